"""Benchmark decontamination by templates, which also finds questions asked again with other parameters.

Numbers (digits or spelled), units and names become typed placeholders; a run of
names or of numbers is one. Windows of SIZE template words of the benchmark are
hash-joined with those of every document. On each diagonal (a document's place
less the item's) a value that a placeholder of the item stands for must be bound to
one value of the document throughout; several values may share one. Of a value with
several bindings the commonest holds (then one that changes nothing, then the first),
and the windows that contradict it are dropped, not the diagonal. A run at an item's
edge, which may go on outside of it, is bound freely. An item is found where the
windows that remain, on all diagonals together, are `share` of its own.

A capitalised word is a name if it stands once in the text where no sentence
begins. As a passage may be set into a sentence, or into a long text that holds its
words capitalised elsewhere, texts with names are read in four ways: with names, with
all of them as words, with those inside sentences only, and with those that stand so
within LOCAL words. An item of fewer than SIZE template words is also searched for as a
window of its own length, each word of a run by itself, anywhere in a text; but one of
fewer than LEAST words is found only where it is all of a text.

Nulls and edges: windows of placeholders alone tell nothing and are left out; a
null or wordless text has no windows; an item or a document of
fewer words than SIZE is one window as a whole; an item without words is never
found; rows with a null doc_id or repeated rows are each searched on their own (a
null id is reported as null); equal items are each reported; texts of any length
are searched whole; empty tables give empty results; other columns are ignored, and
pass through `decontaminate`, whatever their names; it judges a row by its text alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh, hot_keys, spread_join, staged, text_or_empty
from .shingles import mix, run_hashes, runs, seeds, word_hashes

SIZE, SHARE = 5, 0.8
#: Words that an item must have to be searched for inside of other texts.
LEAST = 2
#: Words within which a capitalised word must stand inside a sentence to be a name beside it.
LOCAL = 100
#: Windows of the benchmark that are shipped to the tasks at once; a larger benchmark is searched for block by block.
SHIPPED = 1 << 20

#: Numbers as words.
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half third quarter twice thrice".split())
#: Units of measure and of money.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs oz ton tons ml l liter liters litre litres gallon gallons pint pints cup cups "
    "second seconds minute minutes hour hours day days week weeks month months year years percent degree degrees dollar dollars cent cents euro euros kmh mph kph meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters".split()
)
PLAIN, NUMBER, UNIT, NAME = range(4)
#: A slot that is bound to anything, and the first way of reading short items by themselves.
FREE, SHORT = -1, 10
_PLACES = seeds(SIZE + 1, 40_000) | np.uint64(1)
_TYPED = seeds(4, 41_000)


def _flags(*bytes_: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(bytes_)] = True
    return out


_DIGITS, _UPPER, _LOWER = _flags(*b"0123456789"), _flags(*range(65, 91)), _flags(*range(97, 123))
#: What lies between template words: all ASCII but letters and digits, so that 3.5 or 1,000 are runs of numbers.
_BETWEEN = ~(_DIGITS | _UPPER | _LOWER) & (np.arange(256) < 128)
#: A sentence begins behind these.
_ENDERS = _flags(*b".!?:\n\r")


def _known(words: frozenset[str]) -> np.ndarray:
    return np.sort(np.concatenate([word_hashes(w) for w in words]))


_NUMBERS, _UNITS = _known(NUMBERS), _known(UNITS)


def _among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def capitals(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, kinds, capital, inside): words without names, the places of capitalised ones, and which stand inside a sentence."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    starts, ends = runs(raw, _BETWEEN)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    upper = np.flatnonzero(_UPPER[raw])
    low = raw.copy()
    low[upper] += 32
    hashes = run_hashes(low, starts, ends)
    kinds = np.where(_DIGITS[raw[starts]] | _among(hashes, _NUMBERS), NUMBER, np.where(_among(hashes, _UNITS), UNIT, PLAIN))
    capital = np.flatnonzero(_UPPER[raw[starts]] & (kinds == PLAIN) & (ends - starts > 1))
    small = np.concatenate([[0], np.cumsum(_LOWER[raw])])
    capital = capital[small[ends[capital]] - small[starts[capital]] == ends[capital] - starts[capital] - 1]
    enders = np.flatnonzero(_ENDERS[raw])
    before = np.where(capital > 0, ends[capital - 1], 0)
    inside = (np.searchsorted(enders, starts[capital]) == np.searchsorted(enders, before)) & (capital > 0)
    return hashes, kinds, capital, inside


def named(kinds: np.ndarray, places: np.ndarray) -> np.ndarray:
    out = kinds.copy()
    out[places] = NAME
    return out


def near_inside(hashes: np.ndarray, capital: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Of `capital` the places whose word stands inside a sentence within LOCAL words."""
    _, words = np.unique(hashes[capital], return_inverse=True)
    keys = words * (len(hashes) + 2 * LOCAL) + capital
    known = np.sort(keys[inside])
    return capital[np.searchsorted(known, keys + LOCAL, "right") > np.searchsorted(known, keys - LOCAL)]


def template(hashes: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of names or numbers made one, whose value is its words' in order."""
    again = np.flatnonzero((kinds[1:] == kinds[:-1]) & ((kinds[1:] == NAME) | (kinds[1:] == NUMBER))) + 1
    if not len(again):
        return hashes, kinds
    starts = np.delete(np.arange(len(hashes)), again)
    place = np.arange(len(hashes)) - np.repeat(starts, np.diff([*starts, len(hashes)]))
    return np.add.reduceat(hashes * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), starts), kinds[starts]


def readings(text: str | None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(way, hashes, kinds), runs not yet made one: with names; where there are any, also with all of them as words, and
    in the two ways of taking fewer of them."""
    hashes, kinds, capital, inside = capitals(text)
    if not inside.any():
        return [(0, hashes, kinds)]
    ways = [named(kinds, capital[_among(hashes[capital], np.unique(hashes[capital[inside]]))]), kinds, named(kinds, capital[inside]), named(kinds, near_inside(hashes, capital, inside))]
    return [(way, hashes, k) for way, k in enumerate(ways) if not any((k == other).all() for other in ways[:way])]


def windows(hashes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """A hash of each run of SIZE template words, or of all where there are fewer."""
    words = np.where(kinds == PLAIN, hashes, _TYPED[kinds])
    n = len(words)
    if not n:
        return words
    if n < SIZE:
        return mix((words * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = words[: n - SIZE + 1] * _PLACES[0]
    for k in range(1, SIZE):
        total += words[k : n - SIZE + 1 + k] * _PLACES[k]
    return mix(total)


def short_windows(hashes: np.ndarray, kinds: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of `length` words, other than those of `windows`."""
    words = np.where(kinds == PLAIN, hashes, _TYPED[kinds])
    n = len(words) - length + 1
    if n < 1:
        return words[:0]
    total = np.full(n, length, np.uint64)
    for k, place in enumerate(seeds(length, 42_000) | np.uint64(1)):
        total += words[k : k + n] * place
    return mix(total)


def item_windows(items: DataFrame) -> DataFrame:
    """(item, item_id, way, place, total, window, slots, length): length is that of a short item's window, or 0; slots are the hash and kind of each placeholder in the window, by offset."""

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for item, item_id, text in part[["item", "item_id", "text"]].itertuples(index=False, name=None):
                for way, words, own in readings(text):
                    hashes, kinds = template(words, own)
                    found = windows(hashes, kinds).astype(np.int64)
                    if len(kinds) < SIZE and len(own) >= LEAST and (own == PLAIN).any():
                        rows.append((item, item_id, SHORT + way, 0, 1, int(short_windows(words, own, len(own)).astype(np.int64)[0]), slots_of(words, own, 0, len(own)), len(own)))
                    places = [p for p in range(len(found)) if (kinds[p : p + SIZE] == PLAIN).any()]
                    rows += [(item, item_id, way, p, len(places), int(found[p]), slots_of(hashes, kinds, p, free=True), 0) for p in places]
            yield pd.DataFrame(rows, columns=["item", "item_id", "way", "place", "total", "window", "slots", "length"])

    return items.mapInPandas(cut, "item long, item_id long, way int, place int, total int, window long, slots array<struct<offset:int,kind:int,value:long>>, length int")


def slots_of(hashes: np.ndarray, kinds: np.ndarray, place: int, size: int = SIZE, free: bool = False) -> list[tuple[int, int, int]]:
    """(offset, kind, value) of the placeholders of a window; if `free`, runs at the text's edges are of the kind FREE."""
    edges = (0, len(kinds) - 1) if free else ()
    return [(k - place, FREE if k in edges and kinds[k] != UNIT else int(kinds[k]), int(hashes[k : k + 1].astype(np.int64)[0])) for k in range(place, min(place + size, len(kinds))) if kinds[k] != PLAIN]


def document_hits(source: DataFrame, wanted: np.ndarray, lengths: list[int]) -> DataFrame:
    """(row, doc_id, way, at, window, slots) of the windows of `source` (row, doc_id, text) that are among `wanted`, sorted
    hashes; `lengths` are those of short items."""
    shipped = source.sparkSession.sparkContext.broadcast(wanted)  # SHIPPED at most

    def search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shipped.value
        for part in parts:
            rows = []
            for row, doc_id, text in zip(part["row"], part["doc_id"].astype("Int64"), part["text"]):
                for way, words, own in readings(text):
                    hashes, kinds = template(words, own)
                    for size, found in [(0, windows(hashes, kinds)), *((n, short_windows(words, own, n)) for n in lengths)]:
                        found = found.astype(np.int64)
                        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                        for place in np.flatnonzero(known[at] == found).tolist() if len(found) else ():
                            slots = slots_of(words, own, place, size) if size else slots_of(hashes, kinds, place)
                            rows.append((row, doc_id, SHORT + way if size else way, place, int(found[place]), slots))
            yield pd.DataFrame(rows, columns=["row", "doc_id", "way", "at", "window", "slots"]).astype({"doc_id": "Int64"})

    return source.mapInPandas(search, "row long, doc_id long, way int, at long, window long, slots array<struct<offset:int,kind:int,value:long>>")


def blocks_of_items(items: DataFrame, shipped: int) -> Iterator[tuple[DataFrame, np.ndarray]]:
    """The items' windows in blocks of at most about `shipped`, each with its sorted distinct hashes."""
    count = items.count()
    n = max(1, -(-count // shipped))
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) if n > 1 else items
        hashes = np.unique(np.array([r[0] for r in block.select("window").distinct().toLocalIterator()], np.int64))
        if len(hashes):
            yield block, hashes


def agreeing(places: list[int], bindings: list[list[tuple[int, int, int, int]]]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(places, bindings without their offsets) of the windows of a diagonal, bound (offset, kind, from, to), that agree with
    the binding that holds of each value: the commonest, then one that changes nothing, then the first."""
    votes: Counter = Counter()
    first: dict[tuple[int, int, int], int] = {}
    for place, bound in zip(places, bindings):
        votes.update({b[1:] for b in bound})
        for b in bound:
            first[b[1:]] = min(first.get(b[1:], place + b[0]), place + b[0])
    holds: dict[tuple[int, int], tuple[int, bool, int, int]] = {}
    for (kind, a, b), n in votes.items():
        own = (n, a == b, -first[kind, a, b], b)
        holds[kind, a] = max(holds.get((kind, a), own), own)
    kept = [(p, bound) for p, bound in zip(places, bindings) if all(holds[kind, a][3] == b for _, kind, a, b in bound)]
    return [p for p, _ in kept], sorted({b[1:] for _, bound in kept for b in bound})


def _consistent(met: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., places, bound) of each diagonal of `met` (keys..., diagonal, place, bound): what agrees there. A diagonal
    has a window for each of the item's at most."""
    fields = {f.name: f.dataType.simpleString() for f in met.schema}
    gathered = met.groupBy(*keys, "diagonal").agg(F.collect_list(F.struct("place", "bound")).alias("windows"))

    def agree(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = [agreeing([w["place"] for w in own], [[(b["offset"], b["kind"], b["from"], b["to"]) for b in w["bound"]] for w in own]) for own in part["windows"]]
            out = part[keys].astype({k: "Int64" for k in keys})
            out["places"] = [places for places, _ in found]
            out["bound"] = [[{"kind": k, "from": a, "to": b} for k, a, b in bound] for _, bound in found]
            yield out

    return gathered.mapInPandas(agree, ", ".join(f"{k} {fields[k]}" for k in keys) + ", places array<int>, bound array<struct<kind:int,from:long,to:long>>")


def _contaminated(source: DataFrame, benchmark: DataFrame, share: float, shipped: int, once: bool) -> DataFrame:
    """`contaminated` for (row, doc_id, text); with `once` rows of one (row, doc_id) are the same text and count as one."""
    spark: SparkSession = source.sparkSession
    named = benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = staged(item_windows(named), "benchmark-windows")
    lengths = sorted(r[0] for r in items.where("length > 0").select("length").distinct().collect())  # SIZE template words at most, so few
    schema = "row long, doc_id long, item_id long, n_windows int, n_found long, coverage double, n_slots long, n_changed long"
    out = spark.createDataFrame([], schema)
    for block, hashes in blocks_of_items(items, shipped):
        own = block.select("item", "item_id", F.col("way").alias("item_way"), "place", "total", F.col("window").alias("w"), F.col("slots").alias("item_slots"))
        hits = document_hits(source, hashes, lengths)
        hits = staged(hits.dropDuplicates(["row", "doc_id", "way", "at", "window"]) if once else hits, "benchmark-hits")
        # A passage that many documents hold is one window: its hits are dealt over tasks.
        hot = hot_keys(hits.groupBy("window").agg(F.count(F.lit(1)).alias("n")))
        met = spread_join(hits, own, ["window"], ["w"], "row", hot)
        met = met.where((F.col("way") >= SHORT) == (F.col("item_way") >= SHORT))  # a short item by itself only meets windows of its own
        bound = F.transform(F.arrays_zip("item_slots", "slots"), lambda s: F.struct(s["item_slots"]["offset"].alias("offset"), s["item_slots"]["kind"].alias("kind"), s["item_slots"]["value"].alias("from"), s["slots"]["value"].alias("to")))
        # A diagonal belongs to one way of reading either side; a passage lies on one, or on a few where words were put in or left out.
        keys = ["row", "doc_id", "item", "item_id", "item_way", "total"]
        placed = met.select(*keys, F.concat_ws(":", "way", F.col("at") - F.col("place")).alias("diagonal"), "place", F.filter(bound, lambda b: b["kind"] != FREE).alias("bound"))
        found = _consistent(placed, keys).groupBy(*keys).agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_found"), F.array_distinct(F.flatten(F.collect_list("bound"))).alias("bound")
        )
        covered = found.where(F.col("n_found") >= share * F.col("total")).select(
            "row",
            "doc_id",
            "item",
            "item_id",
            "item_way",
            F.col("total").alias("n_windows"),
            "n_found",
            (F.col("n_found") / F.col("total")).alias("coverage"),
            F.size("bound").cast("long").alias("n_slots"),
            F.size(F.filter("bound", lambda b: b["from"] != b["to"])).cast("long").alias("n_changed"),
        )
        # Of the readings of an item the one that is found the more counts.
        figures = F.struct("n_windows", "n_found", "coverage", "n_slots", "n_changed")
        best = covered.groupBy("row", "doc_id", "item", "item_id").agg(F.max_by(figures, F.struct("coverage", -F.col("item_way"))).alias("best"))
        out = out.union(best.select("row", "doc_id", "item_id", "best.*"))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, shipped: int = SHIPPED) -> DataFrame:
    """(row, doc_id, item_id, n_windows, n_found, coverage, n_slots, n_changed): a row for each item found in a row of `docs`.

    n_slots counts the item's bound values, n_changed those that the document has otherwise; with n_changed > 0 it is
    the item with other parameters.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _contaminated(source, benchmark, share, shipped, False)


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of `docs` in which no item is found, with their columns. A text is told by 128 bits of its hash, so that rows
    are judged each by its own text, whatever their ids."""
    told = F.xxhash64(text_or_empty()), F.xxhash64(F.lit(7), text_or_empty())
    source = docs.select(told[1].alias("row"), told[0].alias("doc_id"), F.col("text").cast("string").alias("text"))
    a, b = fresh(docs, "a"), fresh(docs, "b")
    dirty = staged(_contaminated(source, benchmark, share, SHIPPED, True).select(F.col("doc_id").alias(a), F.col("row").alias(b)).distinct(), "contaminated")
    return docs.join(dirty, (told[0] == F.col(a)) & (told[1] == F.col(b)), "left_anti")
