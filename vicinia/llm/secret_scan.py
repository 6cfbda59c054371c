"""Secret scans through a trigram inverted index, in DataFrame functions only.

From each rule's pattern a Boolean trigram query is derived on the driver: a
list of clauses, all of which must hold, each a choice of trigram sets of which
one must be there whole. The index holds a posting (trigram, text key) for every
trigram that some query asks for, found in one pass over a text; postings are
intersected by text, candidates are verified with the pattern itself, and the offsets
of their matches are running sums of the lengths between them. A rule without a
mandatory trigram scans every text.

Offsets are code points, ends exclusive; matches are leftmost and do not
overlap within a rule. Nulls and edges: a null text counts as empty, without
spans; equal texts share their postings, so null and repeated doc_ids need no
care; texts are scanned whole, in work that grows with their length and matches; an
empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import staged, text_key, text_or_empty

Clause = list[frozenset[str]]

#: More strings than this are not multiplied out when a query is derived.
MOST_STRINGS = 32


@dataclass(frozen=True)
class Rule:
    """`group` of each match of `pattern` must have `least` characters, or the match is dropped."""

    kind: str
    pattern: str
    group: int
    least: int


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: What the index finds besides: key blocks and the prefixed tokens of two services.
MORE_RULES = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
)


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> list[Clause]:
    """The clauses that any text with a match of `pattern` fulfils, in lower case; none if no trigram is mandatory."""
    clauses: list[Clause] = []

    def close(strings: list[str]) -> None:
        sets = [trigrams(s) for s in strings]
        if all(sets):
            clauses.append(sorted(set(sets), key=sorted))

    def walk(parts) -> list[str]:
        """The strings that the last stretch of `parts` can be; earlier stretches are closed as clauses."""
        run = [""]
        for op, arg in parts:
            if (now := strings_of(op, arg)) is None or len(run) * len(now) > MOST_STRINGS:
                close(run)
                run = [""] if now is None else now
            else:
                run = sorted({a + b for a, b in product(run, now)})
        return run

    def strings_of(op, arg) -> list[str] | None:
        if op is sre.LITERAL:
            return [chr(arg).lower()]
        if op is sre.IN and arg[0][0] is not sre.NEGATE and all(k is sre.LITERAL or k is sre.RANGE and v[1] - v[0] < MOST_STRINGS for k, v in arg):
            found = {chr(c).lower() for k, v in arg for c in ([v] if k is sre.LITERAL else range(v[0], v[1] + 1))}
            return sorted(found) if len(found) <= 6 else None
        if op is sre.SUBPATTERN:
            return finite(arg[3])
        if op is sre.BRANCH:
            options = [finite(branch) for branch in arg[1]]
            if any(o is None for o in options):
                return None
            return sorted({s for o in options for s in o})
        if op is sre.MAX_REPEAT and arg[1] <= 1:
            inner = finite(arg[2])
            return None if inner is None else sorted({*inner, *([""] if arg[0] == 0 else [])})
        if op is sre.MAX_REPEAT and arg[0] == arg[1] and arg[1] <= 8:
            inner = finite(arg[2])
            return None if inner is None or len(inner) > 1 else [inner[0] * arg[1]]
        return None

    def finite(parts) -> list[str] | None:
        run = [""]
        for op, arg in parts:
            now = strings_of(op, arg)
            if now is None or len(run) * len(now) > MOST_STRINGS:
                return None
            run = sorted({a + b for a, b in product(run, now)})
        return run

    close(walk(parser.parse(pattern)))
    return clauses


def _one_of(characters: Sequence[str]) -> str:
    return "[" + "".join(c if c.isalnum() else f"\\{c}" for c in sorted(set(characters))) + "]"


def trigram_pattern(vocabulary: Sequence[str]) -> str:
    """A pattern that matches before each of the trigrams, which is its group: by their first letters, then by their second."""
    tree: dict[str, dict[str, list[str]]] = {}
    for t in vocabulary:
        tree.setdefault(t[0], {}).setdefault(t[1], []).append(t[2])
    rest = "|".join(f"{_one_of([a])}(?:{'|'.join(_one_of([b]) + _one_of(last) for b, last in more.items())})" for a, more in tree.items())
    return f"(?={_one_of(list(tree))})(?=({rest}))"


def posting_index(docs: DataFrame, vocabulary: Sequence[str] | None) -> DataFrame:
    """Postings (trigram, key) of the lowered texts, of one pass over each: of the trigrams in `vocabulary`, or of all where it is None."""
    text = text_or_empty()
    pattern = "(?s)(?=(...))" if vocabulary is None else trigram_pattern(vocabulary)
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)))
    return docs.select(text_key(text).alias("key"), F.explode(found).alias("trigram")).select("trigram", "key")


def candidates(index: DataFrame, queries: dict[str, list[Clause]]) -> DataFrame:
    """(key, rules): the texts whose postings fulfil a query, with the kinds of the rules whose queries they do."""
    wanted = sorted({t for clauses in queries.values() for clause in clauses for choice in clause for t in choice})
    present = index.where(F.col("trigram").isin(wanted)).groupBy("key").agg(F.collect_set("trigram").alias("present"))

    def holds(clauses: list[Clause]) -> Column:
        every = F.lit(True)
        for clause in clauses:
            some = F.lit(False)
            for choice in clause:
                some = some | (F.size(F.array_intersect("present", F.array(*[F.lit(t) for t in sorted(choice)]))) == len(choice))
            every = every & some
        return every

    rules = F.array_compact(F.array(*[F.when(holds(clauses), F.lit(kind)) for kind, clauses in queries.items()]))
    return present.select("key", rules.alias("rules")).where(F.size("rules") > 0)


def pieces(text: Column, rule: Rule, place: int) -> Column:
    """An array of (place, at, gap, hit, part): of each match in order the lengths of the text before it, of itself, and of
    the group that counts."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    zipped = F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), 1, F.size(whole)).alias("gap"), whole.alias("hit"))

    def lengths(piece: Column, at: Column) -> Column:
        part = F.regexp_extract(piece["hit"], rule.pattern, rule.group) if rule.group else piece["hit"]
        return F.struct(F.lit(place).alias("place"), at.alias("at"), F.char_length(piece["gap"]).alias("gap"), F.char_length(piece["hit"]).alias("hit"), F.char_length(part).alias("part"))

    return F.transform(zipped, lengths)


def joined(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def spans(hits: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(row, found) for the rows (row, hits) that have matches: an array of (start, place, kind, end).

    A match's offset is the sum of what lies before it; the windows run over the matches of one rule in one row.
    """
    upto = Window.partitionBy("row", "place").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = hits.select("row", F.explode("hits").alias("h")).select("row", "h.*").withColumn("end", F.sum(F.col("gap") + F.col("hit")).over(upto))
    rule = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.least).alias("least")) for r in rules])[F.col("place")]
    kept = placed.where(F.col("part") >= rule["least"])
    own = F.struct((F.col("end") - F.col("hit")).alias("start"), "place", rule["kind"].alias("kind"), "end")
    return kept.groupBy("row").agg(F.collect_list(own).alias("found"))


def find_secrets(docs: DataFrame, base: Sequence[Rule] = BASE_RULES, more: Sequence[Rule] = MORE_RULES, vocabulary: Sequence[str] | None = ()) -> DataFrame:
    """(doc_id, n_<kind> of the base rules, base_sha256, spans) for each row of `docs`.

    `vocabulary` is what the index covers: by default the trigrams that the rules ask for, None for every trigram.
    """
    rules = [*base, *more]
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    if vocabulary is not None and not vocabulary:
        vocabulary = sorted({t for q in queries.values() for clause in q for choice in clause for t in choice})
    index = staged(posting_index(docs, vocabulary), "trigram-postings")
    text = text_or_empty()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("key"))
    # The candidates are written first, so that the join has a plain table on either side and a hot text's rows can be split.
    joined_docs = keyed.join(staged(candidates(index, queries), "trigram-candidates"), "key", "left")
    none = F.array().cast("array<struct<place:int,at:int,gap:int,hit:int,part:int>>")
    due = [F.array_contains("rules", r.kind) if r.kind in queries else F.col("text").rlike(r.pattern) for r in rules]
    hits = F.concat(*[F.when(d, pieces(F.col("text"), r, i)).otherwise(none) for i, (d, r) in enumerate(zip(due, rules))])
    # Written, so that a row keeps its number; what is held of it are a few numbers a match.
    matched = staged(joined_docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", hits.alias("hits")), "secret-matches")
    told = spans(matched.where(F.size("hits") > 0), rules).withColumnRenamed("row", "of")
    found = F.coalesce("found", F.array().cast("array<struct<start:bigint,place:int,kind:string,end:bigint>>"))
    own = F.filter(found, lambda s: s["place"] < len(base))
    every = matched.select("row", "doc_id").join(told, F.col("row") == F.col("of"), "left")
    places = F.transform(found, lambda s: s["place"])
    counts = [F.size(F.filter(places, lambda p: p == i)).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(base)]
    return every.select("doc_id", *counts, F.sha2(joined(own), 256).alias("base_sha256"), joined(found).alias("spans"))
