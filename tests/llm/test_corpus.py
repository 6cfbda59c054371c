"""Toxicity, near-dedup, WARC, decontamination, mixing and the pipeline against brute force."""

import base64
import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vicinia import skew
from vicinia.llm import components, decontamination, minhash, mixing, shingles, toxicity, warc
from vicinia.llm._common import scratch_path

from .docs import AWKWARD, near_copies, table, texts

SPACES = b" \t\n\x0b\x0c\r"


def words(t):
    return (t or "").encode().lower().split()


def shingle_set(t, size):
    w = words(t)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def roots(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


# --- hashes -----------------------------------------------------------------------


def test_words_and_shingles():
    docs = [*AWKWARD, *texts(30, 2), "A\x1cb \x85c\xa0d", "Long" * 700_000 + " tail a b"]
    seen = {}
    for t in docs:
        found = shingles.word_hashes(t)
        assert len(found) == len(words(t))
        for w, h in zip(words(t), found.tolist()):
            assert seen.setdefault(w, h) == h
        for size in (1, 4):
            assert len(shingles.shingle_set(t, size)) == len(shingle_set(t, size))
    assert len(set(seen.values())) == len(seen)
    chunk, shingles.CHUNK = shingles.CHUNK, 7  # whatever the chunks, the hashes are the same
    try:
        small = [shingles.word_hashes(t).tolist() for t in docs[:-1]]
    finally:
        shingles.CHUNK = chunk
    assert small == [shingles.word_hashes(t).tolist() for t in docs[:-1]]


def test_sketches_estimate_similarity():
    r = np.random.default_rng(0)
    for size in (1, 2, 7, 60, 3000):
        a = r.integers(0, 2**63, size).astype(np.uint64)
        places = minhash.sketch(a)
        assert (places < np.uint64(2**64 - 1)).all() and (places == minhash.sketch(a[::-1].copy())).all()
        if size > 5:
            keep = a[: int(size * 0.8)]
            estimate = (minhash.sketch(keep) == places).mean()
            assert abs(estimate - len(keep) / size) < 5 * (0.16 / minhash.COORDINATES) ** 0.5
    assert len(np.unique([minhash.bands_of(minhash.sketch(r.integers(0, 2**63, 50).astype(np.uint64))) for _ in range(20)])) == 20 * minhash.BANDS
    assert 60 < minhash.least_equal(0.8) < 90


# --- near-duplicates --------------------------------------------------------------


@pytest.mark.parametrize("small", [minhash.SMALL, 2])
@pytest.mark.parametrize("size, percent", [(4, 80)])
def test_near_duplicates(spark, monkeypatch, size, percent, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 500)
    docs = near_copies(60) + near_copies(20, 5, (3, 5, 6, 7, 8)) + AWKWARD + AWKWARD + ["a b c", "A B C", "a b"]
    sets = [shingle_set(t, size) for t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = roots(len(docs), links)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(table(spark, docs), size, percent).collect()}
    assert len(set(want)) < len(docs)
    for i in range(len(docs)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i), docs[i]


def test_near_duplicates_without_ids(spark):
    t = " ".join(f"w{i}" for i in range(60))
    docs, ids = [t, t, t + " x", "one two three four", None, t, "one two three four five"], [None, 9, 4, None, None, 9, 4]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(table(spark, docs, ids)).collect()]
    assert sorted(got, key=str) == sorted([(None, 4, False), (9, 4, False), (9, 4, False), (4, 4, True), (4, 4, True), (None, None, True), (None, None, True)], key=str)
    assert minhash.near_duplicates(table(spark, [])).count() == 0
    kept = minhash.deduplicated(table(spark, docs, ids), 4, 80)
    assert kept.columns == table(spark, []).columns and kept.count() == 4


def test_rows_of_repeated_and_missing_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    docs = [a, b, b, c, c, c + "  ", f"{c} more", "", "", a + " and more", b]
    ids = [5, 5, 3, None, None, None, None, None, 7, 2, 3]
    df = table(spark, docs, ids)
    got = [(r["doc_id"], (r["text"] or "")[:2]) for r in minhash.deduplicated(df, 4, 80).collect()]
    assert sorted(got, key=str) == sorted([(3, "b0"), (2, "a0"), (None, "c0"), (None, ""), (7, "")], key=str)
    rows = [(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, 4, 80).collect()]
    assert [r for r in rows if r[0] == 5] and sorted(r for r in rows if r[0] == 5) == [(5, 2, False), (5, 3, False)]
    assert sorted(r for r in rows if r[0] in (2, 3)) == [(2, 2, True), (3, 3, True), (3, 3, True)]
    alone = [(r["doc_id"], r["text"][:2]) for r in minhash.deduplicated(table(spark, [a, b, b], [5, 5, 3]), 4, 80).collect()]
    assert sorted(alone) == [(3, "b0"), (5, "a0")]


@pytest.mark.parametrize("small", [minhash.SMALL, 2])
def test_one_row_of_each_group_whatever_the_ids(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 500)
    docs = near_copies(30) + AWKWARD + near_copies(30)[20:40]
    r = random.Random(8)
    ids = [r.choice([None, *range(12)]) for _ in docs]
    sets = [shingle_set(t, 4) for t in docs]
    want = roots(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    groups = {}
    for i, c in enumerate(want):
        groups.setdefault(c, []).append(i)
    df = table(spark, docs, ids, extra=False).toPandas().assign(n_chars=range(len(docs)), doc_id=pd.array(ids, "Int64"))
    df = spark.createDataFrame(df.astype(object).where(df.notna(), None).values.tolist(), "doc_id long, text string, lang string, source string, n_chars int")
    kept = {x["n_chars"] for x in minhash.deduplicated(df, 4, 80).collect()}
    for own in groups.values():
        (one,) = kept & set(own)
        least = min((ids[i] for i in own if ids[i] is not None), default=None)
        assert ids[one] == least
    found = sorted((x["doc_id"] is None, x["doc_id"] or 0, x["component_id"] is None, x["component_id"] or 0) for x in minhash.near_duplicates(df, 4, 80).collect())
    told = [min((ids[j] for j in groups[want[i]] if ids[j] is not None), default=None) for i in range(len(docs))]
    assert found == sorted((x is None, x or 0, y is None, y or 0) for x, y in zip(ids, told))


def test_hot_keys_are_dealt_over_tasks(spark, monkeypatch):
    """One family of near copies and one text that a third of all rows repeat, every key of theirs hot."""
    monkeypatch.setattr(skew, "FEW", 0)
    monkeypatch.setattr(skew, "LEAST", 3)
    monkeypatch.setattr(skew, "PARTS", 20)
    monkeypatch.setattr(minhash, "BLOCK", 500)
    r = random.Random(21)
    base = " ".join(f"w{i}" for i in range(70)).split()
    docs = [" ".join(w if r.random() > 0.02 else f"v{r.random()}" for w in base) for _ in range(60)] + [" ".join(base)] * 40 + texts(30, 5)
    sets = [shingle_set(t, 4) for t in docs]
    want = roots(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])])
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(table(spark, docs), 4, 80).collect()}
    assert got == dict(enumerate(want)) and want.count(want[60]) > 60


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)] + [(5, 5)]
    n = 500
    want = roots(n, edges)
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: want[i] for a, b in edges for i in (a, b) if a != b}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars already, as near-dedup's pointers mostly are, are written once; a path takes rounds."""
    written, staged = [], components.staged
    monkeypatch.setattr(components, "staged", lambda df, name: written.append(name) or staged(df, name))
    edges = spark.createDataFrame([(i, i % 7) for i in range(7, 60)], "a long, b long")
    assert {x["node"]: x["component"] for x in components.components(edges).collect()} == {i: i % 7 for i in range(60)}
    assert len(written) == 1
    path = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    assert {x["component"] for x in components.components(path).collect()} == {0} and len(written) > 2


def test_near_dedup_takes_few_stages(spark):
    """What it costs on small tables is Spark's stages."""
    docs = near_copies(60) + texts(30, 5)
    context, group = spark.sparkContext, "near-dedup-stages"
    context.setJobGroup(group, group)
    try:
        minhash.near_duplicates(table(spark, docs), 4, 80).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    jobs = [context.statusTracker().getJobInfo(j) for j in context.statusTracker().getJobIdsForGroup(group)]
    assert jobs and sum(len(set(j.stageIds)) for j in jobs) <= 80


# --- WARC -------------------------------------------------------------------------


def pages(spark, html, ids=None):
    rows = [(i if ids is None else ids[i], None if i % 4 == 0 else f"http://h{i}.example/é?q={i}", h, 1) for i, h in enumerate(html)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, first long")


def digest(h):
    return base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()


@pytest.mark.parametrize("split", [64, 1000, warc.SPLIT])
def test_warc_round_trip(spark, split):
    r = random.Random(1)
    html = [f"<p>{r.random()}</p>" * r.randint(0, 9) for _ in range(60)] + [None, "", "<b>é😀</b>\r\n\r\nWARC/1.1\r\n"] * 2 + ["\x1f\x8b\x08" * 50, "z" * 300_000] * 2
    first = {}
    for i, h in enumerate(html):
        first.setdefault(digest(h), i)
    got = {x["page_id"]: x for x in warc.round_trip(pages(spark, html), split=split).collect()}
    assert len(got) == len(html)
    for i, h in enumerate(html):
        f = first[digest(h)]
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == (len((h or "").encode()), digest(h), "response" if f == i else "revisit", None if f == i else f)


def test_warc_payloads_and_urls_come_back(spark):
    html = ["<a>", "<a>", None, "é" * 9]
    path = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(pages(spark, html), path, archive_bytes=300)
    got = {x["page_id"]: x for x in warc.read_archives(manifest, path, 100, payloads=True).collect()}
    assert manifest.count() > 1 and sum(m["records"] for m in manifest.collect()) == 4
    assert bytes(got[3]["payload"]).decode() == html[3] and got[1]["payload"] is None and bytes(got[2]["payload"]) == b""
    assert got[3]["url"] == "http://h3.example/é?q=3" and got[0]["url"] == "urn:page:0"


def test_warc_damage_is_told(spark):
    import pyarrow.fs

    members = [warc.record(str(i), None, f"<p>page {i} {random.Random(i).random()}</p>".encode() * 30, None, "2020-01-01T00:00:00Z", 6) for i in range(5)]
    data, path = b"".join(members), scratch_path(spark, "warc-damaged")
    file = f"{path.removeprefix('file://')}/one.warc.gz"
    fs, root = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(file, compression=None) as out:
        out.write(data)
    manifest = spark.createDataFrame([(file, len(data), 5)], "file string, bytes long, records long")
    whole = sorted(map(tuple, warc.read_archives(manifest, path).select("offset", "page_id", "file").collect()))
    assert [r[1] for r in whole] == list(range(5)) and warc.checked(manifest, warc.read_archives(manifest, path)).count() == 5
    for at, kind in ((whole[3][0] - 30, "damaged"), (whole[2][0] + 1, None), (len(data) - 40, "damaged")):
        bad = bytearray(data)
        bad[at] ^= 0xFF
        with fs.open_output_stream(whole[0][2], compression=None) as out:
            out.write(bytes(bad))
        got = warc.read_archives(manifest, path, damaged="report")
        assert sorted(r["record_type"] for r in got.collect()) == sorted(["response"] * 4 + [kind] * (kind is not None))
        with pytest.raises(Exception, match="does not decode|of 5 records"):
            warc.checked(manifest, warc.read_archives(manifest, path)).collect()


@pytest.mark.parametrize("split", [100, 1 << 20])
def test_warc_heads_of_any_length(split):
    import io

    r = random.Random(3)
    long = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(90_000))
    swapped = []
    for i, url in enumerate(["http://a/", f"http://{long}/", "http://b/", f"http://c/{'x' * 300_000}"]):
        text = __import__("zlib").decompress(warc.record(str(i), url, b"p", None, "2020-01-01T00:00:00Z", 6), 31).split(b"\r\n")
        text[1:5] = [text[4], text[3], text[2], text[1]]  # the type comes behind the URI
        swapped.append(__import__("gzip").compress(b"\r\n".join(text)))
    data = b"".join(swapped)
    found = [x for s in range(0, len(data), split) for x in warc.records_in(io.BytesIO(data), len(data), s, s + split)]
    assert [warc.parse(d)[0] for _, d in found] == ["0", "1", "2", "3"]


def test_warc_edges(spark):
    assert warc.round_trip(pages(spark, [])).count() == 0
    got = warc.round_trip(pages(spark, ["x", "x", "x", "y", "x"], [None, 3, 3, None, 5])).collect()
    assert sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in got if r["payload_digest"] == digest("x")) == [(-1, "revisit", 3), (3, "response", None), (3, "response", None), (5, "revisit", 3)]
    assert [(r["page_id"], r["record_type"]) for r in got if r["payload_digest"] == digest("y")] == [(None, "response")]


# --- decontamination --------------------------------------------------------------

ITEM = "A train leaves at 9 with Anna aboard. It goes 120 km to meet Peter, and Anna pays 40 dollars for it."


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id int")


def found(spark, docs, bench, **options):
    out = decontamination.contaminated(table(spark, docs), items(spark, [(i, t, 0) for i, t in enumerate(bench)]), **options)
    return {(r["doc_id"], r["item_id"]): r for r in out.collect()}


def test_templates(spark):
    filler = texts(12, 3, 60)
    docs = [
        f"{filler[0]} {ITEM} {filler[1]}",
        f"{filler[2]}\nA train leaves at 7 with Maria aboard. It goes 90 km to meet John Smith, and Maria pays three euros for it.",
        "A train leaves at 7 with Maria aboard. It goes 90 km to meet Maria, and Gustav pays three euros for it.",  # Anna is Maria and Gustav
        " ".join(ITEM.split()[:9]),
        *filler,
        *AWKWARD,
    ]
    got = found(spark, docs, [ITEM, "", None, "a b", "Quite another item of more than five words."])
    assert set(got) == {(0, 0), (1, 0)}
    assert got[0, 0]["n_changed"] == 0 and got[0, 0]["coverage"] == 1.0
    assert got[1, 0]["n_changed"] >= 4


def test_verbatim_as_brute_force(spark):
    bench = [t for t in texts(25, 9, 40) if len(t.split()) >= 5] + ["x y", "x y"]
    r = random.Random(2)
    docs = [" ".join([*texts(1, k)[0].split(), *(w := r.choice(bench).split())[r.randrange(3) :][: r.randint(3, len(w) + 3)], *texts(1, -k)[0].split()]) for k in range(80)] + [*bench[:2], "x y"]
    want = set()
    for i, d in enumerate(docs):
        for j, b in enumerate(bench):
            own = [tuple(b.split()[k : k + 5]) for k in range(max(1, len(b.split()) - 4))]
            if sum(x in shingle_set(d, 5) for x in ([y.encode() for y in o] for o in own) for x in [tuple(x)]) >= 0.8 * len(own):
                want.add((i, j))
    assert set(found(spark, docs, bench)) == want
    assert set(found(spark, docs, bench, shipped=60)) == want  # block by block
    assert found(spark, [], bench) == {} and found(spark, docs, []) == {}


def test_a_passage_that_most_documents_hold(spark):
    short = texts(1, 3)[0]
    docs = [f"{k} {ITEM}" if k % 3 else f"{short} {k}" for k in range(400)]
    got = found(spark, docs, [ITEM])
    assert set(got) == {(k, 0) for k in range(400) if k % 3}
    assert {(r["n_found"], r["n_changed"]) for r in got.values()} == {(next(iter(got.values()))["n_windows"], 0)}


def test_decontaminate_keeps_the_rest(spark):
    docs = table(spark, [ITEM, "fine", None, ITEM], [1, 2, None, None])
    out = decontamination.decontaminate(docs, items(spark, [(0, ITEM, 0)]))
    assert out.columns == docs.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["2", "None"]


def test_what_is_found_wholly(spark):
    filler = texts(4, 3, 60)
    listed = "A box holds 5 red pens and some blue ones. Every pen has a cap of its own, and Tom takes half of them away. The rest is 5"
    sums = "A farmer has 3 cows standing in the stable and buys another group of 5 from the old market nearby this week"
    shop = "Today Anna buys 3 pens. Then Anna meets Peter at school. Later Peter gives Anna 2 pens. Then Anna sells Peter a book."
    away = shop.replace("Anna", "Maria").replace("Peter", "Gustav").replace("3", "7")
    bench = [shop, listed, sums, "What is 2 + 3?", "2 + 3", "x y"]
    docs = [
        f"1. {filler[0]} 12\n{listed}\n2. {filler[1]}",  # between numbered lines
        sums.replace("3", "4").replace("5", "4"),  # two values fall together
        f"{filler[0]} said Then and Later {filler[1]} {'word ' * 300}. {away} {filler[2]}",  # a common word capitalised elsewhere
        f"{filler[0]} What is 2 + 3? 5 {filler[1]}",
        f"{filler[0]} what is 4 + 5 {filler[1]}",
        f"{filler[0]} what is 4 {filler[1]}",
        f"{filler[0]} x y {filler[1]}",
        *filler,
        *AWKWARD,
    ]
    want = {(0, 1), (1, 2), (2, 0), (3, 3), (4, 3), (6, 5)}
    assert set(found(spark, docs, bench)) == want
    kept = {r["doc_id"] for r in decontamination.decontaminate(table(spark, docs), items(spark, [(i, t, 0) for i, t in enumerate(bench)])).collect()}
    assert kept == set(range(len(docs))) - {i for i, _ in want}


def four_numbers(n):
    """Items of prose with four numbers each, other words in every one."""
    words_ = texts(n * 5, 77, 14)
    return [[f"{words_[5 * k]} buys", f"crates of {words_[5 * k + 1]} plums and", f"jars while {words_[5 * k + 2]} the cart holds", f"sacks for {words_[5 * k + 3]} until", f"wagons leave {words_[5 * k + 4]} again"] for k in range(n)]


def filled(parts, numbers):
    return " ".join(x for pair in zip(parts, [*map(str, numbers), ""]) for x in pair if x)


def test_recall_of_four_kinds(spark):
    """Of 40 items with four numbers, set into prose, 0.9 or more are found verbatim, verbatim before a list's number, with other
    numbers, and with all numbers equal; prose with the same numbers is left alone."""
    parts, filler = four_numbers(40), texts(400, 5, 60)
    bench = [filled(p, (3 + k, 11 + 2 * k, 240 + k, 7)) for k, p in enumerate(parts)]
    kinds = {
        "verbatim": bench,
        "before a number": [f"{b} 2." for b in bench],
        "other numbers": [filled(p, (40 + k, 5, 61, 1000 + k)) for k, p in enumerate(parts)],
        "equal numbers": [filled(p, (6, 6, 6, 6)) for p in parts],
    }
    for name, passages in kinds.items():
        docs = [f"{filler[2 * k]} {p} {filler[2 * k + 1]}" for k, p in enumerate(passages)] + [f"{f} {3 + k} {11 + 2 * k}" for k, f in enumerate(filler[100:200])]
        got = set(found(spark, docs, bench))
        assert len(got & {(k, k) for k in range(40)}) >= 36, name
        assert not {pair for pair in got if pair[0] != pair[1]}, name


def test_rows_are_judged_by_their_own_text(spark):
    """Rows that share an id, or have none, do not share their fate; copies of a text do."""
    docs = table(spark, [ITEM, "fine", ITEM, "fine", None, ITEM, "other"], [1, 1, None, None, 1, 2, 2])
    out = decontamination.decontaminate(docs, items(spark, [(0, ITEM, 0)]))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == [("1", "None"), ("1", "fine"), ("2", "other"), ("None", "fine")]


def test_one_word_items_empty_no_corpus(spark):
    assert set(found(spark, ["he said then", "Then", "then", "so"], ["Then", "said then"])) == {(1, 0), (2, 0), (0, 1)}


def test_many_hits_in_one_text(spark):
    bench = [filled(p, (1, 2, 3, 4)) for p in four_numbers(12)]
    got = found(spark, [" and ".join(bench * 40), "word " * 500], bench)
    assert set(got) == {(0, k) for k in range(12)} and {r["coverage"] for r in got.values()} == {1.0}


# --- mixing -----------------------------------------------------------------------


def brute_targets(sizes, weights, share, cap):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal, full = Fraction(share) * sum(sizes.values()), set()
    while True:
        left = goal - sum(cap * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else left * weight[s] / total for s in names}
        over = {s for s in names if s not in full and target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    docs = texts(400, seed, 30) + AWKWARD
    df = table(spark, docs)
    rows = mixing.mix(df).collect()
    sizes = {}
    for r in rows:
        assert r["size"] == len(words(docs[r["doc_id"]])) and r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    target = brute_targets(sizes, [3, 1, 2], 1.5, 2)
    for s, n in sizes.items():
        own = [r for r in rows if r["source"] == s]
        assert {r["source_size"] for r in own} == {n} and own[0]["target"] == pytest.approx(float(target[s]))
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.1 * n + max(r["size"] for r in own)  # copies are whole
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(df.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in rows}
    made = mixing.mixed_documents(df).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in made} == {i: n for i, n in again.items() if n}


def test_mixing_of_missing_and_repeated_ids(spark, monkeypatch):
    """A source without ids, one whose rows share an id, and one whose rows are all alike."""
    import duckdb

    from vicinia.llm.queries import ORACLE_SQL

    monkeypatch.setattr(skew, "FEW", 0)
    monkeypatch.setattr(skew, "LEAST", 20)
    some = texts(300, 4, 12)
    rows = [(None, t, "a") for t in some] + [(5, t, "b") for t in some] + [(7, "one two three", "c")] * 300 + [(None, "x y", None)] * 40 + [(None, None, "a")] * 3
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, extra int").repartition(3)
    got = mixing.mix(df)
    for r in got.groupBy("source", "source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most")).collect():
        assert abs(r["taken"] - r["target"]) <= 0.05 * r["source_size"] + r["most"], r
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    want = db.execute(ORACLE_SQL["op8_mixing"]).fetchall()
    rounded = lambda rows: sorted((str(a), b, c, round(d, 6), e) for a, b, c, d, e in rows)
    assert rounded(map(tuple, got.select("doc_id", "size", "source_size", "target", "taken").collect())) == rounded(want)
    made = mixing.mixed_documents(df)
    assert made.columns == [*df.columns, "copy"]
    count = lambda f: sorted(map(tuple, f.collect()), key=str)
    assert count(made.groupBy("source").count()) == count(got.groupBy("source").agg(F.sum("copies").alias("count")))
    assert made.groupBy("extra").agg(F.max("copy").alias("n"), F.count("copy").alias("m")).where("n != m").count() == 0


def test_mixing_edges(spark, monkeypatch):
    assert mixing.mix(table(spark, [])).count() == 0 and mixing.mixed_documents(table(spark, [])).count() == 0
    assert {r["taken"] for r in mixing.mix(table(spark, [None, "", " "])).collect()} == {0}
    few = sorted(map(tuple, mixing.mix(table(spark, texts(50))).collect()), key=str)
    monkeypatch.setattr(mixing, "FEW", 1)  # sources joined by a shuffle
    assert sorted(map(tuple, mixing.mix(table(spark, texts(50))).collect()), key=str) == few


# --- toxicity ---------------------------------------------------------------------


def insulting(n, seed):
    r = random.Random(seed)
    docs, labels = texts(n, seed, 150), []
    for i in range(n):
        labels.append(int(i % 3 == 0))
        if labels[-1]:
            w = docs[i].split()
            for _ in range(3):
                w.insert(r.randrange(len(w) + 1), r.choice(["vilezz", "rottenqu", "xuqq" + r.choice("abcdefgh") + r.choice("abcdefgh")]))
            docs[i] = " ".join(w)
    return docs, labels


def test_gradients():
    docs, _ = insulting(6, 0)
    low, starts, ends, hashes = toxicity.words_of(" ".join(docs).encode())
    lexicon, which = toxicity.Lexicon.of(low, starts, ends, hashes)
    network = toxicity.Network(lexicon.hashes[:20], 1)
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    windows = np.where(np.arange(toxicity.WINDOW) < 20, np.resize(which, (5, toxicity.WINDOW)), len(lexicon.hashes))
    wanted, weight = np.array([1.0, 0, 1, 0, 1]), np.ones(5)

    class Shown:  # no word is hidden
        @staticmethod
        def random(n):
            return np.ones(n)

    def loss():
        x = network.logits(lexicon, windows).astype(float)
        return float((np.logaddexp(0, x) - wanted * x).mean())

    gradients = network.gradients(lexicon, windows, wanted, weight, Shown)
    for name, g in gradients.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, step = network.p[name][at], 1e-2
        network.p[name][at] = kept + step
        up = loss()
        network.p[name][at] = kept - step
        down = loss()
        network.p[name][at] = kept
        assert (up - down) / (2 * step) == pytest.approx(float(g[at]), rel=0.1, abs=1e-4), name


@pytest.fixture(scope="module")
def network():
    docs, labels = insulting(240, 1)
    return toxicity.fit([t.encode() for t in docs], labels)


def plain_gru(inputs, u):
    """The last and all states over gate inputs, number by number."""
    size = u.shape[0]
    h, states = [0.0] * size, []
    for x in inputs:
        s = [sum(h[i] * float(u[i, j]) for i in range(size)) for j in range(3 * size)]
        z = [1 / (1 + math.exp(-(x[j] + s[j]))) for j in range(size)]
        r = [1 / (1 + math.exp(-(x[size + j] + s[size + j]))) for j in range(size)]
        new = [math.tanh(x[2 * size + j] + r[j] * s[2 * size + j]) for j in range(size)]
        h = [(1 - z[j]) * new[j] + z[j] * h[j] for j in range(size)]
        states.append(h)
    return states


def plain_score(network, text):
    """A text's score, a window, a word and a letter at a time."""
    p = {k: v.astype(float) for k, v in network.p.items()}
    pieces = [w[i : i + toxicity.LONGEST] for w in words(text) for i in range(0, len(w), toxicity.LONGEST)]
    best = 0.0
    for start in range(0, max(len(pieces) - toxicity.WINDOW, 0) + toxicity.STRIDE if pieces else 0, toxicity.STRIDE):
        window = pieces[start : start + toxicity.WINDOW]
        if not window:
            continue
        gates = {"f": [], "b": []}
        for w in window:
            letters = np.frombuffer(w, np.uint8)
            spelled = [v for side, order in (("f", letters), ("b", letters[::-1])) for v in plain_gru([p[f"letter_{side}"][c] for c in order], p[f"char_u_{side}"])[-1]]
            (hashed,) = toxicity.words_of(w)[3].tolist()
            own = network.known.tolist().index(hashed) + 1 if hashed in network.known.tolist() else 0
            for side in "fb":
                gates[side].append(p[f"word_{side}"][own] + np.array(spelled) @ p[f"to_word_{side}"])
        forth, back = plain_gru(gates["f"], p["word_u_f"]), plain_gru(gates["b"][::-1], p["word_u_b"])[::-1]
        states = [np.array([*a, *b]) for a, b in zip(forth, back)]
        attention = [math.exp(np.tanh(s @ p["attend"] + p["attend_b"]) @ p["query"]) for s in states]
        pooled = sum(a * s for a, s in zip(attention, states)) / sum(attention)
        logit = float(pooled @ p["out"] + p["out_b"][0])
        best = max(best, 1 / (1 + math.exp(-(network.slope * logit + network.shift))))
    return best


def test_scores_as_window_by_window(network):
    docs = [t for t in insulting(12, 9)[0]] + AWKWARD[:8] + ["x\u00a0y vilezz\u2003z " * 9, "W" * 60, " ".join(texts(9, 3, 150))]
    got = toxicity.score_texts(network, docs).tolist()
    assert got == pytest.approx([plain_score(network, t) for t in docs], abs=2e-4)


def test_a_toxic_stretch_at_every_place_of_the_grid(network):
    calm = " ".join(texts(40, 31, 60)).split()[:200]
    for place in range(60, 60 + toxicity.STRIDE):
        assert toxicity.score_texts(network, [" ".join([*calm[:place], "vilezz", "rottenqu", "vilezz", *calm[place:]])])[0] >= 0.7


def test_the_sample_is_of_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda t, labels, seed: seen.append((t, labels)))
    docs = [f"{i} " * 50 for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    df = table(spark, docs + docs[:3] + ["0 again"], [*range(40), 0, 1, 2, 0])
    toxicity.train(df, labels)
    toxicity.train(df, labels, sample=6)
    toxicity.train(df, labels, sample_bytes=1000)
    assert [len(t) for t, _ in seen][0] == len({i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1}) and len(seen[1][0]) == 12
    assert sum(map(len, seen[2][0])) <= 1000 and set(seen[2][1]) == {0, 1}
    assert all(t.decode() in docs for t in seen[0][0]) and len(set(seen[0][0])) == len(seen[0][0])


def test_held_out_accuracy(network):
    docs, labels = insulting(200, 2)
    score = toxicity.score_texts(network, docs)
    assert ((score >= 0.7) == np.array(labels, bool)).mean() >= 0.95


def test_whole_texts_are_scored(network):
    calm = " ".join(texts(400, 8, 150))
    assert len(calm) > 100_000
    long = calm * 30 + " vilezz rottenqu vilezz " + calm
    a, b = toxicity.score_texts(network, [long, calm])
    assert a >= 0.7 and a > b
    assert toxicity.score_texts(network, ["x" * 3_000_000, None, "", " \n"])[1:].tolist() == [0, 0, 0]
    some = texts(30, 4)
    together = toxicity.score_texts(network, some)
    assert together == pytest.approx([toxicity.score_texts(network, [t])[0] for t in some], abs=1e-5)


def test_toxic_query(spark):

    docs, labels = insulting(150, 3)
    docs += AWKWARD
    known = spark.createDataFrame([(i, 1, t) for i, t in enumerate(labels)] + [(None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxic_scores(table(spark, docs), known).collect()}
    assert len(got) == len(docs)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    own = [got[i] for i in range(150) if got[i]["held_out"]]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in own]) > 0.8
    kept = toxicity.without_toxic(table(spark, docs), known)
    assert kept.columns == table(spark, []).columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["score"] < 0.7}
    none = toxicity.toxic_scores(table(spark, docs), known.where("toxic = 0"))
    assert {r["score"] for r in none.collect()} == {0.0}
    assert toxicity.toxic_scores(table(spark, []), known).count() == 0


# --- pipeline ---------------------------------------------------------------------


def check_by_brute_force(spark, folder, docs, out):
    """The pipeline's rows `out`, by the operators' brute-force versions one after another."""
    network = toxicity.train(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels")))
    kept = {i: t for i, (t, x) in enumerate(zip(docs, toxicity.score_texts(network, docs))) if x < 0.7}
    key = lambda line: line.strip(SPACES.decode()).translate({c: c + 32 for c in range(65, 91)})
    seen = {}
    for t in kept.values():
        for k in {key(x) for x in (t or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    kept = {i: t if t is None else "\n".join(x for x in t.split("\n") if not key(x) or seen[key(x)] < 10) for i, t in kept.items()}
    ids, sets = list(kept), [shingle_set(t, 5) for t in kept.values()]
    first = roots(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    kept = {i: kept[i] for n, i in enumerate(ids) if first[n] == n and ITEM not in (kept[i] or "")}
    source = {i: None if i % 5 == 0 else f"s{i % 4}" for i in kept}
    sizes = {s: sum(len(words(kept[i])) for i in kept if source[i] == s) for s in set(source.values())}
    target, copies = brute_targets(sizes, [3, 1, 2], 1.5, 2), out.groupby("doc_id").size().to_dict()
    assert set(copies) <= set(kept) and {i: t for i, t in zip(out["doc_id"], out["text"])} == {i: kept[i] for i in copies}
    for s, n in sizes.items():
        own = [i for i in kept if source[i] == s]
        rate = target[s] / n if n else 0
        assert all(copies.get(i, 0) in (math.floor(rate), math.floor(rate) + (rate % 1 > 0)) for i in own)
        assert abs(sum(copies.get(i, 0) * len(words(kept[i])) for i in own) - target[s]) <= 0.1 * n + max(len(words(kept[i])) for i in own)


def test_pipeline(spark, tmp_path):
    docs, labels = insulting(90, 5)
    docs = [t + "\nshared footer line" for t in docs]
    copies = [docs[1], docs[1], docs[2] + " and more"]
    docs += copies + [f"{docs[4]} {ITEM}"] + AWKWARD
    table(spark, docs, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(labels)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert out and list(out[0].asDict()) == [*columns, "copy"]
    ids = {r["doc_id"] for r in out}
    assert not any("shared footer" in (r["text"] or "") for r in out) and not ids & {90, 91, 93}
    toxic = {i for i, t in enumerate(labels) if t}
    assert len(ids & toxic) <= 0.3 * len(toxic)  # few labels
    assert all(r["n_chars"] == len(r["text"]) for r in out if r["text"] is not None)
    frame = pd.DataFrame([r.asDict() for r in out])
    assert (frame.groupby("doc_id", dropna=False)["copy"].max() <= 2).all()
    check_by_brute_force(spark, str(tmp_path), docs, frame)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]


def test_templates_as_their_sql(spark):
    import duckdb

    from vicinia.llm.queries import ORACLE_SQL

    r = random.Random(12)
    names, numbers, units, plain = ["Anna", "Bob", "Peter", "Maria"], ["3", "4.5", "1,000", "twelve", "7th"], ["km", "hours", "dollars"], ["goes", "to", "the", "and", "é", "buys", "X", "mcD", "The"]

    def sentence(n):
        return " ".join(r.choice(r.choice([names, numbers, units, plain, plain])) + r.choice(["", "", "", ".", ",", "!", "\n", ":"]) for _ in range(n))

    def varied(t):
        swap = {a: r.choice(p) if r.random() < 0.6 else a for p in (names, numbers) for a in p}
        return "".join(swap.get(w, w) for w in __import__("re").split(r"([A-Za-z0-9é]+)", t))

    bench = [sentence(r.randint(3, 14)) for _ in range(12)] + [None, "", "Anna", "12 km", ITEM]
    docs = [sentence(r.randint(0, 10)) + " " + varied(r.choice(bench) or "") + " " + sentence(r.randint(0, 6)) for _ in range(150)] + AWKWARD
    got = decontamination.contaminated(table(spark, docs), items(spark, [(i, t, 0) for i, t in enumerate(bench)])).drop("row").toPandas()
    db = duckdb.connect()
    db.register("documents", pd.DataFrame({"doc_id": range(len(docs)), "text": docs}))
    db.register("benchmark", pd.DataFrame({"item_id": range(len(bench)), "text": bench}))
    want = db.execute(ORACLE_SQL["op6_decontamination"]).df()
    order = ["doc_id", "item_id"]
    assert len(want) > 50 and (want["n_changed"] > 0).any()
    pd.testing.assert_frame_equal(got.sort_values(order).reset_index(drop=True), want[got.columns].sort_values(order).reset_index(drop=True), check_dtype=False)
