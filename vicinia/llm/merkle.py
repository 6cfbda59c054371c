"""Merkle manifest of a dataset: a tree of digests a source, a tree over the sources' roots, and the proof of each row.

A row's leaf is the SHA-256 of its fields, each `-` if null, else its number of
UTF-8 bytes, a colon and the value. The leaves of a source stand in order of
doc_id; every 16 consecutive nodes (the last run may be shorter, even one) become
their digest until one is left, the source's subroot. Subroots in order of their
sources, null first, become the root in the same way. Digests are hashed as
lower-case hex, and kept as bytes.

Build, bottom up: leaves are ranged over tasks by (source, doc_id) and numbered by
how many lie in the tasks before, so no source is ever in one task. A level groups
the one below by (source, place div 16), 16 rows a group at most, and is written
with its children's digests in one field. Proofs, top down: a level's nodes are
joined with their parents by that same key; each takes from its parent the
siblings on either side of it and puts them before the proof that the parent has
inherited. All of it is DataFrame functions.

Nulls and edges: a null doc_id comes first in its source and is hashed as `-`;
rows of one source and doc_id are in order of their leaves, and rows that are alike
throughout have places of their own, so repeated rows are repeated leaves; a null
source is a source; a lone leaf is its source's subroot; a lone subroot is the root;
no documents give no rows; texts of any length are hashed whole; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import release, staged

#: Nodes of a run, bytes of a digest, and the fields of a leaf.
ARITY, WIDTH = 16, 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:binary,right:binary>>"
#: How monotonically_increasing_id is made: the partition above this many bits.
PARTITION_BITS = 33


def field(value: Column) -> Column:
    """A value as it is hashed."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    """The leaf of a row with these values, as bytes."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def hexed(node: Column | str) -> Column:
    return F.lower(F.hex(node))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with `pos`, the place from 0 in their `tree` by `order`, and `size`, the number of its rows; staged.

    Ranges of (tree, order) are sorted each in its task; a range's rows of a tree stand behind those of the ranges before,
    which a table of one row a tree and range tells.
    """
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = staged(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("at", PARTITION_BITS)
    runs = placed.groupBy(F.col("tree").alias("of"), part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("of")  # a row a range of the tree
    before = F.coalesce(F.sum("n").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("of", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(own).alias("size"))
    out = placed.join(runs, (F.col("tree") == F.col("of")) & (part == F.col("part")))
    out = staged(out.select(*rows.columns, (F.col("at") + F.col("shift")).alias("pos"), "size"), "numbered")
    release(placed)
    return out


def _above(level: DataFrame) -> DataFrame:
    """The level above one: (tree, pos, size, node, kids), `kids` the digests of a node's children one after another."""
    run = F.array_sort(F.collect_list(F.struct("pos", hexed("node").alias("node"))))  # ARITY at most
    joined = F.array_join(F.transform(run, lambda child: child["node"]), "")
    keys = [F.floor(F.col("pos") / ARITY).alias("pos"), F.ceil(F.col("size") / ARITY).alias("size")]
    grouped = level.where("size > 1").groupBy("tree", *keys).agg(joined.alias("hex"))
    return grouped.select("tree", "pos", "size", F.unhex(F.sha2("hex", 256)).alias("node"), F.unhex("hex").alias("kids"))


def levels(leaves: DataFrame) -> list[DataFrame]:
    """The levels of the trees over `leaves` (tree, pos, size, node), those first; all staged."""
    made = [leaves]
    left = leaves.agg(F.max("size")).first()[0] or 0
    while left > 1:
        made.append(staged(_above(made[-1]), "level"))
        left = -(-left // ARITY)
    return made


def tops(made: list[DataFrame]) -> DataFrame:
    """(tree, node): what remains of each tree."""
    found = [level.where("size = 1").select("tree", "node") for level in made]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def pushed(made: list[DataFrame], inherited: DataFrame | None) -> DataFrame:
    """The leaves of `made` with `path`: for each level up to the top, what stands left and right of the node in its run.

    `inherited` (of, path, ...) is what the top of each tree goes on with, its other columns are handed down too; without
    it, tops have nothing above them.
    """
    told = [] if inherited is None else [c for c in inherited.columns if c != "of"]
    above = None
    for k, level in reversed(list(enumerate(made))):
        done = level.where("size = 1")
        done = done.withColumn("path", F.array().cast(STEP)) if inherited is None else done.join(inherited, F.col("tree") == F.col("of")).drop("of")
        if above is not None:
            parents = above.select(F.col("tree").alias("of"), F.col("pos").alias("up"), F.col("kids").alias("run"), F.col("path").alias("rest"), *[c for c in told if c != "path"])
            at = F.pmod("pos", F.lit(ARITY)).cast("int")
            met = level.where("size > 1").join(parents, (F.col("tree") == F.col("of")) & (F.floor(F.col("pos") / ARITY) == F.col("up")))
            left, right = F.substring("run", F.lit(1), at * WIDTH), F.substring("run", (at + 1) * WIDTH + 1, F.lit(ARITY * WIDTH))
            met = met.withColumn("path", F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "rest"))
            done = met.select(done.columns).unionByName(done)
        above = staged(done, "paths") if k else done
    return above


def folded(leaf: Column, path: Column | str) -> Column:
    """The root, as hex, that a leaf's hex and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(hexed(step["left"]), node, hexed(step["right"])), 256))


def path_digest(path: Column | str) -> Column:
    """The digest of a path's siblings, from left to right and level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(hexed(step["left"]), hexed(step["right"]))), ""), 256)


@dataclass
class Manifest:
    """`rows` (doc_id, source, leaf, other, subroot, path): each row's proof, `other` its leaf after tampering or null;
    `root` as hex, None without rows; `made` and `sources` are the levels of the trees of rows and of sources."""

    rows: DataFrame
    root: str | None
    made: list[DataFrame]
    sources: list[DataFrame]


def manifest(docs: DataFrame, tampered: Column | None = None, fields: Sequence[str] = FIELDS) -> Manifest:
    """Build the trees over `docs` and prove each row. `tampered` is the condition under which a row's text has its A-Z
    lower-cased after the manifest was made."""
    values = {c: F.col(c) for c in fields}
    other = F.lit(None).cast("binary")
    if tampered is not None:
        other = F.when(tampered, digest(*[lower_ascii(v.cast("string")) if c == "text" else v for c, v in values.items()]))
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source").cast("string")), F.lit("0"))  # in the order of sources, null first
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), digest(*values.values()).alias("node"), other.alias("other"))
    hashed = staged(leaves.withColumn("deal", F.monotonically_increasing_id()), "leaves")  # rows that are alike can be ranged apart
    made = levels(numbered(hashed, "doc_id", "node", "deal"))
    release(hashed)
    subroots = tops(made).select(F.lit("").alias("tree"), F.col("tree").alias("named"), "node")
    sources = levels(numbered(subroots, "named"))
    root = tops(sources).first()
    inherited = pushed(sources, None).select(F.col("named").alias("of"), F.col("node").alias("subroot"), "path")
    rows = pushed(made, staged(inherited, "source-paths"))
    source = F.when(F.col("tree") != "0", F.substring("tree", F.lit(2), F.length("tree")))
    return Manifest(rows.select("doc_id", source.alias("source"), F.col("node").alias("leaf"), "other", "subroot", "path"), root and bytes(root["node"]).hex(), made, sources)


def verified(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): each row's digests and proof as the manifest has
    them, and what the row as it is now leads to."""
    built = manifest(docs, tampered)
    now = hexed(F.coalesce("other", "leaf"))
    out = built.rows.select("doc_id", hexed("leaf").alias("leaf"), hexed("subroot").alias("subroot"), F.lit(built.root).cast("string").alias("root"), path_digest("path").alias("proof_sha256"), folded(now, "path").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def every_fifth() -> Column:
    """Whether 5 divides the CRC-32 of the id as text; a row without one is left alone."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
