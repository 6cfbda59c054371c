"""What the corpus operators share: tables, texts and what stands for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..skew import hot_keys, spread_join
from ..staging import discard, release, scratch_path, staged

__all__ = ["SPACES", "WORD", "discard", "fresh", "hot_keys", "release", "rows_id", "scratch_path", "spread_join", "staged", "table", "text_key", "text_or_empty"]

#: The white space that separates words in every contract here: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """`name`, or with underscores before it, as no column of `df` is called, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_key(column: Column) -> Column:
    """128 bits that stand for a text: rows with equal texts share a key, whatever their ids."""
    return F.struct(F.xxhash64(column).alias("a"), F.xxhash64(F.lit(7), column).alias("b"))


def rows_id() -> Column:
    """doc_id as a long; a row without one gets a number from 2**62 on that its text decides."""
    own = F.xxhash64(F.lit(11), text_or_empty()).bitwiseAND(F.lit(2**62 - 1)) + F.lit(2**62)
    return F.coalesce(F.col("doc_id").cast("long"), own)
