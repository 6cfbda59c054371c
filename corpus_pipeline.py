"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination and mixing, in this order.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept
and returns the columns of `documents`; the last adds `copy`, the number of the
copy of a document that is mixed in repeatedly. `run` writes each stage's rows to
the shared folder, reads them again, and deletes what the stage wrote besides.

Nulls and edges: rows with a null text pass the filters as empty texts; a null
doc_id passes each stage as its operator says; columns beyond those of
`documents` pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinia.llm import decontamination, line_dedup, minhash, mixing, toxicity
from vicinia.llm._common import staged, table
from vicinia.staging import release, scope

#: A document of this score or more is rejected.
TOXIC = 0.7


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), TOXIC)


def without_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(docs, min_docs=10, min_length=1)
    if "n_chars" in docs.columns:  # it tells the text's length
        kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs, size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_frequent_lines),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]

#: A trained network cannot be said in SQL. The tests hold each operator, the network's scores among them, against a
#: brute-force version, and the pipeline's rows against those versions one after another.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope(spark) as own:
            kept = own.keep(staged(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
