"""The corpus pipeline: five stages of riskweave.llm, each on what its predecessor kept.

A document is a row: rows of one doc_id with different texts are told apart by a hash of
the text, and NULL is a doc_id like others. Every stage takes an empty table, and keeps
NULL and empty texts unless its docstring says otherwise.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.decontaminate import decontaminate
from riskweave.llm.line_dedup import dedup_lines
from riskweave.llm.near_dedup import near_duplicates
from riskweave.llm.packing import pack_documents
from riskweave.llm.queries import fold
from riskweave.llm.toxicity import fit_toxicity, toxicity_scores
from riskweave.session import owned_tables, scratch_dir, written_table


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id and text hash (_doc, _hash) aren't in ``gone``."""
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
    return docs.join(gone.select("_doc", "_hash").distinct(), same, "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold of toxicity; the labels come from ``sf_dir``.

    NULL and empty texts score the bias alone and stay unless most texts are toxic.
    Repeated rows get equal scores.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels, fold(3) != 1)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    kept = toxicity_scores(rows, model).filter("predicted = 0")
    return kept.select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines are taken out; a document goes if it had lines and all were repeats.

    NULL texts (no lines) and empty ones (one short line) stay. Rows of equal doc_id and
    text stay or go together.
    """
    done = dedup_lines(docs)
    left = done.filter(
        (F.col("n_lines") == 0) | (F.col("n_exact") + F.col("n_near") < F.col("n_lines"))
    )
    changed = F.when(F.col("n_exact") + F.col("n_near") > 0, F.length("text"))
    return left.withColumn("n_chars", F.coalesce(changed, "n_chars").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: the smallest doc_id, then text hash.

    Exact repeats of that row go as well. Rows without words are in no group and stay.
    """
    found = near_duplicates(docs).filter(F.col("group").isNotNull())
    found = written_table(found.select("group", "doc_id", "text_hash"), "near-groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    best = found.groupBy("group").agg(F.min(order).alias("best"))
    rows = found.groupBy("group", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.join(best, "group").withColumn("first", order.eqNullSafe(F.col("best")))
    rows = written_table(
        rows.filter(~F.col("first") | (F.col("copies") > 1)).select(
            F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "first"
        ),
        "near-rows",
    )
    left = _without(docs, rows)
    repeated = rows.filter("first")
    if repeated.isEmpty():
        return left
    # One of the equal rows comes back.
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_hash"))
    again = docs.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.unionByName(again)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; those without words stay.

    Repeated rows stay or go together.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(docs, benchmark, row_hash=True)
    hit = found.filter("contaminated").select("row_hash").distinct()
    return docs.join(hit, F.xxhash64("doc_id", "text") == F.col("row_hash"), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left and their places in sequences; every row is a document."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Toxicity is a fitted model and packing a tokenizer's; the stages are tested in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written, and the next stage reads it.

    What a stage writes on its way is deleted once its result is there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/riskweave/pipeline-{name}-{uuid.uuid4().hex}"
        with owned_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
