"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from riskweave.llm.chat import format_chats
from riskweave.llm.decontaminate import decontaminate
from riskweave.llm.fill_in_middle import fill_in_middle, restored
from riskweave.llm.line_dedup import dedup_lines
from riskweave.llm.lm import score_documents
from riskweave.llm.near_dedup import near_duplicates
from riskweave.llm.packing import pack_documents
from riskweave.llm.repetition import repetition_rules
from riskweave.llm.resample import resample
from riskweave.llm.reversed_search import reversed_search
from riskweave.llm.token_counts import token_counts
from riskweave.llm.token_files import token_files
from riskweave.llm.toxicity import fit_toxicity, toxicity_scores


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n: int):
    """crc32 of doc_id as text, modulo ``n``; the fold of a row."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_chat_format(spark, sf_dir):
    return format_chats(read(spark, sf_dir, "conversations"))


def op2_decontaminate(spark, sf_dir):
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark, sf_dir):
    done = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "n_lines", "n_exact", "n_near", F.sha2("text", 256).alias("text_sha256")
    )


def op4_repetition(spark, sf_dir):
    return repetition_rules(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_lm_scores(spark, sf_dir):
    return score_documents(read(spark, sf_dir, "documents"), fold(7) == 2)


def op6_near_dedup(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents")).drop("text_hash", "group")


def op7_resample(spark, sf_dir):
    target = read(spark, sf_dir, "labels").filter("quality = 1")
    return resample(read(spark, sf_dir, "documents"), target)


def op8_token_counts(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op9_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"), fold(3) != 1)
    held_out = F.coalesce(fold(3) == 1, F.lit(False))
    return toxicity_scores(docs.withColumn("held_out", held_out), model).drop("text")


def op10_packing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op11_token_files(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("shard")


def op12_fill_in_middle(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return restored(fill_in_middle(docs).drop("text")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


def op13_reversed_search(spark, sf_dir):
    return reversed_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format, op2_decontaminate, op3_line_dedup, op4_repetition, op5_lm_scores,
        op6_near_dedup, op7_resample, op8_token_counts, op9_toxicity, op10_packing,
        op11_token_files, op12_fill_in_middle, op13_reversed_search,
    )
}
