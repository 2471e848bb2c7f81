"""Every operator on NULLs, empty, long and invalid texts, repeated rows and clashing columns."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskweave.llm import gru, lm
from riskweave.llm.chat import format_chats
from riskweave.llm.decontaminate import decontaminate
from riskweave.llm.line_dedup import dedup_lines
from riskweave.llm.lm import score_documents
from riskweave.llm.near_dedup import near_duplicates
from riskweave.llm.packing import pack_documents
from riskweave.llm.repetition import repetition_rules
from riskweave.llm.resample import resample
from riskweave.llm.token_counts import token_counts
from riskweave.llm.toxicity import fit_toxicity, toxicity_scores

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def odd(spark):
    """Also has columns named like results and like the operators' own columns."""
    long = " ".join(f"w{i % 700}" for i in range(12_000))
    texts = [None, b"", b"caf\xc3 \xff x one two three four", b"a b c d e\na b c d e\n", long.encode()]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(3, texts[3]), (3, b"another text of document three with words"), (None, b"no id at all here"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, raw binary")
    clash = ("dropped", "_lines", "_doc2", "_k", "_text", "score", "words", "node", "n", "_row", "label")
    return df.select("doc_id", F.col("raw").cast("string").alias("text"), *[F.lit("q").alias(c) for c in clash]).cache()


def toxic_model(df):
    labels = df.sparkSession.createDataFrame([(2, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    return fit_toxicity(df, labels, F.lit(True))


def benchmark(df):
    items = [(1, "three four"), (2, None), (None, "one two three"), (3, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12")]
    return df.sparkSession.createDataFrame(items, "item_id long, text string")


ROW_WISE = {
    "decontaminate": lambda df: decontaminate(df, benchmark(df)),
    "dedup_lines": dedup_lines,
    "repetition": lambda df: repetition_rules(df.select("doc_id", "text")),
    "scores": lambda df: score_documents(df, F.col("doc_id") % 2 == 0),
    "near_duplicates": near_duplicates,
    "token_counts": lambda df: token_counts(df, BYTE_BPE),
    "toxicity": lambda df: toxicity_scores(df, toxic_model(df)),
}


@pytest.mark.parametrize("name", sorted(ROW_WISE))
def test_one_row_for_each(name, odd):
    assert ROW_WISE[name](odd).count() == odd.count()
    assert ROW_WISE[name](odd.limit(0)).count() == 0


def test_packing_and_resampling_of_odd_rows(odd):
    assert pack_documents(odd, WORD_BPE).agg(F.sum("length")).first()[0] > 24_000
    assert pack_documents(odd.limit(0), WORD_BPE).count() == 0
    target = odd.sparkSession.createDataFrame([(3, 1)], "doc_id long, quality int")
    assert resample(odd.select("doc_id", "text"), target).count() <= odd.count()


def test_clashing_columns_are_kept(odd):
    got = dedup_lines(odd)
    assert got.filter("dropped <> 'q' OR _lines <> 'q' OR _k <> 'q' OR _doc2 <> 'q'").count() == 0
    # Two equal lines of one document: the second goes.
    assert {r["text"] for r in got.filter("doc_id = 3 AND n_lines = 3").collect()} == {"a b c d e\n"}


def test_chats_of_odd_rows(spark):
    rows = [(1, 1, "user", "hi"), (1, 2, None, None), (2, 1, "user", "hi"), (None, 1, "user", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("full", F.lit(1))
    assert format_chats(df).filter("conv_id = 1").count() == 1
    assert format_chats(df.limit(0)).count() == 0


def test_scores_do_not_depend_on_partitions(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 20_000)  # several shards
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = []
    for n in (1, 7):
        rows = score_documents(docs.repartition(n), F.col("doc_id") % 7 == 2).collect()
        found.append({r["doc_id"]: r["score"] for r in rows})
    assert found[0] == pytest.approx(found[1], rel=1e-4)


@pytest.mark.parametrize("frequent", [12, 1000])
def test_every_word_is_scored_through_the_network(spark, monkeypatch, frequent):
    """Words beyond the model's, equally many each, are likelier after the word they followed."""
    monkeypatch.setattr(lm, "MODEL_WORDS", 4)
    monkeypatch.setattr(lm, "FREQUENT", frequent)  # 12: all of them are dealt to buckets
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 2000)
    rows = [(d, f"c1 a{d // 2 % 40}" if d % 2 else f"c2 b{d // 2 % 40}") for d in range(8000)]
    texts = [f"{c} {w}{i}" for i in range(0, 40, 5) for c in ("c1", "c2") for w in "ab"] + ["c1 unseen"]
    rows += [(9000 + i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = score_documents(docs, F.col("doc_id") >= 9000).filter("held_out").collect()
    score = {texts[r["doc_id"] - 9000]: r["score"] for r in found}
    for i in range(0, 40, 5):
        assert score[f"c1 a{i}"] > score[f"c1 b{i}"] + 0.05
        assert score[f"c2 b{i}"] > score[f"c2 a{i}"] + 0.05
    assert score["c1 unseen"] < min(s for t, s in score.items() if t != "c1 unseen")
    assert {r["n_known"] for r in found} == {2, 3}


@pytest.mark.parametrize("words, depth", [(0, 2), (1, 3), (2, 2), (50, 2), (200, 3)])
def test_a_trees_probabilities_sum_to_one(words, depth):
    rng = np.random.default_rng(words)
    counts = rng.integers(1, 30, words).astype(float)
    states = [rng.uniform(-1, 1, (int(n), gru.HIDDEN)) for n in counts]
    sums = np.array([s.sum(axis=0) for s in states]).reshape(-1, gru.HIDDEN)
    second = sum((s.T @ s for s in states), np.zeros((gru.HIDDEN, gru.HIDDEN)))
    tree = gru.WordTree((counts + 1) / 5000, counts, sums, second, depth)
    for state in rng.uniform(-1, 1, (5, gru.HIDDEN)).astype(np.float32):
        found = tree.log_probabilities(np.arange(words)[::-1], np.tile(state, (words, 1)))
        assert np.exp(found).sum() == pytest.approx((counts + 1).sum() / 5000, rel=1e-4)


def test_rare_words_do_not_depend_on_partitions(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = {r["doc_id"]: r for r in score_documents(docs, F.col("doc_id") % 7 == 2).collect()}
    monkeypatch.setattr(lm, "SHARD_TOKENS", 20_000)
    monkeypatch.setattr(lm, "FREQUENT", 1500)
    monkeypatch.setattr(lm, "BUCKET_TOKENS", 1000)
    found = []
    for n in (1, 7):
        monkeypatch.setattr(lm, "TASK_TOKENS", 10_000 // n)
        rows = score_documents(docs.repartition(n), F.col("doc_id") % 7 == 2).collect()
        assert all(r["n_known"] == base[r["doc_id"]]["n_known"] for r in rows)
        assert {r["doc_id"]: r["base_score"] for r in rows} == pytest.approx({k: b["base_score"] for k, b in base.items()})
        found.append({r["doc_id"]: r["score"] for r in rows})
    assert found[0] == pytest.approx(found[1], rel=1e-4)


def test_pipeline_keeps_texts_that_share_a_doc_id(spark, sf_dir):
    """A unique text stays though another row of its doc_id is a copy; of copies one row stays."""
    words = lambda p, n=30: " ".join(f"{p}{i}" for i in range(n))
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("length(text) > 100").first()["text"]
    rows = [(1, words("a")), (5, words("a")), (5, words("b")), (5, item), (7, words("c")), (7, words("c")), (8, None)]
    rows += [(None, words("d")), (None, words("e")), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    got = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str)
    gone = [(5, words("a")), (7, words("c"))]
    want = list(rows)
    for r in gone:
        want.remove(r)
    assert got == sorted(want, key=str) and left.columns == docs.columns
    clean = corpus_pipeline.decontamination(spark, docs, sf_dir)
    got = sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=str)
    assert got == sorted((r for r in rows if r[1] != item), key=str)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
