"""Operators that work inside tasks, against brute force and the libraries themselves."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskweave.llm.lm import score_documents
from riskweave.llm.packing import ENCODE_BYTES, encoded, pack_documents
from riskweave.llm.queries import fold
from riskweave.llm.repetition import repeat_lengths, repetition_rules
from riskweave.llm.resample import resample
from riskweave.llm.token_counts import token_counts
from riskweave.llm.toxicity import fit_toxicity, toxicity_scores

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "a  b", "  x", "x  ", "a\n b\n\n c", "a <|endoftext|> b<|endoftext|>",
    "don't  it's\t x", "é\x1c x", "日本語 123 4", "a" * 3000, "İ ΑΣ  Σ", " " * 50 + "x",
    "x  y", "word " * 400, "The cat, the dog.\nThe cat, the dog.\n" * 30,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "es", "s", 1) for i, t in enumerate(ODD)] + [(None, "no id", "en", "s", 1)]
    rows += [(3, ODD[3], "es", "s", 1)]  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_token_counts_are_the_librarys(odd, docs):
    library = Tokenizer.from_file(BYTE_BPE)
    for df in (odd, docs):
        got = token_counts(df, BYTE_BPE, limit=100)
        assert got.columns[:1] == ["doc_id"] and "text" not in got.columns
        texts = Counter(
            (r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids))
            for r in df.collect()
        )
        assert Counter((r["doc_id"], r["n_tokens"]) for r in got.collect()) == texts
        assert got.filter("over_limit <> (n_tokens > 100)").count() == 0


def test_packing_is_gapless_and_whole(odd, docs):
    library = Tokenizer.from_file(WORD_BPE)
    df = docs.select("doc_id", "text").union(odd.filter("doc_id <> 3").select(F.col("doc_id") + 10**6, "text"))
    ids = {
        r["doc_id"]: np.array(
            library.encode(r["text"] or "", add_special_tokens=False).ids + [1], dtype="<u4"
        )
        for r in df.collect()
    }
    pieces = pack_documents(df, WORD_BPE).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
        documents[p["doc_id"]].append(p)
        own = ids[p["doc_id"]]
        assert p["doc_tokens"] == len(own)
        part = own[p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(part.tobytes())
    assert set(documents) == set(ids)
    for doc, ps in documents.items():
        ps.sort(key=lambda p: p["start"])
        assert [p["start"] for p in ps] == list(np.cumsum([0] + [p["length"] for p in ps])[:-1])
        assert sum(p["length"] for p in ps) == len(ids[doc])
    padding = 0
    for ps in sequences.values():
        ps.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in ps] == list(np.cumsum([0] + [p["length"] for p in ps])[:-1])
        total = sum(p["length"] for p in ps)
        assert total <= 2048
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    assert padding == 0
    steps = defaultdict(set)
    for p in pieces:
        steps[p["step_group"]].add(p["tier"])
    assert all(len(t) == 1 for t in steps.values())


def test_packing_of_an_empty_table(spark, docs):
    assert pack_documents(docs.limit(0), WORD_BPE).count() == 0


def test_packing_encodes_few_bytes_at_once():
    """Arrays on the way to the ids of a whole slice of 4 MB took a worker hundreds of MB."""
    met = []

    class Words:
        def encode(self, texts):
            lengths = np.array([len(t or b"") for t in texts.to_pylist()], dtype=np.int64)
            met.append(int(lengths.sum()))
            return np.repeat(np.arange(len(lengths), dtype=np.uint32), lengths), np.cumsum(lengths)

    sizes = [0, 3, 400_000, 700_000, 1_200_000, 5, 300_000, 1, 999_999]
    texts = pa.array([None if n == 3 else b"x" * n for n in sizes], type=pa.binary())
    docs = list(encoded(Words(), pa.record_batch([texts], names=["_text"]), 7))
    assert [len(d) // 4 for d in docs] == [1 if n == 3 else n + 1 for n in sizes]
    assert all(np.frombuffer(d, dtype="<u4")[-1] == 7 for d in docs)
    assert max(n for n in met if n != 1_200_000) <= ENCODE_BYTES


def test_repeat_lengths_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(100):
        texts = [rng.integers(1, rng.integers(2, 5), size=rng.integers(1, 30)) for _ in range(3)]
        starts = np.cumsum([0] + [len(t) for t in texts])[:-1]
        got = repeat_lengths(np.concatenate(texts), starts, 4)
        want = []
        for t in texts:
            for i in range(len(t)):
                best = 0
                for j in range(len(t)):
                    k = 0
                    while i != j and max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                        k += 1
                    best = max(best, k)
                want.append(best)
        want = np.array(want)
        assert (np.where(want >= 4, want, 0) == np.where(got >= 4, got, 0)).all()


def test_repetition_base_measures(odd, docs):
    for df in (odd, docs):
        got = Counter(
            tuple(r) for r in repetition_rules(df).select(
                "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                "base_failed",
            ).collect()
        )
        want = Counter()
        for r in df.collect():
            raw = (r["text"] or "").encode()
            words = raw.split()
            windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
            hit = {
                i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)
            }
            lines = [x for x in raw.split(b"\n") if x.split()]
            n = len(words)
            want[
                (
                    r["doc_id"], n, sum(len(w.decode()) for w in words),
                    sum(raw.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")),
                    len(lines) - len(set(lines)), len(hit), n < 10 or 100 * len(hit) > 20 * n,
                )
            ] += 1
        assert got == want


def test_resampling_weights_and_share(spark, sf_dir, docs):
    target = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    got = resample(docs, target, keep=0.25)
    assert got.count() == docs.count()
    kept = got.filter("kept").agg(F.count(F.lit(1)), F.min("gumbel_key")).first()
    rest = got.filter("NOT kept").agg(F.max("gumbel_key")).first()
    assert abs(kept[0] - 0.25 * docs.count()) <= 2 and kept[1] > rest[0]
    assert resample(docs.limit(0), target).count() == 0
    # Without targets nothing speaks for or against a text.
    assert resample(docs, target.limit(0)).agg(F.max(F.abs("log_weight"))).first()[0] == 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = fit_toxicity(docs, labels, fold(3) != 1)
    scored = toxicity_scores(docs, model).filter(fold(3) == 1).join(labels, "doc_id")
    r = scored.agg(
        F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"),
        F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("false"),
    ).first()
    assert r["recall"] > 0.9 and r["false"] < 0.01


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit_toxicity(odd, labels, F.lit(True))
    got = toxicity_scores(odd, model)
    assert got.count() == odd.count()
    assert got.filter("score IS NULL OR score < 0 OR score > 1 OR predicted <> 0").count() == 0


def test_lm_base_score_and_gain(spark, sf_dir, docs, odd):
    import math

    blank = spark.createDataFrame([(-1, None), (-2, ""), (None, "a b")], "doc_id long, text string")
    given = docs.select("doc_id", "text").union(blank)
    rows = given.collect()
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    held = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows]
    words = [(r["text"] or "").encode().translate(lower).split() + [b""] for r in rows]
    counts = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in score_documents(given, fold(7) == 2).collect()}
    gain = 0.0
    for r, ws, h in zip(rows, words, held):
        g = got[r["doc_id"]]
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in ws)
        assert (g["held_out"], g["n_tokens"], g["train_tokens"]) == (h, len(ws), total)
        assert g["n_known"] == sum(counts[w] > 0 for w in ws)
        assert g["base_score"] == pytest.approx(base, rel=1e-9)
        assert g["score"] < 0
        gain += h * (g["score"] - base)
    assert gain > 0
    assert score_documents(docs.limit(0), F.lit(False)).count() == 0
