"""Token files, fill-in-the-middle and reversed search on odd rows, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskweave.llm import reversed_search as search_module
from riskweave.llm import simple8b, token_files
from riskweave.llm.boundary_set import BoundarySet
from riskweave.llm.fill_in_middle import fill_in_middle, restore, restored, transform
from riskweave.llm.reversed_search import reversed_search
from riskweave.llm.word_ids import IdTable, WordIds, byte_slices

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "a  b", "  x", "x  ", "a\n b\n\n c", "a <|endoftext|> b<|endoftext|>", "x\0y \0",
    "don't  it's\t x", "é\x1c x", "日本語 123 4", "a" * 3000, "İ ΑΣ  Σ", " " * 50 + "x", "<P> in it",
    "x  y 　 z", "Á E̊ \x85 b", "the <S", "the cat", "the cat", "KK ſ ẞ", "word " * 400,
    "The cat, the dog.\nThe cat, the dog.\n" * 30, "\n\n  y", "🙂 a🙂b",
]
DDL = "doc_id long, text string, start string, score int, item string"


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs, ties, repeated rows, a long text and columns named like results."""
    rows = [(i, t, "s", 1, "x") for i, t in enumerate(ODD)]
    rows += [(None, "no id", "s", 1, "x"), (None, None, None, None, None), (3, ODD[3], "s", 1, "x")]
    rows += [(3, "another text of 3", "s", 1, "x"), (-(2**63), "least", "s", 1, "x")]
    rows += [(2**63 - 1, "most", "s", 1, "x"), (77, "long text the cat " * 40_000, "s", 1, "x")]
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="module")
def invalid(spark):
    rows = [(1, b"a \xff\xfe b"), (2, b"caf\xc3"), (3, b"plain")]
    df = spark.createDataFrame(rows, "doc_id long, raw binary")
    return df.select("doc_id", F.col("raw").cast("string").alias("text"))


def texts_of(df):
    """Rows with their text as bytes: Spark hands out invalid UTF-8 as such."""
    rows = df.select("doc_id", F.col("text").cast("binary").alias("t")).collect()
    return [(r["doc_id"], bytes(r["t"]).decode("utf-8", "replace") if r["t"] is not None else None) for r in rows]


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_word_ids_are_the_librarys(path, spark, sf_dir, monkeypatch):
    library = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()
    given = [ODD, [], [None], *[[r["text"] for r in docs[i : i + 40]] for i in range(0, 200, 40)]]
    monkeypatch.setattr("riskweave.llm.word_ids.CACHE_WORDS", 500)  # words are forgotten
    words = WordIds(path)
    for texts in given:
        ids, ends = words.encode(pa.array(texts, type=pa.string()))
        begins = [0, *ends.tolist()]
        for i, t in enumerate(texts):
            want = library.encode(t or "", add_special_tokens=False).ids
            assert ids[begins[i] : ends[i]].tolist() == want


def test_id_table_forgets_rare_words_only():
    table = IdTable()
    table.rows(pa.array([f"w{i}" for i in range(100)]), lambda new: (np.arange(len(new), dtype=np.uint32), np.ones(len(new), dtype=np.int64)))
    for _ in range(3):
        table.rows(pa.array(["w7", "w50"]), None)
    table.trim(50)
    assert table.words.to_pylist() == ["w7", "w50"] and table.flat.tolist() == [7, 50]


def test_byte_slices_hold_all_rows():
    texts = [None, "", "a" * 100, "b" * 30, "c" * 30, None, "d" * 45]
    b = pa.RecordBatch.from_pydict({"text": pa.array(texts, type=pa.string())})
    parts = [p.column("text").to_pylist() for p in byte_slices([b], "text", 3, 60)]
    assert [t for p in parts for t in p] == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= 60 for p in parts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**64 - 1)), max_size=2500))
def test_simple8b_round_trip(values):
    v = np.array(values, dtype=np.uint64)
    words, offsets = simple8b.encode(v)
    assert (simple8b.decode(words, offsets, len(v)) == v).all()
    for b in range(len(offsets)):  # each block by itself
        last = int(offsets[b + 1]) if b + 1 < len(offsets) else len(words)
        part = v[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]
        alone = words[int(offsets[b]) : last]
        assert (simple8b.decode(alone, offsets[b : b + 1] - offsets[b], len(part)) == part).all()


def test_simple8b_fills_words():
    words, _ = simple8b.encode(np.ones(600, dtype=np.uint64))
    assert len(words) == 10


def brute_places(df, end_id=0):
    """(id, n, crc) of each document, in the order of the files up to ties of an id."""
    library = Tokenizer.from_file(BYTE_BPE)
    out = []
    for key, t in texts_of(df):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, end_id]
        out.append((key, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("record", [50, 1 << 20])
def test_token_files_by_brute_force(record, spark, odd, invalid, sf_dir, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if record == 50:  # documents span records
        monkeypatch.setattr(token_files, "RECORD_IDS", record)
        odd, docs = odd.filter("doc_id <> 77"), docs.limit(30)
    for i, df in enumerate((odd, invalid, docs)):
        path = str(tmp_path / str(i))
        got = token_files.token_files(df, BYTE_BPE, path).collect()
        want = brute_places(df)
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(want)
        got.sort(key=lambda r: r["start"])
        assert [r["doc_id"] for r in got] == [w[0] for w in want]
        starts = np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
        assert [r["start"] for r in got] == starts
        for r in token_files.decoded(spark, path, True).collect():
            ids = np.array(r["ids"], dtype="<u4")
            assert len(ids) == r["n_tokens"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]


def test_token_files_do_not_depend_on_partitions(spark, odd):
    one = token_files.token_files(odd.coalesce(1), BYTE_BPE).drop("shard").collect()
    many = token_files.token_files(odd.repartition(7), BYTE_BPE).drop("shard").collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_token_files_of_an_empty_table(spark, odd):
    assert token_files.token_files(odd.limit(0), BYTE_BPE).count() == 0


def test_broken_token_file_is_refused():
    whole = token_files.record(0, np.array([5, 5, 6], dtype=np.uint32), [1], [3]) + b"\n"
    assert [x[1].tolist() for x in token_files.records(whole)] == [[5, 5, 6]]
    with pytest.raises(ValueError):
        list(token_files.records(b"\0" * len(whole)))
    with pytest.raises(ValueError):
        list(token_files.records(whole + b"\0" * 8))


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 400_000), min_size=1, max_size=300), st.integers(0, 200_000))
def test_boundary_set_selects(some, width):
    places = np.array(sorted(some | set(range(70_000, 70_000 + width))))
    found = BoundarySet(places)
    assert len(found) == len(places)
    for k in {0, len(places) // 2, len(places) - 1}:
        assert found.select(k) == places[k]


def test_boundary_set_has_all_forms():
    bitmap = np.arange(0, 65_536, 3)
    run = np.arange(65_536, 131_072)
    array = 131_072 + np.arange(0, 60_000, 100)
    found = BoundarySet(np.concatenate([bitmap, run, array]))
    assert [c.kind for c in found.containers] == ["bitmap", "run", "array"]
    every = np.concatenate([bitmap, run, array])
    for k in range(0, len(every), 997):
        assert found.select(k) == every[k]
    with pytest.raises(IndexError):
        found.select(len(every))


def brute_cut(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return len(units), "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def test_fill_in_middle_by_brute_force(odd, invalid):
    for df in (odd, invalid):
        got = restored(fill_in_middle(df)).collect()
        want = Counter((k, *brute_cut(k, t), t or "") for k, t in texts_of(df))
        assert want == Counter(
            (r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"])
            for r in got
        )
    assert set(odd.columns) <= set(fill_in_middle(odd).columns)
    assert fill_in_middle(odd.limit(0)).count() == 0


def test_fill_in_middle_replaces_columns_of_its_results(odd):
    df = odd.withColumn("form", F.lit("old")).withColumn("output", F.lit(5)).withColumn("n", F.lit("old"))
    assert fill_in_middle(df).filter("form = 'old' OR n IS NULL").count() == 0


def test_marks_across_cuts_are_restored():
    forms = set()
    for key in range(300):
        for text in ("<<P", "<S<P<M>"[:-1], "P>S>M><<", "<P <S <M"):
            n, form, _, _, out = transform(text, key)
            forms.add(form)
            assert restore(out, form) == text
    assert forms == {"plain", "psm", "spm"}


def brute_search(docs, items, k=10):
    def words(t):
        return re.findall(rb"[0-9a-z\x80-\xff]+", t.lower()) if t else []

    found = [(key, Counter(w), len(w)) for key, t in docs for w in [words(t)]]
    n_docs = sum(n > 0 for *_, n in found)
    length = sum(n for *_, n in found)
    df = Counter(w for _, c, _ in found for w in c)
    out = []
    for name, t in items:
        ranked = []
        for key, c, n in found:
            s = 0
            for w in words(t):
                if w in c:
                    m = 25 + 75 * n * n_docs // length
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                    s += weight * (10**9 * c[w] // (1000 * c[w] + 8 * m))
            if s > 0:
                ranked.append((-s, key is None, key or 0))
        ranked.sort()
        out += [(name, i + 1, None if none else key, -s) for i, (s, none, key) in enumerate(ranked[:k])]
    return Counter(out)


def raw_rows(df, key):
    rows = df.select(key, F.col("text").cast("binary").alias("t")).collect()
    return [(r[0], bytes(r["t"]) if r["t"] is not None else None) for r in rows]


@pytest.mark.parametrize("block", [20, 500_000])
def test_reversed_search_by_brute_force(block, spark, odd, invalid, monkeypatch):
    monkeypatch.setattr(search_module, "BLOCK_TERMS", block)  # several blocks of items
    monkeypatch.setattr(search_module, "SCORES_AT_ONCE", 64)
    docs = odd.select("doc_id", "text", "score", "item").unionByName(invalid, allowMissingColumns=True)
    items = [("a", "the cat and the dog"), ("a", "x y z"), ("b", None), (None, "The CAT"), ("c", ""), ("d", "word 日本語 text another")]
    items += [("e", "nothing-here qqq"), ("f", "the " * 50 + "café")]
    items = spark.createDataFrame(items, "item_id string, text string").withColumn("rank", F.lit(1))
    got = reversed_search(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute_search(raw_rows(docs, "doc_id"), raw_rows(items, "item_id"))
    assert Counter(map(tuple, got.collect())) == want and len(want) > 20


def test_reversed_search_ties_and_copies(spark):
    docs = spark.createDataFrame([(i, "the cat sat") for i in range(40, 0, -1)] + [(500, "other")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "cat")], "item_id long, text string")
    got = reversed_search(docs.repartition(5), items).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == list(range(1, 11))
    assert [r["rank"] for r in got] == list(range(1, 11))


def test_reversed_search_of_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "cat")], "item_id long, text string")
    assert reversed_search(odd.limit(0), items).count() == 0
    assert reversed_search(odd, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert reversed_search(odd, items.limit(0)).count() == 0
