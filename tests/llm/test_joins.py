"""Operators that join and link rows, against SQL on driver tables and brute force on odd rows."""

import hashlib
import itertools
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle import compare, connect
from riskweave.llm.chat import format_chats
from riskweave.llm.components import components
from riskweave.llm.decontaminate import decontaminate
from riskweave.llm.line_dedup import dedup_lines, within_one
from riskweave.llm.near_dedup import block_links, least_matches, near_duplicates, set_hash
from riskweave.llm.queries import QUERIES
from riskweave.llm.sql import SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, spark, sf_dir):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), SQL[name]) is None


def shingles(text):
    words = [w.lower() if w.isascii() else w for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1)))


def test_near_duplicates_by_brute_force(spark, sf_dir):
    base = [f"w{i}" for i in range(60)]
    odd = [None, "", " \n", "one two", "One  two", " ".join(base)]
    odd += [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(5, 55, 3)]
    odd += [" ".join(base[:i] + ["y"] + base[i + 1 : 50]) for i in range(4, 40, 9)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    given = docs.union(extra).union(extra.limit(8))
    sets = {r["doc_id"]: shingles(r["text"]) for r in given.collect()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = near_duplicates(given).collect()
    assert len(got) == given.count()
    for r in got:
        want = find(r["doc_id"])
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (
            len(sets[r["doc_id"]]), want, want == r["doc_id"],
        )
    assert near_duplicates(docs.limit(0)).count() == 0


def test_block_links_and_pruning_bound():
    import numpy as np

    from riskweave.llm.near_dedup import signatures

    least = least_matches(0.75, 1e-6)
    assert least == sorted(least) and 0 <= least[0] <= 16 and least[-1] < 96
    sets = [np.arange(i, i + 100, dtype=np.int64) * 7919 for i in (0, 5, 200, 207, 1000)]
    table = {
        "node": np.array([set_hash(s.view(np.uint64)) for s in sets]),
        "root": np.arange(5),
        "shingles": sets,
        "signature": np.zeros((5, 128), dtype=np.uint32),
    }
    links = {frozenset(x) for x in block_links(table, 75, least)}
    node = table["node"]
    assert links == {frozenset((int(node[0]), int(node[1]))), frozenset((int(node[2]), int(node[3])))}
    assert signatures([s.view(np.uint64) for s in sets]).shape == (5, 128)


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    more = spark.createDataFrame([(1000, 1001), (1001, 1001), (1000, 1001)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(chain.union(more)).collect()}
    assert roots == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


def test_decontamination_by_brute_force(spark):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, item), (2, "short item here"), (10, "É b c d e f g h i j k"), (11, None), (12, "a a a a a a a a a a a")]
    texts = [
        None, "", item.upper(), "x " + item.replace(" ", ", ") + " y", item[6:], item[12:],
        "a short item here and short ITEM here", "é b c d e f g h i j k", "É b c d e f g h i j",
        "a " * 40, "alpha beta gamma delta epsilon zeta eta theta iota other lambda mu",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, item.upper()), (None, item)], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))

    def want(text):
        w, hit, names = words(text), set(), set()
        for name, t in items:
            i = words(t)
            n = min(10, len(i))
            for j in range(len(i) - n + 1 if i else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == i[j : j + n]:
                        hit.update(range(p, p + n))
                        names.add(str(name))
        joined = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        return len(w), len(hit), len(names), joined, bool(hit)

    got = decontaminate(docs, benchmark).collect()
    assert len(got) == docs.count()
    by_id = dict(enumerate(texts)) | {None: item}
    for r in got:
        assert tuple(r)[1:] == want(by_id[r["doc_id"]]), r
    assert decontaminate(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    assert decontaminate(docs.limit(0), benchmark).count() == 0


def test_line_dedup_by_brute_force(spark):
    a, b = "one two three four five six", "uno dos tres cuatro cinco seis"
    texts = [
        f"{a}\n{b}\nshort", f"{a}\nshort", f"one two 3 four five six\n{b} siete", "two three four five six\nkeep me",
        None, "", f"{a}\n{a}", "two three four five six one", "a a a a a a\na a a a a",
    ]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, n_near string")
    first, kept = {}, {}
    for i, t in enumerate(texts):
        for k, line in enumerate(t.split("\n") if t is not None else []):
            w = tuple(line.split())
            if len(w) >= 5:
                first.setdefault(w, (i, k))
    for i, t in enumerate(texts):
        lines = []
        for k, line in enumerate(t.split("\n") if t is not None else []):
            w = tuple(line.split())
            later = w in first and first[w] != (i, k)
            near = w in first and any(
                at < first[w] and within_one(list(o), list(w)) for o, at in first.items() if o != w
            )
            if not (later or near):
                lines.append(line)
        kept[i] = None if t is None else "\n".join(lines)
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()}
    assert got == kept
    assert dedup_lines(docs.limit(0)).count() == 0


def test_chat_collapse_of_odd_rows(spark):
    rows = [
        (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", None), (3, 0, "user", "hi"),
        (3, 1, "assistant", None), (4, 0, None, None), (None, 0, "user", "lost"), (5, 0, "user", "hi there"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["n_snapshots"]) for r in format_chats(turns).collect()}
    assert got == {2: (2, 2, 1), 4: (1, 1, 0), None: (1, 1, 0), 5: (1, 1, 0)}
    assert format_chats(turns.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"
    columns = docs.columns
    con = duckdb.connect()
    assert con  # the stages have no SQL; their operators are tested above
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns, name
        assert 0.7 * before < out.count() <= before
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert pieces.filter("length <= 0").count() == 0
    assert pieces.select("doc_id").join(docs, "doc_id", "left_anti").count() == 0
