"""Streams give the batch result, however the input was cut."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from riskweave.operators.features import build_features
from riskweave.schema import FEATURE_COLUMNS
from riskweave.streaming.streams import (
    LateRowCounter,
    activity_sessions,
    amount_table,
    burst_counts,
    deduplicated,
    late_rows,
    observed,
    read_split,
    split_late,
    stream_features,
    stream_raw,
    to_table,
    with_amount_rank,
)
from test_features import SCHEMA, random_rows


def write_in_files(spark, rows, path, files):
    """One Parquet file per slice, read back one per batch."""
    size = -(-len(rows) // files)
    for i in range(files):
        part = spark.createDataFrame(rows[i * size : (i + 1) * size], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.mark.parametrize("files", [1, 5])
def test_stream_equals_batch(spark, tmp_path, files):
    rows = random_rows(200, 11, seconds=3000)
    # Within a file the order is lost; files overlap in time by less than the delay.
    rows[:150] = rows[:150][::-1] if files == 1 else rows[:150]
    stream = write_in_files(spark, rows, str(tmp_path / "in"), files)
    out = str(tmp_path / "out")
    to_table(stream_features(stream, delay="1 minute"), out, str(tmp_path / "state"))
    last = max(r[4] for r in rows)
    batch = build_features(spark.createDataFrame(rows, SCHEMA))
    final = {r["hash"] for r in batch.filter(F.col("close_time") <= F.lit(last) - F.expr("INTERVAL 1 MINUTE")).collect()}
    want = {r["hash"]: r for r in batch.collect() if r["hash"] in final}
    got = {r["hash"]: r for r in spark.read.parquet(out).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    for key in want:
        for c in FEATURE_COLUMNS:
            if c not in ("tx_size_percentile_local", "is_large_tx"):
                assert got[key][c] == pytest.approx(want[key][c], abs=1e-9), (key, c)


def test_stream_resumes_from_its_state(spark, tmp_path):
    rows = random_rows(120, 12, seconds=2000)
    path, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    stream = write_in_files(spark, rows[:60], path, 1)
    to_table(stream_features(stream, delay="1 minute"), out, state)
    first = spark.read.parquet(out).count()
    stream = write_in_files(spark, rows[60:], path, 1)
    to_table(stream_features(stream, delay="1 minute"), out, state)
    got = {r["hash"]: r["duplicate_memo_count"] for r in spark.read.parquet(out).collect()}
    batch = build_features(spark.createDataFrame(rows, SCHEMA)).collect()
    want = {r["hash"]: r["duplicate_memo_count"] for r in batch}
    assert 0 < first < len(got)
    assert got == {h: want[h] for h in got}


def test_dedup_and_late_rows(spark, tmp_path):
    rows = random_rows(60, 13, seconds=3000)
    stream = write_in_files(spark, rows + rows[-5:] + rows[:3], str(tmp_path / "in"), 1)
    out = str(tmp_path / "out")
    to_table(deduplicated(observed(stream), delay="1 hour"), out, str(tmp_path / "state"))
    assert spark.read.parquet(out).count() == 60
    # The second file is far behind the watermark of the first.
    path = str(tmp_path / "late")

    def run(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        writer = burst_counts(source, delay="1 second").writeStream.outputMode("append").format("parquet")
        query = (
            writer.option("path", str(tmp_path / "counts"))
            .option("checkpointLocation", str(tmp_path / "state2"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return late_rows(query)

    assert run(rows[30:]) == 0
    assert run(rows[:5]) > 0


def test_late_rows_over_many_triggers(spark, tmp_path):
    """More triggers than a query remembers; late rows in the first and in the last ones."""
    path = str(tmp_path / "in")
    rows = random_rows(106, 15, accounts=("a",), seconds=13_000)
    late = [(f"late{i}", *r[1:]) for i, r in enumerate(random_rows(4, 16, accounts=("late",), seconds=10))]
    parts = [rows[:1], late[:2], *[[r] for r in rows[1:]], late[2:]]
    parts[0] = [(*rows[0][:4], rows[0][4] + dt.timedelta(seconds=5000), *rows[0][5:])]
    numbered = [(*r, f"{i:04d}") for i, part in enumerate(parts) for r in part]
    # One task writes the files one by one, in the order in which they are read.
    given = spark.createDataFrame(numbered, SCHEMA + ", part string").coalesce(1)
    given.sortWithinPartitions("part").write.partitionBy("part").parquet(path)
    stream = lambda: spark.readStream.schema(spark.createDataFrame(rows, SCHEMA).schema).option(
        "maxFilesPerTrigger", 1
    ).parquet(f"{path}/part=*")
    counter = LateRowCounter()
    spark.streams.addListener(counter)
    try:
        writer = burst_counts(stream(), delay="1 second").writeStream.outputMode("append").format("noop")
        query = writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):
            if counter.triggers[str(query.id)] >= len(parts):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(counter)
    assert len(query.recentProgress) <= 100 < counter.triggers[str(query.id)]
    assert counter.dropped[str(query.id)] > late_rows(query)
    out = str(tmp_path / "split")
    split_late(stream(), out, str(tmp_path / "state2"), "1 second", available_now=True).awaitTermination()
    found = {r["hash"] for r in read_split(spark, out, SCHEMA, late=True).collect()}
    newest, want = None, set()
    for part in parts:
        if newest is not None:
            want |= {r[0] for r in part if r[4] < newest - dt.timedelta(seconds=1)}
        newest = max([r[4] for r in part] + ([newest] if newest else []))
    assert found == want and found
    assert read_split(spark, out, SCHEMA, late=False).count() == sum(map(len, parts)) - len(want)


def test_csv_stream_follows_each_header(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text('account,amount,hash,other\nA,"{""value"":""5"",""currency"":""USD""}",h1,"x,y"\n')
    (folder / "b.csv").write_text("\ufeffhash,Account,fee,amount\r\nh2,B,7,1000000\r\nh3,C,,\r\n")
    (folder / "empty.csv").write_text("hash,account\n")

    def run(name):
        out = str(tmp_path / name)
        to_table(stream_raw(spark, str(folder), "csv"), out, str(tmp_path / f"{name}-state"))
        return {r["hash"]: r for r in spark.read.parquet(out).collect()}

    got = run("out")
    assert got.keys() == {"h1", "h2", "h3"}
    assert (got["h1"]["account"], got["h1"]["amount"]) == ("A", '{"value":"5","currency":"USD"}')
    assert (got["h2"]["account"], got["h2"]["amount"], got["h2"]["fee"]) == ("B", "1000000", "7")
    assert (got["h3"]["account"], got["h3"]["amount"]) == ("C", None)
    (folder / "short.csv").write_text("hash,account,fee\nh4,D\n")
    with pytest.raises(Exception, match="don't match"):
        run("broken")


def test_csv_stream_of_a_long_file(spark, tmp_path):
    """The lines of a file are found once, not again for each line."""
    folder = tmp_path / "csv"
    folder.mkdir()
    lines = [f"{'m' * 60},h{i},A{i % 7}" for i in range(30_000)]
    (folder / "a.csv").write_text("memo,hash,account\n" + "\n".join(lines) + "\n")
    began = time.monotonic()
    out = str(tmp_path / "out")
    to_table(stream_raw(spark, str(folder), "csv"), out, str(tmp_path / "state"))
    assert time.monotonic() - began < 60
    got = spark.read.parquet(out)
    assert got.agg(F.count_distinct("hash", "account")).first()[0] == got.count() == 30_000


def test_sessions(spark, tmp_path):
    rows = random_rows(40, 14, accounts=("a",), seconds=20000)
    stream = write_in_files(spark, rows, str(tmp_path / "in"), 1)
    out = str(tmp_path / "out")
    to_table(activity_sessions(stream, "5 minutes"), out, str(tmp_path / "state"), "complete")
    times = sorted(r[4] for r in rows)
    gaps = sum((b - a).total_seconds() >= 300 for a, b in zip(times, times[1:]))
    got = spark.read.parquet(out)
    assert got.count() == gaps + 1
    assert got.agg(F.sum("n")).first()[0] == 40


def test_amount_rank(spark):
    df = spark.createDataFrame([("A", float(i)) for i in range(1, 101)], "account string, amount_value double")
    probe = spark.createDataFrame([("A", 0.5), ("A", 50.0), ("A", 1000.0), ("B", 1.0)], "account string, amount_value double")
    got = {(r["account"], r["amount_value"]): r["tx_size_percentile_local"] for r in with_amount_rank(probe, amount_table(df)).collect()}
    assert got[("A", 0.5)] == 0.0 and got[("A", 1000.0)] == 1.0 and got[("B", 1.0)] == 1.0
    assert got[("A", 50.0)] == pytest.approx(0.5, abs=0.02)


class CountedState:
    """State of one group that counts its calls, as a list, a value or a map."""

    def __init__(self):
        self.held, self.calls = None, 0

    def _called(self, held):
        self.held, self.calls = held, self.calls + 1

    def get(self):
        self._called(self.held)
        return self.held if self.held is not None else []

    def clear(self):
        self._called(None)

    def put(self, values):
        self._called(list(values))

    def appendValue(self, value):
        self._called([*(self.held or []), value])

    def update(self, value):
        self._called(value)

    def getValue(self, key):
        self._called(self.held or {})
        return self.held.get(key)

    def updateValue(self, key, value):
        self._called({**(self.held or {}), key: value})


def test_calls_of_the_state_do_not_grow_with_rows_or_memos():
    """Rows, memos and accounts of a group are stored together; many memos go to the map."""
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    from riskweave.operators.features import FeatureOptions
    from riskweave.streaming import state as st

    states = {n: CountedState() for n in ("open", "trail", "memos")}
    handle = SimpleNamespace(
        getListState=lambda *a: states["open"],
        getValueState=lambda *a: states["trail"],
        getMapState=lambda *a, **k: states["memos"],
        registerTimer=lambda ms: None,
    )
    worker = st.TrailingFeatures(FeatureOptions(10_000_000))
    worker.init(handle)

    def run(rows):
        """Rows (account, seconds, memo) arrive and become final; how often memos were seen."""
        given = [
            [0, None, a, f"{a}{t}", t, t * 1_000_000, "d", m, np.array([1.0, 0, 0, 0, 0, 0, 0, 0])] for a, t, m in rows
        ]
        for s in states.values():
            s.calls = 0
        assert not list(worker.handleInputRows((0,), iter([pd.DataFrame(given)]), None))
        late = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**9)
        (out,) = worker.handleExpiredTimer((0,), late, None)
        at = list(st.OUTPUT_NUMBERS).index("_memo_seen")
        volume = list(st.OUTPUT_NUMBERS).index("total_volume_5m")
        return [(r.account, r[4], r[6][at], r[6][volume]) for r in out.itertuples()]

    few = run([(a, t, f"m{t % 3}") for a in "ab" for t in range(100)])
    calls = sum(s.calls for s in states.values())
    assert calls < 10
    want = [(a, t * 1_000_000, float(t // 3), float(min(t + 1, 10))) for a in "ab" for t in range(100)]
    assert few == want
    # The next rows continue the window and the counts.
    assert run([("a", 100, "m0"), ("b", 100, "new")]) == [
        ("a", 100_000_000, 34.0, 10.0), ("b", 100_000_000, 0.0, 10.0),
    ]
    # An account with many memos moves them to the map, once, and goes on from there.
    many = run([("a", 101 + t, f"x{t}") for t in range(st.MEMOS_TOGETHER)])
    assert {m for _, _, m, _ in many} == {0.0} and len(states["memos"].held) == st.MEMOS_TOGETHER + 3
    assert run([("a", 1000, "m0"), ("a", 1001, "x5"), ("b", 1000, "new")]) == [
        ("a", 1_000_000_000, 35.0, 1.0), ("a", 1_001_000_000, 1.0, 2.0), ("b", 1_000_000_000, 1.0, 1.0),
    ]
    assert states["memos"].calls <= 5
