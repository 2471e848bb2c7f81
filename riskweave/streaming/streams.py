"""Structured Streaming: ingest, features, burst counts, live alerts."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from riskweave.functions import duration_us, first_filled
from riskweave.operators.alerts import alerts
from riskweave.operators.features import FeatureOptions, finish, prepare
from riskweave.operators.forest import ForestModel
from riskweave.operators.normalize import drop_incomplete, normalize
from riskweave.schema import FEATURE_COLUMNS, RAW_SCHEMA
from riskweave.sources.readers import CSV_OPTIONS, RAW_ALIASES, raw_from_json
from riskweave.streaming.state import GROUPS, OUTPUT_SCHEMA, TrailingFeatures, packed, unpacked

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Steps of the per-account amount distribution that streams look up.
AMOUNT_STEPS = 200


def stream_raw(spark: SparkSession, path: str, fmt: str = "csv", max_files: int | None = None) -> DataFrame:
    """Raw records from a folder that another process adds files to.

    CSV columns are found by the header of each file (see :func:`csv_by_header`),
    fields of JSON lines by name.
    """
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", str(max_files))
    if fmt == "json":
        return raw_from_json(reader.text(path))
    if fmt == "csv":
        return csv_by_header(reader.text(path, wholetext=True))
    return reader.format(fmt).schema(RAW_SCHEMA).load(path)


#: Columns of a CSV file at most.
CSV_COLUMNS = 64


def csv_by_header(files: DataFrame, column: str = "value") -> DataFrame:
    """Raw records of whole CSV files, each read by its own header.

    The reader of CSV streams takes columns by their place. Here a file is one row (so
    files should stay below some 100 MB), its first line names its columns, and every
    other line is looked up by those names, in any order and with any others between. A
    line with another number of fields than the header, or a header without a known
    column, fails the stream instead of shifting values. Line breaks within quotes aren't
    supported.
    """
    options = {k: v for k, v in CSV_OPTIONS.items() if k in ("mode", "escape")}
    ddl = ", ".join(f"c{i} string" for i in range(CSV_COLUMNS))
    # A mark behind the last field tells a line's width, also where fields are empty.
    mark = "\x01"

    def parsed(line):
        return F.from_csv(F.concat(line, F.lit(f",{mark}")), ddl, options)

    def fields(row):
        return F.array(*[F.col(row)[f"c{i}"] for i in range(CSV_COLUMNS)])

    # Inside a generator an expression runs once; as a plain column it would for each use.
    lines = files.select(F.explode(F.array(F.split(column, "\r?\n"))).alias("_lines"))
    header = F.regexp_replace(F.get("_lines", F.lit(0)), "^\ufeff", "")
    # The header is parsed once for its file, and lines take along where each column is.
    heads = lines.select("_lines", F.explode(F.array(parsed(header))).alias("_head"))
    names = F.transform(fields("_head"), lambda n: F.trim(n))
    heads = heads.select("_lines", F.explode(F.array(names)).alias("_names"))
    known = [*RAW_SCHEMA.fieldNames(), *RAW_ALIASES.values()]
    places = F.struct(
        F.array_position("_names", mark).alias("width"),
        F.arrays_overlap("_names", F.array(*[F.lit(n) for n in known])).alias("named"),
        *[F.array_position("_names", n).cast("int").alias(f"at{i}") for i, n in enumerate(known)],
    )
    placed = heads.select("_lines", F.explode(F.array(places)).alias("_at"))
    body = placed.select("_at", F.posexplode("_lines").alias("_nth", "_line"))
    rows = body.filter((F.col("_nth") > 0) & (F.col("_line") != "")).select(
        "_at", F.explode(F.array(parsed(F.col("_line")))).alias("_row")
    )
    rows = rows.select("_at", F.explode(F.array(fields("_row"))).alias("_fields"))
    same = F.col("_at.width") == F.array_position("_fields", mark)
    checked = F.when(same & F.col("_at.named"), F.col("_fields")).otherwise(
        F.raise_error(F.lit("CSV line and header don't match")).cast("array<string>")
    )
    rows = rows.select("_at", F.explode(F.array(checked)).alias("_fields"))

    def value(name):
        at = F.col(f"_at.at{known.index(name)}")
        return F.when(at > 0, F.get("_fields", at - 1))

    return rows.select(
        *[
            (first_filled(value(c), value(RAW_ALIASES[c])) if c in RAW_ALIASES else value(c)).alias(c)
            for c in RAW_SCHEMA.fieldNames()
        ]
    )


def stream_transactions(raw: DataFrame) -> DataFrame:
    """The batch normaliser, applied to a stream."""
    return drop_incomplete(normalize(raw, extras=True))


def deduplicated(df: DataFrame, time: str = "close_time", key: str = "hash", delay: str = "10 minutes") -> DataFrame:
    """Drop repeats of a hash that arrive within the allowed lateness."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def stream_features(
    df: DataFrame,
    window: str = "5 minutes",
    rows: int = 20,
    min_rows: int = 3,
    delay: str = "10 minutes",
    memo_ttl_ms: int | None = None,
    amounts: DataFrame | None = None,
    groups: int = GROUPS,
) -> DataFrame:
    """The batch features of a stream of transactions, once they are final.

    A row is emitted when the watermark (newest time minus ``delay``) has passed
    it. The rank of an amount in its account's whole history cannot be
    known from a stream; with ``amounts`` (see :func:`amount_table`) it is looked
    up, without it is 0. State is kept for ``groups`` groups of accounts; like the window,
    their number must stay when a stream is started again.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    opts = FeatureOptions(duration_us(window), rows, min_rows)
    base = prepare(df, opts).withWatermark("close_time", delay)
    measured = packed(base, groups).groupBy("_group").transformWithStateInPandas(
        statefulProcessor=TrailingFeatures(opts, memo_ttl_ms),
        outputStructType=OUTPUT_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )
    timed = unpacked(measured).withColumn("close_time", F.timestamp_micros("_us"))
    if amounts is None:
        ranked = timed.withColumn("tx_size_percentile_local", F.lit(0.0))
    else:
        ranked = with_amount_rank(timed, amounts)
    done = finish(ranked, opts)
    return done.select("hash", "account", "ledger_index", "close_time", *FEATURE_COLUMNS)


def amount_table(history: DataFrame, steps: int = AMOUNT_STEPS) -> DataFrame:
    """Per account, ``steps + 1`` evenly spaced quantiles of its past amounts."""
    marks = [k / steps for k in range(steps + 1)]
    return history.groupBy("account").agg(
        F.percentile_approx("amount_value", marks, 50 * steps).alias("_marks")
    )


def with_amount_rank(df: DataFrame, amounts: DataFrame) -> DataFrame:
    """Rank of each amount among its account's past ones, from the quantile table.

    The first amounts of an unknown account rank 1, as in a history of one.
    """
    reached = F.size(F.filter("_marks", lambda m: m <= F.col("amount_value")))
    steps = F.size("_marks") - 1
    rank = F.greatest(reached - 1, F.lit(0)) / steps
    return (
        df.join(amounts, "account", "left")
        .withColumn("tx_size_percentile_local", F.coalesce(rank, F.lit(1.0)))
        .drop("_marks")
    )


def burst_counts(
    df: DataFrame, window: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Transactions per account and time window, tumbling or sliding.

    Counts are combined on the map side, so a busy account costs its task one
    row per window and input partition.
    """
    span = F.window("close_time", window, slide) if slide else F.window("close_time", window)
    return (
        df.withWatermark("close_time", delay)
        .groupBy(span.alias("span"), "account")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount_value").alias("volume"))
        .select("account", F.col("span.start").alias("start"), F.col("span.end").alias("end"), "n", "volume")
    )


def activity_sessions(df: DataFrame, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Runs of an account's transactions with no pause longer than ``gap``."""
    return (
        df.withWatermark("close_time", delay)
        .groupBy(F.session_window("close_time", gap).alias("span"), "account")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount_value").alias("volume"))
        .select("account", F.col("span.start").alias("start"), F.col("span.end").alias("end"), "n", "volume")
    )


def live_alerts(
    features: DataFrame, model: ForestModel, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Score each batch of features and add its alerts to a Parquet table.

    A batch writes its own folder and overwrites it when it is run again, so a
    restarted query leaves every alert once.
    """

    def deliver(batch: DataFrame, batch_id: int) -> None:
        found = alerts(model.transform(batch), model.contamination)
        found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = features.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all input there is now, into a Parquet folder, and wait.

    ``complete`` mode replaces the folder with each batch's whole result.
    """
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark has dropped in the triggers a query remembers, the last hundred.

    :class:`LateRowCounter` counts over any number of them.
    """
    return sum(
        op.get("numRowsDroppedByWatermark", 0)
        for progress in query.recentProgress
        for op in progress["stateOperators"]
    )


class LateRowCounter(StreamingQueryListener):
    """Adds up the rows that watermarks drop, by query, over any number of triggers.

    A query itself remembers its last hundred triggers only. Add one counter to
    ``spark.streams`` before the queries start.
    """

    def __init__(self):
        self.dropped: Counter = Counter()
        self.triggers: Counter = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self.triggers[str(progress.id)] += 1
        self.dropped[str(progress.id)] += sum(
            op.numRowsDroppedByWatermark for op in progress.stateOperators
        )

    def onQueryTerminated(self, event) -> None:
        pass


def split_late(
    df: DataFrame, path: str, checkpoint: str, delay: str = "10 minutes", time: str = "close_time",
    available_now: bool = False,
) -> StreamingQuery:
    """Write the rows of a stream to ``path``, those older than its watermark apart.

    The watermark of a batch is the newest time of all batches before it, less ``delay``.
    A batch that runs again replaces its folder, so no row is lost or doubled, and a query
    that starts again finds the newest time in the folders of the batches before. Rows
    without a time count as in time.
    """
    delay_us = duration_us(delay)
    spark, schema = df.sparkSession, df.schema
    us = F.unix_micros(time)
    newest_after: dict[int, int | None] = {-1: None}

    def split(batch: DataFrame, batch_id: int) -> None:
        if batch_id - 1 not in newest_after:
            stored = spark.read.schema(schema.add("batch", "long")).parquet(path)
            stored = stored.filter(F.col("batch") < batch_id)
            newest_after[batch_id - 1] = stored.agg(F.max(us)).first()[0]
        newest = newest_after[batch_id - 1]
        late = F.lit(False) if newest is None else F.coalesce(us < newest - delay_us, F.lit(False))
        seen = Observation()
        marked = batch.withColumn("_late", late).observe(seen, F.max(us).alias("newest"))
        marked.write.mode("overwrite").partitionBy("_late").parquet(f"{path}/batch={batch_id}")
        times = [t for t in (newest, seen.get["newest"]) if t is not None]
        newest_after.clear()
        newest_after.update({batch_id - 1: newest, batch_id: max(times, default=None)})

    writer = df.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_split(spark: SparkSession, path: str, schema: str, late: bool) -> DataFrame:
    """The late rows of :func:`split_late`, or those in time, with their batch."""
    both = spark.read.schema(f"{schema}, batch long, _late boolean").parquet(path)
    return both.filter(F.col("_late") == late).drop("_late")


def observed(df: DataFrame, name: str = "ingest") -> DataFrame:
    """Report rows and the newest time of each batch in the query progress."""
    return df.observe(
        name, F.count(F.lit(1)).alias("rows"), F.max("close_time").alias("newest_time")
    )
