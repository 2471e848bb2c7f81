"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Adaptive execution and a UTC clock; the rest is left to the cluster.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: str = "8", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("riskweave")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session
    without that setting gets a folder of its own: on a cluster a machine-local
    folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or (
        spark.sparkContext.getCheckpointDir()
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    own = tempfile.mkdtemp(prefix="riskweave-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def written_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the scratch folder and return the table read back.

    Cuts the lineage: whatever is computed from the result sees the same rows
    after an executor is lost, and nothing upstream is computed twice.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/riskweave/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _note(path)
    return spark.read.schema(df.schema).parquet(path)


def observed_table(df: DataFrame, label: str, measures: dict[str, Column]) -> tuple[DataFrame, dict]:
    """``written_table``, and aggregates of its rows gathered by the tasks that write it."""
    seen = Observation()
    named = [c.alias(name) for name, c in measures.items()]
    table = written_table(df.observe(seen, *named), label)
    return table, seen.get


_owners: list[list[str]] = []


def _note(path: str) -> None:
    if _owners:
        _owners[-1].append(path)


@contextlib.contextmanager
def owned_tables(spark: SparkSession):
    """Delete, at the end of the block, every table written in it.

    What leaves the block must be written elsewhere or collected before it ends. Blocks may
    lie in one another; a table belongs to the innermost.
    """
    _owners.append([])
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _owners.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
