"""Alert files and saved models."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession

from riskweave.operators.alerts import flatten_alerts
from riskweave.operators.forest import NODE_SCHEMA, ForestModel
from riskweave.operators.scaling import RobustScaler

META_SCHEMA = (
    "columns array<string>, sample int, contamination double, threshold double, "
    "grid array<double>, trained_rows bigint, trained_at string, metrics string"
)


def write_alerts(alert_rows: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite") -> None:
    """Alerts as JSON lines, or flattened as CSV with a header (by file suffix)."""
    fmt = fmt or ("csv" if path.endswith(".csv") else "json")
    if fmt == "csv":
        flatten_alerts(alert_rows).write.mode(mode).option("header", "true").option(
            "escape", '"'
        ).csv(path)
    elif fmt == "json":
        alert_rows.write.mode(mode).option("ignoreNullFields", "false").json(path)
    else:
        alert_rows.write.mode(mode).format(fmt).save(path)


def save_model(model: ForestModel, spark: SparkSession, path: str, mode: str = "overwrite") -> None:
    """The model as three small tables: scaler, nodes, meta."""
    meta = [
        (
            list(model.columns),
            int(model.sample),
            float(model.contamination),
            float(model.threshold),
            [float(g) for g in model.grid],
            int(model.trained_rows),
            dt.datetime.now(dt.timezone.utc).isoformat(),
            json.dumps(model.metrics),
        )
    ]
    model.scaler.table(spark).coalesce(1).write.mode(mode).parquet(f"{path}/scaler")
    spark.createDataFrame(model.nodes, NODE_SCHEMA).coalesce(1).write.mode(mode).parquet(
        f"{path}/nodes"
    )
    spark.createDataFrame(meta, META_SCHEMA).coalesce(1).write.mode(mode).parquet(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> ForestModel:
    meta = spark.read.parquet(f"{path}/meta").first()
    scale = {r["feature"]: r for r in spark.read.parquet(f"{path}/scaler").collect()}
    nodes = spark.read.parquet(f"{path}/nodes").orderBy("tree", "node").toPandas()
    columns = list(meta["columns"])
    scaler = RobustScaler(
        tuple(columns),
        tuple(scale[c]["median"] for c in columns),
        tuple(scale[c]["iqr"] for c in columns),
    )
    return ForestModel(
        columns,
        scaler,
        nodes,
        meta["sample"],
        meta["contamination"],
        meta["threshold"],
        list(meta["grid"]),
        meta["trained_rows"],
        json.loads(meta["metrics"]),
    )
