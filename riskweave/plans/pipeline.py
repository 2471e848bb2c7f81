"""End-to-end plans: load, features, train or load, score, alert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators.alerts import SEVERITIES, alerts, by_urgency
from riskweave.operators.features import build_features
from riskweave.operators.forest import ForestModel, IsolationForest
from riskweave.operators.normalize import drop_incomplete, normalize, unify_schema
from riskweave.operators.split import temporal_split
from riskweave.operators.validation import cv_summary, cv_folds, validate
from riskweave.schema import FEATURE_COLUMNS
from riskweave.session import observed_table, written_table
from riskweave.sources.readers import read_raw, read_transactions
from riskweave.sources.sinks import load_model, save_model, write_alerts


def load_transactions(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Raw file to normalised transactions that have an account and a time."""
    return drop_incomplete(normalize(read_raw(spark, path, fmt), extras=True))


def train(
    features: DataFrame,
    model_path: str | None = None,
    train_frac: float = 0.8,
    n_splits: int = 5,
    forest: IsolationForest | None = None,
) -> tuple[ForestModel, DataFrame]:
    """Fit on the past, validate on the rest; returns (model, test rows).

    ``n_splits=0`` leaves out the cross-validation and its extra fits.
    """
    features = written_table(features, "features")
    train_df, test_df = temporal_split(features, train_frac)
    model = (forest or IsolationForest()).fit(train_df)
    metrics = validate(model.transform(train_df), model.transform(test_df)).first().asDict()
    if n_splits:
        metrics.update(cv_summary(cv_folds(features, n_splits)).first().asDict())
    model.metrics = metrics
    if model_path:
        save_model(model, features.sparkSession, model_path)
    return model, test_df


def score(df: DataFrame, model: ForestModel, from_features: bool = False, **options) -> DataFrame:
    """Score transactions (or ready features): keys, score, flag, features.

    Unordered; ``ranked`` sorts a result for reading.
    """
    features = df if from_features else build_features(df, **options)
    have = [c for c in FEATURE_COLUMNS if c in features.columns]
    keys = [c for c in ("hash", "account", "ledger_index", "close_time") if c in features.columns]
    return model.transform(features).select(
        *keys, "anomaly_score", "risk_flag", "raw_score", "score_pct", *have
    )


def score_table(
    spark: SparkSession,
    model_path: str,
    transactions: DataFrame,
    limit: int | None = 5000,
    newest: bool = False,
    **options,
) -> DataFrame:
    """Score a transactions table with a stored model, highest scores first.

    ``limit`` takes the oldest rows (or the newest); None or 0 takes the whole table.
    Features see the rows taken, no others.
    """
    rows = read_transactions(spark, transactions, limit=limit or None, newest=newest)
    return ranked(score(rows, load_model(spark, model_path), **options))


#: Parts of a run report and what is counted in each, in the pass that writes the part.
REPORT_PARTS = ("transactions", "features", "scored", "alerts")


def run_report(
    transactions: DataFrame, model: ForestModel, out_path: str | None = None, **feature_options
) -> tuple[DataFrame, DataFrame]:
    """(alerts, report) of a run with a stored model.

    The report has one row per part and metric: rows and times of the transactions, values
    of the features that are no number, flagged rows, alerts of each severity. Every metric
    is gathered by the tasks that write a part, so a run reads its input once and each
    part once.
    """
    spark = transactions.sparkSession
    rows = unify_schema(transactions)
    kept = F.col("account").isNotNull() & F.col("close_time").isNotNull()
    us = F.unix_micros("close_time")
    # unify_schema and the features name columns alike, so the table is a source again.
    rows, loaded = observed_table(
        rows,
        "transactions",
        {
            "rows": F.count(F.lit(1)),
            "kept_rows": F.count_if(kept),
            "first_us": F.min(F.when(kept, us)),
            "last_us": F.max(F.when(kept, us)),
            "failed_rows": F.count_if(~F.col("success")),
        },
    )
    values = [F.col(c).cast("double") for c in FEATURE_COLUMNS]
    bad = lambda c: (c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))).cast("long")
    features, measured = observed_table(
        build_features(rows, **feature_options),
        "features",
        {"rows": F.count(F.lit(1)), "not_numbers": F.sum(sum((bad(v) for v in values), F.lit(0)))},
    )
    scored, flagged = observed_table(
        score(features, model, from_features=True),
        "scored",
        {
            "rows": F.count(F.lit(1)),
            "flagged_rows": F.count_if("risk_flag"),
            "mean_score": F.avg("anomaly_score"),
        },
    )
    found, graded = observed_table(
        alerts(scored, model.contamination),
        "alerts",
        {s.lower(): F.count_if(F.col("severity") == s) for s in SEVERITIES},
    )
    if out_path:
        write_alerts(by_urgency(found), out_path)
    parts = zip(REPORT_PARTS, (loaded, measured, flagged, graded), strict=True)
    lines = [(part, m, None if v is None else float(v)) for part, got in parts for m, v in got.items()]
    report = spark.createDataFrame(lines, "part string, metric string, value double")
    return by_urgency(found), report


def ranked(scored: DataFrame, score_col: str = "anomaly_score") -> DataFrame:
    keys = [c for c in ("account", "ledger_index", "close_time", "hash") if c in scored.columns]
    return scored.orderBy(F.desc(score_col), *keys)


def run_pipeline(
    spark: SparkSession,
    transactions: str | DataFrame,
    out_path: str | None = None,
    save_model_path: str | None = None,
    load_model_path: str | None = None,
    live: bool = False,
    n_splits: int = 5,
    **feature_options,
) -> DataFrame:
    """Alerts of a transaction file (or frame), most urgent first.

    With a loaded model, or ``live``, every row is scored; otherwise only the
    test rows the new model has not seen.
    """
    rows = load_transactions(spark, transactions) if isinstance(transactions, str) else transactions
    features = build_features(rows, **feature_options)
    if load_model_path:
        model, target = load_model(spark, load_model_path), features
    else:
        features = written_table(features, "features")
        model, test_df = train(features, save_model_path, n_splits=n_splits)
        target = features if live else test_df
    found = alerts(score(target, model, from_features=True), model.contamination)
    if out_path:
        found = written_table(found, "alerts")
        write_alerts(by_urgency(found), out_path)
    return by_urgency(found)
