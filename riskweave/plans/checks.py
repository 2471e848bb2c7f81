"""One checkable query per operator, over whole driver tables.

Each takes (spark, sf_dir) and returns a DataFrame with its row key; the SQL of
the same name in ``check_sql`` gives the expected rows. Doubles are rounded on
both sides. Events are sparse, so window queries run with 5 minutes and 7 days.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskweave import functions as fn
from riskweave.operators import alerts as al
from riskweave.operators import features as ft
from riskweave.operators import normalize as nz
from riskweave.operators import scaling as sc
from riskweave.operators import amount_sketch as sk
from riskweave.operators import split as sp
from riskweave.operators import validation as va
from riskweave.operators.asof_rank import amounts_so_far
from riskweave.operators.forest import IsolationForest
from riskweave.operators.compiled_forest import score_natively
from riskweave.plans import pipeline as pl
from riskweave.plans.stored_forest import stored_forest
from riskweave.schema import FEATURE_COLUMNS
from riskweave.session import scratch_dir, written_table
from riskweave.sources import readers, sinks
from riskweave.sources.adapters import (
    events_as_raw,
    events_as_transactions,
    lineitem_as_transactions,
    orders_as_transactions,
    table,
)
from riskweave.streaming import streams as st

WINDOWS = ("5 minutes", "7 days")
Query = Callable[[SparkSession, str], DataFrame]

#: Contamination and score of the alert queries, whose model is a plain formula.
ALERT_CONTAMINATION = 0.15


def micros(column: str) -> F.Column:
    return F.unix_micros(F.col(column))


def rounded(df: DataFrame, places: int = 6, fine: tuple[str, ...] = ("fee_rate",)) -> DataFrame:
    """Round doubles for comparison; ``fine`` columns keep 12 places."""
    return df.select(
        *[
            F.round(F.col(c), 12 if c in fine else places).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/riskweave/{label}-{uuid.uuid4().hex}"


# --------------------------------------------------------------------------- sources


def scan_transactions(spark, sf_dir):
    df = readers.read_transactions(spark, events_as_transactions(spark, sf_dir))
    return df.withColumn("close_us", micros("close_time")).drop("close_time")


def scan_oldest_n(spark, sf_dir):
    df = readers.read_transactions(spark, orders_as_transactions(spark, sf_dir), limit=5000)
    return df.withColumn("close_us", micros("close_time")).drop("close_time")


def scan_newest_n(spark, sf_dir):
    df = readers.read_transactions(
        spark, orders_as_transactions(spark, sf_dir), limit=5000, newest=True
    )
    return df.withColumn("close_us", micros("close_time")).drop("close_time")


def normalised_rows(df: DataFrame) -> DataFrame:
    return df.withColumn("time_us", micros("timestamp")).drop("timestamp")


def src_csv_normalize(spark, sf_dir):
    path = fresh_path(spark, "raw-csv")
    readers.conform_raw(events_as_raw(spark, sf_dir)).write.option("header", "true").option(
        "escape", '"'
    ).option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    return normalised_rows(nz.normalize(readers.read_raw(spark, path, "csv")))


def src_json_normalize(spark, sf_dir):
    path = fresh_path(spark, "raw-json")
    raw_messages(events_as_raw(spark, sf_dir)).write.text(path)
    return normalised_rows(nz.normalize(readers.read_raw(spark, path, "json")))


def raw_messages(raw: DataFrame) -> DataFrame:
    """Raw records as JSON text, one message per line, in both spellings."""
    names = raw.columns
    positional = raw.toDF(*[f"c{i}" for i in range(len(names))])
    pairs = [
        F.when(
            F.col(f"c{i}").isNotNull(),
            F.concat(
                F.lit(f'"{n}":"'),
                F.replace(F.replace(F.col(f"c{i}"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
                F.lit('"'),
            ),
        )
        for i, n in enumerate(names)
    ]
    body = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
    return positional.select(body.alias("value"))


# --------------------------------------------------------------------------- normalising


def _normalised(spark, sf_dir):
    return nz.normalize(events_as_raw(spark, sf_dir))


def norm_amount(spark, sf_dir):
    raw = readers.conform_raw(events_as_raw(spark, sf_dir))
    picked = fn.parse_amount(fn.pick_amount("amount", "deliver_max", "taker_gets"))
    return raw.select(F.col("txn_signature").alias("id"), picked.alias("a")).select(
        "id",
        F.round("a.value", 8).alias("value"),
        F.col("a.currency").alias("currency"),
        F.col("a.issuer").alias("issuer"),
    )


def norm_amount_typed(spark, sf_dir):
    """Amounts, ledgers and fees that arrive as numbers, in a typed table and in JSON."""
    ev = table(spark, sf_dir, "events")
    e, v = F.col("event_id"), F.col("value")
    name = F.concat(F.lit("s"), e.cast("string"))
    account = F.col("user_id").cast("string")
    typed_path, json_path = fresh_path(spark, "typed"), fresh_path(spark, "typed-json")
    ev.select(
        (v * 1000.5).alias("amount"), (e + 0.9).alias("ledger_index"), (e % 7).cast("int").alias("fee"),
        account.alias("account"), name.alias("hash"), F.col("ts").cast("timestamp").alias("timestamp"),
    ).write.parquet(typed_path)
    digits, text = (v * 1000).cast("bigint").cast("string"), F.format_string("%.2f", v)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    amount = (
        F.when(e % 4 == 0, digits).when(e % 4 == 1, text).when(e % 4 == 2, F.lit('"abc"')).otherwise(quoted(text))
    )
    pairs = F.concat_ws(
        ",",
        F.concat(F.lit('"amount":'), amount),
        F.concat(F.lit('"ledger_index":'), (e + 0.9).cast("string")),
        F.concat(F.lit('"fee":'), (e % 7).cast("string")),
        F.concat(F.lit('"hash":'), quoted(name)),
    )
    ev.select(F.concat(F.lit("{"), pairs, F.lit("}")).alias("value")).write.text(json_path)
    parts = []
    for origin, raw in (
        ("typed", readers.read_raw(spark, typed_path, "parquet")),
        ("json", readers.read_raw(spark, json_path, "json")),
    ):
        rows = nz.normalize(raw, keep_rejects=True)
        parts.append(
            rows.select(
                F.lit(origin).alias("origin"), F.col("tx_hash").alias("id"), F.round("amount_xrp", 10).alias("value"),
                "ledger_index", "fee", F.array_join("_rejects", ",").alias("rejects"),
            )
        )
    return parts[0].unionByName(parts[1])


def norm_timestamp(spark, sf_dir):
    raw = readers.conform_raw(events_as_raw(spark, sf_dir))
    parsed = fn.parse_time(fn.first_filled("ledger_close_time_human", "date", "timestamp"))
    return raw.select(F.col("txn_signature").alias("id"), F.unix_micros(parsed).alias("time_us"))


def norm_aliases(spark, sf_dir):
    return _normalised(spark, sf_dir).select(
        "tx_hash", "tx_type", "account", "destination", "fee", "ledger_index"
    )


def normalize_all(spark, sf_dir):
    return normalised_rows(_normalised(spark, sf_dir))


def normalize_filter(spark, sf_dir):
    return normalised_rows(nz.drop_incomplete(_normalised(spark, sf_dir)))


def profile_load(spark, sf_dir):
    raw = readers.conform_raw(events_as_raw(spark, sf_dir))
    return nz.profile_load(raw).select(
        "raw_rows",
        "raw_columns",
        "kept_rows",
        micros("first_time").alias("first_us"),
        micros("last_time").alias("last_us"),
        "accounts",
    )


def profile_types(spark, sf_dir):
    return nz.profile_types(nz.drop_incomplete(_normalised(spark, sf_dir)))


def unify_schema(spark, sf_dir):
    """Normalised rows and table rows, brought to the same canonical columns."""
    a = nz.unify_schema(nz.drop_incomplete(_normalised(spark, sf_dir)))
    b = nz.unify_schema(events_as_transactions(spark, sf_dir))
    both = a.withColumn("origin", F.lit("raw")).unionByName(b.withColumn("origin", F.lit("table")))
    return rounded(both.withColumn("close_us", micros("close_time")).drop("close_time"), 8)


# --------------------------------------------------------------------------- features


def feature_query(columns: list[str], source=events_as_transactions, **options) -> Query:
    """Chosen features of all rows, for both windows."""

    def run(spark, sf_dir):
        parts = [
            ft.build_features(source(spark, sf_dir), window=w, **options).select(
                F.lit(w).alias("time_window"), "hash", *columns
            )
            for w in WINDOWS
        ]
        return rounded(parts[0].unionByName(parts[1]))

    return run


def features_all(spark, sf_dir):
    return feature_query(["account", "ledger_index", *FEATURE_COLUMNS])(spark, sf_dir)


def feat_size_percentile_asof(spark, sf_dir):
    """Amounts ranked among the rows so far, of users, customers and suppliers."""
    parts = []
    for name, source in (
        ("events", events_as_transactions),
        ("orders", orders_as_transactions),
        ("lineitem", lineitem_as_transactions),
    ):
        opts = ft.FeatureOptions(60_000_000)
        base = ft.prepare(source(spark, sf_dir), opts)
        ranked = amounts_so_far(base.select("account", *ft.ROW_ORDER, "amount_value"), ["account"], ft.ROW_ORDER)
        parts.append(ranked.select(F.lit(name).alias("origin"), "hash", F.col("_asof").alias("percentile")))
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def features_asof(spark, sf_dir):
    """Features without a look ahead."""
    f = ft.build_features(events_as_transactions(spark, sf_dir), window="7 days", look_ahead=False)
    return rounded(f.select("hash", "tx_size_percentile_local", "is_large_tx", "tx_rate_z_score", "duplicate_memo_count"))


def features_dense(spark, sf_dir):
    """All lines of a supplier in one window: trailing measures in linear time."""
    f = ft.build_features(lineitem_as_transactions(spark, sf_dir), window="4000 days")
    return rounded(f.select("hash", "account", "ledger_index", *FEATURE_COLUMNS), 4)


def feat_memo_entropy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.lit(0).cast("bigint").alias("sub"), "text"
    )
    talk = table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("origin"), F.col("conv_id").alias("id"), F.col("turn").alias("sub"), "text"
    )
    return docs.unionByName(talk).select(
        "origin", "id", "sub", F.round(fn.shannon_entropy("text"), 6).alias("memo_entropy")
    )


def feat_memo_len_url(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        F.char_length("url").cast("double").alias("url_length"),
        fn.contains_url("url").alias("url_has_url"),
        F.char_length("html").cast("double").alias("html_length"),
        fn.contains_url("html").alias("html_has_url"),
    )


def feat_duplicate_memo(spark, sf_dir):
    """Repeated texts per source, in document order."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("account"),
        F.col("doc_id").alias("ledger_index"),
        F.lit("2024-01-01").cast("timestamp").alias("close_time"),
        F.col("doc_id").cast("string").alias("hash"),
        F.col("text").alias("memo_text"),
    )
    return ft.build_features(docs).select("hash", "duplicate_memo_count")


def feat_tx_count_ledgers(spark, sf_dir):
    a = ft.ledger_activity(events_as_transactions(spark, sf_dir), (5, 20)).withColumn("origin", F.lit("events"))
    b = ft.ledger_activity(orders_as_transactions(spark, sf_dir), (5, 20)).withColumn("origin", F.lit("orders"))
    return a.unionByName(b)


def topk_volume_spike(spark, sf_dir, k: int = 100):
    """The flagship: the largest jumps of an account's trailing volume."""
    f = ft.build_features(events_as_transactions(spark, sf_dir), window="7 days")
    top = f.select("hash", "account", "ledger_index", "total_volume_5m", "volume_spike_ratio").orderBy(
        F.desc(F.round("volume_spike_ratio", 6)), "hash"
    )
    return rounded(top.limit(k))


def dq_nan_inf(spark, sf_dir):
    return ft.feature_quality(ft.build_features(events_as_transactions(spark, sf_dir), window="7 days"))


# --------------------------------------------------------------------------- splits


def temporal_split(spark, sf_dir):
    return sp.with_split(orders_as_transactions(spark, sf_dir)).select("hash", "split")


def split_profile(spark, sf_dir):
    return sp.split_profile(sp.with_split(orders_as_transactions(spark, sf_dir)))


def ts_folds(spark, sf_dir):
    return sp.fold_profile(sp.with_segment(orders_as_transactions(spark, sf_dir)))


def ts_fold_rows(spark, sf_dir):
    return sp.with_segment(orders_as_transactions(spark, sf_dir)).select("hash", "segment")


def feature_vector(spark, sf_dir):
    f = ft.build_features(events_as_transactions(spark, sf_dir), window="7 days")
    at = [F.round(F.col("features")[i], 6).alias(f"x{i}") for i in range(len(FEATURE_COLUMNS))]
    return sp.feature_vector(f).select("hash", F.size("features").alias("width"), *at)


def labelled_documents(spark, sf_dir):
    """Documents as rows with a label where one is given."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    joined = docs.join(labels, "doc_id")
    return joined.select(
        F.col("doc_id").cast("string").alias("hash"),
        F.col("source").alias("account"),
        F.col("doc_id").alias("ledger_index"),
        F.lit("2024-01-01").cast("timestamp").alias("close_time"),
        F.col("n_chars").cast("double").alias("amount_value"),
        F.col("text").alias("memo_text"),
        "label",
    )


def split_xy(spark, sf_dir):
    x, y = sp.split_xy(ft.build_features(labelled_documents(spark, sf_dir)))
    return rounded(
        x.select("hash", "tx_size_percentile_local", "memo_length", "duplicate_memo_count").join(y, "hash")
    )


def stratified_split(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return sp.stratified_split(labels, key="doc_id", label="toxic").select("doc_id", "toxic", "split")


def stratified_customers(spark, sf_dir):
    """A class for each customer: all classes are cut in the same passes."""
    orders = table(spark, sf_dir, "orders")
    return sp.stratified_split(orders, key="o_orderkey", label="o_custkey").select("o_orderkey", "o_custkey", "split")


# --------------------------------------------------------------------------- model numbers


def _model_features(spark, sf_dir):
    f = ft.build_features(events_as_transactions(spark, sf_dir), window="7 days")
    return written_table(f, "features")


def robust_scale(spark, sf_dir):
    f = _model_features(spark, sf_dir)
    cols = ["total_volume_5m", "volume_spike_ratio", "dormancy_gap", "tx_rate_mad_z", "contains_url"]
    doubles = f.select("hash", *[F.col(c).cast("double").alias(c) for c in cols])
    return rounded(sc.RobustScaler.fit(doubles, cols).transform(doubles))


def tukey_fence(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    ev = table(spark, sf_dir, "events").select("value")
    a = sc.tukey_outliers(li, "l_extendedprice").withColumn("origin", F.lit("lineitem"))
    b = sc.tukey_outliers(ev, "value").withColumn("origin", F.lit("events"))
    both = a.unionByName(b)
    return rounded(
        both.withColumn("contamination", sc.contamination_column(F.col("outliers"), F.col("n")))
    )


def exact_quantiles(spark, sf_dir):
    """The many-row path of the exact quantiles, on a whole table."""
    from riskweave.operators.ordering import exact_quantiles as quantiles

    cols, probs = ["l_extendedprice", "l_quantity"], [0.0, 0.25, 0.5, 0.95, 1.0]
    li = table(spark, sf_dir, "lineitem").select(*cols)
    found = quantiles(li, cols, probs, limit=1000)
    rows = [(c, p, found[c][i]) for c in cols for i, p in enumerate(probs)]
    return rounded(spark.createDataFrame(rows, "name string, p double, value double"))


def ks_two_sample(spark, sf_dir):
    """Early and late events, order prices of two statuses, and the block plan."""
    ev = table(spark, sf_dir, "events")
    od = table(spark, sf_dir, "orders")
    late = F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")
    a = va.ks_two_sample(ev.filter(~late), ev.filter(late), "value")
    f, o = od.filter("o_orderstatus = 'F'"), od.filter("o_orderstatus = 'O'")
    b = va.ks_two_sample(f, o, "o_totalprice", limit=100)
    both = a.withColumn("origin", F.lit("events")).unionByName(b.withColumn("origin", F.lit("orders")))
    return rounded(both)


def ks_exact(spark, sf_dir):
    """Balances of suppliers in nations of lower and of higher number."""
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_acctbal")
    low, high = rows.filter("s_nationkey < 12"), rows.filter("s_nationkey >= 12")
    found = va.ks_two_sample(low, high, "s_acctbal", method="exact")
    return rounded(found.select("n_a", "n_b", "ks_stat", "ks_p_value"))


def score_separation(spark, sf_dir):
    return rounded(va.score_separation(table(spark, sf_dir, "events").select("value"), "value"))


def cv_summary(spark, sf_dir):
    """The fold summary, over folds whose numbers come from plain counts."""
    rows = sp.with_segment(orders_as_transactions(spark, sf_dir))
    folds = rows.filter("segment > 0").groupBy(F.col("segment").alias("fold")).agg(
        F.avg((F.col("amount_value") > 400000).cast("double")).alias("contamination"),
        F.avg((F.col("amount_value") > 450000).cast("double")).alias("test_flag_rate"),
    )
    return va.cv_summary(folds)


# --------------------------------------------------------------------------- alerts


def formula_scored(spark, sf_dir) -> DataFrame:
    """Features of all events with a score and flag that SQL can repeat."""
    tx = events_as_transactions(spark, sf_dir)
    f = ft.build_features(tx, window="7 days")
    amount = tx.select("hash", (F.col("amount_value") / (F.col("amount_value") + 10)).alias("score"))
    return f.join(amount, "hash").withColumn("risk_flag", F.col("score") > 0.7)


def severity(spark, sf_dir):
    v = F.col("value")
    ev = table(spark, sf_dir, "events").select("event_id", (v / (v + 10)).alias("score"))
    sev = al.severity(F.col("score"), F.col("score") > 0.7, ALERT_CONTAMINATION)
    return ev.select("event_id", sev.alias("severity"))


def risk_label(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", al.risk_label(v / (v + 10)).alias("label"))


def signals(spark, sf_dir):
    """Codes and texts of the signals of every event."""
    f = ft.build_features(events_as_transactions(spark, sf_dir), window="7 days")
    return f.select(
        "hash",
        F.array_join(al.signal_codes(f.columns), ",").alias("codes"),
        F.array_join(al.signals(f.columns), " | ").alias("texts"),
    )


def _formula_alerts(spark, sf_dir):
    return al.alerts(formula_scored(spark, sf_dir), ALERT_CONTAMINATION, score_col="score")


def alerts(spark, sf_dir):
    found = _formula_alerts(spark, sf_dir)
    return found.withColumn("signals", F.array_join("signals", " | ")).drop("features")


def alerts_flat(spark, sf_dir):
    """Through the CSV sink and back."""
    path = fresh_path(spark, "alerts") + ".csv"
    sinks.write_alerts(_formula_alerts(spark, sf_dir), path)
    return _typed_flat(spark.read.option("header", "true").option("escape", '"').csv(path))


def alerts_json_roundtrip(spark, sf_dir):
    """Through the JSON sink and back."""
    found = _formula_alerts(spark, sf_dir)
    path = fresh_path(spark, "alerts") + ".json"
    sinks.write_alerts(found, path)
    return _typed_flat(al.flatten_alerts(spark.read.schema(found.schema).json(path)))


def _typed_flat(flat: DataFrame) -> DataFrame:
    numbers = {"anomaly_score", *[f"feat_{c}" for c in FEATURE_COLUMNS]}
    return flat.select(
        *[
            F.round(F.col(c).cast("double"), 4).alias(c)
            if c in numbers
            else F.col(c).cast("bigint" if c == "ledger_index" else "string").alias(c)
            for c in flat.columns
        ]
    )


def alert_summary(spark, sf_dir):
    return al.alert_summary(_formula_alerts(spark, sf_dir))


def topk_flagged(spark, sf_dir):
    top = al.topk_flagged(formula_scored(spark, sf_dir), 20, score_col="score")
    return rounded(top.select("account", "ledger_index", "score", "tx_rate_mad_z", "volume_spike_ratio",
                              "dest_concentration", "offer_cancel_ratio", "dormancy_gap"))


# --------------------------------------------------------------------------- forest


def _trained(spark, sf_dir):
    f = _model_features(spark, sf_dir)
    train_df, test_df = sp.temporal_split(f)
    return f, train_df, test_df, IsolationForest().fit(train_df)


def pc1(spark, sf_dir):
    f = _model_features(spark, sf_dir)
    scaled = sc.RobustScaler.fit(f, FEATURE_COLUMNS).transform(f)
    return scaled.select("hash", F.round(sc.first_component(scaled, FEATURE_COLUMNS), 6).alias("pc1"))


def calibrate(spark, sf_dir):
    f = _model_features(spark, sf_dir)
    scaled = sc.RobustScaler.fit(f, FEATURE_COLUMNS).transform(f)
    pc = scaled.select(sc.first_component(scaled, FEATURE_COLUMNS).alias("pc1"))
    out = sc.tukey_outliers(pc, "pc1")
    return out.withColumn("contamination", sc.contamination_column(F.col("outliers"), F.col("n")))


def iforest_fit(spark, sf_dir):
    _, train_df, _, model = _trained(spark, sf_dir)
    return spark.createDataFrame(model.nodes)


def iforest_score(spark, sf_dir):
    _, _, test_df, model = _trained(spark, sf_dir)
    return model.transform(test_df).select("hash", "raw_score", "score_pct", "anomaly_score")


def iforest_predict(spark, sf_dir):
    _, _, test_df, model = _trained(spark, sf_dir)
    return model.predict(test_df).select("hash", "prediction")


def iforest_proba(spark, sf_dir):
    _, _, test_df, model = _trained(spark, sf_dir)
    return model.predict_proba(test_df).select("hash", "p_normal", "p_anomaly")


def val_flag_rate(spark, sf_dir):
    _, train_df, test_df, model = _trained(spark, sf_dir)
    tagged = train_df.withColumn("side", F.lit("train")).unionByName(
        test_df.withColumn("side", F.lit("test"))
    )
    return model.transform(tagged).groupBy("side").agg(F.avg(F.col("risk_flag").cast("double")).alias("rate"))


def val_verdicts(spark, sf_dir):
    _, train_df, test_df, model = _trained(spark, sf_dir)
    return va.verdicts(va.validate(model.transform(train_df), model.transform(test_df)))


def timeseries_cv(spark, sf_dir):
    return va.timeseries_cv(_model_features(spark, sf_dir))


def _stored(spark, sf_dir):
    """Features, training and test rows, and the forest that is given by a rule."""
    f = _model_features(spark, sf_dir)
    train_df, test_df = sp.temporal_split(f)
    return f, train_df, test_df, stored_forest(train_df)


SCORES = ("raw_score", "score_pct", "anomaly_score")


def forest_score(spark, sf_dir):
    """All rows by the array scorer and by the compiled trees."""
    f, _, _, model = _stored(spark, sf_dir)
    native = score_natively(f, model).select("hash", *[F.col(c).alias(f"native_{c}") for c in SCORES])
    return rounded(model.transform(f).select("hash", *SCORES).join(native, "hash"))


def forest_predict(spark, sf_dir):
    f, _, _, model = _stored(spark, sf_dir)
    return model.predict(f).select("hash", "prediction")


def forest_proba(spark, sf_dir):
    f, _, _, model = _stored(spark, sf_dir)
    return rounded(model.predict_proba(f).select("hash", "p_normal", "p_anomaly"))


def forest_roundtrip(spark, sf_dir):
    """Scores of the stored model after saving and loading."""
    f, _, _, model = _stored(spark, sf_dir)
    path = fresh_path(spark, "stored-model")
    sinks.save_model(model, spark, path)
    return rounded(sinks.load_model(spark, path).transform(f).select("hash", *SCORES, "risk_flag"))


def score_stored(spark, sf_dir):
    """A stored model on the oldest rows of a table, numbered in the order of the result."""
    _, _, _, model = _stored(spark, sf_dir)
    path = fresh_path(spark, "stored-model")
    sinks.save_model(model, spark, path)
    scored = pl.score_table(
        spark, path, events_as_transactions(spark, sf_dir), limit=4000, window="7 days"
    )
    return rounded(placed(scored.select("hash", "account", "ledger_index", *SCORES, "risk_flag", *FEATURE_COLUMNS)))


def placed(ordered: DataFrame) -> DataFrame:
    """Rows of an ordered result with their place in it, for comparison."""
    spark, path = ordered.sparkSession, fresh_path(ordered.sparkSession, "ordered")
    ordered.write.parquet(path)
    # Files of one ordered write have their part number in their name.
    back = spark.read.schema(ordered.schema).parquet(path)
    at = F.struct(F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("r"))
    back = back.withColumn("_at", at)
    return back.withColumn("place", F.row_number().over(W.orderBy("_at"))).drop("_at")


def ordered_alerts(found: DataFrame) -> DataFrame:
    """Alerts with their place in the order of urgency, and the names of their top features."""
    shown = al.top_features(placed(al.by_urgency(found)))
    names = F.transform(F.split("top_features", "  "), lambda x: F.substring_index(x, "=", 1))
    return shown.select(
        "place", "severity", "anomaly_score", "account", "ledger_index",
        F.array_join("signals", " | ").alias("signals"), F.array_join(names, ",").alias("top_names"),
    )


def alerts_of_test_rows(spark, sf_dir):
    """Alerts of a fresh model: only the rows it hasn't seen, most urgent first."""
    _, _, test_df, model = _stored(spark, sf_dir)
    scored = pl.score(test_df, model, from_features=True)
    return ordered_alerts(al.alerts(scored, model.contamination))


def alerts_of_all_rows(spark, sf_dir):
    """Alerts of a stored model: every row is scored."""
    f, _, _, model = _stored(spark, sf_dir)
    scored = pl.score(f, model, from_features=True)
    return ordered_alerts(al.alerts(scored, model.contamination))


def forest_validation(spark, sf_dir):
    """Flag rates, drift, KS distance, separation, moments and verdicts."""
    _, train_df, test_df, model = _stored(spark, sf_dir)
    found = va.validate(model.transform(train_df), model.transform(test_df), ks_method="asymptotic")
    return va.verdicts(found)


def run_report(spark, sf_dir):
    """Counts of a run with a stored model, gathered while its parts are written."""
    _, _, _, model = _stored(spark, sf_dir)
    _, report = pl.run_report(events_as_transactions(spark, sf_dir), model, window="7 days")
    return rounded(report)


def score_batch(spark, sf_dir):
    f, _, _, model = _trained(spark, sf_dir)
    return pl.ranked(pl.score(f, model, from_features=True))


def model_roundtrip(spark, sf_dir):
    """Scores of a saved and reloaded model, next to those of the original."""
    _, _, test_df, model = _trained(spark, sf_dir)
    path = fresh_path(spark, "model")
    sinks.save_model(model, spark, path)
    loaded = sinks.load_model(spark, path)
    both = model.transform(test_df).select("hash", F.col("raw_score").alias("before"), *FEATURE_COLUMNS)
    return loaded.transform(both).select("hash", "before", F.col("raw_score").alias("after"))


def end_to_end(spark, sf_dir):
    """Raw records to alerts, scored by a model trained on the same history."""
    rows = pl.drop_incomplete(pl.normalize(events_as_raw(spark, sf_dir)))
    return pl.run_pipeline(spark, rows, n_splits=0, window="7 days")


# --------------------------------------------------------------------------- streams

STREAM_DELAY = "10 minutes"


def _through(spark, df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to the end of its input and read what it wrote."""
    out, state = fresh_path(spark, "stream"), fresh_path(spark, "stream-state")
    st.to_table(df, out, state, mode)
    return spark.read.schema(df.schema).parquet(out)


def _event_stream(spark, sf_dir) -> DataFrame:
    """Events as transactions, read as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    return events_as_transactions(spark, sf_dir, stream)


def stream_normalize(spark, sf_dir):
    path = fresh_path(spark, "raw-stream")
    raw_messages(events_as_raw(spark, sf_dir)).repartition(4).write.text(path)
    done = _through(spark, st.stream_transactions(st.stream_raw(spark, path, "json", max_files=2)))
    return normalised_rows(done.drop("success", "memo_text"))


def stream_csv_normalize(spark, sf_dir):
    """CSV files whose columns stand in different orders, as a stream."""
    path = fresh_path(spark, "csv-stream")
    raw = readers.conform_raw(events_as_raw(spark, sf_dir)).withColumn("extra", F.lit("x,y"))
    part = F.pmod(F.xxhash64("txn_signature"), F.lit(3))
    for i in range(3):
        columns = raw.columns[5 * i :] + raw.columns[: 5 * i]
        rows = raw.filter(part == i).select(*columns).repartition(2)
        rows.write.mode("append").option("header", "true").option("escape", '"').option(
            "ignoreLeadingWhiteSpace", "false"
        ).option("ignoreTrailingWhiteSpace", "false").csv(path)
    done = _through(spark, st.stream_transactions(st.stream_raw(spark, path, "csv", max_files=2)))
    return normalised_rows(done.drop("success", "memo_text"))


#: Files, and so triggers, of the stream with late rows.
LATE_FILES = 150


def stream_late(spark, sf_dir):
    """Rows behind the watermark, over more triggers than a query remembers."""
    events = events_as_transactions(spark, sf_dir).select("hash", "account", "close_time", "ledger_index")
    path, out = fresh_path(spark, "late-stream"), fresh_path(spark, "late-split")
    part = F.format_string("%04d", F.col("ledger_index") % LATE_FILES)
    # The reader takes files in the order of their time: they are written one by one, unsorted.
    staged = fresh_path(spark, "late-parts")
    events.withColumn("part", part).write.partitionBy("part").parquet(staged)
    for (name,) in sorted(events.select(part).distinct().collect()):
        rows = spark.read.schema(events.schema).parquet(f"{staged}/part={name}")
        rows.coalesce(1).write.parquet(f"{path}/part={name}")
    stream = (
        spark.readStream.schema(events.schema).option("maxFilesPerTrigger", "1").parquet(f"{path}/part=*")
    )
    st.split_late(stream, out, fresh_path(spark, "late-state"), "20 days", available_now=True).awaitTermination()
    ddl = ", ".join(f"{n} {t}" for n, t in events.dtypes)
    return st.read_split(spark, out, ddl, late=True).select("hash", "account", "batch")


def stream_features(spark, sf_dir):
    """Features of the stream, for the rows its watermark has passed."""
    f = st.stream_features(_event_stream(spark, sf_dir), window="7 days", delay=STREAM_DELAY)
    return rounded(_through(spark, f).drop("close_time", "tx_size_percentile_local", "is_large_tx"))


def stream_bursts(spark, sf_dir):
    tumbling = st.burst_counts(_event_stream(spark, sf_dir), "1 hour")
    sliding = st.burst_counts(_event_stream(spark, sf_dir), "1 hour", "15 minutes")
    both = [
        _through(spark, df, "complete").withColumn("kind", F.lit(kind))
        for kind, df in (("tumbling", tumbling), ("sliding", sliding))
    ]
    out = both[0].unionByName(both[1])
    return rounded(
        out.select("account", "kind", micros("start").alias("start_us"), micros("end").alias("end_us"), "n", "volume")
    )


def stream_amount_rank(spark, sf_dir):
    """Ranks from sketches that the batches of a stream have built."""
    events = events_as_transactions(spark, sf_dir)
    path = fresh_path(spark, "amount-stream")
    given = events.select("hash", "account", "amount_value", "close_time")
    given.repartition(4, "hash").write.parquet(path)
    stream = spark.readStream.schema(given.schema).option("maxFilesPerTrigger", "1").parquet(path)
    sketches = fresh_path(spark, "sketches")
    sk.add_to_sketch(stream, sketches, fresh_path(spark, "sketch-state"), available_now=True).awaitTermination()
    ranked = sk.with_sketched_rank(given, sk.read_sketch(spark, sketches))
    return rounded(ranked.select("hash", "tx_size_percentile_local"))


def stream_dedup(spark, sf_dir):
    """A stream in which every event arrives twice, read back once."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    twice = events_as_transactions(spark, sf_dir, stream.union(stream))
    once = _through(spark, st.deduplicated(twice))
    return once.select("hash", "account", "ledger_index", "amount_value")


def stream_alerts(spark, sf_dir):
    """Alerts of the live scoring query."""
    _, _, _, model = _trained(spark, sf_dir)
    amounts = written_table(st.amount_table(events_as_transactions(spark, sf_dir)), "amounts")
    f = st.stream_features(_event_stream(spark, sf_dir), window="7 days", amounts=amounts)
    out = fresh_path(spark, "live-alerts")
    st.live_alerts(f, model, out, fresh_path(spark, "live-state"), available_now=True).awaitTermination()
    return spark.read.parquet(out).drop("batch")


def build_queries() -> dict[str, Query]:
    one = feature_query
    return {
        "scan_transactions": scan_transactions,
        "scan_oldest_n": scan_oldest_n,
        "scan_newest_n": scan_newest_n,
        "src_csv_normalize": src_csv_normalize,
        "src_json_normalize": src_json_normalize,
        "norm_amount": norm_amount,
        "norm_amount_typed": norm_amount_typed,
        "norm_timestamp": norm_timestamp,
        "norm_aliases": norm_aliases,
        "normalize_all": normalize_all,
        "normalize_filter": normalize_filter,
        "profile_load": profile_load,
        "profile_types": profile_types,
        "unify_schema": unify_schema,
        "feat_size_percentile": one(["tx_size_percentile_local"]),
        "feat_is_large": one(["is_large_tx"]),
        "feat_volume_5m": one(["total_volume_5m"]),
        "feat_volume_spike": one(["volume_spike_ratio"]),
        "feat_fee_rate": one(["fee_rate"]),
        "feat_tx_count_5m": one(["rolling_tx_count_5m", "tx_per_minute"]),
        "feat_rate_zscore": one(["tx_rate_z_score"]),
        "feat_rate_mad_z": one(["tx_rate_mad_z"]),
        "feat_memo_entropy": feat_memo_entropy,
        "feat_memo_len_url": feat_memo_len_url,
        "feat_duplicate_memo": feat_duplicate_memo,
        "feat_dest": one(["dest_concentration", "unique_dest_ratio"]),
        "feat_cancel_ratio": one(["offer_cancel_ratio"]),
        "feat_failed_ratio": one(["failed_tx_ratio"]),
        "feat_dormancy": one(["dormancy_gap"]),
        "feat_tx_count_ledgers": feat_tx_count_ledgers,
        "features_all": features_all,
        "features_ties": one(["account", "ledger_index", *FEATURE_COLUMNS], orders_as_transactions),
        "features_positional": one(
            ["account", "ledger_index", *FEATURE_COLUMNS], orders_as_transactions, ties="positional"
        ),
        # The same rows through the plan for accounts too large for one task.
        "features_hot_accounts": one(["account", "ledger_index", *FEATURE_COLUMNS], hot_rows=60),
        "features_hot_ties": one(
            ["account", "ledger_index", *FEATURE_COLUMNS], orders_as_transactions, hot_rows=10
        ),
        "feat_size_percentile_asof": feat_size_percentile_asof,
        "features_asof": features_asof,
        "features_dense": features_dense,
        "topk_volume_spike": topk_volume_spike,
        "dq_nan_inf": dq_nan_inf,
        "temporal_split": temporal_split,
        "split_profile": split_profile,
        "ts_folds": ts_folds,
        "ts_fold_rows": ts_fold_rows,
        "feature_vector": feature_vector,
        "split_xy": split_xy,
        "stratified_split": stratified_split,
        "stratified_customers": stratified_customers,
        "robust_scale": robust_scale,
        "exact_quantiles": exact_quantiles,
        "pc1": pc1,
        "tukey_fence": tukey_fence,
        "calibrate": calibrate,
        "iforest_fit": iforest_fit,
        "iforest_score": iforest_score,
        "iforest_predict": iforest_predict,
        "iforest_proba": iforest_proba,
        "val_flag_rate": val_flag_rate,
        "val_verdicts": val_verdicts,
        "ks_two_sample": ks_two_sample,
        "ks_exact": ks_exact,
        "score_separation": score_separation,
        "timeseries_cv": timeseries_cv,
        "cv_summary": cv_summary,
        "severity": severity,
        "risk_label": risk_label,
        "signals": signals,
        "alerts": alerts,
        "alerts_flat": alerts_flat,
        "alerts_json_roundtrip": alerts_json_roundtrip,
        "alert_summary": alert_summary,
        "topk_flagged": topk_flagged,
        "forest_score": forest_score,
        "forest_predict": forest_predict,
        "forest_proba": forest_proba,
        "forest_roundtrip": forest_roundtrip,
        "forest_validation": forest_validation,
        "score_stored": score_stored,
        "alerts_of_test_rows": alerts_of_test_rows,
        "alerts_of_all_rows": alerts_of_all_rows,
        "run_report": run_report,
        "score_batch": score_batch,
        "model_roundtrip": model_roundtrip,
        "end_to_end": end_to_end,
        "stream_normalize": stream_normalize,
        "stream_amount_rank": stream_amount_rank,
        "stream_csv_normalize": stream_csv_normalize,
        "stream_late": stream_late,
        "stream_dedup": stream_dedup,
        "stream_features": stream_features,
        "stream_bursts": stream_bursts,
        "stream_alerts": stream_alerts,
    }
