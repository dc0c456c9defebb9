"""Feature and rule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyguard.functions import text
from tallyguard.operators.analytics import distinct_merchants, merchant_sketches, merge_sketches
from tallyguard.operators.audit import drop_redelivered
from tallyguard.operators.card_windows import card_features
from tallyguard.operators.lookups import as_of
from tallyguard.operators.rules import hour_of_day
from tallyguard.operators.scoring import score_transactions
from tallyguard.operators.snapshots import (
    card_snapshots,
    expire,
    last_merchant,
    latest_per_key,
    new_device_flag,
    new_merchant_flag,
    strict_week,
    with_snapshot,
)
from tallyguard.plans.oracle import DENSE, SPARSE, on_features, on_scores
from tallyguard.plans.registry import query
from tallyguard.sources.views import given_probability, tx_dense, tx_sparse


def dense_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card_features(tx_dense(spark, sf_dir))


def sparse_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card_features(tx_sparse(spark, sf_dir))


def dense_scores(spark: SparkSession, sf_dir: str, with_p: bool = False) -> DataFrame:
    features = dense_features(spark, sf_dir)
    if with_p:
        return score_transactions(features.withColumn("p", given_probability()), "p")
    return score_transactions(features)


def rules_text():
    return F.array_join("applied_rules", ",").alias("applied_rules")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions to decisions, end to end."""
    return dense_scores(spark, sf_dir).select("tx_id", "card_id", "risk_score", "decision", rules_text())


_FEATURE_COLUMNS = {
    "w01_tx_count_1h": ("tx_count_1h", "dense"),
    "w02_tx_count_6h": ("tx_count_6h", "dense"),
    "w03_tx_count_24h": ("tx_count_24h", "sparse"),
    "w04_running_mean_amount": ("avg_amount_7d", "sparse"),
    "w05_running_distinct_merchants": ("distinct_merchants_24h", "sparse"),
    "w07_country_changed": ("country_changed", "dense"),
    "w08_time_since_last": ("time_since_last_tx_ms", "sparse"),
    "w09_previous_device": ("device_hash", "sparse"),
    "w10_velocity_score": ("velocity_score", "dense"),
}


def _register_features() -> None:
    for name, (column, view) in _FEATURE_COLUMNS.items():

        def run(spark: SparkSession, sf_dir: str, column=column, view=view) -> DataFrame:
            features = dense_features if view == "dense" else sparse_features
            return features(spark, sf_dir).select("tx_id", "card_id", "ts_ms", column)

        query(name, on_features(f"SELECT tx_id, card_id, ts_ms, {column} FROM feat", DENSE if view == "dense" else SPARSE))(run)


_register_features()

_ALL = (
    "tx_id, card_id, ts_ms, tx_count_1h, tx_count_6h, tx_count_24h, avg_amount_7d, distinct_merchants_24h, "
    "country_changed, time_since_last_tx_ms, device_hash, velocity_score"
)


@query("card_features_dense", on_features(f"SELECT {_ALL} FROM feat"))
def card_features_dense(spark, sf_dir):
    return dense_features(spark, sf_dir).select(*_ALL.split(", "))


@query("card_features_sparse", on_features(f"SELECT {_ALL} FROM feat", SPARSE))
def card_features_sparse(spark, sf_dir):
    return sparse_features(spark, sf_dir).select(*_ALL.split(", "))


@query("card_features_hot_cards", on_features(f"SELECT {_ALL} FROM feat"))
def card_features_hot_cards(spark, sf_dir):
    """Cards above 70 rows take the sliced route, the others the plain one."""
    return card_features(tx_dense(spark, sf_dir), max_rows_per_card=70).select(*_ALL.split(", "))


_REPLACED = DENSE.replace("tx AS (", "given AS (", 1) + ", tx AS (SELECT * REPLACE ({}) FROM given)"


@query(
    "card_features_null_keys_hot",
    on_features(
        f"SELECT {_ALL} FROM feat",
        _REPLACED.format(
            "CASE WHEN tx_id%7<>0 THEN card_id END AS card_id, CASE WHEN tx_id%2<>0 THEN merchant_id END AS merchant_id"
        ),
    ),
)
def card_features_null_keys_hot(spark, sf_dir):
    """A seventh of the rows share the NULL card, half of all the NULL merchant; the sliced route."""
    tx = F.col("tx_id")
    rows = tx_dense(spark, sf_dir).withColumns(
        {"card_id": F.when(tx % 7 != 0, F.col("card_id")), "merchant_id": F.when(tx % 2 != 0, F.col("merchant_id"))}
    )
    return card_features(rows, max_rows_per_card=70).select(*_ALL.split(", "))


@query("w04_four_decimals", on_features("SELECT tx_id, avg_amount_7d FROM feat", _REPLACED.format("amount + (tx_id%97)/10000.0::DOUBLE AS amount")))
def w04_four_decimals(spark, sf_dir):
    rows = tx_dense(spark, sf_dir).withColumn("amount", F.col("amount") + F.col("tx_id") % 97 / F.lit(10000.0))
    return card_features(rows).select("tx_id", "avg_amount_7d")


_RULES = {
    "r01_velocity": "rule_velocity",
    "r02_amount_anomaly": "rule_amount_anomaly",
    "r03_geo_anomaly": "rule_geo_anomaly",
    "r04_merchant_category": "rule_merchant_category",
    "r05_device_change": "rule_device_change",
    "r06_time_anomaly": "rule_time_anomaly",
}


def _register_rules() -> None:
    for name, column in _RULES.items():

        def run(spark: SparkSession, sf_dir: str, column=column) -> DataFrame:
            return dense_scores(spark, sf_dir).select("tx_id", column)

        query(name, on_scores(f"SELECT tx_id, {column} FROM scored"))(run)


_register_rules()
query("score_flagship", on_scores("SELECT tx_id, card_id, risk_score, decision, applied_rules FROM scored"))(flagship)


# --- snapshots, first-seen flags, as-of join ---------------------------------------------------

AS_OF_MS = 1_717_027_200_000  # 150 days after the first event, where the stretched view ends


@query(
    "w06_strict_week",
    f"""WITH {SPARSE} SELECT tx_id, card_id, count(*) OVER w AS tx_count_7d,
      CAST(sum(CAST(round(amount*10000) AS BIGINT)) OVER w AS DOUBLE)/(10000.0::DOUBLE*CAST(count(*) OVER w AS DOUBLE)) AS avg_amount_strict_7d,
      max(amount) OVER w AS max_amount_7d
    FROM tx WINDOW w AS (PARTITION BY card_id ORDER BY ts_ms RANGE BETWEEN 604800000 PRECEDING AND CURRENT ROW)""",
)
def w06_strict_week(spark, sf_dir):
    rows = strict_week(tx_sparse(spark, sf_dir))
    return rows.select("tx_id", "card_id", "tx_count_7d", "avg_amount_strict_7d", "max_amount_7d")


query(
    "w06_strict_week_hot_cards",
    f"""WITH {DENSE} SELECT tx_id, card_id, count(*) OVER w AS tx_count_7d,
      CAST(sum(CAST(round(amount*10000) AS BIGINT)) OVER w AS DOUBLE)/(10000.0::DOUBLE*CAST(count(*) OVER w AS DOUBLE)) AS avg_amount_strict_7d,
      max(amount) OVER w AS max_amount_7d
    FROM tx WINDOW w AS (PARTITION BY card_id ORDER BY ts_ms RANGE BETWEEN 604800000 PRECEDING AND CURRENT ROW)""",
)(
    lambda spark, sf_dir: strict_week(tx_dense(spark, sf_dir), max_rows=60).select(
        "tx_id", "card_id", "tx_count_7d", "avg_amount_strict_7d", "max_amount_7d"
    )
)

_SNAPSHOT_SQL = """SELECT card_id, last_tx_ms, {columns} FROM (
  SELECT card_id, ts_ms AS last_tx_ms, tx_count_1h, tx_count_6h, tx_count_24h, avg_amount_7d, distinct_merchants_24h,
    nullif(country,'') AS last_country, country_changed, time_since_last_tx_ms, nullif(device,'') AS device_hash, velocity_score,
    row_number() OVER (PARTITION BY card_id ORDER BY ts_ms DESC, tx_id DESC) AS r FROM feat) WHERE r=1"""
_SNAPSHOT = (
    "tx_count_1h, tx_count_6h, tx_count_24h, avg_amount_7d, distinct_merchants_24h, last_country, country_changed, "
    "time_since_last_tx_ms, device_hash, velocity_score"
)


@query("w11_card_snapshots", on_features(_SNAPSHOT_SQL.format(columns=_SNAPSHOT)))
def w11_card_snapshots(spark, sf_dir):
    return card_snapshots(dense_features(spark, sf_dir)).select("card_id", "last_tx_ms", *_SNAPSHOT.split(", "))


@query(
    "w12_snapshots_as_of",
    on_features(
        _SNAPSHOT_SQL.format(
            columns=", ".join(
                f"CASE WHEN {AS_OF_MS}-last_tx_ms>=604800000 THEN {default} ELSE {column} END AS {column}"
                for column, default in {
                    "tx_count_24h": "0",
                    "avg_amount_7d": "0.0::DOUBLE",
                    "last_country": "NULL",
                    "country_changed": "false",
                    "time_since_last_tx_ms": "-1",
                    "device_hash": "NULL",
                    "velocity_score": "0.0::DOUBLE",
                }.items()
            )
        ),
        SPARSE,
    ),
)
def w12_snapshots_as_of(spark, sf_dir):
    snapshots = card_snapshots(sparse_features(spark, sf_dir))
    return expire(snapshots, F.lit(AS_OF_MS)).select(
        "card_id", "last_tx_ms", "tx_count_24h", "avg_amount_7d", "last_country", "country_changed",
        "time_since_last_tx_ms", "device_hash", "velocity_score",
    )


@query(
    "w13_new_merchant",
    f"""WITH {DENSE} SELECT tx_id, row_number() OVER (PARTITION BY card_id, merchant_id ORDER BY ts_ms, tx_id)=1 AS is_new_merchant FROM tx""",
)
def w13_new_merchant(spark, sf_dir):
    return new_merchant_flag(tx_dense(spark, sf_dir)).select("tx_id", "is_new_merchant")


query(
    "w13_new_merchant_hot_pairs",
    f"""WITH {DENSE} SELECT tx_id, row_number() OVER (PARTITION BY card_id, merchant_id ORDER BY ts_ms, tx_id)=1 AS is_new_merchant FROM tx""",
)(lambda spark, sf_dir: new_merchant_flag(tx_dense(spark, sf_dir), max_rows=2).select("tx_id", "is_new_merchant"))


@query(
    "w14_new_device",
    f"""WITH {SPARSE} SELECT tx_id, ts_ms - min(ts_ms) OVER (PARTITION BY card_id, device) < 86400000 AS is_new_device FROM tx""",
)
def w14_new_device(spark, sf_dir):
    return new_device_flag(tx_sparse(spark, sf_dir)).select("tx_id", "is_new_device")


@query(
    "w15_last_merchant",
    f"""WITH {SPARSE} SELECT card_id, merchant_id AS last_merchant_id FROM tx
    QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY ts_ms DESC, tx_id DESC)=1""",
)
def w15_last_merchant(spark, sf_dir):
    return last_merchant(tx_sparse(spark, sf_dir))


@query(
    "s16_latest_per_card",
    f"""WITH {DENSE} SELECT card_id, tx_id, ts_ms, amount FROM tx
    QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY ts_ms DESC, tx_id DESC)=1""",
)
def s16_latest_per_card(spark, sf_dir):
    rows = tx_dense(spark, sf_dir).select("card_id", "tx_id", "ts_ms", "amount")
    return latest_per_key(rows, ["card_id"], ["ts_ms", "tx_id"])


_AS_OF_SQL = on_features(
    """SELECT c.tx_id, c.card_id, f.ts_ms AS snapshot_ms, f.avg_amount_7d, f.tx_count_24h
    FROM (SELECT tx_id, card_id, ts_ms - 1 AS at FROM tx) c
    ASOF LEFT JOIN (SELECT * FROM feat QUALIFY row_number() OVER (PARTITION BY card_id, ts_ms ORDER BY tx_id DESC)=1) f
    ON c.card_id=f.card_id AND c.at>=f.ts_ms""",
    SPARSE,
)


def _as_of(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Every transaction with its card's newest snapshot from before it."""
    asked = tx_sparse(spark, sf_dir).select("tx_id", "card_id", (F.col("ts_ms") - 1).alias("ts_ms"))
    history = latest_per_key(sparse_features(spark, sf_dir), ["card_id", "ts_ms"], ["tx_id"]).withColumnRenamed("ts_ms", "snapshot_ms")
    joined = as_of(asked, history, ["avg_amount_7d", "tx_count_24h"], **options)
    return joined.select("tx_id", "card_id", "snapshot_ms", "avg_amount_7d", "tx_count_24h")


query("j01_as_of_snapshot", _AS_OF_SQL)(lambda spark, sf_dir: _as_of(spark, sf_dir))
query("j01_as_of_snapshot_hot_cards", _AS_OF_SQL)(lambda spark, sf_dir: _as_of(spark, sf_dir, max_rows=25))

_WITH_DEFAULTS = """SELECT t.tx_id, coalesce(f.tx_count_24h,0) AS tx_count_24h, coalesce(f.avg_amount_7d,0.0::DOUBLE) AS avg_amount_7d,
    coalesce(f.time_since_last_tx_ms,-1) AS time_since_last_tx_ms, CASE WHEN f.card_id IS NOT NULL THEN f.device END AS device_hash,
    coalesce(f.country_changed,false) AS country_changed
  FROM (SELECT tx_id, CASE WHEN tx_id%4=0 THEN card_id+1000000 ELSE card_id END AS card_id FROM tx) t
  LEFT JOIN (SELECT * FROM feat QUALIFY row_number() OVER (PARTITION BY card_id ORDER BY ts_ms DESC, tx_id DESC)=1) f USING (card_id)"""


@query("p13_default_features", on_features(_WITH_DEFAULTS, SPARSE))
def p13_default_features(spark, sf_dir):
    """Every transaction enriched from its card's snapshot; every fourth carries a card that has none
    and gets the defaults."""
    unknown = F.when(F.col("tx_id") % 4 == 0, F.col("card_id") + 1_000_000).otherwise(F.col("card_id"))
    asked = tx_sparse(spark, sf_dir).select("tx_id", unknown.alias("card_id"))
    return with_snapshot(asked, card_snapshots(sparse_features(spark, sf_dir))).select(
        "tx_id", "tx_count_24h", "avg_amount_7d", "time_since_last_tx_ms", "device_hash", "country_changed"
    )


@query(
    "p14_unknown_card",
    f"""WITH {SPARSE} SELECT DISTINCT card_id+1000000 AS card_id, 0 AS tx_count_1h, 0.0::DOUBLE AS avg_amount_7d, NULL::VARCHAR AS last_country,
      false AS country_changed, -1::BIGINT AS time_since_last_tx_ms, NULL::VARCHAR AS device_hash FROM tx""",
)
def p14_unknown_card(spark, sf_dir):
    """Cards that have no snapshot, as they read."""
    seen = tx_sparse(spark, sf_dir).select("card_id").distinct()
    cards = seen.union(seen.select(F.col("card_id") + 1_000_000))
    snapshots = card_snapshots(sparse_features(spark, sf_dir))
    unseen = cards.join(snapshots, "card_id", "left_anti")
    return with_snapshot(unseen, snapshots).select(
        "card_id", F.col("tx_count_1h").cast("int").alias("tx_count_1h"), "avg_amount_7d", "last_country", "country_changed",
        "time_since_last_tx_ms", "device_hash",
    )


@query(
    "p19_hour_and_weekday",
    f"""WITH {SPARSE} SELECT tx_id, CAST(hour(make_timestamp(ts_ms*1000)) AS INTEGER) AS hour_of_day,
      CAST(dayofweek(make_timestamp(ts_ms*1000))+1 AS INTEGER) AS day_of_week FROM tx""",
)
def p19_hour_and_weekday(spark, sf_dir):
    return tx_sparse(spark, sf_dir).select(
        "tx_id", hour_of_day().alias("hour_of_day"), text.day_of_week(F.col("ts_ms")).alias("day_of_week")
    )


query("f11_hour_utc", f"WITH {DENSE} SELECT tx_id, CAST(hour(make_timestamp(ts_ms*1000)) AS INTEGER) AS hour FROM tx")(
    lambda spark, sf_dir: tx_dense(spark, sf_dir).select("tx_id", hour_of_day().alias("hour"))
)


@query(
    "f10_instants",
    f"""WITH {DENSE} SELECT tx_id, ts_ms, strftime(make_timestamp(ts_ms*1000), '%Y-%m-%dT%H:%M:%S')
      || CASE WHEN ts_ms%1000<>0 THEN '.' || lpad(CAST(ts_ms%1000 AS VARCHAR),3,'0') ELSE '' END || 'Z' AS iso, ts_ms AS back_ms FROM tx""",
)
def f10_instants(spark, sf_dir):
    return tx_dense(spark, sf_dir).select(
        "tx_id",
        "ts_ms",
        text.iso_instant(F.col("ts_ms")).alias("iso"),
        F.unix_millis(F.timestamp_millis("ts_ms")).alias("back_ms"),
    )


@query(
    "f12_hour_date_month",
    f"""WITH {SPARSE} SELECT tx_id, ts_ms//3600000*3600000 AS hour_ms, CAST(make_timestamp(ts_ms*1000) AS DATE) AS date,
      CAST(strftime(make_timestamp(ts_ms*1000), '%Y%m') AS INTEGER) AS yyyymm FROM tx""",
)
def f12_hour_date_month(spark, sf_dir):
    at = F.col("ts_ms")
    return tx_sparse(spark, sf_dir).select(
        "tx_id", text.hour_start_ms(at).alias("hour_ms"), text.utc_date(at).alias("date"), text.year_month(at).alias("yyyymm")
    )


query("a16_approximate_distinct")(lambda spark, sf_dir: distinct_merchants(tx_dense(spark, sf_dir)))


@query("a16_within_bound", f"WITH {DENSE} SELECT card_id, true AS counted_close, true AS merged_close FROM tx GROUP BY 1")
def a16_within_bound(spark, sf_dir):
    """Estimates lie within a tenth of the exact count, or within one."""
    rows = tx_dense(spark, sf_dir).withColumn("hour_ms", text.hour_start_ms(F.col("ts_ms")))
    exact = rows.groupBy("card_id").agg(F.count_distinct("merchant_id").alias("exact"))
    counted = distinct_merchants(rows).withColumnRenamed("merchants", "counted")
    merged = merge_sketches(merchant_sketches(rows, ["card_id", "hour_ms"]), ["card_id"]).withColumnRenamed("merchants", "merged")
    close = lambda name: F.abs(F.col(name) - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.1)
    joined = exact.join(counted, "card_id").join(merged, "card_id")
    return joined.select("card_id", close("counted").alias("counted_close"), close("merged").alias("merged_close"))


@query("a16_merged_sketches")
def a16_merged_sketches(spark, sf_dir):
    """Sketches per card and day, merged per card."""
    rows = tx_sparse(spark, sf_dir).withColumn("date", text.utc_date(F.col("ts_ms")))
    return merge_sketches(merchant_sketches(rows, ["card_id", "date"]), ["card_id"])


@query("card_features_redelivered", on_features(f"SELECT {_ALL} FROM feat"))
def card_features_redelivered(spark, sf_dir):
    """Every transaction sent twice, some three times: copies are dropped before the features."""
    rows = tx_dense(spark, sf_dir)
    sent = rows.unionByName(rows).unionByName(rows.filter(F.col("tx_id") % 3 == 0))
    return card_features(drop_redelivered(sent)).select(*_ALL.split(", "))
