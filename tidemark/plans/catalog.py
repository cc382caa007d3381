"""Named queries over the shared tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Analysis, Probe, Via
from tidemark.functions import times as T
from tidemark.operators import cells as C
from tidemark.operators import classify as K
from tidemark.operators import curves as V
from tidemark.operators import robust as R
from tidemark.operators.via import duplicated_keys
from tidemark.plans import measures as M
from tidemark.sources.tables import inventory

AS_OF = datetime(2001, 7, 15, 12)
VIA_AS_OF = datetime(2001, 6, 1)
CAP = 365

#: A month whose end is this many days old is mature in these queries, and so many of the last months stand aside.
CUTOFF, RECENT = 365, 3

ORDERS = Probe("orders", "orders", "load_time", event_time="event_time", source_insert_time="source_time", compare_event_time="raw_time", key_cols=("o_orderkey",), batch_col="batch", alt_col="o_orderstatus")
LINES = Probe("lines", "lineitem", "l_shipdate", event_time_via=Via("orders", (("l_orderkey", "o_orderkey"),), "o_orderdate"), key_cols=("l_orderkey", "l_linenumber"))
EVENTS = Probe("events", "events", "ts", event_time="ts", analysis=Analysis(freshness_bucket="hour"))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


#: Queries with columns of type date, which both sides give as text.
DATED = {
    "recommended_wait_backto": ("complete_back_to",),
    "volume_collapse": ("first_month", "last_month"),
} | dict.fromkeys(
    "month_lag_cells canonical_pass canonical_grouping_sets month_batch_cells via_join_cells extraction_bound completion_curves days_to_percentiles month_volumes volume_outliers volume_gaps still_filling runs_per_month batch_completion dual_cells dual_percentiles compare_mismatch parity_months small_count_suppression lag_week_heatmap reporting_window daily_arrivals".split(),
    ("event_month",),
)


def query(sql: str):
    """Register a query under its function's name, with the SQL for the same rows."""

    def add(f):
        dates = DATED.get(f.__name__, ())

        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in dates})

        QUERIES[f.__name__] = run
        text = ", ".join(f"CAST(CAST({c} AS DATE) AS VARCHAR) AS {c}" for c in dates)
        ORACLES[f.__name__] = f"SELECT * REPLACE ({text}) FROM ({sql})" if dates else sql
        return f

    return add


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with times by formula: the tables have no load time."""
    d = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    days = lambda n: F.make_dt_interval(n.cast("int"))
    event = F.when(k % 50 == 0, None).otherwise(F.col("o_orderdate").cast("timestamp_ntz"))
    source = F.when(k % 61 == 0, None).otherwise(F.col("o_orderdate").cast("timestamp_ntz") + days(k * 7919 % 30))
    load = F.when(k % 53 == 0, None).when(k % 97 == 0, F.col("o_orderdate").cast("timestamp_ntz") - days(F.lit(5))).when(k % 89 == 0, F.col("o_orderdate").cast("timestamp_ntz") + days(F.lit(500))).otherwise(F.col("o_orderdate").cast("timestamp_ntz") + days(k * 7919 % 45))
    raw = F.when(k % 12 == 0, F.col("o_orderdate").cast("timestamp_ntz") - days(F.lit(35))).otherwise(F.col("o_orderdate").cast("timestamp_ntz"))
    d = d.select("o_orderkey", "o_orderstatus", "o_orderpriority", event.alias("event_time"), source.alias("source_time"), load.alias("load_time"), raw.alias("raw_time"))
    batch = F.when(k % 71 == 0, None).otherwise(F.concat(F.date_format("load_time", "yyyy-MM"), F.lit("-"), F.substring("o_orderpriority", 1, 1)))
    return d.withColumn("batch", batch)


ORDERS_SQL = """
o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, k, event_time, source_time, load_time, raw_time,
        CASE WHEN k % 71 = 0 THEN NULL ELSE strftime(load_time, '%Y-%m') || '-' || substr(o_orderpriority, 1, 1) END AS batch
 FROM (SELECT *, o_orderkey AS k,
   CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate END AS event_time,
   CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE o_orderdate + to_days(CAST((o_orderkey * 7919) % 30 AS INTEGER)) END AS source_time,
   CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_orderdate - INTERVAL 5 DAY WHEN o_orderkey % 89 = 0 THEN o_orderdate + INTERVAL 500 DAY ELSE o_orderdate + to_days(CAST((o_orderkey * 7919) % 45 AS INTEGER)) END AS load_time,
   CASE WHEN o_orderkey % 12 = 0 THEN o_orderdate - INTERVAL 35 DAY ELSE o_orderdate END AS raw_time
  FROM orders)),
adm AS (SELECT * FROM o WHERE load_time <= TIMESTAMP '2001-07-15 12:00:00' OR load_time IS NULL),
lagged AS (SELECT *, date_diff('day', event_time, load_time) AS lag, event_time IS NOT NULL AND load_time IS NOT NULL AS both_there FROM adm),
st AS (SELECT *, CASE WHEN both_there THEN CAST(date_trunc('month', event_time) AS DATE) END AS event_month,
   CAST(CASE WHEN NOT both_there THEN NULL WHEN lag < -1 THEN -1 WHEN lag > 365 THEN 366 WHEN lag < 0 THEN 0 ELSE lag END AS INTEGER) AS lag_day,
   CASE WHEN both_there AND lag >= -1 THEN 1 ELSE 0 END AS eligible,
   CASE WHEN both_there AND lag < -1 THEN 1 ELSE 0 END AS excluded,
   CASE WHEN event_time IS NULL THEN 1 ELSE 0 END AS null_event,
   CASE WHEN event_time IS NOT NULL AND load_time IS NULL THEN 1 ELSE 0 END AS null_load,
   CASE WHEN both_there AND lag >= -1 AND lag < 0 THEN 1 ELSE 0 END AS clipped,
   CASE WHEN both_there AND lag > 365 THEN 1 ELSE 0 END AS overflow,
   CASE WHEN both_there AND lag >= -1 AND (raw_time IS NULL OR date_diff('day', raw_time, event_time) <> 0) THEN 1 ELSE 0 END AS mismatch,
   CAST(CAST(load_time AS DATE) AS TIMESTAMP) AS load_epoch, CASE WHEN load_time IS NOT NULL THEN batch END AS batch_id, o_orderstatus AS alt_value FROM lagged),
ml AS (SELECT event_month, lag_day, CAST(count(*) AS BIGINT) AS row_count, CAST(sum(eligible) AS BIGINT) AS n_eligible, CAST(sum(mismatch) AS BIGINT) AS n_mismatch FROM st WHERE event_month IS NOT NULL GROUP BY ALL),
cu AS (SELECT event_month, lag_day, row_count AS rows, sum(row_count) OVER (PARTITION BY event_month ORDER BY lag_day) / CAST(sum(row_count) OVER (PARTITION BY event_month) AS DOUBLE) AS cum_frac FROM ml WHERE lag_day >= 0),
pc AS (SELECT event_month, p AS pct, CAST(min(CASE WHEN cum_frac >= p / 100.0 AND lag_day <= 365 THEN lag_day END) AS INTEGER) AS days FROM cu, (VALUES (50), (90), (95), (99)) t(p) GROUP BY ALL),
mv AS (SELECT event_month, CAST(sum(row_count) AS BIGINT) AS volume FROM ml WHERE lag_day >= 0 GROUP BY ALL)
"""


def staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.staging(orders(spark, sf_dir), ORDERS, AS_OF)


def month_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of months and lags, kept: metrics that use them more than once read the table once. The calendar and the cap bound them."""
    staged = staging(spark, sf_dir).where("event_month is not null")
    return staged.groupBy("event_month", "lag_day").agg(F.count(F.lit(1)).alias("row_count"), C.total("is_eligible").alias("n_eligible"), C.total("is_compare_mismatch").alias("n_compare_mismatch")).persist()


def curves(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None) -> DataFrame:
    return V.cumulative(V.curve_cells(month_lag(spark, sf_dir) if cells is None else cells))


def percent_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.days_to_percent(curves(spark, sf_dir), CAP)


def volumes(spark: SparkSession, sf_dir: str, cells: DataFrame | None = None) -> DataFrame:
    return M.month_volumes(month_lag(spark, sf_dir) if cells is None else cells)


WITH = "WITH " + ORDERS_SQL
MATURE = "event_month + INTERVAL 1 MONTH <= TIMESTAMP '2001-07-15 12:00:00' - INTERVAL 365 DAY"
GLOBAL_SQL = "CAST(count(*) AS BIGINT) AS row_count, CAST(coalesce(sum(eligible), 0) AS BIGINT) AS n_eligible, CAST(coalesce(sum(null_event), 0) AS BIGINT) AS n_null_event_time, CAST(coalesce(sum(null_load), 0) AS BIGINT) AS n_null_load_time_only, CAST(coalesce(sum(excluded), 0) AS BIGINT) AS n_negative_lag_excluded, CAST(coalesce(sum(clipped), 0) AS BIGINT) AS n_negative_clipped, CAST(coalesce(sum(overflow), 0) AS BIGINT) AS n_overflow, CAST(coalesce(sum(mismatch), 0) AS BIGINT) AS n_compare_mismatch"
GLOBAL = ("row_count", "n_eligible", "n_null_event_time", "n_null_load_time_only", "n_negative_lag_excluded", "n_negative_clipped", "n_overflow", "n_compare_mismatch")


@query(WITH + "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(load_time) AS BIGINT) AS loaded, max(load_time) AS last_load FROM adm")
def asof_admission(spark, sf_dir):
    return K.admitted(orders(spark, sf_dir), "load_time", AS_OF).agg(F.count(F.lit(1)).alias("rows"), F.count("load_time").alias("loaded"), F.max("load_time").alias("last_load"))


@query(WITH + "SELECT eligible, excluded, null_event, null_load, clipped, overflow, CAST(count(*) AS BIGINT) AS rows FROM st GROUP BY ALL")
def classify_buckets(spark, sf_dir):
    flags = {"is_eligible": "eligible", "is_negative_lag_excluded": "excluded", "is_null_event_time": "null_event", "is_null_load_time_only": "null_load", "is_negative_clipped": "clipped", "is_overflow": "overflow"}
    return staging(spark, sf_dir).groupBy(*(F.col(a).alias(b) for a, b in flags.items())).agg(F.count(F.lit(1)).alias("rows"))


@query(WITH + "SELECT event_month, lag_day, row_count FROM ml")
def month_lag_cells(spark, sf_dir):
    return month_lag(spark, sf_dir).select("event_month", "lag_day", "row_count")


@query(WITH + f"""SELECT 7 AS grouping_id, event_month, lag_day, NULL::TIMESTAMP AS load_epoch, NULL::VARCHAR AS batch_id, NULL::VARCHAR AS alt_value, {GLOBAL_SQL} FROM st GROUP BY ALL
UNION ALL SELECT 27, NULL, NULL, load_epoch, NULL, NULL, {GLOBAL_SQL} FROM st GROUP BY ALL
UNION ALL SELECT 13, event_month, NULL, NULL, batch_id, NULL, {GLOBAL_SQL} FROM st GROUP BY ALL
UNION ALL SELECT 30, NULL, NULL, NULL, NULL, alt_value, {GLOBAL_SQL} FROM st GROUP BY ALL
UNION ALL SELECT 31, NULL, NULL, NULL, NULL, NULL, {GLOBAL_SQL} FROM st""")  # fmt: skip
def canonical_pass(spark, sf_dir):
    return C.canonical_pass(staging(spark, sf_dir), batch=True, alt=True).select("grouping_id", *C.WEIGHTS, *GLOBAL)


@query(WITH + f"""SELECT 7 AS grouping_id, event_month, lag_day, NULL::VARCHAR AS batch_id, {GLOBAL_SQL} FROM st WHERE event_month IS NOT NULL GROUP BY ALL
UNION ALL SELECT 13, event_month, NULL, batch_id, {GLOBAL_SQL} FROM st WHERE event_month IS NOT NULL GROUP BY ALL""")  # fmt: skip
def canonical_grouping_sets(spark, sf_dir):
    cells = C.result_cells(C.canonical_cells(staging(spark, sf_dir), batch=True))
    return cells.where(F.col("grouping_id").isin(C.MONTH_LAG, C.MONTH_BATCH)).select("grouping_id", "event_month", "lag_day", "batch_id", *GLOBAL)


@query(WITH + f"SELECT {GLOBAL_SQL} FROM st")
def global_row(spark, sf_dir):
    return C.global_row(staging(spark, sf_dir)).select(*GLOBAL)


@query(WITH + f"SELECT {GLOBAL_SQL} FROM st WHERE false")
def global_row_of_empty(spark, sf_dir):
    return C.global_row(staging(spark, sf_dir).where("false")).select(*GLOBAL)


@query(WITH + f"SELECT {GLOBAL_SQL} FROM st")
def derived_global_row(spark, sf_dir):
    return C.derived_global_row(C.canonical_cells(staging(spark, sf_dir))).select(*GLOBAL)


@query(WITH + "SELECT grouping_id, CAST(count(*) AS BIGINT) AS cells FROM (SELECT DISTINCT 7 AS grouping_id, event_month::VARCHAR a, lag_day::VARCHAR b FROM st UNION ALL SELECT DISTINCT 27, load_epoch::VARCHAR, NULL FROM st UNION ALL SELECT DISTINCT 13, event_month::VARCHAR, batch_id FROM st UNION ALL SELECT DISTINCT 30, alt_value, NULL FROM st) GROUP BY 1")
def cells_by_set(spark, sf_dir):
    return C.canonical_cells(staging(spark, sf_dir), batch=True, alt=True).groupBy("grouping_id").agg(F.count(F.lit(1)).alias("cells"))


@query(WITH + "SELECT load_epoch, CAST(count(*) AS BIGINT) AS row_count FROM st WHERE load_epoch IS NOT NULL GROUP BY 1")
def epoch_cells_day(spark, sf_dir):
    return C.result_cells(C.canonical_cells(staging(spark, sf_dir))).where(F.col("grouping_id") == C.EPOCH).select("load_epoch", "row_count")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS load_epoch, CAST(count(*) AS BIGINT) AS row_count FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def epoch_cells_hour(spark, sf_dir):
    base = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp_ntz").alias("ts"))
    staged = K.staging(base, EVENTS, datetime(2024, 1, 20))
    return C.result_cells(C.canonical_cells(staged)).where(F.col("grouping_id") == C.EPOCH).select("load_epoch", "row_count")


@query(WITH + "SELECT event_month, batch_id, CAST(count(*) AS BIGINT) AS row_count, min(load_time) AS min_load_time FROM st WHERE event_month IS NOT NULL GROUP BY 1, 2")
def month_batch_cells(spark, sf_dir):
    cells = C.result_cells(C.canonical_cells(staging(spark, sf_dir), batch=True))
    return cells.where(F.col("grouping_id") == C.MONTH_BATCH).select("event_month", "batch_id", "row_count", "min_load_time")


@query(WITH + "SELECT alt_value, CAST(count(*) AS BIGINT) AS row_count FROM st GROUP BY 1")
def alt_cells(spark, sf_dir):
    return C.canonical_cells(staging(spark, sf_dir), alt=True).where(F.col("grouping_id") == C.ALT).select("alt_value", "row_count")


@query("SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS distinct_keys, CAST(count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS BIGINT) AS duplicate_rows FROM lineitem")
def uniqueness_guard(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    out = d.agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct(K.key_of(["l_orderkey", "l_linenumber"])).alias("distinct_keys"))
    return out.withColumn("duplicate_rows", F.col("row_count") - F.col("distinct_keys"))


@query(WITH + "SELECT CAST(count(*) AS BIGINT) AS distinct_keys FROM (SELECT DISTINCT CASE WHEN k % 20 = 0 THEN NULL ELSE k % 4000 END AS a, o_orderstatus AS b FROM adm)")
def key_hash_distinct(spark, sf_dir):
    d = K.admitted(orders(spark, sf_dir), "load_time", AS_OF)
    d = d.select(F.when(F.col("o_orderkey") % 20 == 0, None).otherwise(F.col("o_orderkey") % 4000).alias("a"), F.col("o_orderstatus").alias("b"))
    return d.agg(F.countDistinct(K.key_hash(["a", "b"])).alias("distinct_keys"))


VIA_SQL = """WITH b AS (SELECT * FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01 00:00:00' OR l_shipdate IS NULL),
lk AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey % 10 <> 3),
j AS (SELECT b.*, lk.o_orderkey IS NOT NULL AS matched, lk.o_orderdate AS ev, date_diff('day', lk.o_orderdate, b.l_shipdate) AS lag FROM b LEFT JOIN lk ON b.l_orderkey = lk.o_orderkey),
s AS (SELECT *, matched AND ev IS NOT NULL AND l_shipdate IS NOT NULL AS both_there FROM j)
"""


def unmatched(lookup: DataFrame, where: str, part: int = 0) -> DataFrame:
    """All rows of the lookup; those of the condition get a key below zero, which no line has and no other part gives."""
    return lookup.withColumn("o_orderkey", F.when(F.expr(where), -2 * F.col("o_orderkey") - part).otherwise(F.col("o_orderkey")))


def lines_staging(spark, sf_dir, probe=LINES, every=True):
    lookup = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    lookup = unmatched(lookup, "o_orderkey % 10 = 3")
    base = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))
    return K.staging(base, probe, VIA_AS_OF, lookup, every)


@query(VIA_SQL + """SELECT CASE WHEN both_there THEN CAST(date_trunc('month', ev) AS DATE) END AS event_month, CAST(CASE WHEN NOT both_there THEN NULL WHEN lag < -1 THEN -1 WHEN lag > 365 THEN 366 WHEN lag < 0 THEN 0 ELSE lag END AS INTEGER) AS lag_day, CAST(count(*) AS BIGINT) AS row_count, CAST(sum(CASE WHEN NOT matched THEN 1 ELSE 0 END) AS BIGINT) AS n_join_unmatched FROM s GROUP BY 1, 2""")
def via_join_cells(spark, sf_dir):
    cells = C.canonical_cells(lines_staging(spark, sf_dir, every=False)).where(F.col("grouping_id") == C.MONTH_LAG)
    return cells.select("event_month", "lag_day", "row_count", "n_join_unmatched")


@query(VIA_SQL + "SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(sum(CASE WHEN NOT matched THEN 1 ELSE 0 END) AS BIGINT) AS n_join_unmatched, CAST((SELECT max(n) FROM (SELECT count(*) n FROM lk GROUP BY o_orderkey)) AS BIGINT) AS lookup_dup_max, CAST(0 AS BIGINT) AS n_ambiguous_rows FROM s")
def via_guard(spark, sf_dir):
    return C.global_row(lines_staging(spark, sf_dir)).select("row_count", "n_join_unmatched", "lookup_dup_max", "n_ambiguous_rows")


AMBIGUOUS_SQL = """WITH b AS (SELECT * FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-06-01 00:00:00' OR l_shipdate IS NULL),
lk AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderkey) AS dup FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0)),
j AS (SELECT lk.* FROM b LEFT JOIN lk ON b.l_orderkey = lk.o_orderkey)
SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(sum(CASE WHEN rn IS NULL OR rn = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_base_rows, CAST(sum(CASE WHEN rn = 1 AND dup > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_ambiguous_rows, CAST((SELECT max(dup) FROM lk) AS BIGINT) AS lookup_dup_max FROM j"""


@query(AMBIGUOUS_SQL)
def via_ambiguous(spark, sf_dir):
    every = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))
    lookup = unmatched(every, "o_orderkey % 10 = 3").union(unmatched(every, "o_orderkey % 7 <> 0", 1))
    base = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))
    return C.global_row(K.staging(base, LINES, VIA_AS_OF, lookup)).select("row_count", "n_base_rows", "n_ambiguous_rows", "lookup_dup_max")


@query("SELECT event_id, CAST(date_trunc('month', ts) AS DATE)::VARCHAR AS month, date_trunc('hour', ts)::TIMESTAMP AS hour, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, date_diff('day', TIMESTAMP '2024-01-01 12:00:00', ts) AS days, CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS DATE)::VARCHAR AS month_end, round(date_diff('microsecond', TIMESTAMP '2024-01-01 12:00:00', ts) / 86400000000.0, 6) AS elapsed FROM events")
def time_functions(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    start = T.timestamp(datetime(2024, 1, 1, 12))
    return d.select("event_id", T.month_floor(F.col("ts")).cast("string").alias("month"), T.time_bucket(F.col("ts"), "hour").alias("hour"), T.time_bucket(F.col("ts"), "day").alias("day"), T.day_difference(start, F.col("ts")).cast("long").alias("days"), T.month_end(T.month_floor(F.col("ts"))).cast("string").alias("month_end"), F.round(T.elapsed_days(start, F.col("ts")), 6).alias("elapsed"))


@query("SELECT table_name AS table_name, CAST(ordinal_position - 1 AS BIGINT) AS ordinal, column_name FROM information_schema.columns WHERE table_name IN ('orders', 'lineitem', 'events')")
def column_inventory(spark, sf_dir):
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "lineitem", "events")}
    return spark.createDataFrame([(r["table"], r["ordinal"], r["column"]) for r in inventory(tables)], "table_name string, ordinal long, column_name string")


@query("SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicated_lookup_keys(spark, sf_dir):
    return duplicated_keys(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), Via("lineitem", (("a", "l_orderkey"), ("b", "l_linenumber")), "l_shipdate"))


@query(WITH + "SELECT event_month, CAST(count(*) AS BIGINT) AS row_count FROM st WHERE event_time >= TIMESTAMP '1999-08-01 00:00:00' OR event_time IS NULL GROUP BY 1")
def extraction_bound(spark, sf_dir):
    probe = Probe("bounded", "orders", "load_time", event_time="event_time", analysis=Analysis(extraction_months=24))
    return K.staging(orders(spark, sf_dir), probe, AS_OF).groupBy("event_month").agg(F.count(F.lit(1)).alias("row_count"))


@query(WITH + "SELECT event_month, lag_day, rows, round(cum_frac, 9) AS cum_frac FROM cu")
def completion_curves(spark, sf_dir):
    return curves(spark, sf_dir).select("event_month", "lag_day", "rows", F.round("cum_frac", 9).alias("cum_frac"))


@query(WITH + "SELECT event_month, pct, days, days IS NULL AS over_cap FROM pc")
def days_to_percentiles(spark, sf_dir):
    return percent_days(spark, sf_dir)


def mature(df: DataFrame) -> DataFrame:
    return M.ended(df, AS_OF, CUTOFF)


@query(WITH + f"SELECT CASE WHEN bool_or(days IS NULL) THEN NULL ELSE CAST(ceil(avg(days) + 2 * stddev_pop(days)) AS BIGINT) END AS wait, CAST(count(*) AS BIGINT) AS months FROM pc WHERE pct = 95 AND {MATURE}")
def training_wait(spark, sf_dir):
    return M.training_wait(mature(percent_days(spark, sf_dir)))


@query(WITH + f", x AS (SELECT *, row_number() OVER (ORDER BY event_month) AS r, count(*) OVER () AS n FROM pc WHERE pct = 95 AND {MATURE}) SELECT CASE WHEN r <= n // 2 THEN 'older' ELSE 'younger' END AS half, CASE WHEN bool_or(days IS NULL) THEN NULL ELSE CAST(ceil(avg(days) + 2 * stddev_pop(days)) AS BIGINT) END AS wait, CAST(count(*) AS BIGINT) AS months FROM x GROUP BY 1")
def backtest_halves(spark, sf_dir):
    return M.backtest_halves(mature(percent_days(spark, sf_dir)))


@query(WITH + f"SELECT pct, CASE WHEN bool_or(days IS NULL) THEN NULL ELSE round(avg(days), 9) END AS mean, CASE WHEN bool_or(days IS NULL) THEN NULL ELSE round(stddev_pop(days), 9) END AS std FROM pc WHERE {MATURE} GROUP BY 1")
def percentile_summary(spark, sf_dir):
    out = R.percentile_summary(mature(percent_days(spark, sf_dir)), 6)
    return out.select("pct", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


GRID_SQL = ", gr AS (SELECT m.event_month, d.day, coalesce((SELECT max(cum_frac) FROM cu WHERE cu.event_month = m.event_month AND cu.lag_day <= d.day), 0.0) AS frac FROM (SELECT DISTINCT event_month FROM cu) m, (SELECT CAST(unnest(range(0, 61)) AS INTEGER) AS day) d)"


@query(WITH + GRID_SQL + f" SELECT day, round(median(frac), 9) AS frac FROM gr WHERE {MATURE} GROUP BY 1")
def f_mature(spark, sf_dir):
    return V.median_curve(V.on_grid(mature(curves(spark, sf_dir)), 60)).select("day", F.round("frac", 9).alias("frac"))


@query(WITH + GRID_SQL + f" SELECT day, round(quantile_cont(frac, 0.1), 9) AS p10, round(quantile_cont(frac, 0.5), 9) AS p50, round(quantile_cont(frac, 0.9), 9) AS p90 FROM gr WHERE {MATURE} GROUP BY 1")
def curve_bands(spark, sf_dir):
    return V.quantile_bands(V.on_grid(mature(curves(spark, sf_dir)), 60)).select("day", *(F.round(c, 9).alias(c) for c in ("p10", "p50", "p90")))


@query(WITH + f"SELECT CAST(ceil(avg(days) + 2 * stddev_pop(days)) AS BIGINT) AS wait, CAST(TIMESTAMP '2001-07-15 12:00:00' - to_days(CAST(ceil(avg(days) + 2 * stddev_pop(days)) AS INTEGER)) AS DATE) AS complete_back_to FROM pc WHERE pct = 90 AND {MATURE}")
def recommended_wait_backto(spark, sf_dir):
    return M.back_to(mature(percent_days(spark, sf_dir)).where("pct = 90"), AS_OF)


@query(WITH + f"SELECT event_month, volume, CASE WHEN event_month + INTERVAL 1 MONTH > TIMESTAMP '2001-07-15 12:00:00' THEN 'open' WHEN {MATURE} THEN 'mature' ELSE 'immature' END AS state FROM mv")
def month_volumes(spark, sf_dir):
    return M.with_state(volumes(spark, sf_dir), AS_OF, CUTOFF)


BASE_SQL = f""", bl AS (SELECT volume FROM (SELECT *, row_number() OVER (ORDER BY event_month DESC) AS r FROM mv) WHERE r > 3 AND {MATURE}),
md AS (SELECT median(volume) AS median FROM bl),
sg AS (SELECT (SELECT median FROM md) AS median, greatest(1.4826 * median(abs(volume - (SELECT median FROM md))), 0.05 * abs((SELECT median FROM md))) AS sigma, count(*) AS n FROM bl)"""


@query(WITH + BASE_SQL + " SELECT round(median, 6) AS median, round(sigma, 6) AS sigma, CAST(n AS BIGINT) AS n FROM sg")
def volume_baseline(spark, sf_dir):
    out = M.baseline(volumes(spark, sf_dir), AS_OF, CUTOFF, RECENT)
    return out.select(F.round("median", 6).alias("median"), F.round("sigma", 6).alias("sigma"), "n")


@query(WITH + BASE_SQL + f" SELECT event_month, volume, CASE WHEN abs(volume - median) > 3 * sigma THEN 'RED' WHEN abs(volume - median) > 2 * sigma THEN 'AMBER' ELSE 'GREEN' END AS severity FROM mv, sg WHERE {MATURE}")
def volume_outliers(spark, sf_dir):
    v = volumes(spark, sf_dir)
    return M.outliers(v, M.baseline(v, AS_OF, CUTOFF, RECENT), AS_OF, CUTOFF)


THIN = "month(event_month) NOT IN (3, 4)"


@query(WITH + f", t AS (SELECT event_month FROM mv WHERE {THIN}) SELECT CAST(m AS DATE) AS event_month FROM (SELECT unnest(generate_series((SELECT min(event_month) FROM t), (SELECT max(event_month) FROM t), INTERVAL 1 MONTH)) AS m) WHERE CAST(m AS DATE) NOT IN (SELECT event_month FROM t)")
def volume_gaps(spark, sf_dir):
    return M.gaps(volumes(spark, sf_dir).where("month(event_month) not in (3, 4)"))


COLLAPSE_SQL = WITH + f""", t AS (SELECT event_month, CASE WHEN event_month >= DATE '2000-01-01' OR event_month BETWEEN DATE '1997-02-01' AND DATE '1997-05-01' THEN 1 ELSE volume END AS volume FROM mv WHERE {MATURE}),
lw AS (SELECT event_month, year(event_month) * 12 + month(event_month) - row_number() OVER (ORDER BY event_month) AS island FROM t WHERE volume < 10)
SELECT min(event_month) AS first_month, max(event_month) AS last_month, CAST(count(*) AS BIGINT) AS months FROM lw GROUP BY island HAVING max(event_month) = (SELECT max(event_month) FROM t)"""


@query(COLLAPSE_SQL)
def volume_collapse(spark, sf_dir):
    low = (F.col("event_month") >= "2000-01-01") | F.col("event_month").between("1997-02-01", "1997-05-01")
    v = mature(volumes(spark, sf_dir)).withColumn("volume", F.when(low, 1).otherwise(F.col("volume")))
    return M.last_run_below(v, 10.0)


@query(WITH + GRID_SQL + BASE_SQL + f""", fm AS (SELECT day, median(frac) AS frac FROM gr WHERE {MATURE} GROUP BY 1),
im AS (SELECT *, CAST(floor(date_diff('second', event_month + INTERVAL 1 MONTH, TIMESTAMP '2001-07-15 12:00:00') / 86400.0) AS INTEGER) AS age FROM mv WHERE event_month + INTERVAL 1 MONTH <= TIMESTAMP '2001-07-15 12:00:00' AND NOT ({MATURE}))
SELECT event_month, volume, round((SELECT median FROM sg) * frac, 4) AS expected, round(volume / frac, 4) AS nowcast FROM im JOIN fm ON fm.day = least(im.age, 60)""")
def still_filling(spark, sf_dir):
    cells = month_lag(spark, sf_dir)
    v = volumes(spark, sf_dir, cells)
    curve = V.median_curve(V.on_grid(mature(curves(spark, sf_dir, cells)), 60))
    out = M.filling(v, curve, M.baseline(v, AS_OF, CUTOFF, RECENT), AS_OF, CUTOFF, 60)
    return out.select("event_month", "volume", F.round("expected", 4).alias("expected"), F.round("nowcast", 4).alias("nowcast"))


@query(WITH + ", e AS (SELECT DISTINCT load_epoch FROM st WHERE load_epoch IS NOT NULL), g AS (SELECT date_diff('second', lag(load_epoch) OVER (ORDER BY load_epoch), load_epoch) / 86400.0 AS gap FROM e), m AS (SELECT median(gap) AS cadence FROM g) SELECT (SELECT cadence FROM m) AS cadence, greatest(1.4826 * median(abs(gap - (SELECT cadence FROM m))), 1.0) AS sigma, round(date_diff('second', (SELECT max(load_epoch) FROM e), TIMESTAMP '2001-07-15 12:00:00') / 86400.0, 6) AS since, CAST(count(gap) + 1 AS BIGINT) AS epochs FROM g")
def freshness_cadence(spark, sf_dir):
    epochs = staging(spark, sf_dir).select("load_epoch").where("load_epoch is not null").distinct().persist()
    return M.cadence(epochs, "load_epoch", AS_OF)


@query(WITH + "SELECT batch_id, CAST(sum(eligible) AS BIGINT) AS rows, min(load_time) AS first_load FROM st WHERE batch_id IS NOT NULL GROUP BY 1")
def rows_per_run(spark, sf_dir):
    return M.batch_runs(C.canonical_cells(staging(spark, sf_dir), batch=True).where(F.col("grouping_id") == C.MONTH_BATCH))


@query(WITH + "SELECT event_month, CAST(count(DISTINCT batch_id) AS BIGINT) AS runs, CAST(sum(CASE WHEN batch_id IS NULL THEN eligible ELSE 0 END) AS BIGINT) AS null_batch_rows FROM st WHERE event_month IS NOT NULL GROUP BY 1")
def runs_per_month(spark, sf_dir):
    return M.runs_per_month(C.canonical_cells(staging(spark, sf_dir), batch=True).where(F.col("grouping_id") == C.MONTH_BATCH))


@query(WITH + """, bt AS (SELECT batch_id, min(load_time) AS ts FROM st WHERE batch_id IS NOT NULL GROUP BY 1),
bm AS (SELECT event_month, batch_id, sum(eligible) AS n FROM st WHERE event_month IS NOT NULL AND batch_id IS NOT NULL GROUP BY 1, 2 HAVING sum(eligible) > 0),
w AS (SELECT event_month, ts, sum(n) OVER (PARTITION BY event_month ORDER BY ts, batch_id) / CAST(volume AS DOUBLE) AS share FROM bm JOIN bt USING (batch_id) JOIN mv USING (event_month))
SELECT event_month, p AS pct, CAST(min(CASE WHEN share >= p / 100.0 THEN date_diff('day', event_month + INTERVAL 1 MONTH, CAST(ts AS DATE)) END) AS INTEGER) AS days FROM w, (VALUES (50), (90), (95), (99)) t(p) GROUP BY ALL""")
def batch_completion(spark, sf_dir):
    return M.batch_completion(C.canonical_cells(staging(spark, sf_dir), batch=True))


DUAL_SQL = WITH + """, du AS (SELECT *, date_diff('day', event_time, source_time) AS sl, event_time IS NOT NULL AND source_time IS NOT NULL AS two FROM adm),
ds AS (SELECT *, CASE WHEN two THEN CAST(date_trunc('month', event_time) AS DATE) END AS em, CAST(CASE WHEN NOT two THEN NULL WHEN sl < -1 THEN -1 WHEN sl > 365 THEN 366 WHEN sl < 0 THEN 0 ELSE sl END AS INTEGER) AS sld, CAST(date_diff('day', source_time, load_time) AS INTEGER) AS dd FROM du)
"""


def dual(spark, sf_dir):
    return K.dual_staging(orders(spark, sf_dir), ORDERS, AS_OF)


@query(DUAL_SQL + """SELECT 1 AS grouping_id, em AS event_month, sld AS src_lag_day, NULL::INTEGER AS delta_day, CAST(count(*) AS BIGINT) AS row_count FROM ds GROUP BY ALL
UNION ALL SELECT 6, NULL, NULL, dd, CAST(count(*) AS BIGINT) FROM ds GROUP BY ALL UNION ALL SELECT 7, NULL, NULL, NULL, CAST(count(*) AS BIGINT) FROM ds""")  # fmt: skip
def dual_cells(spark, sf_dir):
    return C.dual_pass(dual(spark, sf_dir)).select("grouping_id", *C.DUAL_WEIGHTS, "row_count")


@query(DUAL_SQL + "SELECT CAST(sum(CASE WHEN event_time IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null_event_time, CAST(sum(CASE WHEN event_time IS NOT NULL AND source_time IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null_source_only, CAST(sum(CASE WHEN two AND sl >= -1 THEN 1 ELSE 0 END) AS BIGINT) AS n_eligible FROM ds")
def dual_buckets(spark, sf_dir):
    return C.dual_global_row(dual(spark, sf_dir)).select("n_null_event_time", "n_null_source_only", "n_eligible")


@query(DUAL_SQL + ", c AS (SELECT em, sld, count(*) AS n FROM ds WHERE em IS NOT NULL AND sld >= 0 GROUP BY 1, 2), f AS (SELECT em, sld, sum(n) OVER (PARTITION BY em ORDER BY sld) / CAST(sum(n) OVER (PARTITION BY em) AS DOUBLE) AS cf FROM c) SELECT em AS event_month, p AS pct, CAST(min(CASE WHEN cf >= p / 100.0 AND sld <= 365 THEN sld END) AS INTEGER) AS days FROM f, (VALUES (50), (90), (95), (99)) t(p) GROUP BY ALL")
def dual_percentiles(spark, sf_dir):
    cells = C.dual_cells(dual(spark, sf_dir)).where(F.col("grouping_id") == C.DUAL_MONTH_LAG)
    return V.days_to_percent(V.cumulative(V.curve_cells(cells, "src_lag_day")), CAP).select("event_month", "pct", "days")


@query(DUAL_SQL + "SELECT dd AS delta_day, CAST(count(*) AS BIGINT) AS row_count FROM ds WHERE dd IS NOT NULL GROUP BY 1")
def delta_histogram(spark, sf_dir):
    return C.dual_result_cells(C.dual_cells(dual(spark, sf_dir))).where(F.col("grouping_id") == C.DUAL_DELTA).select("delta_day", "row_count")


@query(WITH + "SELECT event_month, CAST(sum(n_mismatch) AS BIGINT) AS mismatches FROM ml GROUP BY 1")
def compare_mismatch(spark, sf_dir):
    return month_lag(spark, sf_dir).groupBy("event_month").agg(F.sum("n_compare_mismatch").alias("mismatches"))


@query(WITH + f""", l AS (SELECT event_month, CAST(count(*) AS BIGINT) AS n FROM st WHERE event_month IS NOT NULL AND month(event_month) <> 2 AND {MATURE} GROUP BY 1), r AS (SELECT event_month, CAST(count(*) AS BIGINT) AS n FROM st WHERE event_month IS NOT NULL AND (k % 900 <> 1) AND year(event_month) <> 1996 AND {MATURE} GROUP BY 1)
SELECT event_month, l.n AS left_count, r.n AS right_count, coalesce(l.n, 0) - coalesce(r.n, 0) AS diff, CASE WHEN r.n IS NULL THEN 'left_only' WHEN l.n IS NULL THEN 'right_only' WHEN abs(l.n - r.n) <= 0 THEN 'match' ELSE 'mismatch' END AS verdict FROM l FULL OUTER JOIN r USING (event_month)""")
def parity_months(spark, sf_dir):
    d = orders(spark, sf_dir)
    probe = Probe("side", "orders", "load_time", event_time="event_time")
    left = M.month_counts(K.staging(d, probe, AS_OF)).where("month(event_month) <> 2")
    other = d.withColumn("event_time", F.when(F.col("o_orderkey") % 900 != 1, F.col("event_time")))  # without a month, not without the row
    right = M.month_counts(K.staging(other, probe, AS_OF)).where("year(event_month) <> 1996")
    return M.parity(mature(left), mature(right), 0)


@query(WITH + "SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(sum(eligible + excluded + null_event + null_load) AS BIGINT) AS classed, CAST(count(*) - sum(eligible + excluded + null_event + null_load) AS BIGINT) AS other FROM st")
def reconciliation(spark, sf_dir):
    return M.reconciliation(C.global_row(staging(spark, sf_dir)))


@query(WITH + "SELECT round(sum(excluded) / CAST(count(*) - sum(null_event) - sum(null_load) AS DOUBLE), 12) AS excess FROM st")
def negative_lag_excess(spark, sf_dir):
    return M.negative_excess(C.global_row(staging(spark, sf_dir))).select(F.round("excess", 12).alias("excess"))


@query(WITH + "SELECT event_month, lag_day, CASE WHEN abs(row_count) < 5 THEN NULL ELSE row_count END AS row_count FROM ml")
def small_count_suppression(spark, sf_dir):
    return M.suppress(month_lag(spark, sf_dir).select("event_month", "lag_day", "row_count"), ["row_count"])


@query(WITH + "SELECT event_month, CAST(lag_day // 7 AS INTEGER) AS lag_week, round(sum(rows) / CAST(sum(sum(rows)) OVER (PARTITION BY event_month) AS DOUBLE), 9) AS share FROM cu GROUP BY 1, 2")
def lag_week_heatmap(spark, sf_dir):
    out = V.lag_week_shares(curves(spark, sf_dir))
    return out.select("event_month", "lag_week", F.round("share", 9).alias("share"))


@query(WITH + "SELECT event_month, pct, days FROM pc WHERE event_month >= DATE '2000-01-01' AND event_month < DATE '2001-01-01'")
def reporting_window(spark, sf_dir):
    return M.in_window(percent_days(spark, sf_dir), "2000-01-01", "2001-01-01").select("event_month", "pct", "days")


@query(WITH + """SELECT coalesce(strftime(load_epoch, '%Y-%m'), 'none') AS probe, CASE WHEN max(excluded) = 1 THEN 'RED' WHEN max(overflow) = 1 THEN 'AMBER' WHEN max(null_event) = 1 THEN 'INDETERMINATE' WHEN max(null_load) = 1 THEN 'SKIPPED' ELSE 'GREEN' END AS severity FROM st GROUP BY 1""")
def worst_severity(spark, sf_dir):
    from tidemark.status import worst_by

    d = staging(spark, sf_dir)
    severity = F.when(F.col("is_negative_lag_excluded") == 1, "RED").when(F.col("is_overflow") == 1, "AMBER").when(F.col("is_null_event_time") == 1, "INDETERMINATE").when(F.col("is_null_load_time_only") == 1, "SKIPPED").otherwise("GREEN")
    return worst_by(d.select(F.coalesce(F.date_format("load_epoch", "yyyy-MM"), F.lit("none")).alias("probe"), severity.alias("severity")), "probe")


@query("SELECT date_trunc('day', ts)::DATE AS event_month, CAST(count(*) AS BIGINT) AS row_count, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY 1")
def daily_arrivals(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/events.parquet")
    return d.groupBy(F.col("ts").cast("date").alias("event_month")).agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("user_id").alias("users"))
