"""Queries of the engine's own operators over the driver's tables, each with the SQL that gives the same rows.

Rows of one day have no order of their own, so queries with row frames order them
by event_id as well; sums of doubles are rounded, as their order may differ.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import snap_weekday
from .operators.features import PAID, PAID_COUNT, PAID_SUM, SAW_COUNT, TAP, TAP_COUNT, add_features, create_windows, join_dataframes, last_n_dates
from .operators.ingest import ingest_historical_data, ingest_incremental_data, last_day, to_date_column
from .operators.lookback import load_lookback, load_lookbacks
from .operators.standardize import add_partition_column, cast_columns, drop_columns, flatten_struct, preprocess_df, rename_columns
from .params import FeatureParams, JoinParams
from .plans.defaults import CATALOG, PARAMETERS, merged
from .plans.pipeline import run
from .plans.registry import DEFAULT, register_pipelines
from .sources.catalog import Catalog, DatasetSpec
from .testbed import raw_pays, raw_prints, raw_taps, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(oracle: str | None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


# The roles of the events table, in SQL.
_ROLES = """
e AS (SELECT event_id, CAST(ts AS DATE) AS date, CAST(user_id AS INTEGER) AS user_id, event_type, value, CAST(props->>'$.k' AS INTEGER) AS k FROM events),
prints AS (SELECT event_id, date, user_id, k % 4 AS position, 'vp_' || (k % 5) AS value_prop FROM e WHERE event_type = 'view'),
taps AS (SELECT event_id, date, user_id, k % 4 AS position, 'vp_' || (k % 5) AS value_prop FROM e WHERE event_type = 'click'),
pays AS (SELECT date AS pay_date, value AS total, user_id, 'vp_' || (k % 5) AS value_prop FROM e WHERE event_type = 'purchase')"""
_LOADED = f"""{_ROLES},
p AS (SELECT * FROM prints WHERE date BETWEEN (SELECT max(date) FROM prints) - 28 AND (SELECT max(date) FROM prints) - 1),
t AS (SELECT * FROM taps WHERE date BETWEEN (SELECT max(date) FROM taps) - 28 AND (SELECT max(date) FROM taps) - 1),
y AS (SELECT * FROM pays WHERE pay_date BETWEEN (SELECT max(pay_date) FROM pays) - 28 AND (SELECT max(pay_date) FROM pays) - 1)"""


def _joined(how: str) -> str:
    return f"""{_LOADED},
tapped AS (SELECT p.date, p.position, p.value_prop, p.user_id, p.event_id, CASE WHEN t.date IS NULL THEN 0 ELSE 1 END AS customer_tap
  FROM p {how} JOIN t ON p.date = t.date AND p.user_id = t.user_id AND p.value_prop = t.value_prop),
pre_mdt AS (SELECT a.date, coalesce(a.position, 0) AS position, a.value_prop, coalesce(a.user_id, 0) AS user_id, coalesce(a.event_id, 0) AS event_id,
  coalesce(a.customer_tap, 0) AS customer_tap, coalesce(y.total, 0) AS paid_by_customer
  FROM tapped a {how} JOIN y ON a.date = y.pay_date AND a.user_id = y.user_id AND a.value_prop = y.value_prop)"""


_FEATURES = """
  count(value_prop) OVER w AS count_customer_saw_print_last_3_weeks,
  CAST(sum(customer_tap) OVER w AS BIGINT) AS count_customer_tap_print_last_3_weeks,
  round(sum(paid_by_customer) OVER w, 4) AS sum_customer_paid_last_3_weeks,
  CAST(sum(CASE WHEN paid_by_customer > 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS count_customer_paid_last_3_weeks"""
_WINDOW = "WINDOW w AS (PARTITION BY user_id, value_prop ORDER BY date, event_id, customer_tap, paid_by_customer ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)"
_TIES = ("event_id", TAP, PAID)
_MDT = f"""WITH {_joined("LEFT")},
f AS (SELECT *, {_FEATURES} FROM pre_mdt {_WINDOW})
SELECT * FROM f WHERE date BETWEEN (SELECT max(date) FROM f) - 6 AND (SELECT max(date) FROM f)"""


def _standard(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    raw = {"prints": raw_prints, "taps": raw_taps, "pays": raw_pays}
    return tuple(preprocess_df(ingest_historical_data(f(spark, sf_dir), PARAMETERS[f"raw_{t}"]), PARAMETERS[f"intermediate_{t}"])[0] for t, f in raw.items())


def _loaded(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return load_lookbacks(*[(df, PARAMETERS[f"primary_{t}"]) for df, t in zip(_standard(spark, sf_dir), ("prints", "taps", "pays"), strict=True)])


def _pre_mdt(spark: SparkSession, sf_dir: str, how: str = "left") -> DataFrame:
    return join_dataframes(*_loaded(spark, sf_dir), JoinParams(how=how, keep=("event_id",)))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn(PAID_SUM, F.round(PAID_SUM, 4)) if PAID_SUM in df.columns else df


def _scratch(spark: SparkSession, name: str) -> str:
    from uuid import uuid4

    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        from tempfile import mkdtemp

        where = mkdtemp(prefix="funnelworks-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/funnelworks/{name}-{uuid4().hex}"


@_query(_MDT)
def mdt_flagship(spark, sf_dir):
    prints, taps, pays = _loaded(spark, sf_dir)
    joined = join_dataframes(prints, taps, pays, JoinParams(how="left", keep=("event_id",)))
    return _rounded(create_windows(joined, FeatureParams("date", 6, _TIES), source=prints)[0])


_ORDERS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority FROM orders"


@_query(f"SELECT {_ORDERS}")
def ingest_hist_full(spark, sf_dir):
    return ingest_historical_data(table(spark, sf_dir, "orders"), {"col_to_filter_by": "o_orderdate"})


@_query(f"SELECT {_ORDERS} WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def ingest_hist_range(spark, sf_dir):
    return ingest_historical_data(table(spark, sf_dir, "orders"), {"col_to_filter_by": "o_orderdate", "start_dt": "1996-01-01", "end_dt": "1996-12-31"})


@_query(f"SELECT {_ORDERS}")
def ingest_hist_one_bound_is_noop(spark, sf_dir):
    return ingest_historical_data(table(spark, sf_dir, "orders"), {"col_to_filter_by": "o_orderdate", "start_dt": "1996-01-01", "end_dt": "None"})


_LATER = "SELECT event_id, CAST(ts AS DATE) AS ts, user_id, event_type, value, props FROM events WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events WHERE ts < TIMESTAMP '{}')"


@_query(_LATER.format("2024-01-20 00:00:00"))
def ingest_incremental(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return ingest_incremental_data(events, {"col_to_filter_by": "ts"}, events.where("ts < timestamp_ntz'2024-01-20 00:00:00'"))


@_query(_LATER.format("2024-01-20 12:00:00"))
def ingest_incremental_same_day_dropped(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return ingest_incremental_data(events, {"col_to_filter_by": "ts"}, events.where("ts < timestamp_ntz'2024-01-20 12:00:00'"))


@_query("SELECT event_id, CAST(ts AS DATE) AS ts FROM events")
def ingest_incremental_into_empty(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return ingest_incremental_data(events, {"col_to_filter_by": "ts"}, events.limit(0))


@_query("SELECT n_nationkey, n_name, DATE '2024-01-05' AS day FROM nation")
def ingest_from_pandas(spark, sf_dir):
    frame = table(spark, sf_dir, "nation").select("n_nationkey", "n_name").toPandas().assign(day="2024-01-05")  # 25 nations at any scale
    return ingest_historical_data(frame, {"col_to_filter_by": "day"}, spark)


@_query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def to_date_from_string(spark, sf_dir):
    return to_date_column(table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), "day")


@_query("SELECT event_id, CAST(ts AS DATE) AS ts FROM events")
def to_date_truncates_ts(spark, sf_dir):
    return to_date_column(table(spark, sf_dir, "events").select("event_id", "ts"), "ts")


@_query(f"WITH {_ROLES} SELECT strftime(date, '%Y-%m-%d') AS day, CAST(user_id AS BIGINT) AS user_id, event_id, CAST(position AS BIGINT) AS position, value_prop FROM prints")
def struct_flatten(spark, sf_dir):
    return flatten_struct(raw_prints(spark, sf_dir), "event_data")


@_query("SELECT event_id, CAST(user_id AS INTEGER) AS user_id, CAST(value AS VARCHAR) IS NULL AS no_value, TRY_CAST(event_type AS INTEGER) AS event_type FROM events")
def casts(spark, sf_dir):
    df = cast_columns(table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type"), {"user_id": "int", "event_type": "int", "value": "string"})
    return df.select("event_id", "user_id", F.isnull("value").alias("no_value"), "event_type")


@_query("SELECT p_partkey FROM part")
def drop_cols(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return drop_columns(df, [c for c in df.columns if c != "p_partkey"] + ["not_there"])


@_query("SELECT event_id AS id, user_id AS customer FROM events")
def rename_cols(spark, sf_dir):
    return rename_columns(table(spark, sf_dir, "events").select("event_id", "user_id"), {"event_id": "key", "key": "id", "user_id": "customer", "not_there": "x"})


@_query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, CAST(o_orderdate AS DATE) AS o_orderdate_partition FROM orders")
def partition_col(spark, sf_dir):
    return add_partition_column(to_date_column(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate"), "o_orderdate")


@_query(f"WITH {_ROLES} SELECT date, user_id, event_id, position, value_prop, date AS date_partition FROM prints")
def standardize_full(spark, sf_dir):
    return _standard(spark, sf_dir)[0]


@_query("SELECT * FROM (VALUES ('date', 'date'), ('user_id', 'int'), ('event_id', 'bigint'), ('position', 'int'), ('value_prop', 'string'), ('date_partition', 'date')) v(name, type)")
def schema_tracking(spark, sf_dir):
    columns = preprocess_df(ingest_historical_data(raw_prints(spark, sf_dir), PARAMETERS["raw_prints"]), PARAMETERS["intermediate_prints"])[1]
    return spark.createDataFrame(list(columns["columns"].items()), "name string, type string")


@_query("SELECT max(CAST(l_shipdate AS DATE)) AS last FROM lineitem")
def global_max_date(spark, sf_dir):
    return spark.createDataFrame([(last_day(table(spark, sf_dir, "lineitem"), "l_shipdate"),)], "last date")


_LINES = "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem) - {} AND (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem) - 1"


def _lines(spark, sf_dir):
    return to_date_column(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_shipdate")


@_query(_LINES.format(21))
def lookback_default(spark, sf_dir):
    return load_lookback(_lines(spark, sf_dir), {"date_col": "l_shipdate"})


@_query(_LINES.format(28))
def lookback_last_n_days(spark, sf_dir):
    return load_lookback(_lines(spark, sf_dir), {"date_col": "l_shipdate", "last_n_days": 7})


@_query(f"WITH {_LOADED} SELECT date, user_id, event_id, position, value_prop, date AS date_partition FROM p")
def lookback_on_partition_column(spark, sf_dir):
    return _loaded(spark, sf_dir)[0]


_PRE = "SELECT date, position, value_prop, user_id, event_id, customer_tap, paid_by_customer FROM pre_mdt"


@_query(f"WITH {_joined('LEFT')} {_PRE}")
def join_left_composite(spark, sf_dir):
    return _pre_mdt(spark, sf_dir)


@_query(f"WITH {_joined('INNER')} {_PRE}")
def join_inner(spark, sf_dir):
    return _pre_mdt(spark, sf_dir, "inner")


@_query(f"WITH {_joined('RIGHT')} {_PRE}")
def join_right(spark, sf_dir):
    return _pre_mdt(spark, sf_dir, "right")


@_query(f"WITH {_joined('FULL')} {_PRE}")
def join_full(spark, sf_dir):
    return _pre_mdt(spark, sf_dir, "full")


@_query(f"WITH {_ROLES}, j AS (SELECT p.event_id, y.total FROM prints p LEFT JOIN pays y ON p.date = y.pay_date AND p.user_id = y.user_id) SELECT event_id, count(*) AS n, count(total) AS n_paid FROM j GROUP BY event_id")
def join_renamed_keys(spark, sf_dir):
    prints, taps, pays = _standard(spark, sf_dir)
    none = taps.limit(0)
    out = join_dataframes(prints, none, pays, JoinParams(("date", "user_id"), ("date", "user_id"), ("pay_date", "user_id"), keep=("event_id",), fill=()))
    return out.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.count(PAID).alias("n_paid"))


@_query(f"WITH {_joined('LEFT')} SELECT value_prop, count(*) AS n, CAST(sum(customer_tap) AS BIGINT) AS n_tapped, CAST(sum(CASE WHEN paid_by_customer > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_paid FROM pre_mdt GROUP BY value_prop")
def join_three_way(spark, sf_dir):
    return _pre_mdt(spark, sf_dir).groupBy("value_prop").agg(F.count(F.lit(1)).alias("n"), F.sum(TAP).alias("n_tapped"), F.sum(F.when(F.col(PAID) > 0, 1).otherwise(0)).alias("n_paid"))


@_query(f"WITH {_ROLES} SELECT p.event_id, CASE WHEN t.date IS NULL THEN 0 ELSE 1 END AS customer_tap FROM prints p LEFT JOIN taps t ON p.date = t.date AND p.user_id = t.user_id AND p.value_prop = t.value_prop")
def match_flag(spark, sf_dir):
    prints, taps, pays = _standard(spark, sf_dir)
    return join_dataframes(prints, taps, pays.limit(0), JoinParams(keep=("event_id",))).select("event_id", TAP)


@_query(f"WITH {_ROLES}, j AS (SELECT p.event_id, y.total FROM prints p LEFT JOIN pays y ON p.date = y.pay_date AND p.user_id = y.user_id AND p.value_prop = y.value_prop) SELECT event_id, coalesce(total, 0) AS paid_by_customer FROM j")
def fillna_numeric_only(spark, sf_dir):
    prints, taps, pays = _standard(spark, sf_dir)
    return join_dataframes(prints, taps.limit(0), pays, JoinParams(keep=("event_id",))).select("event_id", PAID)


@_query(f"WITH {_joined('LEFT')} SELECT event_id, count(*) AS n FROM pre_mdt GROUP BY event_id HAVING count(*) > 1")
def join_fanout_counts(spark, sf_dir):
    return _pre_mdt(spark, sf_dir).groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(add_features(_pre_mdt(spark, sf_dir), FeatureParams("date", 0, _TIES)))


def _feature_sql(column: str) -> str:
    return f"WITH {_joined('LEFT')}, f AS (SELECT *, {_FEATURES} FROM pre_mdt {_WINDOW}) SELECT event_id, date, {column} FROM f"


@_query(_feature_sql(SAW_COUNT))
def window_count(spark, sf_dir):
    return _features(spark, sf_dir).select("event_id", "date", SAW_COUNT)


@_query(_feature_sql(TAP_COUNT))
def window_sum_int(spark, sf_dir):
    return _features(spark, sf_dir).select("event_id", "date", TAP_COUNT)


@_query(_feature_sql(PAID_SUM))
def window_sum_double(spark, sf_dir):
    return _features(spark, sf_dir).select("event_id", "date", PAID_SUM)


@_query(_feature_sql(PAID_COUNT))
def window_cond_sum(spark, sf_dir):
    return _features(spark, sf_dir).select("event_id", "date", PAID_COUNT)


_CUSTOMER = """WITH o AS (SELECT o_orderkey AS event_id, CAST(o_custkey AS BIGINT) AS user_id, o_orderpriority AS value_prop, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS customer_tap, o_totalprice AS paid_by_customer FROM orders)
SELECT event_id, {} FROM o {}"""


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("value_prop"), F.to_date("o_orderdate").alias("date"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias(TAP), F.col("o_totalprice").alias(PAID))


@_query(_CUSTOMER.format(_FEATURES, _WINDOW))
def window_over_orders(spark, sf_dir):
    return _rounded(add_features(_orders(spark, sf_dir), FeatureParams("date", 0, ("event_id",)))).select("event_id", SAW_COUNT, TAP_COUNT, PAID_SUM, PAID_COUNT)


@_query(_CUSTOMER.format(_FEATURES, "WINDOW w AS (PARTITION BY user_id, value_prop ORDER BY date RANGE BETWEEN INTERVAL 21 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING)"))
def window_day_frame(spark, sf_dir):
    return _rounded(add_features(_orders(spark, sf_dir), FeatureParams("date", frame="days"))).select("event_id", SAW_COUNT, TAP_COUNT, PAID_SUM, PAID_COUNT)


@_query("WITH " + _joined("LEFT") + f", f AS (SELECT *, {_FEATURES} FROM pre_mdt {_WINDOW}) SELECT event_id, {SAW_COUNT}, {TAP_COUNT}, {PAID_SUM}, {PAID_COUNT} FROM f WHERE {SAW_COUNT} = 0")
def window_first_row_null_vs_zero(spark, sf_dir):
    return _features(spark, sf_dir).where(F.col(SAW_COUNT) == 0).select("event_id", SAW_COUNT, TAP_COUNT, PAID_SUM, PAID_COUNT)


_LAST = "WITH {} SELECT event_id, date FROM prints WHERE date BETWEEN (SELECT max(date) FROM prints) - {} AND (SELECT max(date) FROM prints)"


@_query(_LAST.format(_ROLES, 6))
def last_n_dates_six(spark, sf_dir):
    return last_n_dates(_standard(spark, sf_dir)[0], "date", 6).select("event_id", "date")


@_query(_LAST.format(_ROLES, 0))
def last_n_zero(spark, sf_dir):
    return last_n_dates(_standard(spark, sf_dir)[0], "date").select("event_id", "date")


@_query("SELECT o_orderkey, CAST(date_trunc('week', CAST(o_orderdate AS DATE) - 14) AS DATE) AS day FROM orders")
def weekday_snap_monday(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", snap_weekday(F.to_date("o_orderdate"), "Monday", 2).alias("day"))


@_query("SELECT o_orderkey, CAST(date_trunc('week', CAST(o_orderdate AS DATE)) AS DATE) + 6 AS day FROM orders")
def weekday_snap_sunday(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", snap_weekday(F.to_date("o_orderdate"), "Sunday").alias("day"))


_STANDARD = f"WITH {_ROLES} SELECT date, user_id, event_id, position, value_prop, date AS date_partition FROM prints"


def _partitioned(spark: SparkSession) -> DatasetSpec:
    return DatasetSpec("parquet", _scratch(spark, "prints"), partition_by=("date_partition",))


@_query(_STANDARD)
def parquet_roundtrip_partitioned(spark, sf_dir):
    spec = _partitioned(spark)
    spec.write(_standard(spark, sf_dir)[0])
    return spec.read(spark).select("date", "user_id", "event_id", "position", "value_prop", "date_partition")


@_query(_STANDARD)
def dynamic_overwrite(spark, sf_dir):
    """The first half of the days, the second, and again one day: all of them stay."""
    spec, prints = _partitioned(spark), _standard(spark, sf_dir)[0]
    for part in ("date < '2024-01-15'", "date >= '2024-01-15'", "date = '2024-01-20'"):
        spec.write(prints.where(part))
    return spec.read(spark).select("date", "user_id", "event_id", "position", "value_prop", "date_partition")


@_query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_source(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    spec = DatasetSpec("csv", _scratch(spark, "customer"), {"header": True}, write_options={"header": True}, schema=customers.schema)
    spec.write(customers)
    return spec.read(spark)


@_query(f"WITH {_ROLES} SELECT strftime(date, '%Y-%m-%d') AS day, event_id, CAST(position AS BIGINT) AS position, value_prop, CAST(user_id AS BIGINT) AS user_id FROM prints")
def json_source(spark, sf_dir):
    spec = DatasetSpec("json", _scratch(spark, "prints"))
    spec.write(raw_prints(spark, sf_dir))
    return spec.read(spark).select("day", "event_id", "event_data.*", "user_id")


def _raw_files(spark: SparkSession, sf_dir: str) -> Catalog:
    catalog = Catalog(spark, CATALOG, root=_scratch(spark, "data"))
    raw_prints(spark, sf_dir).write.json(f"{catalog.root}/01_raw/prints.json")
    raw_taps(spark, sf_dir).write.json(f"{catalog.root}/01_raw/taps.json")
    raw_pays(spark, sf_dir).write.csv(f"{catalog.root}/01_raw/pays.csv", header=True)
    return catalog


_RUN = merged(PARAMETERS, {"primary_join_parameters": {"keep": ["event_id"]}, "primary_windows_parameters": {"tie_breakers": list(_TIES)}})


@_query(_MDT)
def pipeline_default_run(spark, sf_dir):
    """Raw files to modelling table by the named pipeline, with every table written and read again."""
    catalog = _raw_files(spark, sf_dir)
    run(register_pipelines()[DEFAULT], catalog, _RUN, threads=3)
    mdt = catalog.load("primary.mdt")
    names = json.loads(json.dumps(catalog.load("primary.mdt_columns")))["columns"]
    return _rounded(mdt.select(*names))


@_query(f"WITH {_ROLES} SELECT date, user_id, event_id, position, value_prop, date AS date_partition FROM prints")
def pipeline_incremental_run(spark, sf_dir):
    """The days to January 14 by the historical pipeline, the rest by the incremental one: together all of them."""
    catalog = _raw_files(spark, sf_dir)
    first = merged(_RUN, {f"raw_{t}": {"start_dt": "2024-01-01", "end_dt": "2024-01-14"} for t in ("prints", "taps", "pays")})
    pipelines = register_pipelines()
    run(pipelines["de_historical_pipeline"], catalog, first)
    run(pipelines["ingestion_incremental_pipeline"], catalog, _RUN)
    run(pipelines["intermediate_pipeline"], catalog, _RUN)
    return catalog.load("intermediate.prints").select("date", "user_id", "event_id", "position", "value_prop", "date_partition")


@_query(_STANDARD)
def stream_standardize(spark, sf_dir):
    """The raw files as a stream, standardised into the partitioned table."""
    from .streaming.standardize import standardized, write_partitioned

    raw = raw_prints(spark, sf_dir)
    source, target, state = (_scratch(spark, x) for x in ("raw", "table", "state"))
    raw.repartition(4).write.json(source)
    stream = spark.readStream.schema(raw.schema).json(source)
    write_partitioned(standardized(stream, PARAMETERS["raw_prints"], PARAMETERS["intermediate_prints"]), target, "date_partition", state).awaitTermination()
    return spark.read.parquet(target).select("date", "user_id", "event_id", "position", "value_prop", "date_partition")
