"""Queries of the operators by event time, of existence joins, roll-ups, top rows and drifting fields, each with its SQL.

Streams are fed from the events table run by run, in the order of arrival below: some
events come twelve hours late, some twenty days, and some twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .operators.drift import found_fields, merged_fields, parse_fields
from .operators.existence import existence_join
from .operators.features import PAID, PAID_COUNT, PAID_SUM, SAW_COUNT, TAP, TAP_COUNT, add_features, join_dataframes
from .operators.incremental import advance
from .operators.rollups import ERROR, daily_sketches, from_sketches, rollup
from .operators.sessions import sessions, stream_sessions
from .operators.temporal import asof_join, interval_join
from .operators.top import top_k
from .params import FeatureParams, JoinParams
from .queries import _LOADED, _ROLES, _pre_mdt, _query, _rounded, _scratch, _standard
from .streaming.features import stream_features
from .streaming.late import dropped_as_late, each_once, rows_of_changed_days, within_watermark, write_by_day
from .testbed import table

# --- Existence joins ---------------------------------------------------------------------------------------------------

_EXISTS = """EXISTS (SELECT 1 FROM t WHERE t.date = p.date AND t.user_id = p.user_id AND t.value_prop = p.value_prop)"""
_PAID_TOO = """EXISTS (SELECT 1 FROM y WHERE y.pay_date = p.date AND y.user_id = p.user_id AND y.value_prop = p.value_prop)"""
_PRINT = "p.date, p.position, p.value_prop, p.user_id, p.event_id"


@_query(f"WITH {_LOADED} SELECT {_PRINT} FROM p WHERE {_EXISTS} AND {_PAID_TOO}")
def join_semi(spark, sf_dir):
    return _pre_mdt(spark, sf_dir, "left_semi")


@_query(f"WITH {_LOADED} SELECT {_PRINT} FROM p WHERE NOT {_EXISTS} AND NOT {_PAID_TOO}")
def join_anti(spark, sf_dir):
    return _pre_mdt(spark, sf_dir, "left_anti")


@_query(f"WITH {_ROLES} SELECT DISTINCT user_id, value_prop FROM prints p WHERE NOT EXISTS (SELECT 1 FROM taps t WHERE t.user_id = p.user_id AND t.value_prop = p.value_prop)")
def saw_and_never_tapped(spark, sf_dir):
    prints, taps, _ = _standard(spark, sf_dir)
    return existence_join(prints.select("user_id", "value_prop").distinct(), taps, ["user_id", "value_prop"], "anti")


@_query(f"WITH {_ROLES} SELECT event_id FROM prints p WHERE EXISTS (SELECT 1 FROM taps t WHERE t.date = p.date AND t.user_id = p.user_id)")
def saw_and_tapped_that_day(spark, sf_dir):
    """The dates of one table bound the scan of the other."""
    prints, taps, _ = _standard(spark, sf_dir)
    return existence_join(prints, taps, ["date", "user_id"], "semi", prune_by="date").select("event_id")


@_query("SELECT c_custkey, c_nationkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS c_nationkey FROM customer) WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def customers_not_in_nations(spark, sf_dir):
    """NOT IN with nulls among the customers' nations, which are in no result."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.expr("nullif(c_nationkey, 3)").alias("c_nationkey"))
    return existence_join(customers, table(spark, sf_dir, "supplier").where("s_acctbal > 8000"), [("c_nationkey", "s_nationkey")], "anti", nulls="unknown")


@_query(f"""WITH {_ROLES} SELECT p.date, p.value_prop, count(*) AS n, CAST(sum(CASE WHEN t.date IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS n_tapped, CAST(sum(CASE WHEN y.total > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_paid, count(DISTINCT p.event_id) AS n_prints
FROM prints p LEFT JOIN taps t ON p.date = t.date AND p.user_id = t.user_id AND p.value_prop = t.value_prop LEFT JOIN pays y ON p.date = y.pay_date AND p.user_id = y.user_id AND p.value_prop = y.value_prop GROUP BY p.date, p.value_prop""")
def join_three_way_by_day(spark, sf_dir):
    """All days, not the look-back alone; n is above n_prints where a print has several taps or payments."""
    joined = join_dataframes(*_standard(spark, sf_dir), JoinParams(keep=("event_id",)))
    paid = F.sum(F.when(F.col(PAID) > 0, 1).otherwise(0))
    return joined.groupBy("date", "value_prop").agg(F.count(F.lit(1)).alias("n"), F.sum(TAP).alias("n_tapped"), paid.alias("n_paid"), F.count_distinct("event_id").alias("n_prints"))


# --- Late data ---------------------------------------------------------------------------------------------------------

_DELAY, _RUN_DAYS = "1 day", 10
_ARRIVALS = f"""
first AS (SELECT event_id, ts, user_id, event_type, value, ts + CASE WHEN event_id % 11 = 3 THEN INTERVAL 20 DAY WHEN event_id % 5 = 1 THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END AS came FROM events),
twice AS (SELECT * FROM first UNION ALL SELECT event_id, ts, user_id, event_type, value, came + INTERVAL 2 HOUR FROM first WHERE event_id % 6 = 0),
arrivals AS (SELECT *, (CAST(came AS DATE) - DATE '2024-01-01') // {_RUN_DAYS} AS run FROM twice),
marks AS (SELECT a.run, (SELECT max(date_trunc('millisecond', b.ts)) - INTERVAL 1 DAY FROM arrivals b WHERE b.run < a.run) AS mark FROM (SELECT DISTINCT run FROM arrivals) a),
taken AS (SELECT arrivals.* FROM arrivals JOIN marks ON marks.run = arrivals.run WHERE mark IS NULL OR ts > mark),
once AS (SELECT DISTINCT event_id, ts, user_id, event_type, value FROM taken)"""


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    late = F.when(F.col("event_id") % 11 == 3, F.expr("interval 20 days")).when(F.col("event_id") % 5 == 1, F.expr("interval 12 hours")).otherwise(F.expr("interval 0 hours"))
    first = events.withColumn("at", F.col("ts") + late)
    both = first.union(first.where("event_id % 6 = 0").withColumn("at", F.col("at") + F.expr("interval 2 hours")))
    return both.withColumn("run", F.floor(F.datediff("at", F.lit("2024-01-01").cast("date")) / _RUN_DAYS).cast("int")).drop("at")


def _fed(spark: SparkSession, rows: DataFrame, by: str, start: Callable[[DataFrame, str], StreamingQuery]) -> list[StreamingQuery]:
    """Run after run of ``rows`` (numbered by ``by``): its files are added to the source and the stream takes what is there.

    The queries that ran, each ended; between runs only the checkpoint lives on.
    """
    source, state = _scratch(spark, "source"), _scratch(spark, "checkpoint")
    numbers = sorted(r[by] for r in rows.select(by).distinct().collect())  # one for each run of the stream
    columns, ran = rows.drop(by), []
    for n in numbers:
        columns.where(rows[by] == n).write.mode("append").parquet(source)
        query = start(spark.readStream.schema(columns.schema).parquet(source), state)
        query.awaitTermination()
        ran.append(query)
    return ran


def _late_run(spark: SparkSession, sf_dir: str) -> tuple[str, list[StreamingQuery]]:
    target = _scratch(spark, "by-day")

    def start(stream: DataFrame, state: str) -> StreamingQuery:
        kept = each_once(stream, "ts", ["event_id"], _DELAY).withColumn("day", F.to_date("ts"))
        return write_by_day(kept, target, "day", state)

    return target, _fed(spark, _arrivals(spark, sf_dir), "run", start)


_KEPT = "event_id, ts, user_id, event_type, value, CAST(ts AS DATE) AS day"


@_query(f"WITH {_ARRIVALS} SELECT {_KEPT} FROM once")
def late_events_by_day(spark, sf_dir):
    """What the stream has taken, each event once and in the folder of its day, however late it came."""
    target, _ = _late_run(spark, sf_dir)
    return spark.read.parquet(target).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "day")


@_query(f"WITH {_ARRIVALS} SELECT {_KEPT} FROM once")
def late_events_batch_rule(spark, sf_dir):
    """The same rule in batch."""
    taken = within_watermark(_arrivals(spark, sf_dir), "run", "ts", _DELAY).drop("run").dropDuplicates(["event_id"])
    return taken.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.to_date("ts").alias("day"))


@_query(f"WITH {_ARRIVALS} SELECT (SELECT count(*) FROM arrivals) AS arrived, (SELECT count(*) FROM arrivals) - (SELECT count(*) FROM taken) AS dropped, (SELECT count(*) FROM once) AS kept")
def late_events_counted(spark, sf_dir):
    """Rows that came, that came behind the watermark (as the stream has counted them), and that are there."""
    target, ran = _late_run(spark, sf_dir)
    dropped = sum(dropped_as_late(q) for q in ran)
    return spark.read.parquet(target).agg(F.lit(_arrivals(spark, sf_dir).count()).cast("long").alias("arrived"), F.lit(dropped).cast("long").alias("dropped"), F.count(F.lit(1)).alias("kept"))


@_query(f"""WITH {_ARRIVALS}, latest AS (SELECT event_id, min(run) AS run FROM taken GROUP BY event_id),
days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM once JOIN latest USING (event_id) WHERE run > 0)
SELECT {_KEPT} FROM once WHERE CAST(ts AS DATE) IN (SELECT day FROM days)""")
def late_days_corrected(spark, sf_dir):
    """All rows of the days that changed after the first run: what dynamic overwrite then replaces."""
    target, ran = _late_run(spark, sf_dir)
    first = max(p.batchId for p in ran[0].recentProgress)
    again = rows_of_changed_days(spark, target, "day", first)
    return again.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "day")


# --- Features on a stream and day by day -------------------------------------------------------------------------------

_ACTS = """a AS (SELECT event_id, ts, user_id, 'vp_' || (CAST(props->>'$.k' AS INTEGER) % 5) AS value_prop, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS customer_tap, CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS paid_by_customer FROM events)"""
_ACT_FEATURES = f"""WITH {_ACTS} SELECT event_id, ts, user_id, value_prop, customer_tap, paid_by_customer,
  count(value_prop) OVER w AS {SAW_COUNT}, CAST(sum(customer_tap) OVER w AS BIGINT) AS {TAP_COUNT}, round(sum(paid_by_customer) OVER w, 4) AS {PAID_SUM}, CAST(sum(CASE WHEN paid_by_customer > 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS {PAID_COUNT}
FROM a WINDOW w AS (PARTITION BY user_id, value_prop ORDER BY ts, event_id ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)"""


def _acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as something that a user did with a proposition."""
    prop = F.concat(F.lit("vp_"), F.get_json_object("props", "$.k").cast("int") % 5)
    tap, paid = F.when(F.col("event_type") == "click", 1).otherwise(0), F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", prop.alias("value_prop"), tap.alias(TAP), paid.alias(PAID))


def _shown(features: DataFrame) -> DataFrame:
    return _rounded(features).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "value_prop", TAP, PAID, SAW_COUNT, TAP_COUNT, PAID_SUM, PAID_COUNT)


@_query(_ACT_FEATURES)
def features_of_acts(spark, sf_dir):
    return _shown(add_features(_acts(spark, sf_dir), FeatureParams("ts", 0, ("event_id",))))


@_query(_ACT_FEATURES)
def stream_features_in_order(spark, sf_dir):
    """The same on a stream, in two runs in which every seventh event comes six hours late, and one event at the end that lets all others pass."""
    target, acts = _scratch(spark, "features"), _acts(spark, sf_dir)
    arrives = F.col("ts") + F.when(F.col("event_id") % 7 == 0, F.expr("interval 6 hours")).otherwise(F.expr("interval 0 hours"))
    rows = acts.withColumn("run", (arrives >= "2024-01-16").cast("int"))
    end = acts.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("user_id"), *[F.lit(None).cast(t).alias(n) for n, t in acts.dtypes[3:]], F.lit(2).alias("run"))

    def start(stream: DataFrame, state: str) -> StreamingQuery:
        return stream_features(stream, "ts", "7 hours", ["event_id"]).writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()

    _fed(spark, rows.unionByName(end), "run", start)
    return _shown(spark.read.parquet(target).where("event_id >= 0"))


@_query(_ACT_FEATURES)
def incremental_features(spark, sf_dir):
    """The same in four steps of days; each reads its own days and the state that the step before has written."""
    acts, out, state, p = _acts(spark, sf_dir), _scratch(spark, "features"), None, FeatureParams("ts", 0, ("event_id",))
    for a, b in (("2024-01-01", "2024-01-09"), ("2024-01-09", "2024-01-10"), ("2024-01-10", "2024-01-22"), ("2024-01-22", "2025-01-01")):
        features, after = advance(state, acts.where((F.col("ts") >= a) & (F.col("ts") < b)), p)
        features.write.mode("append").parquet(out)
        kept = _scratch(spark, "state")
        after.write.parquet(kept)
        state = spark.read.schema(after.schema).parquet(kept)
    return _shown(spark.read.parquet(out))


# --- Joins by time and sessions ----------------------------------------------------------------------------------------

_LAST_PRINT = """SELECT y.event_id, y.user_id, y.ts, y.value, {columns} FROM (SELECT * FROM events WHERE event_type = 'purchase') y
LEFT JOIN LATERAL (SELECT event_id, ts FROM events v WHERE v.event_type = 'view' AND v.user_id = y.user_id AND v.ts < y.ts ORDER BY ts DESC, event_id DESC LIMIT 1) v ON true"""


def _of_kind(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("event_id", "user_id", "ts", "value")


def _last_print(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    prints = _of_kind(spark, sf_dir, "view").select(F.col("event_id").alias("print_id"), "user_id", F.col("ts").alias("print_ts"))
    return asof_join(_of_kind(spark, sf_dir, "purchase"), prints, ["user_id"], "ts", "print_ts", ["print_id", "print_ts"], ["print_id"], **more)


@_query(_LAST_PRINT.format(columns="v.event_id AS print_id, v.ts AS print_ts"))
def asof_last_print(spark, sf_dir):
    """Each payment with the user's last print before it."""
    return _last_print(spark, sf_dir)


@_query(_LAST_PRINT.format(columns="CASE WHEN y.ts - v.ts <= INTERVAL 12 HOUR THEN v.event_id END AS print_id, CASE WHEN y.ts - v.ts <= INTERVAL 12 HOUR THEN v.ts END AS print_ts"))
def asof_last_print_by_day(spark, sf_dir):
    """At most twelve hours before; a user's events are parted by day, and the last print is carried from day to day."""
    return _last_print(spark, sf_dir, tolerance=12 * 3600, bucket=86_400)


_AFTER = """SELECT v.event_id, v.user_id, v.ts, v.value, y.event_id AS pay_id, y.ts AS pay_ts FROM (SELECT * FROM events WHERE event_type = 'view') v
{how} JOIN (SELECT * FROM events WHERE event_type = 'purchase') y ON y.user_id = v.user_id AND y.ts BETWEEN v.ts AND v.ts + INTERVAL 3 DAY"""


def _pays_after(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    pays = _of_kind(spark, sf_dir, "purchase").select(F.col("event_id").alias("pay_id"), "user_id", F.col("ts").alias("pay_ts"))
    return interval_join(_of_kind(spark, sf_dir, "view"), pays, ["user_id"], "ts", "pay_ts", ["pay_id", "pay_ts"], 0, 3 * 86_400, **more)


@_query(_AFTER.format(how=""))
def interval_pays_after_print(spark, sf_dir):
    """Each print with the user's payments of the three days after it."""
    return _pays_after(spark, sf_dir)


@_query(_AFTER.format(how="LEFT"))
def interval_pays_after_print_left(spark, sf_dir):
    """Prints without a payment too; buckets of a day, hot users dealt out to four tasks."""
    return _pays_after(spark, sf_dir, how="left", width=86_400, salts=4)


_SESSIONS = """WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
SELECT user_id, min(ts) AS "start", max(ts) AS "end", count(*) AS n FROM n GROUP BY user_id, session"""
_GAP = 6 * 3600


@_query(_SESSIONS)
def sessions_of_users(spark, sf_dir):
    return sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", _GAP)


@_query(_SESSIONS)
def stream_sessions_of_users(spark, sf_dir):
    """The same on a stream, in two runs and one event at the end that lets all sessions pass."""
    target, events = _scratch(spark, "sessions"), table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    rows = events.withColumn("run", (F.col("ts") >= "2024-01-16").cast("int"))
    end = events.limit(1).select(F.lit(None).cast("long").alias("user_id"), F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit(2).alias("run"))

    def start(stream: DataFrame, state: str) -> StreamingQuery:
        return stream_sessions(stream, ["user_id"], "ts", _GAP, "1 hour").writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()

    _fed(spark, rows.union(end), "run", start)
    out = spark.read.parquet(target).where("user_id is not null")
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("start", "end")], "n")


# --- Roll-ups, top rows, drifting fields -------------------------------------------------------------------------------

_CUBED = """SELECT day, event_type, CAST(grouping(day) * 2 + grouping(event_type) AS BIGINT) AS level, count(*) AS n, count(DISTINCT user_id) AS users
FROM (SELECT CAST(ts AS DATE) AS day, event_type, user_id FROM events) GROUP BY CUBE (day, event_type)"""


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "event_type", "user_id")


@_query(_CUBED)
def rollup_users(spark, sf_dir):
    """Events and distinct users by day and kind, by each, and in all."""
    return rollup(_days(spark, sf_dir), ["day", "event_type"], "user_id")


@_query("SELECT event_type, count(*) AS n, true AS near FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY event_type")
def rollup_users_from_sketches(spark, sf_dir):
    """Users of sixteen days from the days' sketches: exact rows, and whether the estimate is within the stated error of the exact count."""
    days, kept = _days(spark, sf_dir), _scratch(spark, "sketches")
    daily_sketches(days, "day", ["event_type"], "user_id").write.partitionBy("day").parquet(kept)
    estimated = from_sketches(spark.read.parquet(kept), "day", ["event_type"], "2024-01-05", "2024-01-20")
    exact = days.where("day between '2024-01-05' and '2024-01-20'").groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    return estimated.join(exact, "event_type").select("event_type", "n", (F.abs(F.col("users") - F.col("exact")) <= F.col("exact") * ERROR + 0.5).alias("near"))


@_query("SELECT o_custkey, o_orderkey, o_totalprice, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_orders_of_customers(spark, sf_dir):
    return top_k(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 3)


@_query("SELECT l_returnflag, l_quantity, l_orderkey, l_linenumber, CAST(rank AS INTEGER) AS rank FROM (SELECT *, dense_rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_orderkey DESC) AS rank FROM lineitem) WHERE rank <= 5")
def top_lines_with_ties(spark, sf_dir):
    """Three hot groups: each task sends the first places of each."""
    return top_k(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_orderkey", "l_linenumber"), ["l_returnflag"], [F.col("l_quantity").desc(), F.col("l_orderkey").desc()], 5, "dense")


_DRIFTING = """CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{"k": ' || (props->>'$.k') || ', "v": ' || CAST(event_id % 100 AS VARCHAR) || '.5}' WHEN 2 THEN '{"k": "' || event_type || '", "w": null}' ELSE 'no json ' || event_id END"""


@_query("""SELECT event_id, CASE event_id % 4 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE CAST(props->>'$.k' AS BIGINT) END AS k,
  CASE event_id % 4 WHEN 1 THEN 'v=' || (event_id % 100) || '.5' WHEN 2 THEN 'k=' || event_type ELSE '' END AS rest, CASE event_id % 4 WHEN 3 THEN 'no json ' || event_id END AS bad FROM events""")
def json_unknown_fields_kept(spark, sf_dir):
    """Texts with other fields and types than those that are tracked (k, an integer): what does not fit is kept beside."""
    texts = _drifting(spark, sf_dir)
    out = parse_fields(texts, "props", {"k": "bigint"})
    rest = F.transform(F.array_sort(F.map_entries("_rest")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("event_id", "k", F.coalesce(F.array_join(rest, ","), F.lit("")).alias("rest"), F.col("_bad").alias("bad"))


def _drifting(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.get_json_object("props", "$.k"), F.col("event_id")
    texts = F.when(n % 4 == 0, F.col("props")).when(n % 4 == 1, F.concat(F.lit('{"k": '), k, F.lit(', "v": '), (n % 100).cast("string"), F.lit(".5}")))
    texts = texts.when(n % 4 == 2, F.concat(F.lit('{"k": "'), F.col("event_type"), F.lit('", "w": null}'))).otherwise(F.concat(F.lit("no json "), n.cast("string")))
    return table(spark, sf_dir, "events").select("event_id", texts.alias("props"))


@_query("""SELECT event_id, CASE event_id % 4 WHEN 2 THEN event_type WHEN 3 THEN NULL ELSE props->>'$.k' END AS k, CASE event_id % 4 WHEN 1 THEN CAST(event_id % 100 AS DOUBLE) + 0.5 END AS v, CASE event_id % 4 WHEN 3 THEN 'no json ' || event_id END AS bad FROM events""")
def json_fields_merged(spark, sf_dir):
    """The same with the fields that are found in all texts merged into the tracked ones: k becomes text, v a number, and nothing is left over."""
    texts = _drifting(spark, sf_dir)
    fields = merged_fields({"k": "bigint"}, found_fields(texts, "props"))
    out = parse_fields(texts, "props", fields)
    return out.where("_rest is null").select("event_id", "k", "v", F.col("_bad").alias("bad"))
