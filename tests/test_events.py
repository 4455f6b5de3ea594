"""Operators by event time, existence joins, roll-ups, top rows, drifting fields and pools against brute force and their plans."""

import json
import os
import random
import subprocess
import sys
import threading
from datetime import date, datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from funnelworks.operators.drift import found_fields, merged_fields, parse_fields
from funnelworks.operators.existence import existence_join
from funnelworks.operators.features import HISTORY, PAID, PAID_COUNT, PAID_SUM, SAW_COUNT, TAP, TAP_COUNT, add_features, join_dataframes
from funnelworks.operators.incremental import advance, tail
from funnelworks.operators.rollups import ERROR, daily_sketches, from_sketches, rollup
from funnelworks.operators.sessions import sessions, stream_sessions
from funnelworks.operators.temporal import asof_join, interval_join
from funnelworks.operators.top import top_k
from funnelworks.params import FeatureParams, JoinParams
from funnelworks.plans.pipeline import Node, Pipeline, run
from funnelworks.sources.catalog import Catalog
from funnelworks.streaming.features import stream_features
from funnelworks.streaming.late import changed_days, each_once, rows_of_changed_days, within_watermark, write_by_day

START = datetime(2024, 3, 1)
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def at(minutes):
    return None if minutes is None else START + timedelta(minutes=minutes)


# --- Pools -------------------------------------------------------------------------------------------------------------


def stages(spark):
    """Pool and time of each stage that ran, as Spark's own status store has them."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    found = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return [(s.schedulingPool(), s.submissionTime().get().getTime(), s.completionTime().get().getTime()) for s in (found.apply(i) for i in range(found.size())) if s.submissionTime().isDefined() and s.completionTime().isDefined()]


def test_nodes_that_run_together_have_pools_of_their_own(spark):
    both, seen = threading.Barrier(2, timeout=60), {}

    def slow(name):
        def job():
            both.wait()  # both nodes are in their functions
            seen[name] = spark.sparkContext.getLocalProperty("spark.scheduler.pool"), spark.sparkContext.getLocalProperty("spark.test.caller")
            return spark.range(2, numPartitions=2).select(F.expr("java_method('java.lang.Thread', 'sleep', 1500L)").alias("x"), "id").agg(F.count("x"), F.sum("id")).first()[1]

        return job

    pair = Pipeline([Node.of(slow("a"), [], "x", "node_a"), Node.of(slow("b"), [], "y", "node_b"), Node.of(lambda x, y: x + y, ["x", "y"], "z", "last")])
    catalog = Catalog(spark)
    spark.sparkContext.setLocalProperty("spark.test.caller", "me")
    run(pair, catalog, {}, threads=2)
    spark.sparkContext.setLocalProperty("spark.test.caller", None)
    assert catalog.load("z") == 2
    assert seen == {"a": ("node_a", "me"), "b": ("node_b", "me")}
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    ran = stages(spark)
    a, b = ([s for s in ran if s[0] == pool] for pool in ("node_a", "node_b"))
    assert a and b and any(max(x[1], y[1]) < min(x[2], y[2]) for x in a for y in b)


def test_session_settings_and_logging(tmp_path):
    """In a process of its own: the settings hold, FAIR pools exist as nodes run, and the log goes to its file."""
    code = f"""
import logging
from funnelworks.session import build_session, configure_logging
spark = build_session({{"spark.ui.enabled": "false"}}, master="local[2]", metadata_aggregates=True, object_store=True, hive=True)
from funnelworks.plans.pipeline import Node, Pipeline, run
from funnelworks.sources.catalog import Catalog
configure_logging("INFO", r"{tmp_path}/logs/run.log")
catalog = Catalog(spark)
run(Pipeline([Node.of(lambda: spark.range(3).count(), [], n, n) for n in ("one", "two")]), catalog, {{}}, threads=2)
sc = spark.sparkContext
pools = sc._jsc.sc().getAllPools()
print("RESULT", sc.getConf().get("spark.scheduler.mode"), sorted(pools.apply(i).name() for i in range(pools.size())), spark.conf.get("spark.sql.parquet.aggregatePushdown"),
      sc.getConf().get("spark.hadoop.fs.s3a.impl"), sc.getConf().get("spark.sql.catalogImplementation"), spark.conf.get("spark.sql.sources.partitionOverwriteMode"), sep="|")
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    line = next(x for x in out.stdout.splitlines() if x.startswith("RESULT"))
    assert line == "RESULT|FAIR|['default', 'one', 'two']|true|org.apache.hadoop.fs.s3a.S3AFileSystem|hive|dynamic", out.stderr
    assert "one: " in (tmp_path / "logs" / "run.log").read_text()


# --- Existence joins ---------------------------------------------------------------------------------------------------

LEFT = [(1, "a"), (1, "a"), (2, "b"), (None, "a"), (3, None), (None, None), (4, "c")]


@pytest.fixture
def two(spark):
    left = spark.createDataFrame([(k, n, i) for i, (k, n) in enumerate(LEFT)], "k int, n string, i int")
    right = spark.createDataFrame([(1, "a"), (1, "a"), (1, "z"), (3, None), (None, None), (4, "x")], "q int, n string")
    return left, right


def test_existence_of_several_keys_and_nulls(two):
    left, right = two
    keys = [("k", "q"), "n"]
    ids = lambda **x: sorted(r["i"] for r in existence_join(left, right, keys, **x).collect())
    assert ids() == [0, 1] and ids(how="anti") == [2, 3, 4, 5, 6]
    assert ids(nulls="equal") == [0, 1, 4, 5] and ids(how="anti", nulls="equal") == [2, 3, 6]
    out = existence_join(left, right, keys)
    assert out.columns == ["k", "n", "i"]


def test_not_in_has_the_nulls_of_sql(spark, two):
    left, right = two
    for df, name in ((left, "a"), (right, "b"), (right.where("q is not null"), "c"), (right.limit(0), "d")):
        df.createOrReplaceTempView(f"existence_{name}")
    for other in "bcd":
        for how, words in (("anti", "NOT IN"), ("semi", "IN")):
            got = existence_join(left, spark.table(f"existence_{other}"), [("k", "q")], how, nulls="unknown")
            assert rows(got) == rows(spark.sql(f"SELECT * FROM existence_a WHERE k {words} (SELECT q FROM existence_{other})"))
            assert "NestedLoop" not in plan_of(got)


def test_existence_prunes_and_sends_keys_once(spark, tmp_path):
    days = [date(2024, 1, d) for d in range(1, 21)]
    spark.createDataFrame([(d, i) for d in days for i in range(5)], "d date, i int").write.partitionBy("d").parquet(f"{tmp_path}/left")
    left = spark.read.parquet(f"{tmp_path}/left")
    right = spark.createDataFrame([(days[4], 1)] * 50 + [(days[6], 2), (days[6], None)], "d date, i int")
    out = existence_join(left, right, ["d", "i"], prune_by="d")
    assert rows(out) == [(1, days[4]), (2, days[6])]
    assert "d#" in plan_of(out) and "2024-01-05" in plan_of(out).split("PartitionFilters")[1]
    kept = existence_join(left, right, ["d", "i"], "anti", prune_by="d")
    assert kept.count() == 98
    assert existence_join(left, right.limit(0), ["d", "i"], prune_by="d").count() == 0
    assert existence_join(left, right.limit(0), ["d", "i"], "anti", prune_by="d").count() == 100


def test_existence_refuses(two):
    for wrong in ({"how": "left"}, {"nulls": "odd"}, {"keys": []}, {"keys": [("k", "q"), "n"], "nulls": "unknown"}, {"prune_by": "n"}, {"prune_by": ("k", "q"), "nulls": "equal"}):
        with pytest.raises(ValueError):
            existence_join(*two, **({"keys": [("k", "q")]} | wrong))


@pytest.mark.parametrize("how", ["semi", "left_semi", "LeftAnti", "anti"])
def test_join_of_three_by_existence(spark, how):
    d = date(2024, 1, 1)
    prints = spark.createDataFrame([(d, None, "a", 1, "x"), (d, 2, "a", 1, "y"), (d, 1, "b", 1, "z"), (d, 1, "c", 2, "w"), (None, 1, "a", 1, "v")], "date date, position int, value_prop string, user_id int, extra string")
    taps = spark.createDataFrame([(d, "a", 1), (d, "a", 1), (d, "b", 1)], "date date, value_prop string, user_id int")
    pays = spark.createDataFrame([(d, "a", 1, 5.0), (d, "c", 2, 1.0)], "pay_date date, value_prop string, user_id int, total double")
    out = join_dataframes(prints, taps, pays, JoinParams(how=how, keep=("extra",)))
    assert out.columns == ["date", "position", "value_prop", "user_id", "extra"]
    assert sorted(r["extra"] for r in out.collect()) == (["x", "y"] if "semi" in how.lower() else ["v"])
    assert {r["position"] for r in out.collect()} <= {0, 1, 2}


# --- Late data and streams ---------------------------------------------------------------------------------------------

EVENTS = "id long, ts timestamp, user long"


def fed(spark, tmp_path, batches, schema, start):
    """Each batch is a run of the stream of its own."""
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/source")
        query = start(spark.readStream.schema(schema).parquet(f"{tmp_path}/source"))
        query.awaitTermination()


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    def start(stream):
        return write_by_day(each_once(stream, "ts", ["id"], "2 days").withColumn("day", F.to_date("ts")), f"{tmp_path}/out", "day", f"{tmp_path}/state")

    first = [(i, START + timedelta(hours=i), i % 3) for i in range(48)]
    fed(spark, tmp_path, [first], EVENTS, start)
    late = [(100, START + timedelta(hours=3), 1), (5, START + timedelta(hours=5), 2), (101, START + timedelta(hours=60), 1)]
    fed(spark, tmp_path, [late], EVENTS, start)
    before = rows(spark.read.parquet(f"{tmp_path}/out"))
    assert sorted(r[0] for r in before) == [*range(48), 100, 101]
    # As if the driver had been lost after the write and before the commit.
    commits = sorted((p for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in commits[1:]:
        p.unlink()
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    start(spark.readStream.schema(EVENTS).parquet(f"{tmp_path}/source")).awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == before
    assert sorted(r["day"].day for r in changed_days(spark, f"{tmp_path}/out", "day", 0).collect()) == [1, 3]
    again = rows_of_changed_days(spark, f"{tmp_path}/out", "day", 0)
    assert again.count() == 26 and "arrived" not in again.columns  # a day of 24, its late one, and the new one
    assert rows_of_changed_days(spark, f"{tmp_path}/out", "day", 99).count() == 0


def test_watermark_rule_in_batch(spark):
    data = [(1, at(0), 0), (2, at(100), 0), (3, at(30), 1), (4, at(41), 1), (5, at(40), 1), (6, None, 1), (7, at(-500), 0)]
    out = within_watermark(spark.createDataFrame(data, "id int, ts timestamp, run int"), "run", "ts", "60 minutes")
    assert sorted(r["id"] for r in out.collect()) == [1, 2, 4, 7]


ACTS = f"id long, ts timestamp, user_id int, value_prop string, {TAP} int, {PAID} double"


def acts(rng, n):
    return [(i, at(rng.randrange(10_000)), rng.choice([1, 1, 1, 2, None]), rng.choice(["a", "a", "b", None]), rng.randint(0, 1), rng.choice([0.0, 0.0, 2.5, 1.25, None])) for i in range(n)]


FEATURES = ["id", SAW_COUNT, TAP_COUNT, PAID_SUM, PAID_COUNT]


def test_stream_features_equal_the_batch(spark, tmp_path):
    """Events of two days come in three runs, up to a day late, in any order in a run."""
    rng = random.Random(8)
    data = acts(rng, 400)
    runs = [[], [], []]
    for r in data:
        runs[min(2, int((r[1] - START).total_seconds() // 60 + rng.choice([0, 0, 1200])) // 4000)].append(r)
    flush = [(-1, datetime(2030, 1, 1), None, None, 0, 0.0)]

    def start(stream):
        out = stream_features(stream, "ts", "1 day", ["id"])
        return out.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()

    fed(spark, tmp_path, [*runs, flush], ACTS, start)
    got = spark.read.parquet(f"{tmp_path}/out").where("id >= 0").select(*FEATURES)
    want = add_features(spark.createDataFrame(data, ACTS), FeatureParams("ts", 0, ("id",))).select(*FEATURES)
    assert got.dtypes == want.dtypes
    assert rows(got) == rows(want)


def test_stream_features_hold_many_keys_in_few_states(spark, tmp_path):
    """The states are as many as the parts, whatever number of users; large and missing whole numbers stay what they are."""
    rng, ran, long_ids = random.Random(12), [], ACTS.replace("user_id int", "user_id long")
    data = [(None if i % 50 == 7 else 2**60 + i, at(rng.randrange(10_000)), rng.choice([2**60 + 2 * rng.randrange(150) + 1, None]), "a", rng.choice([0, 1, None]), rng.choice([2.5, None])) for i in range(600)]

    def start(stream):
        out = stream_features(stream, "ts", "1 day", ["id", TAP, PAID], parts=4)
        ran.append(out.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
        return ran[-1]

    fed(spark, tmp_path, [data, [(-1, datetime(2030, 1, 1), None, None, 0, 0.0)]], long_ids, start)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in ran[0].recentProgress) == 4
    # What was passed by the watermark of the second run is there, as the batch has it.
    got = spark.read.parquet(f"{tmp_path}/out").where("id is null or id >= 0").select(*FEATURES)
    want = add_features(spark.createDataFrame(data, long_ids), FeatureParams("ts", 0, ("id", TAP, PAID))).select(*FEATURES)
    assert rows(got) == rows(want)


def test_incremental_features_equal_a_full_run(spark, tmp_path):
    data = sorted(acts(random.Random(9), 500), key=lambda r: r[1])
    p, state, got = FeatureParams("ts", 0, ("id",)), None, []
    for k, (a, b) in enumerate(((0, 200), (200, 200), (200, 230), (230, 500))):
        features, after = advance(state, spark.createDataFrame(data[a:b], ACTS), p)
        got += rows(features.select(*FEATURES))
        after.write.parquet(f"{tmp_path}/{k}")
        state = spark.read.parquet(f"{tmp_path}/{k}")
        assert state.groupBy("user_id", "value_prop").count().agg(F.max("count")).first()[0] <= HISTORY
    full = spark.createDataFrame(data, ACTS)
    assert sorted(got, key=repr) == rows(add_features(full, p).select(*FEATURES))
    assert rows(state) == rows(tail(full, p))
    with pytest.raises(ValueError):
        advance(state, full, FeatureParams("ts", frame="days"))


def test_incremental_features_read_the_state_and_the_new_day_alone(spark, tmp_path):
    data = spark.createDataFrame(acts(random.Random(10), 300), ACTS).withColumn("day", F.to_date("ts"))
    data.write.partitionBy("day").parquet(f"{tmp_path}/history")
    history, p = spark.read.parquet(f"{tmp_path}/history"), FeatureParams("ts", 0, ("id",))
    advance(None, history.where("day < '2024-03-07'").drop("day"), p)[1].write.parquet(f"{tmp_path}/state")
    features, _ = advance(spark.read.parquet(f"{tmp_path}/state"), history.where("day = '2024-03-07'").drop("day"), p)
    scans = [x for x in plan_of(features).splitlines() if "FileScan" in x]
    assert all("/state" in x or ("2024-03-07" in x or "19789" in x) for x in scans)
    assert "WindowGroupLimit" in plan_of(tail(history, p))


# --- Joins by time -----------------------------------------------------------------------------------------------------

LEFTS, RIGHTS = "i int, k string, t timestamp", "j int, k string, s timestamp"


def timed(rng, n):
    keys = ["a"] * 6 + ["b", "c", None]  # one key has most
    return [(i, rng.choice(keys), at(rng.choice([None, *[rng.randrange(5000)] * 12]))) for i in range(n)]


@pytest.mark.parametrize("bucket", [None, 3600, 86_400, 10**9])
@pytest.mark.parametrize("strict", [True, False])
def test_asof_join_is_the_last_before(spark, bucket, strict):
    rng = random.Random(5)
    lefts, rights = timed(rng, 300), timed(rng, 150)
    rights += [(1000 + j, k, s) for j, k, s in rights[:40]]  # ties
    lefts += [(500 + j, k, s) for j, k, s in rights[:40]]  # at the same time

    def last(k, t, most):
        found = [(s, j) for j, q, s in rights if None not in (k, t, s) and q == k and (s < t or (s == t and not strict))]
        s, j = max(found, default=(None, None))
        return (j, s) if s is not None and (most is None or (t - s).total_seconds() <= most) else (None, None)

    a, b = spark.createDataFrame(lefts, LEFTS), spark.createDataFrame(rights, RIGHTS)
    for most in (None, 7200):
        out = asof_join(a, b, ["k"], "t", "s", ["j", "s"], ["j"], strict, most, bucket)
        assert out.columns == ["i", "k", "t", "j", "s"]
        assert rows(out) == sorted([(i, k, t, *last(k, t, most)) for i, k, t in lefts], key=repr)
        assert "NestedLoop" not in plan_of(out) and "Cartesian" not in plan_of(out) and "MergeJoin" not in plan_of(out)
    if bucket is None:
        assert plan_of(asof_join(a, b, ["k"], "t", "s", ["j"])).count("Exchange") == 1  # not run yet: the one plan
    assert asof_join(a.limit(0), b, ["k"], "t", "s", ["j"], bucket=bucket).count() == 0
    assert asof_join(a, b.limit(0), ["k"], "t", "s", ["j"], bucket=bucket).where("j is null").count() == len(lefts)
    with pytest.raises(ValueError):
        asof_join(a, b, ["k"], "t", "s", ["k"])


@pytest.mark.parametrize(("lower", "upper", "width", "salts"), [(0, 7200, None, 1), (-3600, 60, 500, 3), (600, 600, None, 2), (3600, 10_000, 86_400, 1), (-90, -30, 45, 1)])
def test_interval_join_is_all_pairs_within(spark, lower, upper, width, salts):
    rng = random.Random(6)
    lefts, rights = timed(rng, 250), timed(rng, 120)
    lefts += lefts[:30]
    rights += [(2000 + j, k, s + timedelta(seconds=-lower)) for j, k, s in lefts[:20] if s]  # exactly at the ends
    a, b = spark.createDataFrame(lefts, LEFTS), spark.createDataFrame(rights, RIGHTS)
    pairs = [[(i, k, t, j, s) for j, q, s in rights if None not in (k, t, s) and q == k and lower <= (s - t).total_seconds() <= upper] for i, k, t in lefts]
    out = interval_join(a, b, ["k"], "t", "s", ["j", "s"], lower, upper, width=width, salts=salts)
    assert rows(out) == sorted([p for found in pairs for p in found], key=repr)
    left = interval_join(a, b, ["k"], "t", "s", ["j", "s"], lower, upper, "left", width, salts)
    assert rows(left) == sorted([p for found, (i, k, t) in zip(pairs, lefts) for p in found or [(i, k, t, None, None)]], key=repr)
    assert "NestedLoop" not in plan_of(left) and "Cartesian" not in plan_of(left)


def test_interval_join_refuses(spark):
    a, b = spark.createDataFrame([], LEFTS), spark.createDataFrame([], RIGHTS)
    for wrong in ({"how": "full"}, {"lower": 5, "upper": 1}, {"columns": ["k"]}):
        with pytest.raises(ValueError):
            interval_join(a, b, ["k"], "t", "s", **({"columns": ["j"], "lower": 0, "upper": 1} | wrong))


# --- Sessions ----------------------------------------------------------------------------------------------------------


def plain_sessions(data, gap):
    out = []
    for key in {k for _, k, _ in data}:
        times = sorted(t for _, k, t in data if k == key and t is not None)
        for i, t in enumerate(times):
            if i and (t - times[i - 1]).total_seconds() <= gap:
                out[-1][2:] = [t, out[-1][3] + 1]
            else:
                out.append([key, t, t, 1])
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("bucket", [600, 86_400])
def test_sessions_by_gap(spark, bucket):
    data = timed(random.Random(7), 600)
    data += [(0, "edge", at(m)) for m in (0, 10, 20, 30.001, 40.001)] + [(0, "one", at(5)), (0, "one", at(5))]
    df = spark.createDataFrame(data, LEFTS)
    out = sessions(df, ["k"], "t", 600, bucket)
    assert out.columns == ["k", "start", "end", "n"]
    assert rows(out) == plain_sessions(data, 600)
    assert sessions(df.limit(0), ["k"], "t", 600).count() == 0


def test_sessions_of_a_stream_equal_the_batch(spark, tmp_path):
    data = [r for r in timed(random.Random(7), 300) if r[1] and r[2]] + [(0, "edge", at(m)) for m in (0, 10, 20, 30.001, 40.001)]
    flush = [(0, "end", datetime(2030, 1, 1))]

    def start(stream):
        out = stream_sessions(stream, ["k"], "t", 600, "1 hour")
        return out.writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()

    early = [r for r in data if r[2] < at(2000)]
    fed(spark, tmp_path, [early, [r for r in data if r not in early], flush], LEFTS, start)
    assert rows(spark.read.parquet(f"{tmp_path}/out").where("k <> 'end'")) == plain_sessions(data, 600)


# --- Roll-ups, top rows, drifting fields -------------------------------------------------------------------------------


def test_rollup_of_all_levels(spark):
    rng = random.Random(3)
    data = [(rng.choice(["x", "y", None]), rng.choice([1, 2]), rng.choice([None, *range(20)])) for _ in range(300)]
    out = rollup(spark.createDataFrame(data, "a string, b int, u int"), ["a", "b"], "u")
    want = []
    for level, dims in ((0, (0, 1)), (1, (0,)), (2, (1,)), (3, ())):
        for group in {tuple(r[d] for d in dims) for r in data}:
            mine = [r for r in data if tuple(r[d] for d in dims) == group]
            shown = dict(zip(dims, group))
            want.append((shown.get(0), shown.get(1), level, len(mine), len({r[2] for r in mine} - {None})))
    assert rows(out) == sorted(want, key=repr)
    two = rollup(spark.createDataFrame(data, "a string, b int, u int"), ["a", "b"], "u", [["b"], []])
    assert rows(two) == sorted([r for r in want if r[2] >= 2], key=repr)
    with pytest.raises(ValueError):
        rollup(two, ["a"], "users", [["q"]])


def test_sketches_of_days_unite(spark):
    data = spark.range(60_000).select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("d"), (F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(9000)).alias("u"))
    kept = daily_sketches(data, "d", ["g"], "u")
    assert kept.count() == 30
    for span in ((None, None), ("2024-01-02", "2024-01-05"), ("2024-01-09", None)):
        mine = data.where(F.lit(True) if span[0] is None else F.col("d") >= span[0]).where(F.lit(True) if span[1] is None else F.col("d") <= span[1])
        for dims in (["g"], []):
            exact = {tuple(r[d] for d in dims): (r["n"], r["x"]) for r in mine.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("x")).collect()}
            for r in from_sketches(kept, "d", dims, *span).collect():
                n, x = exact[tuple(r[d] for d in dims)]
                assert r["n"] == n and abs(r["users"] - x) <= ERROR * x


@pytest.mark.parametrize("ties", ["row", "rank", "dense"])
def test_top_k_limits_before_the_shuffle(spark, ties):
    rng = random.Random(2)
    data = [(rng.choice("aaab") if i % 9 else None, rng.randint(0, 8), i) for i in range(200)]
    df = spark.createDataFrame(data, "g string, x int, i int")
    order = [F.col("x").desc(), "i"] if ties == "row" else [F.col("x").desc()]
    out = top_k(df, ["g"], order, 4, ties)
    want = []
    for g in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == g), key=lambda r: (-r[1], r[2]))
        for n, r in enumerate(mine):
            place = {"row": n, "rank": sum(q[1] > r[1] for q in mine), "dense": len({q[1] for q in mine if q[1] > r[1]})}[ties] + 1
            want += [(*r, place)] * (place <= 4)
    assert rows(out) == sorted(want, key=repr)
    plan = plan_of(out)
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")  # read from the last step down
    assert "WindowGroupLimit" in plan
    of_all = top_k(df, [], order, 4, ties)
    assert {r["rank"] for r in of_all.collect()} <= {1, 2, 3, 4} and of_all.agg(F.max("x")).first()[0] == 8
    assert top_k(df, ["g"], order, 0, ties).count() == 0
    for wrong in ({"ties": "odd"}, {"name": "x"}):
        with pytest.raises(ValueError):
            top_k(df, ["g"], order, 1, **wrong)


def test_fields_that_drift_lose_nothing(spark):
    first = ['{"k": 1, "s": "a"}', '{"k": 2}', None]
    later = ['{"k": 2.5, "s": true, "new": [1, {"x": 2}]}', '{"k": null, "deep": {"y": 1}}', "[1, 2]", "7", "not json", "", '{"k": "text"}', '{"big": 123456789012345678901234567890}']
    frame = lambda texts: spark.createDataFrame(list(enumerate(texts)), "i int, props string")
    tracked = found_fields(frame(first), "props")
    assert tracked == {"k": "bigint", "s": "string"}
    # By the old fields all that is new is beside them.
    old = {r["i"]: r for r in parse_fields(frame(later), "props", tracked).collect()}
    assert old[0]["k"] is None and old[0]["s"] == "true" and old[0]["_rest"].keys() == {"k", "new"} and json.loads(old[0]["_rest"]["new"]) == [1, {"x": 2}]
    assert old[0]["_rest"]["k"] == "2.5" and old[1]["_rest"].keys() == {"deep"} and old[6]["_rest"] == {"k": "text"}
    assert [old[i]["_bad"] for i in (2, 3, 4, 5)] == ["[1, 2]", "7", "not json", ""] and old[0]["_bad"] is None
    merged = merged_fields(tracked, found_fields(frame(later[:2]), "props"))
    assert merged == {"k": "double", "s": "string", "deep": "string", "new": "string"}
    both = {r["i"]: r for r in parse_fields(frame(later), "props", merged).collect()}
    assert both[0]["k"] == 2.5 and both[0]["_rest"] is None and json.loads(both[1]["deep"]) == {"y": 1}
    assert both[6]["_rest"] == {"k": "text"} and both[7]["_rest"].keys() == {"big"}
    nulls = {r["i"]: r for r in parse_fields(frame(first), "props", merged).collect()}
    assert (nulls[2]["k"], nulls[2]["_rest"], nulls[2]["_bad"]) == (None, None, None) and nulls[0]["k"] == 1.0
    assert found_fields(frame([None, "x", "[1]"]), "props") == {} == found_fields(frame([None]).limit(0), "props")
    assert parse_fields(frame(first), "props", {}).columns == ["i", "_rest", "_bad"]
    with pytest.raises(ValueError):
        parse_fields(frame(first), "props", {"i": "int"})


def test_a_filter_on_fields_parses_no_text_again(spark, tmp_path):
    spark.createDataFrame([(1, '{"k": 1}'), (2, "odd"), (3, '{"x": 1}'), (4, None)], "i int, props string").write.parquet(f"{tmp_path}/texts")
    out = parse_fields(spark.read.parquet(f"{tmp_path}/texts"), "props", {"k": "bigint"}).where("_rest is null")
    assert plan_of(out).count("from_json(") == 1
    assert rows(out.select("i", "k", "_bad")) == [(1, 1, None), (2, None, "odd"), (4, None, None)]


@pytest.mark.parametrize(("a", "b", "both"), [(a, b, {a, b}) for a, b in combinations(("bigint", "double", "boolean", "string", "void"), 2)])
def test_types_grow(a, b, both):
    want = (both - {"void"}).pop() if "void" in both else "double" if both == {"bigint", "double"} else "string"
    assert merged_fields({"f": a}, {"f": b}) == {"f": want} == merged_fields({"f": b}, {"f": a})
