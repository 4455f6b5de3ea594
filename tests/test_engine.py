"""The engine's operators against the documented cases and their edges."""

import random
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.testing import assertDataFrameEqual

from funnelworks.functions.dates import lookback_bounds, snap_weekday, validate_date
from funnelworks.operators.features import PAID, PAID_COUNT, PAID_SUM, SAW_COUNT, TAP, TAP_COUNT, add_features, create_windows, join_dataframes, last_n_dates
from funnelworks.operators.ingest import as_dataframe, ingest_historical_data, ingest_incremental_data, to_date_column
from funnelworks.operators.lookback import load_lookback, load_lookbacks
from funnelworks.operators.standardize import cast_columns, drop_columns, flatten_struct, preprocess_df, rename_columns
from funnelworks.params import FeatureParams, IngestParams, JoinParams, LookbackParams, StandardizeParams

ACCOUNTS = "account string, opened date, seen string, balance double"


@pytest.fixture
def accounts(spark):
    rows = [("x", date(2019, 3, 4), "2021-05-30", 1.5), ("y", date(2020, 7, 1), "2021-05-31", -2.0), ("z", date(2018, 9, 9), "2021-04-02", 0.0), ("w", None, "2021-05-01", 7.25)]
    return spark.createDataFrame(rows, ACCOUNTS)


def ids(df, column="account"):
    return sorted(r[column] for r in df.collect())


SEEN = {"col_to_filter_by": "seen"}


def test_historical_range_includes_both_ends(accounts):
    out = ingest_historical_data(accounts, SEEN | {"start_dt": "2021-05-01", "end_dt": "2021-05-30"})
    assert ids(out) == ["w", "x"]
    assert dict(out.dtypes)["seen"] == "date"


@pytest.mark.parametrize("extra", [{}, {"start_dt": "2021-05-31"}, {"end_dt": "2021-01-01"}, {"start_dt": "2021-05-31", "end_dt": "None"}, {"start_dt": None, "end_dt": None}])
def test_range_needs_both_bounds(accounts, extra):
    assert len(ids(ingest_historical_data(accounts, SEEN | extra))) == 4


def test_range_takes_dates(accounts):
    assert ids(ingest_historical_data(accounts, SEEN | {"start_dt": date(2021, 4, 2), "end_dt": date(2021, 4, 2)})) == ["z"]


def test_incremental_is_strictly_later(spark, accounts):
    existing = spark.createDataFrame([(date(2021, 5, 1),), (date(2020, 1, 1),), (None,)], "seen date")
    assert ids(ingest_incremental_data(accounts, SEEN, existing)) == ["x", "y"]


@pytest.mark.parametrize("kind", ["date", "string"])
def test_incremental_into_nothing_takes_all(spark, accounts, kind):
    for rows in ([], [(None,)]):
        assert len(ids(ingest_incremental_data(accounts, SEEN, spark.createDataFrame(rows, f"seen {kind}")))) == 4


def test_incremental_over_text_and_pandas(accounts, spark):
    existing = pd.DataFrame({"seen": ["2021-05-30"]})
    assert ids(ingest_incremental_data(accounts.drop("opened").toPandas(), SEEN, existing, spark)) == ["y"]


def test_historical_and_incremental_split_the_table(spark):
    rng = random.Random(3)
    rows = [(i, f"2024-01-{rng.randint(1, 30):02d}") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, d string")
    first = ingest_historical_data(df, {"col_to_filter_by": "d", "start_dt": "2024-01-01", "end_dt": "2024-01-15"})
    rest = ingest_incremental_data(df, {"col_to_filter_by": "d"}, first)
    last = max(r["d"] for r in first.collect())
    assert ids(first, "id") == sorted(i for i, d in rows if d <= "2024-01-15")
    assert ids(rest, "id") == sorted(i for i, d in rows if d > str(last))


def test_timestamps_lose_their_time_and_null_dates_are_in_no_range(spark):
    df = spark.createDataFrame([(1, datetime(2022, 1, 1, 23, 59)), (2, datetime(2022, 1, 2)), (3, None)], "id int, t timestamp")
    out = ingest_historical_data(df, {"col_to_filter_by": "t", "start_dt": "2022-01-01", "end_dt": "2022-01-01"})
    assert [(r["id"], r["t"]) for r in out.collect()] == [(1, date(2022, 1, 1))]


def test_bad_dates_are_null_or_fail(spark):
    df = spark.createDataFrame([("2022-01-01",), ("nonsense",)], "d string")
    assert sorted((r["d"] for r in to_date_column(df, "d").collect()), key=str) == [date(2022, 1, 1), None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        to_date_column(df, "d", on_error="fail").collect()
    with pytest.raises(KeyError):
        to_date_column(df, "x")


@pytest.mark.parametrize("bad", [[], 5, "abc", None])
def test_only_tables_are_ingested(spark, bad):
    with pytest.raises(ValueError):
        as_dataframe(bad, spark)


def test_ingest_parameters(caplog):
    with caplog.at_level("INFO"):
        assert IngestParams.from_dict({"col_to_filter_by": "d", "other": 1}) == IngestParams("d")
    assert "Unrecognized parameters: ['other']" in caplog.text and "Unspecified parameters: ['end_dt', 'start_dt']" in caplog.text
    for bad in ({}, {"other": 1}, {"start_dt": "2022-01-01"}):
        with pytest.raises(ValueError):
            IngestParams.from_dict(bad)


def test_validate_date():
    assert validate_date(["1999-12-31", "2000-02-29"]) is None
    assert validate_date("2022-1-5") is None
    assert validate_date(("2022-01-01", "2022-01-01")) is None
    for bad in (["today", "1999-12-31"], ["2000-02-29", "1999-12-31"], "2022-02-30", "2022-01-01 ", 5, None, {"a": 1}):
        with pytest.raises(ValueError):
            validate_date(bad)


def test_flatten_struct(spark):
    df = spark.createDataFrame([(1, (2, "a"), 3), (4, None, 5)], "x int, s struct<p:bigint,v:string>, y int")
    out = flatten_struct(df, "s")
    assert out.columns == ["x", "y", "p", "v"]
    assert sorted(map(tuple, out.collect())) == [(1, 3, 2, "a"), (4, 5, None, None)]
    for bad in ("x", "missing"):
        with pytest.raises(ValueError):
            flatten_struct(df, bad)
    with pytest.raises(ValueError):
        flatten_struct(df.withColumn("p", F.lit(1)), "s")


def test_casts_drops_renames(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "a string")
    assert sorted((r["a"] for r in cast_columns(df, {"a": "int"}).collect()), key=str) == [1, None, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|cannot be cast"):
        cast_columns(df, {"a": "int"}, "fail").collect()
    with pytest.raises(ValueError):
        cast_columns(df, {"b": "int"})
    assert drop_columns(df, ["zz"]).columns == ["a"]
    two = spark.createDataFrame([(1, 2)], "a int, b int")
    assert rename_columns(two.drop("b"), {"a": "b", "b": "c"}).columns == ["c"]
    with pytest.raises(ValueError):
        rename_columns(two, {"a": "b"})


def test_preprocess_order_and_schema(spark):
    df = spark.createDataFrame([("2020-11-01", ("3", "x"), 7)], "day string, event_data struct<position:string,value_prop:string>, user_id bigint")
    out, tracked = preprocess_df(df, {"explode_column": "event_data", "columns_to_cast": {"position": "int", "user_id": "int", "day": "date"}, "columns_to_drop": ["nothing"], "columns_to_rename": {"day": "date"}, "date_col": "date"})
    assert tracked == {"columns": {"date": "date", "user_id": "int", "position": "int", "value_prop": "string", "date_partition": "date"}}
    assert list(tracked["columns"]) == out.columns
    with pytest.raises(ValueError):
        StandardizeParams.from_dict({})


def test_lookback_bounds_and_rows(spark):
    assert lookback_bounds(date(2020, 11, 30), 7) == (date(2020, 11, 2), date(2020, 11, 29))
    assert lookback_bounds(date(2020, 11, 30)) == (date(2020, 11, 9), date(2020, 11, 29))
    days = [date(2020, 11, 30), date(2020, 11, 29), date(2020, 11, 2), date(2020, 11, 1), None]
    df = spark.createDataFrame([(d, d) for d in days], "date date, date_partition date")
    assert sorted(r["date"] for r in load_lookback(df, {"date_col": "date", "last_n_days": 7}).collect()) == [date(2020, 11, 2), date(2020, 11, 29)]
    assert load_lookback(df.limit(0), LookbackParams("date")).count() == 0
    assert load_lookback(df, LookbackParams("date", 0), anchor=date(2020, 12, 1)).count() == 2
    with pytest.raises(ValueError):
        LookbackParams.from_dict({})


def test_lookbacks_of_several_tables(spark):
    a = spark.createDataFrame([(date(2024, 3, d),) for d in range(1, 31)], "date date")
    b = a.selectExpr("date_sub(date, 40) AS pay_date")
    none = a.limit(0)
    given = [(a, {"date_col": "date", "last_n_days": 7}), (b, {"date_col": "pay_date", "last_n_days": 0}), (none, {"date_col": "date"})]
    for df, (table, p) in zip(load_lookbacks(*given), given, strict=True):
        assertDataFrameEqual(df, load_lookback(table, p))


def test_lookback_prunes_partitions(spark, tmp_path):
    df = spark.range(40).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date")).withColumn("date_partition", F.col("date"))
    df.write.partitionBy("date_partition").parquet(str(tmp_path / "t"))
    plan = load_lookback(spark.read.parquet(str(tmp_path / "t")), LookbackParams("date", 7))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date_partition" in plan


@pytest.fixture
def three(spark):
    d = date(2020, 11, 1)
    prints = spark.createDataFrame([(d, 1, "a", 10), (d, 2, "b", 11), (d, None, "c", None), (None, 4, "a", 12)], "date date, position int, value_prop string, user_id int")
    taps = spark.createDataFrame([(d, 1, "a", 10), (d, 9, "a", 10), (d, 5, "z", 99)], "date date, position int, value_prop string, user_id int")
    pays = spark.createDataFrame([(d, 5.0, 10, "a"), (d, float("nan"), 11, "b"), (d, 7.0, 12, "q")], "pay_date date, total double, user_id int, value_prop string")
    return prints, taps, pays


def test_join_flags_fans_out_and_fills(three):
    out = sorted((tuple(r) for r in join_dataframes(*three).collect()), key=str)
    d = date(2020, 11, 1)
    assert out == sorted([(d, 1, "a", 10, 1, 5.0)] * 2 + [(d, 2, "b", 11, 0, 0.0), (d, 0, "c", 0, 0, 0.0), (None, 4, "a", 12, 0, 0.0)], key=str)


def test_join_kinds(three):
    counts = {how: join_dataframes(*three, JoinParams(how=how)).count() for how in ("inner", "left", "right", "full")}
    # inner: both taps of user 10 are paid; right: those, and two payments alone; full: all prints, the tap and payment alone.
    assert counts == {"inner": 2, "left": 5, "right": 4, "full": 7}
    for how in ("left_semi", "left_anti", "nonsense"):
        with pytest.raises(ValueError):
            JoinParams(how=how)
    with pytest.raises(ValueError):
        JoinParams(print_keys=("date",))


@pytest.mark.parametrize(("alias", "how"), [("left_outer", "left"), ("LeftOuter", "left"), ("outer", "full"), ("full_outer", "full"), ("right_outer", "right"), ("cross", "inner")])
def test_names_of_joins(three, alias, how):
    assert JoinParams(how=alias).how == how
    assertDataFrameEqual(join_dataframes(*three, JoinParams(how=alias)), join_dataframes(*three, JoinParams(how=how)))


def test_columns_to_keep_of_each_table(caplog):
    tables = {f"{t}_df": {"cols_to_join": ["a"], "cols_to_keep": ["b", t]} for t in ("prints", "taps", "pays")}
    assert JoinParams.from_dict(tables | {"how": "outer", "keep": ["b", "c"]}).keep == ("b", "c", "prints")
    assert "cols_to_keep of taps_df has no effect" in caplog.text and "pays_df" in caplog.text


def test_join_takes_extra_columns_with_clashing_names(three):
    prints, taps, pays = three
    taps = taps.withColumn("total", F.lit(1)).withColumn("event", F.lit(1))
    out = join_dataframes(prints.withColumn("event", F.lit(2)).withColumn("total", F.lit(3)), taps, pays.withColumn("event", F.lit(3)).withColumn("date", F.lit(None).cast("date")), JoinParams(keep=("event",)))
    assert out.columns == ["date", "position", "value_prop", "user_id", "event", TAP, PAID]
    assert {r["event"] for r in out.collect()} == {2}


def test_windows_over_no_rows_and_over_some(spark):
    """Nothing before a row: no prints, and sums that are null and not 0."""
    rows = [(9, "p", date(2023, 5, 2), 0, 0.0), (9, "p", date(2023, 5, 9), 1, 4.5), (9, "p", date(2023, 6, 1), 1, 0.0), (9, "q", date(2023, 5, 30), 1, 3.0), (None, "p", date(2023, 5, 31), 0, 1.0)]
    df = spark.createDataFrame(rows, "user_id int, value_prop string, date date, customer_tap int, paid_by_customer double")
    out, tracked = create_windows(df, {"date_col": "date", "last_n_days": 30})
    assert out.columns == ["user_id", "value_prop", "date", TAP, PAID, SAW_COUNT, TAP_COUNT, PAID_SUM, PAID_COUNT] == list(tracked["columns"])
    got = {(r[0], r[1], r[2].day): tuple(r)[5:] for r in out.collect()}
    nothing = (0, None, None, None)
    # The second of May is 30 days before the last day; the row of the 9th has one before it, the last row two.
    assert got == {(9, "p", 2): nothing, (9, "p", 9): (1, 0, 0.0, 0), (9, "p", 1): (2, 1, 4.5, 1), (9, "q", 30): nothing, (None, "p", 31): nothing}
    same, _ = create_windows(df, {"date_col": "date", "last_n_days": 30}, source=df.select("date"))
    assertDataFrameEqual(same, out)


@pytest.mark.parametrize("frame", ["rows", "days"])
def test_windows_against_a_loop(spark, frame):
    rng = random.Random(5)
    rows = [(i, rng.randint(1, 3), rng.choice(["a", "b", None]), date.fromordinal(738000 + rng.randint(0, 60)), rng.randint(0, 1), rng.choice([0.0, 2.5])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, user_id int, value_prop string, date date, customer_tap int, paid_by_customer double")
    got = {r["id"]: (r[SAW_COUNT], r[TAP_COUNT], r[PAID_SUM], r[PAID_COUNT]) for r in add_features(df, FeatureParams("date", 0, ("id",), frame)).collect()}
    for r in rows:
        mine = sorted((x for x in rows if x[1:3] == r[1:3]), key=lambda x: (x[3], x[0]))
        before = mine[: mine.index(r)][-21:] if frame == "rows" else [x for x in mine if 1 <= (r[3] - x[3]).days <= 21]
        sums = (sum(x[4] for x in before), sum(x[5] for x in before), sum(x[5] > 0 for x in before)) if before else (None,) * 3
        assert got[r[0]] == (sum(x[2] is not None for x in before), *sums)


def test_one_shuffle_one_window(spark, three):
    plan = add_features(join_dataframes(*three), FeatureParams("date"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1


def test_last_dates(spark):
    df = spark.createDataFrame([(date(2022, 1, d),) for d in (1, 5, 6, 7)] + [(None,)], "date date")
    assert last_n_dates(df, "date", 2).count() == 3
    assert last_n_dates(df, "date").count() == 1
    assert last_n_dates(df.limit(0), "date", 3).count() == 0


def test_snap_weekday(spark):
    df = spark.createDataFrame([(date(2024, 5, 15),), (date(2024, 5, 19),), (date(2024, 5, 13),)], "d date")
    got = df.select(snap_weekday(F.col("d"), "Monday").alias("m"), snap_weekday(F.col("d"), "sunday", 1).alias("s"), snap_weekday(F.col("d"), "Friday", 1).alias("f")).collect()
    assert [tuple(r) for r in got] == [(date(2024, 5, 13), date(2024, 5, 12), date(2024, 5, 8)), (date(2024, 5, 13), date(2024, 5, 12), date(2024, 5, 12)), (date(2024, 5, 13), date(2024, 5, 12), date(2024, 5, 6))]


def test_fill_only_named_columns(three):
    out = join_dataframes(*three, JoinParams(fill=(PAID,)))
    assert out.where("user_id is null").count() == 1
    assertDataFrameEqual(out.where(f"{PAID} is null"), out.limit(0))
