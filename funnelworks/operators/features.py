"""Impressions with their clicks and payments, and what each user did before."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import FeatureParams, JoinParams
from .existence import EXISTENCE, existence_join
from .ingest import last_day
from .standardize import schema_of

#: The columns of the modelling table.
TAP, PAID = "customer_tap", "paid_by_customer"
SAW_COUNT = "count_customer_saw_print_last_3_weeks"
TAP_COUNT = "count_customer_tap_print_last_3_weeks"
PAID_SUM = "sum_customer_paid_last_3_weeks"
PAID_COUNT = "count_customer_paid_last_3_weeks"
#: Fixed value: how many rows (or days) before a row are counted.
HISTORY = 21


def join_dataframes(prints: DataFrame, taps: DataFrame, pays: DataFrame, parameters: Mapping[str, Any] | JoinParams | None = None) -> DataFrame:
    """Prints with a flag for a tap, and the payment.

    Columns: date, position, value_prop, user_id, those to keep, customer_tap,
    paid_by_customer.  Null keys match nothing; several matches give several rows.
    Nulls (and NaNs) of numeric columns become 0.  The result of the first join
    goes on under its own names, so the second can use any key of prints.

    With ``semi`` and ``anti`` the result is prints alone (date, position, value_prop,
    user_id, those to keep), each at most once: with a tap and a payment, or with neither.
    """
    p = parameters if isinstance(parameters, JoinParams) else JoinParams.from_dict(parameters) if parameters else JoinParams()
    fixed = list(dict.fromkeys(["date", "position", "value_prop", "user_id", *p.keep, *p.print_keys]))
    left = prints.select(*fixed)
    if p.how in EXISTENCE:
        for other, keys in ((taps, p.tap_keys), (pays, p.pay_keys)):
            left = existence_join(left, other, list(zip(p.print_keys, keys, strict=True)), p.how)
        out = left.select(*dict.fromkeys(["date", "position", "value_prop", "user_id", *p.keep]))
        return out.fillna(0, [c for c in p.fill if c in out.columns]) if p.fill is not None else out.fillna(0)
    right = taps.select(*[F.col(c).alias(f"_tap_{i}") for i, c in enumerate(p.tap_keys)], F.col("date").alias("_tap_date"))
    pairs = [left[c] == right[f"_tap_{i}"] for i, c in enumerate(p.print_keys)]
    tapped = left.join(right, pairs, p.how).select(*fixed, F.when(F.col("_tap_date").isNull(), 0).otherwise(1).alias(TAP))
    paid = pays.select(*[F.col(c).alias(f"_pay_{i}") for i, c in enumerate(p.pay_keys)], F.col("total").alias(PAID))
    pairs = [tapped[c] == paid[f"_pay_{i}"] for i, c in enumerate(p.print_keys)]
    out = tapped.join(paid, pairs, p.how).select(*dict.fromkeys(["date", "position", "value_prop", "user_id", *p.keep]), TAP, PAID)
    return out.fillna(0, list(p.fill)) if p.fill is not None else out.fillna(0)


def add_features(df: DataFrame, parameters: Mapping[str, Any] | FeatureParams) -> DataFrame:
    """What the user saw, tapped and paid in the rows before, for the same proposition.

    Over no rows the count of prints is 0 and the sums are null.  One shuffle, one
    sort and one window: the condition on payments is a column of its own before.
    """
    p = parameters if isinstance(parameters, FeatureParams) else FeatureParams.from_dict(parameters)
    by = Window.partitionBy("user_id", "value_prop")
    if p.frame == "days":
        w = by.orderBy(F.datediff(F.col(p.date_col), F.lit("1970-01-01").cast("date"))).rangeBetween(-HISTORY, -1)
    else:
        w = by.orderBy(F.col(p.date_col).asc(), *[F.col(c).asc() for c in p.tie_breakers]).rowsBetween(-HISTORY, -1)
    flagged = df.withColumn("_paid", F.when(F.col(PAID) > 0, 1).otherwise(0))
    made = {SAW_COUNT: F.count("value_prop"), TAP_COUNT: F.sum(TAP), PAID_SUM: F.sum(PAID), PAID_COUNT: F.sum("_paid")}
    return flagged.select(*df.columns, *[x.over(w).alias(name) for name, x in made.items()])


def last_n_dates(df: DataFrame, date_col: str, n: int = 0, source: DataFrame | None = None) -> DataFrame:
    """Rows of the last day and the ``n`` days before it.

    The last day is that of ``source``, a plan with the same dates that is cheaper
    to read, or of ``df``.  No dates, no rows.
    """
    last = last_day(df if source is None else source, date_col)
    return df.limit(0) if last is None else df.filter(F.col(date_col).between(F.lit(last - timedelta(days=n)), F.lit(last)))


def create_windows(df: DataFrame, parameters: Mapping[str, Any] | FeatureParams, source: DataFrame | None = None) -> tuple[DataFrame, dict[str, dict[str, str]]]:
    """Features over all rows, then only the last days; and the schema of the result.

    ``source`` may be a plan with the same dates that is cheaper to read: after left
    joins that is the table of prints.
    """
    p = parameters if isinstance(parameters, FeatureParams) else FeatureParams.from_dict(parameters)
    out = last_n_dates(add_features(df, p), p.date_col, p.last_n_days, source=df if source is None else source)
    return out, schema_of(out)
