"""Features of a new day from the tail of what was there before.

The features of a row depend on the 21 rows before it with the same user and
proposition.  So those rows, for each key, are all that has to be kept: a day's
features come from the new rows and the kept ones, and the history is not read.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import FeatureParams
from .existence import existence_join
from .features import HISTORY, add_features

KEYS = ("user_id", "value_prop")
_OLD = "_old"


def _params(parameters: Mapping[str, Any] | FeatureParams) -> FeatureParams:
    p = parameters if isinstance(parameters, FeatureParams) else FeatureParams.from_dict(parameters)
    if p.frame != "rows":
        raise ValueError("the rows to keep are known for frames of rows only")
    return p


def tail(df: DataFrame, parameters: Mapping[str, Any] | FeatureParams) -> DataFrame:
    """The last 21 rows of each user and proposition: all that later rows look back on.

    A hot key sends 21 rows from each task: the limit is taken before the shuffle.
    """
    p = _params(parameters)
    last = Window.partitionBy(*KEYS).orderBy(F.col(p.date_col).desc(), *[F.col(c).desc() for c in p.tie_breakers])
    return df.withColumn("_place", F.row_number().over(last)).where(F.col("_place") <= HISTORY).drop("_place")


def advance(state: DataFrame | None, new: DataFrame, parameters: Mapping[str, Any] | FeatureParams) -> tuple[DataFrame, DataFrame]:
    """The features of ``new``, and the state after it.

    ``state`` is what an earlier call returned (None at first), ``new`` the rows of later
    days with the same columns.  The features equal those of a full run over all rows up to
    these, provided that ``tie_breakers`` order the rows of a day fully.  Rows of ``new`` that are not later
    than the state's rows of their key would change features that are out already: such days go through
    a full run of what changed (``streaming.late``), not through here.

    Only keys that ``new`` has take part in the window; the state of the others goes on as
    it is.  So the shuffle moves the new rows and at most 21 rows of each of their keys.
    """
    p = _params(parameters)
    if state is None:
        return add_features(new, p), tail(new, p)
    touched = existence_join(state, new, KEYS, "semi", nulls="equal")
    untouched = existence_join(state, new, KEYS, "anti", nulls="equal")
    both = touched.select(*new.columns).withColumn(_OLD, F.lit(True)).union(new.withColumn(_OLD, F.lit(False)))
    features = add_features(both, p).where(~F.col(_OLD)).drop(_OLD)
    return features, tail(both.drop(_OLD), p).union(untouched.select(*new.columns))
