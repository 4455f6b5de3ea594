"""Rows of one table for which another has a match, or has none."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXISTENCE = ("semi", "anti")
#: What a null key means: it matches nothing, it matches null, or whether it matches is not known.
NULLS = ("unmatched", "equal", "unknown")


def _bounds(df: DataFrame, column: str) -> tuple:
    """Least and greatest value, by one small job; files that keep statistics answer it from them."""
    return tuple(df.agg(F.min(column), F.max(column)).first())


def _within(df: DataFrame, column: str, bounds: tuple) -> DataFrame:
    """Rows in a closed range; it is of literals, so it prunes partitions at planning and is pushed to the scan."""
    return df.limit(0) if bounds[0] is None else df.where(F.col(column).between(F.lit(bounds[0]), F.lit(bounds[1])))


def existence_join(left: DataFrame, right: DataFrame, keys: Sequence[str | tuple[str, str]], how: str = "semi", nulls: str = "unmatched", prune_by: str | tuple[str, str] | None = None) -> DataFrame:
    """Rows of ``left`` with a match in ``right`` (``semi``) or without one (``anti``), once each, and no column of ``right``.

    ``keys`` are names, or pairs where the two tables name them differently.  ``nulls``
    says what a null in a key does: ``unmatched`` matches nothing (so anti keeps the row), ``equal``
    matches null, and ``unknown`` is SQL's IN and NOT IN for one key: where ``right`` has a null,
    NOT IN keeps nothing, and a null in ``left`` is kept only if ``right`` is empty.  The
    last needs a small job that counts the rows and nulls of ``right``; the join itself stays
    an equi-join, which a null-aware join of two large tables is not in Spark.

    ``prune_by`` is a key of ordered type (a date): the range that it has in one table
    is put on the other's scan as literals.  A row of ``right`` beyond ``left``'s range
    matches nothing, and a semi join also needs no row of ``left`` beyond ``right``'s.

    ``right`` is reduced to its distinct keys before it moves, so a key that is there a
    million times is sent once by each task; a key that is hot in ``left`` is split by the
    adaptive planner, which may split that side of both joins.
    """
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in keys]
    if how not in EXISTENCE or nulls not in NULLS or not pairs:
        raise ValueError(f"how is {how!r} of {EXISTENCE}, nulls is {nulls!r} of {NULLS}, with one key at least")
    if nulls == "unknown" and len(pairs) > 1:
        raise ValueError("nulls of several keys cannot be unknown")
    unknown = nulls == "unknown" and how == "anti"
    if unknown:
        # Before pruning: a null or any row counts wherever it is.
        rows, missing = right.agg(F.count(F.lit(1)), F.count_if(F.col(pairs[0][1]).isNull())).first()
        if not rows:
            return left
        if missing:
            return left.limit(0)
        left = left.where(F.col(pairs[0][0]).isNotNull())
    if prune_by is not None:
        a, b = (prune_by, prune_by) if isinstance(prune_by, str) else prune_by
        if (a, b) not in pairs:
            raise ValueError(f"{prune_by!r} is no key")
        if nulls == "equal":
            raise ValueError("a range leaves nulls out, so it can't be used where null matches null")
        if how == "semi":
            left = _within(left, a, _bounds(right, b))
        right = _within(right, b, _bounds(left, a))
    names = [f"_key_{i}" for i in range(len(pairs))]
    found = right.select(*[F.col(b).alias(n) for (_, b), n in zip(pairs, names, strict=True)])
    if nulls != "equal":
        found = found.where(reduce(and_, [F.col(n).isNotNull() for n in names]))
    found = found.distinct()

    def same(a: str, n: str) -> Column:
        return left[a].eqNullSafe(found[n]) if nulls == "equal" else left[a] == found[n]

    return left.join(found, reduce(and_, [same(a, n) for (a, _), n in zip(pairs, names, strict=True)]), f"left_{how}")
