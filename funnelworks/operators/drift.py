"""JSON text whose fields change from file to file."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The fields that are in no schema, and texts that are no JSON object.
REST, BAD = "_rest", "_bad"
#: Types from narrow to wide, within which a field may grow; all else that differs becomes text.
_NUMBERS = ("bigint", "decimal", "double")


def _wider(a: str, b: str) -> str:
    """A type that holds both."""
    if a == b or b == "void":
        return a
    if a == "void":
        return b
    at = [next((i for i, n in enumerate(_NUMBERS) if x.startswith(n)), None) for x in (a, b)]
    # Two decimals of different places and a long beside a decimal are both held by a double as far as JSON readers do.
    return "double" if None not in at else "string"


def _simple(kind: str) -> str:
    """The type of a field by its type as found: numbers, booleans and text; what is nested stays JSON text."""
    kind = kind.lower()
    if kind.startswith("decimal"):
        return "double"
    return kind if kind in ("bigint", "double", "boolean", "string", "void") else "string"


def found_fields(df: DataFrame, column: str) -> dict[str, str]:
    """Names and types of the fields that the texts have, by one aggregation over all of them; void if always null."""
    text = F.schema_of_variant_agg(F.try_parse_json(column))
    found = df.agg(text.alias("found")).first()["found"]
    if not found or not found.upper().startswith("OBJECT<"):
        return {}
    # OBJECT<...> has the syntax of a struct.
    kinds = df.sparkSession.createDataFrame([], "x " + "STRUCT" + found[len("OBJECT") :].replace("OBJECT<", "STRUCT<").replace("VARIANT", "STRING")).schema["x"].dataType
    assert isinstance(kinds, StructType)
    return {f.name: _simple(f.dataType.simpleString()) for f in kinds.fields}


def merged_fields(tracked: Mapping[str, str], found: Mapping[str, str]) -> dict[str, str]:
    """The tracked fields, each wide enough for both, then the new ones; a field that is gone stays."""
    out = {name: _wider(kind, found.get(name, kind)) for name, kind in tracked.items()}
    return out | {name: kind for name, kind in found.items() if name not in tracked}


def _typed(value: Column, kind: str) -> Column:
    return value if kind in ("string", "void") else value.try_cast(kind)


def parse_fields(df: DataFrame, column: str, fields: Mapping[str, str]) -> DataFrame:
    """``df`` with a column for each of ``fields`` in place of the text, and ``_rest`` and ``_bad``.

    ``_rest`` is a map of the fields that are not in ``fields``, and of values that do not fit their
    type, as text (null if there are none).  ``_bad`` is the text itself where it is no JSON
    object.  So nothing is lost, whatever a later file brings.  Fields with the names of
    columns are a ValueError.
    """
    others = [c for c in df.columns if c != column]
    if clash := sorted(set(others) & {*fields, REST, BAD}):
        raise ValueError(f"fields have the names of columns: {clash}")
    held = F.try_parse_json(column)
    is_object = F.coalesce(F.schema_of_variant(held).startswith("OBJECT<"), F.lit(False))
    # Generated, so that a text is parsed once: a filter on the result would be pushed below a projection, and parse again.
    made = F.struct(F.when(is_object, F.from_json(column, "map<string,string>")).alias("_map"), F.when(F.col(column).isNotNull() & ~is_object, F.col(column)).alias(BAD))
    parsed = df.select(*[F.col(f"`{c}`") for c in others], F.inline(F.array(made)))
    value = {name: F.col("_map")[name] for name in fields}
    unfit = [F.when(value[n].isNotNull() & _typed(value[n], k).isNull(), F.lit(n)) for n, k in fields.items()]
    known = F.array_except(F.array(*[F.lit(n) for n in fields]).cast("array<string>"), F.array(*unfit).cast("array<string>"))
    rest = F.map_filter("_map", lambda k, _: ~F.array_contains(known, k)) if fields else F.col("_map")
    return parsed.select(
        *[F.col(f"`{c}`") for c in others],
        *[_typed(value[n], k).cast("string" if k == "void" else k).alias(n) for n, k in fields.items()],
        F.when(F.size(rest) > 0, rest).alias(REST),
        BAD,
    )
