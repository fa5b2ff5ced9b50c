"""Typed access to fields of a semi-structured JSON column (VARIANT)."""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, VariantType


def parse_json_column(df: DataFrame, json_col: str = "DATA") -> DataFrame:
    """Turn a JSON text column into VARIANT, parsing each document exactly
    once; malformed text -> NULL.

    Catalyst pushes filters (including the IS NOT NULL it infers from join
    keys) below projections by substituting the projected expression, so a
    plain ``withColumn(try_parse_json(...))`` is re-evaluated -- the whole
    document re-parsed -- once per pushed predicate.  Emitting the parsed
    row through a one-element ``inline`` (a Generate) keeps the parse below
    a boundary that predicates on its output do not cross; what gets
    repeated is only the cheap binary ``variant_get``.
    """
    dt = df.schema[json_col].dataType
    if isinstance(dt, VariantType):
        return df
    if not isinstance(dt, StringType):
        raise TypeError(f"{json_col} must be STRING or VARIANT, got {dt}")
    others = [c for c in df.columns if c != json_col]
    row = F.struct(*[F.col(c) for c in others],
                   F.try_parse_json(F.col(json_col)).alias(json_col))
    return df.select(F.inline(F.array(row)))


def field(json_col: str, path: str, type_: str = "string") -> Column:
    """``DATA:path::TYPE``.  JSON null and a missing field are both NULL; a
    value that does not fit the type is NULL (never an error)."""
    p = path if path.startswith("$") else f"$.{path}"
    return F.try_variant_get(F.col(json_col), p, type_)


def extract_fields(df: DataFrame, json_col: str, fields: Mapping[str, str],
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """Project ``{name: type}`` out of the JSON column in one select.

    Catalyst prunes fields that later operators never read, so callers can
    ask for the full event schema without paying for it.
    """
    df = parse_json_column(df, json_col)
    cols = [F.col(k) for k in keep]
    cols += [field(json_col, name, t).alias(name) for name, t in fields.items()]
    return df.select(*cols)
