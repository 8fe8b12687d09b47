"""General row operators: order, merge, filter and count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_distinct(rows: DataFrame, n: int, *order: Column | str) -> DataFrame:
    """The least n distinct rows."""
    return rows.distinct().orderBy(*order).limit(n)


def merged_in_order(frames: list[DataFrame], *order: Column | str) -> DataFrame:
    """All rows of some frames in one order, repeated ones kept."""
    return reduce(DataFrame.unionByName, frames).orderBy(*order)


def ordered_by(rows: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    return rows.orderBy(F.asc(column) if ascending else F.desc(column))


def all_but(rows: DataFrame, column: str, value: object) -> DataFrame:
    """Rows whose column isn't this value; a null is not."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(value)))


def with_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    return rows.where(F.col(column).startswith(prefix))


def with_suffix(rows: DataFrame, column: str, suffix: str) -> DataFrame:
    return rows.where(F.col(column).endswith(suffix))
