"""Ordered texts: what is exploded into rows with an ordinal is put together again in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def in_order(text: str, *order: str, sep: str = "\n\n") -> Column:
    """An aggregate: the texts in the order of some columns, nulls left out."""
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return F.array_join(F.transform(items, lambda x: x["_text"]), sep)


def first_by(order: str, *columns: str) -> Column:
    """An aggregate: a struct of the columns in the row that is first by an ordinal, ties by the columns."""
    return F.min(F.struct(order, *columns))


def dedup_names(rows: DataFrame, name: str, by: list[str], order: list[str]) -> DataFrame:
    """Rows whose repeated names get .1, .2 and so on behind the first."""
    nth = F.row_number().over(W.partitionBy(*by, name).orderBy(*order)) - 1
    return rows.withColumn(name, F.when(nth == 0, F.col(name)).otherwise(F.concat(name, F.lit("."), nth.cast("string"))))


def places(rows: DataFrame, by: list[str], top: str, left: str, stored: str) -> DataFrame:
    """Rows with `place`, from 1: shapes in reading order, from the top, then from the left, then as stored."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(top, left, stored)))
