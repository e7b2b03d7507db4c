"""Runs of rows of one kind: gaps and islands, and first, last and best values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, group: str, order: list[str], kind: str) -> DataFrame:
    """group, island (from 0), kind, first_at, last_at, n: each run of rows of one kind, in order."""
    w = Window.partitionBy(group).orderBy(*order)
    change = F.coalesce((F.col(kind) != F.lag(kind).over(w)).cast("int"), F.lit(0))
    marked = rows.withColumn("_change", change).withColumn("_at", F.row_number().over(w) - 1).withColumn("island", F.sum("_change").over(w))
    return marked.groupBy(group, F.col("island").cast("long").alias("island")).agg(F.first(kind).alias(kind), F.min("_at").cast("long").alias("first_at"), F.max("_at").cast("long").alias("last_at"), F.count("*").alias("n"))


def join_pages(pages: DataFrame, keys: list[str], page: str, text: str) -> DataFrame:
    """keys and the pages' texts, in order, with a blank line between."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t"))))
    return pages.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "\n\n").alias(text))


def best(rows: DataFrame, keys: list[str], value: str, score: str, order: str) -> DataFrame:
    """keys and the value of the best score; the first wins ties."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(F.col(score), -F.col(order))).alias(value))


def last_values(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def last_of(items: Column) -> Column:
    """The value of the last paper (seg) of an array of a field's values; of a paper's values the first."""
    return F.array_max(F.transform(items, lambda x: F.struct(x["seg"].alias("seg"), (-x["ord"]).alias("ord"), x["value"].alias("value"))))["value"]


def distinct_in_order(rows: DataFrame, keys: list[str], value: str, order: str, most: int | None = None) -> DataFrame:
    """keys and the distinct values in the order of their first places."""
    firsts = rows.groupBy(*keys, value).agg(F.min(order).alias("_o"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("_o", F.col(value).alias("x")))), lambda s: s["x"])
    return firsts.groupBy(*keys).agg((F.slice(values, 1, most) if most else values).alias(value))
