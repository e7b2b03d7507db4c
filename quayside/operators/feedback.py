"""The log of answers: latest rows, counts by kind, accuracy, most common value; and differences between listings of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cleaned(rows: DataFrame) -> DataFrame:
    """error_type: trimmed, and where it is empty `correct` or `other` by is_correct."""
    return rows.withColumn("error_type", F.coalesce(F.nullif(F.trim("error_type"), F.lit("")), F.when(F.col("is_correct"), "correct").otherwise("other")))


def recent(rows: DataFrame, n: int) -> DataFrame:
    """The n latest rows (1 to 1000), the larger id first among equals."""
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(1000, n)))


def statistics(rows: DataFrame) -> DataFrame:
    """error_type, n over the rows, with the totals of right and wrong ones."""
    by = rows.groupBy("error_type").agg(F.count("*").alias("n"), F.count_if("is_correct").alias("n_correct"))
    return by.select("error_type", "n", "n_correct", (F.col("n") - F.col("n_correct")).alias("n_issues"))


def latest_statistics(rows: DataFrame, n: int = 100) -> DataFrame:
    """One row over the n latest rows: total, n_correct, n_issues, and errors (error_type, n) of the wrong ones: the most common first,
    of equally common ones that which came latest. No rows give zeros and no errors."""
    wrong = F.coalesce(~F.col("is_correct"), F.lit(True))
    by = recent(rows, n).groupBy("error_type").agg(F.count("*").alias("n"), F.count_if(wrong).alias("issues"), F.max(F.when(wrong, F.struct("created_at", "id"))).alias("latest"))
    errors = F.array_sort(F.collect_list(F.when(F.col("issues") > 0, F.struct("issues", "latest", "error_type"))))
    total, issues = (F.coalesce(F.sum(c), F.lit(0)).cast("long") for c in ("n", "issues"))
    return by.agg(total.alias("total"), (total - issues).alias("n_correct"), issues.alias("n_issues"), F.transform(F.reverse(errors), lambda x: F.struct(x["error_type"].alias("error_type"), x["issues"].alias("n"))).alias("errors"))


def accuracy(rows: DataFrame, keys: list[str], samples: str, failures: str) -> DataFrame:
    """keys, samples, failures, accuracy: percent to one place, 0 without samples."""
    s, f = F.sum(samples), F.sum(failures)
    return rows.groupBy(*keys).agg(s.alias("samples"), f.alias("failures"), F.coalesce(F.round((s - f) * 100.0 / F.nullif(s, F.lit(0)), 1), F.lit(0.0)).alias("accuracy"))


def mode(rows: DataFrame, value: str, order: str, keys: list[str] | None = None) -> DataFrame:
    """The most common value; of equally common ones the one that came first. Two aggregations, no sort of the table."""
    counts = rows.groupBy(*(keys or []), value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counts.groupBy(*(keys or [])).agg(F.max_by(value, F.struct(F.col("n"), -F.col("_first"))).alias(value), F.max("n").alias("n"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change: added, removed or changed (time or size) between two listings (path, mtime, size)."""
    a, b = (df.select("path", F.struct("mtime", "size").alias(name)) for df, name in ((before, "was"), (after, "now")))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return a.join(b, "path", "full").select("path", change.alias("change")).filter("change IS NOT NULL")


def newer(source: DataFrame, target: DataFrame) -> DataFrame:
    """path of source files that the target lacks or has in an older state."""
    t = target.select("path", F.col("mtime").alias("_t"))
    return source.join(t, "path", "left").filter(F.col("_t").isNull() | (F.col("_t") < F.col("mtime"))).select("path")


def expired(files: DataFrame, now: str, days: int) -> DataFrame:
    return files.filter(F.col("mtime") < F.to_timestamp_ntz(F.lit(now)) - F.make_dt_interval(F.lit(days)))
