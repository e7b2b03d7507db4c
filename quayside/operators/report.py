"""Tables that people read: pivots, searches, lists of differences, summaries, audit lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators.segment import last_of


def pivot_values(firsts: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """case_id, field and a column for each kind of paper, in the given order: its last value."""
    return firsts.groupBy("case_id", F.col("canonical").alias("field")).pivot("doc_type", list(kinds)).agg(F.max_by("value", "seg"))


def pivoted(items: Column, kinds: tuple[str, ...]) -> list[Column]:
    """The same of an array of a field's values, in its row."""
    return [last_of(F.filter(items, lambda x: x["doc_type"] == k)).alias(k) for k in kinds]


def search(rows: DataFrame, query: str = "", only_issues: bool = False) -> DataFrame:
    """Rows that hold the query in any column, case aside; only those with an issue if asked."""
    found = rows.filter(F.contains(F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in rows.columns))), F.lit(query.lower()))) if query else rows
    return found.filter(F.col("status") != "MATCH") if only_issues else found


def lists_of(results: Column) -> list[Column]:
    """matched, differing, missing of a case's results (an array): fields, sorted and comma-joined."""
    names = lambda s: F.array_join(F.array_sort(F.transform(F.filter(results, lambda x: x["status"] == s), lambda x: x["field"])), ",")
    return [names("MATCH").alias("matched"), names("MISMATCH").alias("differing"), names("MISSING").alias("missing")]


def differences(results: DataFrame) -> DataFrame:
    """case_id, matched, differing, missing: fields, sorted and comma-joined."""
    return results.groupBy("case_id").agg(F.collect_list(F.struct("field", "status")).alias("x")).select("case_id", *lists_of(F.col("x")))


def audit_line(x: Column) -> Column:
    """A line for a result (a struct)."""
    sign = F.when(x["status"] == "MATCH", "✓").when(x["status"] == "MISMATCH", "✗").otherwise("⚠")
    return F.concat(sign, F.lit(" "), x["field"], F.lit(": "), F.coalesce(x["hub_value"], F.lit("-")), F.lit(" ("), x["n_papers"].cast("string"), F.lit(" papers, "), x["n_differ"].cast("string"), F.lit(" differ)"))


def text_of(results: Column) -> Column:
    """The audit lines of a case's results (an array), in their order."""
    return F.array_join(F.transform(results, audit_line), "\n")


def report_text(results: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """case_id, report: the audit lines of a case in the order of the fields."""
    order = F.array_position(F.array(*map(F.lit, fields)), F.col("field"))
    one = F.struct(order.alias("o"), "field", "status", "hub_value", "n_papers", "n_differ")
    return results.groupBy("case_id").agg(F.array_sort(F.collect_list(one)).alias("x")).select("case_id", text_of(F.col("x")).alias("report"))


def priority() -> Column:
    return F.when(F.col("status") == "HIGH_RISK", 0).when(F.col("status") == "MISMATCH", 1).when(F.col("status") == "MISSING", 2).otherwise(3)
