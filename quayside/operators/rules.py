"""Rules as data: which rules a case meets (relational division), condition operators, required fields, order and scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(v: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(v, r"\s+", " ")))


def matching(rules: DataFrame, context: DataFrame) -> DataFrame:
    """case_id, rule_id of the rules all of whose conditions a case meets.

    rules: rule_id, enabled, applies_when (map of key to allowed values). context: case_id, key, value (a key may have several
    values). A key's condition is met by any of its values; a key that the case lacks fails; a rule without conditions always
    applies. Conditions are joined by key and value, so only what matches is ever paired.
    """
    active = rules.filter("enabled")
    wanted = active.select("rule_id", F.size("applies_when").alias("n"), F.explode("applies_when").alias("key", "values")).select("rule_id", "n", "key", F.explode("values").alias("v")).select("rule_id", "n", "key", fold(F.col("v")).alias("v")).distinct()
    facts = context.select("case_id", "key", fold(F.col("value")).alias("v")).distinct()
    met = facts.join(wanted, ["key", "v"]).groupBy("case_id", "rule_id").agg(F.countDistinct("key").alias("met"), F.first("n").alias("n")).filter("met = n").select("case_id", "rule_id")
    always = F.array_sort(F.collect_set("rule_id"))
    free = active.filter(F.size("applies_when") == 0).agg(always.alias("ids"))
    cases = context.select("case_id").distinct().withColumn("one", F.lit(1)).join(free.withColumn("one", F.lit(1)), "one").select("case_id", F.explode("ids").alias("rule_id"))
    return met.unionByName(cases)


def condition(op: str, value: Column, args: list[str]) -> Column:
    """exists, equals, in, not_in, contains; a missing value passes not_in and fails the others."""
    v = F.coalesce(fold(value), F.lit(""))
    given = [a.lower().strip() for a in args]
    if op == "exists":
        return v != ""
    if op == "equals":
        return v == given[0]
    if op == "in":
        return v.isin(*given)
    if op == "not_in":
        return ~v.isin(*given)
    if op == "contains":
        hit = F.lit(False)
        for a in given:
            hit = hit | F.contains(v, F.lit(a))
        return hit
    raise ValueError(op)


def missing_fields(fields: DataFrame, required: dict[str, tuple[str, ...]]) -> DataFrame:
    """case_id, doc_type, missing: of each paper the required fields that it lacks, sorted and comma-joined; papers that lack none are left out."""
    there = fields.filter("value <> ''").groupBy("case_id", "doc_type").agg(F.collect_set("canonical").alias("have"))
    wanted = F.create_map(*(x for k, v in required.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    lacks = F.array_sort(F.array_except(F.element_at(wanted, F.col("doc_type")), "have"))
    return there.filter(F.col("doc_type").isin(*required)).select("case_id", "doc_type", F.array_join(lacks, ",").alias("missing")).filter("missing <> ''")


def ordered(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of enabled rules with their place: by priority, then by the rules' order."""
    from pyspark.sql import Window

    w = Window.partitionBy("case_id").orderBy("priority", "load_ord")
    return findings.join(rules.select("rule_id", "priority", "load_ord"), "rule_id").withColumn("place", F.row_number().over(w))
