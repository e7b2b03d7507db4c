"""Checks beside the field comparison: warnings, totals against the declaration, formulas that must hold, slots, units, lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions.normalize import PACKAGE_UNITS, bound, collapse, number
from quayside.operators.compare import HIGH_RISK, OPTIONAL, total_of
from quayside.operators.graph import settled

#: Fields that are added up, and the shown word of a status.
SUMS = ("package_count", "fob", "gross_weight", "net_weight")
STATUS_LABELS = {"MATCH": "正常", "MISSING": "可疑", "MISMATCH": "錯誤", "HIGH_RISK": "錯誤"}
WARNED = ("invoice", "packing_list", "bill_of_lading")


def high_risk_warnings(results: DataFrame, papers: DataFrame) -> DataFrame:
    """case_id, warning: a declaration alone, papers that lack, and high-risk fields that don't match (optional ones may lack)."""
    there = papers.groupBy("case_id").agg(F.collect_set(F.when(F.col("doc_type") != "declaration", F.col("doc_type"))).alias("have"))
    alone = F.when(F.size("have") == 0, "declaration_only")
    lacks = [F.when(~F.array_contains("have", t), f"no_{t}") for t in WARNED]
    first = there.select("case_id", F.explode(F.array_compact(F.array(alone, *lacks))).alias("warning"))
    risky = F.col("field").isin(*HIGH_RISK) & (F.col("status") != "MATCH") & ~(F.col("field").isin(*OPTIONAL) & (F.col("status") == "MISSING"))
    return first.unionByName(results.filter(risky).select("case_id", F.concat("field", F.lit(":"), "status").alias("warning")))


def status_with_warnings(results: DataFrame, warnings: DataFrame) -> DataFrame:
    """case_id, status: HIGH_RISK with any warning, else the worst of the fields; optional ones may lack."""
    s = F.col("status")
    worst = F.when(F.bool_or(s == "MISMATCH"), "MISMATCH").when(F.bool_or((s == "MISSING") & ~F.col("field").isin(*OPTIONAL)), "MISSING").otherwise("MATCH")
    warned = warnings.select("case_id").distinct().withColumn("warned", F.lit(True))
    rows = results.groupBy("case_id").agg(worst.alias("status")).join(warned, "case_id", "left")
    return rows.select("case_id", F.when(F.col("warned"), "HIGH_RISK").otherwise(F.col("status")).alias("status"))


def formal_compare(fields: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """case_id, field, status over the papers besides the declaration: fields with two values or more; totals of each kind of paper for SUMS, the set of values for others."""
    v = F.upper(collapse(F.col("value")))
    rows = fields.filter(F.col("canonical").isin(*names) & (F.col("doc_type") != "declaration") & (F.col("value") != ""))
    kinds = rows.groupBy("case_id", "canonical", "doc_type").agg(F.sum(number(F.col("value"))).cast("decimal(38,2)").alias("total"), F.count("*").alias("n"), F.collect_set(v).alias("vs"))
    all_ = kinds.groupBy("case_id", "canonical").agg(F.sum("n").alias("n"), F.countDistinct("total").alias("totals"), F.size(F.array_distinct(F.flatten(F.collect_list("vs")))).alias("values")).filter("n >= 2")
    ok = F.when(F.col("canonical").isin(*SUMS), F.col("totals") <= 1).otherwise(F.col("values") == 1)
    return all_.select("case_id", F.col("canonical").alias("field"), F.when(ok, "MATCH").otherwise("MISMATCH").alias("status"))


def declaration_against_papers(fields: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """case_id, field, status: the declaration's total against the one that all kinds of papers agree on (SUMS), its value against the papers'
    only value, its containers against theirs; fields on which the papers disagree are left out."""
    v = F.upper(collapse(F.col("value")))
    rows = fields.filter(F.col("canonical").isin(*names) & (F.col("value") != "")).withColumn("own", F.col("doc_type") == "declaration")
    n = number(F.col("value"))
    kinds = rows.groupBy("case_id", "canonical", "own", "doc_type").agg(F.sum(n).cast("decimal(38,2)").alias("total"), F.collect_set(v).alias("vs"))
    each = kinds.groupBy("case_id", "canonical").agg(
        F.collect_set(F.when(~F.col("own"), F.col("total"))).alias("totals"), F.max(F.when(F.col("own"), F.col("total"))).alias("total"),
        F.array_distinct(F.flatten(F.collect_list(F.when(~F.col("own"), F.col("vs"))))).alias("papers"), F.flatten(F.collect_list(F.when(F.col("own"), F.col("vs")))).alias("declared"),
    ).filter((F.size("papers") > 0) & (F.size("declared") > 0))
    return _declared(each)


def _kinds(items: Column) -> Column:
    """An array of doc_type, own (the declaration), total, vs (distinct values) of a field's values (an array of doc_type, value)."""
    v = lambda x: F.upper(collapse(x["value"]))
    one = lambda k: bound(F.filter(items, lambda x: x["doc_type"] == k), lambda xs: F.struct(k.alias("doc_type"), (k == "declaration").alias("own"), total_of(F.transform(xs, lambda x: x["value"])).alias("total"), F.array_distinct(F.transform(xs, v)).alias("vs")))
    return F.transform(F.array_distinct(F.transform(items, lambda x: x["doc_type"])), one)


def _full(grouped: DataFrame, test: Column | None = None) -> DataFrame:
    """case_id, canonical, n, kinds of grouped (case_id, canonical, items): values that aren't empty, all made once."""
    some = F.filter("items", lambda x: (x["value"] != "") & (F.lit(True) if test is None else test(x)))
    rows = grouped.select("case_id", "canonical", F.explode(F.array(some)).alias("items")).filter(F.size("items") > 0)
    return rows.select("case_id", "canonical", F.size("items").alias("n"), F.explode(F.array(_kinds(F.col("items")))).alias("kinds"))


def formal_compare_of(grouped: DataFrame) -> DataFrame:
    """formal_compare() of a case's values by field (case_id, canonical, items), in their rows."""
    totals = F.array_distinct(F.filter(F.transform("kinds", lambda k: k["total"]), lambda t: t.isNotNull()))
    every = F.array_distinct(F.flatten(F.transform("kinds", lambda k: k["vs"])))
    ok = F.when(F.col("canonical").isin(*SUMS), F.size(totals) <= 1).otherwise(F.size(every) == 1)
    return _full(grouped, lambda x: x["doc_type"] != "declaration").filter("n >= 2").select("case_id", F.col("canonical").alias("field"), F.when(ok, "MATCH").otherwise("MISMATCH").alias("status"))


def declaration_against(grouped: DataFrame) -> DataFrame:
    """declaration_against_papers() of a case's values by field (case_id, canonical, items), in their rows."""
    others, own = F.filter("kinds", lambda k: ~k["own"]), F.filter("kinds", lambda k: k["own"])
    each = settled(_full(grouped).select(
        "case_id", "canonical", F.array_distinct(F.filter(F.transform(others, lambda k: k["total"]), lambda t: t.isNotNull())).alias("totals"), F.get(own, F.lit(0))["total"].alias("total"),
        F.array_distinct(F.flatten(F.transform(others, lambda k: k["vs"]))).alias("papers"), F.flatten(F.transform(own, lambda k: k["vs"])).alias("declared"),
    )).filter((F.size("papers") > 0) & (F.size("declared") > 0))
    return _declared(each)


def _declared(each: DataFrame) -> DataFrame:
    boxes = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda x: F.regexp_extract_all(x, F.lit(r"([A-Z]{4}\d{7})"), F.lit(1)))))
    held = (F.size(boxes("papers")) > 0) & (F.size(F.array_except(boxes("papers"), boxes("declared"))) == 0)
    ok = (
        F.when(F.col("canonical").isin(*SUMS), F.when((F.size("totals") == 1) & F.col("total").isNotNull(), F.col("totals")[0] == F.col("total")))
        .when(F.size("papers") == 1, F.array_sort(F.array_distinct("declared")) == F.col("papers"))
        .when(F.col("canonical") == "container_no", held)
    )
    return each.filter(ok.isNotNull()).select("case_id", F.col("canonical").alias("field"), F.when(ok, "MATCH").otherwise("MISMATCH").alias("status"))


def shown_values(items: Column) -> Column:
    """values_by_field() of an array of a field's values."""
    every = F.array_sort(F.transform(items, lambda x: F.struct(x["seg"].alias("seg"), x["ord"].alias("ord"), F.concat(x["doc_type"], F.lit(": "), x["value"]).alias("x"))))
    return F.array_join(F.transform(every, lambda s: s["x"]), "; ")


def exact_cif() -> Column:
    """From fob, freight, insurance, cif: whether they add up exactly."""
    parts = F.col("fob") + F.col("freight") + F.col("insurance")
    return F.when(F.isnull(parts + F.col("cif")), "MISSING").when(parts == F.col("cif"), "MATCH").otherwise("MISMATCH")


def local_amount() -> Column:
    """The amount in local money: CIF, or the amount where CIF lacks or is zero, by the rate; null where either lacks."""
    return (F.coalesce(F.nullif(F.col("cif"), F.lit(0).cast("decimal(18,6)")), F.col("amount")) * F.col("exchange_rate")).cast("decimal(38,6)")


def weight_check(results: DataFrame) -> DataFrame:
    """case_id, status of the weights together: a difference over agreement over nothing."""
    s = F.col("status")
    rows = results.groupBy("case_id").agg(F.bool_or(F.col("field").isin("net_weight", "gross_weight") & (s == "MISMATCH")).alias("bad"), F.bool_or(F.col("field").isin("net_weight", "gross_weight") & (s == "MATCH")).alias("good"))
    return rows.select("case_id", F.when(F.col("bad"), "MISMATCH").when(F.col("good"), "MATCH").otherwise("MISSING").alias("status"))


def found_documents(papers: DataFrame) -> DataFrame:
    return papers.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("doc_type")), ",").alias("found"))


def effective_missing(missing: DataFrame, candidates: DataFrame) -> DataFrame:
    """Missing papers (case_id, doc_type) without those of which there is a candidate, however unsure."""
    return missing.join(candidates.select("case_id", "doc_type").distinct(), ["case_id", "doc_type"], "left_anti")


def slots(papers: DataFrame, group: str, order: str, kinds: tuple[str, ...], name: str) -> DataFrame:
    """group, a column for each kind with the name of its first paper, and others: the rest, in order, comma-joined."""
    w = Window.partitionBy(group, "doc_type").orderBy(order)
    placed = papers.withColumn("_first", (F.row_number().over(w) == 1) & F.col("doc_type").isin(*kinds))
    own = [F.max(F.when(F.col("_first") & (F.col("doc_type") == k), F.col(name))).alias(k) for k in kinds]
    rest = F.array_sort(F.collect_list(F.when(~F.col("_first"), F.struct(F.col(order).alias("o"), F.col(name).alias("x")))))
    return placed.groupBy(group).agg(*own, F.array_join(F.transform(rest, lambda s: s["x"]), ",").alias("others"))


def values_by_field(fields: DataFrame) -> DataFrame:
    """case_id, canonical, shown: all values of a field with their papers, in order, joined as `kind: value; ...`."""
    every = F.array_sort(F.collect_list(F.struct("seg", "ord", F.concat("doc_type", F.lit(": "), "value").alias("x"))))
    return fields.filter("value <> ''").groupBy("case_id", "canonical").agg(F.array_join(F.transform(every, lambda s: s["x"]), "; ").alias("shown"))


def unit_aliases(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, unit, written: units that are written in two ways or more, sorted and joined by ' / '."""
    names = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in {**PACKAGE_UNITS, **{b: b for b in PACKAGE_UNITS.values()}}.items()))
    words = values.select(*keys, F.explode(F.regexp_extract_all(F.upper(value), F.lit(r"\b([A-Z]{2,8})\b"), F.lit(1))).alias("w"))
    unit = F.get(F.filter(names, lambda x: x["a"] == F.col("w")), F.lit(0))["b"]
    rows = words.withColumn("unit", unit).filter("unit IS NOT NULL").groupBy(*keys, "unit").agg(F.array_sort(F.collect_set("w")).alias("ws"))
    return rows.filter(F.size("ws") > 1).select(*keys, "unit", F.array_join("ws", " / ").alias("written"))


def status_label(status: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in STATUS_LABELS.items() for x in p)), status), status)


def fixed_freight(size: Column, rates: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with freight: the rate of a container's size (rates: size, freight, a row each), null where there is none."""
    return rows.withColumn("_s", F.upper(size)).join(F.broadcast(rates.select(F.col("size").alias("_s"), "freight")) if rates.count() <= 10_000 else rates.select(F.col("size").alias("_s"), "freight"), "_s", "left").drop("_s")


def feedback_rows(entries: DataFrame) -> DataFrame:
    """A row for each of an entry's error types (array error_types); without any, one that says correct or other."""
    given = F.when(F.size("error_types") > 0, F.col("error_types")).otherwise(F.array(F.when(F.col("is_correct"), "正確").otherwise("其他")))
    return entries.withColumn("error_type", F.explode(given)).drop("error_types")


def top_errors(feedback: DataFrame, most: int = 5) -> DataFrame:
    """The `most` error types that occur most; ties by name."""
    return feedback.groupBy("error_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_type").limit(most)
