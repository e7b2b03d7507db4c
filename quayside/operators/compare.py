"""A case's declaration against its other papers, totals by paper type, consensus and container sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.normalize import alike, bound, normalized, number
from quayside.operators.extract import constant
from quayside.operators.graph import settled

#: The fields that are compared.
CHECK_FIELDS = (
    "quantity", "package_count", "net_weight", "gross_weight", "amount", "currency", "description", "hs_code", "port", "container_no", "seal_no",
    "vessel_voyage", "declaration_no", "invoice_no", "bl_no", "booking_no", "incoterm", "cif", "fob", "freight", "insurance", "exchange_rate",
    "statistical_method", "duty_rate", "duty_amount", "customs_value", "trade_promotion_fee", "business_tax", "import_regulation", "mp1", "bsmi",
    "commodity_inspection", "closing_date",
)
HIGH_RISK = ("hs_code", "container_no", "seal_no", "vessel_voyage", "exchange_rate", "duty_rate", "customs_value", "trade_promotion_fee", "business_tax", "import_regulation", "mp1", "bsmi", "commodity_inspection")
#: Fields whose absence leaves a report's status alone: all from the declaration's number on.
OPTIONAL = CHECK_FIELDS[12:]


def compared(values: Column, hub: tuple[str, ...] = ("declaration",), fields: tuple[str, ...] = CHECK_FIELDS, targets: tuple[str, ...] | None = None, same: object = None) -> Column:
    """An array of field, status, hub_value, n_papers, n_differ for a case's values (an array of seg, doc_type, canonical, value).

    MISSING where the hub or all other papers lack the field, MISMATCH where any other paper differs, else MATCH. Values that are
    written alike agree; only others get their normal forms.
    """
    agree = alike if same is None else lambda f, a, b: F.coalesce(same(f, normalized(f, a), normalized(f, b)), F.lit(False))
    own = lambda v: v["doc_type"].isin(*hub)
    other = lambda v: ~own(v) if targets is None else v["doc_type"].isin(*targets)

    def judged(field: Column, mine: Column) -> Column:
        first = F.array_min(F.transform(F.filter(mine, own), lambda v: F.struct(v["seg"].alias("seg"), v["value"].alias("value"))))

        def against(x: Column) -> Column:
            h = x["hub"]["value"]
            apart = F.filter(x["others"], lambda v: (v["value"] != h) | v["value"].isNull())
            d = F.when(x["hub"].isNotNull(), F.size(F.filter(apart, lambda v: ~agree(field, h, v["value"])))).otherwise(0)
            n = F.size(x["others"])
            status = lambda d: F.when(h.isNull() | (n == 0), "MISSING").when(d > 0, "MISMATCH").otherwise("MATCH")
            return bound(d, lambda d: F.struct(field.alias("field"), status(d).alias("status"), h.alias("hub_value"), n.cast("long").alias("n_papers"), d.cast("long").alias("n_differ")))

        return bound(F.struct(first.alias("hub"), F.filter(mine, other).alias("others")), against)

    lacking = lambda f: F.struct(f.alias("field"), F.lit("MISSING").alias("status"), F.lit(None).cast("string").alias("hub_value"), F.lit(0).cast("long").alias("n_papers"), F.lit(0).cast("long").alias("n_differ"))
    one = lambda names: lambda f: F.when(F.array_contains(names, f), bound(F.filter(values, lambda v: v["canonical"] == f), lambda mine: judged(f, mine))).otherwise(lacking(f))
    return bound(F.transform(values, lambda v: v["canonical"]), lambda names: F.transform(constant(list(fields)), one(names)))


def judged(sides: Column, same: object = None) -> Column:
    """The same array for a case's sides (batches.sides): only values that are written otherwise than the hub's are looked at."""
    agree = alike if same is None else lambda f, a, b: F.coalesce(same(f, normalized(f, a), normalized(f, b)), F.lit(False))

    def one(x: Column) -> Column:
        h, n = x["hub_value"], x["n_papers"]
        status = lambda d: F.when(h.isNull() | (n == 0), "MISSING").when(d > 0, "MISMATCH").otherwise("MATCH")
        differ = F.size(F.filter(x["apart"], lambda v: ~agree(x["field"], h, v))).cast("long")
        return bound(differ, lambda d: F.struct(x["field"].alias("field"), status(d).alias("status"), h.alias("hub_value"), n.alias("n_papers"), d.alias("n_differ")))

    return F.transform(sides, one)


def compare(firsts: DataFrame, hub: tuple[str, ...] = ("declaration",), fields: tuple[str, ...] = CHECK_FIELDS, targets: tuple[str, ...] | None = None, same: object = None) -> DataFrame:
    """case_id, field, status, hub_value, n_papers, n_differ (compared) from firsts (case_id, seg, doc_type, canonical, value): one shuffle, by case."""
    wanted = firsts.filter(F.col("canonical").isin(*fields)).groupBy("case_id").agg(F.collect_list(F.struct("seg", "doc_type", "canonical", "value")).alias("values"))
    return opened(wanted.select("case_id", compared(F.col("values"), hub, fields, targets, same).alias("results")))


def opened(cases: DataFrame) -> DataFrame:
    """A row for each field of cases (case_id, results)."""
    return settled(cases).select("case_id", F.explode("results").alias("x")).select("case_id", "x.*")


def report_status(results: DataFrame) -> DataFrame:
    """case_id, status and counts: HIGH_RISK if a high-risk field differs, else MISMATCH, else MISSING (but for optional fields), else MATCH."""
    s = F.col("status")
    risk = F.bool_or(F.col("field").isin(*HIGH_RISK) & (s == "MISMATCH"))
    status = F.when(risk, "HIGH_RISK").when(F.bool_or(s == "MISMATCH"), "MISMATCH").when(F.bool_or((s == "MISSING") & ~F.col("field").isin(*OPTIONAL)), "MISSING").otherwise("MATCH")
    return results.groupBy("case_id").agg(status.alias("status"), *(F.count_if(s == x).alias(f"n_{x.lower()}") for x in ("MATCH", "MISMATCH", "MISSING")))


def status_of(results: Column) -> tuple[Column, Column]:
    """report_status() of an array of results, and how many differ: null where there is none."""
    some = lambda test: F.exists(results, lambda r: test(r["field"], r["status"]))
    risk, apart = some(lambda f, s: f.isin(*HIGH_RISK) & (s == "MISMATCH")), some(lambda f, s: s == "MISMATCH")
    lacks = some(lambda f, s: (s == "MISSING") & ~f.isin(*OPTIONAL))
    status = F.when(results.isNull(), None).when(risk, "HIGH_RISK").when(apart, "MISMATCH").when(lacks, "MISSING").otherwise("MATCH")
    return status, F.when(results.isNotNull(), F.size(F.filter(results, lambda r: r["status"] == "MISMATCH")).cast("long"))


def totals(fields: DataFrame) -> DataFrame:
    """case_id, canonical, doc_type, total: sums of the numbers in the values; null where there is none."""
    return fields.groupBy("case_id", "canonical", "doc_type").agg(F.sum(number(F.col("value"))).cast("decimal(38,2)").alias("total"))


def total_of(values: Column) -> Column:
    """The sum of the numbers in an array of texts; null where there is none."""
    numbers = F.filter(F.transform(values, number), lambda n: n.isNotNull())
    narrow = lambda n: n.try_cast("decimal(37,10)")  # noqa: E731 a sum of two has the type of decimal(38,10), without loss
    added = F.aggregate(numbers, F.lit(0).cast("decimal(38,10)"), lambda a, n: narrow(a) + narrow(n))
    return bound(numbers, lambda ns: F.when(F.size(ns) == 1, ns[0]).when(F.size(ns) > 1, added)).cast("decimal(38,2)")


def totals_of(items: Column) -> Column:
    """An array of doc_type, total of a field's values (an array): totals() in the row."""
    kinds = F.array_distinct(F.transform(items, lambda x: x["doc_type"]))
    return F.transform(kinds, lambda k: F.struct(k.alias("doc_type"), total_of(F.transform(F.filter(items, lambda x: x["doc_type"] == k), lambda x: x["value"])).alias("total")))


def agreed(cases: DataFrame) -> DataFrame:
    """consensus() of case_id, canonical, totals (totals_of): nothing is gathered."""
    found = cases.select("case_id", "canonical", F.explode(F.array(F.filter(F.transform("totals", lambda x: x["total"]), lambda x: x.isNotNull()))).alias("t")).filter(F.size("t") >= 2)
    n = F.size(F.array_distinct("t")).cast("long")
    return found.select("case_id", "canonical", F.size("t").cast("long").alias("n_types"), n.alias("n_totals"), F.when(n == 1, "match").otherwise("warning").alias("status"))


def consensus(totals: DataFrame) -> DataFrame:
    """case_id, canonical, status: match where two or more types have one total, warning where they differ; single types are left out."""
    found = totals.filter("total IS NOT NULL").groupBy("case_id", "canonical").agg(F.count("*").alias("n_types"), F.countDistinct("total").alias("n_totals"))
    return found.filter("n_types >= 2").select("case_id", "canonical", "n_types", "n_totals", F.when(F.col("n_totals") == 1, "match").otherwise("warning").alias("status"))


def superset(sets: DataFrame, given: str, wanted: str) -> DataFrame:
    """Adds complete and missing: whether the array `given` holds all of `wanted`, and what it lacks, sorted and comma-joined."""
    lacks = F.array_sort(F.array_except(wanted, given))
    return sets.withColumns({"complete": F.size(lacks) == 0, "missing": F.array_join(lacks, ",")})


def value_text(v: Column) -> Column:
    """The plain form of the export check: no commas, no case."""
    return F.lower(F.trim(F.replace(v, F.lit(","), F.lit(""))))
