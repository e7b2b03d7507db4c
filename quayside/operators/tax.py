"""Formulas of customs value, fees and taxes, freight and insurance: a status for each rule, over one wide row for each case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.normalize import number
from quayside.operators.graph import settled

#: Rates and tolerances.
PROMOTION_RATE, BUSINESS_TAX_RATE = "0.0004", "0.05"
VALUE_TOLERANCE, FEE_TOLERANCE, TAX_TOLERANCE = 3, 2, 3
AMOUNTS = ("fob", "cif", "freight", "insurance", "exchange_rate", "customs_value", "trade_promotion_fee", "duty_amount", "business_tax")
TEXTS = ("hs_code", "duty_rate", "import_regulation", "mp1", "bsmi", "commodity_inspection")
#: Words that say there is none.
NONE_WORDS = ("N", "NO", "NONE", "無", "免", "-", "N/A")


def dec(v: str) -> Column:
    return F.lit(v).cast("decimal(18,6)")


def wide(fields: DataFrame, first_type: str = "declaration") -> DataFrame:
    """case_id and the first number (amounts) or text of each field; the declaration's papers come before the others."""
    order = F.struct((F.col("doc_type") != first_type).alias("late"), "seg", "ord")
    value, n = F.col("value"), number(F.col("value")).cast("decimal(18,6)")
    amounts = [F.min_by(F.when(F.col("canonical") == f, n), F.when((F.col("canonical") == f) & n.isNotNull(), order)).alias(f) for f in AMOUNTS]
    texts = [F.min_by(F.when(F.col("canonical") == f, value), F.when((F.col("canonical") == f) & (value != ""), order)).alias(f) for f in TEXTS]
    return fields.groupBy("case_id").agg(*amounts, *texts)


def wide_row(values: DataFrame, *more: str) -> DataFrame:
    """What wide() says, of batches.by_name(): a case's values come in its row, so nothing is sorted or shuffled. more: columns that stay."""
    numbers = lambda f: F.transform(f, lambda v: number(v).cast("decimal(18,6)"))
    amounts = [F.get(F.filter(numbers(f), lambda x: x.isNotNull()), F.lit(0)).alias(f) for f in AMOUNTS]
    return values.select("case_id", *amounts, *(F.get(F.filter(f, lambda x: x != ""), F.lit(0)).alias(f) for f in TEXTS), *more).transform(settled)


def whole(x: Column) -> Column:
    return F.round(x, 0).cast("decimal(18,6)")


def close(a: Column, b: Column, tolerance: Column | int | None = None) -> Column:
    most = F.greatest(dec("1"), (F.abs(a) * dec("0.005")).cast("decimal(18,6)")) if tolerance is None else F.lit(tolerance)
    return F.abs(a - b) <= most


def customs_base() -> Column:
    return F.coalesce("customs_value", whole(F.col("cif") * F.col("exchange_rate")))


def rules() -> dict[str, Column]:
    """Status of each rule: MATCH, MISMATCH, MISSING or PENDING."""
    fob, cif, freight, insurance, rate, value, fee, duty, vat = (F.col(c) for c in AMOUNTS)
    base = customs_base()
    verdict = lambda ok: F.when(ok, "MATCH").otherwise("MISMATCH")
    return {
        "cif_logic": F.when(cif.isNull() & fob.isNull(), "MISSING").when(cif < fob, "MISMATCH").when(F.isnull(fob + cif + freight + insurance), "PENDING").otherwise(verdict(close(fob + freight + insurance, cif))),
        "customs_value": F.when(value.isNull(), "MISSING").when(F.isnull(cif + rate), "PENDING").otherwise(verdict(close(whole(cif * rate), value, VALUE_TOLERANCE))),
        "trade_promotion_fee": F.when(fee.isNull(), "MISSING").when(base.isNull(), "PENDING").otherwise(verdict(close(whole(base * dec(PROMOTION_RATE)), fee, FEE_TOLERANCE))),
        "business_tax": F.when(vat.isNull(), "MISSING").when(base.isNull(), "PENDING").otherwise(verdict(close(whole((base + F.coalesce(duty, dec("0")) + F.coalesce(fee, dec("0"))).cast("decimal(18,6)") * dec(BUSINESS_TAX_RATE)), vat, TAX_TOLERANCE))),
        "duty_amount": F.when(duty.isNull(), "MISSING").when(base.isNull(), "PENDING").when(duty < 0, "MISMATCH").otherwise("MATCH"),
    }


def tokens(v: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.upper(F.coalesce(v, F.lit(""))), "[^A-Z0-9]+"), lambda x: x != ""))


def positive(v: Column) -> Column:
    return F.coalesce(~F.upper(F.trim(v)).isin(*NONE_WORDS) & (F.trim(v) != ""), F.lit(False))


def knowledge() -> dict[str, Column]:
    """Status of the tariff rules: HS code, duty rate, regulation, MP1 (PENDING where the regulation asks for it and it lacks), BSMI and inspection."""
    hs, duty, regulation, mp1, bsmi, inspection = (F.col(c) for c in TEXTS)
    context = hs.isNotNull() | duty.isNotNull() | regulation.isNotNull()
    return {
        "hs_code": F.when(hs.isNotNull(), "MATCH").otherwise("MISSING"),
        "duty_rate": F.when(duty.isNotNull(), "MATCH").when(hs.isNotNull(), "PENDING").otherwise("MISSING"),
        "import_regulation": F.when(regulation.isNotNull(), "MATCH").when(hs.isNotNull(), "PENDING").otherwise("MISSING"),
        "mp1": F.when(F.array_contains(tokens(regulation), "MP1") & ~positive(mp1), "PENDING").when(mp1.isNotNull(), "MATCH").when(context, "PENDING").otherwise("MISSING"),
        "bsmi": F.when(bsmi.isNotNull(), "MATCH").otherwise("PENDING"),
        "commodity_inspection": F.when(inspection.isNotNull(), "MATCH").otherwise("PENDING"),
    }


def evaluated(wide_rows: DataFrame, statuses: dict[str, Column]) -> DataFrame:
    """case_id, rule, status: a row for each rule."""
    each = F.array(*(F.struct(F.lit(k).alias("rule"), v.alias("status")) for k, v in statuses.items()))
    return wide_rows.select("case_id", F.explode(each).alias("x")).select("case_id", "x.*")


def freight_by_volume(cbm: Column, threshold: Column | int, low: Column | int, high: Column | int) -> Column:
    return F.when(cbm <= threshold, low).otherwise(high)


def insurance(amount: Column, rate: Column, multiplier: str = "1.1", least: int = 400) -> Column:
    """At least the minimum premium, half up to two places."""
    return F.round(F.greatest((amount * dec(multiplier)).cast("decimal(18,6)") * rate, F.lit(least).cast("decimal(18,6)")), 2).cast("decimal(18,2)")


def unit_price(amount: Column, quantity: Column) -> Column:
    return F.try_divide(amount, F.nullif(quantity, F.lit(0)))


def declared_against(expected: dict[str, tuple[Column, Column]]) -> Column:
    """An array of (item, declared, expected, status): equal to the cent, or missing."""
    one = lambda k, d, e: F.struct(F.lit(k).alias("item"), d.cast("decimal(18,2)").alias("declared"), e.cast("decimal(18,2)").alias("expected"), F.when(d.isNull(), "MISSING").when(F.round(d, 2) == F.round(e, 2), "MATCH").otherwise("MISMATCH").alias("status"))
    return F.array(*(one(k, d, e) for k, (d, e) in expected.items()))
