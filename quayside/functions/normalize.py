"""Normal forms of numbers, quantities, weights, money, identifiers and texts, as a broker compares them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(38,10)"
#: In capitals all that is neither a letter nor a digit; Java takes far longer over negated classes of several ranges.
NOT_CAPITAL = r"[\W_]+"
NUMBER = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"
#: Package units that mean the same.
PACKAGE_UNITS = {
    "BLE": "BALES", "BALE": "BALES", "CTN": "CTNS", "CARTON": "CTNS", "CARTONS": "CTNS", "PKG": "PKGS",
    "PACKAGE": "PKGS", "PACKAGES": "PKGS", "PCE": "PCS", "PC": "PCS",
}
#: Currencies; RMB is written CNY.
CURRENCIES = ("USD", "TWD", "NTD", "EUR", "JPY", "CNY", "RMB", "GBP", "HKD")
MONEY_FIELDS = ("amount", "cif", "fob", "freight", "insurance", "duty_amount", "customs_value", "trade_promotion_fee", "business_tax")
ID_FIELDS = ("invoice_no", "bl_no", "booking_no", "shipping_order_no", "container_no", "seal_no")
SHIP_FIELDS = ("vessel_voyage", "vessel", "voyage", "port", "pol", "pod")


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once for each row, however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def null_if_empty(v: Column) -> Column:
    return F.nullif(F.trim(v), F.lit(""))


def collapse(v: Column) -> Column:
    return F.trim(F.regexp_replace(v, r"(?U)\s+", " "))


def number(v: Column) -> Column:
    """The first number of a text, without thousands separators; null where there is none."""
    return _plain_number(F.regexp_extract(v, NUMBER, 0))


def _plain_number(v: Column) -> Column:
    return F.replace(v, F.lit(","), F.lit("")).try_cast(DECIMAL)


def format_number(x: Column) -> Column:
    return F.regexp_replace(F.format_number(x, 6), r"\.?0+$", "")


def unit_name(unit: Column) -> Column:
    out = unit
    for a, b in PACKAGE_UNITS.items():
        out = F.when(unit == a, b).otherwise(out)
    return out


def _shape(value: Column, numeric: Column, unit: Column) -> Column:
    return F.struct(value.alias("value"), numeric.cast(DECIMAL).alias("numeric"), unit.cast("string").alias("unit"))


def _measured(v: Column, letters: str, use: Callable[[Column, Column], Column]) -> Column:
    """use(n, unit): the first number of a text in capitals and the letters after it."""
    pattern = rf"({NUMBER})\s*([A-Z]{{{letters}}})?"
    found = lambda up: F.struct(_plain_number(F.regexp_extract(up, pattern, 1)).alias("n"), F.regexp_extract(up, pattern, 2).alias("unit"))
    return bound(bound(F.upper(v), found), lambda x: use(x["n"], x["unit"]))


def _counted(v: Column, use: Callable[[Column, Column], Column]) -> Column:
    return _measured(v, "2,10", lambda n, unit: bound(unit_name(unit), lambda u: use(n, u)))


def _weighed(v: Column, use: Callable[[Column, Column], Column]) -> Column:
    def kilos(n: Column, written: Column) -> Column:
        given = F.coalesce(F.nullif(written, F.lit("")), F.lit("KGS"))
        kg = F.when(given.isin("MT", "MTS", "TON", "TONS"), (n * 1000).cast(DECIMAL)).otherwise(n)
        unit = F.when(given.isin("MT", "MTS", "TON", "TONS", "KG", "KGS", "KGM"), "KGS").otherwise(given)
        return bound(F.struct(kg.alias("n"), unit.alias("unit")), lambda x: use(x["n"], x["unit"]))

    return _measured(v, "2,5", kilos)


def quantity(v: Column) -> Column:
    """value, numeric, unit of a count: `97 BLE` and `97 BALES` are one."""
    return _counted(v, lambda n, unit: _shape(F.when(n.isNull(), F.upper(collapse(v))).otherwise(F.trim(F.concat_ws(" ", format_number(n), unit))), n, F.when(n.isNotNull(), unit).otherwise("")))


def weight(v: Column) -> Column:
    """value, numeric, unit of a weight in kilograms where the unit is known: tons count a thousand, no unit is kilograms."""
    return _weighed(v, lambda n, unit: _shape(F.when(n.isNull(), F.upper(collapse(v))).otherwise(F.concat_ws(" ", format_number(n), unit)), n, F.when(n.isNotNull(), unit).otherwise("")))


def currency(v: Column) -> Column:
    codes = "|".join(CURRENCIES)

    def read(up: Column) -> Column:
        # no small letter is left, so that \W is all but capitals, digits and _
        found, compact = F.regexp_extract(up, rf"(?:^|\W)({codes})(?:$|\W)", 1), F.regexp_extract(F.trim(up), rf"^({codes})[0-9]", 1)
        return bound(bound(found, lambda x: F.when(x != "", x).otherwise(compact)), lambda x: F.when(x == "RMB", "CNY").otherwise(x))

    return bound(F.upper(v), read)


def money(v: Column) -> Column:
    """value, numeric and an empty unit: amounts are compared whatever their currency; currency() has that."""
    return bound(number(v), lambda n: _shape(F.when(n.isNull(), F.upper(F.trim(v))).otherwise(F.trim(F.concat_ws(" ", currency(v), format_number(n)))), n, F.lit("")))


def repair_identifier(v: Column) -> Column:
    """O beside a digit is 0, I and L beside a digit are 1; from left to right, so that a repaired character counts as a digit for the next."""

    def step(acc: Column, i: Column) -> Column:
        c = v.substr(i, F.lit(1))
        near = F.right(acc, F.lit(1)).rlike("^[0-9]$") | v.substr(i + 1, F.lit(1)).rlike("^[0-9]$")
        return F.concat(acc, F.when(near & (c == "O"), "0").when(near & c.isin("I", "L"), "1").otherwise(c))

    # where no O, I or L stands beside a digit there is nothing to repair
    return F.when(~v.rlike("[OIL][0-9]|[0-9][OIL]"), v).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(v), F.lit(1))), F.lit(""), step))


def identifier(v: Column) -> Column:
    return bound(F.regexp_replace(F.upper(v), NOT_CAPITAL, ""), repair_identifier)


def hs_code(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def shipping(v: Column) -> Column:
    return F.regexp_replace(F.upper(v), NOT_CAPITAL, "")


def incoterm(v: Column) -> Column:
    found = F.regexp_extract(F.upper(v), r"\b(FOB|CIF|CFR|CNF|EXW|DAP|DDP)\b", 1)
    return F.when(found != "", found).otherwise(F.upper(F.trim(v)))


def container_digits(v: Column) -> Column:
    return F.regexp_replace(F.translate(F.upper(v), "?OILSG", "701158"), "[^0-9]", "")


def classifier_text(v: Column) -> Column:
    return collapse(F.lower(F.translate(v, "：﹕／", "::/")))


def matcher_text(v: Column) -> Column:
    t = F.translate(v, "　：－–—", " :---")
    for a, b in ((r"[ \t]+", " "), (r"\s*/\s*", "/"), (r"\s*-\s*", "-")):
        t = F.regexp_replace(t, a, b)
    return F.upper(t)


def bare_key(v: Column) -> Column:
    return F.regexp_replace(matcher_text(v), r"[^A-Z0-9/\-.]", "")


def vessel_alias(t: Column) -> Column:
    for a, b in (("VOYAGE", "VOY"), ("VOY.", "VOY"), ("V.", "VOY"), ("VSL", "VESSEL")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def match_key(v: Column, kind: str) -> Column:
    t = bare_key(v)
    if kind in ("invoice_no", "bl_no", "booking_no", "shipping_order_no", "container_no", "container_suffix", "vessel_voyage"):
        t = repair_identifier(t)
    return vessel_alias(t) if kind == "vessel_voyage" else t


def _rate(v: Column) -> Column:
    return bound(number(v), lambda n: _shape(F.when(n.isNull(), F.trim(v)).otherwise(format_number(n)), n, F.lit("")))


def _written(field: Column, v: Column) -> Column:
    """The normal form of a field that is neither counted, weighed, money nor a rate."""
    return (
        F.when(field.isin(*ID_FIELDS), identifier(v))
        .when(field == "hs_code", hs_code(v))
        .when(field.isin(*SHIP_FIELDS), shipping(v))
        .when(field == "incoterm", incoterm(v))
        .otherwise(F.lower(collapse(v)))
    )


def normalized(field: Column, v: Column) -> Column:
    """value, numeric, unit of a value, by the rule of its field."""
    return (
        F.when(field.isin("package_count", "quantity"), quantity(v))
        .when(field.isin("net_weight", "gross_weight"), weight(v))
        .when(field.isin(*MONEY_FIELDS), money(v))
        .when(field == "exchange_rate", _rate(v))
        .otherwise(_shape(_written(field, v), F.lit(None), F.lit("")))
    )


def equivalent(field: Column, a: Column, b: Column) -> Column:
    """Whether two normal forms (structs of normalized()) of a field agree; money and rates agree whatever their units."""
    both = a["numeric"].isNotNull() & b["numeric"].isNotNull()
    return F.when(both, (a["numeric"] == b["numeric"]) & ((a["unit"] == b["unit"]) | field.isin(*MONEY_FIELDS, "exchange_rate"))).otherwise(a["value"] == b["value"])


def alike(field: Column, a: Column, b: Column) -> Column:
    """equivalent() of the normal forms of two values of a field, whose texts are made only where one of them has no number."""

    def numbers(parts: Callable[[Column, Callable[[Column, Column], Column]], Column], form: Callable[[Column], Column]) -> Column:
        of = lambda v: parts(v, lambda n, unit: F.struct(n.cast(DECIMAL).alias("n"), unit.alias("unit")))
        texts = form(a)["value"] == form(b)["value"]
        return bound(F.struct(of(a).alias("a"), of(b).alias("b")), lambda x: F.when(F.isnotnull(x["a"]["n"]) & F.isnotnull(x["b"]["n"]), (x["a"]["n"] == x["b"]["n"]) & (x["a"]["unit"] == x["b"]["unit"])).otherwise(texts))

    plain = lambda v, use: use(number(v), F.lit(""))
    same = (
        F.when(field.isin("package_count", "quantity"), numbers(_counted, quantity))
        .when(field.isin("net_weight", "gross_weight"), numbers(_weighed, weight))
        .when(field.isin(*MONEY_FIELDS), numbers(plain, money))
        .when(field == "exchange_rate", numbers(plain, _rate))
        .otherwise(_written(field, a) == _written(field, b))
    )
    return F.coalesce(same, F.lit(False))


def variants(v: Column) -> Column:
    r = lambda x, a, b: F.replace(x, F.lit(a), F.lit(b))
    return F.array(v, r(v, "O", "0"), r(v, "0", "O"), r(r(v, "I", "1"), "L", "1"), r(v, "1", "I"))


def key_similarity(a: Column, b: Column) -> Column:
    """1 for equal keys, .92 if one reading of their ambiguous characters is equal, the share of the one that holds the other, else one minus the edit distance over the longer length."""
    la, lb = F.length(a), F.length(b)
    long, short = F.greatest(la, lb), F.least(la, lb)
    held = F.when(la <= lb, F.contains(b, a)).otherwise(F.contains(a, b))
    score = F.when(a == b, F.lit(1.0)).when(F.arrays_overlap(variants(a), variants(b)), F.lit(0.92)).when((short >= 5) & held, short / long).otherwise(1 - F.levenshtein(a, b) / F.greatest(long, F.lit(1)))
    return F.when((la == 0) | (lb == 0), F.lit(0.0)).otherwise(score)


def vessel_parts(v: Column) -> Column:
    """vessel, voyage: the first word with a digit is the voyage, the others are the vessel."""
    words = F.regexp_extract_all(F.upper(v), F.lit("([A-Z0-9]+)"), F.lit(1))
    voyage = F.get(F.filter(words, lambda w: w.rlike("[0-9]")), F.lit(0))
    at = F.array_position(words, voyage)
    rest = F.when(voyage.isNull(), words).otherwise(F.filter(words, lambda w, i: i + 1 != at))
    return F.struct(F.array_join(rest, " ").alias("vessel"), F.coalesce(voyage, F.lit("")).alias("voyage"))


def vessel_pending(a: Column, b: Column) -> Column:
    """Of vessel_parts of a declaration and another paper: the same vessel, but only one of them has a voyage."""
    return (a["vessel"] != "") & (a["vessel"] == b["vessel"]) & ((a["voyage"] != "") != (b["voyage"] != ""))


def report_vessel(v: Column) -> Column:
    """A vessel as reports compare it: without the words for vessel and voyage, letters and digits alone."""
    bare = F.regexp_replace(F.upper(v), r"\b(VESSEL|VOYAGE|VOY|VSL)\b", "")
    return F.regexp_replace(F.regexp_replace(bare, "船名|航次", ""), "[^A-Z0-9]", "")


def version_key(v: Column) -> Column:
    """A version as arrays that sort as versions do: numbers (three at least), 1 for a release or 0 before it, its numbers."""
    clean = F.regexp_replace(F.trim(v), "^[vV]", "")
    main, before = F.substring_index(clean, "-", 1), F.when(F.contains(clean, F.lit("-")), F.regexp_replace(clean, "^[^-]*-", ""))
    chunks = F.filter(F.split(main, r"\."), lambda x: x != "")
    numbers = F.transform(chunks, lambda x: F.coalesce(F.nullif(F.regexp_replace(x, "[^0-9]", ""), F.lit("")), F.lit("0")).cast("int"))
    full = F.concat(numbers, F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(3) - F.size(numbers))))
    rank = F.when(before.isNull(), 1).otherwise(0)
    return F.struct(full.alias("numbers"), rank.alias("rank"), F.when(before.isNull(), F.array().cast("array<int>")).otherwise(F.transform(F.regexp_extract_all(before, F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("int"))).alias("before"))
