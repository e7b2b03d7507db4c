"""From texts to fields: lines, labels, identifiers; each field's first value. One row for each field found."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.normalize import bound

#: The words that name a field, in the order in which they are tried. A user's own table may take their place.
ALIASES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("quantity", ("qty", "quantity", "pcs", "數量")),
    ("package_count", ("packages", "package", "carton", "ctn", "件數", "箱數")),
    ("unit", ("unit", "uom", "單位")),
    ("item_no", ("item", "item no", "part no", "品號", "料號")),
    ("description", ("description", "goods", "commodity", "品名", "貨名")),
    ("gross_weight", ("gross weight", "g w", "gw", "毛重")),
    ("net_weight", ("net weight", "n w", "nw", "淨重")),
    ("amount", ("amount", "total amount", "total", "value", "金額")),
    ("currency", ("currency", "幣別")),
    ("hs_code", ("hs code", "hscode", "tariff", "稅則", "稅則號別")),
    ("port", ("port", "discharge port", "loading port", "港口", "卸貨港", "裝貨港")),
    ("container_no", ("container", "container no", "cntr no", "櫃號", "貨櫃號碼")),
    ("seal_no", ("seal", "seal no", "封條", "封條號碼")),
    ("vessel_voyage", ("vessel voyage", "vessel/voyage", "vessel", "voyage", "船名航次")),
    ("vessel", ("vessel", "vessel name", "船名")),
    ("voyage", ("voyage", "voy", "航次")),
    ("booking_no", ("booking no", "booking number", "booking#", "定倉號碼", "訂艙號碼")),
    ("shipping_order_no", ("s/o no", "so no", "shipping order no", "s/o", "裝貨單號")),
    ("declaration_no", ("declaration no", "entry no", "報單號碼", "報單號別")),
    ("invoice_no", ("invoice no", "invoice number", "inv no", "發票號碼", "發票編號")),
    ("bl_no", ("b/l no", "bl no", "bill of lading no", "提單號碼")),
    ("pol", ("pol", "port of loading", "loading port", "起運港", "裝貨港")),
    ("pod", ("pod", "port of discharge", "discharge port", "目的港", "卸貨港")),
    ("etd", ("etd", "estimated time of departure", "開航日")),
    ("eta", ("eta", "estimated time of arrival", "到港日")),
    ("cbm", ("cbm", "measurement", "m3", "材積")),
    ("carrier", ("carrier", "shipping line", "船公司")),
    ("forwarder", ("forwarder", "forwarding agent", "承攬", "貨代")),
    ("notify", ("notify", "notify party", "通知人")),
    ("origin", ("origin", "country of origin", "產地")),
    ("customer", ("customer", "buyer", "客戶", "買方")),
    ("supplier", ("supplier", "vendor", "shipper", "供應商", "賣方")),
    ("incoterm", ("incoterm", "trade term", "貿易條件", "交易條件")),
    ("cif", ("cif", "cif value", "cif amount", "完稅價格")),
    ("fob", ("fob", "fob value", "fob amount", "離岸價格")),
    ("freight", ("freight", "ocean freight", "運費")),
    ("insurance", ("insurance", "ins", "保費", "保險費")),
    ("exchange_rate", ("exchange rate", "ex rate", "rate", "匯率")),
    ("statistical_method", ("statistical method", "stat method", "統計方式", "統計單位")),
    ("duty_rate", ("duty rate", "tax rate", "tariff rate", "稅率")),
    ("duty_amount", ("duty", "tax", "duty amount", "稅額", "進口稅")),
    ("customs_value", ("customs value", "dutiable value", "完稅價格", "完稅價值", "海關完稅價格")),
    ("trade_promotion_fee", ("trade promotion fee", "推貿費", "推廣貿易服務費")),
    ("business_tax", ("business tax", "vat", "營業稅", "加值稅")),
    ("import_regulation", ("import regulation", "import requirements", "輸入規定", "輸入規定代號")),
    ("mp1", ("mp1", "mp 1", "mp-1", "mp1 規定")),
    ("bsmi", ("bsmi", "商品檢驗", "標準檢驗局", "商檢局")),
    ("commodity_inspection", ("commodity inspection", "inspection", "商檢", "檢驗方式", "商品檢驗")),
    ("closing_date", ("closing date", "cut off", "cutoff", "結關日")),
)
#: Identifiers by their look, in the order in which they are tried.
IDENTIFIERS: tuple[tuple[str, str], ...] = (
    ("invoice_no", r"\b(?:invoice|inv)\s*(?:no\.?|number|#)\s*[:\-]?\s*([A-Z0-9\-\/]+)"),
    ("declaration_no", r"\b(?:declaration|entry)\s*(?:no\.?|number|#)\s*[:\-]?\s*([A-Z0-9\-\/]+)"),
    ("bl_no", r"\b(?:b/l|bl|bill of lading)\s*(?:no\.?|number|#)?\s*[:\-]?\s*([A-Z0-9\-\/]+)"),
    ("booking_no", r"\b(?:booking|bkg)\s*(?:no\.?|number|#)?\s*[:\-]?\s*([A-Z0-9\-\/]+)"),
    ("shipping_order_no", r"\b(?:s/o|so|shipping order)\s*(?:no\.?|number|#)?\s*[:\-]?\s*([A-Z0-9\-\/]+)"),
    ("container_no", r"\b([A-Z]{4}\s*\d{7})\b"),
    ("incoterm", r"\b(FOB|CIF|CFR|CNF|EXW|DAP|DDP)\b"),
    ("exchange_rate", r"(?:exchange\s*rate|ex\s*rate|匯率)\s*[:：]?\s*([0-9]+(?:\.[0-9]+)?)"),
    ("hs_code", r"(?:\b(?:hs\s*code|hscode|tariff)|稅則(?:號別)?)\s*[:：]?\s*([0-9.\-]{6,14})"),
    ("seal_no", r"\b(?:seal)\s*(?:no\.?|number|#)?\s*[:\-]?\s*([A-Z0-9\-\/]+)"),
)
#: Words, one of which stands wherever an identifier's pattern holds (seven digits for a container); others are always tried.
LOOKS = {
    "invoice_no": ("inv",), "declaration_no": ("declaration", "entry"), "bl_no": ("b/l", "bl", "bill of lading"), "booking_no": ("booking", "bkg"),
    "shipping_order_no": ("s/o", "so", "shipping order"), "container_no": (), "exchange_rate": ("rate", "匯率"), "hs_code": ("hs", "tariff", "稅則"), "seal_no": ("seal",),
}
NOT_WORD = r"[^0-9a-zA-Z一-鿿]+"
#: The same in Java, whose negated classes of several ranges take a microsecond for each character.
NOT_WORD_JAVA = r"[\W_&&[^一-鿿]]+"


def plain_words(v: str) -> str:
    return re.sub(NOT_WORD, " ", v).strip().lower()


def constant(values: list[str]) -> Column:
    """An array of texts that is folded before the first row and costs one literal in the plan."""
    return F.split(F.lit("\n".join(values)), "\n")


def field_of(name: Column, rows: list[tuple[str, str]]) -> Column:
    """The first field (canonical, name) of this name, or null."""
    return F.get(constant([c for c, _ in rows]), (F.array_position(constant([n for _, n in rows]), name) - 1).cast("int"))


def label_words(v: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(v, NOT_WORD_JAVA, " ")))


def map_label(words: Column, aliases: tuple[tuple[str, tuple[str, ...]], ...] = ALIASES) -> Column:
    """The field that a label's words (label_words) name: an equal name, else the longest name that they hold; the first listed wins ties."""
    rows = [(c, plain_words(a)) for c, names in aliases for a in names if plain_words(a)]
    longest = constant(sorted((n for _, n in rows), key=lambda n: -len(n)))
    # an equal name is looked for among those of its length only
    sizes = [[r for r in rows if len(r[1]) == n] for n in range(max((len(n) for _, n in rows), default=0) + 1)]
    every = lambda k: F.get(F.array(*(constant([r[k] for r in own]) if own else F.lit(None).cast("array<string>") for own in sizes)), F.length(words))
    equal = F.get(every(0), (F.array_position(every(1), words) - 1).cast("int"))
    return F.coalesce(equal, field_of(F.get(F.filter(longest, lambda n: F.contains(words, n)), F.lit(0)), rows))


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' other columns, ord and raw: the lines that aren't blank, trimmed."""
    return docs.select(*(c for c in docs.columns if c != text), F.posexplode(F.split(text, r"\R", -1)).alias("ord", "raw")).withColumn("raw", F.trim("raw")).filter("raw <> ''")


def look(raw: Column, low: Column) -> Column:
    """canonical, value of the first identifier that a line looks to hold; low is the line in lower case. A pattern is tried where one of its words stands."""
    there = lambda c: (low.rlike("[0-9]{7}") if c == "container_no" else F.exists(constant(list(LOOKS[c])), lambda w: F.contains(low, w))) if c in LOOKS else F.lit(True)
    shown = lambda c: lambda x: F.when(x != "", F.struct(F.lit(c).alias("canonical"), x.alias("value")))
    return F.coalesce(*(F.when(there(c), bound(F.regexp_extract(raw, f"(?i){p}", 1), shown(c))) for c, p in IDENTIFIERS))


def fields_of(rows: Column, aliases: tuple[tuple[str, tuple[str, ...]], ...] = ALIASES) -> Column:
    """An array of ord, canonical, label, value, confidence for an array of lines (ord, raw): those in which a field is found.

    A label and value, a field's name inside the line, or an identifier's look, in this order. All of it stays in the row: what a
    paper or a case holds is never dealt out by line and gathered again.
    """
    names = [(c, a) for c, own in aliases for a in own]
    wide = r"^([A-Za-z一-鿿 ./_-]{2,35})\s{2,}(.+)$"

    def labelled(x: Column) -> Column:
        raw = x["raw"]
        first = F.when(F.contains(raw, F.lit(":")), ":").when(F.contains(raw, F.lit("：")), "：").when(F.contains(raw, F.lit("\t")), "\t")

        def split(y: Column) -> Column:
            at, spaced = y["at"], y["first"].isNull() & raw.rlike(wide)
            label = F.when(at > 1, F.left(raw, at - 1)).when(spaced, F.regexp_extract(raw, wide, 1))
            value = F.when(at > 1, raw.substr(at + 1, F.length(raw))).when(spaced, F.regexp_extract(raw, wide, 2))
            return F.struct(x["ord"].alias("ord"), raw.alias("raw"), label.alias("label"), F.trim(value).alias("value"))

        return bound(bound(first, lambda f: F.struct(f.alias("first"), F.coalesce(F.instr(raw, f), F.lit(0)).alias("at"))), split)

    def named(x: Column) -> Column:
        name = bound(label_words(x["label"]), lambda w: map_label(w, aliases))
        return F.struct(x["ord"].alias("ord"), x["raw"].alias("raw"), x["label"].alias("label"), x["value"].alias("value"), name.alias("name"))

    def field(x: Column, canonical: Column, label: Column, value: Column, confidence: float) -> Column:
        return F.struct(x["ord"].alias("ord"), canonical.alias("canonical"), label.alias("label"), value.alias("value"), F.lit(confidence).alias("confidence"))

    def unnamed(x: Column) -> Column:
        raw = x["raw"]

        def within(low: Column) -> Column:
            def without(name: Column) -> Column:
                at = F.position(name, low)
                return F.btrim(F.concat(F.left(raw, at - 1), raw.substr(at + F.length(name), F.length(raw))), F.lit(" :-："))

            inline = F.when(x["label"].isNull(), F.get(F.filter(constant([a for _, a in names]), lambda a: F.contains(low, a) & (without(a) != "")), F.lit(0)))
            held = lambda n: F.when(n.isNotNull(), field(x, field_of(n, names), n, without(n), 0.62))
            looks = lambda l: F.when(l.isNotNull(), field(x, l["canonical"], l["canonical"], F.trim(l["value"]), 0.72))
            return F.coalesce(bound(inline, held), bound(look(raw, low), looks))

        return bound(F.lower(raw), within)

    found = lambda x: F.when(x["name"].isNotNull(), field(x, x["name"], F.trim(x["label"]), x["value"], 0.78)).otherwise(unnamed(x))
    return F.array_compact(F.transform(F.transform(F.transform(rows, labelled), named), found))


def parsed(text: Column, aliases: tuple[tuple[str, tuple[str, ...]], ...] = ALIASES) -> Column:
    """The fields (fields_of) of a text's lines that aren't blank."""
    every = F.transform(F.split(text, r"\R", -1), lambda v, i: F.struct(i.alias("ord"), F.trim(v).alias("raw")))
    return F.coalesce(fields_of(F.filter(every, lambda x: x["raw"] != ""), aliases), F.array().cast("array<struct<ord:int,canonical:string,label:string,value:string,confidence:double>>"))


def parse_lines(rows: DataFrame, aliases: tuple[tuple[str, tuple[str, ...]], ...] = ALIASES) -> DataFrame:
    """Of lines(): canonical, label, value, confidence where a field is found (fields_of)."""
    kept = [c for c in rows.columns if c != "raw"]
    # outer: a filter on the size of the array would compute all of this twice
    found = rows.select(*kept, F.explode_outer(fields_of(F.array(F.struct(F.lit(0).alias("ord"), "raw")), aliases)).alias("_f")).filter("_f IS NOT NULL")
    return found.select(*kept, *(F.col(f"_f.{c}").alias(c) for c in ("canonical", "label", "value", "confidence")))


def firsts_of(fields: Column) -> Column:
    """Of an array of fields in order (canonical, value and others) each field's first whose value isn't empty."""
    first = lambda fs: bound(F.transform(fs, lambda f: f["canonical"]), lambda names: F.filter(fs, lambda f, i: F.array_position(names, f["canonical"]) == i + 1))
    return bound(F.filter(fields, lambda f: f["value"] != ""), first)


def first_values(fields: DataFrame, keys: list[str]) -> DataFrame:
    """keys, canonical, value: each field's first value that isn't empty."""
    return fields.filter("value <> ''").groupBy(*keys, "canonical").agg(F.min_by("value", "ord").alias("value"))
