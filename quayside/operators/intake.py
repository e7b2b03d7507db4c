"""What a file is at first sight: nine kinds by terms, how sure a segment is, evidence kinds, messages that are safe to show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.normalize import collapse

#: Kind, its score in hundredths, its terms; the first term in the header counts once more.
KINDS = (
    ("declaration", 78, ("報單", "進口報單", "出口報單", "海關報單", "DECLARATION", "DS2")),
    ("invoice", 76, ("COMMERCIAL INVOICE", "INVOICE", "INV NO", "INVOICE NO", "發票")),
    ("packing", 72, ("PACKING LIST", "PACKING", "P/L", "PACKAGE", "CTNS", "裝箱單", "裝箱明細")),
    ("bl", 78, ("BILL OF LADING", "B/L", "BL NO", "LADING", "提單")),
    ("so", 74, ("SHIPPING ORDER", "S/O", "BOOKING CONFIRMATION", "BOOKING NO", "訂艙", "定倉")),
    ("clearance_list", 72, ("清表", "資料清表", "用料清表", "MATERIAL LIST", "MATERIAL CLEARANCE")),
    ("drawback_standard", 74, ("核退標準", "核退清表", "DRAWBACK STANDARD", "退稅標準")),
    ("tax_sheet", 70, ("稅單", "稅額", "進口稅", "TAX", "DUTY", "DUTY MEMO")),
    ("arrival_notice", 70, ("ARRIVAL NOTICE", "到貨通知", "抵港通知")),
)
DOC_TYPES = {"packing": "packing_list", "bl": "bill_of_lading", "so": "shipping_order", "drawback_standard": "drawback_clearance"}
IMAGES = (".jpg", ".jpeg", ".png", ".tif", ".tiff")
HEADER_LINES = 8
#: The words of a source's name that tell its kind, in the order in which they are tried.
EVIDENCE = (
    ("invoice", ("inv", "發票")),
    ("packing", ("pack", "pkg", "裝箱", "包裝")),
    ("arrival_notice", ("arrival", "到貨", "抵港")),
    ("delivery_order", ("d/o", "delivery order", "提貨")),
    ("manifest", ("manifest", "艙單", "倉單")),
    ("shipping_order", ("s/o", "shipping order")),
    ("booking", ("booking", "訂艙")),
    ("bl", ("b/l", "bl", "lading", "提單")),
    ("declaration", ("ds2", "declaration", "報單")),
    ("tax_sheet", ("稅單", "tax", "duty")),
    ("drawback_standard", ("核退",)),
    ("material_clearance", ("用料",)),
    ("clearance_list", ("清表",)),
)
#: Fields by category; all others are basic data.
CATEGORIES = (
    ("數量", ("quantity", "package_count", "unit")),
    ("重量", ("gross_weight", "net_weight")),
    ("金額", ("amount", "currency")),
    ("櫃封", ("container_no", "seal_no")),
    ("航運", ("port", "vessel_voyage", "origin")),
    ("稅則", ("hs_code",)),
)
BASIC = "基本資料"
#: Words of an error and what is shown for it; else the last.
MESSAGES = (
    (("tesseract", "ocr 辨識元件"), "此文件可能為掃描 PDF，系統目前缺少 OCR 辨識元件，請安裝 Tesseract 或改用可搜尋 PDF。"),
    (("timeout", "逾時"), "OCR 辨識逾時，請改用較清楚的掃描檔或可搜尋 PDF。"),
    (("pdf", "讀取失敗"), "PDF 讀取未完成，請確認檔案是否可開啟，或改用可搜尋 PDF。"),
)
OTHER_MESSAGE = "OCR 尚未取得足夠文字，請人工確認或提供較清楚的文件。"


def holds(v: Column, terms: tuple[str, ...]) -> Column:
    return F.exists(F.array(*(F.lit(t.lower()) for t in terms)), lambda t: F.contains(v, t))


def first_of(v: Column, rules: tuple[tuple[str, tuple[str, ...]], ...], other: Column) -> Column:
    """The name of the first rule of which the text, in lower case, holds a term."""
    v = F.lower(F.coalesce(v, F.lit("")))
    return F.coalesce(*(F.when(holds(v, terms), name) for name, terms in rules), other)


def classified(docs: DataFrame, keys: list[str], text: str = "text", name: str = "file") -> DataFrame:
    """keys, kind, doc_type, score (hundredths), warnings. A null text is an empty one; of equal scores the first kind stands."""
    t = F.coalesce(text, F.lit(""))
    each = docs.select(*keys, t.alias("_t"), F.coalesce(F.lower(name), F.lit("")).alias("_f"), F.lower(collapse(t)).alias("_n"), F.lower(collapse(F.array_join(F.slice(F.split(t, "\n", -1), 1, HEADER_LINES), "\n"))).alias("_h"))

    def score(base: int, terms: tuple[str, ...]) -> Column:
        hits = F.filter(F.array(*(F.lit(x.lower()) for x in terms)), lambda x: F.contains("_n", x))
        more = F.when(F.exists(hits, lambda x: F.contains("_h", x)), 8).otherwise(0) + F.when(F.contains("_h", F.lit(terms[0].lower())), 8).otherwise(0)
        return F.when(F.size(hits) > 0, F.least(F.lit(98), base + F.least(F.lit(18), 4 * (F.size(hits) - 1)) + more))

    scored = F.array_compact(F.array(*(F.when(score(b, x).isNotNull(), F.struct(score(b, x).alias("score"), F.lit(-i).alias("o"), F.lit(k).alias("kind"))) for i, (k, b, x) in enumerate(KINDS))))
    blank = F.trim("_n") == ""
    best = each.withColumn("_b", F.array_max(scored))
    image = F.regexp_extract("_f", r"(\.[a-z0-9]+)$", 1).isin(*IMAGES)
    kind = F.coalesce("_b.kind", F.when(image, "image_scan").otherwise("unknown"))
    sure = F.coalesce("_b.score", F.when(blank, 0).otherwise(35))
    found = best.select(*keys, kind.alias("kind"), sure.cast("long").alias("score"), F.concat_ws("; ", F.when(sure < 55, "low classification confidence"), F.when(blank, "no extracted text")).alias("warnings"))
    return found.withColumn("doc_type", F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in DOC_TYPES.items() for x in p)), F.col("kind")), F.col("kind")))


def segment_confidence(kind: Column, text: Column) -> Column:
    """Hundredths: none for a blank text, little for an unknown kind."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", 0).when(kind == "unknown", 30).otherwise(75)


def effective_type(parsed: Column, detected: Column, candidate: Column, sure: Column) -> Column:
    """The parsed kind, else the detected one, else a candidate that is sure enough (a boolean), else unknown."""
    known = lambda c: F.when(c != "unknown", c)
    return F.coalesce(known(parsed), known(detected), F.when(sure, candidate), F.lit("unknown"))


def evidence_kind(source: Column) -> Column:
    return first_of(source, EVIDENCE, F.lit(""))


def category(field: Column) -> Column:
    return F.coalesce(*(F.when(field.isin(*names), c) for c, names in CATEGORIES), F.lit(BASIC))


def safe_message(error: Column) -> Column:
    return first_of(error, tuple((m, words) for words, m in MESSAGES), F.lit(OTHER_MESSAGE))
