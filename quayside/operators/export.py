"""An export case: its booking against its other papers, field by field, and what is said of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.normalize import collapse

#: The papers that are compared, the fields in order, and the messages.
HUB = ("booking", "shipping_order", "booking_confirmation")
TARGETS = ("bill_of_lading", "packing_list", "packing_detail", "export_declaration")
FIELDS = ("vessel_voyage", "vessel", "voyage", "pol", "pod", "etd", "eta", "container_no", "seal_no", "package_count", "gross_weight", "cbm")
NO_HUB, NO_VALUE, NO_OTHER, DIFFERS, AGREES = "請上傳 Booking Confirmation、S/O 或 Shipping Order。", "定倉單缺少欄位", "比對文件缺少欄位", "定倉單與 {} 不一致", "一致"
SUMMARIES = {"HIGH_RISK": "缺少定倉單 / S/O / Booking，無法完成出口工作流核對。", "MISMATCH": "出口文件與定倉單存在不一致欄位。", "MISSING": "出口文件仍有欄位缺漏，需補文件或人工確認。", "MATCH": "出口文件與定倉單核對一致。"}


def plain(v: Column) -> Column:
    return collapse(F.lower(F.replace(v, F.lit(","), F.lit(""))))


def booking_results(papers: DataFrame, firsts: DataFrame) -> DataFrame:
    """case_id, place, field, status, hub_value, message of papers (case_id, seg, doc_type, source) and firsts (case_id, seg, canonical, value):
    the first paper that is a booking against every target that has the field; a case without one has no rows.

    Cases get one row for each field; the field's values meet there in one shuffle by case and field after the papers' own."""
    hub = papers.filter(F.col("doc_type").isin(*HUB)).groupBy("case_id").agg(F.min("seg").alias("_hub"))
    names = papers.select("case_id", "seg", "doc_type", "source")
    wanted = firsts.filter(F.col("canonical").isin(*FIELDS) & (F.col("value") != "")).select("case_id", "seg", F.col("canonical").alias("field"), "value", plain(F.col("value")).alias("n"))
    rows = wanted.join(names, ["case_id", "seg"]).filter(F.col("doc_type").isin(*HUB, *TARGETS)).join(hub, "case_id")
    own = F.max(F.when(F.col("seg") == F.col("_hub"), F.struct("value", "n")))
    other = F.array_sort(F.collect_list(F.when(F.col("doc_type").isin(*TARGETS), F.struct("seg", "source", "n"))))
    every = hub.select("case_id", F.explode(F.array(*map(F.lit, FIELDS))).alias("field"))
    met = every.join(rows.groupBy("case_id", "field").agg(own.alias("own"), other.alias("other")), ["case_id", "field"], "left")
    wrong = F.transform(F.filter("other", lambda x: x["n"] != F.col("own.n")), lambda x: x["source"])
    status = F.when(F.col("own").isNull() | (F.coalesce(F.size("other"), F.lit(0)) <= 0), "MISSING").when(F.size("wrong") > 0, "MISMATCH").otherwise("MATCH")
    before, after = DIFFERS.split("{}")
    told = F.when(F.col("own").isNull(), NO_VALUE).when(F.col("status") == "MISSING", NO_OTHER).when(F.col("status") == "MATCH", AGREES).otherwise(F.concat(F.lit(before), F.array_join("wrong", ", "), F.lit(after)))
    place = F.array_position(F.array(*map(F.lit, FIELDS)), F.col("field"))
    return met.withColumn("wrong", wrong).withColumn("status", status).select("case_id", place.cast("long").alias("place"), "field", "status", F.coalesce("own.value", F.lit("")).alias("hub_value"), F.concat("field", F.lit(": "), told).alias("message"))


def booking_report(papers: DataFrame, results: DataFrame) -> DataFrame:
    """case_id, status, summary, warnings: a row for each case of papers; without a booking HIGH_RISK, a difference before a lack."""
    rows = papers.select("case_id").distinct().join(results, "case_id", "left").groupBy("case_id").agg(
        F.when(F.count("status") == 0, "HIGH_RISK").when(F.bool_or(F.col("status") == "MISMATCH"), "MISMATCH").when(F.bool_or(F.col("status") != "MATCH"), "MISSING").otherwise("MATCH").alias("status"),
        F.array_sort(F.collect_list(F.when(F.col("status") != "MATCH", F.struct("place", "message")))).alias("w"),
    )
    summary = F.element_at(F.create_map(*(F.lit(x) for p in SUMMARIES.items() for x in p)), F.col("status"))
    warnings = F.when(F.col("status") == "HIGH_RISK", NO_HUB).otherwise(F.array_join(F.transform("w", lambda x: x["message"]), "\n"))
    return rows.select("case_id", "status", summary.alias("summary"), warnings.alias("warnings"))
