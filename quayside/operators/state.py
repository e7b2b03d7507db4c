"""Where a case stands: confidence, workflow state, whether it may be declared, unresolved keys, section states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW_CONFIDENCE = 0.65


def case_confidence(papers: DataFrame) -> DataFrame:
    """case_id, mean, least, low: papers below LOW_CONFIDENCE, in order."""
    low = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("confidence") < LOW_CONFIDENCE, F.struct("seg", "doc_type")))), lambda x: x["doc_type"]), ",")
    return papers.groupBy("case_id").agg(F.round(F.avg("confidence"), 4).alias("mean"), F.min("confidence").alias("least"), low.alias("low"))


def workflow_state() -> Column:
    """From least, has_bl, has_declaration, n_missing, report_status, n_findings; the first that holds."""
    status = F.col("report_status")
    return (
        F.when(F.col("least") < LOW_CONFIDENCE, "NEEDS_HUMAN_REVIEW")
        .when(~F.col("has_bl"), "WAITING_BL")
        .when(~F.col("has_declaration"), "WAITING_DECLARATION")
        .when(F.col("n_missing") > 0, "PARTIAL_DOCUMENTS")
        .when(status.isNull(), "PENDING")
        .when((status == "MATCH") & (F.col("n_findings") == 0), "AUDIT_COMPLETED")
        .when(status.isin("MATCH", "MISSING"), "READY_FOR_AUDIT")
        .otherwise("NEEDS_HUMAN_REVIEW")
    )


def can_declare() -> Column:
    return F.col("state").isin("READY_FOR_AUDIT", "AUDIT_COMPLETED") & (F.col("n_missing") == 0) & (F.col("n_mismatch") == 0) & (F.col("report_status") != "HIGH_RISK")


def case_status() -> Column:
    return F.when(F.col("report_status").isin("HIGH_RISK", "MISMATCH"), "EXCEPTION").when(F.col("n_missing") > 0, "MISSING_DOCUMENTS").otherwise("COMPLETE")


def unresolved(keys: DataFrame, required: tuple[str, ...] = ("invoice_no", "bl_no", "booking_no", "container_no")) -> DataFrame:
    """case_id, unresolved: required keys that no paper of the case has; a case of one paper adds cross_document_match."""
    each = keys.groupBy("case_id").agg(F.collect_set("key").alias("have"), F.countDistinct("seg").alias("n"))
    lacks = F.filter(F.array(*map(F.lit, required)), lambda k: ~F.array_contains("have", k))
    return each.select("case_id", F.array_join(F.when(F.col("n") == 1, F.concat(lacks, F.array(F.lit("cross_document_match")))).otherwise(lacks), ",").alias("unresolved"))


def section_status(results: DataFrame, sections: tuple[tuple[str, tuple[str, ...]], ...]) -> DataFrame:
    """case_id, section, state: issue over missing over done; unchecked where none of a section's fields was looked at."""
    of = F.create_map(*(x for name, fields in sections for f in fields for x in (F.lit(f), F.lit(name))))
    s = F.col("status")
    rows = results.withColumn("section", F.element_at(of, F.col("field"))).filter("section IS NOT NULL")
    state = F.when(F.bool_or(s.isin("MISMATCH", "HIGH_RISK")), "issue").when(F.bool_or((s == "MISSING") & (F.col("n_papers") + F.when(F.col("hub_value").isNotNull(), 1).otherwise(0) > 0)), "missing").when(F.bool_or(s == "MATCH"), "done").otherwise("unchecked")
    return rows.groupBy("case_id", "section").agg(state.alias("state"))
