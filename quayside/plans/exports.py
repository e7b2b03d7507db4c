"""Queries of export cases and of the reading by labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.operators import export, extract, labels
from quayside.sources import case_papers, export_papers

#: Papers as the reading by labels gets them; expressions that Spark and DuckDB read alike. Some values stand on the line below their label, some files aren't read.
LABELLED = {
    "kind": "case doc_type when 'invoice' then 'INV' when 'packing_list' then 'PKG' when 'bill_of_lading' then 'B/L' when 'declaration' then 'DS2' when 'manifest' then '倉單' when 'arrival_notice' then 'S/O' else doc_type end",
    "told": "case case_id % 4 when 1 then replace(text, 'Packages: ', concat('Packages :', chr(10), '  ')) when 2 then lower(text) when 3 then concat(replace(text, 'Weight: ', 'Weight：'), chr(10), 'GW # 7', chr(10), 'Cut off:', chr(13), 'Warehouse: :', chr(13), '倉庫: K2 ') else text end",
    "file": "concat('f', cast(seg as string), case when case_id % 50 = 7 then '.docx' when case_id % 50 = 8 then '' else '.TXT' end)",
}


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return case_papers.papers(spark, sf_dir).select("case_id", "seg", *(F.expr(v).alias(k) for k, v in LABELLED.items())).withColumnsRenamed({"kind": "doc_type", "told": "text", "file": "source"})


def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each paper's values behind the labels of its kind."""
    return labels.label_fields(labelled(spark, sf_dir)).select("case_id", "seg", "doc_type", "field", "value")


def label_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each paper, with its fields or its error."""
    return labels.read_papers(labelled(spark, sf_dir), ["case_id", "seg"]).withColumn("error", F.coalesce("error", F.lit("")))


def _export(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    papers = export_papers.papers(spark, sf_dir)
    firsts = extract.first_values(extract.parse_lines(extract.lines(papers.drop("source"))), ["case_id", "seg"])
    return papers.drop("text"), firsts


def booking_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The booking as hub, twelve fields, with what is said of each."""
    return export.booking_results(*_export(spark, sf_dir)).drop("place")


def booking_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers, firsts = _export(spark, sf_dir)
    return export.booking_report(papers, export.booking_results(papers, firsts))


def queries() -> dict:
    return {f.__name__: f for f in (label_values, label_papers, booking_compare, booking_report)}
