"""Papers of export cases made from the orders: bookings and what is shipped under them. Expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.sources import synthetic

VESSEL = "concat('EVER ', cast(n % 50 as string), ' ', cast(n % 9 as string), 'W')"
#: A kind of paper, when a case has it, and its text; papers differ from the booking by the order's number.
PAPERS = (
    ("packing_list", "n % 5 <> 3", "concat('PACKING LIST\nPackages: ', cast(p as string), '\nGross Weight: ', cast(gw as string), ' KGS\nContainer No: ', box, case when n % 4 = 1 then '\nCBM: 12.5' else '' end)"),
    ("booking", "n % 8 <> 6", f"concat('BOOKING CONFIRMATION\nVessel Voyage: ', {VESSEL}, '\nPOL: KEELUNG\nPOD: HAIPHONG\nETD: 2024-06-1', cast(n % 10 as string), '\nContainer No: ', box, '\nPackages: ', cast(p as string), case when n % 6 = 1 then '' else concat('\nGross Weight: ', cast(gw as string), ' KGS') end, '\nCBM: 12.5')"),
    ("shipping_order", "n % 3 = 0", f"concat('SHIPPING ORDER\nVessel Voyage: ', {VESSEL}, 'X\nSeal No: S', cast(n as string))"),
    ("bill_of_lading", "n % 7 <> 2", f"concat('BILL OF LADING\nVessel Voyage: ', case when n % 11 = 4 then 'EVER OTHER' else lower({VESSEL}) end, '\nPOL: KEELUNG\nPOD: ', case when n % 13 = 5 then 'DANANG' else 'HaiPhong' end, '\nContainer No: ', box, '\nSeal No: S', cast(n as string), '\nETD: 2024-06-1', cast(n % 10 as string))"),
    ("export_declaration", "n % 9 <> 4", "concat('EXPORT DECLARATION\nPackages: ', cast(p + case when n % 10 = 7 then 1 else 0 end as string), '\nGross Weight: ', cast(gw as string), ' KGS\nCBM: 12.5')"),
    ("invoice", "n % 2 = 0", "concat('COMMERCIAL INVOICE\nPackages: 1\nPOD: NOWHERE')"),
)
SOURCE = "concat(cast(n as string), '-', kind, '.txt')"


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, seg, doc_type, source, text."""
    each = F.array_compact(F.array(*(F.when(F.expr(when), F.struct(F.lit(i).alias("seg"), F.lit(k).alias("kind"), F.expr(text).alias("text"))) for i, (k, when, text) in enumerate(PAPERS))))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df = synthetic.figures(spark, sf_dir).repartition(parts, "n").select("n", F.explode(each).alias("x")).select("n", "x.*")
    return df.select(F.col("n").alias("case_id"), "seg", F.col("kind").alias("doc_type"), F.expr(SOURCE).alias("source"), "text")


def _sql() -> str:
    parts = "\n  UNION ALL ".join(f"SELECT n, {i} AS seg, '{k}' AS kind, {text} AS text FROM figures WHERE {when}" for i, (k, when, text) in enumerate(PAPERS))
    return synthetic.SQL.split(",\npapers AS")[0] + f",\np0 AS (\n  {parts}),\npapers AS (SELECT n AS case_id, seg, kind AS doc_type, {SOURCE} AS source, text FROM p0)"


#: The same table for DuckDB, to stand in a WITH.
SQL = _sql()
