"""Stores that grow: pages parsed once for each state of a file, and the history of checks as tables that are committed together.

A version is a folder; it counts once its commit is there, which is written last. A run that dies leaves a folder without commit,
which nobody reads and the next run overwrites.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.sources import files

STATE = "path string, mtime timestamp, size long, version long"
PAGES = "path string, page_no int, text string, needs_manual boolean, error string"
#: The tables of a check's history, and the columns of each beside its keys.
HISTORY = {
    "checks": "batch string, check_id string, created_at timestamp, mode string, summary string",
    "uploaded_documents": "batch string, check_id string, doc_type string, source_name string, stored_name string",
    "parsed_results": "batch string, check_id string, doc_type string, source_name string, fields_json string, error string",
    "check_items": "batch string, check_id string, status string, field string, message string, expected string, actual string",
}


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def committed(spark: SparkSession, root: str) -> list[str]:
    """The names of the versions or batches under root that are whole, in order: one entry for each commit, never rows."""
    fs, p = _fs(spark, f"{root}/commits")
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def commit(spark: SparkSession, root: str, name: str) -> None:
    fs, p = _fs(spark, f"{root}/commits/{name}")
    fs.create(p, True).close()


def parse_changed(spark: SparkSession, folder: str, root: str, parse: Callable[[DataFrame], DataFrame] = files.pages, recursive: bool = True) -> tuple[DataFrame, DataFrame]:
    """The pages of all files of a folder, of which only those that are new or changed since the last call are read and parsed; and
    path, change of this call.

    A file's state is its path, time and size; its pages stay in the version that parsed it, pages for manual review included.
    Pages of removed files are not given any more. The listing and the manifest meet in a join; contents are read for the files that it
    leaves over. Equal to parsing the whole folder.
    """
    versions = committed(spark, root)
    last = int(versions[-1]) if versions else -1
    was = spark.read.schema(STATE).parquet(f"{root}/manifests/{last:09d}") if versions else spark.createDataFrame([], STATE)
    now = files.scan(spark, folder, recursive, content=False).select("path", "mtime", "size")
    both = now.join(was.withColumnsRenamed({"mtime": "t", "size": "s"}), "path", "full")
    same = (F.col("mtime") == F.col("t")) & (F.col("size") == F.col("s"))
    change = F.when(F.col("version").isNull(), "added").when(F.col("mtime").isNull(), "removed").when(~same, "changed")
    told = both.select("path", "mtime", "size", F.when(same, F.col("version")).otherwise(F.lit(last + 1)).alias("version"), change.alias("change"))
    new = f"{last + 1:09d}"
    told.filter("mtime IS NOT NULL").select("path", "mtime", "size", "version").write.mode("overwrite").parquet(f"{root}/manifests/{new}")
    manifest = spark.read.schema(STATE).parquet(f"{root}/manifests/{new}")
    fresh = manifest.filter(F.col("version") == last + 1).select("path")
    read = files.scan(spark, folder, recursive).join(fresh, "path", "left_semi")
    parse(read).write.mode("overwrite").parquet(f"{root}/pages/version={last + 1}")
    gone = was.join(manifest.select("path"), "path", "left_anti").select("path", F.lit("removed").alias("change"))
    mine = fresh.join(was.select("path", F.lit("changed").alias("change")), "path", "left").select("path", F.coalesce("change", F.lit("added")).alias("change"))
    commit(spark, root, new)
    held = spark.read.schema(f"{PAGES}, version long").parquet(f"{root}/pages")
    return held.join(manifest.select("path", "version"), ["path", "version"]).drop("version"), mine.unionByName(gone)


def save(spark: SparkSession, root: str, batch: str, tables: dict[str, DataFrame]) -> None:
    """Writes a batch's rows of the four tables of HISTORY and then its commit. The same batch again takes the place of itself, so a
    batch that foreachBatch repeats is there once; readers never see a part of it."""
    for name, shape in HISTORY.items():
        columns = [c.split(" ")[0] for c in shape.split(", ")][1:]
        tables[name].select(*columns).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
    commit(spark, root, batch)


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the history: the rows of all committed batches."""
    batches = committed(spark, root)
    shape = HISTORY[name]
    if not batches:
        return spark.createDataFrame([], shape)
    found = spark.read.schema(shape).option("basePath", f"{root}/{name}").parquet(*(f"{root}/{name}/batch={b}" for b in batches))
    return found.select(*(c.split(" ")[0] for c in shape.split(", ")))


def history_tables(report: DataFrame, documents: DataFrame, parsed: DataFrame, batch: str, created_at: str, mode: str) -> dict[str, DataFrame]:
    """The four tables of a batch of checked cases: report (case_id, status, field, message, expected, actual), documents (case_id,
    doc_type, source_name, stored_name), parsed (case_id, doc_type, source_name, fields: a map, error). A case's check is named by batch
    and case; its summary counts its items by status."""
    keyed = lambda df: df.withColumn("check_id", F.concat_ws(":", F.lit(batch), F.col("case_id").cast("string")))
    counts = keyed(report).groupBy("check_id", "status").agg(F.count("*").alias("n")).groupBy("check_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("status"), F.lit(": "), F.col("n").cast("string")))), ", ").alias("summary"))
    cases = keyed(documents.select("case_id").unionByName(report.select("case_id")).distinct()).join(counts, "check_id", "left")
    checks = cases.select("check_id", F.lit(created_at).cast("timestamp").alias("created_at"), F.lit(mode).alias("mode"), F.coalesce("summary", F.lit("")).alias("summary"))
    fields = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("fields"))))
    return {"checks": checks, "uploaded_documents": keyed(documents), "parsed_results": keyed(parsed).withColumn("fields_json", F.coalesce(fields, F.lit("{}"))), "check_items": keyed(report)}
