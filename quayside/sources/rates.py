"""Rates and freight settings from nested files, in versions that hold from a day on; a case takes the version of its own date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.sources.store import commit, committed

RATES = "ref string, valid_from date, rates map<string,string>"
#: Rows of a table of versions up to which each task may hold it.
BROADCAST_ROWS = 100_000


def read_nested(spark: SparkSession, paths: list[str], valid_from: str) -> DataFrame:
    """ref, valid_from, rates of files of the shape {"rate_tables": {ref: {name: value}}}. A file without tables gives no rows; a table
    that is no object is left out."""
    text = spark.read.text(paths, wholetext=True)
    tables = F.from_json(F.get_json_object(F.regexp_replace("value", "^\\uFEFF", ""), "$.rate_tables"), "map<string,string>")
    each = text.select(F.explode(tables).alias("ref", "said")).filter(F.startswith(F.trim("said"), F.lit("{")))
    return each.select("ref", F.lit(valid_from).cast("date").alias("valid_from"), F.from_json("said", "map<string,string>").alias("rates"))


def publish(spark: SparkSession, root: str, name: str, rates: DataFrame) -> None:
    """Writes a version (ref, valid_from, rates) and then its commit; readers see it whole or not at all. The same name again replaces it."""
    rates.select("ref", "valid_from", "rates").write.mode("overwrite").parquet(f"{root}/rates/{name}")
    commit(spark, root, name)


def published(spark: SparkSession, root: str) -> DataFrame:
    """The rates of all committed versions. Of two with one ref and day the later version's count."""
    names = committed(spark, root)
    if not names:
        return spark.createDataFrame([], RATES)
    found = spark.read.schema(RATES).parquet(*(f"{root}/rates/{n}" for n in names))
    version = F.regexp_extract(F.col("_metadata.file_path"), r"/rates/([^/]*)/[^/]*$", 1)
    return found.select("*", version.alias("version")).groupBy("ref", "valid_from").agg(F.max_by("rates", "version").alias("rates"))


def as_of(cases: DataFrame, rates: DataFrame, ref: str = "ref", date: str = "date") -> DataFrame:
    """cases with valid_from and rates: of the case's ref the version with the latest day that is not after its date; null where none is.

    The versions of a ref are one row, sorted, so a ref that many cases share costs each of them a look-up and no more. The rows are
    broadcast where the table of versions is small; beyond, Spark joins by shuffle."""
    each = F.struct("valid_from", F.to_json("rates").alias("rates"))  # maps don't sort
    versions = rates.groupBy(F.col("ref").alias("_ref")).agg(F.array_sort(F.collect_list(each)).alias("_versions"))
    if rates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        versions = F.broadcast(versions)
    held: Column = F.filter("_versions", lambda v: v["valid_from"] <= F.col(date).cast("date"))
    joined = cases.join(versions, cases[ref] == F.col("_ref"), "left").withColumn("_own", F.try_element_at(held, F.lit(-1)))
    return joined.select(*(cases[c] for c in cases.columns), F.col("_own.valid_from").alias("valid_from"), F.from_json("_own.rates", "map<string,string>").alias("rates"))
