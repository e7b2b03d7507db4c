"""Tables between steps, in shared storage or within a plan, and connected components by star steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new one where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quayside-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The rows of df, written once to shared storage: later steps read them, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote and nothing reads any more."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            remove(t.sparkSession, path)


def settled(df: DataFrame) -> DataFrame:
    """The same rows, with every column computed here, once: expressions that use it don't repeat what makes it."""
    return df.select(F.explode(F.array(F.struct("*"))).alias("row")).select("row.*")


def components(edges: DataFrame) -> DataFrame:
    """v, root: the smallest vertex that each vertex of edges (a, b; any ordered type, not null) reaches, itself included.

    Each round is a large star (every vertex hands the least of its neighbours and itself to its greater neighbours) and a small
    star (the same among its smaller ones). A round is written to shared storage and the one before it deleted; rounds grow with
    the square of the logarithm of the number of vertices at most.
    """
    own = cut(edges.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "vertices")
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        after = cut(small, "edges")
        dropped(now)
        now = after
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return own.join(now.select(F.col("u").alias("v"), F.col("v").alias("root")), "v", "left").select("v", F.coalesce("root", "v").alias("root"))
        before = state
