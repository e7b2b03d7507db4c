"""Line dedup: later copies of repeated runs of lines go, by a suffix array over line ids. Only DataFrame functions.

The corpus is a sequence of lines with a word, document after document by key. A line's id is the rank of its 128-bit hash among
the lines that occur twice or more; suffixes that begin with another line are unique already and take no further part. Prefix
doubling ranks the runs of 2, 4, 8, ... lines within documents: the pair (rank of the run, rank of the run that follows it),
counted over all machines; pairs that occur once are unique and leave, the others get their rank in the pairs' order. Ranks are
given by a range partitioning of the distinct pairs and so follow the order of suffixes; suffixes of one rank are an interval of
the suffix array whose longest common prefix is at least that run. Any run of n lines is told from others by two ranks, of the
runs of 2^k <= n lines at its begin and at its end.

A line goes if it lies in a run of at least MIN_WORDS words that has occurred before (earlier document, or earlier place in this
one). Such a run exists exactly if one of the shortest runs of MIN_WORDS words that begin or end at some line covers the line and
has occurred before; so those are looked up, at their first places. They have at most MIN_WORDS lines, which bounds the doubling.
The first copy of each line always stays. Maximal repeated runs are the covered lines that follow each other.

No window or group holds more than one document's lines; hot lines are counted by partial sums and joined by joins that Spark
can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quayside.llm.common import cut, dropped, joined_hot, text_or_empty, unused

MIN_WORDS = 10
WORD = r"\S+"  # ASCII white space parts words
DOC = ["k", "d"]  # key and hash of the text


def lines(docs: DataFrame, key: str, text: str, min_words: int) -> DataFrame:
    """k, d, i (place among lines with a word), line (place among all), h1, h2, f and b (lines of the shortest run of min_words that begins, ends here; null: none)."""
    t = text_or_empty(text)
    each = F.filter(F.transform(F.split(t, "\n", -1), lambda x, i: F.struct(i.alias("line"), x.alias("x"), F.regexp_count(x, F.lit(WORD)).alias("w"))), lambda x: x["w"] > 0)
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(t).alias("d"), F.transform(each, lambda x: F.struct(x["line"].alias("line"), F.xxhash64(x["x"]).alias("h1"), F.xxhash64(F.lit("2"), x["x"]).alias("h2"), x["w"].alias("w"))).alias("rows"))

    def shortest(i: Column, step: int) -> Column:
        held, out = F.lit(0), F.lit(None).cast("int")
        sums = []
        for n in range(min_words):
            held = held + F.get(F.col("rows"), i + step * n)["w"]
            sums.append(held)
        for n in range(min_words - 1, -1, -1):
            out = F.when(sums[n] >= min_words, n + 1).otherwise(out)
        return out

    full = F.transform("rows", lambda x, i: F.struct(i.alias("i"), x["line"].alias("line"), x["h1"].alias("h1"), x["h2"].alias("h2"), shortest(i, 1).alias("f"), shortest(i, -1).alias("b")))
    return rows.select("k", "d", F.explode(full).alias("x")).select("k", "d", "x.*")


def ranks(classes: DataFrame, by: list[str], name: str) -> DataFrame:
    """The rows with r, a number that follows the order of the columns `by`."""
    return cut(classes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("r", F.monotonically_increasing_id()), name)


def same_doc(a: DataFrame, b: DataFrame) -> Column:
    return a["k"].eqNullSafe(b["k"]) & (a["d"] == b["d"])


def rank_levels(rows: DataFrame, most: int) -> list[DataFrame]:
    """For 1, 2, 4, ... up to `most` lines: k, d, i, r of the runs that occur twice or more. The first level has all columns of rows."""
    repeated = rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    named = ranks(repeated, ["h1", "h2"], "line-ids")
    levels = [cut(rows.join(named, ["h1", "h2"]).drop("h1", "h2").dropDuplicates([*DOC, "i"]), "level")]
    long = 1
    while 2 * long <= most:
        there = Window.partitionBy(*DOC).orderBy("i").rangeBetween(long, long)
        pairs = levels[-1].select(*DOC, "i", F.col("r").alias("r1"), F.max("r").over(there).alias("r2")).filter("r2 IS NOT NULL")
        pairs = cut(pairs, "pairs")
        named = ranks(pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).filter("n > 1").select("r1", "r2"), ["r1", "r2"], "run-ids")
        levels.append(cut(pairs.join(named, ["r1", "r2"]).select(*DOC, "i", "r"), "level"))
        long *= 2
    return levels


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """k, d, line: the lines that go."""
    every = cut(lines(docs, key, text, min_words), "lines")
    levels = rank_levels(every, min_words)
    base = levels[0]
    ends = F.array(F.struct(F.col("i").alias("start"), F.col("f").alias("n")), F.struct((F.col("i") - F.col("b") + 1).alias("start"), F.col("b").alias("n")))
    wanted = base.select(*DOC, F.explode(F.array_distinct(F.filter(ends, lambda x: x["n"].isNotNull()))).alias("x")).select(*DOC, "x.start", "x.n").distinct()
    found = None
    for m, level in enumerate(levels):
        own = wanted.filter((F.col("n") >= 1 << m) & (F.col("n") < 2 << m))
        left, right = level.select(F.col("k").alias("k1"), F.col("d").alias("d1"), F.col("i").alias("i1"), F.col("r").alias("r1")), level.select(F.col("k").alias("k2"), F.col("d").alias("d2"), F.col("i").alias("i2"), F.col("r").alias("r2"))
        own = own.join(left, own["k"].eqNullSafe(left["k1"]) & (own["d"] == left["d1"]) & (own["start"] == left["i1"]))
        own = own.join(right, own["k"].eqNullSafe(right["k2"]) & (own["d"] == right["d2"]) & (own["start"] + own["n"] - (1 << m) == right["i2"])) if m else own.withColumn("r2", F.col("r1"))
        own = own.select(*DOC, "start", "n", "r1", "r2")
        found = own if found is None else found.unionByName(own)
    found = cut(found, "runs")
    place = F.struct("k", "d", "start")
    firsts = found.groupBy("n", "r1", "r2").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1")
    later = joined_hot(found, cut(firsts, "firsts"), ["n", "r1", "r2"], "times", found.count()).filter(place > F.col("first"))
    covered = later.select(*DOC, F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("i")).distinct()
    gone = covered.join(base.select(F.col("k").alias("k1"), F.col("d").alias("d1"), F.col("i").alias("i1"), "line"), covered["k"].eqNullSafe(F.col("k1")) & (covered["d"] == F.col("d1")) & (covered["i"] == F.col("i1"))).select(*DOC, "line")
    gone = cut(gone, "gone")
    dropped(docs.sparkSession, every, found, *levels)
    return gone


def deduped(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns of docs; in the text the lines that go are left out (an empty text may remain). Adds n_deleted.

    A null text stays null. Documents are in the order of their keys (nulls first), then of their texts' hashes; rows with the
    same key and text are one document and get the same text. Blank lines stay and don't part a run. An empty table gives no
    rows. A column n_deleted of docs is replaced; other names don't clash.
    """
    k, d, lost, hashed = unused(docs, "k", "d", "lost", "hashed")
    gone = repeated_lines(docs, key, text, min_words).groupBy(*DOC).agg(F.collect_set("line").alias(lost)).select(F.col("k").alias(k), F.col("d").alias(d), lost)
    marked = docs.withColumn(hashed, F.xxhash64(text_or_empty(text)))
    both = marked.join(gone, marked[key].eqNullSafe(gone[k]) & (marked[hashed] == gone[d]), "left")
    all_lines = F.split(text, "\n", -1)
    ends = F.array_sort(F.concat(F.array(F.lit(-1)), lost, F.array(F.size(all_lines))))
    # what stands between the lines that go, one slice each: a long text takes time in proportion to its lines
    kept = F.transform(F.slice(ends, 2, F.size(ends)), lambda e, j: F.slice(all_lines, F.get(ends, j) + 2, e - F.get(ends, j) - 1))
    kept = F.array_join(F.flatten(kept), "\n")
    given = [c for c in docs.columns if c != "n_deleted"]
    return both.select(*(both[c] if c != text else F.when(F.col(lost).isNull(), both[c]).otherwise(kept).alias(c) for c in given), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias("n_deleted"))
