"""Licence scan: ordered signature rules behind a keyword gate, overlaps settled by priority and containment.

Only DataFrame functions. One pass over the texts numbers the rows, counts words and stores the texts that pass the gate: those
that hold a rule's keyword, or all words of a base phrase. They are searched for the phrases, paired with the rules whose keyword
they hold, and searched for their matches. Of the matches, those that lie inside one of at least their own priority give way
(the wider, then the earlier rule, wins among equals). Matches belong to a row by its number, so rows may share a key.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import cut, text_or_empty
from quayside.llm.license_rules import Rule, rules

#: A character of a word, before A-Z are lower-cased, and what stands between words.
WORD = r"[\p{Alnum}\P{ASCII}]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrase and label; the places where a phrase's words stand one after the other are the base of the result.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

def phrase_regex(phrase: str) -> str:
    return rf"(?i)(?<!{WORD}){GAP.join(phrase.split(' '))}(?!{WORD})"


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD + "+")).cast("long")


def gated(low: Column, signatures: list[Rule], phrases: bool = True) -> Column:
    """Whether a text in lower case may hold a rule's match, by the rules' own keywords, or a phrase's."""
    keywords = {r.keyword for r in signatures}
    if "" in keywords:  # a rule without a keyword is tried on every text
        return F.lit(True)
    least = sorted(k for k in keywords if not any(j != k and j in k for j in keywords))
    some = [F.contains(low, F.lit(k)) for k in least]
    if phrases:
        some += [reduce(and_, (F.contains(low, F.lit(w)) for w in p.split(" "))) for p, _ in BASE]
    return reduce(or_, some, F.lit(False))


def base_places(text: Column, low: Column) -> Column:
    """For each phrase the number of places, and the words before the first and the last of them. low: the text in lower case."""

    def one(phrase: str, label: str) -> Column:
        there = reduce(and_, (F.contains(low, F.lit(w)) for w in phrase.split(" ")))
        parts = F.transform(F.split(text, phrase_regex(phrase), -1), words)
        n, long = F.size(parts).cast("long") - 1, len(phrase.split(" "))
        before_last = F.aggregate(F.slice(parts, 1, F.greatest(n, F.lit(1)).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.when(there, F.struct(F.lit(label).alias("label"), n.alias("n"), parts[0].alias("first"), (before_last + (n - 1) * long).alias("last")))

    return F.filter(F.array(*(one(*x) for x in BASE)), lambda x: x["n"] > 0)


def detections(docs: DataFrame, signatures: list[Rule] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All matches that stand: key, rule_id, label, priority, confidence, start, end (code points, end exclusive).

    Rows that share a key are matched each by its own text. A null or empty text has none; columns besides key and text don't matter.
    """
    signatures = rules() if signatures is None else signatures
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    held = cut(rows.filter(gated(F.lower("t"), signatures, phrases=False)).withColumn("row", F.monotonically_increasing_id()), "licences")
    return held.select("row", "k").join(standing(held, signatures), "row").drop("row").withColumnRenamed("k", key)


def standing(held: DataFrame, signatures: list[Rule]) -> DataFrame:
    """row, rule_id, label, priority, confidence, start, end of the matches in texts t that stand; rows are told apart by their number."""
    kind = "array<struct<rule_id:int,label:string,priority:int,keyword:string,pattern:string,confidence:double>>"
    table = F.from_json(F.lit(json.dumps([r._asdict() | {"pattern": f"(?i){r.pattern}"} for r in signatures])), kind)
    tried = held.withColumn("low", F.lower("t")).select("row", "t", F.explode(F.filter(table, lambda r: F.contains(F.col("low"), r["keyword"]))).alias("r"))
    hits = tried.select("row", "r.*", F.transform(F.regexp_extract_all("t", F.col("r.pattern"), F.lit(0)), F.length).alias("long"), F.split("t", F.col("r.pattern"), -1).alias("parts")).filter(F.size("long") > 0)
    # start of a match: all that stands before it, parts and matches, summed in the order of the text
    pieces = F.transform(F.col("long"), lambda n, i: F.struct(F.length(F.get(F.col("parts"), i)).alias("before"), n.alias("n")))
    placed = hits.select("row", "rule_id", "label", "priority", "confidence", F.posexplode(pieces).alias("at", "x"))
    so_far = Window.partitionBy("row", "rule_id").orderBy("at")
    spans = placed.withColumn("end", F.sum(F.col("x.before") + F.col("x.n")).over(so_far)).withColumn("start", F.col("end") - F.col("x.n")).filter("end > start")
    earlier = Window.partitionBy("row").orderBy("start", F.desc("end"), F.desc("priority"), "rule_id").rowsBetween(Window.unboundedPreceding, -1)
    levels = sorted({r.priority for r in signatures})
    for p in levels:
        spans = spans.withColumn(f"reach{p}", F.max(F.when(F.col("priority") >= p, F.col("end"))).over(earlier))
    reach = F.coalesce(F.lit(None).cast("long"), *(F.when(F.col("priority") == p, F.col(f"reach{p}")) for p in levels))
    return spans.filter(reach.isNull() | (reach < F.col("end"))).select("row", "rule_id", "label", "priority", "confidence", "start", "end")


def scan(docs: DataFrame, signatures: list[Rule] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: key, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts give 0 words, null places, empty labels and score 0. score: the greatest confidence of a match that
    stands, at least 0.5 where a base phrase stands. Rows that share a key (or have none) are
    judged each by its own text.
    An empty table gives no rows; other columns are ignored, whatever their names.
    """
    t, signatures = F.col("t"), rules() if signatures is None else signatures
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    one_pass = rows.select("k", F.monotonically_increasing_id().alias("row"), words(t).alias("n_words"), F.when(gated(F.lower(t), signatures), t).alias("t"))
    held = cut(one_pass, "licences")  # the texts that pass the gate, and every text's words
    found = held.select("k", "row", "n_words", F.when(t.isNotNull(), base_places(t, F.lower(t))).alias("base"))
    own = standing(held.filter(t.isNotNull()), signatures).groupBy(F.col("row").alias("row2")).agg(F.collect_set("label").alias("own"), F.max("confidence").alias("sure"))
    both = found.join(own, F.col("row") == F.col("row2"), "left")
    base = F.coalesce(F.col("base"), F.expr("array()").cast("array<struct<label:string,n:bigint,first:bigint,last:bigint>>"))
    some = F.size(base) > 0
    names = F.array_sort(F.transform(base, lambda x: x["label"]))
    return both.select(
        F.col("k").alias(key),
        "n_words",
        F.aggregate(base, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["last"])).alias("last_word"),
        F.array_join(names, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(names, F.coalesce(F.col("own"), F.expr("array()").cast("array<string>"))))), ",").alias("labels"),
        F.greatest(F.coalesce(F.col("sure"), F.lit(0.0)), F.when(some, 0.5).otherwise(0.0)).alias("score"),
    )
