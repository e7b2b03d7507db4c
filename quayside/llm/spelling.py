"""Spelling variants: words one edit apart, found by joining chunks of one with positional grams of the other.

Join. The shorter word of a pair (either, if both have one length) contributes two disjoint chunks, its halves. One edit changes one
of them at most, so the other is in the longer word as a gram, at its own place or one further. Of the longer word's positional
grams only those at such places can meet a chunk, and only those are made. Rows meet by length, place and text of the gram; what
lies beside it is compared by edit distance.

A gram that many words share is not joined: where a group would make over MOST pairs for each of its rows, the part of the word
that the edit lies in is halved again and its rows meet by both of the parts around it, until groups are small or the part is one
letter (then the words of a group differ in that letter only, and the alphabet bounds their number). So pairs that are compared
grow with the words, whatever prefix or ending they share, and no pair is missed.
"""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import cut, dropped, joined_hot

WORD = "[A-Za-zÀ-ÿ]+"
#: Least length and occurrences of a word, how many times as frequent its form must be, and the pairs for each row of a group.
LENGTH, TIMES, FACTOR, MOST = 6, 5, 5, 16
KEY = ["l", "lo", "hi", "rest"]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", changed: Callable[[Column, Column], Column] | None = None, length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """word, n of all words of at least `length` code points and `times` occurrences in the table.

    Words are runs of WORD with A-Z in lower case; changed maps a row's key and such a word to the word that counts (shorter or as long).
    Null and empty texts have none. Every occurrence counts, in repeated rows too; an empty table gives no words.
    """
    run = F.col("run")
    runs = docs.select(F.col(key).alias("k"), F.explode(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))).alias("run")).filter(F.length(run) >= length)
    low = runs.select("k", F.when(F.lower(run) == run, run).otherwise(F.translate(run, ascii_uppercase, ascii_lowercase)).alias("run"))
    word = changed(F.col("k"), run) if changed else run
    return low.select(word.alias("word")).filter(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)


def keyed(rows: DataFrame) -> DataFrame:
    """side, word, n and the key of rows (side, word, n, l, lo, hi): the text before and behind the part of a word of l letters that
    the edit lies in, from lo to hi. A word of side y has l letters or one more."""
    return rows.select("side", "word", "n", "l", "lo", "hi", F.concat(F.left("word", F.col("lo")), F.right("word", F.col("l") - F.col("hi"))).alias("rest"))


def halves(lo: Column, hi: Column) -> Column:
    mid = F.floor((lo + hi) / 2).cast("int")
    return F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi")))


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """a, na, b, nb: every two words (word, n; distinct, two letters at least) that differ by exactly one inserted, deleted or replaced code point, once."""
    size = F.length("word").cast("int")
    sides = F.array(F.struct(F.lit("x").alias("side"), size.alias("l")), F.struct(F.lit("y").alias("side"), size.alias("l")), F.struct(F.lit("y").alias("side"), (size - 1).alias("l")))
    each = words.select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.side", "s.l").filter("l > 0")
    pending = keyed(each.select("*", F.explode(halves(F.lit(0), F.col("l"))).alias("i")).select("side", "word", "n", "l", "i.lo", "i.hi"))
    pairs: DataFrame | None = None
    while True:
        pending = cut(pending, "grams")
        x, y = (F.sum((F.col("side") == s).cast("long")) for s in "xy")
        groups = pending.groupBy(*KEY).agg(x.alias("nx"), y.alias("ny"), F.count("*").alias("times"), F.min("word").alias("first"), F.max("word").alias("last"))
        groups = cut(groups.filter("nx > 0 and ny > 0 and first <> last").drop("first", "last").withColumn("split", (F.col("nx") * F.col("ny") > most * F.col("times")) & (F.col("hi") - F.col("lo") > 1)), "groups")
        sized = joined_hot(pending, groups, KEY, "times", pending.count())
        own, other = (sized.filter((F.col("side") == s) & ~F.col("split")).select(*KEY, F.col("word").alias(w), F.col("n").alias(f"n{w}")) for s, w in (("x", "a"), ("y", "b")))
        part = lambda w, more: F.substr(F.col(w), F.col("lo") + 1, F.col("hi") - F.col("lo") + more)
        more = F.length("b") - F.length("a")
        near = own.join(other, KEY).filter((more == 1) | (F.col("a") < F.col("b"))).filter(F.levenshtein(part("a", F.lit(0)), part("b", more), 1) == 1)
        near = cut(near.select("a", "na", "b", "nb").distinct(), "near")
        pairs = near if pairs is None else pairs.unionByName(near)
        if groups.filter("split").isEmpty():
            dropped(words.sparkSession, pending, groups)
            return pairs.distinct()
        finer = sized.filter("split").select("side", "word", "n", "l", F.explode(halves(F.col("lo"), F.col("hi"))).alias("i")).select("side", "word", "n", "l", "i.lo", "i.hi")
        pending, done = cut(keyed(finer), "grams"), (pending, groups)
        dropped(words.sparkSession, *done)


def roots(links: DataFrame) -> DataFrame:
    """word, root: where following forms ends, from word and form. Forms are more frequent than their words, so there is no circle;
    each round doubles the steps, and their number grows with the logarithm of the logarithm of the greatest frequency."""
    now = cut(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("up")), "root", "left")
        after = cut(further.select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "roots")
        dropped(links.sparkSession, now)
        now = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return now


def forms(counts: DataFrame, factor: int = FACTOR, most: int = MOST) -> DataFrame:
    """A row for each word of counts (word, n): word, form, root, n, n_near, form_n.

    A word's form is the most frequent word near it (of equals the smallest), if that is `factor` times as frequent as the word at
    least, else null; its root is where following forms ends. counts has each word once; no words give no rows.
    """
    words = cut(counts.select("word", "n"), "words")
    pairs = near_pairs(words, most)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.first("na").alias("own"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("less"), "b")).alias("x"))
    better = -F.col("x.less") >= factor * F.col("own")
    named = cut(best.select("word", "n_near", F.when(better, F.col("x.b")).alias("form"), F.when(better, -F.col("x.less")).alias("form_n")), "forms")
    ends = roots(named.filter("form is not null"))
    found = words.join(named, "word", "left").join(ends, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
