"""Secret scan: patterns, and tokens that a Markov chain of random strings explains far better than one of ordinary identifiers.

Only DataFrame functions. One pass over the texts keeps of each row what the patterns and the candidate tokens match and how much
text stands before each match; texts themselves are not shuffled or stored. Labelled samples train two chains over characters:
values that the patterns found are random strings; other candidate tokens, and a few identifiers as programs write them, are
ordinary. Every distinct token of the table counts once. The first fit takes plain words for ordinary; each other adds what the one
before finds ordinary, as the rest may be secrets that no pattern found. What is collected of a fit is a table of character pairs,
2 * 95 * 95 numbers at most. A candidate is a secret where its log-likelihood ratio reaches THRESHOLD, unless it lies on a span of
the patterns.
"""

from __future__ import annotations

import json
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import cut, text_or_empty

KINDS = ("assign", "access", "hex", "markov")
#: Pattern, group that is the value, and least length of the value.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]{24,})", 1, 24),
}
#: A candidate token: a longest run of these characters, one of them a letter.
TOKEN = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{12,}"
#: Least log-likelihood ratio (natural logarithm) of a secret, added to each pair's count, number of characters, weight of a sample below, fits.
THRESHOLD, ALPHA, CHARACTERS, GIVEN, ROUNDS = 14.0, 1.0, 66, 20, 3
#: A token that is ordinary by its look: letters, capitals at the start or throughout.
PLAIN = "^(?:[A-Z]?[a-z]+|[A-Z]+)$"
#: Samples of ordinary identifiers, besides those of the table.
ORDINARY = (
    "getElementById", "setAttributeValue", "toLocaleDateString", "XMLHttpRequest", "ArrayIndexOutOfBounds", "NullPointerException", "HttpServletResponse", "isAuthenticated", "handleButtonClick", "maxConnectionCount",
    "user_account_name", "created_at_timestamp", "parse_http_request", "MAX_BUFFER_SIZE", "DEFAULT_TIMEOUT_MS", "last_modified_date", "__init_subclass__", "order_line_items", "is_valid_utf8", "get_or_create_user_2",
    "2024-01-15T00-00-00", "2023-12-31_235959", "1999-10-01-120000", "INV-00000123", "ORDER-2021-000457", "ticket-100200300", "version-10-2-33", "release-2022-04-18", "chapter-12-section-03", "file_0001_part_02",
    "application/json", "text/x-python", "usr/local/share/lib", "images/2019/photo_10", "content-type-header", "x-requested-with", "utf-8-encoded-text", "well-known-service", "north-north-west", "state-of-the-art",
    "Donaudampfschifffahrt", "internationalization", "counterrevolutionary", "electroencephalogram", "misunderstandings", "anticonstitutionnellement", "responsabilidades", "Geschwindigkeitsbegrenzung", "HEADQUARTERS", "INTERNATIONAL-TRADE",
)


def pieces(text: Column, pattern: str) -> Column:
    """The text cut at its matches: for each piece its length, and for every second one, a match, its text. One pass over the text."""
    marked = F.regexp_replace(F.replace(text, F.lit("\x01"), F.lit("\x02")), pattern, "\x01$0\x01")
    return F.transform(F.split(marked, "\x01", -1), lambda x, i: F.struct(F.length(x).alias("n"), F.when(i % 2 == 1, x).alias("hit")))


def gates(text: Column) -> dict[str, Column]:
    """What a text must hold to have a match that counts, as cheaply as it can be said."""
    return {"assign": text.rlike(r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}"""), "access": F.contains(text, F.lit("AKIA")), "hex": text.rlike("[0-9a-f]{24}"), "markov": F.lit(True)}


def matches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """row, k and the pieces for each kind, in shared storage: rows are told apart by their number, texts aren't kept."""
    t = F.col("t")
    none = F.expr("array()").cast("array<struct<n:int,hit:string>>")
    gate = gates(t)
    found = [F.filter(F.when(gate[kind], pieces(t, pattern)).otherwise(none), lambda x: x["n"] > 0).alias(kind) for kind, pattern in {**{k: p for k, (p, _, _) in BASE.items()}, "markov": TOKEN}.items()]
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"))
    return cut(rows.select(F.monotonically_increasing_id().alias("row"), "k", *found), "secrets")


def value(kind: str, hit: Column) -> Column:
    return F.regexp_extract(hit, BASE[kind][0], BASE[kind][1]) if kind in BASE else hit


def pairs(token: Column) -> Column:
    """The numbers of the character pairs of an ASCII token, its start counted as a character."""
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c) - 32)
    return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(codes, 1, F.greatest(F.length(token) - 1, F.lit(0)))), codes, lambda a, b: a * 95 + b)


def ratio(token: Column, weights: Column) -> Column:
    """The log-likelihood ratio of a token: random string against ordinary identifier."""
    return F.aggregate(pairs(token), F.lit(0.0), lambda s, p: s + F.get(weights, p))


def fit(samples: DataFrame) -> Column:
    """The weights of all character pairs, as a literal, from samples (token, random, times); of the counts 2 * 95 * 95 rows at most are collected."""
    counts = samples.select("random", "times", F.explode(pairs(F.col("token"))).alias("p")).groupBy("random", "p").agg(F.sum("times").alias("n")).collect()
    seen = {(r.random, r.p): r.n for r in counts}
    first: dict[tuple[bool, int], int] = {}
    for (random, p), n in seen.items():
        first[random, p // 95] = first.get((random, p // 95), 0) + n
    chain = lambda random, p: log((seen.get((random, p), 0) + ALPHA) / (first.get((random, p // 95), 0) + ALPHA * CHARACTERS))
    return F.from_json(F.lit(json.dumps([chain(True, p) - chain(False, p) for p in range(95 * 95)])), "array<double>")


def hits(found: DataFrame, kind: str, *columns: str) -> DataFrame:
    """The columns, at, n, hit of a kind's pieces where it has a match."""
    return found.filter(F.size(kind) > 0).select(*columns, F.posexplode(kind).alias("at", "x")).select(*columns, "at", "x.n", "x.hit")


def labelled(found: DataFrame) -> DataFrame:
    """token, random, times: every distinct value of the patterns and every other distinct candidate token, once each; the given identifiers more often."""
    each = [hits(found, kind).filter("hit is not null").select(value(kind, F.col("hit")).alias("token"), F.lit(kind in BASE).alias("random")).filter(F.length("token") >= BASE.get(kind, ("", 0, 1))[2]) for kind in KINDS]
    every = reduce(DataFrame.unionByName, each).groupBy("token").agg(F.max("random").alias("random")).select("token", "random", F.lit(1).alias("times"))
    given = found.sparkSession.createDataFrame([(x, False, GIVEN) for x in ORDINARY], "token string, random boolean, times int")
    return every.unionByName(given)


def model(found: DataFrame, rounds: int = ROUNDS) -> Column:
    """The weights after some rounds. Ordinary samples of the first are letters of one case; each other takes those that the one
    before finds less like random strings, so a secret that no pattern found doesn't speak for itself."""
    samples = cut(labelled(found), "samples")
    weights = fit(samples.filter(F.col("random") | (F.col("times") > 1) | F.col("token").rlike(PLAIN)))
    for _ in range(rounds - 1):
        weights = fit(samples.filter(F.col("random") | (F.col("times") > 1) | (ratio(F.col("token"), weights) < 0)))
    return weights


def placed(found: DataFrame, kind: str) -> DataFrame:
    """row, start, end, value of the matches of a kind; an end is the sum of the pieces up to it."""
    so_far = Window.partitionBy("row").orderBy("at")
    ends = hits(found, kind, "row").withColumn("end", F.sum(F.col("n").cast("long")).over(so_far)).filter("hit is not null")
    return ends.select("row", (F.col("end") - F.col("n")).alias("start"), "end", value(kind, F.col("hit")).alias("value"))


def spans(found: DataFrame, weights: Column) -> DataFrame:
    """row, rank (place in KINDS), start, end, score (null for the patterns' own) of all that is found."""
    base = [placed(found, kind).filter(F.length("value") >= least).select("row", F.lit(i).alias("rank"), "start", "end", F.lit(None).cast("double").alias("score")) for i, (kind, (_, _, least)) in enumerate(BASE.items())]
    score = ratio(F.col("value"), weights)
    more = placed(found, "markov").withColumn("score", score).filter((F.col("score") >= THRESHOLD) & F.col("value").rlike("[A-Za-z]")).select("row", F.lit(len(BASE)).alias("rank"), "start", "end", "score")
    every = reduce(DataFrame.unionByName, [*base, more])
    # a candidate on a span of the patterns is not said again
    own = Window.partitionBy("row").orderBy("start", "rank", "end")
    before = F.max(F.when(F.col("rank") < len(BASE), F.col("end"))).over(own.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(F.col("rank") < len(BASE), F.col("start"))).over(own.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (after.isNull() | (after >= F.col("end")))
    return every.withColumn("clear", clear).filter((F.col("rank") < len(BASE)) | F.col("clear")).drop("clear")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: key, spans (kind, start, end, score; by start, then kind as in KINDS; code points, end exclusive).

    Null and empty texts have none. Rows that share a key, or have none, are judged each by its own text; copies of a text don't
    change the model. Spans of one start and end under two kinds are both there. Without labelled values the chain of random
    strings gives all pairs alike. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    found = matches(docs, key, text)
    names = F.array(*map(F.lit, KINDS))
    held = spans(found, model(found)).groupBy(F.col("row").alias("row2")).agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end", "score"))).alias("s"))
    shown = F.transform("s", lambda x: F.struct(F.get(names, x["rank"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score")))
    none = F.expr("array()").cast("array<struct<kind:string,start:long,end:long,score:double>>")
    return found.select("row", "k").join(held, F.col("row") == F.col("row2"), "left").select(F.col("k").alias(key), F.coalesce(shown, none).alias("spans"))
