"""Which papers belong to one shipment: similar keys, guards against mixing, connected components, case ids, missing papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.normalize import key_similarity
from quayside.operators.graph import components, cut, shared_dir  # noqa: F401

#: How much an equal key says.
WEIGHTS = {
    "booking_no": 1.0, "shipping_order_no": 1.0, "bl_no": 0.95, "invoice_no": 0.9, "container_no": 0.9, "container_suffix": 0.72,
    "vessel_voyage": 0.7, "eta": 0.5, "amount": 0.55, "date": 0.45, "consignee": 0.35, "shipper": 0.35,
}
PARTIAL = ("invoice_no", "bl_no", "booking_no", "shipping_order_no", "container_no", "container_suffix")
HARD = ("invoice_no", "bl_no", "booking_no", "shipping_order_no", "container_no")
PARTIES = ("consignee", "shipper")
CASE_KEYS = ("booking_no", "shipping_order_no", "bl_no", "invoice_no", "container_no")
#: Papers that a case must have, in order, and how sure a candidate must be to count.
REQUIRED = {"import": ("declaration", "invoice", "packing_list", "bill_of_lading"), "export": ("export_declaration", "invoice", "packing_list", "bill_of_lading", "booking")}
CANDIDATE = {"declaration": 0.30, "export_declaration": 0.30, "arrival_notice": 0.36, "delivery_order": 0.36, "tax_document": 0.36, "clearance": 0.36}


def folded(v: Column) -> Column:
    """One reading for all ambiguous characters."""
    return F.translate(v, "OIL", "011")


def shortened(v: Column, most: int) -> Column:
    """The texts that are left of v when up to `most` characters go."""
    out = level = F.array(v)
    for _ in range(most):
        one = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.left(x, i - 1), x.substr(i + 1, F.length(x))))
        level = F.array_distinct(F.flatten(F.transform(level, one)))
        out = F.array_union(out, level)
    return out


def allowed(length: Column, least: float) -> Column:
    """The edits that two values may differ by, the longer of which has this length, to be alike by `least`."""
    return F.floor(F.lit((1 - least) + 1e-9) * length).cast("int")


def segments(least: float) -> Column:
    """Where the segments of a value lie that may differ by k edits: k + 1 of them, as even as can be, each with its place in order."""
    l = F.col("l")
    k = allowed(l, least)
    start = lambda i: F.floor(l * i / (k + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), k), lambda i: F.struct(i.alias("i"), start(i).alias("p"), (start(i + 1) - start(i)).alias("s")))


def value_pairs(keys: DataFrame, least: float = 0.9, by: list[str] | None = None, few: int = 2, small: int = 64) -> DataFrame:
    """by, key, a, b (a < b), similarity of all pairs of distinct values of a key (and of `by`) whose similarity is at least `least`.

    Exact for values of any length. Values that read alike share their folded form. Two that differ by at most `few` edits, by what
    `least` allows for the longer one, share a text that is left when so many characters go: selective, however much of all values
    is the same. Where more edits are allowed, the longer value is cut into one segment more than edits; the shorter one holds one
    of them at a place that the edits and the lengths allow. (A value within the other differs by as many edits as it is shorter.)
    Groups (of `by` and key) of up to `small` values are compared value by value. Papers are not paired here, however many share a
    value: they belong to it.
    """
    by = by or []
    v = F.col("value")
    every = cut(keys.select(*by, "key", "value").distinct().filter("value <> ''").withColumn("m", F.length(v)), "values")
    sizes = every.groupBy(*by, "key").agg(F.count("*").alias("values"))
    sized = cut(every.join(sizes, [*by, "key"]), "sized")
    side = lambda name, m: sized.filter(F.col("values") <= small).select(*by, "key", v.alias(name), F.col("m").alias(m))
    direct = side("a", "ma").join(side("b", "mb"), [*by, "key"]).filter("a < b").filter(F.abs(F.col("ma") - F.col("mb")) <= allowed(F.greatest("ma", "mb"), least)).select(*by, "key", "a", "b")
    alike = lambda df: df.withColumn("similarity", key_similarity(F.col("a"), F.col("b"))).filter(F.col("similarity") >= least)
    each = sized.filter(F.col("values") > small).drop("values")
    if each.isEmpty():
        return alike(direct)
    own = allowed(F.col("m"), least)
    cases = F.array(v)
    for e in range(1, few + 1):
        cases = F.when(own >= e, shortened(v, e)).otherwise(cases)
    blocks = F.array_union(F.array(F.concat(F.lit("="), folded(v))), F.transform(cases, lambda x: F.concat(F.lit("-"), x)))
    short = each.filter(own <= few).select(*by, "key", "value", F.explode(blocks).alias("block"))
    read = each.filter(own > few).select(*by, "key", "value", F.concat(F.lit("="), folded(v)).alias("block"))
    met = short.unionByName(read)
    on = [*by, "key", "block"]
    pairs = met.withColumnRenamed("value", "a").join(met.withColumnRenamed("value", "b"), on).filter("a < b").select(*by, "key", "a", "b")
    # the longer value's segments, and the texts that the shorter one may hold of each length's segments
    held = each.filter(own > few).withColumn("l", F.col("m")).select(*by, "key", v.alias("b"), "l", F.explode(segments(least)).alias("x"))
    held = held.select(*by, "key", "b", "l", "x.i", F.substr(F.col("b"), F.col("x.p") + 1, F.col("x.s")).alias("block"))
    lengths = F.filter(F.sequence(F.col("m"), F.floor(F.col("m") / F.lit(least) + 1e-6).cast("int")), lambda n: (allowed(n, least) > few) & (n - F.col("m") <= allowed(n, least)))
    tried = each.select(*by, "key", v.alias("a"), "m", F.explode(lengths).alias("l")).select("*", F.explode(segments(least)).alias("x"))
    k, apart = allowed(F.col("l"), least), F.col("l") - F.col("m")
    first, last = F.greatest(F.lit(0), F.col("x.p") - F.floor((k + apart) / 2)).cast("int"), F.least(F.col("m") - F.col("x.s"), F.col("x.p") + F.floor((k - apart) / 2)).cast("int")
    tried = tried.withColumn("first", first).withColumn("last", last).filter("last >= first").select(*by, "key", "a", "l", "x.i", "x.s", F.explode(F.sequence("first", "last")).alias("q"))
    tried = tried.select(*by, "key", "a", "l", "i", F.substr(F.col("a"), F.col("q") + 1, F.col("s")).alias("block")).distinct()
    far = tried.join(held, [*by, "key", "l", "i", "block"]).filter("a <> b").select(*by, "key", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return alike(direct.unionByName(pairs.unionByName(far).distinct()))


def weight(key: Column) -> Column:
    out = F.lit(0.0)
    for k, w in WEIGHTS.items():
        out = F.when(key == k, w).otherwise(out)
    return out


def pair_score(key: Column, similarity: Column) -> Column:
    w = weight(key)
    return F.when(similarity >= 1.0, w).when(similarity >= 0.88, w * 0.92).when((similarity >= 0.72) & key.isin(*PARTIAL), w * 0.72).otherwise(0.0)


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.95, "exact_match").when(score >= 0.8, "high_confidence").when(score >= 0.6, "partial_match").when(score > 0, "low_confidence").otherwise("pending_review")


def conflicts(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """Of pairs (a, b of papers) those that must not meet: a hard key that differs, or a party that does."""
    left = keys.select(F.col("seg_id").alias("a"), "key", F.col("value").alias("va"))
    right = keys.select(F.col("seg_id").alias("b"), "key", F.col("value").alias("vb"))
    s = key_similarity(F.col("va"), F.col("vb"))
    bad = (F.col("key").isin(*HARD) & (s < 0.72)) | (F.col("key").isin(*PARTIES) & (s < 0.58))
    return pairs.join(left, "a").join(right, ["b", "key"]).filter(bad).select("a", "b").distinct()


def links(keys: DataFrame, near: DataFrame, least: float = 0.6) -> DataFrame:
    """a, b: papers to their key's value, and values to the values they resemble, where the score is at least `least`. Vertices are texts: `p:` paper, `v:` value."""
    own = keys.filter(weight(F.col("key")) >= least).select(F.concat(F.lit("p:"), F.col("seg_id").cast("string")).alias("a"), F.concat_ws(":", F.lit("v"), "key", "value").alias("b"))
    other = near.filter(pair_score(F.col("key"), F.col("similarity")) >= least).select(F.concat_ws(":", F.lit("v"), "key", "a").alias("a"), F.concat_ws(":", F.lit("v"), "key", "b").alias("b"))
    return own.unionByName(other)


def paper_links(keys: DataFrame, near: DataFrame, least: float = 0.6) -> DataFrame:
    """a, b: links() between papers only (seg_id): each paper of a value meets the value's first one, and the first papers of values that
    resemble each other meet. The same components, over numbers, without a vertex for each value."""
    own = cut(keys.filter(weight(F.col("key")) >= least).select("key", "value", "seg_id"), "papers")
    first = cut(own.groupBy("key", "value").agg(F.min("seg_id").alias("first")), "firsts")
    score = pair_score(F.col("key"), F.col("similarity"))
    other = near.filter((score >= least) & (weight(F.col("key")) >= least)).select("key", "a", "b")
    side = lambda name: first.select("key", F.col("value").alias(name), F.col("first").alias(f"f{name}"))
    met = other.join(side("a"), ["key", "a"]).join(side("b"), ["key", "b"]).select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    return own.join(first, ["key", "value"]).select(F.col("seg_id").alias("a"), F.col("first").alias("b")).unionByName(met).distinct()


def case_id(keys: dict[str, Column], names: Column) -> Column:
    """The first key that a case has, else a digest of its papers' names."""
    return F.coalesce(*(F.nullif(keys[k], F.lit("")) for k in CASE_KEYS if k in keys), F.concat(F.lit("CASE-"), F.upper(F.substring(F.sha1(F.array_join(names, "|")), 1, 8))))


def candidate_least(kind: Column) -> Column:
    out = F.lit(0.42)
    for k, x in CANDIDATE.items():
        out = F.when(kind == k, x).otherwise(out)
    return out


def missing_documents(papers: DataFrame, direction: str = "import", sure: Column | None = None) -> DataFrame:
    """case_id, doc_type of the required papers that a case has neither as a paper nor as a candidate (doc_type, confidence)."""
    counts = sure if sure is not None else F.col("confidence") >= candidate_least(F.col("doc_type"))
    there = papers.groupBy("case_id").agg(F.collect_set(F.when(counts, F.col("doc_type"))).alias("have"))
    wanted = F.array(*map(F.lit, REQUIRED[direction]))
    if direction == "export":
        wanted = F.when(F.array_contains("have", "shipping_order"), F.array_remove(wanted, "booking")).otherwise(wanted)
    return there.select("case_id", F.explode(F.array_except(wanted, "have")).alias("doc_type"))


def lacking(papers: Column, direction: str = "import") -> Column:
    """missing_documents() of a case's papers (an array of doc_type, confidence), as an array."""
    sure = F.filter(papers, lambda p: p["confidence"] >= candidate_least(p["doc_type"]))
    have, wanted = F.transform(sure, lambda p: p["doc_type"]), F.array(*map(F.lit, REQUIRED[direction]))
    if direction == "export":
        wanted = F.when(F.array_contains(have, "shipping_order"), F.array_remove(wanted, "booking")).otherwise(wanted)
    return F.array_except(wanted, have)


def fallback_candidates(papers: DataFrame) -> DataFrame:
    """case_id, shown: required papers that a case has as candidates only, with how sure they are."""
    sure = F.col("confidence") >= candidate_least(F.col("doc_type"))
    low = papers.filter(F.col("doc_type").isin(*REQUIRED["import"]) & ~sure).groupBy("case_id", "doc_type").agg(F.max("confidence").alias("c"))
    return low.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.col("doc_type"), F.lit(" ("), F.floor(F.col("c") * 100).cast("string"), F.lit("%)")))), ", ").alias("shown"))
