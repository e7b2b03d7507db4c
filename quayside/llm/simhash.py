"""SimHash near-duplicates: 64-bit fingerprints, linked by a self-join of binary tries, then joined into components.

Join. Copies share a fingerprint, so the join works on distinct ones. Two that differ in at most 4 bits agree on at least 3 of 7
blocks of bits, whichever bits differ. So each fingerprint goes, for each of the 35 choices of 3 blocks, into the trie that
all with the same bits in those blocks share: tries lie on different machines and no pair is missed. A task holds the sorted
leaves of its tries; a node is a range of them. It walks pairs of nodes down all tries at once, level by level, adds up the
bits in which the two paths differ and drops a pair beyond the budget of 4. A pair whose leaves are all in one component
already is dropped too, so a large group of near copies costs about its size and not its square. Each trie gives a link from
each leaf to the first of its component; no set of all pairs exists anywhere. A trie of more than HOT leaves is dealt out once
more, by 35 choices of the bits that its leaves don't share; what lies in one task then agrees on 43 bits at least.

Components: repeated large-star and small-star steps over these links, as joins, each written to shared storage.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import cut, fresh_dir, joined_hot, remove, slices, text_or_empty, unused

SEED, WORDS, BUDGET, BLOCKS = 42, 4, 4, 7
#: Node pairs that a task takes down a level at once.
FRONT = 1 << 18
#: Leaves beyond which a trie is dealt out again.
HOT = 1 << 16


def simhash(text: bytes, n: int = WORDS, seed: int = SEED) -> int:
    """Bit b is 1 if it is set in over half of the XXH64 of all n-word shingles (A-Z lower-cased, ASCII white space between words)."""
    words = text.lower().split()
    if not words:
        return 0
    joined, ends = b" ".join(words), list(accumulate(len(w) + 1 for w in words))
    h = xxhash.xxh64_intdigest
    if len(words) <= n:
        hashes = [h(joined, seed)]
    else:
        hashes = [h(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[n - 1 :])]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # a very long text costs no more memory
        part = np.array(hashes[i : i + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """k, th (a hash of the text), fp (the fingerprint's bits as a signed long). A null text is as an empty one: fingerprint 0."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            found = np.fromiter((simhash(x) for x in b.column("t").cast(pa.binary()).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("th"), pa.array(found.view(np.int64))], ["k", "th", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.xxhash64(text_or_empty(text)).alias("th"), text_or_empty(text).alias("t")).mapInArrow(task, f"k {kind}, th long, fp long")


def masks(budget: int = BUDGET, blocks: int = BLOCKS, within: int = (1 << 64) - 1) -> list[int]:
    """The bits of each choice of blocks of the bits `within`; two fingerprints within the budget agree on all bits of at least one."""
    places = [b for b in range(64) if within >> b & 1]
    edges = [len(places) * i // blocks for i in range(blocks + 1)]
    bits = [sum(1 << b for b in places[lo:hi]) for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(bits, blocks - budget)]


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Puts each a[i] and b[i] into one component; label holds each leaf's first one."""
    while True:
        x, y = label[a], label[b]
        if not (apart := x != y).any():
            return
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := label[label], label):
            label[:] = up


def trie_join(trie: np.ndarray, code: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """Leaves (trie number, fingerprint), sorted; gives for each leaf the first one of its component in its trie."""
    n = len(code)
    label = np.arange(n)
    if n < 2:
        return label
    first = np.flatnonzero(np.r_[True, trie[1:] != trie[:-1]])
    last = np.r_[first[1:], n]
    # ones[b][i]: leaves before i whose bit b is set; of a node, those with a 0 come first
    ones = np.zeros((64, n + 1), np.int32)
    for b in range(64):
        np.cumsum((code >> np.uint64(b)) & np.uint64(1), out=ones[b, 1:])
    more = last - first > 1
    zero = np.zeros(more.sum(), np.int64)
    stack = [np.stack([first[more], last[more], first[more], last[more], zero, zero + 63])]
    while stack:
        front = stack.pop()
        if front.shape[1] > FRONT:
            stack += [front[:, FRONT:], front[:, :FRONT]]
            continue
        # pairs whose leaves are in one component already
        low, high = ranged(np.minimum, label, front), ranged(np.maximum, label, front)
        front = front[:, np.minimum(low[0], low[1]) != np.maximum(high[0], high[1])]
        if not front.shape[1]:
            continue
        a, a2, b, b2, d, bit = front
        leaf = (a2 - a == 1) & (b2 - b == 1) | (bit < 0)
        if leaf.any():
            x, y = a[leaf], b[leaf]
            near = (np.bitwise_count(code[x] ^ code[y]) <= budget) & (x != y)
            joined(label, x[near], y[near])
            a, a2, b, b2, d, bit = front[:, ~leaf]
            if not len(a):
                continue
        one_a, one_b = ones[bit, a2] - ones[bit, a], ones[bit, b2] - ones[bit, b]
        am, bm, own = a2 - one_a, b2 - one_b, a == b
        apart = np.concatenate([np.stack([a, am, bm, b2, d + 1, bit - 1]), np.stack([am, a2, b, bm, d + 1, bit - 1])[:, ~own]], axis=1)
        same = np.concatenate([np.stack([a, am, b, bm, d, bit - 1]), np.stack([am, a2, bm, b2, d, bit - 1])], axis=1)
        for nxt in (apart, same):  # the nearer pairs are on top, so components form early
            nxt = nxt[:, (nxt[1] > nxt[0]) & (nxt[3] > nxt[2]) & (nxt[4] <= budget)]
            nxt = nxt[:, (nxt[0] != nxt[2]) | (nxt[1] - nxt[0] > 1)]
            if nxt.shape[1]:
                stack.append(nxt)
    return label


def ranged(op: np.ufunc, label: np.ndarray, front: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """op over the labels of each pair's first and second range."""
    out = []
    for lo, hi in ((front[0], front[1]), (front[2], front[3])):
        if (hi - lo == 1).all():
            out.append(label[lo])
        else:
            padded = np.append(label, label[-1])
            out.append(op.reduceat(padded, np.stack([lo, hi], 1).ravel())[::2])
    return out[0], out[1]


def signed(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits)


def links(prints: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) whose components are those of all pairs within the budget."""
    every = masks(budget, budget + 3)
    first = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(signed(m)).alias("bits")) for i, m in enumerate(every)))
    dealt = prints.select("fp", F.explode(first).alias("x")).select("x.choice", "x.bits", "fp")
    large = cut(dealt.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("choice", "bits"), "large-tries")
    if not large.isEmpty():
        again = F.array(*(F.array(*(signed(m | x) for x in masks(budget, budget + 3, ~m & (1 << 64) - 1))) for m in every))
        split = dealt.join(large, ["choice", "bits"]).select("choice", "fp", F.posexplode(F.get(again, F.col("choice"))).alias("i", "m"))
        finer = split.select((F.col("choice") * len(every) + F.col("i") + len(every)).alias("choice"), F.col("fp").bitwiseAND(F.col("m")).alias("bits"), "fp")
        dealt = dealt.join(large, ["choice", "bits"], "left_anti").unionByName(finer)
    dealt = dealt.repartition("choice", "bits").sortWithinPartitions("choice", "bits")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def run(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            choice, bits, fp = (np.concatenate(x) for x in zip(*parts))
            new = np.r_[True, (choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1]), True]
            more = ~(new[:-1] & new[1:])  # a trie of one leaf has no pair
            trie, fp = np.cumsum(new[:-1])[more], fp[more]
            at = np.lexsort((fp, trie))
            fp = fp[at]
            label = trie_join(trie, fp, budget)
            own = label != np.arange(len(label))
            return pa.RecordBatch.from_arrays([pa.array(fp[own].view(np.int64)), pa.array(fp[label[own]].view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            c, m, f = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("choice", "bits", "fp"))
            part = (c, m, f.view(np.uint64))
            if rows > 1 << 17:  # up to the last trie of what is held, which may go on
                end = np.flatnonzero((c != c[-1]) | (m != m[-1]))
                if len(end):
                    k = end[-1] + 1
                    yield run([*held, tuple(x[:k] for x in part)])
                    held, rows, part = [], 0, tuple(x[k:] for x in part)
            held.append(part)
            rows += len(part[0])
        if held:
            yield run(held)

    return dealt.mapInArrow(task, "a long, b long").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """v, root: for each vertex of edges (a, b) the smallest vertex it can reach. Vertices without an edge aren't there."""
    spark = edges.sparkSession
    steps = [fresh_dir(spark, name)]
    edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct().write.parquet(steps[0])
    before = None
    while True:
        now = spark.read.parquet(steps[-1])
        # large star: each neighbour above u gets the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        # small star: u and its smaller neighbours get the smallest of these
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        steps.append(fresh_dir(spark, name))
        small.write.parquet(steps[-1])
        if len(steps) > 2:
            remove(spark, steps.pop(-3))
        after = spark.read.parquet(steps[-1]).agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return spark.read.parquet(steps[-1]).select(F.col("u").alias("v"), F.col("v").alias("root"))
        before = after


def rooted(docs: DataFrame, key: str, text: str, budget: int) -> tuple[DataFrame, DataFrame]:
    """k, th, fp of each row; and fp, root, times (rows with this fp) of each fingerprint. Both in shared storage."""
    rows = cut(fingerprints(docs, key, text), "fingerprints")
    prints = cut(rows.groupBy("fp").agg(F.count("*").alias("times"), F.min("k").alias("first")), "prints")
    roots = components(links(prints.select("fp"), budget))
    return rows, cut(prints.join(roots, prints.fp == roots.v, "left").select("fp", "times", "first", F.coalesce("root", "fp").alias("root")), "roots")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """key, fp, component (the smallest key that a row's fingerprint reaches over links), one row for each row of docs.

    Rows with equal texts, null keys and empty texts are rows as any other; a component of null keys alone has a null id.
    An empty table gives no rows. Other columns are ignored.
    """
    rows, prints = rooted(docs, key, text, budget)
    heads = prints.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("n"))
    named = cut(joined_hot(prints.select("fp", "root", "times"), heads, ["root"], "n", prints.count()).select("fp", "component", "times"), "components")
    return joined_hot(rows, named, ["fp"], "times", rows.count()).select(F.col("k").alias(key), "fp", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", budget: int = BUDGET) -> DataFrame:
    """The rows of docs of which each component keeps one: the smallest key, null last, of these the smallest hash of the text.

    Rows that share a key are judged each by its own text; of rows with one key and one text, one stays.
    """
    rows, prints = rooted(docs, key, text, budget)
    root = joined_hot(rows, prints.select("fp", "root", "times"), ["fp"], "times", rows.count())
    least = root.groupBy("root").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "th")).alias("x"))
    head, own, hashed = unused(docs, "head", "own", "hashed")
    heads = least.select(F.col("x.k").alias(head), F.col("x.th").alias(own)).distinct()
    marked = docs.withColumn(hashed, F.xxhash64(text_or_empty(text)))
    kept = marked.join(heads, marked[key].eqNullSafe(heads[head]) & (marked[hashed] == heads[own]), "left_semi")
    return kept.dropDuplicates([key, hashed]).drop(hashed)
