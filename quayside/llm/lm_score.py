"""LM scoring: prediction by partial matching over bytes, pretrained on the corpus, beside a unigram base.

Model. The trie of contexts of 0 to 4 bytes with the counts of what follows each (a byte or the end of the text) in the training
texts. A symbol is coded in the longest context that has been seen; a context that hasn't seen the symbol after it codes an
escape (method C: distinct symbols over all counts and distinct symbols), and shorter contexts then leave out all symbols of the
longer one. Below the empty context all 257 symbols that are left are equally likely. So probabilities add up to one.

Nothing of the model is broadcast: words and 5-grams grow with the corpus. Texts are dealt by hash into chunks of about
CHUNK_BYTES, so what a task holds stays the same as the corpus grows. A chunk sends each of its distinct words and 5-grams once, with its training count; a window adds these up by word and
5-gram over all chunks (a word has one row for each chunk at most, however often it occurs); 5-grams that no training text has
get their probabilities from the shorter contexts by joins; and each chunk gets back exactly the figures it asked for, grouped
with its texts, whose shuffle both steps use.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import cut, slices, text_or_empty

ORDER, BITS = 4, 9
END, BEGIN, SYMBOLS = 256, 257, 257
MASK = (1 << BITS) - 1
PARTS, REST = 7, 2
CHUNK_BYTES = 10 << 20


def grams(text: bytes) -> np.ndarray:
    """The code of each symbol with the ORDER symbols before it; BEGIN stands before the text, END comes last."""
    x = np.concatenate([np.full(ORDER, BEGIN, np.int64), np.frombuffer(text, np.uint8), [END]])
    n = len(x) - ORDER
    code = x[:n].copy()
    for i in range(1, ORDER + 1):
        code <<= BITS
        code |= x[i : n + i]
    return code


def added(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([a[0], b[0]]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([a[1], b[1]]), len(keys)).astype(np.int64)


class Asked:
    """The distinct words and 5-grams of a chunk, with their training counts."""

    def __init__(self) -> None:
        self.words: Counter[bytes] = Counter()
        self.sums = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.held: list[np.ndarray] = []
        self.rare: list[np.ndarray] = []
        self.size = 0

    def add(self, text: bytes, trains: bool) -> None:
        words = text.lower().split()
        if trains:
            self.words.update(words)
            self.words[b""] += 1
        else:
            for w in set(words):
                self.words.setdefault(w, 0)
            self.words.setdefault(b"", 0)
        (self.held if trains else self.rare).append(grams(text))
        self.size += len(text) + 1
        if self.size > 1 << 22:
            self.settle()

    def settle(self) -> None:
        for parts, one in ((self.held, 1), (self.rare, 0)):
            if parts:
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                self.sums = added(self.sums, (keys, n * one))
                parts.clear()
        self.size = 0


def asked(dealt: DataFrame) -> DataFrame:
    """chunk, w or g, n."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks: dict[int, Asked] = {}
        for b in slices(batches, "t"):
            for c, t, trains in zip(b.column("chunk").to_pylist(), b.column("t").cast(pa.binary()).to_pylist(), b.column("trains").to_pylist()):
                chunks.setdefault(c, Asked()).add(t, trains)
        for c, x in chunks.items():
            x.settle()
            words, n = list(x.words), np.fromiter(x.words.values(), np.int64, len(x.words))
            for i in range(0, len(words), 1 << 16):
                part = words[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), c, np.int32)), pa.array(part, pa.binary()), pa.nulls(len(part), pa.int64()), pa.array(n[i : i + (1 << 16)])], ["chunk", "w", "g", "n"])
            keys, n = x.sums
            for i in range(0, len(keys), 1 << 16):
                part = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), c, np.int32)), pa.nulls(len(part), pa.binary()), pa.array(part), pa.array(n[i : i + (1 << 16)])], ["chunk", "w", "g", "n"])

    return dealt.mapInArrow(task, "chunk int, w binary, g long, n long")


def lower(gram: Column, k: int) -> Column:
    """The last k context symbols and the symbol."""
    return gram.bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1))


def probabilities(counts: DataFrame) -> DataFrame:
    """g and lp, log10 of the probability of its symbol after its context; counts: g and n, its training count or 0."""
    seen = counts.filter("n > 0")
    tables = [seen.groupBy(lower(F.col("g"), k).alias("x")).agg(F.sum("n").alias("n")) for k in range(ORDER)] + [seen.select(F.col("g").alias("x"), "n")]
    stats = []
    for k in range(ORDER + 1):
        x = tables[k].withColumn("c", F.shiftright("x", BITS))
        if k:  # what the next shorter context's counts hold of this one's symbols
            x = x.join(tables[k - 1].select(F.col("x").alias("y"), F.col("n").alias("shorter")), lower(F.col("x"), k - 1) == F.col("y"))
        else:
            x = x.withColumn("shorter", F.lit(0).cast("long"))
        stats.append(cut(x.groupBy("c").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("shorter").alias("left_out")), f"contexts-{k}"))
    best = stats[ORDER].select(F.col("c").alias("c0"), "total", "kinds")
    known = seen.join(best, F.shiftright("g", BITS) == F.col("c0")).select("g", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("lp"))
    out = counts.filter("n = 0").select("g", F.lit(0.0).alias("lp"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("minus"), F.lit(0).cast("long").alias("fewer"))
    for k in range(ORDER, -1, -1):
        t = tables[k].select(F.col("x").alias("xk"), F.col("n").alias("nk"))
        s = stats[k].select(F.col("c").alias("ck"), "total", "kinds", "left_out")
        x = out.join(s, F.shiftright(lower(F.col("g"), k), BITS) == F.col("ck"), "left")
        x = x.join(t, lower(F.col("g"), k) == F.col("xk"), "left") if k < ORDER else x.withColumn("nk", F.lit(None).cast("long"))
        there = F.col("total").isNotNull() & ~F.col("done")
        total, kinds = F.col("total") - F.col("minus"), F.col("kinds") - F.col("fewer")
        hit = there & F.col("nk").isNotNull()
        step = F.when(hit, F.log10(F.col("nk") / (total + kinds))).when(there & (kinds > 0), F.log10(kinds / (total + kinds))).otherwise(0.0)
        out = x.select("g", (F.col("lp") + step).alias("lp"), (F.col("done") | hit).alias("done"), F.when(there, F.col("left_out")).otherwise(F.col("minus")).alias("minus"), F.when(there, F.col("kinds")).otherwise(F.col("fewer")).alias("fewer"))
    rest = out.select("g", F.when(F.col("done"), F.col("lp")).otherwise(F.col("lp") - F.log10(F.lit(float(SYMBOLS)) - F.col("fewer"))).alias("lp"))
    return known.unionByName(rest)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts with crc32(key as text) mod 7 = 2 are held out of training; a null key's text is ''. Null and empty texts have one
    token, the end. Repeated rows train and are scored each. Without a training text, all symbols are equally likely. An empty
    table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // CHUNK_BYTES))
    kind = docs.schema[key].dataType.simpleString()
    part = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % PARTS
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t"), (part != REST).alias("trains"))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("k", "t"), F.lit(parts)).cast("int")).repartition(parts, "chunk")
    same = Window.partitionBy("w", "g").orderBy("chunk")
    everywhere = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = cut(asked(dealt).select("chunk", "w", "g", F.sum("n").over(everywhere).alias("n"), (F.row_number().over(same) == 1).alias("first")), "sums")
    firsts = sums.filter("first")
    totals = firsts.filter("w IS NOT NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    all_tokens, distinct = int(totals["n"]), int(totals["v"])
    p = probabilities(cut(firsts.filter("g IS NOT NULL").select("g", "n"), "grams"))
    answers = sums.filter("w IS NOT NULL").select("chunk", "w", F.lit(None).cast("long").alias("g"), F.col("n").cast("double").alias("x")).unionByName(
        sums.filter("g IS NOT NULL").select("chunk", "g").join(p, "g").select("chunk", F.lit(None).cast("binary").alias("w"), "g", F.col("lp").alias("x"))
    )

    def told(texts: pa.Table, answers: pa.Table) -> pa.Table:
        own = answers.filter(answers.column("w").is_valid())
        counts = dict(zip(own.column("w").to_pylist(), own.column("x").to_pylist()))
        own = answers.filter(answers.column("g").is_valid())
        g, lp = own.column("g").to_numpy(), own.column("x").to_numpy()
        at = np.argsort(g)
        g, lp = g[at], lp[at]
        end, below = counts.get(b"", 0.0), float(all_tokens + distinct + 1)
        n_tokens, n_known, base, full = [], [], [], []
        for chunk in texts.column("t").cast(pa.binary()).chunks:
            for i in range(0, len(chunk), 256):
                for t in chunk.slice(i, 256).to_pylist():
                    words = t.lower().split()
                    c = np.append(np.fromiter(map(counts.__getitem__, words), float, len(words)), end)
                    n_tokens.append(len(c))
                    n_known.append(int((c > 0).sum()))
                    base.append(float(np.log10((c + 1) / below).sum()))
                    codes = np.sort(grams(t))
                    full.append(float(lp[np.searchsorted(g, codes)].sum()))
        n = len(n_tokens)
        return pa.table([texts.column("k"), pa.array([not x for x in texts.column("trains").to_pylist()], pa.bool_()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([all_tokens] * n, pa.int64()), pa.array(base, pa.float64()), pa.array(full, pa.float64())], names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"`{key}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(told, schema)
