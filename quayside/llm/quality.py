"""Quality rules: counts of each text, and the perplexity of a modified Kneser-Ney model held against bands of its language.

Each language has a model of its own over the bytes of its texts (ASCII letters without case, digits as one symbol; characters of
other scripts keep all their bytes): it predicts a byte from the four before. Spark counts the 5-grams of all texts of all
languages. A language's discounts and probabilities follow from its counts; they are kept as arrays sorted by the n-grams' hashes,
two for each order, in a file in shared storage. So a model grows with its language's distinct 5-grams, which are far fewer than
its bytes; none is broadcast or gathered. Rows are sorted by language within their partitions, so that a task holds a language's
arrays at a time (MODEL_BYTES in all, if they are small), and looks each distinct n-gram of a slice of texts up in them.

A text's figure is its mean code length in bits a byte (the log of its perplexity). Each language's band lies around the median
of its texts, to each side BAND robust standard deviations and, as the mean of a short text strays further, SHORT over the
square root of its bytes; texts outside go. The medians come
from a histogram in steps of 1/1000 bit, so they cover all texts and don't depend on how rows are dealt out. Of each
language every distinct text counts once, however many copies it has, lest a model learns some by heart. BAND lies between 4 and 5, which were measured on 10,000
documents, labelled in part: of those that pass the base rules 4 keeps 99.97 % of good quality and drops 17 % of poor quality, 5 keeps
all and drops 4 %; on 51,282 others they keep 98.7 and 99.1 %, and drop 22 and 6 %.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import cut, fresh_dir, slices, text_or_empty, unused

ORDER, BITS = 5, 8
BAND, SHORT = 4.5, 2.0
STEP = 1000
BROADCAST_ROWS = 100_000
MODEL_BYTES, HELD = 64 << 20, 1 << 22
SYMBOLS = b"#*$%&|<>"
#: Fixed byte to symbol: A-Z as a-z, digits as 0.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


def grams(text: bytes, order: int = ORDER) -> np.ndarray:
    """The n-gram that ends at each byte, as a number of 8 bits a symbol; spaces stand before the text."""
    x = np.frombuffer(b" " * (order - 1) + text.translate(FOLD), np.uint8)
    n = len(x) - order + 1
    code = x[:n].astype(np.uint64)
    for i in range(1, order):
        code <<= np.uint64(BITS)
        code |= x[i : n + i]
    return code


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """l, gram, n: over all texts of each language. A task adds up what it has seen, and sends it each HELD n-grams."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def sent() -> Iterator[pa.RecordBatch]:
            for l, parts in sums.items():
                code, n = added(parts)
                yield pa.RecordBatch.from_arrays([pa.array([l]).take(pa.array(np.zeros(len(code), np.int64))), pa.array(code.view(np.int64)), pa.array(n)], ["l", "gram", "n"])
            sums.clear()

        for b in slices(batches, "t"):
            texts = b.column("t").cast(pa.binary()).to_pylist()
            for l, rows in by_value(b.column("l").to_pylist()).items():
                code, n = np.unique(np.concatenate([grams(texts[i]) for i in rows]), return_counts=True)
                held = sums.setdefault(l, [])
                held.append((code, n))
                size += len(code)
                if len(held) > 8:
                    before = sum(len(x) for x, _ in held)
                    sums[l] = [added(held)]
                    size -= before - len(sums[l][0][0])
            if size > HELD:
                yield from sent()
                size = 0
        yield from sent()

    given = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("l"), text_or_empty(text).alias("t")).withColumn("th", F.xxhash64("t"))
    return counted_once(given).mapInArrow(task, "l string, gram long, n long").groupBy("l", "gram").agg(F.sum("n").alias("n"))


def counted_once(given: DataFrame) -> DataFrame:
    """l and t: every distinct text of a language once. Copies meet before the shuffle, so a text with many costs one row a task."""
    return given.groupBy("l", "th").agg(F.first("t").alias("t")).select("l", "t")


def by_value(values: list) -> dict:
    out: dict = {}
    for i, v in enumerate(values):
        out.setdefault(v, []).append(i)
    return out


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)


def mixed(code: np.ndarray) -> np.ndarray:
    """A 64-bit hash, one to one."""
    x = code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """For counts of one, two, three or more; fixed ones where too few n-grams have these counts."""
    n1, n2, n3, n4 = (int((n == k).sum()) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.05), k) for k, d in ((1.0, 1 - 2 * y * n2 / n1), (2.0, 2 - 3 * y * n3 / n2), (3.0, 3 - 4 * y * n4 / n3)))


def fit(gram: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order, from 1: hashes (sorted), what the discounted count gives, and the weight left for the lower order by context."""
    model: list = [None] * ORDER
    code, count = gram.astype(np.uint64), n.astype(np.float64)
    for k in range(ORDER, 0, -1):
        d1, d2, d3 = discounts(count)
        off = np.minimum(np.select([count == 1, count == 2], [d1, d2], d3), count)
        context, inverse = np.unique(code >> np.uint64(BITS), return_inverse=True)
        total, left = np.bincount(inverse, count), np.bincount(inverse, off)
        own, rest = (count - off) / total[inverse], left / total
        model[k - 1] = (*by_hash(code, own), *by_hash(context, rest))
        code, count = np.unique(code & np.uint64((1 << BITS * (k - 1)) - 1), return_counts=True)  # in how many contexts
        count = count.astype(np.float64)
    return model


def by_hash(code: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mixed(code)
    at = np.argsort(h)
    return h[at], value[at].astype(np.float32)


def found(hashes: np.ndarray, values: np.ndarray, code: np.ndarray, missing: float) -> np.ndarray:
    if not len(hashes):
        return np.full(len(code), missing)
    h = mixed(code)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[at] == h, values[at].astype(np.float64), missing)


def probability(model: list, code: np.ndarray) -> np.ndarray:
    """Of the last symbol of each n-gram after the ones before it."""
    p = np.full(len(code), 1.0 / (1 << BITS))
    for k in range(1, ORDER + 1):
        part = code & np.uint64((1 << BITS * k) - 1)
        grams_, own, contexts, rest = model[k - 1]
        p = found(grams_, own, part, 0.0) + found(contexts, rest, part >> np.uint64(BITS), 1.0) * p
    return p


def counted(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    n = len(words)
    chars = sum(map(len, words))
    if not text.isascii():
        raw = np.frombuffer(text, np.uint8)
        chars -= int(((raw & 0xC0) == 0x80).sum())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    dups = 0
    if n:
        lines = [x for x in text.split(b"\n") if x.strip()]
        dups = len(lines) - len(set(lines))
    repeats = 0
    ids: dict[bytes, int] = {}
    if n >= 4:
        code = np.fromiter(map(ids.setdefault, words, range(n)), np.int64, n)
        if len(ids) < n:
            if n < 1 << 21:
                window = (code[:-2] << 42) | (code[1:-1] << 21) | code[2:]
            else:
                window = np.unique(np.stack([code[:-2], code[1:-1], code[2:]], 1), axis=0, return_inverse=True)[1].ravel()
            order = np.argsort(window, kind="stable")
            same = window[order[1:]] == window[order[:-1]]
            if same.any():
                twice = np.zeros(n - 2, bool)
                twice[order[1:][same]] = twice[order[:-1][same]] = True
                cover = np.zeros(n, bool)
                for i in range(3):
                    cover[i : n - 2 + i] |= twice
                repeats = int(cover.sum())
    return n, chars, symbols, dups, repeats


def models(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """l, file: a model of each language, written to shared storage under a name of its own attempt."""
    folder = fresh_dir(docs.sparkSession, "models")

    def written(counts: pd.DataFrame) -> pd.DataFrame:
        l = counts["l"].iloc[0]
        model = fit(counts["gram"].to_numpy(), counts["n"].to_numpy())
        out = io.BytesIO()
        np.savez(out, *(x for order in model for x in order))
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name = f"{hashlib.sha256(l.encode()).hexdigest()}-{uuid4().hex}.npz"
        with store.open_output_stream(f"{base}/{name}", compression=None) as f:
            f.write(out.getvalue())
        return pd.DataFrame({"l": [l], "file": [f"{folder}/{name}"]})

    return cut(gram_counts(docs, text, lang).groupBy("l").applyInPandas(written, "l string, file string"), "model-files")


class Models:
    """The models that a task has read last, MODEL_BYTES of them or one."""

    def __init__(self) -> None:
        self.held: dict[str, tuple[list, int]] = {}

    def __getitem__(self, file: str) -> list:
        if file not in self.held:
            store, path = fs.FileSystem.from_uri(file)
            with store.open_input_file(path) as f:
                data = f.read()
            while self.held and sum(n for _, n in self.held.values()) + len(data) > MODEL_BYTES:
                del self.held[next(iter(self.held))]
            parts = np.load(io.BytesIO(data))
            arrays = [parts[x] for x in parts.files]
            self.held[file] = [tuple(arrays[4 * k : 4 * k + 4]) for k in range(ORDER)], len(data)
        return self.held[file][0]


def bits_of(texts: list[bytes], model: list) -> np.ndarray:
    """Of each text (none is empty) the mean code length of its bytes. Each distinct n-gram is looked up once."""
    code, at = np.unique(np.concatenate([grams(t) for t in texts]), return_inverse=True)
    cost = -np.log2(probability(model, code))
    sizes = np.array([len(t) for t in texts])
    return np.add.reduceat(cost[at], np.cumsum(sizes) - sizes) / sizes


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """A row for each row of docs: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, bits, kept.

    Null and empty texts have no words and fail; a null language is as the language ''. bits: mean code length a byte, 0 for
    an empty text. Repeated rows and keys are kept as they are. An empty table gives no rows.
    """
    return verdicts(docs, key, text, lang).select(F.col("k").alias(key), *COUNTS, "base_failed", "bits", "kept")


def verdicts(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """k, th (hash of the text), l, the counts, base_failed, bits, kept."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Models()
        for b in slices(batches, "t"):
            texts = b.column("t").cast(pa.binary()).to_pylist()
            base = np.array([counted(x) for x in texts], np.int64).reshape(-1, 5)
            bits = np.zeros(len(texts))
            for file, rows in by_value(b.column("file").to_pylist()).items():
                if rows := [i for i in rows if texts[i]]:
                    bits[rows] = bits_of([texts[i] for i in rows], read[file])
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("th"), b.column("l"), *(pa.array(base[:, i]) for i in range(5)), pa.array(bits), pa.array([len(x) for x in texts], pa.int64())], ["k", "th", "l", *COUNTS, "bits", "size"])

    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("k"), F.xxhash64(text_or_empty(text)).alias("th"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("l"), text_or_empty(text).alias("t"))
    filed = given.join(models(docs.select(text, lang), text, lang), "l", "left").select("k", "th", "l", "t", "file").sortWithinPartitions("file")
    rows = cut(filed.mapInArrow(task, f"k {kind}, th long, l string, {', '.join(f'{c} long' for c in COUNTS)}, bits double, size long"), "quality")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    inside = F.round(F.col("bits") * STEP).cast("long")
    steps = cut(rows.filter("NOT base_failed").groupBy("l", inside.alias("x")).agg(F.count("*").alias("n")), "steps")
    centre = median(steps, "centre")
    spread = median(steps.join(centre, "l").groupBy("l", F.abs(F.col("x") - F.col("centre")).alias("x")).agg(F.sum("n").alias("n")), "spread")
    bands = cut(centre.join(spread, "l").select("l", "centre", (F.col("spread") * 1.4826 * BAND).alias("wide")), "bands")
    if bands.count() <= BROADCAST_ROWS:  # a row for each language; beyond, Spark splits the join's large languages
        bands = F.broadcast(bands)
    inside_band = F.abs(F.col("bits") * STEP - F.col("centre")) <= F.col("wide") + SHORT * STEP / F.sqrt("size")
    return rows.join(bands, "l", "left").select("k", "th", "l", *COUNTS, "base_failed", "bits", (~F.col("base_failed") & F.coalesce(inside_band, F.lit(True))).alias("kept"))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def median(histogram: DataFrame, name: str) -> DataFrame:
    """l and the least x with at least half of its n at or below; a language has some thousands of steps at most."""
    so_far = Window.partitionBy("l").orderBy("x")
    everything = Window.partitionBy("l")
    marked = histogram.select("l", "x", F.sum("n").over(so_far).alias("up"), F.sum("n").over(everything).alias("all"))
    return marked.filter("2 * up >= all").groupBy("l").agg(F.min("x").alias(name))


def good(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that are kept, all columns. Rows that share a key are judged each by its own text and language."""
    k, th, l, hashed, name = unused(docs, "k", "th", "l", "hashed", "name")
    kept = verdicts(docs, key, text, lang).filter("kept").select(F.col("k").alias(k), F.col("th").alias(th), F.col("l").alias(l))
    marked = docs.withColumn(hashed, F.xxhash64(text_or_empty(text))).withColumn(name, F.coalesce(F.col(lang).cast("string"), F.lit("")))
    both = marked[key].eqNullSafe(kept[k]) & (marked[hashed] == kept[th]) & (marked[name] == kept[l])
    return marked.join(kept, both, "left_semi").drop(hashed, name)
