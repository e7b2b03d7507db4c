"""Benchmark decontamination by templates: documents that hold an item, word for word or with other numbers, names or units.

Words lose the signs around them. An item has two sets of windows, five words in a row, and a document holds it if it has at
least SIMILARITY of the windows of either. Literal windows fold case and take every word as it stands; an item of fewer than
five words is one window as a whole. In template windows numbers, units after a number, and capitalised words inside a sentence
are typed slots, and windows with fewer than MIN_LITERAL plain words say nothing and don't count. Windows are joined by their
hashes. Template windows are aligned (a place in the document less the place in the item), the greatest alignments first; in
each the slots must fill consistently: one value of the item stands for one value of the document, that of the most windows, and
windows that hold another don't count. A window counts or not by the first alignment that has it.

Before the join, documents' windows pass a Bloom filter of fixed size (2^23 bits, whatever the tables) over the items' windows,
so few are shuffled; the joins are exact. A text has one row for each distinct window, with all its places, so repetitive texts
don't multiply. A document that holds an item has at least one of any set of the item's windows that is larger than what may be
missing; so pairs are found by the item's rarest windows alone, and only these pairs' windows are joined: windows in few items
by their hash, those in more than COMMON items from the pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import cut, slices, text_or_empty

WORDS, SIMILARITY, MIN_LITERAL = 5, 0.8, 3
#: Windows of more items than this are joined from the pairs of the rarer ones; changes the plan only.
COMMON = 8
#: Pairs of places that alignments are counted from at once; a window with more is counted by convolution.
PAIRS = 1 << 20
BLOOM_BITS, BLOOM_SHIFTS = 1 << 23, (0, 20, 40)
UNITS = frozenset(
    "kg g mg t lb lbs oz km m cm mm mi mile miles ft feet foot inch inches in yd l ml liter liters litre litres gal s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent % degrees degree c f k hz khz mhz ghz w kw v a j kj mb gb tb kb mph kmh".encode().split()
)
SIGNS = b".,;:!?\"'()[]{}<>|*#$&=_`~-"
NUMBER = re.compile(rb"[+-]?[0-9][0-9.,:/]*%?")
WITH_UNIT = re.compile(rb"([+-]?[0-9][0-9.,]*)([A-Za-z]+)")
PLAIN, NUM, UNIT, CAPITAL, BOTH, NOTHING = range(6)
SLOT_HASH = {NUM: 0xA5A5A5A501, UNIT: 0xA5A5A5A502, CAPITAL: 0xA5A5A5A503}
ODD = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(64)], np.uint64)
REMEMBERED, BATCH_BYTES = 200_000, 1 << 20
TEMPLATE, LITERAL = range(2)


class Canon:
    """What each distinct word is, found once: its kind, the hashes of its plain and its case-folded form, and whether a sentence ends with it."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.words: list[bytes] = []
        self.kind, self.hash, self.fold, self.stops = np.zeros(0, np.uint8), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)

    def learn(self, words: list[bytes]) -> None:
        kinds, hashes, folds, stops = [], [], [], []
        for w in words:
            core = w.strip(SIGNS)
            low = core.lower()
            if not core:
                kind = NOTHING
            elif NUMBER.fullmatch(core):
                kind = NUM
            elif (m := WITH_UNIT.fullmatch(core)) and m[2].lower() in UNITS:
                kind = BOTH
            elif low in UNITS:
                kind = UNIT
            else:
                kind = CAPITAL if core[:1] != low[:1] and core[1:] == low[1:] and len(core) > 1 else PLAIN
            kinds.append(kind)
            hashes.append(xxhash.xxh3_64_intdigest(low))
            folds.append(hashes[-1] if low.isascii() else xxhash.xxh3_64_intdigest(core.decode(errors="replace").casefold().encode()))
            stops.append(w[-1:] in b".!?:")
        self.words += words
        self.kind = np.concatenate([self.kind, np.array(kinds, np.uint8)])
        self.hash = np.concatenate([self.hash, np.array(hashes, np.uint64)])
        self.fold = np.concatenate([self.fold, np.array(folds, np.uint64)])
        self.stops = np.concatenate([self.stops, np.array(stops, bool)])

    def tokens(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each text: places of its words here, kinds (PLAIN or a slot's) and hashes, and the hashes of its folded words, a number
        and its unit in one; words of signs alone are left out."""
        if len(self.place) > REMEMBERED:
            self.forget()
        lists = [t.replace(b"\n", b" |. ").split() for t in texts]  # signs alone that end a sentence, as a line does
        fresh = list(set().union(*lists).difference(self.place))
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
        self.learn(fresh)
        for ws in lists:
            at = np.fromiter(map(self.place.__getitem__, ws), np.int64, len(ws))
            kind, stops = self.kind[at], self.stops[at]
            begins = np.concatenate([[True], stops[:-1]]) if len(at) else stops
            at, begins = at[kind != NOTHING], begins[kind != NOTHING]
            kind, fold = self.kind[at].copy(), self.fold[at]
            twice = np.where(kind == BOTH, 2, 1)
            second = np.cumsum(twice)[kind == BOTH] - 1
            at, begins, kind = np.repeat(at, twice), np.repeat(begins, twice), np.repeat(kind, twice)
            kind[kind == BOTH] = NUM
            kind[second] = UNIT
            alone = np.flatnonzero(kind == UNIT)
            kind[alone[(alone == 0) | (kind[alone - 1] != NUM)]] = PLAIN  # a unit stands after a number
            kind[(kind == CAPITAL) & begins] = PLAIN
            h = self.hash[at]
            for k, x in SLOT_HASH.items():
                h[kind == k] = x
            yield at, kind, h, fold

    def value(self, place: int, kind: int) -> bytes:
        core = self.words[place].strip(SIGNS)
        if (m := WITH_UNIT.fullmatch(core)) and m[2].lower() in UNITS and kind in (NUM, UNIT):
            core = m[1] if kind == NUM else m[2]
        return core.lower()


def windows(h: np.ndarray, of: np.ndarray, size: int, way: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows of `size` words that lie in one text, and their hashes. of: the text of each word."""
    n = len(h) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    x = np.full(n, ODD[8 + size] if way == LITERAL else 0, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            x += (h[i : n + i] ^ (h[i : n + i] >> np.uint64(29))) * ODD[i]
        x ^= x >> np.uint64(32)
        x *= ODD[7]
    at = np.flatnonzero(of[:n] == of[size - 1 :])
    return at, x[at]


def bloom_place(h: np.ndarray, shift: int) -> np.ndarray:
    return ((h >> np.uint64(shift)) & np.uint64(BLOOM_BITS - 1)).astype(np.int64)


def row_id(text: str) -> Column:
    """With the key, what tells rows apart: those with the same key and text hold the same items."""
    return F.xxhash64(text_or_empty(text))


def windows_of(rows: DataFrame, key: str, text: str, bloom=None, sizes: tuple[int, ...] = ()) -> DataFrame:
    """k, row, way, size, h, places (where the window stands in the text), slots (for each place the values of its slots, joined by spaces), total (how many windows the text has).

    Items (no filter): literal windows of WORDS words, or of the whole text if that is shorter. Documents: literal windows of the
    given sizes. Windows without slots have their first place only in documents.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        bits = None if bloom is None else bloom.value
        for b in slices(batches, "t", BATCH_BYTES):
            texts = b.column("t").cast(pa.binary()).to_pylist()
            found = list(canon.tokens(texts))
            place, kind, hashes, fold = (np.concatenate(x) for x in zip(*found))
            plain = np.concatenate([[0], np.cumsum(kind == PLAIN)])
            for way, size in [(TEMPLATE, WORDS), *((LITERAL, n) for n in (sizes if bits is not None else range(1, WORDS + 1)))]:
                long = np.array([len(f[0] if way == TEMPLATE else f[3]) for f in found])
                of, first = np.repeat(np.arange(len(found)), long), np.cumsum(long) - long
                at, x = windows(hashes if way == TEMPLATE else fold, of, size, way)
                if way == TEMPLATE:
                    keep = plain[at + WORDS] - plain[at] >= MIN_LITERAL
                    at, x = at[keep], x[keep]
                elif bits is None:
                    keep = np.minimum(long, WORDS)[of[at]] == size
                    at, x = at[keep], x[keep]
                total = np.bincount(of[at], minlength=len(found))
                if bits is not None:
                    for shift in BLOOM_SHIFTS:
                        keep = bits[bloom_place(x, shift)]
                        at, x = at[keep], x[keep]
                if not len(at):
                    continue
                order = np.lexsort((x, of[at]))  # stable: a window's places ascend
                at, x = at[order], x[order]
                head = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (of[at[1:]] != of[at[:-1]])]))
                times = np.diff(np.append(head, len(at)))
                free = np.ones(len(head), bool) if way == LITERAL else plain[at[head] + WORDS] - plain[at[head]] == WORDS
                if bits is not None:  # without slots one place is enough
                    keep = np.repeat(~free, times)
                    keep[head] = True
                    at = at[keep]
                    times = np.where(free, 1, times)
                    x, own = x[head], of[at[np.cumsum(times) - times]]
                else:
                    x, own = x[head], of[at[head]]
                slotted = np.repeat(~free, times).tolist()
                slots = [b" ".join(canon.value(int(place[i + j]), int(kind[i + j])) for j in np.flatnonzero(kind[i : i + WORDS] != PLAIN).tolist()) if s else b"" for i, s in zip(at.tolist(), slotted)]
                ends = pa.array(np.concatenate([[0], np.cumsum(times)]), pa.int32())
                i, n = pa.array(own), len(x)
                yield pa.RecordBatch.from_arrays(
                    [b.column("k").take(i), b.column("row").take(i), pa.array(np.full(n, way, np.int32)), pa.array(np.full(n, size, np.int32)), pa.array(x.view(np.int64)), pa.ListArray.from_arrays(ends, pa.array(at - first[of[at]])), pa.ListArray.from_arrays(ends, pa.array(slots, pa.binary())), pa.array(total[own])],
                    ["k", "row", "way", "size", "h", "places", "slots", "total"],
                )

    kind = rows.schema[key].dataType.simpleString()
    given = rows.select(F.col(key).alias("k"), row_id(text).alias("row"), text_or_empty(text).alias("t"))
    return given.mapInArrow(task, f"k {kind}, row long, way int, size int, h long, places array<long>, slots array<binary>, total long")


def alignments(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Shifts (a document's place less an item's) and how many windows stand so, the most first; pairs: places of each window."""
    least = min(int(d[0]) - int(i[-1]) for i, d in pairs)
    size = max(int(d[-1]) - int(i[0]) for i, d in pairs) - least + 1
    count, held, n = np.zeros(size, np.int64), [], 0
    for i, d in pairs:
        if len(i) * len(d) > PAIRS:
            long = 1 << int(size + i[-1] - i[0] + 1).bit_length()
            a, b = np.zeros(long), np.zeros(long)
            a[d - d[0]], b[i[-1] - i] = 1, 1
            out = np.rint(np.fft.irfft(np.fft.rfft(a) * np.fft.rfft(b), long)).astype(np.int64)
            start = int(d[0]) - int(i[-1]) - least
            wide = int(d[-1] - d[0]) + int(i[-1] - i[0]) + 1
            count[start : start + wide] += out[:wide]
        else:
            held.append((d[:, None] - i[None, :]).ravel() - least)
            n += len(held[-1])
            if n > PAIRS:
                count += np.bincount(np.concatenate(held), minlength=size)
                held, n = [], 0
    if held:
        count += np.bincount(np.concatenate(held), minlength=size)
    some = np.flatnonzero(count)
    some = some[np.argsort(-count[some], kind="stable")]
    return some + least, count[some]


def agreed(windows: list) -> int:
    """How many of an item's windows a document has: of (places, slots) in the item and (their, fillings) in the document."""
    n, pairs, values, fillings = 0, [], {}, {}
    for w in windows:
        if not any(w["slots"]):
            n += len(w["places"])
        else:
            pairs.append((np.array(w["places"]), np.array(w["their"])))
            values |= zip(w["places"], map(bytes, w["slots"]))
            fillings |= zip(w["their"], map(bytes, w["fillings"]))
    if not pairs:
        return n
    low = min(int(d[0]) for _, d in pairs)
    which = np.full(max(int(d[-1]) for _, d in pairs) - low + 2, -1)  # of each place of the document its window; the last is none
    for j, (_, d) in enumerate(pairs):
        which[d - low] = j
    open_ = np.concatenate([i for i, _ in pairs])
    own = np.repeat(np.arange(len(pairs)), [len(i) for i, _ in pairs])
    for shift in alignments(pairs)[0].tolist():
        at = open_ + shift - low
        fits = which[np.where((at >= 0) & (at < len(which) - 1), at, -1)] == own
        if fits.any():
            said = [tuple(zip(values[p].split(b" "), fillings[p + shift].split(b" "))) for p in open_[fits].tolist()]
            n += consistent(said)
            open_, own = open_[~fits], own[~fits]
            if not len(open_):
                break
    return n


def consistent(said: list[tuple[tuple[bytes, bytes], ...]]) -> int:
    """Of an alignment's windows, each as pairs of an item's value and the document's, how many agree."""
    votes = Counter(pair for pairs in said for pair in set(pairs))
    stands: dict[bytes, bytes] = {}
    for a, b in sorted(votes, key=lambda p: (-votes[p], p)):
        stands.setdefault(a, b)
    return sum(all(stands[a] == b for a, b in pairs) for pairs in said)


def filter_bits(items: DataFrame):
    """The Bloom filter of the items' windows, one bit for each place: OR-ed from tasks' own places, never from rows gathered."""
    spark = items.sparkSession

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BLOOM_BITS, bool)
        for b in batches:
            for shift in BLOOM_SHIFTS:
                bits[bloom_place(b.column("h").to_numpy(zero_copy_only=False).view(np.uint64), shift)] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(bits).astype(np.int32))], ["p"])

    places = items.select("h").mapInArrow(task, "p int").distinct().toArrow().column(0).to_numpy()  # at most 2^23
    bits = np.zeros(BLOOM_BITS, bool)
    bits[places] = True
    return spark.sparkContext.broadcast(bits)


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """key, row (row_id of its text), item, share: the items that a row's text holds and the share of their windows that it has.

    Null and empty texts, and those of signs alone, hold nothing and are held by none; an empty table gives no rows. Rows that
    repeat a key are judged each by its own text, of documents as of items. Other columns are ignored.
    """
    given = benchmark.select(F.col(item).alias("k"), text_or_empty(item_text).alias("t")).withColumn("row", row_id("t")).dropDuplicates(["k", "row"])
    same = ["h", "way", "size"]
    found = windows_of(given, "k", "t").select(F.struct("k", "row").alias("item"), *same, "places", "slots", "total")
    items = cut(found, "items")
    sizes = tuple(sorted(r["size"] for r in items.filter(F.col("way") == LITERAL).select("size").distinct().collect()))  # at most WORDS
    theirs = windows_of(docs, key, text, filter_bits(items), sizes).select(F.struct("k", "row").alias("doc"), *same, F.col("places").alias("their"), F.col("slots").alias("fillings"))
    own = cut(theirs, "windows").dropDuplicates(["doc", *same])
    # an item's rarest windows, one more than may be missing
    marked = items.join(own.groupBy(*same).agg(F.count("*").alias("n_docs")), same, "left").join(items.groupBy(*same).agg(F.count("*").alias("n_items")), same)
    before = Window.partitionBy("item", "way").orderBy(F.coalesce("n_docs", F.lit(0)), "h").rowsBetween(Window.unboundedPreceding, -1)
    marked = cut(marked.withColumn("before", F.coalesce(F.sum(F.size("places")).over(before), F.lit(0))), "seeds")
    missing = F.col("total") - F.ceil(F.lit(similarity) * F.col("total") - 1e-9)
    seeds = marked.filter((F.col("before") <= missing) & F.col("n_docs").isNotNull())
    pairs = cut(own.select("doc", *same).join(seeds.select("item", *same), same).select("doc", "item", "way").distinct(), "pairs")
    few = own.join(marked.filter(F.col("n_items") <= COMMON), same).join(pairs, ["doc", "item", "way"], "left_semi")
    shared = marked.filter(F.col("n_items") > COMMON)
    many = pairs.join(own.join(shared.select(*same).distinct(), same, "left_semi"), ["doc", "way"]).join(shared, ["item", *same])
    columns = ["doc", "item", "way", "total", F.struct("places", "slots", "their", "fillings").alias("w")]
    both = few.select(*columns).unionByName(many.select(*columns))
    held = both.groupBy("doc", "item", "way").agg(F.collect_list("w").alias("ws"), F.max("total").alias("total"))
    shares = held.select("doc", "item", (F.udf(agreed, "bigint")("ws") / F.col("total")).alias("share")).filter(F.col("share") >= similarity)
    best = shares.groupBy("doc", "item").agg(F.max("share").alias("share"))
    return best.select(F.col("doc.k").alias(key), F.col("doc.row").alias("row"), F.col("item.k").alias("item"), "share")


def marked(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row for each row of docs: key, contaminated, n_items, item_ids (sorted, comma-joined), share (the greatest, else 0)."""
    found = matches(docs, benchmark, key, text, item, item_text, similarity).groupBy(F.col(key).alias("_k"), F.col("row").alias("_r")).agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("share").alias("share"))
    both = docs.select(key, row_id(text).alias("_row")).join(found, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_row") == F.col("_r")), "left")
    return both.select(key, F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.array_join(F.col("items").cast("array<string>"), ","), F.lit("")).alias("item_ids"), F.coalesce("share", F.lit(0.0)).alias("share"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that hold no item, all columns."""
    found = matches(docs, benchmark, key, text, item, item_text, similarity).select(F.col(key).alias("_k"), F.col("row").alias("_r")).distinct()
    return docs.join(found, docs[key].eqNullSafe(found["_k"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == found["_r"]), "left_anti")
