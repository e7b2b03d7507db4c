"""Values behind known labels, by kind of paper: the older reading, which takes labels one by one, the longest first, over a whole text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators.batches import listed
from quayside.operators.profile_batches import collapsed, has, pieces

#: Fields that many kinds of papers have, and their labels.
COMMON = {
    "FOB": ("FOB", "F.O.B"),
    "CIF": ("CIF", "C.I.F"),
    "品名": ("Description", "Commodity", "Goods", "Product", "品名", "貨名"),
    "件數": ("Packages", "Package", "PCS", "CTNS", "Quantity", "Qty", "件數", "箱數"),
    "毛重": ("Gross Weight", "G.W.", "GW", "毛重"),
    "淨重": ("Net Weight", "N.W.", "NW", "淨重"),
    "船名航次": ("Vessel Voyage", "Vessel/Voyage", "Vessel", "Voyage", "船名航次", "船名", "航次"),
    "貨櫃號": ("Container No", "Container Number", "Container", "CNTR", "貨櫃號", "櫃號"),
    "港口": ("Port of Loading", "Port of Discharge", "POL", "POD", "Port", "港口"),
}
GOODS, CARRIED = ("品名", "件數", "毛重", "淨重"), ("船名航次", "貨櫃號", "港口", "件數", "毛重", "淨重")
#: The fields that only one kind has, and those of COMMON that each kind has beside them.
OWN = {
    "INV": {"發票號碼": ("Invoice No", "Invoice Number", "Inv No", "發票號碼", "發票編號")},
    "PKG": {},
    "B/L": {},
    "倉單": {"貨櫃場": ("Container Yard", "CY", "貨櫃場"), "倉號": ("Warehouse No", "Warehouse", "倉號", "倉庫")},
    "訂艙單 / SO": {"結關日": ("Closing Date", "Cut Off", "CY Cut", "結關日"), "開船日": ("ETD", "Sailing Date", "Departure Date", "開船日")},
    "DS2報單": {
        "稅則": ("HS Code", "Tariff", "Commodity Code", "稅則", "稅則號別"),
        "稅率": ("Tax Rate", "Duty Rate", "Rate", "稅率"),
        "稅金": ("Tax", "Duty", "稅金", "進口稅"),
        "納稅辦法": ("Tax Payment", "Payment Method", "納稅辦法", "納稅方式"),
        "運費": ("Freight", "運費"),
        "保費": ("Insurance", "保費"),
    },
}
SHARED = {"INV": ("FOB", "CIF", *GOODS), "PKG": GOODS, "B/L": CARRIED, "倉單": CARRIED, "訂艙單 / SO": CARRIED, "DS2報單": tuple(COMMON)}
#: Other names of kinds, the kinds of files that are read, what is said of others, and the longest value.
NAMES = {"DS2": "DS2報單", "訂艙單": "訂艙單 / SO", "SO": "訂艙單 / SO", "S/O": "訂艙單 / SO"}
READ = (".pdf", ".txt", ".csv")
UNREAD = "目前 parser 先支援 PDF/TXT/CSV，尚未支援："
LONGEST = 160
SIGNS, AROUND = ":：#", " \t:："

Tables = dict[str, dict[str, tuple[str, ...]]]
TABLES: Tables = {kind: OWN[kind] | {f: COMMON[f] for f in SHARED[kind]} for kind in OWN}


def kind_of(v: Column, names: dict[str, str] = NAMES) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), v), v)


def suffix(source: Column) -> Column:
    return F.lower(F.regexp_extract(source, r"(\.[^./\\]*)$", 1))


def tidy(text: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The lines that aren't blank, each with single blanks, and the places of their texts."""
    cut = pc.split_pattern_regex(pc.fill_null(text, ""), "[\r\n]")
    of, lines = np.repeat(np.arange(len(text)), np.diff(cut.offsets.to_numpy())), collapsed(cut.flatten())
    full = pc.not_equal(lines, "").to_numpy(zero_copy_only=False)
    return of[full], lines.filter(pa.array(full))


def alike(text: str) -> str:
    """Letters as a comparison without case sees them, one by one."""
    if text.isascii():
        return text.lower()
    return "".join((c.upper() if len(c.upper()) == 1 else c).lower()[0] for c in text)


#: A field's place among its kind's, a rank (labels from the longest on, each at the start of a line before anywhere), and the label
#: where only a comparison without case takes the letters for its own.
Hit = tuple[int, int, str | None]


def finder(tables: Tables) -> tuple[int, Callable[[str, str], list[Hit]]]:
    """The length of the longest label, and what a kind's labels say of the end of a line that stands before a sign."""
    rows = {kind: [(f, 2 * rank, alike(x), x.lower()) for f, labels in enumerate(fields.values()) for rank, x in enumerate(sorted(labels, key=len, reverse=True))] for kind, fields in tables.items()}

    def find(kind: str, end: str) -> list[Hit]:
        out: list[Hit] = []
        text, low = alike(end), end.lower()
        for field, rank, name, plain in rows[kind]:
            if text.endswith(name):
                odd = None if low.endswith(plain) else plain
                out += [(field, rank, odd)] * (text == name) + [(field, rank + 1, odd)]
        return out

    return max((len(x) for fields in tables.values() for labels in fields.values() for x in labels), default=0), find


def later_signs(line: str, longest: int) -> list[tuple[int, str, str]]:
    """place, end, value of the signs of a line after its first that have something behind them."""
    at = [i for i, c in enumerate(line) if c in SIGNS]
    last, starts = len(line.rstrip(AROUND)), {}
    for i, until in zip(reversed(at), [len(line), *reversed(at)]):
        between = line[i + 1 : until].lstrip(AROUND)
        starts[i] = until - len(between) if between or until == len(line) or line[until] == "#" else starts[until]
    # blanks are single, and one character more than the longest label tells whether a line starts with it
    return [(i, line[max(0, i - longest - 2) : i].rstrip(" ")[-longest - 1 :], line[starts[i] : min(starts[i] + LONGEST, last)]) for i in at[1:] if i + 1 < len(line)]


def values_under(lines: pa.Array, at: np.ndarray) -> list[str]:
    return pc.utf8_slice_codeunits(pc.utf8_trim(lines.take(pa.array(at)), AROUND), 0, LONGEST).to_pylist()


def signs_of(of: np.ndarray, lines: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Of each sign with something behind it: its line, its order within it, the end of what stands before it, and the value. What
    stands before or behind may be the line beside its own."""
    line = np.flatnonzero(has(lines, f"[{SIGNS}]"))
    cut = pc.split_pattern_regex(lines.take(pa.array(line)), f"[{SIGNS}]", max_splits=1).flatten()
    before, behind = pc.utf8_rtrim(cut.take(pa.array(np.arange(0, len(cut), 2))), " "), cut.take(pa.array(np.arange(1, len(cut), 2)))
    several = np.flatnonzero(has(behind, f"[{SIGNS}]"))
    first, last = pc.equal(before, "").to_numpy(zero_copy_only=False), pc.equal(behind, "").to_numpy(zero_copy_only=False)
    own = np.concatenate([of, [-1]])
    beside = lambda step, where: np.where(where & (own[np.clip(line + step, -1, len(of))] == own[line]), line + step, -1)
    above, below = beside(-1, first), beside(1, last)
    taken = lambda x, at: pc.if_else(pa.array(at >= 0), lines.take(pa.array(np.maximum(at, 0))), x) if (at >= 0).any() else x
    ends = pc.utf8_slice_codeunits(taken(before, above), -longest - 1, 2**31 - 1)
    values = pc.utf8_slice_codeunits(pc.utf8_trim(taken(behind, below), AROUND), 0, LONGEST)
    kept = np.flatnonzero(~last | (below >= 0))
    by = pa.array(kept)
    more, other = [], []
    held: dict[str, list[tuple[int, str, str]]] = {}
    under = values_under(lines, np.minimum(line[several] + 1, len(of) - 1))
    for i, text, next_value in zip(line[several].tolist(), lines.take(pa.array(line[several])).to_pylist(), under, strict=True):
        if text not in held:
            held[text] = later_signs(text, longest)
        found = held[text]
        # the last sign of a line may have its value on the next one
        if text[-1] in SIGNS and own[i + 1] == own[i]:
            at = len(text) - 1
            found = [*found, (at, text[max(0, at - longest - 2) : at].rstrip(" ")[-longest - 1 :], next_value)]
        more += [i] * len(found)
        other += found
    place, end, value = zip(*other, strict=True) if other else ((), (), ())
    joined = lambda a, b: pa.concat_arrays([a.take(by), pa.array(b, pa.string())])
    return np.concatenate([line[kept], np.array(more, np.int64)]), np.concatenate([np.full(len(kept), -1, np.int64), np.array(place, np.int64)]), joined(ends, end), joined(values, value)


def fields_of(kind: pa.Array, text: pa.Array, tables: Tables) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """The text's place, field and value of what labels tell, in the texts' order. A text is cut at its signs, and each distinct end of
    what stands before them is held against its kind's labels once."""
    kinds = list(tables)
    own = pc.fill_null(pc.index_in(kind, pa.array(kinds, pa.string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    asked = np.flatnonzero(own >= 0)
    of, lines = tidy(text.take(pa.array(asked)))
    longest, find = finder(tables)
    line, place, ends, values = signs_of(of, lines, longest)
    codes = ends.dictionary_encode()
    n, names = max(len(codes.dictionary), 1), codes.dictionary.to_pylist()
    which, pair = np.unique(own[asked[of[line]]] * n + codes.indices.to_numpy().astype(np.int64), return_inverse=True)
    hits = [find(kinds[w // n], names[w % n]) for w in which.tolist()]
    many = np.array([len(h) for h in hits], np.int64)
    start, flat = np.cumsum(many) - many, [x for h in hits for x in h]
    times = many[pair]
    sign = np.repeat(np.arange(len(line)), times)
    hit = np.repeat(start[pair], times) + np.arange(len(sign)) - np.repeat(np.cumsum(times) - times, times)
    if any(x[2] is not None for x in flat):
        # a label counts only where the text's small letters hold it somewhere
        low: dict[int, str] = {}
        held = lambda t: low.setdefault(t, "\n".join(lines.filter(pa.array(of == t)).to_pylist()).lower())
        there = np.array([flat[h][2] is None or flat[h][2] in held(int(of[line[s]])) for s, h in zip(sign.tolist(), hit.tolist(), strict=True)], bool)
        sign, hit = sign[there], hit[there]
    field, rank = (np.array([x[k] for x in flat], np.int64)[hit] for k in (0, 1))
    row = of[line[sign]]
    order = np.lexsort((place[sign], line[sign], rank, field, row))
    row, field, rank, sign = row[order], field[order], rank[order], sign[order]
    same = lambda *x: np.concatenate([[False], np.logical_and.reduce([v[1:] == v[:-1] for v in x])]) if len(x[0]) else np.zeros(0, bool)
    # only the first place of a label counts; where nothing is left of its value, the next label's
    kept = ~same(row, field, rank) & pc.not_equal(values.take(pa.array(sign)), "").to_numpy(zero_copy_only=False)
    row, field, sign = row[kept], field[kept], sign[kept]
    kept = ~same(row, field)
    row, field, sign = asked[row[kept]], field[kept], sign[kept]
    most = max((len(x) for x in tables.values()), default=0)
    table = pa.array([list(x)[i] if i < len(x) else "" for x in tables.values() for i in range(most)], pa.string())
    return row, table.take(pa.array(own[row] * most + field)), values.take(pa.array(sign))


def label_fields(papers: DataFrame, tables: Tables = TABLES) -> DataFrame:
    """papers' columns but text, then field, value: of each field of the paper's kind (doc_type; other names count) the value behind its
    longest label, where a line starts with it before anywhere else. A colon or # stands between, on the same line or the next.

    Null and empty texts, unknown kinds and fields without a value give no rows. No shuffle; a row is read once."""
    kept = [c for c in papers.columns if c != "text"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            row, field, value = fields_of(batch.column("_kind"), batch.column("text"), tables)
            by = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(by) for c in kept), field, value], [*kept, "field", "value"])

    schema = "".join(f"`{c}` {papers.schema[c].dataType.simpleString()}, " for c in kept)
    return papers.select(*kept, kind_of(F.col("doc_type")).alias("_kind"), "text").mapInArrow(each, f"{schema}field string, value string")


def read_papers(papers: DataFrame, keys: list[str], tables: Tables = TABLES) -> DataFrame:
    """keys, kind, source, n_fields, fields, error: one row for each paper; a file of a kind that isn't read has an error and no fields."""
    # every paper stays in its row: its fields are neither joined to it nor gathered
    end = suffix(F.col("source"))
    error = F.when(~end.isin(*READ), F.concat(F.lit(UNREAD), F.regexp_extract("source", r"(\.[^./\\]*)$", 1)))
    told = papers.select(*keys, kind_of(F.col("doc_type")).alias("kind"), "source", error.alias("error"), F.when(error.isNull(), F.col("text")).alias("_t"))
    kept = told.columns[:-1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            row, field, value = fields_of(batch.column("kind"), batch.column("_t"), tables)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), listed(pa.StructArray.from_arrays([field, value], ["field", "value"]), row, batch.num_rows)], [*kept, "fs"])

    found = told.mapInArrow(each, "".join(f"`{c}` {told.schema[c].dataType.simpleString()}, " for c in kept) + "fs array<struct<field string, value string>>")
    lines = F.array_join(F.transform(F.array_sort("fs"), lambda x: F.concat(x["field"], F.lit("="), x["value"])), "\n")
    return found.select(*keys, "kind", "source", F.size("fs").cast("long").alias("n_fields"), lines.alias("fields"), "error")
