"""Personal data: patterns, and a skip-chain conditional random field that carries their labels to what only resembles them.

Patterns (the base) find e-mail addresses, IP addresses, card and telephone numbers. The field labels a text's candidate tokens
(those with a digit or an @) as one of the four, as a secret (an access token or password: no pattern finds those, the field
alone does) or as nothing. Its factors: shape
and context of a token; neighbouring candidates; and skip edges, which link each token to the next one in the text that repeats
it or resembles it (same digits, same last seven digits, same address). Loopy sum-product messages over all edges give each
token's label; so a number written once with its country code and once without gets one label in both places. A chain of links
has the group's size; no pairs within a group are made.

Weights are fitted by pseudo-likelihood on labels that the patterns give, and for secrets a cue before a long token, on at most
SAMPLE texts and SAMPLE_TOKENS tokens of each (the texts of the smallest hashes); labels spread over skip edges first. In a third of these tokens the features that the
patterns look at are hidden, so the field has to use the others and the links. Without any sample it adds nothing.

The texts are read once: a first pass stores patterns' spans, candidates and edges, without text; fitting and messages use those.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import cut, slices

KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "secret")
SAMPLE, SAMPLE_TOKENS = 2000, 200
SIGNS = "=:|-<>()[]{}\"'.,;!?#*"
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # begun inside a run of digits it would end as from its start
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
CANDIDATE = re.compile(r"[^\x20\x09-\x0D]+")
CUES = (frozenset("email e-mail mail mailto contact write".split()), frozenset("ip host server address ipv4 addr".split()), frozenset("card visa mastercard amex credit payment".split()), frozenset("phone tel telephone call mobile fax cell".split()))
ROUNDS, DAMP, SURE = 8, 0.3, 0.8
#: Features that the patterns themselves look at: hidden in part of the sample.
HIDDEN = (1, 4, 6, 11, 22)
N_FEATURES = 24
SECRET_CUES = frozenset("token secret password passwd pwd key apikey api_key api-key access_key bearer auth".split())
SECRET_CHARS = 16
WRAPS = ".,;:!?\"'<>()[]{}|"
GLUED = re.compile(r"([A-Za-z_-]+)[=:][\"'(<]*(?=[^\"'(<])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As leftmost matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from each @: in proportion to the text."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            found.append((start, last))
        at = text.find("@", max(last, at + 1))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost and not overlapping within a kind; matches that fail their check are dropped."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p) < 4 and int(p or 0) < 256 for p in (x.lstrip("0") for x in m[0].split(".")))]
        for m in CARD.finditer(text):
            digits = "".join(DIGIT.findall(m[0]))
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(found)


def candidates(text: str) -> tuple[list[tuple[int, int]], list[int], list[tuple[int, int, int]]]:
    """Spans of the candidate tokens (without signs at their ends), features as bits, edges (token, token, 0 near or 1 skip)."""
    spans, feats, edges = [], [], []
    keys: dict[tuple, int] = {}
    before, last_end, run = "", -9, []

    def link(key: tuple, i: int) -> None:
        if (j := keys.get(key, i)) != i:
            edges.append((j, i, 1))
        keys[key] = i

    def close() -> None:  # a run of number tokens: one number, perhaps
        digits = "".join(DIGIT.findall("".join(text[a:b] for a, b in (spans[i] for i in run))))
        for at, i in enumerate(reversed(run)):
            if len(digits) >= 7:
                link(("digits", digits[-7:], at), i)
            feats[i] |= (1 << 12) * (7 <= len(digits) <= 9) | (1 << 13) * (10 <= len(digits) <= 13) | (1 << 14) * (14 <= len(digits) <= 19) | (1 << 11) * (14 <= len(digits) <= 19 and luhn(digits))
        run.clear()

    for m in CANDIDATE.finditer(text):
        word = m[0]
        if "@" in word or DIGIT.search(word):
            glued = GLUED.match(word.lstrip(WRAPS))
            cue = (glued[1] if glued else before).lower().strip(WRAPS + "#=")
            rest = word.lstrip(WRAPS)[glued.end() :] if glued else word
            core = rest.strip(WRAPS)
            start = m.start() + len(word) - len(rest) + rest.find(core) if core else m.start()
            core = core or word
            end, i, n = start + len(core), len(spans), len(DIGIT.findall(core))
            bits = 1 | (1 << 1) * ("@" in core) | (1 << 2) * bool(re.search(r"\.[A-Za-z]{2,}$", core)) | (1 << 3) * bool(re.search("[A-Za-z]", core)) | (1 << 4) * core.startswith("+") | (1 << 5) * (core.count(".") == 3)
            bits |= (1 << 6) * bool(re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", core)) | (1 << 7) * ("-" in core) | (1 << 8) * (n <= 2) | (1 << 9) * (3 <= n <= 4) | (1 << 10) * (n >= 10)
            for k, cues in enumerate(CUES):
                bits |= (1 << 15 + k) * (cue in cues)
            bits |= (1 << 19) * (start - last_end == 1)
            long = len(core) >= SECRET_CHARS and n > 1 and "@" not in core
            bits |= (1 << 20) * long | (1 << 21) * (long and bool(re.fullmatch("[0-9A-Fa-f]+", core))) | (1 << 22) * (cue in SECRET_CUES) | (1 << 23) * (long and 0 < n < len(core))
            spans.append((start, end))
            feats.append(bits)
            if start - last_end == 1:
                edges.append((i - 1, i, 0))
            elif run:
                close()
            if n and not bits & 8:
                run.append(i)
            elif run:
                close()
            link(("word", core.lower().lstrip("+")), i)
            if "@" in core:
                link(("name", core.lower().split("@")[0]), i)
            last_end = m.end()
        elif run:
            close()
        if word.strip(SIGNS):
            before = word
    if run:
        close()
    return spans, feats, edges



def read_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, base (start, kind, end of each span), spans (start, end of each candidate), feats, edges (a, b, type): flat arrays."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            rows: list[tuple[list[int], ...]] = []
            for t in b.column("t").to_pylist():
                if t is None:
                    rows.append(([], [], [], []))
                else:
                    spans, feats, edges = candidates(t)
                    rows.append(([x for s in base_spans(t) for x in s], [x for s in spans for x in s], feats, [x for e in edges for x in e]))
            yield pa.RecordBatch.from_arrays([b.column("k"), *(pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in range(4))], ["k", "base", "spans", "feats", "edges"])

    kind = docs.schema[key].dataType.simpleString()
    some = F.when(F.col(text).rlike("[0-9@]"), F.col(text)).alias("t")
    return docs.select(F.col(key).alias("k"), some).mapInArrow(task, f"k {kind}, base array<int>, spans array<int>, feats array<int>, edges array<int>")


def unpacked(feats: np.ndarray) -> np.ndarray:
    return ((feats[:, None] >> np.arange(N_FEATURES)) & 1).astype(np.float64)


def labels_of(spans: np.ndarray, base: np.ndarray, feats: np.ndarray) -> np.ndarray:
    """Of each candidate: 1 + kind of the first pattern's span that holds its start; a secret if it is long and mixed and has the cue; else 0."""
    out = np.where((feats >> 22 & feats >> 23 & 1) > 0, len(LABELS), 0)
    for start, kind, end in base[::-1]:
        out[(spans[:, 0] >= start) & (spans[:, 0] < end)] = kind + 1
    return out


def spread(labels: np.ndarray, skips: np.ndarray) -> None:
    """Tokens without a label take that of a token they repeat or resemble: what is personal data in one place is so in all."""
    while True:
        a, b = labels[skips[:, 0]], labels[skips[:, 1]]
        to_b, to_a = (a > 0) & (b == 0), (b > 0) & (a == 0)
        if not (to_a | to_b).any():
            return
        labels[skips[to_b, 1]] = a[to_b]
        labels[skips[to_a, 0]] = b[to_a]


def fit(rows: list[dict], rounds: int = 600, rate: float = 1.0, keep: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features (N_FEATURES, 6) and of label pairs on near and skip edges (2, 6, 6), by pseudo-likelihood."""
    k = len(LABELS) + 1
    feats, gold, edges, n = [], [], [], 0
    for r in rows:
        f = np.asarray(r["feats"], np.int64)[:SAMPLE_TOKENS]
        feats.append(f)
        gold.append(labels_of(np.asarray(r["spans"], np.int64).reshape(-1, 2)[: len(f)], np.asarray(r["base"], np.int64).reshape(-1, 3), f))
        e = np.asarray(r["edges"], np.int64).reshape(-1, 3)
        e = e[(e[:, :2] < len(f)).all(1)]
        spread(gold[-1], e[e[:, 2] == 1])
        edges.append(e + [n, n, 0])
        n += len(f)
    w, v = np.zeros((N_FEATURES, k)), np.zeros((2, k, k))
    if not n or not any(g.any() for g in gold):
        return w, v
    x, y, e = unpacked(np.concatenate(feats)), np.concatenate(gold), np.concatenate(edges)
    hide = np.random.default_rng(7).random(len(x)) < 1 / 3
    for f in HIDDEN:
        x[hide, f] = 0
    near = np.zeros((2, n, k))  # neighbours' labels, counted, by edge type
    for t in (0, 1):
        own = e[e[:, 2] == t]
        np.add.at(near[t], own[:, 0], np.eye(k)[y[own[:, 1]]])
        np.add.at(near[t], own[:, 1], np.eye(k)[y[own[:, 0]]])
    truth = np.eye(k)[y]
    for _ in range(rounds):
        s = x @ w + near[0] @ v[0] + near[1] @ v[1]
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (truth - p) / len(x)
        w += rate * (x.T @ d * 4 - keep * w)
        for t in (0, 1):
            g = near[t].T @ d
            v[t] += rate * ((g + g.T) * 2 - keep * v[t])
    return w, v


def marginals(feats: np.ndarray, edges: np.ndarray, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Label probabilities of each token after ROUNDS of damped messages over all edges, both ways."""
    node = unpacked(feats) @ w
    if len(edges):
        a, b = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pair, m = np.exp(v)[np.concatenate([edges[:, 2]] * 2)], np.zeros((2 * len(edges), w.shape[1]))
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        for _ in range(ROUNDS):
            total = node.copy()
            np.add.at(total, b, m)
            out = total[a] - m[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(np.einsum("ek,ekl->el", out, pair) + 1e-300)
            m = DAMP * m + (1 - DAMP) * (new - new.max(1, keepdims=True))
        np.add.at(node, b, m)
    p = np.exp(node - node.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def all_spans(base: np.ndarray, spans: np.ndarray, feats: np.ndarray, edges: np.ndarray, w: np.ndarray, v: np.ndarray) -> list[tuple[int, int, int]]:
    """Patterns' spans and those of the field, by start and kind. A token that a pattern's span touches adds none; neighbours of a kind join."""
    out = [tuple(map(int, x)) for x in base]
    if len(spans) and (w.any() or v.any()):
        p = marginals(feats, edges, w, v)
        label = np.where(p.max(1) > SURE, p.argmax(1), 0)
        if len(base):  # spans of the patterns, joined where they overlap
            order = np.argsort(base[:, 0], kind="stable")
            starts, reach = base[order, 0], np.maximum.accumulate(base[order, 2])
            at = np.searchsorted(starts, spans[:, 1]) - 1
            label[(at >= 0) & (reach[np.maximum(at, 0)] > spans[:, 0])] = 0
        last = None
        for i in np.flatnonzero(label):
            start, end, kind = int(spans[i, 0]), int(spans[i, 1]), int(label[i]) - 1
            if last and last[1] == kind and feats[i] >> 19 & 1 and last[3] == i - 1:
                last[2], last[3] = end, int(i)
                out[-1] = tuple(last[:3])
            else:
                last = [start, kind, end, int(i)]
                out.append((start, kind, end))
    return sorted(out)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: key, base and spans, each an array of (kind, start, end) by start, then kind.

    Null and empty texts have none. Repeated rows and keys are kept as they are; null keys too. An empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    held = cut(read_texts(docs, key, text), "pii")
    some = held.filter(F.size("spans") > 0).orderBy(F.xxhash64("k"), F.xxhash64("spans")).limit(SAMPLE)
    bounded = some.select("base", F.slice("spans", 1, 2 * SAMPLE_TOKENS).alias("spans"), F.slice("feats", 1, SAMPLE_TOKENS).alias("feats"), F.filter(F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_TOKENS * 4 - 1)), lambda i: F.struct(F.get("edges", i * 3).alias("a"), F.get("edges", i * 3 + 1).alias("b"), F.get("edges", i * 3 + 2).alias("t"))), lambda x: x["t"].isNotNull()).alias("edges"))
    rows = [{"base": r["base"][: 3 * SAMPLE_TOKENS], "spans": r["spans"], "feats": r["feats"], "edges": [x for e in r["edges"] for x in e]} for r in bounded.collect()]
    sent = spark.sparkContext.broadcast(fit(rows))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        shown = lambda x: [{"kind": LABELS[k], "start": int(a), "end": int(e)} for a, k, e in x]
        for b in batches:
            base, every = [], []
            for r in zip(*(b.column(c).to_pylist() for c in ("base", "spans", "feats", "edges"))):
                x = np.asarray(r[0], np.int64).reshape(-1, 3)
                base.append(shown(x))
                every.append(shown(all_spans(x, np.asarray(r[1], np.int64).reshape(-1, 2), np.asarray(r[2], np.int64), np.asarray(r[3], np.int64).reshape(-1, 3), *sent.value)))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(base, kind), pa.array(every, kind)], [key, "base", "spans"])

    spans = "array<struct<kind:string,start:int,end:int>>"
    return held.mapInArrow(task, f"`{key}` {docs.schema[key].dataType.simpleString()}, base {spans}, spans {spans}")
