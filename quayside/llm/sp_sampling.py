"""Sampled SentencePiece segmentations: Gumbel top-k without replacement by a perturbed A* search over the lattice.

A text's segmentations have probabilities in proportion to exp(THETA * sum of piece scores). The search keeps sets of
segmentations, each with the greatest of its members' Gumbel-perturbed log probabilities. It starts with the set of all. Taking
the best set, it draws the member that holds the maximum, step by step: an edge by its exact conditional probability (backward
sums over the lattice give the heuristic, so it is exact); at each step the segmentations that take another edge become a set of
their own, whose maximum is a Gumbel variable truncated at that of the set they leave. The k best members are k distinct
segmentations, as if drawn one after another without replacement. With the maximum of the sets that remain as threshold t, a
sample's inclusion score is 1 - exp(-exp(log p - t)).

No piece crosses a space or a newline, so a text's lattice is a chain of lattices of its words. A slice of texts builds those
of its distinct words at once, as arrays, and draws an edge for all words of all its texts at a time. Random numbers are hashes
of the seed, the row's key, the sample and the place in the text: the same on any cluster, however rows are dealt.

The model gives characters it lacks as bytes. Pieces of several characters with scores below
-1e8 (the model's runs of spaces) are not sampled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import slices, text_or_empty

SPACE = "▁"
SAMPLES, THETA, SEED = 2, 0.0005, 11
#: Bytes of text sampled at once, and characters of distinct words whose lattice is built at once: they bound a task's memory
#: (a longer text is sampled alone; beyond a block only its edges, at 24 bytes each, and its samples stay).
TEXT_BYTES, BLOCK = 3 << 19, 1 << 18
CHUNK = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")
NONE = np.zeros(0, np.int64)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The vocabulary as a trie: sorted keys (state, character) to states, and each state's piece or -1."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], skipped: set[int]) -> None:
        states: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i, p in enumerate(pieces):
            if i in skipped:
                continue
            if "\n" in p or SPACE in p.lstrip(SPACE):
                raise ValueError("a piece crosses words")
            at = 0
            for c in p:
                at = states.setdefault((at, ord(c)), len(states) + 1)
            ends[at] = i
        keys = np.array([(a << 21) | c for a, c in states], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.array(list(states.values()), np.int64)[order]
        self.begin = np.zeros(0x110000, np.int64)  # the first step, by character; 0: none
        for (a, c), b in states.items():
            if not a:
                self.begin[c] = b
        self.piece = np.full(len(states) + 1, -1, np.int64)
        self.piece[list(ends)] = list(ends.values())
        self.scores, self.byte_ids, self.names = np.array(scores), np.array(byte_ids, np.uint32), pieces
        self.weights = np.append(self.scores, 0.0)  # a character in bytes has the score 0
        data = [p.replace(SPACE, " ").encode() for p in pieces]
        for b, i in enumerate(byte_ids):
            data[i] = bytes([b])
        self.data = np.frombuffer(b"".join(data), np.uint8)
        self.data_ends = np.concatenate([[0], np.cumsum([len(d) for d in data])])

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, in UTF-8, without the space that encoding puts first."""
        start, size = self.data_ends[ids], self.data_ends[ids + 1] - self.data_ends[ids]
        out = self.data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))].tobytes()
        return out[1:] if out[:1] == b" " else out


@cache
def load(path: str) -> Pieces:
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    n = p.vocab_size()
    names, scores = [p.id_to_piece(i) for i in range(n)], [p.get_score(i) for i in range(n)]
    byte_ids = [i for i in range(n) if p.is_byte(i)]
    skipped = {i for i in range(n) if p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i) or scores[i] < -1e8 and len(names[i]) > 1}
    least = min(x for x in scores if x > -1e8)
    scores = [max(x, least) for x in scores]  # the single space has the score of the runs of spaces
    return Pieces(names, scores, byte_ids, skipped)


class Lattice(NamedTuple):
    """Of distinct words. Nodes: places in words, word after word, the place behind a word included. Edges by their first node."""

    base: np.ndarray  # first node of each word
    last: np.ndarray  # of each node: whether its word ends there
    first: np.ndarray  # first edge of each node
    draw: np.ndarray  # probability of this edge and those before it at its node
    end: np.ndarray
    logp: np.ndarray  # given the node
    piece: np.ndarray  # beyond the vocabulary: a character in bytes, at chars
    chars: list[np.ndarray]


def lattice(words: list[str], pieces: Pieces, theta: float) -> Lattice:
    """The lattices of words, built a block at a time."""
    parts, lo, held = [], 0, 0
    for i, w in enumerate(words):
        if held and held + len(w) > BLOCK:
            parts.append(lattice_block(words[lo:i], pieces, theta))
            lo, held = i, 0
        held += len(w)
    parts.append(lattice_block(words[lo:], pieces, theta))
    if len(parts) == 1:
        return parts[0]
    nodes = np.cumsum([0, *(len(x.last) for x in parts)])
    edges = np.cumsum([0, *(len(x.end) for x in parts)])
    odd = np.cumsum([0, *(len(x.chars) for x in parts)])
    n = len(pieces.scores)
    return Lattice(
        np.concatenate([x.base + a for x, a in zip(parts, nodes)]),
        np.concatenate([x.last for x in parts]),
        np.concatenate([*(x.first[:-1] + a for x, a in zip(parts, edges)), edges[-1:]]),
        np.concatenate([x.draw for x in parts]),
        np.concatenate([x.end + np.int32(a) for x, a in zip(parts, nodes)]),
        np.concatenate([x.logp for x in parts]),
        np.concatenate([np.where(x.piece < n, x.piece, x.piece + np.int32(a)) for x, a in zip(parts, odd)]),
        [c for x in parts for c in x.chars],
    )


def lattice_block(words: list[str], pieces: Pieces, theta: float) -> Lattice:
    sizes = np.array([len(w) for w in words], np.int64)
    base = np.cumsum(sizes + 1) - (sizes + 1)
    n = int((sizes + 1).sum())
    code = np.full(n, -1, np.int64)  # a character at each node but the last ones
    inside = np.ones(n, bool)
    inside[base + sizes] = False
    code[inside] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    last = ~inside
    left = np.repeat(base + sizes, sizes + 1) - np.arange(n)
    at, starts, ends, ids = np.flatnonzero(inside), [], [], []
    state = np.zeros(len(at), np.int64)
    single = np.zeros(n, bool)
    step = 0
    while len(at):
        char = code[at + step]
        if step:
            key = (state << 21) | char
            i = np.minimum(np.searchsorted(pieces.keys, key), len(pieces.keys) - 1)
            ok = pieces.keys[i] == key
            at, state = at[ok], pieces.to[i[ok]]
        else:
            state = pieces.begin[char]
            at, state = at[state > 0], state[state > 0]
        step += 1
        piece = pieces.piece[state]
        whole = piece >= 0
        starts.append(at[whole])
        ends.append(starts[-1] + step)
        ids.append(piece[whole])
        if step == 1:
            single[starts[-1]] = True
        more = left[at] > step
        at, state = at[more], state[more]
    odd = np.flatnonzero(inside & ~single)  # characters without a piece go as bytes
    kinds, which = np.unique(code[odd], return_inverse=True)
    chars = [pieces.byte_ids[np.frombuffer(chr(c).encode("utf-8", "surrogatepass"), np.uint8)] for c in kinds.tolist()]
    starts, ends, ids = [*starts, odd], [*ends, odd + 1], [*ids, (which + len(pieces.scores))]
    first = np.zeros(n + 1, np.int64)
    np.cumsum(sum(np.bincount(s, minlength=n) for s in starts), out=first[1:])
    start, end, piece = (np.empty(first[-1], np.int64) for _ in range(3))
    free = first[:-1].copy()
    for s, e, i in zip(starts, ends, ids):  # a node has one edge of each length at most: its next free place
        to = free[s]
        start[to], end[to], piece[to] = s, e, i
        free[s] += 1
    weight = theta * pieces.weights[np.minimum(piece, len(pieces.scores))]
    # backward sums: nodes by how many characters are left
    beta = np.zeros(n)
    longest = int(sizes.max(initial=0))
    lefts = left[start].astype(np.uint16 if longest < 1 << 16 else np.int64)
    by_left = np.argsort(lefts, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(lefts, minlength=longest + 1))])[1:]
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi > lo:
            e = by_left[lo:hi]
            value = weight[e] + beta[end[e]]
            node = start[e]
            head = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            top = np.maximum.reduceat(value, head)
            count = np.diff(np.append(head, len(e)))
            beta[node[head]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, count)), head))
    logp = np.minimum(weight + beta[end] - beta[start], 0.0)
    draw, rank = np.exp(logp), np.arange(len(logp)) - first[start]
    for r in range(1, int(rank.max(initial=0)) + 1):
        e = np.flatnonzero(rank == r)
        draw[e] += draw[e - 1]
    draw[first[1:][first[1:] > first[:-1]] - 1] = 1.0
    return Lattice(base, last, first, draw, end.astype(np.int32), logp, piece.astype(np.int32), chars)


def uniform(seed: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """In (0, 1), a hash of both."""
    with np.errstate(over="ignore"):
        x = seed + GOLD * (counter.astype(np.uint64) + np.uint64(1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) / (1 << 52)


def truncated(loc: np.ndarray, top: np.ndarray | float, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of these locations, given that they are at most top."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        return np.where(np.isneginf(loc), -np.inf, loc - np.log(np.exp(loc - top) - np.log(u)))


class Path(NamedTuple):
    """A sample of one text: its edges, their first nodes, the word of each, the place in the text of each, log probabilities."""

    edge: np.ndarray
    node: np.ndarray
    word: np.ndarray
    place: np.ndarray
    logp: np.ndarray


def drawn(lat: Lattice, node: np.ndarray, seed: np.ndarray, place: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Paths from nodes to the ends of their words: which one each edge belongs to, edge, its node, its place; in order."""
    n, who = len(node), np.flatnonzero(~lat.last[node])
    node, place = node[who], place[who]
    out: list[tuple[np.ndarray, ...]] = []
    while len(who):
        u = uniform(seed[who], place * 2 + (sample << 40))
        e = lat.first[node]
        low = np.flatnonzero(lat.draw[e] <= u)  # a node has few edges
        while len(low):
            e[low] += 1
            low = low[lat.draw[e[low]] <= u[low]]
        out.append((who, e, node, place))
        end = lat.end[e].astype(np.int64)
        place, node = place + (end - node), end
        go = ~lat.last[node]
        who, node, place = who[go], node[go], place[go]
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    steps = sum(np.bincount(x[0], minlength=n) for x in out)
    first, done = np.cumsum(steps) - steps, [np.empty(int(steps.sum()), np.int64) for _ in range(4)]
    for i, parts in enumerate(out):  # each path's i-th edge
        out[i] = ()
        to = first[parts[0]] + i
        for all_, part in zip(done, parts):
            all_[to] = part
    return tuple(done)


def sampled(texts: list[str], keys: list[str], pieces: Pieces, k: int, theta: float, seed: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples, best first: ids, log probability, perturbed log probability, inclusion score."""
    lists = [CHUNK.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    kinds = {w: i for i, w in enumerate(set().union(*lists))}
    lat = lattice(list(kinds), pieces, theta)
    sizes = np.array([len(w) for w in kinds], np.int64)
    seeds = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), seed) for x in keys], np.uint64)
    word = [np.fromiter(map(kinds.__getitem__, ws), np.int64, len(ws)) for ws in lists]
    place = [np.cumsum(sizes[w]) - sizes[w] for w in word]
    found: list[list[Path]] = [[] for _ in texts]
    perturbed: list[list[float]] = [[] for _ in texts]
    open_sets: list[list[np.ndarray]] = [[] for _ in texts]  # of each sample: the maximum of what leaves it at each step
    barred: list[dict[tuple[int, int], list[int]]] = [{} for _ in texts]
    starts: list[tuple[int, int, int, int, float] | None] = [(i, -1, 0, 0, 0.0) for i in range(len(texts))]  # text, sample and step it leaves, edge, top
    for s in range(k):
        live = [x for x in starts if x is not None]
        nodes, who, places, heads = [], [], [], []
        for i, parent, step, edge, _ in live:
            if parent < 0:
                nodes.append(lat.base[word[i]])
                places.append(place[i])
                heads.append(0)
            else:  # the rest of the word behind the new edge, and all words after it
                p = found[i][parent]
                w = int(p.word[step])
                nodes.append(np.concatenate([[lat.end[edge]], lat.base[word[i][w + 1 :]]]))
                places.append(np.concatenate([[p.place[step] + lat.end[edge] - p.node[step]], place[i][w + 1 :]]))
                heads.append(w)
            who.append(np.full(len(nodes[-1]), len(who), np.int64))
        if not live:
            break
        owner = np.concatenate(who)
        text_of = np.array([x[0] for x in live], np.int64)
        offset = np.cumsum([0, *map(len, nodes)])
        one, edges, at, spot = drawn(lat, np.concatenate(nodes), seeds[text_of][owner], np.concatenate(places), s)
        cuts = np.searchsorted(one, offset)
        logp = lat.logp[edges]
        before = np.empty(len(edges))  # the log probability of what a path has before each edge
        tops = np.empty(len(live))
        for j, (i, parent, step, edge, top) in enumerate(live):
            lo, hi = cuts[j], cuts[j + 1]
            if hi > lo:
                before[lo] = found[i][parent].logp[:step].sum() + lat.logp[edge] if parent >= 0 else 0.0
                before[lo + 1 : hi] = before[lo] + np.cumsum(logp[lo : hi - 1])
            tops[j] = top if parent >= 0 else -np.log(-np.log(uniform(seeds[i : i + 1], np.array([1 << 62]))[0]))
        size = np.diff(cuts)
        with np.errstate(divide="ignore"):
            loc = before + np.log(np.maximum(-np.expm1(logp), 0.0))
        loc[lat.first[at + 1] - lat.first[at] == 1] = -np.inf
        fresh = truncated(loc, np.repeat(tops, size), uniform(np.repeat(seeds[text_of], size), spot * 2 + 1 + (s << 40)))
        for j, (i, parent, step, edge, _) in enumerate(live):
            part = slice(cuts[j], cuts[j + 1])
            path = [edges[part], at[part], one[part] - offset[j] + heads[j], spot[part], logp[part]]  # views of all paths' arrays
            if parent < 0:
                open_sets[i].append(fresh[part])
            else:  # the sets before left the parent already, or do below
                p = found[i][parent]
                new = (np.array([x]) for x in (edge, p.node[step], p.word[step], p.place[step], lat.logp[edge]))
                path = [np.concatenate([x[:step], y, z]) for x, y, z in zip(p, new, path)]
                open_sets[i].append(np.concatenate([np.full(step + 1, -np.inf), fresh[part]]))
            found[i].append(Path(*path) if s + 1 < k else Path(path[0], NONE, NONE, NONE, path[4]))  # nothing leaves the last
            perturbed[i].append(float(tops[j]))
            starts[i] = None
        if s + 1 < k:
            for i in range(len(texts)):
                if len(found[i]) == s + 1:
                    starts[i] = leave(i, s, lat, found[i], open_sets[i], barred[i], seeds[i : i + 1])
    out = []
    for i in range(len(texts)):
        rest = max((float(x.max(initial=-np.inf)) for x in open_sets[i]), default=-np.inf)
        rows = []
        for p, g in zip(found[i], perturbed[i]):
            total = float(p.logp.sum())
            with np.errstate(over="ignore"):
                rows.append((ids_of(lat, lat.piece[p.edge], pieces), total, g, float(-np.expm1(-np.exp(total - rest)))))
        out.append(rows)
    return out


def leave(i: int, s: int, lat: Lattice, paths: list[Path], sets: list[np.ndarray], barred: dict[tuple[int, int], list[int]], seed: np.ndarray) -> tuple[int, int, int, int, float] | None:
    """Takes the best open set: draws the edge by which its best member leaves, and puts what is left back."""
    best = [(float(x.max(initial=-np.inf)), j) for j, x in enumerate(sets)]
    top, parent = max(best)
    if np.isneginf(top):
        return None
    step = int(sets[parent].argmax())
    p = paths[parent]
    node = int(p.node[step])
    out = barred.setdefault((parent, step), [int(p.edge[step])])
    edges = np.array([e for e in range(lat.first[node], lat.first[node + 1]) if e not in out])
    weight = np.exp(lat.logp[edges])
    counter = np.array([int(p.place[step])], np.int64)
    cum = np.cumsum(weight)
    edge = int(edges[min(np.searchsorted(cum, float(uniform(seed, counter * 2 + (s + 1 << 40) + (1 << 61))[0]) * cum[-1], side="right"), len(edges) - 1)])
    out.append(edge)
    left = weight.sum() - np.exp(lat.logp[edge]) if len(edges) > 1 else 0.0
    with np.errstate(divide="ignore"):
        loc = np.array([p.logp[:step].sum() + np.log(max(left, 0.0))])
    sets[parent][step] = float(truncated(loc, top, uniform(seed, counter * 2 + 1 + (s + 1 << 40) + (1 << 61)))[0]) if len(edges) > 1 else -np.inf
    return i, parent, step, edge, top


def ids_of(lat: Lattice, piece: np.ndarray, pieces: Pieces) -> np.ndarray:
    n = len(pieces.scores)
    odd = piece >= n
    if not odd.any():
        return piece.astype(np.uint32)
    parts, at = [], 0
    for j in np.flatnonzero(odd).tolist():
        parts += [piece[at:j].astype(np.uint32), lat.chars[int(piece[j]) - n]]
        at = j + 1
    return np.concatenate([*parts, piece[at:].astype(np.uint32)])


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SAMPLES, theta: float = THETA, seed: int = SEED, model: str | None = None) -> DataFrame:
    """Up to k rows for each row of docs, best first: key, sample (from 0), ids (little-endian unsigned 32-bit), log_prob, perturbed, inclusion, exact.

    exact: whether decoding the ids gives the text again; false only for texts that hold U+2581, which decodes to a space.
    Null and empty texts have one segmentation, without ids; texts with fewer than k segmentations give those they have. Rows
    that repeat a key have the same random numbers, so equal rows equal samples; a null key is the key ''. An empty table gives
    no rows. Other columns are ignored.
    """
    model = model or model_path()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for b in slices(batches, "t", TEXT_BYTES):
            texts = b.column("t").to_pylist()
            rows = sampled(texts, b.column("s").to_pylist(), pieces, k, theta, seed)
            own = [i for i, x in enumerate(rows) for _ in x]
            flat = [x for r in rows for x in r]
            exact = [pieces.decode(x[0]) == texts[i].encode() for i, x in zip(own, flat)]
            yield pa.RecordBatch.from_arrays(
                [b.column("k").take(pa.array(own, pa.int64())), pa.array([j for r in rows for j in range(len(r))], pa.int32()), pa.array([x[0].astype("<u4").tobytes() for x in flat], pa.binary()), *(pa.array([x[c] for x in flat], pa.float64()) for c in (1, 2, 3)), pa.array(exact, pa.bool_())],
                ["k", "sample", "ids", "log_prob", "perturbed", "inclusion", "exact"],
            )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("s"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(task, f"k {kind}, sample int, ids binary, log_prob double, perturbed double, inclusion double, exact boolean").withColumnRenamed("k", key)
