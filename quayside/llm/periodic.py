"""Periodic runs of words: squares from the segments that a suffix automaton's link tree shows when a word is appended.

A stretch of words is appended word by word to a suffix automaton. The suffixes that end at a word are the path from its state up
the suffix links, and the path falls into segments by where each suffix ended last before. A link-cut tree holds the segments:
each is a splay tree with one last end, access() recolours the path to the new end and meets each old segment once. A segment
whose longest suffix has m words and ended d words ago shows, for d <= m, two neighbouring copies of d words: m + d words of
smallest period d end here, and reach as far to the left as they can. The same start and period at the next word is the same
run, so the last end at which it is met ends the run. Appending costs logarithmic amortised time, whatever the text.

Only stretches where a run can lie are appended. In a run of at least 2 * GRAM words each word lies in a window of GRAM words that
comes again in it, so what such windows don't cover (found by hashes, wrongly equal ones only cost time) is passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import slices, text_or_empty

#: Words of the shortest run, and of the windows that come again in it.
LEAST, GRAM = 12, 6
#: Times that a stretch is cut down to its repeated windows; more times find no more runs and no fewer.
PASSES = 4


def appended(words: list, least: int = LEAST) -> list[tuple[int, int, int]]:
    """start, length, period of all runs of a list of hashable words: length at least `least` and twice the smallest period."""
    length, link, nxt = [0], [-1], [{}]
    above, below, parent, last_end = [-1], [-1], [-1], [-1 - len(words)]  # of the splay trees; a tree's root has its last end

    def splay(x: int) -> None:
        while True:
            p = parent[x]
            if p < 0:
                return
            if above[p] == x:
                upper = True
            elif below[p] == x:
                upper = False
            else:
                return
            g = parent[p]
            if g >= 0 and (above[g] == p if upper else below[g] == p):  # both on one side: the parent goes first
                a = parent[g]
                if upper:
                    b = below[p]
                    above[g] = b
                    below[p] = g
                else:
                    b = above[p]
                    below[g] = b
                    above[p] = g
                if b >= 0:
                    parent[b] = g
                parent[g] = p
                parent[p] = a
                if a >= 0:
                    if above[a] == g:
                        above[a] = p
                    elif below[a] == g:
                        below[a] = p
                last_end[p] = last_end[g]
                g = a
            if upper:
                b = below[x]
                above[p] = b
                below[x] = p
            else:
                b = above[x]
                below[p] = b
                above[x] = p
            if b >= 0:
                parent[b] = p
            parent[p] = x
            parent[x] = g
            if g >= 0:
                if above[g] == p:
                    above[g] = x
                elif below[g] == p:
                    below[g] = x
            last_end[x] = last_end[p]

    found: dict[tuple[int, int], int] = {}
    state = 0
    for i, w in enumerate(words):
        new, p = len(length), state
        length.append(i + 1)
        nxt.append({})
        above.append(-1)
        below.append(-1)
        last_end.append(i)
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p < 0:
            up = 0
        else:
            up = q = nxt[p][w]
            if length[p] + 1 != length[q]:
                up = new + 1  # q's shorter suffixes get a state of their own, on the path above q
        link.append(up)
        parent.append(up)
        if up == new + 1:
            length.append(length[p] + 1)
            nxt.append(nxt[q].copy())
            link.append(link[q])
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = up
                p = link[p]
            link[q] = up
            splay(q)
            b = above[q]
            above.append(b)
            below.append(-1)
            parent.append(q)
            last_end.append(last_end[q])
            if b >= 0:
                parent[b] = up
            above[q] = up
        state = lower = new
        x = up
        while x >= 0:  # access: the path to the new state gets one colour
            splay(x)
            m, e = length[x], last_end[x]
            if i - e <= m:
                found[e - m + 1, i - e] = i
            if (b := below[x]) >= 0:
                last_end[b] = e
            below[x] = lower
            lower = x
            x = parent[x]
        last_end[lower] = i
    return sorted((s, e + 1 - s, d) for (s, d), e in found.items() if e + 1 - s >= least)


def stretches(hashes: np.ndarray, gram: int = GRAM) -> list[tuple[int, int]]:
    """The parts outside which no run of at least 2 * gram words lies: each of their words is in a window that comes again in the part."""
    out, todo = [], [(0, len(hashes), 0)]
    while todo:
        a, b, depth = todo.pop()
        n = b - a - gram + 1
        if n <= gram:
            continue
        if depth == PASSES:
            out.append((a, b))
            continue
        h = hashes[a : a + n].copy()
        for k in range(1, gram):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            h += hashes[a + k : a + k + n]
        order = np.argsort(h)
        same = np.diff(h[order]) == 0
        if not same.any():
            continue
        again = np.zeros(n, bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        edge = np.zeros(b - a + 1, np.int32)
        edge[:n] += again
        edge[gram:] -= again
        covered = np.cumsum(edge[:-1]) > 0
        if covered.all():
            out.append((a, b))
            continue
        turns = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
        todo += [(a + int(s), a + int(e), depth + 1) for s, e in zip(turns[::2], turns[1::2])]
    return sorted(out)


def word_runs(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """start, length, period of all runs of a text's words, by start, then period."""
    gram = max(1, least // 2)
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    return [(a + s, n, d) for a, b in stretches(hashes, gram) for s, n, d in appended(words[a:b], least)]


def kept_words(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, d in found:
        edge[s + d] += 1
        edge[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, prepare: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """A row for each row of docs: key, n_words, runs (start, length, period, by start, then period), collapsed (the text without
    what its runs repeat, one space between words).

    Words are what ASCII white space separates. A run is a longest stretch of at least `least` words and twice its smallest period.
    prepare changes a row's words before (key, words); it must give as many for equal rows. A null or empty text has no words,
    no runs and collapses to an empty text. Rows with equal texts or keys are judged each for itself; null keys stay null; an
    empty table gives no rows; other columns are ignored, whatever their names. A text's memory grows with its longest stretch
    of repeats (some 700 bytes a word), not with other texts.
    """
    kind = docs.schema[key].dataType
    shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            n, found, collapsed = [], [], []
            for k, t in zip(b.column("k").to_pylist(), b.column("t").cast(pa.binary()).to_pylist()):
                words = t.split()
                if prepare:
                    words = prepare(k, words)
                own = word_runs(words, least)
                n.append(len(words))
                found.append([{"start": s, "length": m, "period": d} for s, m, d in own])
                collapsed.append(b" ".join(kept_words(words, own)))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(n, pa.int64()), pa.array(found, shape), pa.array(collapsed, pa.binary()).cast(pa.string())], ["k", "n_words", "runs", "collapsed"])

    found = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("t")).mapInArrow(task, f"k {kind.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return found.withColumnRenamed("k", key)
