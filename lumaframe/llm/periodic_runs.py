"""Runs: stretches of words that repeat with a period, found over a suffix tree of each document.

A tandem repeat is a string that follows itself. Its two halves are leaves i and i + q below
the tree's node of depth q; it is branching if the words after the halves differ, and then
they are in different children of a node. So it is enough to look, for each node, from the
leaves of all children but the largest (the smaller-half trick of Stoye and Gusfield, n log n
leaves in all) q words ahead and q words back. Every run has one branching repeat for its
period and some for multiples of it: rotated to the left as far as words agree and merged by
their ends, they are the runs, and the smallest period of a merged group is the run's.

The tree is the one that intervals of a suffix array with common prefixes make. Ranks by
prefixes of 1, 2, 4, ... words give the array, and the ranks of all levels are kept: they
tell how far two places agree, to the right for the tree, to the left for rotations. Nothing
is hashed there, so nothing needs to be verified.

Only words that a run may contain enter the tree. In a run of at least `least` words every
word is in a stretch of least/2 words that the run has twice; stretches of words
not covered so are left out, and each of the rest is a string of its own. Documents are
independent rows: no shuffle, and a batch of them goes through the tree at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

SPACES = r"[\x20\x09-\x0D]+"
LEAST = 12
#: Words that go through the tree together; a longer document goes alone.
BATCH_WORDS = 400_000
#: Leaves looked from at once.
LEAVES = 1 << 20
#: Rounds of leaving out words; more leave out little.
ROUNDS = 4


def _ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of all places by their next 1, 2, 4, ... symbols, until all differ; what is beyond the end is smallest."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    fresh = np.empty(n, bool)
    fresh[0] = True
    fresh[1:] = symbols[order[1:]] != symbols[order[:-1]]
    rank = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # a group's rank is its first place in the order
    levels, width = [rank], 1
    open_ = order[~(fresh & np.append(fresh[1:], True))]  # places whose rank others share
    while len(open_):
        ahead = open_ + width
        nextrank = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        own = rank[open_]
        by = np.lexsort((nextrank, own))
        open_, own, nextrank = open_[by], own[by], nextrank[by]
        group = np.append(True, own[1:] != own[:-1])
        fresh = group | np.append(True, nextrank[1:] != nextrank[:-1])
        at = np.arange(len(open_))
        first = np.maximum.accumulate(np.where(group, at, 0))
        rank = rank.copy()
        rank[open_] = own + np.maximum.accumulate(np.where(fresh, at, 0)) - first
        levels.append(rank)
        width *= 2
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
    return levels


def _agree(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, left: bool = False) -> np.ndarray:
    """How many symbols agree from places a and b on (a < b or a > b), or before them."""
    n, done = len(levels[0]), np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        if left:
            x, y = a - done - step, b - done - step
            inside = (x >= 0) & (y >= 0)
        else:
            x, y = a + done, b + done
            inside = (x < n) & (y < n)
        rank = levels[k]
        same = np.zeros(len(a), bool)
        same[inside] = rank[x[inside]] == rank[y[inside]]
        done += np.where(same, step, 0)
    return done


def _nodes(common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inner nodes but the root: depth, first and last leaf, first and last leaf of the largest child.

    common[x] is the common prefix of the leaves x - 1 and x; common[0] is 0.
    """
    depths, firsts, lasts, bigs, bigends = [], [], [], [], []
    stack: list[list[int]] = []  # depth, first leaf, largest child's first leaf and size
    inner = np.flatnonzero(common)
    ends = np.append(inner[:-1] + 1 != inner[1:], True) if len(inner) else inner  # where common falls to 0 afterwards
    for x, depth, final in zip(inner.tolist(), common[inner].tolist(), ends.tolist(), strict=True):
        child = (x - 1, 1)  # the leaf before, or the node that ends there
        while True:
            while stack and stack[-1][0] > depth:
                d, first, big, size = stack.pop()
                depths.append(d)
                firsts.append(first)
                lasts.append(x - 1)
                bigs.append(big)
                bigends.append(big + size - 1)
                child = (first, x - first)
                if stack and stack[-1][0] >= depth and child[1] > stack[-1][3]:
                    stack[-1][2:] = child
            if depth and (not stack or stack[-1][0] < depth):
                stack.append([depth, child[0], *child])
            if not final or not depth:
                break
            x, depth, child = x + 1, 0, (x, 1)  # the string's leaves end: close all its nodes
    return tuple(np.array(v, np.int64) for v in (depths, firsts, lasts, bigs, bigends))


def _branching(symbols: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all branching tandem repeats of symbols, each once."""
    n, rank = len(symbols), levels[-1]
    leaves = np.empty(n, np.int64)
    leaves[rank] = np.arange(n)
    common = np.zeros(n, np.int64)
    common[1:] = _agree(levels, leaves[:-1], leaves[1:])
    depth, first, last, big, bigend = _nodes(common)
    sizes = (big - first) + (last - bigend)  # leaves of all children but the largest
    before, total = np.cumsum(sizes) - sizes, int(sizes.sum())
    found = []
    for low in range(0, total, LEAVES):
        place = np.arange(low, min(total, low + LEAVES))
        node = np.searchsorted(before, place, side="right") - 1
        x = first[node] + place - before[node]
        x = np.where(x >= big[node], x + bigend[node] - big[node] + 1, x)
        i, q, lo, hi = leaves[x], depth[node], first[node], last[node]
        for start, other in ((i, i + q), (i - q, i - q)):
            ok = (other >= 0) & (other < n) & (start >= 0)
            ok &= (start + 2 * q) < n
            ok[ok] = (rank[other[ok]] >= lo[ok]) & (rank[other[ok]] <= hi[ok])
            ok[ok] = symbols[start[ok] + q[ok]] != symbols[start[ok] + 2 * q[ok]]
            found.append(start[ok] * n + q[ok])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs // n, pairs % n


def tree_runs(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and smallest periods of the runs of at least `least` symbols, by start and period.

    symbols is one string, or several that share no symbol, each followed by a symbol that occurs nowhere else.
    """
    none = np.zeros(0, np.int64)
    if len(symbols) < least:
        return none, none, none
    levels = _ranks(symbols)
    start, period = _branching(symbols, levels)
    back = _agree(levels, start, start + period, left=True)
    begin, end = start - back, start + 2 * period
    long = end - begin >= least
    begin, end, period = begin[long], end[long], period[long]
    order = np.lexsort((period, end, begin))
    begin, end, period = begin[order], end[order], period[order]
    fresh = np.append(True, (begin[1:] != begin[:-1]) | (end[1:] != end[:-1]))[: len(begin)]
    begin, end, period = begin[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, begin))
    return begin[order], (end - begin)[order], period[order]


def _repeated(words: np.ndarray, string: np.ndarray, width: int) -> np.ndarray:
    """Which words stand in a stretch of width words that its string has again; a few others may be marked too."""
    n = len(words)
    covered = np.zeros(n + 1, np.int64)
    if n < width:
        return covered[:n] > 0
    factor, mark = np.uint64(0x9E3779B97F4A7C15), np.zeros(n - width + 1, np.uint64)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * factor
    mixed ^= mixed >> np.uint64(29)
    for k in range(width):
        mark = mark * np.uint64(0xD6E8FEB86659FD93) + mixed[k : n - width + 1 + k]
    whole = np.flatnonzero(string[: n - width + 1] == string[width - 1 :])
    mark = (mark[whole] + string[whole].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) * factor
    mark ^= mark >> np.uint64(32)
    order = np.argsort(mark)
    same = mark[order[1:]] == mark[order[:-1]]
    hit = whole[np.unique(np.concatenate((order[1:][same], order[:-1][same])))]
    covered[hit] += 1
    covered[hit + width] -= 1
    return np.cumsum(covered)[:n] > 0


def word_runs(words: np.ndarray, document: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, lengths and periods of the runs in words (numbers) of documents (numbers that don't fall)."""
    place, string = np.arange(len(words)), document
    for _ in range(ROUNDS):
        kept = _repeated(words[place], string, (least + 1) // 2)
        done = kept.all()
        string, place = string[kept], place[kept]
        if len(place):
            parted = np.append(True, (place[1:] != place[:-1] + 1) | (string[1:] != string[:-1]))
            string = np.cumsum(parted)
            long = np.bincount(string)[string] >= least
            done &= long.all()
            string, place = string[long], place[long]
        if done or not len(place):
            break
    if not len(place):
        none = np.zeros(0, np.int64)
        return none, none, none
    last = np.append(string[1:] != string[:-1], True)
    spread = np.arange(len(place)) + np.cumsum(last) - last  # one more place after each string
    own = words[place] + 1
    own = own + string * (int(own.max()) + 1)  # strings share no symbol
    symbols = np.empty(len(place) + int(last.sum()), np.int64)
    symbols[spread] = own
    symbols[spread[last] + 1] = -np.arange(1, int(last.sum()) + 1)
    begin, length, period = tree_runs(symbols, least)
    origin = np.zeros(len(symbols), np.int64)
    origin[spread] = place
    return origin[begin], length, period


def _batch(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Number of words, runs and collapsed text of each text."""
    split = [t.split() for t in texts]  # white space of bytes is 20, 09 to 0D
    sizes = np.array([len(x) for x in split], np.int64)
    starts = np.cumsum(sizes) - sizes
    every = list(chain.from_iterable(split))
    numbers = dict(zip(dict.fromkeys(every), count(), strict=False))
    words = np.fromiter(map(numbers.__getitem__, every), np.int64, len(every))
    begin, length, period = word_runs(words, np.repeat(np.arange(len(texts)), sizes), least)
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, begin + period, 1)
    np.subtract.at(gone, begin + length, 1)
    gone = np.cumsum(gone)[:-1] > 0
    owner = np.searchsorted(starts, begin, side="right") - 1  # of texts without words the last one, never hit
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for k, b, n, q in zip(owner.tolist(), (begin - starts[owner]).tolist(), length.tolist(), period.tolist(), strict=True):
        runs.setdefault(k, []).append((b, n, q))
    done = []
    for k, (x, s) in enumerate(zip(split, starts.tolist(), strict=True)):
        if k in runs:
            x = [w for w, cut in zip(x, gone[s : s + len(x)].tolist(), strict=True) if not cut]
        done.append((int(sizes[k]), runs.get(k, []), b" ".join(x)))
    return done


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapse(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, n_words, runs, collapsed), one row for each row of df.

    Words are stretches of anything but the code points 20 and 09 to 0D. runs holds (start,
    length, period) of every run by start, then period: consecutive words with smallest period
    q, at least max(least, 2 q) of them, that no neighbouring word extends. collapsed is the
    words, joined by single spaces, without those that any run contains after its first q.
    A null or empty text has no words, no runs and an empty collapsed text. Repeated rows
    and null keys are rows like others; other columns are dropped.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)) // (4 * BATCH_WORDS)  # words have a few bytes
            for part in np.unique(sizes):
                low, high = np.searchsorted(sizes, [part, part + 1])
                some = batch.slice(low, high - low)
                n, runs, texts = zip(*_batch([t.as_buffer().to_pybytes() for t in some.column(1)], least), strict=True)
                found = [[{"start": b, "length": m, "period": q} for b, m, q in x] for x in runs]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(found, RUNS), pa.array(texts, pa.binary()).cast(pa.string())], ["key", "n_words", "runs", "collapsed"])

    out = rows.mapInArrow(run, f"key {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.select(F.col("key").alias(key), "n_words", "runs", "collapsed")
