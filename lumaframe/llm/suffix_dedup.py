"""Removal of byte strings that an earlier document holds, by hash-compared suffix sorting.

Equal strings of LENGTH bytes have the same smallest-hashed SEED-byte substring at the
same place, their anchor. Consecutive windows of a text with one anchor form a context of
at most 2 * LENGTH - SEED bytes, so strings that may be equal meet wherever contexts are
shuffled by anchor. Documents are dealt to buckets by key, anchors to shards by hash:

1. A bucket sends 32 bits of each distinct anchor to its shard, which answers with two
   bits: whether another bucket has it too, and whether it has very many contexts in all.
2. A bucket collapses equal contexts and sends the distinct ones whose anchor is shared.
   The shard collapses equal contexts of different buckets and sorts the windows that are
   left (suffixes cut at LENGTH) by a mergesort whose comparisons find the common
   extension by binary search over prefix polynomial hashes. Neighbours that agree over
   LENGTH bytes are compared byte by byte, so a hash collision can't remove anything. What
   a document with a smaller key holds goes back as one bit for each window.
3. A bucket reads its bits and cuts the covered bytes.

Texts move once, and of most of a text no more than a few bits of its anchors after that;
each of the three steps finds the contexts anew, which is cheaper than moving them.
Buckets and shards have a size of their own: their number grows with the input. A text of
any length is one document of its bucket and is worked on in pieces. A passage that many
documents share costs each bucket one context inside the passage, and each document one
at its two edges.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_bytes
from .shingles import mix

LENGTH, SEED = 50, 24
#: Text bytes of a bucket, and text bytes whose contexts (about 3.7 times as much) meet in a shard.
BUCKET_BYTES, SHARD_TEXT = 4_000_000, 2_000_000
#: Contexts of an anchor above which its windows are dealt out by their own bytes.
HOT_CONTEXTS = 1000
#: Windows that a shard sorts at once.
WINDOWS = 1_000_000
_PIECE = 1 << 20
#: Spans that are expanded to bytes at once.
_SPANS = 1 << 14
_BASE = 0x9E3779B97F4A7C15 | 1
#: Spreads seed hashes before their high bits are compared.
_ORDER = np.uint64(0xD1342543DE82EF95)
NO_KEY = -(2**63)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2**64, and of its inverse."""
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_UP, _DOWN = _powers(_PIECE + 1)
_STEPS = np.arange(2 * LENGTH, dtype=np.uint8)


@dataclass
class Contexts:
    """Where contexts stand in the bytes of a bucket; names are hashes of their whole text."""

    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray  # offset of the anchor in the context
    seed: np.ndarray  # hash of the anchor
    name: np.ndarray


def contexts_of(data: np.ndarray, bounds: np.ndarray) -> Contexts:
    """All contexts of documents that lie in data between consecutive bounds."""
    parts = []
    n_docs, i = len(bounds) - 1, 0
    while i < n_docs:
        a = int(bounds[i])
        j = int(np.searchsorted(bounds, a + _PIECE, side="right")) - 1
        if j > i:
            parts.append(_piece(data, a, int(bounds[j]), bounds[i : j + 1]))
            i = j
        else:  # a long document, in pieces that share LENGTH - 1 bytes
            end = int(bounds[i + 1])
            while end - a >= LENGTH:
                b = min(end, a + _PIECE)
                parts.append(_piece(data, a, b, np.array([a, b])))
                a = b - LENGTH + 1
            i += 1
    parts = [p for p in parts if p is not None]
    if not parts:
        return Contexts(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)))
    return Contexts(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _piece(data: np.ndarray, a: int, b: int, bounds: np.ndarray):
    own = data[a:b].astype(np.uint64)
    n = len(own)
    if n < LENGTH:
        return None
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((own + np.uint64(1)) * _UP[:n], out=sums[1:])
    seeds = (sums[SEED:] - sums[:-SEED]) * _DOWN[: n - SEED + 1]
    low = (seeds * _ORDER & ~np.uint64(_PIECE - 1)) | np.arange(len(seeds), dtype=np.uint64)  # ties: leftmost
    span, width = 1, LENGTH - SEED + 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    owner = (low & np.uint64(_PIECE - 1)).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)  # windows that begin in a document and end in it
    starts, ends = bounds[:-1] - a, bounds[1:] - a
    long = ends - starts >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1])[: len(owner)])
    if not len(at):
        return None
    owned = owner[at]
    fresh = np.flatnonzero(np.concatenate([[True], (owned[1:] != owned[:-1]) | (at[1:] != at[:-1] + 1)]))
    start = at[fresh]
    windows = np.diff(np.append(fresh, len(at)))
    anchor = owned[fresh] - start
    stop = start + windows + LENGTH - 1
    name = mix((sums[stop] - sums[start]) * _DOWN[start] + windows.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return start + a, windows, anchor, mix(seeds[owned[fresh]]), name


def _within(size: np.ndarray) -> np.ndarray:
    """0, 1, .. of each of several spans, one after another."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of several spans, one after another."""
    first = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for i in range(0, len(start), _SPANS):
        s = slice(i, i + _SPANS)
        a, b = int(first[i]), int(first[s][-1] + size[s][-1])
        out[a:b] = data[np.repeat(start[s] - first[s], size[s]) + np.arange(a, b)]
    return out


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether spans at a and b agree byte by byte."""
    out = np.zeros(len(a), bool)
    for i in range(0, len(a), _SPANS):
        s = slice(i, i + _SPANS)
        differs = _gather(data, a[s], size[s]) != _gather(data, b[s], size[s])
        if len(a[s]):
            out[s] = ~np.logical_or.reduceat(differs, np.cumsum(size[s]) - size[s])
    return out


def _classes(data: np.ndarray, start: np.ndarray, size: np.ndarray, name: np.ndarray) -> np.ndarray:
    """For each span the index of the first equal one; equal names are verified."""
    order = np.argsort(name, kind="stable")
    head = np.concatenate([[True], name[order][1:] != name[order][:-1]]) if len(order) else np.zeros(0, bool)
    first = np.empty(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    twin = np.flatnonzero(first != np.arange(len(first)))
    equal = size[twin] == size[first[twin]]
    equal[equal] = _same(data, start[twin[equal]], start[first[twin[equal]]], size[twin[equal]])
    first[twin[~equal]] = twin[~equal]  # a collision: stands for itself
    return first


class Bucket:
    """The documents of a bucket in a fixed order, and their contexts."""

    def __init__(self, keys: list[int], texts: list[str], shards: int):
        self.shards = shards
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.order = sorted(range(len(raw)), key=lambda i: (keys[i], raw[i]))
        self.data = np.frombuffer(b"".join(raw[i] for i in self.order), np.uint8)
        self.bounds = np.concatenate([[0], np.cumsum([len(raw[i]) for i in self.order])]).astype(np.int64)
        self.keys = np.array([keys[i] for i in self.order], np.int64)
        self.found = c = contexts_of(self.data, self.bounds)
        name = (mix(c.seed) % np.uint64(shards)) << np.uint64(32) | c.seed >> np.uint64(32)
        self.anchors, self.of_anchor, self.often = np.unique(name, return_inverse=True, return_counts=True)
        self.anchor_shard = (self.anchors >> np.uint64(32)).astype(np.int64)

    def anchor_rows(self):
        """(shard, its anchors, 32 bits each in rising order, with their numbers of different contexts) of each shard."""
        kinds = np.ones(len(self.anchors), np.int64)
        again = np.flatnonzero(self.often[self.of_anchor] > 1)
        pairs = np.unique(np.stack([self.of_anchor[again].astype(np.uint64), self.found.name[again]]), axis=1)
        which, count = np.unique(pairs[0], return_counts=True)
        kinds[which.astype(np.int64)] = count
        kinds = np.minimum(kinds, 0xFFFF).astype("<u2")
        for a, b in _runs(self.anchor_shard):
            yield int(self.anchor_shard[a]), _pack_rising((self.anchors[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32), kinds[a:b])

    def choose(self, replies: list[tuple[int, bytes]]) -> None:
        """Contexts whose anchor occurs more than once, the distinct ones of them, and which of those go to shards."""
        shared, hot = np.zeros(len(self.anchors), bool), np.zeros(len(self.anchors), bool)
        begin = {int(self.anchor_shard[a]): (a, b) for a, b in _runs(self.anchor_shard)}
        for shard, body in replies:
            a, b = begin[shard]
            flags = np.unpackbits(np.frombuffer(body, np.uint8).reshape(2, -1), axis=1, count=b - a).astype(bool)
            shared[a:b], hot[a:b] = flags
        at = np.flatnonzero((shared | (self.often > 1))[self.of_anchor])
        c = self.found
        live = Contexts(c.start[at], c.windows[at], c.anchor[at], c.seed[at], c.name[at])
        of_anchor, apart = self.of_anchor[at], hot[self.of_anchor[at]]
        if apart.any():  # an anchor of very many contexts: its windows go their own ways
            live, of_anchor, apart = _windows_apart(self.data, live, of_anchor, apart)
        self.live = live
        self.owner = self.keys[np.searchsorted(self.bounds, live.start, side="right") - 1] if len(at) else np.zeros(0, np.int64)
        first = _classes(self.data, live.start, live.windows + LENGTH - 1, live.name)
        self.distinct, self.of = np.unique(first, return_inverse=True)  # the first one has the smallest key
        anchor = of_anchor[self.distinct]
        sent = np.flatnonzero(shared[anchor] | (np.bincount(anchor, minlength=len(self.anchors))[anchor] > 1))
        own = (mix(live.name[self.distinct[sent]]) % np.uint64(self.shards)).astype(np.int64)
        shard = np.where(apart[self.distinct[sent]], own, self.anchor_shard[anchor[sent]])
        order = np.argsort(shard, kind="stable")
        self.packed, self.shard = sent[order], shard[order]

    def context_rows(self):
        """(shard, packed contexts) of each shard."""
        c = self.live
        for a, b in _runs(self.shard):
            at = self.distinct[self.packed[a:b]]
            text = _gather(self.data, c.start[at], c.windows[at] + LENGTH - 1)
            keys = self.owner[at]
            body = np.int64(len(at)).tobytes() + keys.tobytes() + c.windows[at].astype(np.uint8).tobytes() + c.anchor[at].astype(np.uint8).tobytes() + text.tobytes()
            yield int(self.shard[a]), _squeezed(body)

    def cut(self, replies: list[tuple[int, bytes]]):
        """(number of the row, bytes, removed spans, kept bytes) of each document."""
        c = self.live
        mask = np.zeros(len(self.distinct), np.uint32)
        begin = {int(self.shard[a]): a for a, _ in _runs(self.shard)}
        for shard, body in replies:
            pairs = np.frombuffer(body, np.uint32).reshape(2, -1)
            mask[self.packed[begin[shard] + pairs[0].astype(np.int64)]] |= pairs[1]
        bits = mask[self.of]
        bits[self.owner > self.owner[self.distinct][self.of]] = (1 << (LENGTH - SEED + 1)) - 1
        marks = np.zeros(len(self.data) + 1, np.int32)
        at = np.flatnonzero(bits)
        for b in range(LENGTH - SEED + 1):
            hit = at[((bits[at] >> np.uint32(b)) & np.uint32(1)).astype(bool) & (c.windows[at] > b)]
            np.add.at(marks, c.start[hit] + b, 1)
            np.add.at(marks, c.start[hit] + b + LENGTH, -1)
        gone = np.cumsum(marks[:-1]) > 0
        for i, row in enumerate(self.order):
            a, b = int(self.bounds[i]), int(self.bounds[i + 1])
            own = gone[a:b]
            if own.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                yield row, b - a, edge.reshape(-1, 2), self.data[a:b][~own].tobytes()
            else:
                yield row, b - a, np.zeros((0, 2), np.int64), self.data[a:b].tobytes()


def _runs(values: np.ndarray):
    """(begin, end) of each run of equal values."""
    if not len(values):
        return []
    edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return list(zip(edge.tolist(), [*edge[1:].tolist(), len(values)], strict=True))


def _windows_apart(data: np.ndarray, c: Contexts, of_anchor: np.ndarray, apart: np.ndarray) -> tuple[Contexts, np.ndarray, np.ndarray]:
    """Contexts with those apart taken to single windows, each named by its own bytes."""
    rest, some = np.flatnonzero(~apart), np.flatnonzero(apart)
    which = np.repeat(some, c.windows[some])
    offset = _within(c.windows[some])
    start = c.start[which] + offset
    size = np.full(len(start), LENGTH)
    name = _span_hashes(data, start, size, c.seed[which])
    join = lambda x, y: np.concatenate([x[rest], y])
    made = Contexts(join(c.start, start), join(c.windows, np.ones(len(start), np.int64)), join(c.anchor, c.anchor[which] - offset), join(c.seed, c.seed[which]), join(c.name, name))
    of_anchor, apart = join(of_anchor, of_anchor[which]), join(apart, np.ones(len(start), bool))
    order = np.argsort(made.start, kind="stable")  # of equal ones the first has the smallest key
    return Contexts(*(getattr(made, f)[order] for f in ("start", "windows", "anchor", "seed", "name"))), of_anchor[order], apart[order]


def _squeezed(body: bytes) -> bytes:
    """body compressed if that makes it smaller; with very many shards a row is a few bytes that a frame would only add to."""
    packed = zstandard.ZstdCompressor(level=3).compress(body)
    return b"\1" + packed if len(packed) < len(body) else b"\0" + body


def _loosened(body: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(body[1:]) if body[0] else body[1:]


def _pack_rising(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising 32-bit values as steps, and 16-bit counts, byte by byte of their weight, compressed."""
    steps = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    planes = steps.view(np.uint8).reshape(-1, 4).T.tobytes() + counts.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
    return _squeezed(planes)


def _unpack_rising(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(_loosened(body), np.uint8).reshape(6, -1)
    values = np.cumsum(np.ascontiguousarray(planes[:4].T).view("<u4").ravel(), dtype=np.uint32)
    return values, np.ascontiguousarray(planes[4:].T).view("<u2").ravel()


def shared_anchors(rows: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each row of distinct values two flags each: another row has it too; it has more than HOT_CONTEXTS contexts in all."""
    _, of, count = np.unique(np.concatenate([v for v, _ in rows]), return_inverse=True, return_counts=True)
    total = np.bincount(of, np.concatenate([k for _, k in rows]))
    flags = np.stack([count[of] > 1, total[of] > HOT_CONTEXTS])
    return np.split(flags, np.cumsum([len(v) for v, _ in rows])[:-1], axis=1)


class Suffixes:
    """Suffixes of contexts, compared over at most LENGTH bytes by prefix polynomial hashes."""

    def __init__(self, text: np.ndarray, place: np.ndarray):
        """place: of each byte in its context."""
        self.text, self.place = text, place
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        self.words = np.ndarray((len(text),), "<u8", padded, 0, (1,))
        self.sums = np.zeros(len(text) + 1, np.uint64)
        for i in range(0, len(text), _PIECE):
            part = slice(i, i + _PIECE)
            values = (text[part].astype(np.uint64) + np.uint64(1)) * _UP[place[part]]
            np.cumsum(values, out=self.sums[i + 1 : i + 1 + len(values)])
            self.sums[i + 1 : i + 1 + len(values)] += self.sums[i]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes at a and b, LENGTH at most, by binary search."""
        base_a, base_b, down_a, down_b = self.sums[a], self.sums[b], _DOWN[self.place[a]], _DOWN[self.place[b]]
        low = np.zeros(len(a), np.int64)
        step = 32
        while step:  # lengths are tried bit by bit, longest first
            trial = low + step
            equal = (trial <= LENGTH) & ((self.sums[np.minimum(a + trial, len(self.text))] - base_a) * down_a == (self.sums[np.minimum(b + trial, len(self.text))] - base_b) * down_b)
            low = np.where(equal, trial, low)
            step //= 2
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether suffixes at a come before those at b; the first eight bytes settle most pairs."""
        first_a, first_b = self.words[a].byteswap(), self.words[b].byteswap()
        out = first_a < first_b
        tie = np.flatnonzero(first_a == first_b)
        a, b = a[tie], b[tie]
        n = self.common(a, b)
        inside = np.minimum(n, LENGTH - 1)
        out[tie] = (n < LENGTH) & (self.text[a + inside] < self.text[b + inside])
        return out

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of suffixes by group, then by their bytes: a bottom-up mergesort of all groups at once."""
        perm = np.argsort(group, kind="stable")
        g = group[perm]
        head = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
        base = np.maximum.accumulate(np.where(head, np.arange(len(g)), 0))
        size = np.diff(np.append(np.flatnonzero(head), len(g)))
        size = np.repeat(size, size)
        run = 1
        while run < size.max(initial=0):
            slot = np.flatnonzero(size > run)
            local = slot - base[slot]
            mine = local // run
            other = base[slot] + (mine ^ 1) * run
            end = np.minimum(other + run, base[slot] + size[slot])
            low, high = np.minimum(other, end), end.copy()
            own = at[perm[slot]]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                that = at[perm[middle]]
                right = (mine[open_] & 1).astype(bool)  # of equal suffixes the left run's come first
                before = np.where(right, ~self.less(own[open_], that), self.less(that, own[open_]))
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            to = base[slot] + (mine & ~1) * run + (local - mine * run) + (low - np.minimum(other, end))
            merged = perm.copy()
            merged[to] = perm[slot]
            perm = merged
            run *= 2
        return perm


def earlier(keys: np.ndarray, windows: np.ndarray, anchor: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each context a bit for each window that a context with a smaller key holds too."""
    mask = np.zeros(len(keys), np.uint32)
    size = windows + LENGTH - 1
    start = np.cumsum(size) - size
    wide = np.ndarray((max(0, len(text) - 7),), "<u8", text, 0, (1,))
    seed = np.zeros(len(keys), np.uint64)
    for k in range(0, SEED, 8):
        seed = mix(seed * np.uint64(31) + wide[start + anchor + k])
    # anchors of one context meet nothing
    _, of, count = np.unique(seed, return_inverse=True, return_counts=True)
    live = np.flatnonzero(count[of] > 1)
    if not len(live):
        return mask
    # equal contexts: the smallest key stands for all
    name = _span_hashes(text, start[live], size[live], seed[live])
    first = live[_classes(text, start[live], size[live], name)]
    heads, of_head = np.unique(first, return_inverse=True)
    least = np.full(len(heads), np.iinfo(np.int64).max)
    np.minimum.at(least, of_head, keys[live])
    whole = live[keys[live] > least[of_head]]
    mask[whole] = ((np.uint64(1) << windows[whole].astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    # windows of different contexts with one anchor
    _, of_seed, count = np.unique(seed[heads], return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(count[of_seed] > 1)
    if not len(mixed):
        return mask
    c = heads[mixed]
    body = _gather(text, start[c], size[c])
    begin = np.cumsum(size[c]) - size[c]
    place = np.concatenate([_STEPS[_within(size[c[i : i + _SPANS]])] for i in range(0, len(c), _SPANS)])
    suffixes = Suffixes(body, place)
    own, windows_c, anchor_c, group = least[mixed], windows[c], anchor[c], of_seed[mixed]
    held = np.zeros(len(c), np.uint32)
    # equal windows have their anchor at one place, so places are sorted apart; as many at once as fit in WINDOWS
    of_place = [int(((anchor_c >= k) & (anchor_c - k < windows_c)).sum()) for k in range(LENGTH - SEED + 1)]
    k = 0
    while k < len(of_place):
        end, total = k + 1, of_place[k]
        while end < len(of_place) and total + of_place[end] <= WINDOWS:
            total += of_place[end]
            end += 1
        place_of, which = np.nonzero((anchor_c >= np.arange(k, end)[:, None]) & (anchor_c - np.arange(k, end)[:, None] < windows_c))
        offset = anchor_c[which] - (place_of + k)
        if len(which) > 1:
            smaller = _smallest(suffixes, begin[which] + offset, group[which] * 32 + place_of + k, own[which]) < own[which]
            np.bitwise_or.at(held, which[smaller], np.uint32(1) << offset[smaller].astype(np.uint32))
        k = end
    # what a context's smallest key finds held, its other keys find held as well
    of_mixed = np.zeros(len(heads), np.uint32)
    of_mixed[mixed] = held
    mask[live] |= of_mixed[of_head]
    return mask


def _smallest(suffixes: Suffixes, at: np.ndarray, group: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each suffix the smallest key of the suffixes of its group that agree with it over LENGTH bytes."""
    order = suffixes.sort(at, group)
    a, b = at[order[:-1]], at[order[1:]]
    near = np.flatnonzero(group[order[:-1]] == group[order[1:]])
    near = near[suffixes.common(a[near], b[near]) == LENGTH]
    near = near[_same(suffixes.text, a[near], b[near], np.full(len(near), LENGTH))]
    joined = np.zeros(len(order), bool)
    joined[near + 1] = True
    label = np.cumsum(~joined) - 1
    least = np.full(int(label[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, label, keys[order])
    out = np.empty(len(order), np.int64)
    out[order] = least[label]
    return out


def _span_hashes(text: np.ndarray, start: np.ndarray, size: np.ndarray, salt: np.ndarray) -> np.ndarray:
    total = np.zeros(len(start), np.uint64)
    for i in range(0, len(start), _SPANS):
        s = slice(i, i + _SPANS)
        place = np.arange(int(size[s].sum())) - np.repeat(np.cumsum(size[s]) - size[s], size[s])
        values = (_gather(text, start[s], size[s]).astype(np.uint64) + np.uint64(1)) * _UP[place]
        total[s] = np.add.reduceat(values, np.cumsum(size[s]) - size[s])
    return mix(total + salt * np.uint64(3) + size.astype(np.uint64))


def _unpack(body: bytes):
    body = _loosened(body)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    at = 8 + 8 * n
    return np.frombuffer(body, np.int64, n, 8), np.frombuffer(body, np.uint8, n, at), np.frombuffer(body, np.uint8, n, at + n), np.frombuffer(body, np.uint8, -1, at + 2 * n)


def drop_repeated_bytes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, spans, kept), one row for each row of df.

    A byte goes if a string of LENGTH bytes that covers it also starts in a row with a
    smaller key; strings are judged on the input and never cross rows. spans are the
    maximal removed (start, end) runs in bytes, kept the remaining bytes joined. A null
    text is empty; texts under LENGTH bytes stay whole. A null key is the smallest; rows of
    one key don't remove each other's bytes. Other columns are dropped.
    """
    rows = df.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = text_bytes(rows)
    buckets, shards = max(1, -(-total // BUCKET_BYTES)), max(1, -(-total // SHARD_TEXT))
    rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket"), "key", "text").repartition(buckets, "bucket")

    def bucket_of(own: pa.Table) -> Bucket:
        return Bucket(own.column("key").to_pylist(), own.column("text").to_pylist(), shards)

    def told(replies: pa.Table, kind: int) -> list[tuple[int, bytes]]:
        rows = zip(*(replies.column(c).to_pylist() for c in ("kind", "shard", "body")), strict=True)
        return [(shard, body) for k, shard, body in rows if k == kind]

    def sent(bucket: int, rows: list[tuple[int, bytes]]) -> pa.Table:
        return pa.table({"shard": pa.array([s for s, _ in rows], pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "body": pa.array([b for _, b in rows], pa.binary())})

    def answer(shard: int, kind: int, rows: list[tuple[int, bytes]]) -> pa.Table:
        return pa.table(
            {
                "bucket": pa.array([b for b, _ in rows], pa.int32()),
                "shard": pa.array([shard] * len(rows), pa.int32()),
                "kind": pa.array([kind] * len(rows), pa.int32()),
                "body": pa.array([b for _, b in rows], pa.binary()),
            }
        )

    def send_anchors(own: pa.Table) -> pa.Table:
        return sent(own.column("bucket")[0].as_py(), list(bucket_of(own).anchor_rows()))

    def match_anchors(table: pa.Table) -> pa.Table:
        flags = shared_anchors([_unpack_rising(b.as_py()) for b in table.column("body")])
        rows = [(b, np.packbits(f, axis=1).tobytes()) for b, f in zip(table.column("bucket").to_pylist(), flags, strict=True) if f.any()]
        return answer(table.column("shard")[0].as_py(), 1, rows)

    def send_contexts(own: pa.Table, replies: pa.Table) -> pa.Table:
        bucket = bucket_of(own)
        bucket.choose(told(replies, 1))
        return sent(own.column("bucket")[0].as_py(), list(bucket.context_rows()))

    def match_contexts(table: pa.Table) -> pa.Table:
        parts = [_unpack(b.as_py()) for b in table.column("body")]
        keys, windows, anchor, body = (np.concatenate(x) for x in zip(*parts, strict=True))
        mask = earlier(keys, windows.astype(np.int64), anchor.astype(np.int64), body)
        rows, at = [], 0
        for bucket, part in zip(table.column("bucket").to_pylist(), parts, strict=True):
            own = mask[at : at + len(part[0])]
            at += len(part[0])
            hit = np.flatnonzero(own)
            if len(hit):
                rows.append((bucket, np.stack([hit.astype(np.uint32), own[hit]]).tobytes()))
        return answer(table.column("shard")[0].as_py(), 2, rows)

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def cut(own: pa.Table, replies: pa.Table) -> pa.Table:
        keys, bucket = own.column("key").to_pylist(), bucket_of(own)
        bucket.choose(told(replies, 1))
        got = list(bucket.cut(told(replies, 2)))
        return pa.table(
            {
                "key": pa.array([keys[i] for i, _, _, _ in got], pa.int64()),
                "n_bytes": pa.array([n for _, n, _, _ in got], pa.int64()),
                "spans": pa.array([[{"start": int(a), "end": int(b)} for a, b in s] for _, _, s, _ in got], pa.list_(span)),
                "kept": pa.array([k for _, _, _, k in got], pa.binary()),
            }
        )

    to_shard, to_bucket = "shard int, bucket int, body binary", "bucket int, shard int, kind int, body binary"
    own = rows.groupBy("bucket")
    shared = own.applyInArrow(send_anchors, to_shard).groupBy("shard").applyInArrow(match_anchors, to_bucket)
    contexts = own.cogroup(shared.groupBy("bucket")).applyInArrow(send_contexts, to_shard)
    held = contexts.groupBy("shard").applyInArrow(match_contexts, to_bucket)
    replies = shared.unionByName(held).groupBy("bucket")
    done = own.cogroup(replies).applyInArrow(cut, "key bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")
    return done.select(F.when(F.col("key") != NO_KEY, F.col("key")).cast(df.schema[key].dataType).alias(key), "n_bytes", "spans", "kept")
