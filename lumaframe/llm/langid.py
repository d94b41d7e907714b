"""Language identification with a linear-chain conditional random field over words.

Every word of a text gets a language label: byte n-grams of the word between its
boundaries, its affixes and the word itself if a learned lexicon holds it score the
labels, and a learned transition matrix ties neighbours together, so code-switched
texts fall into runs. Forward-backward gives each word's marginals; a document takes the
label with the largest mean marginal, and that mean is its score.

Training collects a bounded sample (TRAIN_DOCS documents of at most TRAIN_BYTES for each of
the TRAIN_LABELS most frequent languages, SAMPLE_BYTES in all, whole texts) to the driver and fits weights and transitions by the gradient of the
conditional likelihood. Prediction is row-local, over whole texts, and vectorised:
chunks of CHUNK words are multiplied out to small transfer matrices, messages pass from
chunk to chunk of a document, and each chunk is then run forward and backward.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches

#: Bounds of the training sample and of the model; parameters of train(): documents of a
#: label, bytes of a document, and labels.
TRAIN_DOCS, TRAIN_BYTES, TRAIN_LABELS, LEXICON_WORDS, ROUNDS = 150, 200_000, 100, 2000, 6
#: Bytes of the whole sample, whatever the number of labels.
SAMPLE_BYTES = 32 << 20
#: Words of a chunk; bytes of text that a worker scores at once.
CHUNK, BLOCK_BYTES = 32, 1_500_000
GRAMS, AFFIXES = 1 << 16, 1 << 14

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(11).integers(0, 2**63, (64, 256)).astype(np.uint64).ravel()


@dataclass
class Words:
    """Words of some texts: feature ids, and where each text's words begin."""

    grams: np.ndarray  # one id for each byte of a word
    first: np.ndarray  # where each word's bytes begin in grams
    affixes: np.ndarray  # (words, 4) ids
    hashes: np.ndarray  # of whole words
    counts: np.ndarray  # words of each text


def words_of(texts: list[str]) -> Words:
    """The words (runs of letters, case folded over Latin-1) of whole texts."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"  " + b" ".join(raw) + b"    ", np.uint8)
    lengths = np.array([len(r) for r in raw], np.int64)
    begins = 2 + np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(raw) else np.zeros(0, np.int64)
    letter = _LETTER[data]
    low = np.where(letter, _LOWER[data], 32).astype(np.uint8)
    accented = np.flatnonzero((low[:-1] == 0xC3) & (low[1:] >= 0x80) & (low[1:] <= 0x9E) & (low[1:] != 0x97)) + 1
    low[accented] += 32
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    at = np.flatnonzero(letter)
    first = np.zeros(len(starts), np.int64)
    np.cumsum((ends - starts)[:-1], out=first[1:])
    wide = low.astype(np.uint32)
    grams = _hash(wide[at - 1] << 16 | wide[at] << 8 | wide[at + 1], GRAMS)
    place = at - np.repeat(starts, ends - starts)
    hashes = np.add.reduceat(_TABLE[np.minimum(place, 63) * 256 + low[at]], first) if len(first) else np.zeros(0, np.uint64)
    head = wide[starts] | wide[starts + 1] << 8
    tail = wide[ends - 1] | wide[ends - 2] << 8
    affixes = np.stack([_hash(head, AFFIXES), _hash(head | wide[starts + 2] << 16, AFFIXES), _hash(tail, AFFIXES), _hash(tail | wide[ends - 3] << 16, AFFIXES)], 1)
    counts = np.searchsorted(starts, begins + lengths) - np.searchsorted(starts, begins)
    return Words(grams, first, affixes, hashes, counts)


def _hash(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(size)


class Field:
    """Labels and weights; all arrays have one column for each label."""

    def __init__(self, labels: list[str], lexicon: np.ndarray):
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weights = [np.zeros((GRAMS, n), np.float32), *(np.zeros((AFFIXES, n), np.float32) for _ in range(4)), np.zeros((len(lexicon) + 1, n), np.float32)]
        self.links = np.eye(n) * 4.0

    def lexical(self, w: Words) -> np.ndarray:
        if not len(self.lexicon):
            return np.zeros(len(w.hashes), np.int64)
        at = np.minimum(np.searchsorted(self.lexicon, w.hashes), len(self.lexicon) - 1)
        return np.where(self.lexicon[at] == w.hashes, at, len(self.lexicon))

    def scores(self, w: Words) -> np.ndarray:
        if not len(w.first):
            return np.zeros((0, len(self.labels)))
        total = np.add.reduceat(self.weights[0][w.grams], w.first, axis=0)
        for k in range(4):
            total += self.weights[1 + k][w.affixes[:, k]]
        total += self.weights[5][self.lexical(w)]
        return total.astype(np.float64)

    def marginals(self, scores: np.ndarray, counts: np.ndarray, pairs: bool = False):
        """Each word's label probabilities, and if asked the expected counts of neighbouring labels."""
        n, size = scores.shape
        counts = counts[counts > 0]
        step = np.exp(self.links - self.links.max())
        local = np.exp(scores - scores.max(1, keepdims=True)) + 1e-30
        chunks = -(-counts // CHUNK)
        total = int(chunks.sum())
        text = np.repeat(np.arange(len(counts)), counts)
        start = np.concatenate([[0], np.cumsum(counts)[:-1]])
        place = np.arange(n) - start[text]
        head = np.concatenate([[0], np.cumsum(chunks)[:-1]])
        row, col = head[text] + place // CHUNK, place % CHUNK
        cells = np.ones((CHUNK, total, size))
        live = np.zeros((CHUNK, total), bool)
        cells[col, row], live[col, row] = local, True
        # transfer matrix of each chunk
        moves = np.broadcast_to(np.eye(size), (total, size, size)).copy()
        for t in range(CHUNK):
            on = live[t]
            new = (moves[on].reshape(-1, size) @ step).reshape(-1, size, size) * cells[t, on][:, None, :]
            moves[on] = new / new.sum((1, 2), keepdims=True)
        # messages between the chunks of a text
        enter, leave = np.full((total, size), 1.0 / size), np.ones((total, size))
        longest = int(chunks.max(initial=0))
        by_length = np.argsort(-chunks, kind="stable")
        falling = -chunks[by_length]
        for k in range(1, longest):
            c = head[by_length[: np.searchsorted(falling, -k)]] + k
            out = np.einsum("ci,cij->cj", enter[c - 1], moves[c - 1])
            enter[c] = out / out.sum(1, keepdims=True)
        for k in range(longest - 1, 0, -1):
            c = head[by_length[: np.searchsorted(falling, -k)]] + k
            out = np.einsum("cij,cj->ci", moves[c], leave[c])
            leave[c - 1] = out / out.sum(1, keepdims=True)
        # forward and backward inside the chunks
        ahead, now = np.empty_like(cells), enter
        for t in range(CHUNK):
            new = (now @ step) * cells[t]
            new /= new.sum(1, keepdims=True)
            now = np.where(live[t][:, None], new, now)
            ahead[t] = now
        back, now = np.empty_like(cells), leave
        for t in range(CHUNK - 1, -1, -1):
            back[t] = now
            new = (cells[t] * now) @ step.T
            new /= new.sum(1, keepdims=True)
            now = np.where(live[t][:, None], new, now)
        found = ahead[col, row] * back[col, row]
        found /= found.sum(1, keepdims=True)
        if not pairs:
            return found
        later = np.flatnonzero(place > 0)
        left = ahead[col[later - 1], row[later - 1]]
        right = local[later] * back[col[later], row[later]]
        norm = np.einsum("ni,ij,nj->n", left, step, right)
        return found, np.einsum("ni,nj->ij", left / norm[:, None], right) * step

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Label and mean marginal of each text; -1 and 0 without words."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        w = words_of(texts)
        has = np.flatnonzero(w.counts)
        if len(has):
            found = self.marginals(self.scores(w), w.counts)
            starts = np.concatenate([[0], np.cumsum(w.counts[has])[:-1]])
            mean = np.add.reduceat(found, starts, axis=0) / w.counts[has][:, None]
            best[has], score[has] = mean.argmax(1), np.clip(mean.max(1), 0.0, 1.0)
        return best, score


def fit(rows: list[tuple[str, str]], lexicon_words: int = LEXICON_WORDS, rounds: int = ROUNDS, seed: int = 5) -> Field:
    """A field learned from (text, label) rows; several documents in a row form one sequence."""
    rng = np.random.default_rng(seed)
    labels = sorted({label for _, label in rows})
    rows = [rows[i] for i in rng.permutation(len(rows))]
    common: set[int] = set()
    for label in labels:
        got, n = np.unique(words_of([t for t, y in rows if y == label]).hashes, return_counts=True)
        often = np.lexsort((got, -n))[:lexicon_words]
        common.update(got[often][n[often] > 1].tolist())
    field = Field(labels, np.array(sorted(common), np.uint64))
    parts = []
    for i in range(0, len(rows), 40):
        w = words_of([t for t, _ in rows[i : i + 40]])
        y = np.repeat([labels.index(label) for _, label in rows[i : i + 40]], w.counts)
        sequences = np.add.reduceat(w.counts, np.arange(0, len(w.counts), 5))
        if len(y):
            parts.append((w, y, sequences))
    squares = [np.full(x.shape, 1.0, np.float32) for x in field.weights]
    link_squares = np.ones_like(field.links)
    for _ in range(rounds):
        for k in rng.permutation(len(parts)):
            w, y, sequences = parts[k]
            found, seen = field.marginals(field.scores(w), sequences, pairs=True)
            rest = -found
            rest[np.arange(len(y)), y] += 1.0
            rest /= np.sqrt(len(y))
            ids = [w.grams, *w.affixes.T, field.lexical(w)]
            spread = np.repeat(rest, np.diff(np.append(w.first, len(w.grams))), axis=0)
            for j, (x, q) in enumerate(zip(field.weights, squares, strict=True)):
                source = spread if j == 0 else rest
                slope = np.stack([np.bincount(ids[j], source[:, c], len(x)) for c in range(x.shape[1])], 1).astype(np.float32)
                q += slope * slope
                x += 0.3 * (slope - 1e-4 * x) / np.sqrt(q)
            own = np.ones(len(y), bool)
            own[np.concatenate([[0], np.cumsum(sequences)[:-1]])[sequences > 0]] = False
            real = np.zeros_like(field.links)
            at = np.flatnonzero(own)
            np.add.at(real, (y[at - 1], y[at]), 1.0)
            slope = (real - seen) / np.sqrt(len(y))
            link_squares += slope * slope
            field.links = np.clip(field.links + 0.3 * slope / np.sqrt(link_squares), -8, 8)
    return field


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves no remainder by 5; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(
    df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs: int = TRAIN_DOCS,
    most_bytes: int = TRAIN_BYTES, labels: int = TRAIN_LABELS, sample_bytes: int = SAMPLE_BYTES, **options,
) -> Field | None:
    """A field from at most docs documents of each label outside the held-out part; None if there are none.

    Documents come in the order of a hash of their key and text; rows that agree in both
    count once, so the sample is bounded however often a key or a text is repeated. Null
    texts, null labels, texts above most_bytes and labels beyond the most frequent are left
    out. sample_bytes bounds the whole sample, which the driver holds: it is shared evenly by
    the labels, and a label's documents end where its share does.
    """
    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(F.col(key)) & (F.octet_length(text) <= most_bytes))
    rows = rows.select(F.xxhash64(F.col(key), F.col(text)).alias("h"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    # a share of the hashes that holds docs of them with certainty for all purposes, whatever the number of rows
    part = F.shiftrightunsigned("h", 11) / float(2**53)
    once = rows.select("h", "lang", F.octet_length("text").alias("bytes")).distinct()
    common = once.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(labels)
    held = sample_bytes / F.count("*").over(Window.partitionBy())  # over a row for each label
    common = common.select(F.col("lang").alias("l"), ((docs + 6 * math.sqrt(docs) + 10) / F.col("n")).alias("share"), held.alias("held"))
    few = once.withColumn("part", part).join(F.broadcast(common), F.col("lang") == F.col("l")).where(F.col("part") < F.col("share"))
    along = Window.partitionBy("l").orderBy("part", "h")
    sums = {"n": F.row_number().over(along), "upto": F.sum("bytes").over(along.rowsBetween(Window.unboundedPreceding, 0))}
    chosen = few.withColumns(sums).where((F.col("n") <= docs) & (F.col("upto") <= F.col("held"))).select(F.col("h").alias("k"), "l")
    sample = rows.join(F.broadcast(chosen), (F.col("h") == F.col("k")) & (F.col("lang") == F.col("l")), "left_semi")
    got = sample.groupBy("lang", "h").agg(F.first("text").alias("text")).select("text", "lang")
    got = sorted((r["text"], r["lang"]) for r in got.collect())
    return fit(got, **options) if any(len(words_of([t]).first) for t, _ in got) else None


def predict(df: DataFrame, field: Field | None, text: str = "text") -> DataFrame:
    """df with lang_pred and score appended, one output row per input row.

    Texts that are null or have no letter, and all texts without a field, get `und` and 0.
    Nothing but the text is read; columns that are already named lang_pred or score are replaced.
    """
    keep = [c for c in df.columns if c not in ("lang_pred", "score")]
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    plain = F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).otherwise(F.lit(""))
    rows = df.select(row.alias("row"), plain.alias("text"))
    if field is None:
        return rows.select("row.*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    small_batches(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = sent.value
        names = np.array([*model.labels, "und"], object)
        for series in texts:
            values = series.tolist()
            best, score, i = np.full(len(values), -1), np.zeros(len(values)), 0
            while i < len(values):
                j, size = i + 1, len(values[i])
                while j < len(values) and size + len(values[j]) < BLOCK_BYTES:
                    size += len(values[j])
                    j += 1
                best[i:j], score[i:j] = model.predict(values[i:j])
                i = j
            yield pd.DataFrame({"lang_pred": names[best], "score": score})

    return rows.withColumn("p", label("text")).select("row.*", "p.lang_pred", "p.score")
