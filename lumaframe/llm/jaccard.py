"""N-gram Jaccard join with signature trees.

Documents with equal shingle sets are one node, named by its smallest row and a digest of
the set. Nodes that may be similar meet where they share a band key (min-hashes of the
set): a link of similarity s is missed with probability (1 - s**ROWS) ** BANDS, 9e-7 at
0.8 and 1e-9 at 0.85, and far less above; sets of similarity 0.3 share a key in one of
twelve cases. Where nodes meet the join is exact: a tree over the sets holds OR-combined
token bitmaps, size ranges and bitmap slack at each node, a dual traversal drops node
pairs whose largest possible overlap is below what the smallest sizes need, and pairs
that reach the leaves are compared token by token. Node pairs that are already one
component are skipped, so thousands of copies of a text cost about one comparison each.

Only verified links form components. The join runs twice: over the groups of the first
FIRST bands, then over those groups of all bands that still hold several components,
which after the first run are few. Groups of equal members are taken once. A group above
WHOLE_SHINGLES is cut into blocks. The first run joins each block and the group's
smallest set, so a large group of near copies becomes one component at linear cost; the
second joins what lies outside the group's largest component with every block.

Texts that share a key with another move once to a table of their own, and from there to
the groups. They never leave the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import beside, components
from .shared import small_batches, written
from .shingles import Bands, digest, shingle_sets

BANDS, ROWS, FIRST = 35, 5, 6
#: Shingles of the largest group that stays whole, of a block of others, and of a task of small ones; bytes of text scored at once.
WHOLE_SHINGLES, BLOCK_SHINGLES, TASK_SHINGLES, BATCH_BYTES = 250_000, 150_000, 250_000, 2_000_000
FAN = 8
NO_KEY = -(2**63)


class Tree:
    """A signature tree over sets; leaves are single sets, ordered by their own order and size."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        n = len(sets)
        sizes = np.array([len(s) for s in sets], np.int64)
        maps = np.zeros((n, bits // 64), np.uint64)
        for i, s in enumerate(sets):
            at = (s & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(maps[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        slack = sizes - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, sizes, sizes, slack)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, slack = self.levels[-1]
            cut = np.arange(0, len(maps), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(slack, cut)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether any pair of sets below nodes a and b of a level may be similar enough."""
        maps, low, high, slack = self.levels[level]
        fits = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
        most = np.bitwise_count(maps[a] & maps[b]).sum(1).astype(np.int64) + np.minimum(slack[a], slack[b])
        most = np.minimum(most, np.minimum(high[a], high[b]))
        return fits & ((100 + percent) * most >= percent * (low[a] + low[b]))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b|, exactly."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def forest(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, parts: list | None = None) -> list[tuple[int, int]]:
    """Linked pairs that connect whatever links connect.

    With side, links between the two sides count only; sets of equal parts are connected from the start.
    """
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][0] if len(sets[i]) else 0))
    sets = [sets[i] for i in order]
    side = None if side is None else np.asarray(side)[order]
    longest = max(map(len, sets), default=1)
    tree = Tree(sets, max(64, 1 << (2 * longest - 1).bit_length()))
    root, heads = list(range(len(sets))), {}
    for i, own in enumerate(order if parts else ()):
        root[i] = heads.setdefault(parts[own], i)
    links, joined = [], bool(parts)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def one(level: int, a: int, b: int) -> bool:
        """Whether all below two nodes is one component already."""
        width = FAN**level
        r = find(a * width)
        return all(find(i) == r for n in {a, b} for i in range(n * width, min(len(sets), (n + 1) * width)))

    top = len(tree.levels) - 1
    stack = [(top, 0, 0)] if sets else []
    while stack:
        level, a, b = stack.pop()
        if level == 0:
            if a != b and find(a) != find(b) and (side is None or side[a] != side[b]) and similar(sets[a], sets[b], percent):
                root[find(a)] = find(b)
                links.append((order[a], order[b]))
                joined = True
            continue
        if joined and one(level, a, b):
            continue
        below, n = level - 1, len(tree.levels[level - 1][0])
        left, right = np.arange(a * FAN, min(n, (a + 1) * FAN)), np.arange(b * FAN, min(n, (b + 1) * FAN))
        x, y = (m.ravel() for m in np.meshgrid(left, right, indexing="ij"))
        if a == b:
            x, y = x[x <= y], y[x <= y]
        may = tree.possible(below, x, y, percent)
        if below == 0:
            may &= x != y
        pairs = [(below, int(i), int(j)) for i, j in zip(x[may], y[may], strict=True)]
        pairs.sort(key=lambda p: p[2] - p[1], reverse=True)  # a node with itself is taken first
        stack += pairs
    return links


def _profiles(df: DataFrame, size: int, key: str, text: str, own: Column) -> DataFrame:
    """(key, own, n_shingles, set, bands) of every row; own is a bigint that passes through."""
    rows = df.select(_coded(key).alias("key"), own.alias("own"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(BANDS, ROWS)
        for batch in batches:
            for part, sets in _by_size(batch, "text", size):
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        part.column("own"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(s) for s in sets], pa.binary()),
                        pa.array([bands.keys(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    ["key", "own", "n_shingles", "set", "bands"],
                )

    return rows.mapInArrow(run, "key bigint, own bigint, n_shingles bigint, set binary, bands array<bigint>")


def _coded(key: str) -> Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY))


def _ordered(number: Column) -> Column:
    """Eight bytes that stand in the order of a bigint."""
    return F.unhex(F.lpad(F.hex(number.bitwiseXOR(F.lit(NO_KEY))), 16, "0"))


def _key_of(node: Column) -> Column:
    """The key that a node's name begins with."""
    return (F.conv(F.hex(F.substring(node, 1, 8)), 16, 10).cast("decimal(20,0)") + F.lit(NO_KEY).cast("decimal(20,0)")).cast("long")


def _by_size(batch, column: str, size: int):
    """Slices of a batch of about BATCH_BYTES of text each, with their shingle sets."""
    texts = [t.encode("utf-8", "surrogatepass") for t in batch.column(column).to_pylist()]
    i = 0
    while i < len(texts):
        j, total = i + 1, len(texts[i])
        while j < len(texts) and total + len(texts[j]) <= BATCH_BYTES:
            total += len(texts[j])
            j += 1
        yield batch.slice(i, j - i), shingle_sets(texts[i:j], size)
        i = j


def classes(df: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id), one row for each row of df.

    Two rows link when 100 * |a & b| >= percent * |a | b| for their sets of distinct
    shingles of size words; component_id is the smallest key that links reach, the row's
    own included. Null or empty texts and texts without words have no shingles and link
    with nothing. A null key counts as the smallest and comes back as null. Repeated rows
    are in one class; other columns are dropped.
    """
    small_batches(df.sparkSession)
    own = F.xxhash64(text)
    rows = written(_profiles(df, size, key, text, own), "profiles")
    nodes, joined = _joined(df, rows, size, percent, key, text, own)
    # a name begins with its key, so the smallest name of a component names its smallest key
    named = nodes.select("set", "id").join(joined, "id", "left")
    named = written(named.select("set", _key_of(F.coalesce("component", "id")).alias("component_id")), "classes")
    real = lambda c: F.when(c != NO_KEY, c)
    return rows.join(named, "set", "left").select(
        real(F.col("key")).cast(df.schema[key].dataType).alias(key), "n_shingles", real(F.coalesce("component_id", "key")).alias("component_id")
    )


def one_of_each_class(df: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of df for each class of texts that links join: of the smallest key (null first), then of the smallest hash of the row.

    Classes are those of the texts, whatever their keys: different texts under one key, or
    under none, are told apart. Rows whose text has no words link with nothing, and all stay.
    """
    small_batches(df.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    worded = F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    held, own = df.where(worded), F.xxhash64(row)
    rows = written(_profiles(held, size, key, text, own), "profiles")
    nodes, joined = _joined(held, rows, size, percent, key, text, own)
    kept = written(nodes.join(joined.where("id != component"), "id", "left_anti").select("key", "own"), "kept")
    found = held.select(_coded(key).alias("key"), own.alias("own"), row.alias("row")).join(kept, ["key", "own"], "left_semi")
    once = Window.partitionBy("key", "own").orderBy("own")  # equal rows have the same hash
    return found.withColumn("n", F.row_number().over(once)).where("n = 1").select("row.*").unionByName(df.where(~worded))


def _joined(df: DataFrame, rows: DataFrame, size: int, percent: int, key: str, text: str, own: Column) -> tuple[DataFrame, DataFrame]:
    """The distinct sets of profiles (id, set, key, own), and (id, component) of those that links join."""
    first = F.min(F.struct("key", "own")).alias("first")
    nodes = rows.where("n_shingles > 0").groupBy("set").agg(first, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = nodes.select(F.concat(_ordered(F.col("first.key")), _ordered(F.col("first.own")), F.col("set")).alias("id"), "set", "first.key", "first.own", "n", "bands")
    nodes = written(nodes, "nodes")
    name = F.xxhash64("id").alias("name")
    keys = nodes.select(name, F.posexplode("bands").alias("place", "band"))
    # as a table of its own, so that the join of a very common band can be split
    shared = keys.groupBy("band").agg(F.min("name").alias("least"), F.max("name").alias("most")).where("least != most").select("band")
    keys = keys.join(written(shared, "shared"), "band").join(nodes.select(name, "id", "key", "own", "n"), "name")
    keys = written(keys.select("id", "key", "own", "n", "place", "band"), "keys")
    texts = df.select(_coded(key).alias("key"), own.alias("own"), F.col(text).alias("text")).where(F.col(text).isNotNull())
    texts = texts.join(keys.select("id", "key", "own").distinct(), ["key", "own"])
    texts = written(texts.groupBy("key", "own").agg(F.first("id").alias("id"), F.first("text").alias("text")).select("id", "text"), "texts")
    keys = keys.select("id", "n", "place", "band")
    links = written(_links(keys.where(F.col("place") < FIRST).withColumn("comp", F.col("id")), texts, size, percent, True), "links")
    joined = written(components(links, "a", "b"), "joined")
    keys = keys.join(joined, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    more = written(_links(keys, texts, size, percent, False), "links")
    return nodes, components(links.union(more), "a", "b")


def _links(keys: DataFrame, texts: DataFrame, size: int, percent: int, blockwise: bool) -> DataFrame:
    """(a, b): names of linked sets, enough to connect what the links inside groups connect.

    keys has (id, n, band, comp), comp naming what is connected already. With blockwise, a
    large group is only joined inside its blocks and with its smallest set.
    """
    about = {"least": (F.min, "id"), "lo": (F.min, "comp"), "hi": (F.max, "comp"), "total": (F.sum, "n"), "mark": (F.bit_xor, F.xxhash64("id")), "members": (F.sum, F.lit(1))}
    rows = beside(keys, ["band"], "id", **about).where("lo != hi")
    rows = rows.withColumn("group", F.xxhash64("mark", "members", "least")).dropDuplicates(["group", "id"])  # of groups of equal members one stays
    blocks = F.when(F.col("total") <= WHOLE_SHINGLES, 1).otherwise(F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int")
    rows = written(rows.select("group", "id", "n", "comp", "least", blocks.alias("blocks")), "groups")
    total = rows.agg(F.sum("n").alias("n")).first()["n"] or 0
    tasks = max(1, -(-total // TASK_SHINGLES))
    none = F.lit(0).alias("i"), F.lit(0).alias("j")
    dealt = rows.where("blocks = 1").select("group", "id", "comp", *none, F.lit(False).alias("guest"), F.pmod(F.xxhash64("group"), F.lit(tasks)).alias("task"))
    large = rows.where("blocks > 1").withColumn("home", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    if not large.isEmpty():
        if blockwise:
            homes = large.select("group", "id", "comp", F.lit(0).alias("i"), F.col("home").alias("j"), F.lit(False).alias("guest"))
            guests = large.where("id = least").select("group", "id", "comp", F.lit(0).alias("i"), upto(F.col("blocks")).alias("j"), F.lit(True).alias("guest"))
        else:
            large = beside(large, ["group", "comp"], "id", weight=(F.sum, "n"))
            large = beside(large, ["group"], "id", main=(F.max, F.struct("weight", "comp"))).withColumn("outside", F.col("comp") != F.col("main.comp"))
            large = beside(large, ["group"], "id", rest=(F.sum, F.when(F.col("outside"), F.col("n")).otherwise(0)))
            parts = F.ceil(F.col("rest") / BLOCK_SHINGLES).cast("int")
            homes = large.select("group", "id", "comp", upto(parts).alias("i"), F.col("home").alias("j"), F.lit(False).alias("guest"))
            guests = large.where("outside").select("group", "id", "comp", F.pmod(F.xxhash64("id"), parts).cast("int").alias("i"), upto(F.col("blocks")).alias("j"), F.lit(True).alias("guest"))
        dealt = dealt.union(homes.union(guests).withColumn("task", F.xxhash64("group", "i", "j")))

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_pylist()
        place = {x: n for n, x in enumerate(ids)}
        once = table.take(pa.array(list(place.values())))
        sets = dict(zip(place, (s for _, some in _by_size(once, "text", size) for s in some), strict=True))
        groups: dict = {}
        where = zip(*(table.column(c).to_pylist() for c in ("group", "i", "j", "guest", "comp")), strict=True)
        for x, (group, i, j, guest, comp) in zip(ids, where, strict=True):
            if digest(sets[x]) == x[16:]:
                groups.setdefault((group, i, j), []).append((x, guest, comp))
        a, b = [], []
        for members in groups.values():
            side = None if blockwise or not any(g for _, g, _ in members) else np.array([g for _, g, _ in members])
            for x, y in forest([sets[m[0]] for m in members], percent, side, [m[2] for m in members]):
                a.append(members[x][0])
                b.append(members[y][0])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return dealt.join(texts, "id").groupBy("task").applyInArrow(run, "a binary, b binary")
