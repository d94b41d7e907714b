"""Near-duplicate embeddings by collision counting over one-dimensional projections.

Vectors are scaled to unit length and projected on the axes of random rotations. For a
pair of cosine c the squared differences along the d axes of a rotation sum to 2 - 2c.
With windows of half width w centred on a query, w**2 = REACH * (2 - 2c) / d, fewer than
d / REACH axes can miss, so a pair at the threshold or above always counts at least
d - d / REACH collisions, and few other pairs reach that. Counts over the first axes stop
earlier, where a pair at the threshold would be lost with probability MISS / 100 at most.

Which pairs are counted at all is settled by tables. A table takes K of the projections
and collects a pair if it collides in all K; T tables leave a pair at the threshold out
with probability (1 - P(|z| <= sqrt(REACH))**K) ** T <= MISS, and one above it far more
rarely. K grows with the logarithm of the number of vectors and T little, so cells keep
their size while the table grows. A pair is taken by the first table and by the one cell
that is due to it, hence once. Pairs that pass the count are verified in double precision.

Inside a cell the vectors are sorted along the table's first projection, and each run of
queries meets the slice of its window. Cells above BLOCK_ROWS are dealt out as pairs of
blocks to different tasks. Equal vectors are one node throughout; tasks return link
counts for each node and the edges of a forest, never all pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import written

COSINE, REACH, MISS = 0.95, 6.4, 1e-5
#: Vectors that a cell should hold, vectors of a block, queries and others that meet at once.
CELL_ROWS, BLOCK_ROWS, QUERY_ROWS, SLICE_ROWS = 4000, 12_000, 128, 2048
#: Cells are this many half windows wide.
WIDE = 4.0


class Plan:
    """Rotations, tables and cells for vectors of one length."""

    def __init__(self, size: int, rows: int, cosine: float, seed: int = 17):
        self.size, self.cosine = size, cosine
        self.gap = 2.0 - 2.0 * cosine
        self.window = math.sqrt(REACH * self.gap / size) + 1e-9
        inside = math.erf(math.sqrt(REACH / 2))
        # (first axis, last axis, misses allowed so far): all axes by the bound, fewer by the binomial tail
        steps = sorted({size, *(max(1, size // k) for k in (8, 4, 2))})
        bound = int(size / REACH) + 1
        self.counts = [(a, b, bound if b == size else min(bound, _tail(b, 1 - inside, MISS / 100))) for a, b in zip([0, *steps], steps, strict=False)]
        if size < 16:  # some axis has at most the mean difference, which is inside the window
            self.depth, self.tables = 1, size
        else:
            self.depth = max(1, min(size // 2, math.ceil(math.log(max(rows, 1) / CELL_ROWS) / 0.84)))
            self.tables = max(1, math.ceil(math.log(MISS) / math.log(1 - inside**self.depth)))
        rng = np.random.default_rng((seed, size))
        turns = [np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(-(-self.depth * self.tables // size))]
        self.axes = np.concatenate(turns, axis=1)
        self.shift = rng.random(self.depth * self.tables) * WIDE * self.window

    def unit(self, vectors: np.ndarray) -> np.ndarray:
        scaled = vectors / np.abs(vectors).max(1, keepdims=True)
        return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)

    def cells(self, values: np.ndarray, table: int) -> np.ndarray:
        """Cell coordinates of values (rows, depth) of a table."""
        own = slice(table * self.depth, (table + 1) * self.depth)
        return np.floor((values + self.shift[own]) / (WIDE * self.window)).astype(np.int64)

    def entries(self, vectors: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(table, rows, cell names): each vector's own cell, and those it may meet smaller vectors in."""
        spots = self.unit(vectors) @ self.axes[:, : self.depth * self.tables]
        found = []
        for t in range(self.tables):
            own = spots[:, t * self.depth : (t + 1) * self.depth]
            here, below = self.cells(own, t), self.cells(own - self.window - 1e-5, t)  # wider than single precision errs
            rows, at = np.arange(len(own)), here
            for j in range(self.depth):
                low = at.copy()
                low[:, j] = below[rows, j]
                twice = low[:, j] != at[:, j]
                rows, at = np.concatenate([rows, rows[twice]]), np.concatenate([at, low[twice]])
            found.append((t, rows, _names(at, t)))
        return found


def _tail(n: int, p: float, risk: float) -> int:
    """The fewest misses of n that a pair at the threshold exceeds with a probability under risk."""
    total, k = 0.0, n
    while k > 0:
        total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if total >= risk:
            return k
        k -= 1
    return 0


def _names(cells: np.ndarray, table: int) -> np.ndarray:
    """A 64-bit name of each cell; cells that share one are only searched together."""
    name = np.full(len(cells), table + 1, np.uint64)
    for j in range(cells.shape[1]):
        name = (name ^ cells[:, j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        name ^= name >> np.uint64(29)
    return name.view(np.int64)


def linked(plan: Plan, vectors: np.ndarray, table: int, cell: int, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of cosine at least plan.cosine that this table and cell are due to report."""
    unit = plan.unit(vectors)
    spots = (unit @ plan.axes).astype(np.float32)
    own = list(range(table * plan.depth, (table + 1) * plan.depth))
    w = np.float32(plan.window + 1e-6)
    turn = own[0] // plan.size * plan.size
    # the axes of one rotation, the table's own last: they collide anyhow
    rest = np.ascontiguousarray(np.roll(spots[:, turn : turn + plan.size], turn - own[-1] - 1, axis=1))
    along = lambda rows: rows[np.argsort(spots[rows, own[0]], kind="stable")]
    queries = along(np.arange(len(spots)) if side is None else np.flatnonzero(side == side.min()))
    others = queries if side is None else along(np.flatnonzero(side != side.min()))
    line = spots[others, own[0]]
    mine, theirs = ([np.ascontiguousarray(spots[rows, j]) for j in own] for rows in (queries, others))
    out_i, out_j = [], []
    for a in range(0, len(queries), QUERY_ROWS):
        b = min(len(queries), a + QUERY_ROWS)
        start = a if side is None else int(np.searchsorted(line, mine[0][a] - w, side="left"))
        end = int(np.searchsorted(line, mine[0][b - 1] + w, side="right"))
        parts = [_collide([p[a:b] for p in mine], [q[c : min(end, c + SLICE_ROWS)] for q in theirs], w, c) for c in range(start, end, SLICE_ROWS)]
        if not parts:
            continue
        i, j = (np.concatenate(x) for x in zip(*parts, strict=True))
        if side is None:
            up = j > a + i  # slices begin at the queries themselves
            i, j = i[up], j[up]
        i, j = queries[a + i], others[j]
        missed = np.zeros(len(i), np.int64)
        for first, last, most in plan.counts:  # count collisions; stop where too many axes have missed
            missed = missed + (np.abs(np.take(rest[:, first:last], i, 0) - np.take(rest[:, first:last], j, 0)) > w).sum(1)
            keep = missed <= most
            i, j, missed = i[keep], j[keep], missed[keep]
        for t in range(table):  # an earlier table reports what collides there
            earlier = list(range(t * plan.depth, (t + 1) * plan.depth))
            keep = (np.abs(spots[np.ix_(i, earlier)] - spots[np.ix_(j, earlier)]) > w).any(1)
            i, j = i[keep], j[keep]
        if len(i):
            raw_i, raw_j = vectors[i], vectors[j]
            dot = np.einsum("nd,nd->n", unit[i], unit[j])
            exact = np.where(np.abs(dot - plan.cosine) < 1e-9, _cosine(raw_i, raw_j), dot) >= plan.cosine
            low = np.minimum(unit[i] @ plan.axes[:, own], unit[j] @ plan.axes[:, own])
            due = _names(plan.cells(low, table), table) == cell
            i, j = i[exact & due], j[exact & due]
            out_i.append(i)
            out_j.append(j)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _collide(mine: list[np.ndarray], theirs: list[np.ndarray], w: np.float32, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, start + j) of pairs within w along all projections; the tables are small enough for a core's cache."""
    shape = len(mine[0]), len(theirs[0])
    gap, near, hits = np.empty(shape, np.float32), np.empty(shape, bool), np.empty(shape, bool)
    for k, (p, q) in enumerate(zip(mine, theirs, strict=True)):
        np.subtract(p[:, None], q[None, :], out=gap)
        np.abs(gap, out=gap)
        np.less_equal(gap, w, out=near if k else hits)
        if k:
            hits &= near
    i, j = np.divmod(np.flatnonzero(hits), shape[1])
    return i, j + start


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("nd,nd->n", a, b) / np.sqrt(np.einsum("nd,nd->n", a, a) * np.einsum("nd,nd->n", b, b))


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(key, n_links, component_id, kept), one row for each row of df.

    n_links counts the other rows at a cosine of at least cosine, component_id is the
    smallest key that links reach, and kept tells whether it is the row's own. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing,
    and vectors link with those of their own length only. Repeated rows are links of each
    other; a null key counts among the links but is nobody's component unless all are
    null. Other columns are dropped.
    """
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("key"), F.when(fine, F.col(vector)).alias("v"))
    # equal vectors are one node; -0.0 is 0.0
    name = F.unhex(F.md5(F.array_join(F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast("string")), ",").cast("binary")))
    rows = rows.withColumn("node", F.when(F.col("v").isNotNull(), name))
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("key").alias("first"), F.count("*").alias("m"), F.first("v").alias("v"))
    nodes = written(nodes, "vectors")
    found = None
    for size, n in sorted((r["size"], r["n"]) for r in nodes.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).collect()):
        part = _search(nodes.where(F.size("v") == size), Plan(size, n, cosine))
        found = part if found is None else found.union(part)
    if found is None:
        return rows.select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    found = written(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.where("other is not null"), "node", "other")
    first = joined.join(nodes.select(F.col("node").alias("id"), "first"), "id").groupBy("component").agg(F.min("first").alias("least"))
    joined = joined.join(first, "component").select(F.col("id").alias("node"), "least")
    about = nodes.select("node", "m", "first").join(links, "node", "left").join(joined, "node", "left")
    about = about.select("node", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    # as a table of its own, so that the join of a vector with very many copies can be split
    done = rows.select("key", "node").join(written(about, "about"), "node", "left")
    component = F.coalesce("component_id", "key")
    return done.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("key")).alias("kept"))


def _search(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(node, other, links): rows with links add to a node's links, those with other are forest edges."""
    size = plan.size
    plain = nodes.select("node", "m", "v")
    kind = plain.schema["v"].dataType.simpleString()

    def spread(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                for table, at, names in plan.entries(_matrix(part.column("v"), size)):
                    taken = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [*taken.columns, pa.array(np.full(len(at), table, np.int32)), pa.array(names)], ["node", "m", "v", "table", "cell"]
                    )

    entries = plain.mapInArrow(spread, f"node binary, m bigint, v {kind}, table int, cell bigint")
    counts = entries.groupBy("table", "cell").agg(F.count("*").alias("n")).where("n > 1")
    entries = entries.join(counts, ["table", "cell"])
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    entries = entries.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j")))
    entries = entries.select("node", "m", "v", "table", "cell", "block", F.explode(pair).alias("p"))
    entries = entries.select("node", "m", "v", "table", "cell", "block", F.col("p.i").alias("i"), F.col("p.j").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        number, cell = table.column("table")[0].as_py(), table.column("cell")[0].as_py()
        node, m = table.column("node").to_pylist(), table.column("m").to_numpy()
        side = None if table.column("i")[0].as_py() == table.column("j")[0].as_py() else table.column("block").to_numpy()
        a, b = linked(plan, _matrix(table.column("v"), size), number, cell, side)
        total = np.bincount(a, m[b], len(m)) + np.bincount(b, m[a], len(m))
        root = list(range(len(m)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        left, right = [], []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            rx, ry = find(x), find(y)
            if rx != ry:
                root[rx] = ry
                left.append(node[x])
                right.append(node[y])
        has = np.flatnonzero(total)
        return pa.table(
            {
                "node": pa.array([node[i] for i in has] + left, pa.binary()),
                "other": pa.array([None] * len(has) + right, pa.binary()),
                "links": pa.array(total[has].astype(np.int64).tolist() + [0] * len(left), pa.int64()),
            }
        )

    # dealt by all four: the join's own partitioning would keep all blocks of a cell together
    return entries.repartition("table", "cell", "i", "j").groupBy("table", "cell", "i", "j").applyInArrow(run, "node binary, other binary, links bigint")
