"""Near copies among embeddings by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned so that their principal directions
come first, by decreasing second moment over all vectors. The space of the first
``LEADING`` coordinates is cut into a tree of boxes of about ``TILE_ROWS`` vectors,
from the counts of all vectors in a fixed grid; every pair of boxes is a tile of
the comparison, to which only vectors go that are near enough to the other box,
found by walking down the tree. A box that the grid can't cut further is dealt to
blocks by a hash, and pairs of its blocks are tiles too, so no task has more than
about four times ``TILE_ROWS``.

A tile accumulates the leading coordinates first. The rest of a product is at
most the product of the lengths of the two suffixes, so a pair stops as soon as
its cosine can no longer reach the threshold. The suffix length is one more
coordinate, so one matrix product gives the bound of a whole block. Vectors are
first held against a few leaders, and blocks whose vectors are all connected
already are passed over, so a crowd of near copies costs a few comparisons each.

The search is exact. Equal vectors are collapsed first; groups are the connected
components of pairs with a cosine of at least ``COSINE``.

Defined results: a vector that is null, empty, of length zero, or holds a null,
NaN or infinite value is no copy of anything; vectors of different dimension are
never compared. The least ``vec_id`` of a group is its head; rows without
``vec_id`` are left out; rows that agree in it are one vector, whichever of its
rows is nearest. A vector may have any number of dimensions that fits a row. An
empty table has no copies. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphwell.llm.arrow import map_batches
from glyphwell.llm.components import connected_components
from glyphwell.llm.kernels import mix64
from glyphwell.llm.simhash import CROWD, LEADERS, Forest
from glyphwell.session import cut

COSINE = 0.95
TILE_ROWS = 20_000
LEADING = 3
#: Steps of the grid in each leading coordinate, over [-1, 1].
GRID = 64
_SLACK = 1e-5
_BLOCK = 2048


def units(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``key``, ``dim``, ``v``: the vectors that have a direction, of length one, as float32 bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, dims, out = [], [], []
        lists, ids = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
        flat, offsets = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), lists.offsets.to_numpy()
        size = np.diff(offsets)
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            x = flat[offsets[at][:, None] + np.arange(d)]
            with np.errstate(all="ignore"):
                largest = np.abs(x).max(axis=1, keepdims=True)
                x = x / largest
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) + np.float32(0)
            ok = np.isfinite(x).all(axis=1)
            keys += ids[at][ok].tolist()
            dims += [int(d)] * int(ok.sum())
            out += [row.tobytes() for row in x[ok]]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["key", "dim", "v"])

    good = df.select(F.col(key).cast("bigint").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    good = good.where("key is not null and size(v) > 0 and not exists(v, x -> x is null)")
    return map_batches(good, run, "key bigint, dim int, v binary")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, d)


def directions(vectors: DataFrame, d: int) -> np.ndarray:
    """The principal directions (d, d) as columns, from second moments over all vectors."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = _matrix(batch.column(0), d).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"i": np.arange(d, dtype=np.int32), "row": pa.array(list(total))})

    rows = vectors.select("v").mapInArrow(moments, "i int, row array<double>").select("i", F.posexplode("row")).groupBy("i", "pos").agg(F.sum("col").alias("s")).toArrow()
    second = np.zeros((d, d))
    second[rows.column("i").to_numpy(), rows.column("pos").to_numpy()] = rows.column("s").to_numpy()
    return np.linalg.eigh((second + second.T) / 2)[1][:, ::-1]


def steps(x: np.ndarray, lead: int) -> np.ndarray:
    """The grid steps of each row's leading coordinates."""
    return np.clip(((x[:, :lead] + 1) * (GRID / 2)).astype(np.int64), 0, GRID - 1)


def cells(x: np.ndarray, lead: int) -> np.ndarray:
    """The number of the grid's cell of each row."""
    return steps(x, lead) @ (GRID ** np.arange(lead)[::-1])


class Boxes:
    """A tree of boxes over the grid's cells: low and high corners in grid steps, children, leaves' numbers and blocks."""

    def __init__(self, cell: np.ndarray, count: np.ndarray, lead: int, rows: int) -> None:
        where = np.stack([cell // GRID**k % GRID for k in range(lead)][::-1], axis=1) if len(cell) else np.zeros((0, lead), np.int64)
        self.lead, self.low, self.high, self.children, self.leaf, self.blocks = lead, [np.zeros(lead, np.int64)], [np.full(lead, GRID)], [None], [-1], []
        todo = [(0, np.arange(len(cell)))]
        while todo:
            at, own = todo.pop()
            low, high = self.low[at], self.high[at]
            best = None
            if count[own].sum() > rows:
                for k in range(lead):
                    mass = np.bincount(where[own, k], weights=count[own], minlength=GRID)[low[k] : high[k]]
                    if (mass > 0).sum() > 1:
                        left = np.cumsum(mass)[:-1]
                        cut_at = int(np.argmin(np.abs(left - mass.sum() / 2)))
                        spread = float(np.sqrt(np.average((np.arange(len(mass)) - np.average(np.arange(len(mass)), weights=mass)) ** 2, weights=mass)))
                        if min(left[cut_at], mass.sum() - left[cut_at]) > 0 and (best is None or spread > best[0]):
                            best = spread, k, low[k] + cut_at + 1
            if best is None:
                self.leaf[at] = len(self.blocks)
                self.blocks.append(max(1, round(count[own].sum() / rows)))
                continue
            _, k, edge = best
            self.children[at] = (len(self.low), len(self.low) + 1)
            for side in (0, 1):
                low_, high_ = low.copy(), high.copy()
                (high_ if side == 0 else low_)[k] = edge
                self.low.append(low_)
                self.high.append(high_)
                self.children.append(None)
                self.leaf.append(-1)
                todo.append((len(self.low) - 1, own[(where[own, k] < edge) == (side == 0)]))

    def within(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and leaves, for each row those no further away than ``reach``, a squared distance."""
        rows, leaves, todo = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [(0, np.arange(len(x)))]
        while todo:
            at, own = todo.pop()
            low, high = self.low[at] * (2 / GRID) - 1, self.high[at] * (2 / GRID) - 1
            far = (np.maximum(0, np.maximum(low - x[own], x[own] - high)) ** 2).sum(axis=1)
            own = own[far <= reach]
            if not len(own):
                continue
            if self.children[at] is None:
                rows.append(own)
                leaves.append(np.full(len(own), self.leaf[at]))
            else:
                todo += [(child, own) for child in self.children[at]]
        return np.concatenate(rows), np.concatenate(leaves)

    def home(self, steps: np.ndarray) -> np.ndarray:
        """The leaf of each row, from its grid steps."""
        out, todo = np.zeros(len(steps), np.int64), [(0, np.arange(len(steps)))]
        while todo:
            at, own = todo.pop()
            if self.children[at] is None:
                out[own] = self.leaf[at]
                continue
            left, right = self.children[at]
            inside = (steps[own] < self.high[left]).all(axis=1)
            todo += [(left, own[inside]), (right, own[~inside])]
        return out


def tile_of(boxes: Boxes, home: np.ndarray, lot: np.ndarray, row: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, ...]:
    """For rows sent to boxes: their numbers and the tiles (a, block of a, b, block of b) that they go to.

    A tile is a pair of blocks, of one box or of two, in order.
    """
    many = np.array(boxes.blocks, np.int64)
    block = lot % many[home]
    at = np.repeat(np.arange(len(row)), many[to])
    other = np.arange(len(at)) - np.repeat(np.cumsum(many[to]) - many[to], many[to])
    r, t = row[at], to[at]
    first = (home[r] < t) | ((home[r] == t) & (block[r] <= other))
    one, two = (home[r], block[r]), (t, other)
    return r, *(np.where(first, x, y) for x, y in zip(one, two)), *(np.where(first, y, x) for x, y in zip(one, two)), block[r]


def near_rows(a: np.ndarray, b: np.ndarray | None, cosine: float, done: Callable[[slice, slice], bool] = lambda p, q: False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of unit vectors in PCA order whose cosine is at least ``cosine``; within ``a``, i < j, if b is None.

    Blocks for whose rows ``done`` is true are passed over.
    """
    d = a.shape[1]
    stops = sorted({max(1, d // 8), max(1, d // 4), max(1, d // 2), d})
    suffix = lambda x, s: np.sqrt(np.maximum(1 - (x[:, :s].astype(np.float64) ** 2).sum(axis=1), 0)).astype(np.float32) if s < d else np.zeros(len(x), np.float32)
    other = a if b is None else b
    bounds = [(suffix(a, s), suffix(other, s)) for s in stops]
    first = stops[0]
    left, right = np.column_stack((a[:, :first], bounds[0][0])), np.column_stack((other[:, :first], bounds[0][1]))
    for p in range(0, len(a), _BLOCK):
        for q in range(p if b is None else 0, len(other), _BLOCK):
            if done(slice(p, p + _BLOCK), slice(q, q + _BLOCK)):
                continue
            i, j = np.nonzero(left[p : p + _BLOCK] @ right[q : q + _BLOCK].T >= cosine - _SLACK)
            i, j = i + p, j + q
            if b is None:
                i, j = i[i < j], j[i < j]
            read, part = first, np.einsum("nd,nd->n", a[i, :first], other[j, :first]) if len(i) else np.zeros(0, np.float32)
            for s, (sa, sb) in zip(stops[1:], bounds[1:]):
                if not len(i):
                    break
                part = part + np.einsum("nd,nd->n", a[i, read:s], other[j, read:s])
                alive = part + sa[i] * sb[j] >= cosine - _SLACK
                i, j, part, read = i[alive], j[alive], part[alive], s
            if len(i):
                exact = np.einsum("nd,nd->n", a[i].astype(np.float64), other[j].astype(np.float64)) >= cosine
                yield i[exact], j[exact]


def link(x: np.ndarray, left: np.ndarray, right: np.ndarray | None, cosine: float) -> Forest:
    """A forest of the rows of ``x`` that joins all near pairs of one of ``left`` and one of ``right``, or of two of ``left``."""
    forest, wide = Forest(len(x)), x.astype(np.float64)
    alive = left if right is None else np.concatenate((left, right))
    for _ in range(LEADERS if len(alive) > CROWD else 0):
        if not len(alive):
            break
        near = wide[alive] @ wide[alive[0]] >= cosine
        near[0] = True
        forest.add(np.full(int(near.sum()), alive[0]), alive[near])
        alive = alive[~near]
    # In the order of their trees, so that blocks are of one tree where there is a crowd.
    p = left[np.argsort(forest.root(left), kind="stable")]
    q = p if right is None else right[np.argsort(forest.root(right), kind="stable")]

    def done(a: slice, b: slice) -> bool:
        roots = forest.root(np.concatenate((p[a], q[b])))
        return bool((roots == roots[0]).all())

    for i, j in near_rows(x[p], None if right is None else x[q], cosine, done):
        forest.add(p[i], q[j])
    return forest


def near_edges(vectors: DataFrame, d: int, cosine: float = COSINE, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges ``u``, ``v`` with the components of all near pairs of the unit vectors ``key``, ``v`` of dimension ``d``."""
    turn, lead = directions(vectors, d), min(LEADING, d)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, n = np.unique(cells(_matrix(batch.column(0), d).astype(np.float64) @ turn, lead), return_counts=True)
        return pa.RecordBatch.from_pydict({"cell": c, "n": n.astype(np.int64)})

    # At most GRID ** LEADING rows, whatever the corpus.
    found = map_batches(vectors.select("v"), count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    boxes = Boxes(found.column("cell").to_numpy(), found.column("n").to_numpy(), lead, tile_rows)
    reach = 2 - 2 * cosine + _SLACK  # squared distance of unit vectors of that cosine

    def send(batch: pa.RecordBatch) -> pa.RecordBatch:
        y = _matrix(batch.column(1), d).astype(np.float64) @ turn
        home, x = boxes.home(steps(y, lead)), np.clip(y[:, :lead], -1, 1)
        row, to = boxes.within(x, reach)
        away = to != home[row]
        row, to = np.concatenate((np.arange(len(y)), row[away])), np.concatenate((home, to[away]))
        lot = (mix64(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(1)).astype(np.int64)
        row, a, ka, b, kb, block = tile_of(boxes, home, lot, row, to)
        v = pa.array([r.tobytes() for r in y.astype(np.float32)], pa.binary()).take(pa.array(row))
        side = (home[row] != a) | (block != ka)  # which of the tile's two blocks is the row's own
        columns = {"a": a, "ka": ka, "b": b, "kb": kb, "side": side, "key": batch.column(0).take(pa.array(row)), "v": v}
        return pa.RecordBatch.from_pydict(columns)

    def compare(tile: pa.Table) -> pa.Table:
        tile = tile.combine_chunks()
        x, key, side = _matrix(tile.column("v"), d), tile.column("key").to_numpy(), tile.column("side").to_numpy(zero_copy_only=False)
        alone = all(tile.column(m)[0].as_py() == tile.column(n)[0].as_py() for m, n in (("a", "b"), ("ka", "kb")))
        forest = link(x, np.flatnonzero(~side), None if alone else np.flatnonzero(side), cosine)
        i, j = (np.concatenate(e) for e in zip(*forest.edges)) if forest.edges else (np.zeros(0, np.int64),) * 2
        return pa.table({"u": key[i], "v": key[j]})

    sent = map_batches(vectors.select("key", "v"), send, "a bigint, ka bigint, b bigint, kb bigint, side boolean, key bigint, v binary")
    return sent.groupBy("a", "ka", "b", "kb").applyInArrow(compare, "u bigint, v bigint")


def near_copies(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``vec_id``, ``duplicate_of``: each near copy, with the least ``vec_id`` of its group."""
    known = cut(units(df, key, vector))
    distinct = cut(known.groupBy("dim", "v").agg(F.min("key").alias("key")))
    edges = known.join(distinct.withColumnRenamed("key", "least"), ["dim", "v"]).where("key <> least").select(F.col("key").alias("u"), F.col("least").alias("v"))
    for (d,) in distinct.select("dim").distinct().orderBy("dim").collect():
        edges = edges.union(near_edges(distinct.where(F.col("dim") == d), d, cosine, tile_rows))
    return connected_components(edges).select(F.col("u").alias("vec_id"), F.col("v").alias("duplicate_of"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle(vectors: str) -> str:
    return f"""
    WITH RECURSIVE vectors AS ({vectors}), near AS (
        SELECT a.vec_id AS u, b.vec_id AS v FROM vectors a, vectors b
        WHERE a.vec_id <> b.vec_id AND len(a.embedding) = len(b.embedding)
          AND list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= {COSINE}),
    reach AS (SELECT u, v FROM near UNION SELECT r.u, n.v FROM reach r JOIN near n ON r.v = n.u)
    SELECT u AS vec_id, min(v) AS duplicate_of FROM reach GROUP BY u HAVING min(v) < u
"""


ORACLE = _oracle("SELECT vec_id, embedding FROM embeddings")


def with_copies(spark, sf_dir: str) -> DataFrame:
    """The operator over all vectors and a near copy of each: doubled, with the coordinates at even places a tenth larger."""
    known = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    copy = F.transform("embedding", lambda x, i: F.when(i % 2 == 0, x * 2.2).otherwise(x * 2.0))
    return near_copies(known.union(known.select(F.col("vec_id") + 1_000_000_000, copy)))


COPIES_ORACLE = _oracle(
    "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings UNION ALL "
    "SELECT vec_id + 1000000000, list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: CASE WHEN i % 2 = 1 THEN x * 2.2 ELSE x * 2.0 END) FROM embeddings"
)
