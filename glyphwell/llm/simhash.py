"""SimHash near-dedup by the generalised pigeonhole principle.

Every document gets a 256-bit SimHash of its distinct words. Two documents are
near copies if the first 64 bits differ in at most ``RADIUS`` places and all 256
in at most ``FULL_RADIUS``. The search for such pairs is exact:

* The 64 bits are grouped into parts so that correlated bits share a part.
* Part ``i`` gets its own radius ``t_i``, with ``sum(t_i) = RADIUS - parts + 1``;
  a near pair must then be within ``t_i`` of each other in at least one part.
  Dynamic programming picks the radii of least total cost; the number of
  candidates of a part at each radius is counted over all fingerprints, by a
  Walsh-Hadamard transform of the histogram of the part's values.
* Fingerprints are sent to sub-cubes of a part's values, and to half of the
  neighbouring sub-cubes within its radius: of two neighbours a hash names the one
  that the other's rows visit. The rows that each sub-cube gets are counted
  beforehand; one of over ``2 * TASK_ROWS`` is dealt to blocks by a hash, and its
  tasks are the pairs of two blocks, so no task outgrows that, however the values
  crowd. A part has as many sub-cubes as send the fewest rows by that count. Each task probes its rows, verifies the candidates, and hands on only a
  spanning forest of the near pairs, which has the same connected components and
  at most one edge a row.
* In a task, rows of equal value are first held against a few leaders of theirs,
  and rows of a large tree pass over that tree, so a crowd of near copies costs a
  few comparisons a row. Rows are sorted by value once, and again only when trees
  have grown by an eighth of all rows; no pair is compared from both sides.

Groups are the connected components. Equal fingerprints are collapsed before
the search, so thousands of equal copies cost one row.

Defined results: a null text counts as an empty one, and an empty one is never a
copy of anything. A text without words, such as one of punctuation, stands for
one word, so it is a copy of equal texts only. A very long text is one slice of
its own. Of a group the least ``doc_id`` stays (nulls last). Rows of equal
``doc_id`` are one document in a report; in ``drop_near_copies`` repeated rows are
copies too, and exactly one row of each group stays. Documents are named there by
128 bits of hashes. An empty table has no groups. Other columns pass through,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glyphwell.llm import kernels
from glyphwell.llm.arrow import map_batches, record
from glyphwell.llm.chunks import row_keys
from glyphwell.llm.components import connected_components
from glyphwell.session import cut, free_names

#: Most differing bits of near copies: among the first 64, and among all 256.
RADIUS = 10
FULL_RADIUS = 36
#: Rows that one probing task should hold; some 100 bytes each.
TASK_ROWS = 400_000
#: Cost of a row sent to a sub-cube, in verified candidates.
ROW_COST = 300.0
#: Rows of one value that are held against leaders first, and rounds of leaders.
CROWD, LEADERS = 64, 4
#: Pairs of two values from which they are compared as one block.
BLOCK = 1 << 12

_SEEDS = (np.uint64(0), np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F), np.uint64(0x2545F4914F6CDD1D))
# Byte b as eight byte-wide lanes, lane k holding bit k: lanes add up to 255 words at once.
_LANES = np.zeros(256, np.uint64)
for _k in range(8):
    _LANES |= ((np.arange(256, dtype=np.uint64) >> np.uint64(_k)) & np.uint64(1)) << np.uint64(8 * _k)

_FINGERPRINT = {"key": pa.int64(), "f0": pa.int64(), "f1": pa.int64(), "f2": pa.int64(), "f3": pa.int64()}


def simhashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints (rows, 4) of a text column, and which rows have text.

    A bit is set if more than half of the distinct words' hashes have it set.
    """
    prints, worded = np.zeros((len(column), 4), np.uint64), np.zeros(len(column), bool)
    for first, _, hashes, row in kernels.words(column):
        if not len(hashes):
            continue
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        hashes, row = hashes[fresh], row[fresh]
        head = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        size = np.diff(np.append(head, len(row)))
        # Blocks of at most 255 words, so that byte lanes can't overflow.
        blocks = -(-size // 255)
        start = np.repeat(head, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        block_head = np.cumsum(blocks) - blocks
        docs = row[head] + first
        worded[docs] = True
        for k, seed in enumerate(_SEEDS):
            word = kernels.mix64(hashes + seed) if k else hashes
            octets = word.view(np.uint8).reshape(-1, 8)
            bits = np.empty((len(head), 64), bool)
            for j in range(8):
                lanes = np.add.reduceat(_LANES[octets[:, j]], start).view(np.uint8).reshape(-1, 8)
                ones = np.add.reduceat(lanes.astype(np.int64), block_head, axis=0)
                bits[:, 8 * j : 8 * j + 8] = 2 * ones > size[:, None]
            prints[docs, k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    raw, starts = kernels.string_buffer(column)
    for i in np.flatnonzero(~worded & (np.diff(starts) > 0)):  # no word: the text as a whole stands for one
        whole = kernels.span_hashes(raw[starts[i] : starts[i + 1]], np.zeros(1, np.int64), np.diff(starts[i : i + 2]))
        prints[i], worded[i] = [whole[0], *(kernels.mix64(whole + seed)[0] for seed in _SEEDS[1:])], True
    return prints, worded


def fingerprints(docs: DataFrame, key: str, text: str = "text", also: list[str] | None = None) -> DataFrame:
    """``key``, ``f0`` .. ``f3``, and further BIGINT columns, of the documents that have text. ``key`` is a BIGINT."""
    also = also or []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints, worded = simhashes(batch.column(1))
        signed, mask = prints[worded].view(np.int64), pa.array(worded)
        more = {name: batch.column(2 + k).filter(mask) for k, name in enumerate(also)}
        return record(_FINGERPRINT | dict.fromkeys(also, pa.int64()), key=batch.column(0).filter(mask), **{f"f{k}": signed[:, k].copy() for k in range(4)}, **more)

    columns = [F.col(key).alias("key"), F.col(text).alias("text"), *(F.col(c).cast("bigint").alias(c) for c in also)]
    return map_batches(docs.select(*columns), run, "key bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint" + "".join(f", {c} bigint" for c in also))


@dataclass(frozen=True)
class Plan:
    """Bits of each part, its radius (-1: not probed), the bits that name its sub-cubes, and the blocks of large sub-cubes."""

    parts: tuple[tuple[int, ...], ...]
    radii: tuple[int, ...]
    cube_bits: tuple[int, ...]
    blocks: tuple[dict[int, int], ...]


def group_bits(correlation: np.ndarray, parts: int) -> tuple[tuple[int, ...], ...]:
    """Split the bits evenly into parts, each grown from the free bit most correlated with its own."""
    n, free, out = len(correlation), set(range(len(correlation))), []
    strength = np.abs(correlation) - np.eye(n)
    for p in range(parts):
        size = n // parts + (p < n % parts)
        rest = sorted(free)
        own = [rest[int(np.argmax(strength[np.ix_(rest, rest)].max(axis=1)))]]
        free.discard(own[0])
        while len(own) < size:
            rest = sorted(free)
            own.append(rest[int(np.argmax(strength[np.ix_(rest, own)].sum(axis=1)))])
            free.discard(own[-1])
        out.append(tuple(sorted(own)))
    return tuple(out)


def candidate_counts(values: np.ndarray, counts: np.ndarray, width: int, most: int) -> np.ndarray:
    """Ordered pairs of rows whose values differ in at most 0, 1, .. ``most`` bits."""
    x = np.zeros(1 << width)
    x[values] = counts
    for twice in range(2):  # the transform of the squared transform is the autocorrelation over XOR
        h = 1
        while h < len(x):
            x = x.reshape(-1, 2, h)
            x = np.stack((x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]), axis=1).reshape(-1)
            h *= 2
        x = x * x if not twice else x / len(x)
    apart = np.bitwise_count(np.arange(1 << width, dtype=np.uint32))
    return np.cumsum(np.bincount(apart, weights=x, minlength=width + 1)[: most + 1])


def allocate(cost: list[list[float]], total: int) -> tuple[int, ...]:
    """Radii t_i >= -1 with sum ``total`` and least summed ``cost[i][t_i + 1]``."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in cost:
        after: dict[int, tuple[float, tuple[int, ...]]] = {}
        for used, (c, chosen) in best.items():
            for t1, extra in enumerate(row):
                now = (c + extra, (*chosen, t1 - 1))
                if used + t1 not in after or now < after[used + t1]:
                    after[used + t1] = now
        best = after
    return best[total + len(cost)][1]


def _cube(width: int, cubes: int) -> int:
    return min(width, max(0, cubes))


def visits(home: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether rows of one sub-cube go to another: of a pair only those of one, by a hash of both, and all to their own."""
    low, high = np.minimum(home, to).astype(np.uint64), np.maximum(home, to).astype(np.uint64)
    turn = (kernels.mix64(low << np.uint64(32) | high) & np.uint64(1)).astype(bool)
    return (home == to) | ((home < to) == turn)


def _ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def part_count(rows: int, radius: int) -> int:
    """Parts of least expected cost for bits that were independent."""

    def cost(m: int) -> float:
        each, extra = divmod(radius - m + 1, m)
        width = 64 // m
        balls = sum(_ball(width, each + (i < extra)) for i in range(m))
        return rows * rows / 2 * balls / 2.0**width + rows * balls * 4 + rows * m * ROW_COST

    return min((m for m in range(3, 9) if 64 // m <= 22 and radius - m + 1 >= 0), key=cost, default=4)


def part_value(column: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The bits of 64-bit fingerprints at the given places, packed from the lowest."""
    out = np.zeros(len(column), np.uint32)
    for k, bit in enumerate(bits):
        out |= ((column >> np.uint64(bit)) & np.uint64(1)).astype(np.uint32) << np.uint32(k)
    return out


def plan(prints: DataFrame, radius: int = RADIUS, task_rows: int = TASK_ROWS) -> Plan:
    """Group the bits and allocate the radii from counts over all of ``prints``."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((65, 65), np.int64)
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bits = np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            bits = np.hstack((bits, np.ones((len(bits), 1), np.float32)))
            for at in range(0, len(bits), 1 << 20):
                total += np.rint(bits[at : at + (1 << 20)].T @ bits[at : at + (1 << 20)]).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"i": np.arange(65 * 65, dtype=np.int32), "s": total.ravel()})

    sums = np.zeros(65 * 65)
    for i, s in prints.select("f0").mapInArrow(moments, "i int, s bigint").groupBy("i").agg(F.sum("s")).toPandas().itertuples(index=False):
        sums[i] = s
    sums = sums.reshape(65, 65)
    n = max(int(sums[64, 64]), 1)
    mean = sums[64, :64] / n
    covariance = sums[:64, :64] / n - np.outer(mean, mean)
    spread = np.sqrt(np.clip(np.diag(covariance), 1e-9, None))
    m = part_count(n, radius)
    parts = group_bits(covariance / np.outer(spread, spread), m)
    # The lowest bits of a part name its sub-cubes: the most even ones, so that sub-cubes are of a size.
    parts = tuple(tuple(sorted(bits, key=lambda b: (abs(mean[b] - 0.5), b))) for bits in parts)
    total = radius - m + 1

    # The histogram of a part has at most 2**width values, whatever the number of rows.
    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for p, bits in enumerate(parts):
                v, c = np.unique(part_value(f, bits), return_counts=True)
                yield pa.RecordBatch.from_pydict({"p": np.full(len(v), p, np.int32), "v": v.astype(np.int32), "c": c.astype(np.int64)})

    found = prints.select("f0").mapInArrow(values, "p int, v int, c bigint").groupBy("p", "v").agg(F.sum("c").alias("c")).toArrow()
    p_of, v_of, c_of = (found.column(k).to_numpy() for k in ("p", "v", "c"))
    most_cubes = max(0, int(np.ceil(np.log2(max(1.0, n * 8 / task_rows)))))
    cost, choice = [], []
    for p, bits in enumerate(parts):
        mine = p_of == p
        pairs = candidate_counts(v_of[mine], c_of[mine], len(bits), max(total + m - 1, 0)) / 2
        most = min(len(bits), total + m - 1)
        # The number of sub-cubes that has the fewest rows sent, those for further tiles included.
        sent = [rows_sent(v_of[mine], c_of[mine], cube, most, task_rows) for cube in range(_cube(len(bits), most_cubes) + 1)]
        choice.append([int(np.argmin([s[t] for s in sent])) for t in range(most + 1)])
        cost.append([0.0] + [pairs[t] + ROW_COST * sent[choice[p][t]][t] + n * 4 * _ball(len(bits), t) for t in range(most + 1)])
    radii, blocks = allocate(cost, total), []
    cube_bits = tuple(choice[p][max(radius_p, 0)] for p, radius_p in enumerate(radii))
    for p, (radius_p, cube) in enumerate(zip(radii, cube_bits)):
        got = rows_got(v_of[p_of == p], c_of[p_of == p], cube, max(radius_p, 0))[-1]
        many = tiles(got, task_rows)
        blocks.append({int(c): int(many[c]) for c in np.flatnonzero(many > 1)})
    return Plan(parts, radii, cube_bits, tuple(blocks))


def rows_got(values: np.ndarray, counts: np.ndarray, cube: int, most: int) -> np.ndarray:
    """(radius, sub-cube): rows that each sub-cube gets, its own and visitors, at radius 0 .. ``most``."""
    at_home = np.bincount(values & ((1 << cube) - 1), weights=counts, minlength=1 << cube)
    every, got = np.arange(1 << cube), np.zeros((most + 1, 1 << cube))
    for mask in _masks(cube, most).astype(np.int64):
        got[int(mask).bit_count()] += at_home[every ^ mask] * visits(every ^ mask, every)
    return np.cumsum(got, axis=0)


def tiles(got: np.ndarray, task_rows: int) -> np.ndarray:
    """The blocks that a sub-cube of so many rows is dealt to; each row goes to as many tiles less one."""
    return np.where(got > 2 * task_rows, np.ceil(got / task_rows), 1)


def rows_sent(values: np.ndarray, counts: np.ndarray, cube: int, most: int, task_rows: int) -> np.ndarray:
    """All rows that are sent at radius 0 .. ``most``; infinite where counting them would take too long."""
    least = next((t for t in range(most + 1) if _ball(cube, t) << cube > 1 << 20), most + 1)
    out = np.full(most + 1, np.inf)
    if least:
        got = rows_got(values, counts, cube, least - 1)
        out[:least] = (got * np.maximum(tiles(got, task_rows) - 1, 1)).sum(axis=1)
    return out


def _masks(width: int, radius: int) -> np.ndarray:
    every = np.arange(1 << width, dtype=np.uint32)
    return every[np.bitwise_count(every) <= radius]


def send(prints: DataFrame, how: Plan) -> DataFrame:
    """Each fingerprint once for its sub-cube of every part, and once for each that it visits within the radius; to all tiles of its block."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        f0 = columns[1].view(np.uint64)
        lot = kernels.mix64(columns[0].view(np.uint64))
        out = []
        for p, (bits, radius, cube) in enumerate(zip(how.parts, how.radii, how.cube_bits)):
            if radius < 0:
                continue
            value = part_value(f0, bits)
            home = value & np.uint32((1 << cube) - 1)
            many = np.ones(1 << cube, np.int64)
            for c, n in how.blocks[p].items():
                many[c] = n
            for mask in _masks(cube, radius):
                to = (home ^ mask).astype(np.int64)
                goes = np.flatnonzero(visits(home, home ^ mask))
                n = np.maximum(many[to[goes]] - 1, 1)
                at = np.repeat(goes, n)
                block = (lot[at] % many[to[at]].astype(np.uint64)).astype(np.int64)
                # Every other block, with which a row meets its own block too.
                other = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                other += (other >= block) & (many[to[at]] > 1)
                tile = np.minimum(block, other) * many[to[at]] + np.maximum(block, other)
                out.append((at, np.full(len(at), p, np.int32), to[at].astype(np.int32), tile, np.full(len(at), mask == 0)))
        if not out:
            return None
        at, part, cube, tile, own = (np.concatenate(x) for x in zip(*out))
        return pa.RecordBatch.from_pydict({"part": part, "cube": cube, "tile": tile, "own": own} | {n: c[at] for n, c in zip(_FINGERPRINT, columns)})

    return map_batches(prints.select(*_FINGERPRINT), run, "part int, cube int, tile bigint, own boolean, key bigint, f0 bigint, f1 bigint, f2 bigint, f3 bigint")


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin .. begin + size - 1 of each range in turn."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def link(f: np.ndarray, own: np.ndarray, bits: tuple[int, ...], part_radius: int, radius: int, full_radius: int, most: int = 1 << 16) -> Forest:
    """A forest of the rows of ``f`` (rows, 4) that joins all pairs, one of them own, within ``part_radius`` in the part and near over all bits.

    Rows of equal value are all own or none is. They lie side by side, so candidates
    are read in runs, in pieces of ``most`` that stay in the processor's cache.
    """
    forest = Forest(len(f))

    def add(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        near = np.bitwise_count(f[i, 0] ^ f[j, 0]) <= radius
        at = np.flatnonzero(near)
        near[at] = np.bitwise_count(f[i[at]] ^ f[j[at]]).sum(axis=1, dtype=np.int32) <= full_radius
        forest.add(i[near], j[near])
        return near

    if len(f) <= CROWD:
        add(*np.triu_indices(len(f), 1))
        return forest
    value = part_value(f[:, 0], bits)
    _, slot, size = np.unique(value, return_inverse=True, return_counts=True)
    alive = np.flatnonzero(size[slot] > CROWD)
    for _ in range(LEADERS):
        if not len(alive):
            break
        _, head, own_value = np.unique(value[alive], return_index=True, return_inverse=True)
        leader = alive[head][own_value]
        near = add(leader, alive)
        alive = alive[~near]
    start = np.append(0, np.cumsum(np.bincount(value, minlength=1 << len(bits))))
    is_own = np.zeros(1 << len(bits), bool)
    is_own[value[own]] = True
    mine = np.flatnonzero(is_own).astype(np.uint32)

    def sort() -> None:
        """Rows by value and then by tree, so that in a value each tree is one run."""
        nonlocal order, first, root, named, crowded, many
        root = forest.root(np.arange(len(f)))
        order = np.lexsort((root, value))
        root, first = root[order], f[order, 0]
        named = (value[order].astype(np.uint64) << np.uint64(32)) | root.astype(np.uint64)
        # Rows of large trees, and how many of them stand before each place.
        crowded = np.bincount(root, minlength=1)[root] > CROWD
        many = np.append(0, np.cumsum(crowded))

    def compare(rows: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
        """Hold each row against ``size`` rows from ``begin`` on."""
        ends, a = np.cumsum(size), 0
        while a < len(rows):
            before = ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + most, side="right")))
            other = _ranges(begin[a:b], size[a:b])
            at = np.flatnonzero(np.bitwise_count(np.repeat(first[rows[a:b]], size[a:b]) ^ first[other]) <= radius)
            if len(at):
                add(order[rows[a + np.searchsorted(ends[a:b] - before, at, side="right")]], order[other[at]])
            a = b

    def compare_all(low: int, high: int, begin: int, end: int) -> None:
        """Hold the rows ``low`` .. ``high`` against ``begin`` .. ``end``."""
        step = max(1, most // (end - begin))
        for a in range(low, high, step):
            near = np.bitwise_count(first[a : min(a + step, high), None] ^ first[None, begin:end]) <= radius
            if near.any():
                i, j = np.nonzero(near)
                add(order[a + i], order[begin + j])

    order = first = root = named = crowded = many = None
    sort()
    for mask in _masks(len(bits), part_radius):
        other = mine ^ mask
        # Of two own values the lower one's rows meet the higher one's.
        meet = (start[other + 1] > start[other]) & ((mine <= other) | ~is_own[other])
        low, high, begin, end = start[mine[meet]], start[mine[meet] + 1], start[other[meet]], start[other[meet] + 1]
        # Large blocks at once, unless rows of large trees are there, whose own tree is passed over.
        large = ((high - low) * (end - begin) >= BLOCK) & (many[high] == many[low])
        for block in zip(low[large].tolist(), high[large].tolist(), begin[large].tolist(), end[large].tolist()):
            compare_all(*block)
        low, high, begin, end = low[~large], high[~large], begin[~large], end[~large]
        size = high - low
        rows, begin, end = _ranges(low, size), np.repeat(begin, size), np.repeat(end, size)
        if not mask:
            begin = rows + 1
        crowd = crowded[rows] & (end - begin > CROWD)
        wanted = (value[order[rows[crowd]]] ^ mask).astype(np.uint64) << np.uint64(32) | root[rows[crowd]].astype(np.uint64)
        left = np.clip(np.searchsorted(named, wanted), begin[crowd], end[crowd])
        right = np.clip(np.searchsorted(named, wanted, side="right"), begin[crowd], end[crowd])
        rest = np.flatnonzero(crowd)
        size = end - begin
        size[rest] = left - begin[rest]
        compare(np.concatenate((rows, rows[rest])), np.concatenate((begin, right)), np.concatenate((size, end[rest] - right)))
        if 8 * np.count_nonzero(forest.root(order) != root) >= len(f):
            sort()
    return forest


class Forest:
    """Union-find that keeps the edges that joined two trees."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        parent = self.parent
        while len(i):
            a, b = self.root(i), self.root(j)
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            high, low = np.maximum(a, b), np.minimum(a, b)
            # One joining edge for each root that stops being one.
            root, at = np.unique(high, return_index=True)
            parent[root] = low[at]
            self.edges.append((i[at], j[at]))

    def root(self, x: np.ndarray) -> np.ndarray:
        up = self.parent[x]
        while not np.array_equal(above := self.parent[up], up):
            up = above
        self.parent[x] = up
        return up


def near_edges(prints: DataFrame, how: Plan, radius: int = RADIUS, full_radius: int = FULL_RADIUS) -> DataFrame:
    """Edges ``u``, ``v`` between keys of near fingerprints, with the components of all near pairs."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        p = table.column("part")[0].as_py()
        f = np.stack([table.column(f"f{k}").to_numpy().view(np.uint64) for k in range(4)], axis=1)
        key, own = table.column("key").to_numpy(), table.column("own").to_numpy(zero_copy_only=False)
        forest = link(f, own, how.parts[p], how.radii[p], radius, full_radius)
        i, j = (np.concatenate(x) for x in zip(*forest.edges)) if forest.edges else (np.zeros(0, np.int64),) * 2
        return pa.table({"u": key[i], "v": key[j]})

    return send(prints, how).groupBy("part", "cube", "tile").applyInArrow(run, "u bigint, v bigint")


_FACES = ["f0", "f1", "f2", "f3"]


def near_groups(known: DataFrame, radius: int = RADIUS, full_radius: int = FULL_RADIUS, task_rows: int = TASK_ROWS) -> DataFrame:
    """``key``, ``head``: every key but the least of its group of near copies, with that least one.

    ``known`` has a BIGINT ``key`` without nulls that names a document, and ``f0`` .. ``f3``.
    """
    distinct = cut(known.groupBy(*_FACES).agg(F.min("key").alias("key")))
    edges = near_edges(distinct, plan(distinct, radius, task_rows), radius, full_radius)
    equal = known.join(distinct.withColumnRenamed("key", "least"), _FACES).where("key <> least").select(F.col("key").alias("u"), F.col("least").alias("v"))
    return connected_components(edges.union(equal)).select(F.col("u").alias("key"), F.col("v").alias("head"))


def near_copies(docs: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``duplicate_of``: each near copy, with the least ``doc_id`` of its group.

    Documents without a ``doc_id`` can't be named and are left out.
    """
    named = docs.where("doc_id is not null and length(text) > 0").select(F.col("doc_id").cast("bigint").alias("key"), "text")
    return near_groups(cut(fingerprints(named, "key")), **options).select(F.col("key").alias("doc_id"), F.col("head").alias("duplicate_of"))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near copies; columns as they came.

    The row of the least ``doc_id`` stays (nulls last); of rows that agree in
    ``doc_id`` and text, the one whose JSON comes first. Rows of null or empty
    text all stay.
    """
    key, key2 = free_names(docs, "row_key", "row_key2")
    one, two = row_keys()
    keyed = docs.withColumn(key, one).withColumn(key2, two)
    worded = F.length("text") > 0
    slim = docs.where(worded).select(one.alias("k1"), two.alias("k2"), F.col("doc_id").alias("id"), "text")
    rows = fingerprints(slim, "k1", also=["k2", "id"]).groupBy("key", "k2", "id", *_FACES).agg(F.count("*").alias("n"))
    # Numbers of their own, so that no two documents share one; fixed once they are in the shared folder.
    names = cut(rows.withColumnRenamed("key", "k1").withColumn("key", F.monotonically_increasing_id()))
    groups = cut(near_groups(names.select("key", *_FACES), **options))
    members = groups.union(groups.select("head", "head").distinct()).join(names.select("key", "k1", "k2", "id"), "key")
    stay = members.groupBy("head").agg(F.min_by("key", F.struct(F.col("id").isNull(), "id", "k1", "k2")).alias("stay"))
    lost = members.join(stay, "head").where("key <> stay").select(F.col("k1").alias(key), F.col("k2").alias(key2))
    left = keyed.join(lost, [key, key2], "left_anti")
    repeated = names.where("n > 1").select(F.col("k1").alias(key), F.col("k2").alias(key2))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not repeated.isEmpty():
        row = F.struct(*columns)
        again = left.where(worded).join(repeated, [key, key2], "left_semi").groupBy(key, key2).agg(F.min_by(row, F.to_json(row)).alias(key + "_row"))
        left = left.join(repeated, [key, key2], "left_anti").select(*columns).union(again.select(*(F.col(f"{key}_row.`{c}`") for c in docs.columns)))
    return left.select(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
