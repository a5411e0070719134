"""Approximate nearest neighbours by stable projections and kd-trees.

Projecting on Gaussian vectors keeps distances in distribution: the squared projected distance of two points over
their squared distance follows a chi-square law with one degree of freedom per projection. A kd-tree over the few
projected dimensions yields candidates by growing projected distance; their true distances are computed; the
search may stop when a point nearer than the k-th found would, with the asked probability, have shown up before.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keep

#: Projections (an even number), and the probability with which a nearer point would have shown up before the stop.
PROJECTIONS, CERTAINTY = 8, 0.95
#: Points of a leaf of a block's tree, and rows which a block of points or of queries should hold.
LEAF, BLOCK_ROWS, QUERY_ROWS = 128, 4_096, 4_096
#: Pairs whose products are added up at a time.
PAIRS = 16_384
#: Rows of the sample that fixes the cells of the upper tree (the documented bound).
SAMPLE_ROWS = 4_000


def chi_square_cdf(x: np.ndarray, degrees: int) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half, term, total = np.minimum(x, 1e4) / 2, 1.0, 1.0
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def reach(certainty: float, degrees: int) -> float:
    """The value at which the distribution function comes to ``certainty``."""
    lo, hi = 0.0, 1e3
    while hi - lo > 1e-9:
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(np.array(mid), degrees) < certainty else (lo, mid)
    return hi


def planes(points: np.ndarray, leaf: int) -> list[tuple[int, float, int, int]]:
    """A kd-tree as (axis, value, left, right); -1 - n stands for cell n. Equal points stay in one cell."""
    nodes: list[tuple[int, float, int, int]] = []
    cells = 0

    def split(rows: np.ndarray) -> int:
        nonlocal cells
        spread = np.ptp(points[rows], axis=0) if len(rows) else np.zeros(points.shape[1])
        if len(rows) <= leaf or spread.max() == 0:
            cells += 1
            return -cells
        axis = int(spread.argmax())
        values = points[rows, axis]
        value = float(np.median(values))
        low = values < value
        if not low.any():
            value = float(values[values > value].min())
            low = values < value
        at = len(nodes)
        nodes.append((axis, value, 0, 0))
        left, right = split(rows[low]), split(rows[~low])
        nodes[at] = axis, value, left, right
        return at

    split(np.arange(len(points)))
    return nodes


def cell_of(nodes: list[tuple[int, float, int, int]], points: np.ndarray) -> np.ndarray:
    """Cell of each point."""
    out = np.zeros(len(points), np.int64)
    todo = [(0 if nodes else -1, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        if node < 0:
            out[rows] = -1 - node
            continue
        axis, value, left, right = nodes[node]
        low = points[rows, axis] < value
        todo += [(left, rows[low]), (right, rows[~low])]
    return out


def bounds(nodes: list[tuple[int, float, int, int]], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corner of every cell, infinite outside."""
    corners: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    todo = [(0 if nodes else -1, np.full(dims, -np.inf), np.full(dims, np.inf))]
    while todo:
        node, lo, hi = todo.pop()
        if node < 0:
            corners[-1 - node] = lo, hi
            continue
        axis, value, left, right = nodes[node]
        cut_hi, cut_lo = hi.copy(), lo.copy()
        cut_hi[axis] = cut_lo[axis] = value
        todo += [(left, lo, cut_hi), (right, cut_lo, hi)]
    return (np.array([corners[i][0] for i in range(len(corners))]),
            np.array([corners[i][1] for i in range(len(corners))]))


def box_distance(points: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Squared distance of every point to every box."""
    total = np.zeros((len(points), len(lo)))
    for d in range(points.shape[1]):
        x = points[:, d, None]
        total += np.maximum(np.maximum(lo[None, :, d] - x, x - hi[None, :, d]), 0) ** 2
    return total


class Space:
    """Projection of vectors, extended by one coordinate so that the largest product is the nearest point."""

    def __init__(self, dims: int, norm: float, projections: int, seed: int):
        self.norm2 = norm * norm
        self.matrix = np.random.default_rng(seed).normal(size=(dims + 1, projections))

    def points(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0))
        return x @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.matrix[:-1]


def exact_where(q: np.ndarray, x: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Products of all pairs that can reach ``least``, -inf for the others.

    A matrix product sorts out the others; what stays is added up in one fixed order, so equal vectors tie exactly.
    """
    rough = q @ x.T
    slack = 1e-9 * np.maximum(1.0, np.abs(rough))
    i, j = np.nonzero(rough >= least[:, None] - slack)
    out = np.full(rough.shape, -np.inf)
    for at in range(0, len(i), PAIRS):
        a, b = i[at:at + PAIRS], j[at:at + PAIRS]
        out[a, b] = (q[a] * x[b]).sum(axis=1)
    return out


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, space: Space, k: int,
                 floor: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, point row, product) of each query's best k in a block, itself left out.

    ``floor``: the k-th product that the query has already, or -inf. Leaves come by growing projected distance; a
    query stops when the next leaf fails the chi-square test against its k-th distance so far.
    """
    p, pq = space.points(x), space.queries(q)
    nodes = planes(p, LEAF)
    cell = cell_of(nodes, p)
    order = np.argsort(cell, kind="stable")
    starts = np.searchsorted(cell[order], np.arange(cell.max() + 2))
    lo = np.array([p[order[a:b]].min(axis=0) for a, b in zip(starts, starts[1:])])
    hi = np.array([p[order[a:b]].max(axis=0) for a, b in zip(starts, starts[1:])])
    gap = box_distance(pq, lo, hi)
    ranked = np.argsort(gap, axis=1)
    q2 = (q * q).sum(axis=1)
    best = np.full((len(q), k), -np.inf)
    rows = np.full((len(q), k), -1)
    active = np.arange(len(q))
    for step in range(len(lo)):
        kth = np.maximum(best[active, k - 1], floor[active])
        distance2 = q2[active] + space.norm2 - 2 * kth
        leaf = ranked[active, step]
        active = active[gap[active, leaf] <= limit * np.maximum(distance2, 0)]
        if not len(active):
            break
        leaf = ranked[active, step]
        by_leaf = np.argsort(leaf, kind="stable")
        cuts = np.flatnonzero(np.diff(leaf[by_leaf])) + 1
        for some in np.split(by_leaf, cuts):
            who = active[some]
            n = leaf[some[0]]
            members = order[starts[n]:starts[n + 1]]
            got = exact_where(q[who], x[members], np.maximum(best[who, k - 1], floor[who]))
            got[q_ids[who, None] == ids[None, members]] = -np.inf
            both = np.concatenate([best[who], got], axis=1)
            both_rows = np.concatenate([rows[who], np.broadcast_to(members, got.shape)], axis=1)
            both_ids = np.where(both_rows < 0, np.iinfo(np.int64).max, ids[both_rows])
            top = np.lexsort((both_ids, -both), axis=1)[:, :k]
            best[who], rows[who] = np.take_along_axis(both, top, 1), np.take_along_axis(both_rows, top, 1)
    i, j = np.nonzero(best > -np.inf)
    return i, rows[i, j], best[i, j]


def _vectors(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten(), np.float64).reshape(-1, dims)


def nearest(df: DataFrame, key: str, vector: str, k: int = 20, every: int = 20, seed: int = 11,
            projections: int = PROJECTIONS, certainty: float = CERTAINTY) -> DataFrame:
    """The k rows with the largest inner product for each row whose key is divisible by ``every``, itself left out.

    An upper kd-tree over a bounded sample of projected points names cells; every row belongs to one. Large cells are
    dealt into blocks by digest, so copies of one vector spread. Each query first searches one block of its own cell; its
    k-th distance found there tells by the chi-square test which cells it must still visit. Queries are dealt into
    blocks too. Results of all blocks meet per query, k of each block at most.

    Rows with a null key, and vectors that are null, empty, zero, of another length than the most common one, or hold null
    or non-finite components take no part; ties go to the smaller key; a repeated key is a point for each of its
    vectors and a query for each distinct vector, never its own neighbour; without rows there are no results; further
    columns are ignored. Keys are integers.
    """
    raw = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    good = raw.filter("id is not null and v is not null and size(v) > 0").filter(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = good.groupBy(F.size("v").alias("n")).agg(
        F.count("*").alias("rows"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2"))
    most = sizes.orderBy(F.desc("rows"), "n").limit(1).collect()
    out_type = "query_id long, vec_id long, score double"
    if not most:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, total = most[0]["n"], most[0]["rows"]
    space = Space(dims, math.sqrt(most[0]["norm2"]), projections, seed)
    good = good.filter(F.size("v") == dims)
    limit = reach(certainty, projections)

    share = min(1.0, 4.0 * SAMPLE_ROWS / total)
    picked = good.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("id", "v").orderBy(
        F.xxhash64("id"), "id").limit(SAMPLE_ROWS).toArrow()
    sample = space.points(_vectors(picked.column("v"), dims))
    wanted = max(1, math.ceil(total / BLOCK_ROWS))
    upper = planes(sample, max(1, math.ceil(len(sample) / wanted))) if len(sample) else []
    low, high = bounds(upper, projections)

    def place(batches):
        for b in batches:
            x = _vectors(b.column(1), dims)
            at = cell_of(upper, space.points(x))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at)], names=["id", "v", "cell"])

    placed = keep(good.mapInArrow(place, "id long, v array<double>, cell long"), "projected-points")
    counts = {r["cell"]: -(-r["count"] // BLOCK_ROWS) for r in placed.groupBy("cell").count().collect()}
    first = np.cumsum([0, *(counts.get(c, 0) for c in range(len(low)))])
    offsets = F.create_map(*[F.lit(int(v)) for c in counts for v in (c, first[c])])
    parts = F.create_map(*[F.lit(int(v)) for c in counts for v in (c, counts[c])])
    points = placed.select("id", "v", "cell", (offsets[F.col("cell")] + F.pmod(
        F.xxhash64("id", F.lit(3)), parts[F.col("cell")])).alias("block"))
    asked = placed.filter(F.pmod("id", F.lit(every)) == 0).dropDuplicates(["id", "v"]).select(
        "id", "v", "cell", F.xxhash64("v").alias("q"), F.lit(float("-inf")).alias("floor"))
    slices = max(1, math.ceil(asked.count() / QUERY_ROWS))
    asked = asked.withColumn("slice", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(slices)).cast("long"))

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (
                ("query_id", pa.int64()), ("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        q_ids, ids = queries["id"].to_numpy(), candidates["id"].to_numpy()
        i, j, s = search_block(q_ids, _vectors(queries["v"], dims), ids, _vectors(candidates["v"], dims), space, k,
                               queries["floor"].to_numpy(), limit)
        return pa.table({"query_id": q_ids[i], "q": queries["q"].to_numpy()[i], "vec_id": ids[j], "score": s})

    def run(queries: DataFrame) -> DataFrame:
        """Blocks of points are copied once per slice of queries."""
        copies = points.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>")))
        return queries.groupBy("block", "slice").cogroup(copies.groupBy("block", "slice")).applyInArrow(
            search, out_type.replace("vec_id", "q long, vec_id", 1))

    own = keep(run(asked.withColumn("block", offsets[F.col("cell")].cast("long") + F.pmod(
        F.xxhash64("id", F.lit(3)), parts[F.col("cell")]))), "own-cell")
    kth = own.groupBy("query_id", "q").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    known = asked.join(kth, (F.col("id") == F.col("query_id")) & (asked["q"] == kth["q"]), "left").select(
        "id", "v", "cell", asked["q"], "slice", F.when(F.col("n") >= k, F.col("kth")).otherwise(
            float("-inf")).alias("floor"))

    def visits(batches):
        blocks_of = {c: np.arange(first[c], first[c + 1]) for c in range(len(low))}
        for b in batches:
            q = _vectors(b.column(1), dims)
            floor = b.column(5).to_numpy()
            distance2 = np.maximum((q * q).sum(axis=1) + space.norm2 - 2 * floor, 0)
            near = box_distance(space.queries(q), low, high) <= limit * distance2[:, None]
            lists = [np.concatenate([blocks_of[c] for c in np.flatnonzero(row)] or [np.empty(0, np.int64)]) for row in near]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(lists, pa.list_(pa.int64()))], names=["id", "v", "cell", "q", "slice", "floor", "blocks"])

    rest = known.mapInArrow(visits, "id long, v array<double>, cell long, q long, slice long, floor double, blocks array<long>")
    mine = offsets[F.col("cell")].cast("long") + F.pmod(F.xxhash64("id", F.lit(3)), parts[F.col("cell")])
    rest = rest.select("id", "v", "cell", "q", "slice", "floor", F.explode("blocks").alias("block")).filter(
        F.col("block") != mine)
    found = own.unionByName(run(rest))
    best = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
