"""Approximate nearest neighbours: robust-pruned directed graphs, one a shard, searched by beams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged

#: Vectors of a shard, queries of a block and those searched at once, edges of a node and those it may hold while a graph grows, beam and relaxation of the graph.
SHARD, BLOCK, AT_ONCE, DEGREE, SLACK, BUILD_BEAM, ALPHA = 32768, 65536, 512, 32, 24, 64, 1.2
#: The narrowest beam of a search; it doubles until it finds this share of the true first ones of so many sample queries in the shard.
BEAM, RECALL, SAMPLE = 64, 0.97, 256


def _gaps(x: np.ndarray, p: np.ndarray, inner: bool) -> np.ndarray:
    """How far x and p are, row by row: squared distances or, if inner, inner products with the other sign."""
    return -np.einsum("nd,nd->n", p, x) if inner else np.einsum("nd,nd->n", p - x, p - x)


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, x: np.ndarray, beam: int, inner: bool = False, opened: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For each x the beam nearest nodes that a greedy search from entry meets: ids (-1: none) and how far (see _gaps), near to far.

    All searches go on in step: each opens its few nearest nodes not opened yet and merges into its beam those of their neighbours
    that it has not met before, as a bitmap tells.
    """
    n, opened = len(x), min(opened, beam)
    ids = np.full((n, beam), -1, np.int32)
    far = np.full((n, beam), np.inf, np.float32)
    done = np.ones((n, beam), bool)
    met = np.zeros((n, len(points)), bool)
    ids[:, 0], far[:, 0], done[:, 0], met[:, entry] = entry, _gaps(x, points[np.full(n, entry)], inner), False, True
    active = np.arange(n)
    while len(active):
        i, d, o = ids[active], far[active], done[active]
        rows = np.arange(len(active))[:, None]
        cost = np.where(o, np.inf, d)
        pick = np.argpartition(cost, opened - 1, axis=1)[:, :opened]
        next_ = np.where(o[rows, pick][:, :, None], -1, graph[i[rows, pick]]).reshape(len(active), -1)
        o[rows, pick] = True
        r, c = np.nonzero(next_ >= 0)
        key = np.unique(active[r] * np.int64(len(points)) + next_[r, c])
        key = key[~met.ravel()[key]]
        met.ravel()[key] = True
        r, node = np.searchsorted(active, key // len(points)), key % len(points)
        at = np.arange(len(r)) - np.searchsorted(r, np.arange(len(active)))[r]
        if len(r):
            new, gap = np.full((len(active), at.max() + 1), -1, np.int32), np.full((len(active), at.max() + 1), np.inf, np.float32)
            new[r, at], gap[r, at] = node, _gaps(x[active[r]], points[node], inner)
            i, d, o = np.hstack([i, new]), np.hstack([d, gap]), np.hstack([o, new < 0])
            near = np.argpartition(d, beam - 1, axis=1)[:, :beam]
            i, d, o = (np.take_along_axis(z, near, 1) for z in (i, d, o))
        ids[active], far[active], done[active] = i, d, o
        active = active[(~o).any(axis=1)]
    order = far.argsort(axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)


def robust_prune(points: np.ndarray, nodes: np.ndarray, found: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each node's candidates (a row of found, -1: none) the nearest, then those not alpha times nearer to one already kept than to the node."""
    p = points[found]
    d = ((p - points[nodes][:, None]) ** 2).sum(axis=2)
    d[(found < 0) | (found == nodes[:, None])] = np.inf
    square = (p ** 2).sum(axis=2)
    among = square[:, :, None] + square[:, None] - 2 * (p @ p.transpose(0, 2, 1))
    left, kept, rows = d.copy(), np.full((len(nodes), degree), -1, np.int32), np.arange(len(nodes))
    for k in range(degree):
        pick = left.argmin(axis=1)
        fine = np.isfinite(left[rows, pick])
        if not fine.any():
            break
        kept[fine, k] = found[rows, pick][fine]
        left[(alpha * alpha * among[rows, pick] <= d) & fine[:, None]] = np.inf
        left[rows, pick] = np.inf
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 7) -> tuple[np.ndarray, int]:
    """The graph (n x degree node numbers, -1: none) over points and its entry, the point nearest to their mean.

    Points are put in by batches, each at most twice the one before: a greedy search of the graph so far proposes
    neighbours, pruning keeps diverse ones. A node gathers SLACK edges back beyond degree before they are pruned, and is pruned to degree at the end.
    """
    n = len(points)
    graph = np.full((n, degree + SLACK), -1, np.int32)
    filled = np.zeros(n, np.int64)
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])

    def prune(nodes: np.ndarray, found: np.ndarray) -> None:
        size = (found >= 0).sum(axis=1)
        by = np.argsort(size, kind="stable")
        nodes, found, size = nodes[by], -np.sort(-found[by], axis=1), size[by]
        a = 0
        while a < len(nodes):  # rows of like sizes together, so that a hub widens no others
            b = a + max(1, min(512, (1 << 22) // max(1, int(size[min(a + 511, len(nodes) - 1)])) ** 2))
            kept = robust_prune(points, nodes[a:b], found[a:b, :max(1, int(size[a:b].max()))], degree, alpha)
            graph[nodes[a:b]] = -1
            graph[nodes[a:b], :degree] = kept
            filled[nodes[a:b]] = (kept >= 0).sum(axis=1)
            a = b

    at = 1
    while at < n:
        batch = order[at:min(n, at + max(16, min(at, 1024)))]
        if at < 128:  # while few are in, they are candidates themselves
            prune(batch, np.tile(order[:at + len(batch)], (len(batch), 1)).astype(np.int32))
        else:
            prune(batch, np.concatenate([beam_search(points, graph, entry, points[batch[a:a + AT_ONCE]], beam)[0] for a in range(0, len(batch), AT_ONCE)]))
        r, c = np.nonzero(graph[batch] >= 0)
        to, back = graph[batch][r, c], batch[r]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count)
        fits = filled[nodes] + count <= degree + SLACK
        f = np.repeat(fits, count)
        graph[to[f], filled[to[f]] + place[f]] = back[f]
        filled[nodes[fits]] += count[fits]
        if not fits.all():
            full, some = nodes[~fits], count[~fits]
            new = np.full((len(full), int(some.max())), -1, np.int32)
            new[np.repeat(np.arange(len(full)), some), place[~f]] = back[~f]
            prune(full, np.hstack([graph[full], new]))
        at += len(batch)
    over = np.flatnonzero(filled > degree)
    prune(over, graph[over])
    return graph[:, :degree], entry


def usable(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, embedding) without those that are null, empty, zero or hold a null or non-finite component."""
    e = F.col("embedding")
    fine = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _unit(v: np.ndarray) -> np.ndarray:
    """Directions; the largest component is made one first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v ** 2).sum(axis=1, keepdims=True))


def nearest(points: np.ndarray, graph: np.ndarray, entry: int, x: np.ndarray, beam: int) -> np.ndarray:
    """For each query of x the nodes (-1: none) of large inner product that a beam over the graph meets, large to small; all, if no more than the beam holds."""
    if len(points) <= beam:
        return np.tile(np.arange(len(points)), (len(x), 1))
    scaled = (points / np.abs(points).max()).astype(np.float32)
    x = _unit(x).astype(np.float32)
    return np.concatenate([beam_search(scaled, graph, entry, x[a:a + AT_ONCE], beam, inner=True)[0] for a in range(0, len(x), AT_ONCE)])


def fitting_beam(points: np.ndarray, graph: np.ndarray, entry: int, k: int, recall: float = RECALL, sample: int = SAMPLE, seed: int = 3) -> int:
    """The narrowest of the beams BEAM, 2 BEAM, 4 BEAM, ... that finds this share of the k largest inner products of sample queries, which are points
    themselves; in the end it holds all points."""
    x = points[np.random.default_rng(seed).permutation(len(points))[:sample]]
    scaled, u = points / np.abs(points).max(), _unit(x)
    k, beam = min(k, len(points)), max(BEAM, k)
    least = np.empty(len(x))
    for a in range(0, len(x), 64):
        least[a:a + 64] = np.partition(u[a:a + 64] @ scaled.T, len(points) - k, axis=1)[:, len(points) - k]
    while beam < len(points):
        ids = nearest(points, graph, entry, x, beam)[:, :k]
        hit = (np.einsum("qkd,qd->qk", scaled[ids], u) >= least[:, None] - 1e-9) & (ids >= 0)
        if hit.mean() >= recall:
            break
        beam *= 2
    return beam


def build_index(distinct: DataFrame, count: int, k: int, shard: int = SHARD) -> DataFrame:
    """distinct (embedding, members) -> the same with dim, shard, pos, entry, beam and edges (positions in the shard): one row for every vector.

    The graph is one of directions: it stays as easy to walk where norms differ widely. Vectors of different lengths have graphs of their own. Each shard measures the beam it needs.
    """
    shards = max(1, -(-count // shard))
    dealt = distinct.withColumn("dim", F.size("embedding")).withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        v = _matrix(table.column("embedding"))
        graph, entry = build_graph(_unit(v).astype(np.float32))
        out = table.append_column("pos", pa.array(np.arange(len(v), dtype=np.int32)))
        for name, value in (("entry", entry), ("beam", fitting_beam(v, graph, entry, k))):
            out = out.append_column(name, pa.array(np.full(len(v), value, np.int32)))
        edges = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * graph.shape[1]), pa.array(graph.ravel(), pa.int32()))
        return out.append_column("edges", edges)

    return dealt.groupBy("dim", "shard").applyInArrow(build, "embedding array<double>, members array<long>, dim int, shard int, pos int, entry int, beam int, edges array<int>")


def search(vectors: DataFrame, every: int = 20, k: int = 20, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every` the k
    rows of largest inner product that beams over all shards find, its own row left out; ties to the smaller vec_id.

    Equal vectors are one node with its k + 1 smallest vec_ids (no more can be among the first k), and equal queries one
    query, so copies cost one search. Every shard's graph is built once and kept; blocks of queries are
    sent to each, whose searches take the beam that the shard has measured (see fitting_beam). Vectors that are null, empty, zero or hold null or non-finite components take no part; those of another length than a query's
    are no candidates of it. No vectors: no rows; other columns are not read.
    """
    fit = staged(usable(vectors), "ann_vectors")
    first = W.partitionBy("embedding").orderBy("vec_id")
    distinct = (fit.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).groupBy("embedding")
                .agg(F.array_sort(F.collect_list("vec_id")).alias("members")))
    distinct = staged(distinct, "ann_distinct")
    count = distinct.count()
    index = staged(build_index(distinct, count, k + 1, shard), "ann_index")

    asked = fit.where(F.pmod("vec_id", F.lit(every)) == 0)
    queries = staged(asked.select("embedding").distinct().withColumn("q", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "ann_queries")
    n_blocks = max(1, -(-queries.count() // block))
    shards = max(1, -(-count // shard))
    blocked = queries.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(n_blocks)).cast("int"))
    sent = blocked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    hit = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def find(table: pa.Table, asks: pa.Table) -> pa.Table:
        if not len(table) or not len(asks):
            return hit.empty_table()
        table = table.take(np.argsort(table.column("pos").to_numpy()))
        v, x = _matrix(table.column("embedding")), _matrix(asks.column("embedding"))
        graph = _matrix(table.column("edges")).astype(np.int32)
        entry, beam = table.column("entry")[0].as_py(), table.column("beam")[0].as_py()
        members = table.column("members").to_pylist()
        at, vec, score = [], [], []
        step = max(1, (1 << 23) // max(1, min(beam, len(v)) * v.shape[1]))
        for a in range(0, len(x), step):
            ids = nearest(v, graph, entry, x[a:a + step], beam)
            s = np.where(ids < 0, -np.inf, (v[ids] * x[a:a + step, None]).sum(axis=2))
            least = np.partition(s, max(0, s.shape[1] - k - 1), axis=1)[:, max(0, s.shape[1] - k - 1)]
            for i, (found, own, low) in enumerate(zip(ids, s, least, strict=True)):
                good = np.flatnonzero((own >= low) & (found >= 0))
                some = sorted((-y, m) for f, y in zip(found[good].tolist(), own[good].tolist(), strict=True) for m in members[f])[:k + 1]
                at += [a + i] * len(some)
                vec += [m for _, m in some]
                score += [-y for y, _ in some]
        return pa.table([asks.column("q").take(pa.array(at, pa.int64())), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], schema=hit)

    found = copies.groupBy("dim", "shard", "block").cogroup(sent.groupBy("dim", "shard", "block")).applyInArrow(find, "q long, vec_id long, score double")
    best = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    out = asked.select(F.col("vec_id").alias("query_id"), "embedding").join(queries.select("embedding", "q"), "embedding").join(top, "q").where(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("n"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
