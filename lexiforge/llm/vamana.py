"""Approximate nearest neighbours on robust-pruned directed graphs.

Vectors are dealt into shards of bounded size, each of one narrow band of norms. In each shard a graph is built in two
passes: a greedy search from the medoid proposes neighbours for every vector, and robust pruning keeps those that no
kept neighbour is much closer to (by the relaxed factor alpha), so that edges point in diverse directions; edges back
are added and pruned alike. A query's beam search runs over every shard, and the shards' results are scored exactly
and merged.

Nearness is the inner product: one more coordinate gives all vectors of a shard the same norm, which turns it into
Euclidean distance. In a narrow band that coordinate is small, so queries, which lack it, don't lie far from the nodes.
Besides, every shard measures its own recall when it is built, on vectors of its own against all of the shard, and
stores the narrowest beam (96, twice that, and so on) that finds RECALL of the nearest; a shard where only all nodes
would do is scanned. Shards grow with the input up to a bound, so that a query meets fewer of them.

A shard's graph and the blocks of queries stream through one task: the graph is loaded once, the queries pass it. Equal
vectors are one node; their ids come back at the end, the smallest first, and never more than the result can hold.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without
an id; a repeated row counts once; vectors of other dimensions than the query's are no candidates; an empty input gives
no rows; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, power_for, written

DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA, BATCH, CANDIDATES, EXPAND = 32, 64, 96, 1.2, 256, 96, 4
#: Vectors of a shard: as many shards as SHARDS, until these are full.
SHARDS, LEAST_SHARD, MOST_SHARD = 64, 4096, 65536
QUERY_BLOCK = 128
#: A shard's beam finds this share of the nearest TRIAL_K for TRIALS vectors of its own.
RECALL, TRIALS, TRIAL_K = 0.97, 128, 21
#: Width of a band of norms, as a logarithm: there are fewer than 1,500 / BAND bands of finite numbers.
BAND = 0.03


def lifted(x: np.ndarray) -> np.ndarray:
    """x with a coordinate that makes all norms equal."""
    norm = np.einsum("ij,ij->i", x, x)
    return np.ascontiguousarray(np.c_[x, np.sqrt(np.maximum(norm.max(initial=0.0) - norm, 0.0))], np.float32)


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each query, the nearest nodes found (-1: none) in ascending distance; a whole batch goes step by step together."""
    n, q = len(x), len(queries)
    square = np.einsum("ij,ij->i", x, x)
    ids, dist = np.full((q, beam), -1, np.int64), np.full((q, beam), np.inf, np.float32)
    ids[:, 0], dist[:, 0] = start, square[start] - 2 * (queries @ x[start])
    open_ = ids >= 0
    seen = np.zeros((q, n + 1), bool)
    seen[:, start] = seen[:, n] = True
    while True:
        rank = np.where(open_, np.arange(beam), beam)
        pick = np.sort(rank, 1)[:, :EXPAND]
        live = np.flatnonzero(pick[:, 0] < beam)
        if not len(live):
            return ids, dist
        pick = pick[live]
        valid = pick < beam
        at = np.minimum(pick, beam - 1)
        node = np.where(valid, ids[live[:, None], at], -1)
        r, c = np.nonzero(valid)
        open_[live[r], at[r, c]] = False
        near = np.where(node[:, :, None] >= 0, graph[node], -1).reshape(len(live), -1)
        near = np.where(near >= 0, near, n)
        new = ~seen[live[:, None], near]
        # the same node may be reached twice in one step
        order = np.argsort(near, 1, kind="stable")
        ordered = np.take_along_axis(near, order, 1)
        twice = np.zeros_like(new)
        np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
        new &= ~twice
        seen[live[:, None], near] = True
        far = np.full(near.shape, np.inf, np.float32)
        r, c = np.nonzero(new)
        got = near[r, c]
        far[r, c] = square[got] - 2 * np.einsum("ij,ij->i", x[got], queries[live[r]])
        every, every_d = np.c_[ids[live], np.where(new, near, -1)], np.c_[dist[live], far]
        every_o = np.c_[open_[live], new]
        best = np.argsort(every_d, 1, kind="stable")[:, :beam]
        sub = np.arange(len(live))[:, None]
        ids[live], dist[live], open_[live] = every[sub, best], every_d[sub, best], every_o[sub, best]


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Of each point, at most degree of its candidates (-1: none): the nearest left, time and again, without those it makes needless."""
    c = np.sort(candidates, 1)
    c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
    c[c == points[:, None]] = -1
    own = x[points]
    d = np.einsum("ijk,ijk->ij", x[c] - own[:, None], x[c] - own[:, None])
    d[c < 0] = np.inf
    order = np.argsort(d, 1, kind="stable")[:, :CANDIDATES]
    c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
    v = x[c]
    s = np.einsum("ijk,ijk->ij", v, v)
    between = s[:, :, None] + s[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
    alive, out, rows = np.isfinite(d), np.full((len(points), degree), -1, np.int64), np.arange(len(points))
    for k in range(degree):
        first = np.argmax(alive, 1)
        ok = alive[rows, first]
        if not ok.any():
            break
        out[ok, k] = c[rows, first][ok]
        needless = alpha * alpha * between[rows, first] <= d
        alive &= ~(needless & ok[:, None])
        alive[rows, first] = False
    return out


def build(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, int]:
    """The graph (neighbours of each row of x, -1 for none) and the node where searches start."""
    n, rng = len(x), np.random.default_rng(seed)
    medoid = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    graph = np.full((n, DEGREE), -1, np.int64)
    if n < 2:
        return graph, medoid
    k = min(DEGREE // 2, n - 1)
    graph[:, :k] = (np.arange(n)[:, None] + rng.integers(1, n, (n, k))) % n
    for alpha in (1.0, ALPHA):
        for points in np.array_split(rng.permutation(n), -(-n // BATCH)):
            found, _ = beam_search(x, graph, medoid, x[points], min(BUILD_BEAM, max(n, 2)))
            graph[points] = robust_prune(x, points, np.c_[found, graph[points]], alpha, DEGREE)
            # edges back
            source, target = np.repeat(points, DEGREE), graph[points].ravel()
            source, target = source[target >= 0], target[target >= 0]
            order = np.argsort(target, kind="stable")
            source, target = source[order], target[order]
            to, first, number = np.unique(target, return_index=True, return_counts=True)
            width = int(number.max(initial=0))
            back = np.full((len(to), width), -1, np.int64)
            back[np.repeat(np.arange(len(to)), number), np.arange(len(target)) - np.repeat(first, number)] = source
            free = (graph[to] < 0).sum(1)
            both = np.c_[graph[to], back]
            fits = number <= free
            if fits.any():
                graph[to[fits]] = -np.sort(-both[fits], 1)[:, :DEGREE]
            for part in np.array_split(np.flatnonzero(~fits), max(1, -(-int((~fits).sum()) // BATCH))):
                if len(part):
                    graph[to[part]] = robust_prune(x, to[part], both[part], alpha, DEGREE)
    return graph, medoid


def proper(column: str):
    """Whether a vector takes part."""
    c = F.col(column)
    finite = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(c, lambda v: v != 0)


def wide_enough(x: np.ndarray, graph: np.ndarray, start: int, least: int = SEARCH_BEAM, seed: int = 11) -> int:
    """The narrowest beam that finds RECALL of the largest inner products for vectors of x; at most all of them."""
    up, n = lifted(x), len(x)
    own = np.random.default_rng(seed).choice(n, min(TRIALS, n), replace=False)
    k = min(TRIAL_K, n)
    true = np.argpartition(-(x[own].astype(np.float64) @ x.T.astype(np.float64)), k - 1, 1)[:, :k]
    beam = least
    while beam < n:
        found, _ = beam_search(up, graph, start, np.c_[x[own], np.zeros(len(own), np.float32)], beam)
        if (found[:, :, None] == true[:, None]).any(1).mean() >= RECALL:
            return beam
        beam *= 2
    return n


INDEX = "dim int, shard int, start int, beam int, reps binary, vectors binary, graph binary"


def build_index(nodes: DataFrame, shard_size: int | None = None) -> DataFrame:
    """A row for each shard of nodes (rep, embedding), written: ids, vectors, graph, start and beam."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double")))
    rows = nodes.withColumns({"dim": F.size("embedding"), "band": F.floor(F.log(norm) / BAND + 0.5).cast("int")})
    found = sorted(map(tuple, rows.groupBy("dim", "band").count().collect()))
    size = shard_size or power_for(sum(n for _, _, n in found), SHARDS, LEAST_SHARD, MOST_SHARD)
    shards, bands = 0, []
    for dim, band, n in found:
        bands.append((dim, band, shards, -(-n // size)))
        shards += -(-n // size)
    bands = nodes.sparkSession.createDataFrame(bands, "dim int, band int, first int, parts int")

    def make(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep")
        x = np.stack(frame["embedding"].to_numpy()).astype(np.float32)
        graph, start = build(lifted(x))
        beam = wide_enough(x, graph, start)
        return pd.DataFrame([{"dim": key[0], "shard": key[1], "start": start, "beam": beam, "reps": frame["rep"].to_numpy(np.int64).tobytes(), "vectors": x.tobytes(), "graph": graph.astype(np.int32).tobytes()}])

    rows = rows.join(F.broadcast(bands), ["dim", "band"]).withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts"))).cast("int")).drop("band", "first", "parts")
    # A fixed number of partitions: adaptive execution must not put many shards, small as their rows are, into one task.
    dealt = rows.repartition(partitions_for(nodes.sparkSession, 2 * shards, 1), "dim", "shard")
    return written(dealt.groupBy("dim", "shard").applyInPandas(make, INDEX), "vamana")


FOUND = pa.schema([("query_id", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])


def search_index(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rep, score: the k nearest nodes of every shard that beam search finds for each of queries (query_id, embedding)."""
    n, shards = queries.count(), index.count()
    blocks = queries.withColumns({"dim": F.size("embedding"), "part": F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n // QUERY_BLOCK)))).cast("int")})
    blocks = blocks.groupBy("dim", "part").agg(F.collect_list(F.struct("query_id", "embedding")).alias("asked"))
    blocks = written(blocks.select("dim", "part", "asked.query_id", F.flatten("asked.embedding").alias("vectors")), "query-blocks")
    # A row a shard: as many as full shards and bands, so it is small.
    asked = blocks.join(F.broadcast(index.select("dim", "shard")), "dim").select("dim", "shard", "part", "query_id", F.col("vectors").alias("asked"))
    both = index.withColumn("part", F.lit(-1)).unionByName(asked, allowMissingColumns=True)
    both = both.repartition(partitions_for(index.sparkSession, 2 * shards, 1), "dim", "shard").sortWithinPartitions("dim", "shard", "part")
    columns = ["dim", "shard", "part", "start", "beam", "reps", "vectors", "graph", "query_id", "asked"]

    def ask(batches):
        here, graph, reps, x, up, start, beam = None, None, None, None, None, 0, 0
        for b in batches:
            for i in range(b.num_rows):
                dim, shard, part = (b.column(c)[i].as_py() for c in range(3))
                if part < 0:
                    here, start, beam = (dim, shard), b.column(3)[i].as_py(), b.column(4)[i].as_py()
                    x = np.frombuffer(b.column(6)[i].as_py(), np.float32).reshape(-1, dim)
                    reps, graph = np.frombuffer(b.column(5)[i].as_py(), np.int64), np.frombuffer(b.column(7)[i].as_py(), np.int32).reshape(len(x), -1).astype(np.int64)
                    up = lifted(x)
                elif here == (dim, shard):
                    asked_by = b.column(8)[i].values.to_numpy()
                    q = b.column(9)[i].values.to_numpy().reshape(-1, dim).astype(np.float64)
                    if max(beam, k) >= len(x):
                        ids = np.broadcast_to(np.arange(len(x)), (len(q), len(x)))
                    else:
                        ids, _ = beam_search(up, graph, start, np.c_[q, np.zeros(len(q))].astype(np.float32), max(beam, k))
                    # the beam holds k and more; exact products decide
                    score = q @ x.T.astype(np.float64) if ids.shape[1] == len(x) else np.where(ids >= 0, np.einsum("ijk,ik->ij", x[ids].astype(np.float64), q), -np.inf)
                    rep = np.where(ids >= 0, reps[ids], np.iinfo(np.int64).max)
                    best = np.lexsort((rep, -score), axis=1)[:, :k]
                    r, c = np.nonzero(np.take_along_axis(ids, best, 1) >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(asked_by[r]), pa.array(np.take_along_axis(rep, best, 1)[r, c]), pa.array(np.take_along_axis(score, best, 1)[r, c])], schema=FOUND)

    return both.select(*columns).mapInArrow(ask, "query_id long, rep long, score double")


def nearest(embeddings: DataFrame, every: int = 20, k: int = 20, shard_size: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found for each row whose vec_id is divisible by every."""
    rows = embeddings.filter(F.col("vec_id").isNotNull() & proper("embedding")).select("vec_id", "embedding").distinct()
    # Equal vectors are one node; no result has room for more than k + 1 of its ids.
    order = Window.partitionBy("embedding").orderBy("vec_id")
    ranked = written(rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).withColumn("rep", F.min("vec_id").over(Window.partitionBy("embedding"))), "vectors")
    nodes = ranked.filter("n = 1").select(F.col("vec_id").alias("rep"), "embedding")
    index = build_index(nodes, shard_size)
    queries = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    found = search_index(index, queries, k + 1)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rep")
    top = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    out = top.join(ranked.select("rep", "vec_id"), "rep").filter("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
