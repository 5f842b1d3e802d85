"""Approximate nearest neighbours by largest inner product: robust-pruned directed graphs, one for each shard.

Distinct vectors are dealt to shards by hash. A shard's graph is built in rounds: a batch of points searches the graph
so far, what it visits are its candidates, relaxed distance pruning (ALPHA) keeps up to DEGREE diverse ones, and edges
are added both ways. Inner products become distances by one more component that gives all vectors the same length.
Every query block is searched in every shard by beam search, and the best found are merged with exact scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import cut

SHARD, DEGREE, ALPHA, BUILD_BEAM, BEAM, EXPAND = 10_000, 32, 1.2, 64, 128, 4
#: Queries that meet a shard at once: about as many bytes as the shard's graph, so neither side's copies dominate.
QUERY_BLOCK, BATCH = 16_384, 256
NEAREST = 20


def greedy(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the beam's points, nearest first (-1: none), and all points it opened (-1: none)."""
    n, opened = len(q), []
    ids, dist, done = np.full((n, beam), -1), np.full((n, beam), np.inf, np.float32), np.ones((n, beam), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = start, -(q @ x[start]), False
    seen = np.zeros((n, len(x)), bool)
    seen[:, start] = True
    while True:
        rows = np.flatnonzero(~done.all(axis=1))
        if not len(rows):
            break
        first = np.argsort(done[rows], axis=1, kind="stable")[:, :EXPAND]
        pick = np.where(np.take_along_axis(done[rows], first, 1), -1, np.take_along_axis(ids[rows], first, 1))
        done[rows[:, None], first] = True
        record = np.full((n, EXPAND), -1)
        record[rows] = pick
        opened.append(record)
        near = np.where(pick[:, :, None] >= 0, edges[pick], -1).reshape(len(rows), -1)
        near.sort(axis=1)
        good = near >= 0
        good[:, 1:] &= near[:, 1:] != near[:, :-1]
        good &= ~seen[rows[:, None], near]
        r, c = np.nonzero(good)
        seen[rows[r], near[r, c]] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[r, c] = -np.einsum("ij,ij->i", x[near[r, c]], q[rows[r]])
        all_d = np.concatenate([dist[rows], d], axis=1)
        best = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[rows] = np.take_along_axis(all_d, best, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(good, near, -1)], axis=1), best, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], ~good], axis=1), best, 1)
    return ids, np.concatenate(opened, axis=1)


def prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Up to DEGREE candidates (-1: none) of each point: the nearest stays, and those nearer to it, by ALPHA, go."""
    own = np.where(candidates == points[:, None], -1, candidates)
    vectors = x[own]
    d = np.where(own >= 0, ((vectors - x[points][:, None]) ** 2).sum(axis=2), np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :BEAM]
    own, d, vectors = np.take_along_axis(own, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(vectors, order[:, :, None], 1)
    alive, kept = np.isfinite(d), np.full((len(points), DEGREE), -1)
    every = np.arange(len(points))
    for k in range(DEGREE):
        at = alive.argmax(axis=1)
        has = alive[every, at]
        if not has.any():
            break
        kept[has, k] = own[every, at][has]
        alive &= ALPHA**2 * ((vectors - vectors[every, at][:, None]) ** 2).sum(axis=2) > d
        alive[every, at] = False
    return kept


def build(x: np.ndarray, seed: int = 7) -> tuple[np.ndarray, int]:
    """The graph of a shard's points: edges (points x DEGREE, -1: none) and the point where searches begin."""
    n = len(x)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    edges = np.full((n, DEGREE), -1)
    order = np.random.default_rng(seed).permutation(n)
    order = order[order != start]
    at, size = 0, 1
    while at < len(order):
        batch = order[at : at + size]
        at, size = at + size, min(2 * size, BATCH)
        _, opened = greedy(x, edges, start, x[batch], BUILD_BEAM)
        edges[batch] = kept = prune(x, batch, opened)
        back, source = kept.ravel(), np.repeat(batch, DEGREE)
        good = back >= 0
        back, source = back[good], source[good]
        by = np.argsort(back, kind="stable")
        back, source = back[by], source[by]
        targets, first, count = np.unique(back, return_index=True, return_counts=True)
        more = np.full((len(targets), count.max(initial=0)), -1)
        more[np.repeat(np.arange(len(targets)), count), np.arange(len(back)) - np.repeat(first, count)] = source
        both = np.concatenate([edges[targets], more], axis=1)
        fits = (both >= 0).sum(axis=1) <= DEGREE
        edges[targets[fits]] = -np.sort(-both[fits], axis=1)[:, :DEGREE]
        rest = np.flatnonzero(~fits)
        for part in np.array_split(rest, max(1, len(rest) * both.shape[1] // 40_000)):
            if len(part):
                edges[targets[part]] = prune(x, targets[part], both[part])
    return edges, start


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


GRAPH = "dim int, shard int, ids binary, vectors binary, edges binary, start int"


def _graph(top: dict[int, float]):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim, shard = key[0].as_py(), key[1].as_py()
        table = table.sort_by("nid")
        v = np.array(table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
        # one more component gives all vectors the length of the longest
        last = np.sqrt(np.maximum(0, top[dim] - (v * v).sum(axis=1)))
        edges, start = build(np.column_stack([v, last]).astype(np.float32) / np.float32(max(top[dim], 1e-300) ** 0.5))
        ids = table.column("nid").to_numpy()
        return pa.table([[dim], [shard], [ids.tobytes()], [v.tobytes()], [edges.astype(np.int32).tobytes()], [start]], schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("edges", pa.binary()), ("start", pa.int32())]))

    return run


def _search(k: int, top: dict[int, float]):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                v = np.frombuffer(r["vectors"]).reshape(-1, dim)
                ids, edges = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["edges"], np.int32).reshape(-1, DEGREE)
                scale = max(top[dim], 1e-300) ** 0.5
                x = np.column_stack([v, np.sqrt(np.maximum(0, top[dim] - (v * v).sum(axis=1)))]).astype(np.float32) / np.float32(scale)
                q = np.array([s["v"] for s in r["queries"]])
                unit = q / np.sqrt((q * q).sum(axis=1, keepdims=True))
                qid = np.array([s["qid"] for s in r["queries"]])
                found = np.concatenate([greedy(x, edges, r["start"], np.column_stack([unit[i : i + BATCH], np.zeros(len(unit[i : i + BATCH]))]).astype(np.float32), BEAM)[0] for i in range(0, len(q), BATCH)])
                who, col = np.nonzero(found >= 0)
                at = found[who, col]
                score = (v[at] * q[who]).sum(axis=1)
                order = np.lexsort((ids[at], -score, who))
                who, at, score = who[order], at[order], score[order]
                rank = np.arange(len(who)) - np.searchsorted(who, who)
                keep = rank <= k
                yield pa.RecordBatch.from_arrays([pa.array(qid[who[keep]]), pa.array(ids[at[keep]]), pa.array(score[keep])], ["qid", "nid", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = NEAREST, vec_id: str = "vec_id", embedding: str = "embedding", shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found among all rows but its own, nearest first.

    Vectors that are null, empty, all zero or hold a null or non-finite component take no part; vectors of another
    length than the query's aren't its candidates. Rows of one id and vector count once; a null id takes no part.
    Equal vectors are one point of a graph with its k + 1 smallest ids, and no other id of it can be among a query's k
    nearest, as ties go to the smaller id.
    """
    usable = lambda df: df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    rows = usable(vectors).distinct()
    first = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    points = rows.withColumn("rn", first).where(F.col("rn") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = cut(points.select(F.monotonically_increasing_id().alias("nid"), "v", "ids", F.size("v").alias("dim")))
    by_dim = points.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).collect()
    empty = points.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not by_dim:
        return empty
    top, shards = {r["dim"]: r["top"] for r in by_dim}, {r["dim"]: -(-r["n"] // shard) for r in by_dim}
    per_dim = F.create_map(*(F.lit(x) for d, n in shards.items() for x in (d, n)))
    total = sum(shards.values())
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("v"), F.element_at(per_dim, F.col("dim"))).cast("int"))
    # by ranges finer than a shard, so that no task gets two shards
    graphs = cut(dealt.repartitionByRange(3 * total, "dim", "shard").groupBy("dim", "shard").applyInArrow(_graph(top), GRAPH))

    asked = usable(queries).distinct()
    wanted = cut(asked.select("v").distinct().select(F.monotonically_increasing_id().alias("qid"), "v", F.size("v").alias("dim")))
    blocks = -(-max(1, wanted.count()) // QUERY_BLOCK)
    block = wanted.groupBy("dim", F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("qid", "v")).alias("queries"))
    everywhere = block.withColumn("shard", F.explode(F.sequence(F.lit(0), F.element_at(per_dim, F.col("dim")) - 1))).where(F.col("dim").isin(list(shards)))
    # a shard's graph is sent once for each block of queries, that is once while there are up to QUERY_BLOCK of them
    jobs = everywhere.join(graphs, ["dim", "shard"]).repartition(3 * blocks * total, "dim", "block", "shard")
    found = jobs.mapInArrow(_search(k, top), "qid long, nid long, score double")
    best = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "nid"))
    found = found.withColumn("rn", best).where(F.col("rn") <= k + 1).drop("rn")
    named = found.join(points.select("nid", "ids"), "nid").select("qid", "score", F.explode("ids").alias("vec_id"))
    who = asked.join(wanted.select("qid", "v"), "v").select(F.col("vec_id").alias("query_id"), "qid")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    pairs = who.join(named, "qid").where(F.col("query_id") != F.col("vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
