"""Approximate nearest neighbours over balanced posting lists whose centroids are searched by an in-memory graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.llm.common import stored


@dataclass(frozen=True)
class Centroids:
    """Centres of the posting lists and, for each, its neighbours in the search graph."""

    points: np.ndarray
    links: np.ndarray
    entries: np.ndarray


def usable(vector: Column) -> Column:
    """Not null, not all zero, every component a finite number."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & good & F.exists(vector, lambda x: x != 0)


def balanced_centres(points: np.ndarray, leaf: int, seed: int = 5) -> np.ndarray:
    """Halve the points again and again, at the median along the line between two means, down to ``leaf`` points."""
    rng, todo, out = np.random.default_rng(seed), [points], []
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            out.append(own.mean(axis=0))
            continue
        a, b = own[rng.choice(len(own), 2, replace=False)]
        for _ in range(8):
            side = ((own - a) ** 2).sum(axis=1) <= ((own - b) ** 2).sum(axis=1)
            if side.all() or not side.any():
                break
            a, b = own[side].mean(axis=0), own[~side].mean(axis=0)
        order = np.argsort(own @ (b - a), kind="stable")
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
    return np.array(out, np.float32)


def search_graph(points: np.ndarray, degree: int = 24, entries: int = 32) -> Centroids:
    """Link each centre to near ones in different directions, and to some far ones so that all can be reached."""
    n = len(points)
    rng = np.random.default_rng(9)
    links = np.zeros((n, degree), np.int32)
    squares = (points**2).sum(axis=1)
    for i in range(n):
        d = squares - 2 * points @ points[i] + squares[i]
        near = np.argsort(d, kind="stable")[1 : 4 * degree]
        chosen: list[int] = []
        for j in near:
            if len(chosen) >= degree - 4:
                break
            if all(((points[j] - points[c]) ** 2).sum() > 0.8 * d[j] for c in chosen):
                chosen.append(int(j))
        rest = [int(j) for j in near if int(j) not in chosen][: degree - 4 - len(chosen)]
        row = chosen + rest
        row += [(i + 1) % n] + rng.integers(0, n, degree - len(row) - 1).tolist()  # the ring reaches every centre
        links[i] = row[:degree]
    return Centroids(points, links, rng.permutation(n)[:entries])


def nearest_centres(graph: Centroids, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search for many queries at once: ids and distances of up to ``width`` near centres, nearest first."""
    points, n = graph.points, len(queries)
    width = min(width, len(points))
    rows = np.arange(n)
    seen = np.zeros((n, len(points)), bool)
    seen[:, graph.entries] = True
    ids = np.tile(graph.entries, (n, 1))
    dist = ((queries[:, None, :] - points[ids[0]][None]) ** 2).sum(axis=2)
    if ids.shape[1] < width:
        pad = width - ids.shape[1]
        ids = np.concatenate([ids, np.zeros((n, pad), ids.dtype)], axis=1)
        dist = np.concatenate([dist, np.full((n, pad), np.inf)], axis=1)
    open_ = np.isfinite(dist)
    while True:
        order = np.argsort(dist, axis=1, kind="stable")[:, :width]
        ids, dist, open_ = (np.take_along_axis(x, order, axis=1) for x in (ids, dist, open_))
        waiting = open_.any(axis=1)
        if not waiting.any():
            return ids, np.sqrt(dist)
        pick = open_.argmax(axis=1)
        open_[rows, pick] = False
        near = graph.links[ids[rows, pick]]
        d = ((points[near] - queries[:, None, :]) ** 2).sum(axis=2)
        new = ~seen[rows[:, None], near] & waiting[:, None]
        np.put_along_axis(seen, near, True, axis=1)
        first = np.ones_like(new)  # the same neighbour twice in one row
        ordered = np.argsort(near, axis=1, kind="stable")
        sorted_near = np.take_along_axis(near, ordered, axis=1)
        np.put_along_axis(first, ordered, np.concatenate([np.ones((n, 1), bool), np.diff(sorted_near, axis=1) != 0], axis=1), axis=1)
        new &= first
        ids = np.concatenate([ids, near], axis=1)
        dist = np.concatenate([dist, np.where(new, d, np.inf)], axis=1)
        open_ = np.concatenate([open_, new], axis=1)


def lists_for(graph: Centroids, vectors: np.ndarray, *, ratio: float, most: int, least: int = 1) -> list[np.ndarray]:
    """Posting lists of each vector: those no farther than ``ratio`` times the nearest centre, nearest first, ``least`` to ``most`` of them."""
    width = max(most, 24)
    if 8 * width >= len(graph.points):  # a beam as wide would visit most centres
        width = min(width, len(graph.points))
        dist = (vectors**2).sum(axis=1)[:, None] - 2 * vectors @ graph.points.T + (graph.points**2).sum(axis=1)
        ids = np.argpartition(dist, width - 1, axis=1)[:, :width]
        ids = np.take_along_axis(ids, np.argsort(np.take_along_axis(dist, ids, axis=1), axis=1, kind="stable"), axis=1)
        dist = np.sqrt(np.maximum(np.take_along_axis(dist, ids, axis=1), 0))
    else:
        ids, dist = nearest_centres(graph, vectors, width)
    return [own[np.isfinite(d) & ((d <= ratio * d[0] + 1e-12) | (np.arange(len(d)) < least))][:most] for own, d in zip(ids, dist)]


def measured_probes(graph: Centroids, sample: np.ndarray, *, k: int, recall: float, ratio: float, most: int, queries: int = 256, seed: int = 3) -> int:
    """How many lists a query must read so that ``recall`` of its ``k`` nearest in the sample, found by brute force, are in one.

    In the whole table the nearest are nearer than in a sample, so no more are needed there.
    """
    asked = np.random.default_rng(seed).permutation(len(sample))[:queries]
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(graph.points)
    squares, needed = (sample**2).sum(axis=1), []
    for i in asked:
        d = squares - 2 * sample @ sample[i]
        d[i] = np.inf
        near = np.argpartition(d, k - 1)[:k]
        rank = np.empty(len(graph.points), np.int64)
        rank[np.argsort(((graph.points - sample[i]) ** 2).sum(axis=1), kind="stable")] = np.arange(len(rank))
        needed += [rank[own].min() + 1 for own in lists_for(graph, sample[near], ratio=ratio, most=most)]
    return int(np.quantile(needed, recall, method="higher"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _assign(frame: DataFrame, shared, **options) -> DataFrame:
    """A row (list, key, vector) for every list of a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                own = batch.slice(start, 512)
                vectors = _matrix(own.column("vector")).astype(np.float32)
                found = lists_for(shared.value, vectors, **options)
                row = np.repeat(np.arange(len(found)), [len(f) for f in found])
                taken = own.take(pa.array(row))
                lists = pa.array(np.concatenate(found).astype(np.int32))
                yield pa.RecordBatch.from_arrays([lists, taken.column("key"), taken.column("vector")], names=["list", "key", "vector"])

    return frame.select("key", "vector").mapInArrow(run, "list int, key bigint, vector array<double>")


def _scan(k: int):
    def run(place: tuple, posting: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = {"query": [], "key": [], "score": []}
        if len(posting) and len(asked):
            vectors, keys = np.stack(posting["vector"].to_numpy()), posting["key"].to_numpy(np.int64)
            for query, vector in zip(asked["key"], asked["vector"]):
                score = np.sqrt(((vectors - np.asarray(vector)) ** 2).sum(axis=1))
                if len(score) > k:
                    near = np.flatnonzero(score <= np.partition(score, k - 1)[k - 1])
                else:
                    near = np.arange(len(score))
                best = near[np.lexsort((keys[near], score[near]))]
                found["query"] += [query] * len(best)
                found["key"] += keys[best].tolist()
                found["score"] += score[best].tolist()
        return pd.DataFrame({"query": np.array(found["query"], np.int64), "key": np.array(found["key"], np.int64), "score": np.array(found["score"], np.float64)})

    return run


def nearest(
    vectors: DataFrame, is_query: Column, *, k: int = 10, list_size: int = 200, sample: int = 50_000, copies: int = 8, copy_ratio: float = 1.2,
    probes: int = 64, probe_ratio: float = 1.25, block: int = 4096, recall: float = 0.995,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found of every query row, itself left out.

    ``vectors`` has vec_id and embedding. Score is the Euclidean distance of the original
    vectors in double precision; nearest first, ties to the smaller vec_id. Vectors that are null,
    all zero or hold null or non-finite components take no part, nor do those whose length is
    not the most common one. Rows without an id take no part. Equal vectors are stored once
    with their k + 1 smallest ids, which is all that a result can hold of them.

    Centres are fitted on about ``sample`` vectors chosen by a hash, one for ``list_size`` vectors
    while twelve of the sample are left for each; every vector is indexed. (A pruning rule that
    keeps copies on different sides of a boundary left none in 64 dimensions, so it is not used.)
    A vector near a boundary is stored in up to ``copies`` lists. A query reads the lists whose
    centres are within ``probe_ratio`` times its nearest centre's distance, ``probes`` at most,
    but always as many as :func:`measured_probes` finds needed for ``recall``.
    Lists are cut into blocks of about ``block`` vectors and queries into as many, so no task
    holds a whole list.
    """
    spark = vectors.sparkSession
    good = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), is_query.alias("asked")
    )
    sizes = good.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not sizes:
        return empty
    total = sizes[0]["n"]
    good = good.filter(F.size("vector") == sizes[0]["size"])
    same = Window.partitionBy("vector").orderBy("vec_id")
    copies_of = good.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1)
    points, _ = stored(copies_of.groupBy("vector").agg(F.min("vec_id").alias("key"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "ann-points")
    asked, _ = stored(good.filter("asked").select("vec_id", "vector").join(points.select("vector", "key"), "vector").select("vec_id", "key"), "ann-queries")
    share = min(1.0, sample / total)
    fitted = points.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share * (1 << 20)).select("vector").toPandas()["vector"]  # bounded by sample
    if not len(fitted):
        return empty
    fitted = np.stack(fitted.to_numpy()).astype(np.float32)
    graph = search_graph(balanced_centres(fitted, max(12, round(list_size * share))))
    needed = measured_probes(graph, fitted, k=k, recall=recall, ratio=copy_ratio, most=copies)
    shared = spark.sparkContext.broadcast(graph)
    postings, _ = stored(_assign(points, shared, ratio=copy_ratio, most=copies), "ann-postings")
    wanted = points.join(asked.select("key").distinct(), "key", "left_semi")
    probing, _ = stored(_assign(wanted, shared, ratio=probe_ratio, most=max(probes, needed), least=needed), "ann-probes")
    # One row per list, of which there are fewer than vectors in the sample: a bounded broadcast.
    count = lambda frame, name: frame.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    cuts = F.broadcast(count(postings, "blocks").join(count(probing, "parts"), "list"))
    spread = lambda frame, own, other: frame.join(cuts, "list").select(
        "list", F.pmod(F.xxhash64("key"), F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), "key", "vector"
    )
    place = ["list", "blocks", "parts"]
    found = (
        spread(postings, "blocks", "parts").groupBy(*place).cogroup(spread(probing, "parts", "blocks").groupBy(*place))
        .applyInPandas(_scan(k + 1), "query bigint, key bigint, score double")
    )
    merged = found.groupBy("query", "key").agg(F.min("score").alias("score"))
    top = merged.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("score", "key"))).filter(F.col("n") <= k + 1)
    ids = top.join(points.select("key", "ids"), "key").select("query", "score", F.explode("ids").alias("vec_id"))
    results = ids.join(asked.select(F.col("vec_id").alias("query_id"), F.col("key").alias("query")), "query").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return results.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
