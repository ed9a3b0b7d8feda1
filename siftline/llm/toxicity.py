"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.llm.common import held_out, stored

STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Model:
    """Hashes of the chosen n-grams and, for each, its ratio times its learned weight."""

    orders: tuple[int, ...]
    hashes: np.ndarray
    weights: np.ndarray
    bias: float


def codes_of(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text between two spaces; white space becomes a space."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes[(codes >= 9) & (codes <= 13)] = 32
    return codes


def ngram_hashes(codes: np.ndarray, orders: Sequence[int]) -> Iterator[np.ndarray]:
    """Per order, a 64-bit hash of the n-gram that starts at each place."""
    if not len(codes):
        return
    rolled = codes + np.uint64(1)
    for n in range(2, max(orders) + 1):
        if len(codes) < n:
            return
        rolled = rolled[:-1] * STEP + codes[n - 1 :]
        if n in orders:
            yield (rolled ^ (rolled >> np.uint64(29))) * MIX


def _blocks(codes: np.ndarray, orders: Sequence[int], size: int = 1 << 18) -> Iterator[np.ndarray]:
    """Hashes of a text of any length in bounded memory; blocks overlap so that no n-gram is cut."""
    for start in range(0, max(len(codes) - 1, 1), size):
        yield from ngram_hashes(codes[start : start + size + max(orders) - 1], orders)


class Finder:
    """Which of a fixed set of hashes occur: one slot per hash in a table, so a lookup is two reads."""

    BITS = 22

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.slot = np.full(1 << self.BITS, -1, np.int32)
        self.slot[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)] = np.arange(len(hashes), dtype=np.int32)

    @classmethod
    def separate(cls, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that are first in their slot."""
        return np.sort(np.unique(hashes >> np.uint64(64 - cls.BITS), return_index=True)[1])

    def present(self, codes: np.ndarray, orders: Sequence[int]) -> np.ndarray:
        seen = np.zeros(len(self.hashes), bool)
        for hashes in _blocks(codes, orders):
            found = self.slot[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)]
            at = np.flatnonzero(found >= 0)
            found = found[at]
            seen[found[self.hashes[found] == hashes[at]]] = True
        return np.flatnonzero(seen)


def labelled_sample(docs: DataFrame, labels: DataFrame, *, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """About ``per_class`` labelled texts of each class outside the held-out fold, and the classes' whole sizes.

    Rows are taken by a hash of the id, so the choice is repeatable and independent of the
    order. An id with conflicting labels counts as the larger one.
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("_id").agg(F.max("y").alias("y"))
    )
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("y") == y, F.lit(min(1.0, per_class / n))).otherwise(share)
    chosen = known.filter(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < share * (1 << 20))
    # At most about 2 * per_class rows of two numbers, so a broadcast is bounded.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return rows.select("text", "y", (F.crc32(F.col("_id").cast("string")) % 5 == 1).alias("check")), sizes


def _counts(sample: DataFrame, orders: Sequence[int]) -> DataFrame:
    """(h, y, n): in how many texts of class y the n-gram occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                own = batch.slice(start, 200)
                each: dict[int, list[np.ndarray]] = {0: [], 1: []}
                for text, y in zip(own.column("text").to_pylist(), own.column("y").to_pylist()):
                    each[y].append(np.unique(np.concatenate([np.zeros(0, np.uint64), *_blocks(codes_of(text), orders)])))
                for y, found in each.items():
                    if found:
                        h, n = np.unique(np.concatenate(found), return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), y)), pa.array(n)], names=["h", "y", "n"])

    return sample.mapInArrow(run, "h bigint, y bigint, n bigint")


def train(
    docs: DataFrame, labels: DataFrame, *, label: str = "toxic", orders: Sequence[int] = (3, 4, 5, 6), per_class: int = 3000,
    max_features: int = 20_000, min_texts: int = 3, alpha: float = 1.0, reg: float = 0.01,
) -> Model:
    """Fit on a bounded sample: about ``per_class`` texts of each class, none of the held-out fold.

    Every n-gram's log-count ratio compares the shares of texts of either class that hold it.
    The ``max_features`` n-grams whose ratios stand out most from chance are kept, and a
    logistic regression learns one weight per ratio. A fifth of the sample takes no part in
    this; on it the bias is moved to where a score of 0.5 separates the classes best, given
    their whole sizes. With one class only, or none, the score is that class's share.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    orders = tuple(orders)
    sample, sizes = labelled_sample(docs, labels, label=label, per_class=per_class)
    both, _ = stored(sample.repartition(docs.sparkSession.sparkContext.defaultParallelism * 2), "toxic-sample")
    sample = both.filter("NOT check")
    taken = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    if min(taken.get(0, 0), taken.get(1, 0)) < min_texts:
        share = (sizes.get(1, 0) + 0.5) / (total + 1)
        return Model(orders, np.zeros(0, np.uint64), np.zeros(0), float(np.log(share / (1 - share))))
    n1, n0 = F.col("n1") + alpha, F.col("n0") + alpha
    ratio = F.log(n1 / (taken[1] + 2 * alpha)) - F.log(n0 / (taken[0] + 2 * alpha))
    best = (
        _counts(sample, orders).groupBy("h").agg(F.sum(F.col("n") * F.col("y")).alias("n1"), F.sum(F.col("n") * (1 - F.col("y"))).alias("n0"))
        .filter(F.col("n1") + F.col("n0") >= min_texts).select("h", ratio.alias("ratio"), (F.abs(ratio) / F.sqrt(1 / n1 + 1 / n0)).alias("z"))
        .orderBy(F.desc("z"), "h").limit(max_features).toPandas()
    )
    hashes, ratios = best["h"].to_numpy(np.int64).view(np.uint64), best["ratio"].to_numpy(np.float64)
    apart = Finder.separate(hashes)
    hashes, ratios = hashes[apart], ratios[apart]
    shared = docs.sparkSession.sparkContext.broadcast((hashes, ratios))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_hashes, own_ratios = shared.value
        finder = Finder(own_hashes)
        for batch in batches:
            found = [finder.present(codes_of(t), orders) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column("y").to_pylist(), pa.float64()), pa.array(found, pa.list_(pa.int32())), pa.array([own_ratios[f] for f in found], pa.list_(pa.float64()))],
                names=["label", "at", "value"],
            )

    size = len(hashes)
    sparse = F.udf(lambda at, value: Vectors.sparse(size, at, value), VectorUDT())  # the bounded sample only
    rows, _ = stored(sample.mapInArrow(vectors, "label double, at array<int>, value array<double>"), "toxic-vectors")
    fitted = LogisticRegression(maxIter=100, regParam=reg, standardization=False).fit(rows.select("label", sparse("at", "value").alias("features")))
    plain = Model(orders, hashes, fitted.coefficients.toArray() * ratios, float(fitted.intercept))
    checked = score(both.filter("check").select("text", "y"), plain).select("y", "score").toPandas()  # part of the bounded sample
    return replace(plain, bias=plain.bias - _best_cut(checked["score"].to_numpy(), checked["y"].to_numpy() == 1, sizes))


def _best_cut(scores: np.ndarray, positive: np.ndarray, sizes: dict[int, int]) -> float:
    """The log-odds at which F1 is best, each class weighted by its whole size; the middle of the best gap."""
    if not positive.any() or positive.all():
        return 0.0
    odds = np.log(np.clip(scores, 1e-12, 1 - 1e-12)) - np.log1p(-np.clip(scores, 1e-12, 1 - 1e-12))
    order = np.argsort(-odds, kind="stable")
    odds, positive = odds[order], positive[order]
    hit = np.cumsum(positive) / positive.sum() * sizes[1]
    false = np.cumsum(~positive) / (~positive).sum() * sizes[0]
    best = int(np.argmax(2 * hit / (hit + false + sizes[1])))
    below = odds[best + 1] if best + 1 < len(odds) else odds[best]
    return float((odds[best] + below) / 2)


def score(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, the probability of label 1, from the whole text; null counts as empty.

    Other columns come back unchanged; one that is named ``out`` is replaced.
    """
    rest = [c for c in docs.columns if c != out]
    schema = docs.select(*rest).schema.add(out, "double", False)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        finder = Finder(own.hashes)
        for batch in batches:
            sums = [own.bias + own.weights[finder.present(codes_of(t.as_py()), own.orders)].sum() for t in batch.column(text)]
            values = 1 / (1 + np.exp(-np.clip(np.array(sums, np.float64), -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(values)], names=schema.names)

    return docs.mapInArrow(run, schema)
