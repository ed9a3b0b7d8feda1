"""Text quality by a factorisation machine over hashed words, structure statistics and metadata.

A text is a sparse vector x: its words by hash, weighted by how often they occur, and one
place per interval of each structure statistic and of each metadata column. The score is

    sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

and the pairwise sum is taken in time linear in the places used, as
``1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm.common import drop_stored, stored
from siftline.llm.word_codes import Memo, slices, words_of

#: Intervals of a structure statistic (all are shares from 0 to 1) and of a metadata column (powers of two).
STEPS, LEVELS = 16, 40
#: Words added to every text's count when shares are taken.
SHRINK = 20.0
STATISTICS = (
    "letters", "upper", "digits", "spaces", "lines", "other", "marks a word", "distinct words", "most common word", "repeated neighbours", "short words", "long words",
    "words with marks inside", "words in upper case", "words without letters", "length",
)


@dataclass(frozen=True)
class Machine:
    """Weights of the places: hashed words first, then intervals of statistics, then of metadata columns."""

    words: int
    metadata: tuple[str, ...]
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @property
    def places(self) -> int:
        return self.words + STEPS * len(STATISTICS) + LEVELS * len(self.metadata)

    def odds(self, at: np.ndarray, value: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log-odds of label 1 for texts whose places and values lie one after another, ``counts`` of each."""
        text = np.repeat(np.arange(len(counts)), counts)

        def sums(x: np.ndarray) -> np.ndarray:  # each text by itself, so that equal texts get equal sums
            return np.bincount(text, weights=x, minlength=len(counts))

        pairs = np.zeros(len(counts))
        for weights in self.factors.T:
            held = weights[at] * value
            pairs += sums(held) ** 2 - sums(held * held)
        return self.bias + sums(self.linear[at] * value) + 0.5 * pairs


def word_facts(word: str) -> tuple[int, int, int, int, int, int, int]:
    """Hash of the lower-cased word, its letters, upper-case letters, digits, other signs, length, and its kind.

    The kind is a sum: 1 if signs stand between letters, 2 if all letters are upper case (two at least), 4 without letters.
    """
    code = int.from_bytes(blake2b(word.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big") >> 1
    if word.isalpha() and word.islower():
        return code, len(word), 0, 0, 0, len(word), 0
    letters = sum(map(str.isalpha, word))
    upper = sum(map(str.isupper, word))
    digits = sum(map(str.isdigit, word))
    core = word.strip("".join({c for c in word if not c.isalnum()}))
    kind = (bool(core) and not core.isalnum()) + 2 * (upper == letters > 1) + 4 * (letters == 0)
    return code, letters, upper, digits, len(word) - letters - digits, len(word), kind


class Features:
    """Places and values of texts; what a word says is worked out once and remembered within bounds."""

    def __init__(self, words: int, metadata: Sequence[str], memory: int = 100_000):
        self.words, self.metadata, self.memo = words, tuple(metadata), Memo(memory)

    def _facts(self, words: list[str]) -> list[tuple]:
        return [word_facts(w) for w in words]

    def texts(self, texts: pa.Array, meta: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per slice of texts: places, values, and the number of places of each text."""
        start = 0
        for part in slices(texts, 1 << 20):
            n = len(part)
            yield self._slice(part, [m[start : start + n] for m in meta])
            start += n

    def _slice(self, part: pa.Array, meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(part)
        lines = pc.fill_null(pc.count_substring(part, "\n"), 0).to_numpy(zero_copy_only=False)
        spaced = pc.replace_substring_regex(pc.fill_null(part, ""), r"[ \t\n\x0b\f\r]+", " ")
        distinct, codes, per = words_of(pc.utf8_trim(spaced, " "))
        chars = pc.utf8_length(pc.fill_null(part, "")).to_numpy(zero_copy_only=False).astype(np.float64)
        facts = np.array(self.memo.fill(distinct, self._facts), np.int64).reshape(-1, 7)
        real = facts[codes, 5] > 0  # an empty text is split into one empty word
        text = np.repeat(np.arange(n), per)
        codes, text = codes[real], text[real]
        total = np.bincount(text, minlength=n).astype(np.float64)
        whole, length = np.maximum(total, 1), np.maximum(chars, 1)

        def share(values: np.ndarray, of: np.ndarray) -> np.ndarray:
            return np.bincount(text, weights=values, minlength=n) / of

        key, times = np.unique(text * np.int64(len(distinct) + 1) + codes, return_counts=True)
        owner, word = key // (len(distinct) + 1), key % (len(distinct) + 1)
        most = np.zeros(n)
        np.maximum.at(most, owner, times)
        again = np.zeros(len(codes))
        again[1:] = (codes[1:] == codes[:-1]) & (text[1:] == text[:-1])
        of = facts[codes]
        letters = share(of[:, 1], 1.0)
        shares = [
            letters / length, share(of[:, 2], np.maximum(letters, 1)), share(of[:, 3], length), (chars - share(of[:, 5], 1.0)) / length, lines / whole,
            share(of[:, 4], length), np.minimum(share(of[:, 4], whole) / 4, 1), np.bincount(owner, minlength=n) / whole, most / whole, share(again, whole),
            share(of[:, 5] <= 2, whole), share(of[:, 5] >= 12, whole), share(of[:, 6] & 1, whole), share((of[:, 6] >> 1) & 1, whole),
            share((of[:, 6] >> 2) & 1, whole), np.log2(total + 1) / LEVELS,
        ]
        # Shares near 0 matter most, so intervals are even in the square root.
        steps = [np.minimum((np.sqrt(np.clip(s, 0, 1)) * STEPS).astype(np.int64), STEPS - 1) + self.words + STEPS * i for i, s in enumerate(shares)]
        base = self.words + STEPS * len(STATISTICS)
        for i, m in enumerate(meta):
            level = np.floor(np.log2(np.abs(np.nan_to_num(m, nan=0.0, posinf=1e300, neginf=-1e300)) + 1)).clip(0, LEVELS // 2 - 2).astype(np.int64) + 1
            steps.append(np.where(np.isnan(m), 0, np.where(m < 0, level + LEVELS // 2, level)) + base + LEVELS * i)
        weight = 1 + np.log(times.astype(np.float64))
        # Words count by their share, less so in short texts, which say little about their words.
        norm = np.bincount(owner, weights=weight, minlength=n) + SHRINK
        every = np.tile(np.arange(n), len(steps))
        rows = np.concatenate([owner, every])
        at = np.concatenate([facts[word, 0] % self.words, *steps])
        value = np.concatenate([weight / norm[owner], np.full(len(every), 0.5)])
        # Words that share a place are one place of the sum of their values.
        both, inverse = np.unique(rows * np.int64(1 << 32) + at, return_inverse=True)
        return both & 0xFFFFFFFF, np.bincount(inverse, weights=value), np.bincount(both >> 32, minlength=n)


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(True))


def _meta(batch: pa.RecordBatch, metadata: Sequence[str]) -> list[np.ndarray]:
    return [pc.fill_null(batch.column(c).cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) for c in metadata]


def _sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, metadata: Sequence[str]) -> tuple[DataFrame, dict[int, int]]:
    """About ``per_class`` texts of each class outside the held-out fold, chosen by a hash of the id, and the classes' sizes."""
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
        .groupBy("_id").agg(F.min("_y").alias("_y"))
    )
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.lit(0.0)
    for y, n in sizes.items():
        share = F.when(F.col("_y") == y, F.lit(min(1.0, per_class / n))).otherwise(share)
    chosen = known.filter(F.pmod(F.xxhash64("_id", F.lit(12)), F.lit(1 << 20)) < share * (1 << 20))
    # About 2 * per_class rows of two numbers at most, so a broadcast is bounded.
    rows = docs.select("doc_id", "text", *metadata).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return rows.select("text", *metadata, F.col("_y").alias("_label"), (F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(5)) == 0).alias("_check")), sizes


def train(
    docs: DataFrame, labels: DataFrame, *, label: str = "quality", metadata: Sequence[str] = (), words: int = 1 << 14, factors: int = 8, per_class: int = 2500,
    rounds: int = 100, step: float = 0.05, reg: float = 0.03, least: int = 3, seed: int = 1,
) -> Machine:
    """Fit on a bounded sample: about ``per_class`` labelled texts of each class, none of the held-out fold.

    Four fifths of the sample fit the machine (Spark's, by gradient steps over the partitions), one fifth moves the bias to
    where a score of 0.5 separates the classes best, given their whole sizes. Numeric ``metadata``
    columns count by sign and power of two; null is an interval of its own. An id with conflicting
    labels counts as 0; labels other than 0 and 1 are ignored. With fewer than ``least`` texts of a
    class the score is the share of class 1.
    """
    from pyspark.ml.classification import FMClassifier

    spark, metadata = docs.sparkSession, tuple(metadata)
    sample, sizes = _sample(docs, labels, label, per_class, metadata)
    both, path = stored(sample.repartition(2 * spark.sparkContext.defaultParallelism), "quality-sample")
    taken = {r["_label"]: r["n"] for r in both.filter("NOT _check").groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
    blank = Machine(words, metadata, float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, 0)))
    blank = replace(blank, linear=np.zeros(blank.places), factors=np.zeros((blank.places, factors)))
    if min(taken.get(0, 0), taken.get(1, 0)) < least:
        drop_stored(spark, path)
        return blank

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(words, metadata)
        for batch in batches:
            start = 0
            for at, value, counts in features.texts(batch.column("text"), _meta(batch, metadata)):
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_label").slice(start, len(counts)).cast(pa.float64()), pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(value))],
                    names=["label", "at", "value"],
                )
                start += len(counts)

    sparse = _sparse(blank.places)
    rows, rows_path = stored(both.filter("NOT _check").mapInArrow(run, "label double, at array<int>, value array<double>"), "quality-vectors")
    fitted = FMClassifier(factorSize=factors, maxIter=rounds, stepSize=step, regParam=reg, seed=seed, solver="adamW", tol=0.0).fit(rows.select("label", sparse("at", "value").alias("features")))
    machine = replace(blank, bias=float(fitted.intercept), linear=fitted.linear.toArray(), factors=fitted.factors.toArray())
    checked = score(both.filter("_check").select("text", *metadata, "_label"), machine, out="_score").select("_label", "_score").toPandas()  # part of the bounded sample
    machine = replace(machine, bias=machine.bias - best_cut(checked["_score"].to_numpy(), checked["_label"].to_numpy() == 1, sizes))
    drop_stored(spark, path, rows_path)
    return machine


def _sparse(size: int):
    """A row's places and values as a vector of Spark ML; for the bounded sample only."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    return F.udf(lambda at, value: Vectors.sparse(size, at, value), VectorUDT())


def best_cut(scores: np.ndarray, good: np.ndarray, sizes: dict[int, int]) -> float:
    """The log-odds at which the mean of both classes' hit rates is best: the middle of the widest such gap."""
    if good.all() or not good.any():
        return 0.0
    clipped = np.clip(scores, 1e-12, 1 - 1e-12)
    odds = np.log(clipped) - np.log1p(-clipped)
    order = np.argsort(odds, kind="stable")
    odds, good = odds[order], good[order]
    low = np.concatenate([[0], np.cumsum(~good)]) / (~good).sum()  # rejected rightly, if the cut lies below place i
    lost = np.concatenate([[0], np.cumsum(good)]) / good.sum()
    value = low - lost
    best = np.flatnonzero(value >= value.max() - 1e-12)
    edges = np.concatenate([[odds[0] - 1], odds, [odds[-1] + 1]])
    widest = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[widest] + edges[widest + 1]) / 2)


def score(docs: DataFrame, machine: Machine, *, text: str = "text", out: str = "score") -> DataFrame:
    """Add ``out``, the probability of label 1, from the whole text and the machine's metadata columns.

    One narrow pass. A null text counts as empty and is scored like any text, a text of any length
    is used whole, repeated rows get equal scores, an empty table gives an empty one. Other columns come
    back unchanged; one that is named ``out`` is replaced.
    """
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*kept).schema.add(out, "double", False)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # its size is set by ``words`` and ``factors``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        features = Features(own.words, own.metadata)
        for batch in batches:
            odds = [own.odds(*found) for found in features.texts(batch.column(text), _meta(batch, own.metadata))]
            values = 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *odds]), -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(values)], names=schema.names)

    return docs.mapInArrow(run, schema)
