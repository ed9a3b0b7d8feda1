"""Hard negatives of anchor vectors by exact integer scores, several candidates per multiplication.

Components are whole numbers. Candidates' components, biased so that none is negative, are put
side by side into the fields of one wide integer (Kronecker packing); one product with an anchor's
biased component then holds the products of all of them, and the sum over the components holds
all their scores, as no field can run over. As long as the packed sums stay below 2**53 the wide
integers are held in doubles, in which such sums are exact, so that a block of anchors and a block
of packed candidates are one matrix product; above that they are Python integers of any width.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.llm.common import drop_stored, stored

#: Doubles hold every whole number below 2**EXACT_BITS.
EXACT_BITS = 53
LIMIT = 1 << 63

PAIRS = "anchor_id bigint, other_id bigint, place bigint, positive_id bigint, positive_score bigint, score bigint"


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): doubles where all are small enough to be exact, else Python integers."""
    if values.size == 0 or float(np.abs(values).max()) * scale < 1 << 52:
        return np.floor(values * float(scale))
    exact = [math.floor(x * scale) if abs(x) < 1 << 52 else int(x) * scale for x in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def as_integers(values: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python integers."""
    return values if values.dtype == object else np.array([int(x) for x in values.ravel().tolist()], object).reshape(values.shape)


class Packed:
    """Candidates' integer vectors, one row each, packed for scores with any of the given anchors."""

    def __init__(self, candidates: np.ndarray, anchors: np.ndarray):
        self.count, self.size = candidates.shape
        self.native = candidates.dtype != object and anchors.dtype != object and self._measure(candidates, anchors) <= EXACT_BITS
        if not self.native:
            self._measure(as_integers(candidates), as_integers(anchors))
        self.fields = EXACT_BITS // self.width if self.native else 64
        self.rows = -(-self.count // self.fields)
        if self.native:
            self.packed = self._fields(np.zeros((self.rows, self.size)), lambda f: 2.0 ** (self.width * f))
        else:
            self.packed = self._fields(np.full((self.rows, self.size), 0, object), lambda f: 1 << (self.width * f))

    def _measure(self, candidates: np.ndarray, anchors: np.ndarray) -> int:
        """Bias both sides and find the bits a field needs; returns the bits that any sum needs."""
        self.bias, self.anchor_bias = (-min(int(m.min(initial=0)), 0) for m in (candidates, anchors))
        self.biased = candidates + self.bias
        self.sums = self.biased.sum(axis=1)
        most, most_anchor = (int(m.sum(axis=1).max(initial=0)) for m in (self.biased, anchors + self.anchor_bias))
        # The largest sum of products in a field: the largest anchor sum times the largest component.
        self.width = max((most_anchor * int(self.biased.max(initial=0))).bit_length(), 1)
        other = max(most_anchor * self.bias, most * self.anchor_bias, self.size * self.bias * self.anchor_bias)
        return max(self.width, other.bit_length())

    def _fields(self, wide: np.ndarray, shift) -> np.ndarray:
        """Candidate f * rows + r goes to field f of row r."""
        for f in range(self.fields):
            part = self.biased[f * self.rows : (f + 1) * self.rows]
            wide[: len(part)] += part * shift(f)
        return wide

    def scores(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Anchors' inner products with all candidates as int64, and which of them fit there (None: all)."""
        biased = (anchors if self.native else as_integers(anchors)) + self.anchor_bias
        wide = biased @ self.packed.T
        # (a - A)(c - C) summed over the components, from the biased sums of products.
        less = self.bias * biased.sum(axis=1)
        fixed = self.size * self.bias * self.anchor_bias
        if self.native:
            wide, out, mask = wide.astype(np.int64), np.empty((len(anchors), self.rows * self.fields), np.int64), np.int64((1 << self.width) - 1)
            for f in range(self.fields):
                out[:, f * self.rows : (f + 1) * self.rows] = (wide >> np.int64(self.width * f)) & mask
            out = out[:, : self.count]
            out -= (less - fixed).astype(np.int64)[:, None]
            out -= (self.anchor_bias * self.sums).astype(np.int64)[None, :]
            return out, None
        mask = (1 << self.width) - 1
        exact = np.concatenate([(wide >> (self.width * f)) & mask for f in range(self.fields)], axis=1)[:, : self.count]
        exact = exact - (less - fixed)[:, None] - (self.anchor_bias * self.sums)[None, :]
        fits = ((exact >= -LIMIT) & (exact < LIMIT)).astype(bool)
        return np.where(fits, exact, 0).astype(np.int64), fits


def matrix(lists: pa.Array, scale: int) -> np.ndarray:
    """Vectors of one length as rows of whole numbers."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return whole(flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0), scale)


def tiles(anchors: pa.Table, rows: pa.Table, scale: int, at_once: int = 256) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Per slice of anchors: scores with all rows, and which pairs count: of other ids, with a score that fits."""
    ours, theirs = (t.column("vector").combine_chunks() for t in (anchors, rows))
    own, other = matrix(ours, scale), matrix(theirs, scale)
    packed = Packed(other, own)
    own_ids, ids = (t.column("id").to_numpy() for t in (anchors, rows))
    for start in range(0, len(own), at_once):
        part = slice(start, min(start + at_once, len(own)))
        scores, fits = packed.scores(own[part])
        counts = own_ids[part, None] != ids[None, :]
        yield part, scores, counts if fits is None else counts & fits


def _rows(**columns: np.ndarray) -> pa.Table:
    names = [c.split(" ")[0] for c in PAIRS.split(", ")]
    n = len(columns["anchor_id"])
    return pa.table({c: pa.array(columns[c] if c in columns else np.zeros(n, np.int64), pa.int64()) for c in names})


def best_same(anchors: pa.Table, rows: pa.Table, scale: int, keep: int) -> list[pa.Table]:
    """Each anchor's ``keep`` best rows of its own label."""
    found = []
    own, label, ids = (x.to_numpy() for x in (anchors.column("label"), rows.column("label"), rows.column("id")))
    anchor_ids = anchors.column("id").to_numpy()
    least = np.iinfo(np.int64).min
    for part, scores, counts in tiles(anchors, rows, scale):
        open_ = counts & (own[part, None] == label[None, :])
        scores = np.where(open_, scores, least)
        line = np.arange(len(scores))
        for _ in range(min(keep, scores.shape[1])):
            at = scores.argmax(axis=1)  # the first of equals, which has the smallest id
            real = open_[line, at]
            found.append(_rows(anchor_id=anchor_ids[part][real], other_id=ids[at[real]], score=scores[line, at][real]))
            scores[line, at] = least
            open_[line, at] = False
    return found


def best_below(anchors: pa.Table, rows: pa.Table, scale: int, keep: int, floor: tuple[int, int]) -> list[pa.Table]:
    """For each of an anchor's positives, the ``keep`` best rows of other labels from the floor up to its score."""
    found = []
    own, label, ids = (x.to_numpy() for x in (anchors.column("label"), rows.column("label"), rows.column("id")))
    anchor_ids = anchors.column("id").to_numpy()
    goals = anchors.column("positives").combine_chunks()
    starts = goals.offsets.to_numpy()
    goal_ids, goal_scores = (goals.values.field(f).to_numpy(zero_copy_only=False) for f in ("id", "score"))
    # 100 * negative >= 80 * positive, without products that leave 64 bits.
    least = np.array([-(-floor[0] * int(p) // floor[1]) for p in goal_scores], np.int64)
    for part, scores, counts in tiles(anchors, rows, scale):
        first, last = starts[part.start : part.stop], starts[part.start + 1 : part.stop + 1]
        low = np.array([least[a:b].min(initial=np.iinfo(np.int64).max) for a, b in zip(first, last)])
        high = np.array([goal_scores[a:b].max(initial=np.iinfo(np.int64).min) for a, b in zip(first, last)])
        line, at = np.nonzero(counts & (own[part, None] != label[None, :]) & (scores >= low[:, None]) & (scores <= high[:, None]))
        value = scores[line, at]
        order = np.lexsort((at, -value, line))
        line, at, value = line[order], at[order], value[order]
        for place in range(int((last - first).max(initial=0))):
            goal = first[line] + place
            mine = goal < last[line]
            goal = np.where(mine, goal, 0)
            chosen = np.flatnonzero(mine & (value >= least[goal]) & (value <= goal_scores[goal]))
            if len(chosen):
                group = line[chosen]
                new = np.concatenate([[True], group[1:] != group[:-1]])
                rank = np.arange(len(group)) - np.flatnonzero(new)[np.cumsum(new) - 1]
                chosen = chosen[rank < keep]
                found.append(_rows(
                    anchor_id=anchor_ids[part][line[chosen]], other_id=ids[at[chosen]], score=value[chosen],
                    place=np.full(len(chosen), place), positive_id=goal_ids[goal[chosen]], positive_score=goal_scores[goal[chosen]],
                ))
    return found


def _usable(df: DataFrame, id_col: str, vector: str, label: Column) -> DataFrame:
    """id, label, vector of the rows that take part."""
    x = F.col(vector)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.select(F.col(id_col).cast("bigint").alias("id"), label.cast("bigint").alias("label"), x.alias("vector"), finite.alias("fine")).filter(
        "fine AND id IS NOT NULL AND label IS NOT NULL"
    ).drop("fine")


def hard_negatives(
    df: DataFrame, is_anchor: Column, *, label: Column | None = None, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256,
    positives: int = 5, negatives: int = 5, floor: tuple[int, int] = (80, 100), block: int = 16_384, anchor_block: int = 4_096,
) -> DataFrame:
    """For every anchor and each of its best rows of the same label, the best rows of other labels that score nearly as high.

    A component becomes floor(scale * x); a score is the integer inner product; higher scores come
    first, equal ones by id. A negative scores no more than the positive, and at least
    ``floor[0] / floor[1]`` of it. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Anchors and rows are dealt into blocks of bounded size; each pair of blocks is one group,
    scored whole, twice: for the positives, then for the negatives. Nothing is broadcast, no
    label, id or vector is a shuffle key, and of every pair of blocks only the best few leave.

    Defined cases: rows with a null id, label or vector, or with a null or non-finite component,
    take no part. Only vectors of equal length form pairs. A pair whose score does not fit a long
    takes no part. A repeated id is as many rows, none of which is another row to an anchor of
    that id; anchors that share an id are one, with its smallest label and vector. Anchors without
    positives or without negatives give no rows, an empty table gives an empty one. Other columns are ignored.
    """
    spark = df.sparkSession
    label = F.col("label") if label is None else label
    usable = _usable(df, id_col, vector, label)
    asked = _usable(df.filter(is_anchor), id_col, vector, label)
    asked, asked_path = stored(asked.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row")).select("id", "row.*"), "anchors")
    rows, anchors = usable.count(), asked.count()
    cells = max(-(-rows // block), 3 * spark.sparkContext.defaultParallelism)
    groups = max(-(-anchors // anchor_block), 1)
    # Whole rows are dealt by a running number, so neither repeated ids nor equal vectors crowd a cell.
    dealt = usable.withColumn("cell", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(cells)))
    dealt = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = dealt.withColumn("size", F.size("vector"))

    def paired(best, asked_rows: DataFrame) -> DataFrame:
        spread = asked_rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("size", F.size("vector"))
        spread = spread.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cells - 1).cast("bigint"))))

        def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
            if not ours.num_rows or not theirs.num_rows:
                return _rows(anchor_id=np.zeros(0, np.int64))
            return pa.concat_tables([_rows(anchor_id=np.zeros(0, np.int64)), *best(ours, theirs.sort_by("id"))])

        # Both sides by an explicit number: small inputs would else be put together into one task.
        keys, tasks = ("cell", "part", "size"), cells * groups
        both = (side.repartition(tasks, *keys).groupBy(*keys) for side in (spread, dealt))
        return next(both).cogroup(next(both)).applyInArrow(run, PAIRS)

    def ranked(found: DataFrame, keep: int, *group: str) -> DataFrame:
        order = Window.partitionBy(*group).orderBy(F.desc("score"), "other_id")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)

    best = ranked(paired(lambda a, r: best_same(a, r, scale, positives), asked), positives, "anchor_id")
    goals = best.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("other_id").alias("id"), "score")).alias("positives"))
    goals, goals_path = stored(asked.join(goals, asked["id"] == goals["anchor_id"]).drop("anchor_id"), "anchor-positives")
    # A repeated id is a positive of its anchor as often as it occurs; places tell them apart.
    found = paired(lambda a, r: best_below(a, r, scale, negatives, floor), goals)
    out = ranked(found, negatives, "anchor_id", "place").select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
    out, _ = stored(out, "hard-negatives")
    drop_stored(spark, asked_path, goals_path)
    return out
