"""Near fingerprints among those that share one block of bits, compared as arrays.

Two fingerprints at most d bits apart, cut into d + 1 blocks, agree on one of them; where a pair has to
share a band, the bands are the blocks. So a fingerprint is shuffled once per block, a handful of
short rows whatever the number of fingerprints, and those that meet are compared exactly, a few
thousand million a minute and core. Longer keys compare less but copy a fingerprint hundreds of times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftline.functions.hashing import block_masks

#: Comparisons made at once.
CELLS = 1 << 18
#: Shuffled rows that a task gets, about.
TASK_ROWS = 1 << 17


def block_count(distance: int, num_bands: int) -> int:
    """Blocks of which every near pair shares one."""
    return num_bands if distance >= num_bands else distance + 1


def in_blocks(side: DataFrame, blocks: int, hash_bits: int) -> DataFrame:
    """Every row once per block of its ``fp``: all its columns, k (the block) and v (its bits)."""
    masks = block_masks(blocks, hash_bits)
    shifts = [(m & -m).bit_length() - 1 for m in masks]
    parts = [F.shiftrightunsigned("fp", s).bitwiseAND(F.lit((m >> s) - (1 << 64 if m >> s >> 63 else 0))) for m, s in zip(masks, shifts)]
    return side.filter(F.col("fp").isNotNull()).select(*side.columns, F.posexplode(F.array(*parts)).alias("k", "v"))


def _arranged(rows: DataFrame, units: list[str], total: int) -> DataFrame:
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(total / TASK_ROWS))
    return rows.repartition(tasks, *units).sortWithinPartitions(*units)


def _units(batches: Iterator[pa.RecordBatch], units: list[str], values: list[str]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Runs of rows with equal ``units``, whichever batches they lie in."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in units]
        data = [batch.column(c).to_numpy() for c in values]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for key in keys:
            change[1:] |= key[1:] != key[:-1]
        starts = np.flatnonzero(change).tolist()
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            unit = tuple(int(key[start]) for key in keys)
            if unit != now:
                if held:
                    yield now, [np.concatenate(x) for x in zip(*held)]
                now, held = unit, []
            held.append([x[start:end] for x in data])
    if held:
        yield now, [np.concatenate(x) for x in zip(*held)]


def block_pairs(
    left: DataFrame, right: DataFrame | None, total: int, *, distance: int, num_bands: int, hash_bits: int, slice_rows: int
) -> DataFrame:
    """fp_a, fp_b, distance of all near pairs: within ``left`` (fp_a < fp_b), or of every row of ``left`` with every one of ``right``.

    The rows of a block value that has more than ``slice_rows`` are dealt out into slices, and each two
    slices meet in a unit of their own. ``total`` is the number of fingerprints, for the number of tasks.
    """
    blocks = block_count(distance, num_bands)
    masks = np.array(block_masks(blocks, hash_bits), np.uint64)
    sides = [left] if right is None else [left, right]
    rows = None
    for at, side in enumerate(sides):
        one = in_blocks(side.select("fp"), blocks, hash_bits).withColumn("side", F.lit(at))
        rows = one if rows is None else rows.unionByName(one)
    parts = F.ceil(F.col("n") / F.lit(slice_rows)).cast("int")
    # Few: a value that is listed has more than ``slice_rows`` rows.
    crowds = rows.groupBy("k", "v", "side").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > slice_rows).select("k", "v", "side", parts.alias("parts"))
    per_side = [F.broadcast(crowds.filter(F.col("side") == at).select("k", "v", F.col("parts").alias(f"parts{at}"))) for at in range(len(sides))]
    for at, one in enumerate(per_side):
        rows = rows.join(one, ["k", "v"], "left").withColumn(f"parts{at}", F.coalesce(f"parts{at}", F.lit(1)))
    own = F.when(F.col("side") == 0, F.col("parts0")).otherwise(F.col(f"parts{len(sides) - 1}"))
    others = F.when(F.col("side") == 0, F.col(f"parts{len(sides) - 1}")).otherwise(F.col("parts0"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), own).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    if right is None:
        i, j = F.least("own", "other"), F.greatest("own", "other")
        second = F.when(F.col("own") == F.col("other"), False).otherwise(F.col("own") > F.col("other"))
    else:
        first = F.col("side") == 0
        i, j = F.when(first, F.col("own")).otherwise(F.col("other")), F.when(first, F.col("other")).otherwise(F.col("own"))
        second = ~first
    rows = rows.select("fp", "k", "v", i.alias("i"), j.alias("j"), second.cast("int").alias("second"))
    units = ["k", "v", "i", "j"]
    within = right is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (block, _, i, j), (fps, second) in _units(batches, units, ["fp", "second"]):
            fps = fps.view(np.uint64)
            a, b = fps[second == 0], fps[second == 1]
            alone = within and i == j
            if alone:
                b = a
            if not len(a) or not len(b):
                continue
            step = max(1, CELLS // len(b))
            for start in range(0, len(a), step):
                ahead = b[start + 1 :] if alone else b
                if not len(ahead):
                    break
                difference = a[start : start + step, None] ^ ahead[None, :]
                apart = np.bitwise_count(difference)
                x, y = np.nonzero(apart <= distance)
                if alone:
                    x, y = x[y >= x], y[y >= x]  # the others were met the other way round
                bits = difference[x, y]
                # A pair is kept under the first of the blocks that it shares.
                kept = np.ones(len(x), bool)
                for mask in masks[:block]:
                    kept &= (bits & mask) != 0
                x, y = x[kept], y[kept]
                if not len(x):
                    continue
                one, two = a[start + x].view(np.int64), ahead[y].view(np.int64)
                if within:
                    one, two = np.minimum(one, two), np.maximum(one, two)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(apart[x, y].astype(np.int32))], names=["fp_a", "fp_b", "distance"])

    return _arranged(rows, units, total * blocks).mapInArrow(run, "fp_a bigint, fp_b bigint, distance int")


def block_links(keyed: DataFrame, total: int, *, distance: int) -> DataFrame:
    """u, v: links that connect the near fingerprints of each block value, each to the one its search began with.

    ``keyed`` has fp, k, v. A fingerprint that was reached is not compared again, so the variants of one text cost little
    more than one pass over them, and no pairs are listed.
    """
    units = ["k", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (fps,) in _units(batches, units, ["fp"]):
            left, found, roots = fps.view(np.uint64), [], []
            while len(left) > 1:
                root, left = left[0], left[1:]
                reached = [root]
                while reached and len(left):
                    near = np.bitwise_count(left ^ reached.pop()) <= distance
                    if near.any():
                        new, left = left[near], left[~near]
                        reached.extend(new)
                        found.append(new.view(np.int64))
                        roots.append(np.full(len(new), root).view(np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(roots))], names=["u", "v"])

    return _arranged(keyed.select("fp", "k", "v"), units, total).mapInArrow(run, "u bigint, v bigint")
