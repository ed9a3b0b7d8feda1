"""Near-duplicate fingerprint pairs as equi-joins on agreeing bit blocks.

Two fingerprints at most d bits apart, cut into d + r blocks, agree on at least r whole
blocks. Joining on every choice of r blocks therefore finds all such pairs; more blocks
mean longer keys and fewer candidates. Inputs are distinct fingerprints, so a blast of
identical texts is one row here whatever its size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from siftline.functions.hashing import block_keys, block_masks, signed64
from siftline.operators.blocks import block_pairs
from siftline.operators.skew import lookup_join
from siftline.session import materialize

MAX_KEYS = 1000
BROADCAST_ROWS = 1_000_000
# Shuffling and sorting one keyed row costs about as much as comparing this many pairs.
ROW_COST = 50


@dataclass(frozen=True)
class KeyScheme:
    """How fingerprints are keyed: cut into ``blocks``, joined on each choice of ``agree``."""

    blocks: int
    agree: int

    @property
    def keys(self) -> int:
        return math.comb(self.blocks, self.agree)

    def key_bits(self, hash_bits: int) -> float:
        return hash_bits * self.agree / self.blocks


def max_distance(threshold: float, hash_bits: int = 64) -> int:
    """Largest Hamming distance whose similarity reaches the threshold."""
    return max(d for d in range(hash_bits + 1) if d == 0 or 1.0 - d / hash_bits >= threshold)


def key_schemes(
    distance: int, rows: int, other: int | None = None, *, num_bands: int = 8, hash_bits: int = 64
) -> list[KeyScheme]:
    """Exact key schemes from the cheapest for this many rows to ever longer keys.

    ``other`` is the size of the second side; without it the join is within one set.

    The estimate weighs rows shuffled against candidate pairs. Bits of text fingerprints
    are correlated, so a key is credited with about two thirds of its length.
    """
    options = [KeyScheme(num_bands, max(1, num_bands - distance))]
    options += [KeyScheme(distance + r, r) for r in range(1, 7) if distance + r <= min(hash_bits, 24)]
    options = [o for o in dict.fromkeys(options) if o.keys <= MAX_KEYS]

    def cost(o: KeyScheme) -> float:
        compared = rows * rows / 2 if other is None else rows * other
        candidates = compared / 2 ** (o.key_bits(hash_bits) * 0.65)
        return o.keys * (ROW_COST * (rows + (other or 0)) + candidates)

    best = min(options, key=cost)
    finer = sorted(
        (o for o in options if o.key_bits(hash_bits) > best.key_bits(hash_bits)),
        key=lambda o: o.key_bits(hash_bits),
    )
    return [best, *finer]


def explode_keys(side: DataFrame, scheme: KeyScheme, hash_bits: int) -> DataFrame:
    """Every row once per block key of its ``fp``: all its columns, k (the blocks chosen) and v (their bits)."""
    keys = F.array(
        *[
            F.struct(F.lit(chosen).alias("k"), F.lit(mask).alias("mask"))
            for chosen, mask in block_keys(scheme.blocks, scheme.agree, hash_bits)
        ]
    )
    return side.select("*", F.explode(keys).alias("key")).select(
        *side.columns, F.col("key.k").alias("k"), F.col("fp").bitwiseAND(F.col("key.mask")).alias("v")
    )


def _keyed(side: DataFrame, scheme: KeyScheme, hash_bits: int) -> DataFrame:
    return explode_keys(side.select("fp"), scheme, hash_bits)


def _agreeing_blocks(difference: Column, blocks: int, hash_bits: int) -> Column:
    """Bit set of the blocks in which two fingerprints do not differ."""
    total = F.lit(0)
    for i, mask in enumerate(block_masks(blocks, hash_bits)):
        same = difference.bitwiseAND(F.lit(signed64(mask))) == 0
        total = total + F.when(same, 1 << i).otherwise(0)
    return total


def is_near(difference: Column, distance: int, num_bands: int, hash_bits: int) -> Column:
    """Whether two fingerprints that differ in these bits match: close enough, and one band in common."""
    close = F.bit_count(difference) <= distance
    if distance < num_bands:  # then some band has to agree
        return close
    bands = [difference.bitwiseAND(F.lit(signed64(m))) == 0 for m in block_masks(num_bands, hash_bits)]
    shares_band = bands[0]
    for band in bands[1:]:
        shares_band = shares_band | band
    return close & shares_band


def under_lowest_key(difference: Column, k: Column, scheme: KeyScheme, hash_bits: int) -> Column:
    """Whether ``k`` is the lowest of the keys that a pair shares, so that it is kept once.

    Among the blocks up to the key's last block, none but the key's own blocks agree.
    """
    smear = k
    for shift in (1, 2, 4, 8, 16):
        smear = smear.bitwiseOR(F.shiftright(smear, shift))
    agreeing = _agreeing_blocks(difference, scheme.blocks, hash_bits)
    return F.bit_count(agreeing.bitwiseAND(smear)) == scheme.agree


def _join(left: DataFrame, right: DataFrame, scheme: KeyScheme, distance: int, num_bands: int, hash_bits: int, self_join: bool) -> DataFrame:
    a = left.withColumnRenamed("fp", "fp_a")
    b = right.select(F.col("fp").alias("fp_b"), "k", "v")
    pairs = a.join(b, ["k", "v"])
    if self_join:
        pairs = pairs.filter(F.col("fp_a") < F.col("fp_b"))
    difference = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    pairs = pairs.filter(is_near(difference, distance, num_bands, hash_bits)).filter(under_lowest_key(difference, F.col("k"), scheme, hash_bits))
    return pairs.select("fp_a", "fp_b", F.bit_count(difference).alias("distance"))


def _crowded(left: DataFrame, right: DataFrame, self_join: bool, limit: int) -> DataFrame:
    """Keys whose join would compare more than ``limit`` squared pairs."""
    there = right.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    if self_join:
        return there.filter(F.col("n") > limit).select("k", "v")
    here = left.groupBy("k", "v").agg(F.count(F.lit(1)).alias("m"))
    work = F.col("m").cast("double") * F.col("n")
    return here.join(there, ["k", "v"]).filter(work > float(limit) * limit).select("k", "v")


def near_pairs(
    left: DataFrame,
    right: DataFrame | None = None,
    *,
    threshold: float = 0.90,
    num_bands: int = 8,
    hash_bits: int = 64,
    bucket_limit: int = 1 << 15,
    scheme: KeyScheme | None = None,
) -> DataFrame:
    """All pairs of distinct fingerprints that share a band and reach the similarity threshold.

    Inputs have one column ``fp`` of distinct fingerprints and should be materialised.
    Without ``right`` the pairs are unordered (fp_a < fp_b) within ``left``; with it,
    every (left, right) pair including equal fingerprints. Output: fp_a, fp_b, distance.

    A ``left`` side small enough to broadcast with its keys (checked by count) is probed
    while ``right`` is scanned; ``right`` is then neither shuffled nor copied and may hold
    a fingerprint several times (its pairs repeat as often).

    All other pairs come from :func:`block_pairs`: a fingerprint is shuffled once per block, and more
    than ``bucket_limit`` of them that share a block are compared in slices.

    With a ``scheme`` its keys are joined. Keys shared by more than ``bucket_limit`` fingerprints (between two sets: by more than
    its square in pairs) are not joined directly then.
    Their fingerprints go on to a scheme with longer keys, which is exact by itself, so
    no pair is lost and a crowded bucket does not cost its square.
    """
    if hash_bits % num_bands:
        raise ValueError(f"{num_bands} bands do not divide {hash_bits} bits evenly")
    distance = max_distance(threshold, hash_bits)
    self_join = right is None
    sizes = [left.count()] if self_join else [left.count(), right.count()]
    rows = max(sizes)
    schemes = key_schemes(distance, *sizes, num_bands=num_bands, hash_bits=hash_bits)
    if scheme is not None:
        bits = scheme.key_bits(hash_bits)
        schemes = [scheme, *[s for s in key_schemes(distance, 1, num_bands=num_bands, hash_bits=hash_bits) if s.key_bits(hash_bits) > bits]]
    elif not self_join and sizes[0] * schemes[0].keys <= BROADCAST_ROWS and sizes[0] <= sizes[1]:
        probe = F.broadcast(_keyed(left, schemes[0], hash_bits))
        return _join(probe, _keyed(right, schemes[0], hash_bits), schemes[0], distance, num_bands, hash_bits, False)
    else:
        return block_pairs(left, right, sum(sizes), distance=distance, num_bands=num_bands, hash_bits=hash_bits, slice_rows=bucket_limit)
    found = []
    for level, current in enumerate(schemes):
        keyed_left = _keyed(left, current, hash_bits)
        keyed_right = keyed_left if self_join else _keyed(right, current, hash_bits)
        last = level == len(schemes) - 1 or rows <= bucket_limit
        hot = None
        if not last:
            hot = materialize(_crowded(keyed_left, keyed_right, self_join, bucket_limit))
            hot_rows = hot.count()
            if hot_rows == 0:
                hot, last = None, True
        if hot is None:
            found.append(_join(keyed_left, keyed_right, current, distance, num_bands, hash_bits, self_join))
            break
        hot_keys = F.broadcast(hot) if hot_rows <= BROADCAST_ROWS else hot
        cold = keyed_left.join(hot_keys, ["k", "v"], "left_anti")
        cold_right = keyed_right.join(hot_keys, ["k", "v"], "left_anti")
        found.append(_join(cold, cold_right, current, distance, num_bands, hash_bits, self_join))
        left = materialize(keyed_left.join(hot_keys, ["k", "v"], "left_semi").select("fp").distinct())
        if not self_join:
            right = materialize(keyed_right.join(hot_keys, ["k", "v"], "left_semi").select("fp").distinct())
        rows = left.count() if self_join else max(left.count(), right.count())
    if len(found) == 1:
        return found[0]
    merged = found[0]
    for part in found[1:]:
        merged = merged.unionByName(part)
    return merged.distinct()


def near_pairs_in_time(
    groups: DataFrame, *, threshold: float = 0.90, num_bands: int = 8, hash_bits: int = 64, bucket_limit: int = 2048
) -> DataFrame:
    """The pairs of :func:`near_pairs` whose fingerprints occur in one time bucket or in two consecutive ones.

    ``groups`` (fp, bucket) is materialised and has each pair of them once. Within a TTL there are mostly few
    messages, so all fingerprints of a bucket and of the one before are compared: no fingerprint is copied once per block key.
    Those of buckets that meet more than ``bucket_limit`` go through :func:`near_pairs`, which finds all their pairs.
    """
    distance = max_distance(threshold, hash_bits)
    own = groups.select("fp", "bucket")
    met = own.select(F.col("fp").alias("other"), F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"))
    crowds = materialize(met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_limit).select("bucket"))
    difference = F.col("fp").bitwiseXOR(F.col("other"))
    close = own.join(crowds, "bucket", "left_anti").join(met, "bucket").filter(F.col("fp") != F.col("other")).filter(is_near(difference, distance, num_bands, hash_bits))
    pairs = close.select(F.least("fp", "other").alias("fp_a"), F.greatest("fp", "other").alias("fp_b"), F.bit_count(difference).alias("distance"))
    if not crowds.isEmpty():
        crowded = materialize(met.join(crowds, "bucket", "left_semi").select(F.col("other").alias("fp")).distinct())
        pairs = pairs.unionByName(near_pairs(crowded, threshold=threshold, num_bands=num_bands, hash_bits=hash_bits))
    return pairs.distinct()


def bucket_representatives(
    groups: DataFrame, *, threshold: float = 0.90, num_bands: int = 8, hash_bits: int = 64, ttl: bool = False
) -> DataFrame:
    """Per (fp, bucket): an early near duplicate in the bucket and a late one in the bucket before.

    ``groups`` has fp, bucket, first, last, n, where first and last are
    (ts, message_id, fp). Fingerprints sharing a key are represented by the earliest and
    the latest message among them, and each fingerprint is compared with the
    representatives of its keys and with itself, so the work is linear however crowded a
    key is. What is found is a true near duplicate; one that is missed must be looked up
    with :func:`near_pairs`. Output: fp, bucket, first, before, n.
    """
    distance = max_distance(threshold, hash_bits)
    scheme = KeyScheme(num_bands, max(1, num_bands - distance))
    masks = block_keys(scheme.blocks, scheme.agree, hash_bits)
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(mask).alias("mask")) for k, mask in masks])
    keyed = groups.select("*", F.explode(keys).alias("key")).select(
        "fp", "bucket", "first", "last", F.col("key.k").alias("k"), F.col("fp").bitwiseAND(F.col("key.mask")).alias("v")
    )
    order_type = groups.schema["first"].dataType
    none = F.lit(None).cast(order_type)
    same = F.struct(F.col("bucket"), F.col("first"), none.alias("before"))
    later = F.struct((F.col("bucket") + 1).alias("bucket"), none.alias("first"), F.col("last").alias("before"))
    parts = F.array(same, later) if ttl else F.array(same)
    entries = keyed.select("k", "v", F.explode(parts).alias("p")).select("k", "v", "p.*")
    # weight 1 per fingerprint summary of the bucket itself: the rows that will look it up
    faces = materialize(
        entries.groupBy("k", "v", "bucket").agg(
            F.min("first").alias("first"), F.max("before").alias("before"), F.count("first").alias("rows")
        ).filter(F.col("rows") > 0)
    )
    met = lookup_join(keyed.select("fp", "bucket", "k", "v"), faces, ["k", "v", "bucket"], weight="rows", how="inner")

    def close(face: str) -> Column:
        near = F.bit_count(F.col("fp").bitwiseXOR(F.col(face)["fp"])) <= distance
        return F.when(near, F.col(face))

    found = met.select("fp", "bucket", close("first").alias("first"), close("before").alias("before"), F.lit(0).cast("long").alias("n"))
    own = groups.select(
        "fp", F.explode(F.array(
            F.struct(F.col("bucket"), F.col("first"), none.alias("before"), F.col("n")),
            *([F.struct((F.col("bucket") + 1).alias("bucket"), none.alias("first"), F.col("last").alias("before"), F.lit(0).cast("long").alias("n"))] if ttl else []),
        )).alias("p"),
    ).select("fp", "p.*")
    return (
        found.unionByName(own).groupBy("fp", "bucket")
        .agg(F.min("first").alias("first"), F.max("before").alias("before"), F.sum("n").alias("n"))
        .filter(F.col("n") > 0)
    )
