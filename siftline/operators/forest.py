"""Connected groups of near fingerprints from a sparse set of links, without listing pairs.

A crowd of n variants of one text has up to n² near pairs, but n - 1 links connect it. Links are
made between each fingerprint and one representative of each of its block keys, if the two are
really near; that is at most as many rows as there are keyed fingerprints. What may be missing
then are links between different groups that share a key. Only these are looked up: in each key the members
outside its largest group are compared with all members of other groups. Where even that is too much
work the key's fingerprints go on to longer keys, which find every near pair as well.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from siftline.operators.blocks import block_count, block_links, in_blocks
from siftline.operators.components import connected_components
from siftline.operators.neighbours import explode_keys, is_near, key_schemes, max_distance
from siftline.operators.skew import lookup_join
from siftline.session import materialize


def _order(seed: int) -> Column:
    """A different order of fingerprints for every round, so that representatives change."""
    return F.xxhash64(F.lit(seed), F.col("fp"))


def representative_links(keyed: DataFrame, near, rounds: int) -> Iterator[DataFrame]:
    """Per round (u, v): each fingerprint and the representative of each of its keys, where they are near.

    One row per key and fingerprint goes into a round's join, however crowded the key is.
    """
    for seed in range(rounds):
        faces = keyed.groupBy("k", "v").agg(F.min_by("fp", _order(seed)).alias("face"), F.count(F.lit(1)).alias("n"))
        met = lookup_join(keyed, materialize(faces.filter("n > 1")), ["k", "v"], weight="n", how="inner")
        yield met.filter((F.col("fp") != F.col("face")) & near(F.col("fp").bitwiseXOR(F.col("face")))).select(
            F.col("fp").alias("u"), F.col("face").alias("v")
        ).distinct()


def relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (fp, blast) after groups joined by links between labels (u, v) were merged; the smallest label stays."""
    links = materialize(links)
    if links.isEmpty():
        return labels
    merged = connected_components(links)
    return materialize(
        labels.join(merged.withColumnRenamed("node", "blast"), "blast", "left").select("fp", F.coalesce("component", "blast").alias("blast"))
    )


def near_components(
    fps: DataFrame, known: DataFrame | None = None, *, threshold: float = 0.90, num_bands: int = 8, hash_bits: int = 64, rounds: int = 3,
    key_work: int = 1 << 24, block_rows: int = 1 << 17,
) -> DataFrame:
    """fp, blast: the smallest fingerprint (or known label) that a chain of near fingerprints leads to.

    ``fps`` holds distinct fingerprints in a column ``fp``. ``known`` (fp, blast) are groups that
    are known to be connected already; links inside them are not looked for again.
    Fingerprints that share a block are searched together, see :func:`block_links`. Only where more than ``block_rows`` share
    one are their links looked for by keys and representatives:
    ``rounds`` are the representatives tried per key; ``key_work`` is the number of comparisons in one key above
    which its fingerprints go on to longer keys. All three change the work, not the result.
    """
    distance = max_distance(threshold, hash_bits)
    nodes = materialize(fps.select("fp").distinct())
    labels = nodes.withColumn("blast", F.col("fp"))
    if known is not None:
        labels = materialize(nodes.join(known.select("fp", "blast"), "fp", "left").select("fp", F.coalesce("blast", "fp").alias("blast")))

    def near(difference: Column) -> Column:
        return is_near(difference, distance, num_bands, hash_bits)

    def moved(links: DataFrame) -> DataFrame:
        """Links between labels for links between fingerprints."""
        ends = links.join(labels.select(F.col("fp").alias("u"), F.col("blast").alias("a")), "u")
        ends = ends.join(labels.select(F.col("fp").alias("v"), F.col("blast").alias("b")), "v").filter("a <> b")
        return ends.select(F.col("a").alias("u"), F.col("b").alias("v"))

    blocks = block_count(distance, num_bands)
    keyed = in_blocks(nodes, blocks, hash_bits)
    # Few: a value that is listed has more than ``block_rows`` rows.
    crowds = materialize(keyed.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block_rows).select("k", "v"))
    links = block_links(keyed.join(F.broadcast(crowds), ["k", "v"], "left_anti"), nodes.count() * blocks, distance=distance).distinct()
    labels = relabel(labels, links if known is None else moved(links).distinct())
    if crowds.isEmpty():
        return labels
    inside = materialize(keyed.join(F.broadcast(crowds), ["k", "v"], "left_semi").select("fp").distinct())
    schemes = key_schemes(distance, inside.count(), num_bands=num_bands, hash_bits=hash_bits)
    for level, scheme in enumerate(schemes):
        links = None
        keyed = materialize(explode_keys(inside.select("fp"), scheme, hash_bits))
        for found in representative_links(keyed, near, rounds):
            links = found if links is None else links.unionByName(found)
        labels = relabel(labels, moved(links).distinct())

        own = materialize(explode_keys(inside.select("fp").join(labels, "fp"), scheme, hash_bits))
        per_group = own.groupBy("k", "v", "blast").agg(F.count(F.lit(1)).alias("n"))
        per_key = per_group.groupBy("k", "v").agg(F.sum("n").alias("n"), F.max(F.struct("n", "blast")).alias("most"), F.count(F.lit(1)).alias("groups"))
        mixed = materialize(
            per_key.filter("groups > 1").select("k", "v", F.col("most.blast").alias("main"), ((F.col("n") - F.col("most.n")).cast("double") * F.col("n")).alias("work"))
        )
        last = level == len(schemes) - 1
        light = mixed if last else mixed.filter(F.col("work") <= key_work)
        # Every pair across groups has a member outside the key's largest group.
        open_rows = own.join(light, ["k", "v"])
        minority = open_rows.filter(F.col("blast") != F.col("main")).select("k", "v", "fp", "blast")
        others = open_rows.select("k", "v", F.col("fp").alias("other"), F.col("blast").alias("theirs"))
        across = minority.join(others, ["k", "v"]).filter(F.col("blast") != F.col("theirs")).filter(near(F.col("fp").bitwiseXOR(F.col("other"))))
        labels = relabel(labels, across.select(F.col("blast").alias("u"), F.col("theirs").alias("v")).distinct())
        heavy = mixed.filter(F.col("work") > key_work)
        if last or heavy.isEmpty():
            break
        inside = materialize(own.join(heavy.select("k", "v"), ["k", "v"], "left_semi").select("fp").distinct())
    return labels
