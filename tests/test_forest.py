"""Groups of near fingerprints from sparse links, at once and batch by batch, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.operators import forest as G, outbreak as O
from siftline.operators.blast_index import BlastIndex
from siftline.operators.neighbours import KeyScheme, explode_keys, is_near, near_pairs
from siftline.operators.outbreak_index import IndexOptions
from siftline.session import materialize


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def variants(n, bases, flips, seed):
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(bases)]
    out = set()
    while len(out) < n:
        fp = rnd.choice(centres)
        for _ in range(rnd.randrange(0, flips + 1)):
            fp ^= 1 << rnd.randrange(64)
        out.add(signed(fp))
    return sorted(out)


def by_hand(fps, distance, bands=None):
    """Smallest fingerprint of every connected group."""
    a = np.array(fps, np.int64).view(np.uint64)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(a)):
        diff = a ^ a[i]
        near = np.bitwise_count(diff) <= distance
        if bands:
            width = 64 // bands
            near &= np.any([(diff >> np.uint64(b * width)) & np.uint64((1 << width) - 1) == 0 for b in range(bands)], axis=0)
        for j in np.flatnonzero(near):
            x, y = root(i), root(int(j))
            parent[max(x, y)] = min(x, y)
    return {fp: fps[root(i)] for i, fp in enumerate(fps)}


@pytest.mark.parametrize("threshold, distance, work, rounds", [(0.90, 6, 1 << 24, 3), (0.90, 6, 50, 1), (0.85, 9, 200, 1)])
def test_components_equal_brute_force(spark, threshold, distance, work, rounds):
    fps = variants(700, 25, 9, 3)
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    got = {r["fp"]: r["blast"] for r in G.near_components(df, threshold=threshold, rounds=rounds, key_work=work).collect()}
    assert got == by_hand(fps, distance, 8)


def test_known_groups_are_extended(spark):
    fps = variants(400, 10, 8, 4)
    want = by_hand(fps, 6)
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    first = G.near_components(df.filter(F.pmod(F.xxhash64("fp"), F.lit(2)) == 0))
    assert {r["fp"]: r["blast"] for r in G.near_components(df, first).collect()} == want
    assert G.near_components(df.limit(0)).count() == 0


def test_links_of_a_crowd_grow_linearly(spark):
    """50,000 variants of one text: rows of the joins are counted, pairs would be a thousand million."""
    counts = {}
    for n in (25_000, 50_000):
        fps = materialize(spark.createDataFrame([(f,) for f in variants(n, 1, 4, 5)], "fp bigint"))
        keyed = materialize(explode_keys(fps, KeyScheme(8, 2), 64))
        links = sum(x.count() for x in G.representative_links(keyed, lambda d: is_near(d, 6, 8, 64), 3))
        counts[n] = links
        assert links <= 3 * keyed.count()
        labels = G.near_components(fps)
        assert labels.count() == n and labels.select("blast").distinct().count() == 1
    assert counts[50_000] <= 2.5 * counts[25_000]


def test_batches_give_what_one_run_gives(spark, tmp_path):
    fps = variants(300, 8, 7, 6)
    rows = [(i, fp) for i, fp in enumerate(fps)] + [(1000 + i, fps[i]) for i in range(0, 300, 7)]
    df = materialize(spark.createDataFrame(rows, "message_id bigint, fp bigint").withColumn("ts", F.timestamp_seconds("message_id")))
    groups = materialize(O.fingerprint_groups(df))
    want = {tuple(r) for r in O.blast_summary(groups, O.blast_labels(groups)).collect()}
    index = BlastIndex(spark, str(tmp_path / "b"), IndexOptions(shards=4))
    for batch in range(3):
        part = materialize(df.filter(F.pmod(F.xxhash64("message_id"), F.lit(3)) == batch))
        assert index.add(part, batch=batch) and not index.add(part, batch=batch)
        if batch == 1:
            assert index._read("relabels").count() > 0
            index.compact()
    assert index.add(materialize(df.limit(0)), batch=4)
    assert {r["fp"]: r["blast"] for r in index.labels().collect()} == by_hand(fps, 6)
    assert {tuple(r) for r in O.blast_summary(index.groups(), index.labels()).collect()} == want


def test_batch_repeated_after_half_a_commit(spark, tmp_path):
    fps = variants(120, 3, 5, 7)
    df = materialize(spark.createDataFrame(list(enumerate(fps)), "message_id bigint, fp bigint").withColumn("ts", F.timestamp_seconds("message_id")))
    index = BlastIndex(spark, str(tmp_path / "b"), IndexOptions(shards=4))
    index.index.add(df, batch=0)  # messages were stored, labels were not
    assert index.add(df, batch=0)
    assert {r["fp"]: r["blast"] for r in index.labels().collect()} == by_hand(fps, 6)
    assert index.groups().agg(F.sum("n")).first()[0] == 120
