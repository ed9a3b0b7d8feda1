"""The commit log and the stored index of known messages."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftline.operators import outbreak as O
from siftline.operators.outbreak_index import IndexOptions, OutbreakIndex
from siftline.session import materialize
from siftline.sources import tables as T
from siftline.sources.commits import CommitLog, LostRace, Part


def test_batches_are_committed_once(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "t"))
    schema = spark.createDataFrame([], "a int").schema
    assert log.read(schema).count() == 0 and log.snapshot().version == -1
    rows = spark.range(3).select(F.col("id").cast("int").alias("a"))
    assert log.append(rows, writer="w", batch=0) and not log.append(rows, writer="w", batch=0)
    assert log.append(rows, writer="w", batch=1) and not log.append(rows, writer="w", batch=0)
    assert log.append(rows, writer="other", batch=0) and log.append(rows) and log.append(rows)
    assert log.read(schema).count() == 15
    rows.write.parquet(log.folder("left-behind"))  # an attempt that never committed
    assert log.read(schema).count() == 15
    assert log.vacuum(older_than_seconds=3600) == [] and log.vacuum(older_than_seconds=-5) == ["left-behind"]
    assert log.append(rows.limit(1), writer="w", batch=2, replace=True) and log.read(schema).count() == 1
    with pytest.raises(LostRace):
        log.commit(remove=[Part("not-there")])


def test_two_writers_do_not_lose_each_other(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "t"))
    log.commit(add=[Part("a")], writer="x")
    stale = log.snapshot()
    assert log.commit(add=[Part("b")], writer="y")
    log.snapshot, fresh = iter_first(stale, log.snapshot), log.snapshot
    assert log.commit(add=[Part("c")], writer="z")  # its first try meets a number that is taken
    assert {p.name for p in fresh().parts} == {"a", "b", "c"} and fresh().version == 2


def iter_first(first, rest):
    left = [first]
    return lambda: left.pop() if left else rest()


def test_old_versions_go(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "t"))
    for i in range(25):
        log.commit(add=[Part(f"p{i}")], writer="w", batch=i)
    assert len(log._versions()) == 20 and len(log.snapshot().parts) == 25


def test_replayed_sinks_add_nothing(spark, tmp_path):
    path = str(tmp_path / "decisions")
    rows = spark.createDataFrame([("a", "spam", "o", "s"), ("b", "reklam", "o", "s")], "text string, label string, original_label string, original_source string")
    for _ in range(3):
        T.append_decisions(rows, path, batch=("bulk", 7))
    T.append_decisions(rows.limit(1), path, batch=("bulk", 8))
    assert T.read_decisions(spark, path).count() == 3
    sure = spark.createDataFrame([("t", "spam", "human_reviewed", "tr")], T.CONFIRMED_SCHEMA)
    assert [T.append_confirmed(sure, str(tmp_path / "c"), batch=("q", 1)) for _ in range(2)] == [True, False]
    assert T.read_confirmed(spark, str(tmp_path / "c")).count() == 1
    split = spark.createDataFrame([("t", {"a": "1"}, "train"), ("u", {}, "val")], "text string, extra map<string,string>, split string")
    assert T.write_splits(split, str(tmp_path / "s"), batch=("fit", 1)) and not T.write_splits(split, str(tmp_path / "s"), batch=("fit", 1))
    assert T.write_splits(split.limit(1), str(tmp_path / "s"), batch=("fit", 2))
    assert T.read_split(spark, str(tmp_path / "s")).count() == 1


def fingerprints(spark, n=240, seed=1):
    rnd = random.Random(seed)
    bases = [rnd.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(n):
        fp = rnd.choice(bases)
        for _ in range(rnd.randrange(0, 5)):
            fp ^= 1 << rnd.randrange(64)
        rows.append((i, rnd.randrange(0, 600), fp - (1 << 64) if fp >> 63 else fp))
    df = spark.createDataFrame(rows, "message_id bigint, s bigint, fp bigint")
    return df.select("message_id", F.timestamp_seconds("s").alias("ts"), "fp"), rows


def by_hand(rows, asked, known, ttl, distance=6):
    """Flag, and the best distance, of each asked message among the known ones and itself."""
    out = {}
    for i, s, fp in asked:
        near = [bin((fp ^ f) & (2**64 - 1)).count("1") for j, t, f in known if (t, j) < (s, i) and (ttl is None or s - t < ttl)]
        near = [d for d in near if d <= distance]
        out[i] = (bool(near), 1 - min(near) / 64 if near else None)
    return out


@pytest.mark.parametrize("ttl", [None, 90])
def test_index_equals_brute_force_batch_by_batch(spark, tmp_path, ttl):
    fps, rows = fingerprints(spark)
    index = OutbreakIndex(spark, str(tmp_path / "index"), IndexOptions(ttl_seconds=ttl, shards=8, fan_in=2))
    known = []
    for batch in range(4):  # arrival is not in time order
        own = [r for r in rows if r[0] % 4 == batch]
        part = materialize(fps.filter(F.col("message_id") % 4 == batch))
        known += own
        for replay in range(2):  # a replayed batch gives the same and adds nothing
            got = {r["message_id"]: (r["is_outbreak_candidate"], r["best_similarity"]) for r in index.verdicts(part, before_batch=batch).collect()}
            assert got == by_hand(rows, own, known, ttl), (batch, replay)
            assert index.add(part, batch=batch) == (replay == 0)
        index.compact(keep_batch=batch)
    assert len(index.log.snapshot().parts) < 4
    pairs = {(r["message_id"], r["similar_id"], r["similarity"]) for r in index.similar(fps).collect()}
    want = {
        (i, j, 1 - d / 64) for i, s, fp in rows for j, t, f in rows
        if (t, j) < (s, i) and (ttl is None or s - t < ttl) and (d := bin((fp ^ f) & (2**64 - 1)).count("1")) <= 6
    }
    assert pairs == want and index.similar(fps).count() == len(want)


def test_lookup_reads_only_its_folders(spark, tmp_path):
    fps, rows = fingerprints(spark, 400)
    index = OutbreakIndex(spark, str(tmp_path / "index"), IndexOptions(ttl_seconds=30, shards=16))
    index.add(fps, batch=0)
    one = materialize(fps.orderBy(F.desc("ts")).limit(1))
    groups = O.fingerprint_groups(one, ttl_seconds=30)
    plan = index.lookup(groups)._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^]]*)\]", plan)
    assert any("bucket" in f and "shard" in f for f in filters), plan
    want = {tuple(r) for r in index.lookup(groups).collect()}
    bucket = groups.first()["bucket"]
    shards = {r["shard"] for r in index._keyed(groups, "bucket").select("shard").distinct().collect()}
    spoilt = 0
    for path in (tmp_path / "index").glob("_parts/*/keys/bucket=*/shard=*/*.parquet"):
        at, shard = (int(re.search(rf"{name}=(\d+)", str(path))[1]) for name in ("bucket", "shard"))
        if at not in (bucket, bucket - 1) or shard not in shards:
            path.write_bytes(b"unreadable")
            path.with_name(f".{path.name}.crc").unlink()
            spoilt += 1
    assert spoilt > 200 and {tuple(r) for r in index.lookup(groups).collect()} == want and want
    assert index.entries_for(groups.limit(0), index.parts()).count() == 0


def test_expiry_deletes_whole_folders(spark, tmp_path):
    fps, rows = fingerprints(spark)
    index = OutbreakIndex(spark, str(tmp_path / "index"), IndexOptions(ttl_seconds=60, shards=4))
    for batch in range(2):
        index.add(fps.filter(F.col("message_id") % 2 == batch), batch=batch)
    before = {r["message_id"] for r in index._read("members", index.parts()).collect()}
    assert len(before) == len(rows)
    assert index.expire(300) > 0
    left = {r["message_id"] for r in index._read("members", index.parts()).collect()}
    assert left == {i for i, s, _ in rows if s >= 300}
    assert index.expire(10_000) > 0 and index.parts() == []
    assert index.verdicts(materialize(fps)).count() == len(rows)
