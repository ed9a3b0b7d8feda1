"""What keeps the work of single steps in proportion to their input."""

import random
import unicodedata
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from siftline import queries
from siftline.functions import confusables, hashing
from siftline.operators import blocks, forest, neighbours, outbreak, outbreak_index, synth
from siftline.operators.dedup import corpus_summary
from siftline.plans.corpus import training_corpus
from siftline.schema import SPAM, record_columns
from siftline.session import materialize
from siftline.sources import files
from siftline.streaming import state


def test_counts_of_the_corpus_shuffle_no_text(spark):
    docs = spark.createDataFrame([(f"hemen tiklayin {i // 2} bonus", ("tr", "en", None)[i % 3]) for i in range(60)] + [(None, "tr")] * 2, "text string, lang string")
    seeds = docs.filter("text IS NOT NULL").select(*record_columns(F.col("text"), F.lit(SPAM), F.lit("synthetic_seed"), F.lit("tr")))
    sources = {"docs": lambda: docs.select(*record_columns(F.col("text"), F.lit(SPAM), F.lit("docs"), F.col("lang")))}
    slim = training_corpus(sources=sources, seeds=seeds, columns=("label", "lang"))
    whole = training_corpus(sources=sources, seeds=seeds)
    assert slim.columns == ["label", "lang"] and whole.columns[-1] == "root_text"
    rows = lambda df: sorted(map(str, corpus_summary(df, ("label", "lang")).collect()))
    assert rows(slim) == rows(whole)
    exchanged = [line for line in slim._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert exchanged and not any("text#" in line for line in exchanged)


def timed_fingerprints(spark, n=300):
    rnd = random.Random(5)
    bases = [rnd.getrandbits(63) for _ in range(4)]
    rows = []
    for i in range(n):
        fp = rnd.choice(bases)
        for _ in range(rnd.randrange(0, 6)):
            fp ^= 1 << rnd.randrange(63)
        rows.append((i, rnd.randrange(0, 2000), fp))
    return spark.createDataFrame(rows, "message_id bigint, s bigint, fp bigint").select("message_id", F.timestamp_seconds("s").alias("ts"), "fp"), rows


def test_pairs_within_a_ttl_are_looked_for_there_only(spark):
    fps, rows = timed_fingerprints(spark)
    groups = materialize(outbreak.fingerprint_groups(fps, ttl_seconds=100))
    at = {(fp, 1 * s // 100) for _, s, fp in rows}
    near = {(a, b) for a, i in at for b, j in at if a < b and abs(i - j) <= 1 and (a ^ b).bit_count() <= 6}
    found = {(r["fp_a"], r["fp_b"]) for r in neighbours.near_pairs_in_time(groups).collect()}
    anywhere = {(r["fp_a"], r["fp_b"]) for r in neighbours.near_pairs(materialize(groups.select("fp").distinct())).collect()}
    assert found == near and len(found) < len(anywhere) / 2
    crowded = {(r["fp_a"], r["fp_b"]) for r in neighbours.near_pairs_in_time(groups, bucket_limit=30).collect()}
    assert near <= crowded <= anywhere


def test_folders_of_a_part_do_not_grow_with_its_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(outbreak_index, "FOLDERS", 6)
    fps, rows = timed_fingerprints(spark, 160)  # 67 buckets of 30 seconds
    index = outbreak_index.OutbreakIndex(spark, str(tmp_path / "index"), outbreak_index.IndexOptions(ttl_seconds=30, shards=4))
    old = materialize(fps.filter("message_id < 80"))
    new = materialize(fps.filter("message_id >= 80"))
    index.add(old, batch=0)
    assert len(list((tmp_path / "index").glob("_parts/*/keys/bucket=*/shard=*"))) <= 7
    got = {r["message_id"]: r["is_outbreak_candidate"] for r in index.verdicts(new, before_batch=1).collect()}
    assert got == {i: any((t, j) < (s, i) and s - t < 30 and (fp ^ f).bit_count() <= 6 for j, t, f in rows) for i, s, fp in rows if i >= 80}
    assert index.expire(1000) > 0
    assert {r["message_id"] for r in index._read("members", index.parts()).collect()} == {i for i, s, _ in rows if i < 80 and s >= 990}


class Value:
    row = None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row

    def clear(self):
        self.row = None


def test_keys_of_one_state_stay_apart_and_share_a_timer():
    timers, values = [], {}
    memory = state.KeyMemory(100, 6, 3, "bigint", {3: 0xFFFF})
    memory.init(SimpleNamespace(getValueState=lambda name, _: values.setdefault(name, Value()), registerTimer=timers.append))
    second = 1_000_000
    rows = [(10 * second, 1, 7), (20 * second, 2, 7 | 1 << 40), (30 * second, 3, 6), (200 * second, 4, 7)]
    memory.handleInputRows((3, 5), iter([pd.DataFrame(rows, columns=["micros", "message_id", "fp"])]), None)
    assert timers == [10_000]

    def at(seconds):
        clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: seconds * 1000)
        return [tuple(r) for frame in memory.handleExpiredTimer((3, 5), clock, None) for r in frame[["message_id", "match_id"]].astype(object).where(lambda x: x.notna(), None).values.tolist()]

    # Message 3 is one bit away from the first, under another key.
    assert at(60) == [(1, None), (2, None), (2, 1), (3, None)] and timers == [10_000, 110_000]
    assert at(250) == [(4, None)] and timers[-1] == 300_000
    assert at(400) == [] and len(timers) == 3 and all(v.row is None for v in values.values())


def _fingerprints(seed):
    rnd = random.Random(seed)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for _ in range(140):
        fp = rnd.choice(fps)
        for bit in rnd.sample(range(64), rnd.randrange(1, 12)):
            fp ^= 1 << bit
        fps.append(fp)
    return sorted({hashing.signed64(fp) for fp in fps})


def _apart(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def _share(a, b):
    return any(not (a ^ b) & mask for mask in hashing.block_masks(8))


@pytest.mark.parametrize("distance, slice_rows", [(6, 3), (9, 4), (9, 1000)])
def test_pairs_by_blocks_equal_brute_force(spark, distance, slice_rows):
    """a fingerprint is shuffled once per block; crowded blocks are compared in slices."""
    fps = _fingerprints(distance)
    df = spark.createDataFrame([(f,) for f in [*fps, None]], "fp bigint")
    blocks_ = blocks.block_count(distance, 8)
    assert blocks.in_blocks(df, blocks_, 64).count() == blocks_ * len(fps)
    options = {"distance": distance, "num_bands": 8, "hash_bits": 64, "slice_rows": slice_rows}
    want = [(a, b, _apart(a, b)) for a in fps for b in fps if a < b and _apart(a, b) <= distance and (distance < 8 or _share(a, b))]
    assert want and sorted(map(tuple, blocks.block_pairs(df, None, len(fps), **options).collect())) == sorted(want)
    some = fps[::3]
    left = spark.createDataFrame([(f,) for f in some], "fp bigint")
    want = [(a, b, _apart(a, b)) for a in some for b in fps if _apart(a, b) <= distance and (distance < 8 or _share(a, b))]
    assert sorted(map(tuple, blocks.block_pairs(left, df, len(fps), **options).collect())) == sorted(want)


@pytest.mark.parametrize("block_rows", [2, 1 << 17])
def test_groups_by_blocks_equal_brute_force(spark, block_rows):
    """links come from the blocks; crowded ones go on to keys."""
    fps = _fingerprints(3)
    want, left = {}, set(fps)
    while left:
        reached, group = [min(left)], {min(left)}
        left -= group
        while reached:
            a = reached.pop()
            new = {b for b in left if _apart(a, b) <= 6}
            left, group = left - new, group | new
            reached += new
        want |= dict.fromkeys(group, min(group))
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    assert {r["fp"]: r["blast"] for r in forest.near_components(df, block_rows=block_rows).collect()} == want


def test_variants_that_are_only_counted_are_not_made(spark):
    """column pruning reaches the text of an adversarial row."""
    seeds = spark.createDataFrame([("hemen tiklayin", "spam", "s", "tr")], "text string, label string, source string, lang string").withColumn("extra", F.lit(None).cast("map<string,string>"))
    counted = synth.adversarial_set(seeds).groupBy("root_text").count()
    assert counted.first()["count"] == 2
    assert "lambda" not in counted._jdf.queryExecution().optimizedPlan().toString()


def test_a_folder_named_like_a_file_is_one(spark, tmp_path):
    """a corpus of many part files is found and read whole."""
    spark.range(40).selectExpr("concat('text ', id) AS text", "'ham' AS label").repartition(4).write.option("header", True).csv(f"{tmp_path}/raw/b c.csv")
    spark.range(1).selectExpr("'x' AS text", "'ham' AS label").write.option("header", True).csv(f"{tmp_path}/raw/other/a.csv")
    path = files.first_file(spark, f"{tmp_path}/raw", ("parquet", "csv"))
    assert path.endswith("/raw/b c.csv")
    assert files.read_labelled_csv(spark, path, text_columns=("text",), label_columns=("label",)).count() == 40
    (tmp_path / "raw" / "a.csv").write_text("text,label\nx,ham\n")
    assert files.first_file(spark, f"file://{tmp_path}/raw/", ("csv",)).endswith("/raw/a.csv")
    assert files.first_file(spark, f"{tmp_path}/none", ("csv",)) is None


def test_a_language_is_profiled_from_several_files(spark, tmp_path, monkeypatch):
    """no task writes or sorts a whole language."""
    spark.range(900).selectExpr("id AS doc_id", "concat('line one\n\"two\" ', id) AS text", "IF(id % 3 = 0, 'de', 'en') AS lang").write.parquet(f"{tmp_path}/in/documents.parquet")
    monkeypatch.setattr(queries.jobs, "scratch", lambda _: f"{tmp_path}/raw")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = {r["folder"]: tuple(r)[1:] for r in queries.QUERIES["raw_profile"](spark, f"{tmp_path}/in").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "raw" / "lang=en").glob("part-*"))) > 1
    assert rows["en"] == ("doc_id|text", 600, "1|2|4", None) and rows["de"] == ("doc_id|text", 300, "0|3|6", None)
    assert rows["zz"] == ("a|b", 2, None, "a quoted field is never closed") and rows["yy"] == (None, None, None, "no content")


def test_texts_reach_python_a_few_at_a_time(spark):
    """Arrow columns in slices, not a whole batch of strings; ASCII texts are not sent to be decomposed."""
    texts = ["plain", None, "", "é ﬁ", "Å", "漢 ½"] * 50
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    done = df.select("i", confusables.normalize_nfkd("t").alias("d"))
    assert [r["d"] for r in done.orderBy("i").collect()] == [None if t is None else unicodedata.normalize("NFKD", t) for t in texts]
    assert "octet_length" in done._jdf.queryExecution().optimizedPlan().toString()
    pandas_iterator = PythonEvalType.SQL_SCALAR_PANDAS_ITER_UDF
    plan = df.select(hashing.simhash("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and f", {pandas_iterator}" not in plan
