"""The keyed-state outbreak stream on shuffled and late input, against the batch operator."""

import datetime as dt
import random

from pyspark.sql import functions as F

from siftline.operators.outbreak import detect_outbreaks
from siftline.streaming import jobs, state

SCHEMA = "message_id long, text string, ts timestamp"


def test_state_stream_equals_batch_and_forgets(spark, tmp_path):
    rnd = random.Random(1)
    bases = ["Depoda son urunler kaldi, gelin hemen bakin ", "toplanti yarin saat ucte buyuk salonda olacak ", "kargonuz yola cikti takip icin tiklayin "]
    start = dt.datetime(2024, 1, 1)
    rows = [(i, rnd.choice(bases) + rnd.choice(["", "x", "xy", "z!"]), start + dt.timedelta(seconds=20 * i // 3 * 3)) for i in range(45)]
    files = [[], [], []]
    for row in rows:  # shuffled, and every fifth message comes one file late
        files[min(2, row[0] // 15 + (row[0] % 5 == 0))].append(row)
    clock = [(None, "", start + dt.timedelta(seconds=2000)), ]
    late = [(900, bases[0], start + dt.timedelta(seconds=5))]
    for rows_ in [*files, clock, late]:
        rnd.shuffle(rows_)
        spark.createDataFrame(rows_, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = state.start_outbreak_state_stream(stream, out, str(tmp_path / "state"), ttl_seconds=200, watermark="400 seconds")
    jobs.finish(query, seconds=400)
    got = spark.read.parquet(out).collect()
    want = detect_outbreaks(spark.createDataFrame(rows, SCHEMA), ttl_seconds=200).collect()
    view = lambda r, d: (r["message_id"], r["is_outbreak_candidate"], r["best_similarity"], d)
    assert sorted(view(r, [x["distance"] for x in r["levels"]]) for r in got) == sorted(
        view(r, [round(64 * (1 - m["similarity"])) for m in r["matches"]]) for r in want
    )
    assert {r["is_outbreak_candidate"] for r in got} == {True, False}
    totals = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"])
    assert max(totals) > 100 and totals[-1] == 0, totals
    assert dropped > 0  # the last file's row


def test_distance_counts_the_sign_bit():
    memory = state.KeyMemory(100, 6, 3, "bigint")
    near = -(1 << 63) | 7
    rows = memory._judge((3, 0), 50_000_000, 2, 7, {near: (1_000_000, 1), 7 ^ 1: (2_000_000, 0)})
    # Both are one bit away; the later message stands for the distance.
    assert rows == [(2, 50_000_000, 7, None, None), (2, 50_000_000, 7, 1, 0)]
