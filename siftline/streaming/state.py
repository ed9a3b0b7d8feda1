"""Outbreak detection with keyed state: every block key remembers the fingerprints of its last TTL.

A message waits in the state of its keys until the watermark has passed its time. Then all earlier
messages have arrived, in whatever order, and it is compared with what its keys remember; so verdicts
equal the batch ones for every message that is not later than the watermark. What is remembered
per key is one entry per fingerprint, its latest message; event-time timers remove it one TTL after that.
The keys of one choice of blocks share a fixed number of states, as every state costs calls of its own in every
micro-batch; inside a state each key is still looked up by itself. A state has one timer, for what it has to do next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from siftline.functions.hashing import block_keys
from siftline.operators.neighbours import KeyScheme, max_distance
from siftline.operators.outbreak import fingerprint_messages

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Key of rows that only move the watermark on.
CLOCK = -1


class KeyMemory(StatefulProcessor):
    """State of some block keys: messages that wait for their time, and the fingerprints remembered.

    ``masks`` has the fingerprint mask of every choice of blocks.
    """

    def __init__(self, ttl_seconds: int, distance: int, lowest: int, id_type: str, masks: dict[int, int] | None = None):
        self.ttl, self.distance, self.lowest, self.id_type = ttl_seconds * 1_000_000, distance, lowest, id_type
        self.masks = masks or {}

    def init(self, handle) -> None:
        lists = "ts array<bigint>, id array<{0}>, fp array<bigint>".format(self.id_type)
        self.handle = handle
        self.waiting = handle.getValueState("waiting", lists)
        self.known = handle.getValueState("known", lists)

    @staticmethod
    def _get(state) -> tuple[list, list, list]:
        row = state.get()
        return tuple(list(x) for x in row) if row is not None else ([], [], [])

    @staticmethod
    def _put(state, rows: tuple[list, list, list]) -> None:
        if rows[0]:
            state.update(tuple(rows))
        else:
            state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows]
        if key[0] != CLOCK:
            waiting = self._get(self.waiting)
            for frame in frames:
                for held, name in zip(waiting, ("micros", "message_id", "fp")):
                    held += frame[name].tolist()
            self.handle.registerTimer(min(-(-int(t) // 1000) for frame in frames for t in frame["micros"]))
            self._put(self.waiting, waiting)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        ts, ids, fps = self._get(self.waiting)
        due = [i for i in range(len(ts)) if ts[i] <= now]
        mask = self.masks[key[0]]
        known: dict[int, dict[int, tuple]] = {}  # per block key, oldest entry first
        for t, i, f in sorted(zip(*self._get(self.known))):
            known.setdefault(f & mask, {})[f] = (t, i)
        out = []
        for i in sorted(due, key=lambda i: (ts[i], ids[i])):
            own = known.setdefault(fps[i] & mask, {})
            while own and own[oldest := next(iter(own))][0] + self.ttl <= ts[i]:
                del own[oldest]
            out += self._judge(key, ts[i], ids[i], fps[i], own)
            own.pop(fps[i], None)  # renewed, it goes to the end
            own[fps[i]] = (ts[i], ids[i])
        left = sorted(set(range(len(ts))) - set(due))
        if due:
            self._put(self.waiting, ([ts[i] for i in left], [ids[i] for i in left], [fps[i] for i in left]))
        kept = [(t, i, f) for own in known.values() for f, (t, i) in own.items() if t + self.ttl > now]
        coming = [ts[i] for i in left] + [t + self.ttl for t, _, _ in kept]
        if coming:
            self.handle.registerTimer(-(-min(coming) // 1000))
        self._put(self.known, tuple(list(x) for x in zip(*kept)) if kept else ([], [], []))
        if out:
            yield pd.DataFrame(out, columns=["message_id", "micros", "fingerprint", "distance", "match_id"]).astype({"distance": "Int32"})

    def _judge(self, key, ts, message_id, fp, known: dict) -> list[tuple]:
        """One row per distance met; under the lowest key also one that only says that the message was judged."""
        rows = [(message_id, ts, fp, None, None)] if key[0] == self.lowest else []
        if known:
            others = np.fromiter(known, np.int64, len(known))
            bits = np.bitwise_count((others ^ np.int64(fp)).view(np.uint64))  # of signed numbers it would count the absolute value
            best: dict[int, tuple] = {}
            for other, d in zip(others[bits <= self.distance].tolist(), bits[bits <= self.distance].tolist()):
                when, who = known[other]
                if ts - when < self.ttl:
                    best[d] = max(best.get(d, (when, who)), (when, who))
            rows += [(message_id, ts, fp, d, best[d][1]) for d in best]
        return rows

    def close(self) -> None:
        pass


def outbreak_events(
    messages: DataFrame, *, ttl_seconds: int, watermark: str, id_col: str = "message_id", text_col: str = "text", ts_col: str = "ts",
    threshold: float = 0.90, num_bands: int = 8, hash_bits: int = 64, hash_fn: str = "blake2b", shards: int = 64,
) -> DataFrame:
    """A stream of what each key found about each message: message_id, micros, fingerprint, distance, match_id.

    Rows behind the watermark are dropped by Spark and get no verdict. A row without an id moves the watermark on
    and is nothing else; a source that ends sends one to have its last messages judged.
    """
    scheme = KeyScheme(num_bands, max(1, num_bands - max_distance(threshold, hash_bits)))
    masks = block_keys(scheme.blocks, scheme.agree, hash_bits)
    id_type = messages.schema[id_col].dataType.simpleString()
    fps = fingerprint_messages(messages.withWatermark(ts_col, watermark), id_col=id_col, text_col=text_col, ts_col=ts_col, hash_bits=hash_bits, hash_fn=hash_fn)
    # A null among them would make Pandas hold the fingerprints of a state as doubles.
    shard = lambda mask: F.when(F.col("fp").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(F.col("fp").bitwiseAND(F.lit(mask))), F.lit(shards))).cast("bigint")
    keys = F.array(*[F.struct(F.lit(k).alias("k"), shard(mask).alias("shard")) for k, mask in masks])
    clock = F.array(F.struct(F.lit(CLOCK).alias("k"), F.lit(0).cast("bigint").alias("shard")))
    keyed = fps.select("ts", "message_id", "fp", F.unix_micros("ts").alias("micros"), F.explode(F.when(F.col("message_id").isNull(), clock).otherwise(keys)).alias("key"))
    memory = KeyMemory(ttl_seconds, max_distance(threshold, hash_bits), masks[0][0], id_type, dict(masks))
    return keyed.select("ts", "message_id", "fp", "micros", "key.k", "key.shard").groupBy("k", "shard").transformWithStateInPandas(
        statefulProcessor=memory, outputStructType=f"message_id {id_type}, micros bigint, fingerprint bigint, distance int, match_id {id_type}",
        outputMode="Append", timeMode="EventTime",
    )


def verdicts(events: DataFrame, *, hash_bits: int = 64) -> DataFrame:
    """One row per message from what its keys found; all of it comes in one micro-batch, as it hangs on the watermark alone."""
    best = events.groupBy("message_id", "micros", "fingerprint", "distance").agg(F.max("match_id").alias("match_id"))
    level = F.when(F.col("distance").isNotNull(), F.struct("distance", "match_id"))
    found = best.groupBy("message_id", "micros", "fingerprint").agg(F.array_sort(F.collect_list(level)).alias("levels"))
    return found.select(
        "message_id", F.timestamp_micros("micros").alias("ts"), "fingerprint", (F.size("levels") > 0).alias("is_outbreak_candidate"),
        (F.lit(1.0) - F.get("levels", F.lit(0))["distance"] / F.lit(float(hash_bits))).alias("best_similarity"), "levels",
    )


def start_outbreak_state_stream(
    messages: DataFrame, out_path: str, checkpoint: str, *, ttl_seconds: int, watermark: str, hash_bits: int = 64, available_now: bool = True, **detection,
) -> StreamingQuery:
    """Verdicts of a stream under ``out_path``, one folder per micro-batch, which a replay overwrites."""
    spark = messages.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        verdicts(batch, hash_bits=hash_bits).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    events = outbreak_events(messages, ttl_seconds=ttl_seconds, watermark=watermark, hash_bits=hash_bits, **detection)
    writer = events.writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", checkpoint)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # the query takes its settings along when it starts
    try:
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
