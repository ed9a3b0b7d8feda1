"""A stored index of known messages: later batches look up only the keys and times they need.

Every batch adds one part, a folder with two tables:

* ``keys``: the batch's distinct fingerprints, once per block key, in folders by time bucket and key shard;
* ``members``: its messages, in folders by time bucket and fingerprint shard.

A lookup reads the folders of the batch's own time buckets and of those before them, and of these
only the shards that its keys fall into. Buckets are as long as the TTL, so expiry
drops whole folders. A part that spans many buckets puts several, an era, into one folder and has fewer shards, so that
the number of its files does not grow with the time it spans. Parts are committed through a manifest (:mod:`siftline.sources.commits`): a batch sent again adds
nothing, and parts of one size class are merged into one of the next when there are enough.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftline.operators.neighbours import BROADCAST_ROWS, KeyScheme, explode_keys, is_near, max_distance, near_pairs, near_pairs_in_time, under_lowest_key
from siftline.operators.outbreak import attach_verdicts, fingerprint_groups, neighbourhood, time_bucket
from siftline.session import materialize, remove_folder
from siftline.sources.commits import CommitLog, Part, Snapshot

ORDER = "struct<ts:timestamp,message_id:{id}>"
#: Folders that one table of a part has about, whatever its span of time.
FOLDERS = 512


@dataclass(frozen=True)
class IndexOptions:
    """What an index is built for; a lookup has to use the same."""

    ttl_seconds: int | None = None
    threshold: float = 0.90
    num_bands: int = 8
    hash_bits: int = 64
    shards: int = 64
    #: Parts of one level that are merged into one of the next.
    fan_in: int = 8

    @property
    def distance(self) -> int:
        return max_distance(self.threshold, self.hash_bits)

    @property
    def scheme(self) -> KeyScheme:
        return KeyScheme(self.num_bands, max(1, self.num_bands - self.distance))


class OutbreakIndex:
    """Known messages below ``root``; ``id_type`` is the SQL type of message ids."""

    def __init__(self, spark: SparkSession, root: str, options: IndexOptions = IndexOptions(), *, id_type: str = "bigint"):
        self.spark, self.options = spark, options
        self.log = CommitLog(spark, root)
        order = ORDER.format(id=id_type)
        self.keys_schema = f"k int, v bigint, fp bigint, first {order}, last {order}, bucket bigint, shard int"
        self.members_schema = f"message_id {id_type}, ts timestamp, fp bigint, bucket bigint, shard int"

    # ---- writing

    def _shard(self, *columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.options.shards)).cast("int")

    def _layout(self, low: int, high: int) -> dict:
        """Buckets per folder and shards of a part with these time buckets."""
        span = high - low + 1
        return {"era": max(1, -(-span // FOLDERS)), "shards": max(1, min(self.options.shards, FOLDERS // span))}

    def _keyed(self, groups: DataFrame, *more: str) -> DataFrame:
        """fp, the given columns, k, v, shard: one row per block key."""
        keyed = explode_keys(groups.select("fp", *more), self.options.scheme, self.options.hash_bits)
        return keyed.withColumn("shard", self._shard("k", "v"))

    def _write(self, keys: DataFrame, members: DataFrame, part: Part) -> None:
        # The rebalance hint cuts crowded shards into several files and fills small ones.
        era, shards = part.note["era"], part.note["shards"]
        for name, rows in (("keys", keys), ("members", members)):
            rows = rows.withColumn("own_shard", F.col("shard")).withColumn("shard", F.col("shard") % shards)
            rows = rows.withColumn("own_bucket", F.col("bucket")).withColumn("bucket", F.floor(F.col("bucket") / era) * era)
            rows.hint("rebalance", "bucket", "shard").write.partitionBy("bucket", "shard").parquet(f"{self.log.folder(part)}/{name}")

    def add(self, fps: DataFrame, *, batch: int, writer: str = "batches") -> bool:
        """Remember a materialised batch (message_id, ts, fp); False if that batch was added before.

        A writer's batches are numbered upwards. The batch shows all at once or, if the job fails, not at all.
        """
        if self.log.has(writer, batch):
            return False
        groups = materialize(fingerprint_groups(fps, ttl_seconds=self.options.ttl_seconds))
        span = groups.agg(F.min("bucket"), F.max("bucket"), F.max(F.unix_micros("last.ts"))).first()
        if span[0] is None:
            return self.log.commit(writer=writer, batch=batch)
        keys = self._keyed(groups, "bucket", "first", "last")
        members = fps.select("message_id", "ts", "fp", time_bucket(self.options.ttl_seconds).alias("bucket")).withColumn("shard", self._shard("fp"))
        part = Part(self.log.new_part(f"{writer}-{batch}"), {"low": span[0], "high": span[1], "newest": span[2], "level": 0, "writer": writer, "batch": batch, **self._layout(span[0], span[1])})
        self._write(keys, members, part)
        if not self.log.commit(add=[part], writer=writer, batch=batch):
            remove_folder(self.spark, self.log.folder(part))
            return False
        return True

    def expire(self, before_ts: float) -> int:
        """Forget all time buckets that end before this time (epoch seconds); returns the number of folders deleted.

        The manifest moves the horizon first, so that readers never see half of a bucket.
        """
        if self.options.ttl_seconds is None:
            raise ValueError("an index without a TTL keeps everything")
        horizon = int(before_ts // self.options.ttl_seconds)
        gone = [p for p in self.log.snapshot().parts if p.note["high"] < horizon]
        self.log.commit(remove=gone, note=lambda old: {**old, "horizon": max(horizon, old.get("horizon", horizon))})
        folders = [self.log.folder(p) for p in gone]
        for part in self.log.snapshot().parts:
            era = part.note["era"]
            for low in range(part.note["low"] // era * era, min(horizon, part.note["high"] + 1) - era + 1, era):
                folders += [f"{self.log.folder(part)}/{name}/bucket={low}" for name in ("keys", "members")]
        for folder in folders:
            remove_folder(self.spark, folder)
        return len(folders)

    def compact(self, *, keep_batch: int | None = None) -> int:
        """Merge parts wherever a level has ``fan_in`` of them; returns the number of merges.

        A part is rewritten once per level, so the work per row grows with the logarithm of the
        number of batches. ``keep_batch``, the batch that could be sent again, is left as it is.
        """
        merges = 0
        while True:
            levels: dict[int, list[Part]] = {}
            for part in self.log.snapshot().parts:
                if keep_batch is None or part.note["batch"] < keep_batch:
                    levels.setdefault(part.note["level"], []).append(part)
            full = next((level for level in sorted(levels) if len(levels[level]) >= self.options.fan_in), None)
            if full is None:
                return merges
            parts = levels[full]
            low = max(min(p.note["low"] for p in parts), self.horizon())
            note = {"low": low, "high": max(p.note["high"] for p in parts), "newest": max(p.note["newest"] for p in parts),
                    "level": full + 1, "writer": parts[0].note["writer"], "batch": max(p.note["batch"] for p in parts)}
            note |= self._layout(low, note["high"])
            merged = Part(self.log.new_part(f"level-{full + 1}"), note)
            keys = self._read("keys", parts).groupBy("bucket", "shard", "k", "v", "fp").agg(F.min("first").alias("first"), F.max("last").alias("last"))
            self._write(keys, self._read("members", parts), merged)
            self.log.commit(add=[merged], remove=parts)
            merges += 1

    # ---- reading

    def horizon(self) -> int:
        return self.log.snapshot().note.get("horizon", -(1 << 62))

    def parts(self, *, before_batch: int | None = None, writer: str = "batches", snapshot: Snapshot | None = None) -> list[Part]:
        """Committed parts; with ``before_batch`` without that batch of the writer and later ones."""
        parts = (snapshot or self.log.snapshot()).parts
        return [p for p in parts if before_batch is None or p.note["writer"] != writer or p.note["batch"] < before_batch]

    def newest(self, parts: Sequence[Part]) -> float | None:
        """The time of the newest message in these parts (epoch seconds), from the manifest."""
        times = [p.note["newest"] for p in parts]
        return max(times) / 1e6 if times else None

    def _read(self, name: str, parts: Sequence[Part], low: int | None = None, high: int | None = None, shards: Sequence[int] | None = None) -> DataFrame:
        """Rows of the parts within the time buckets and the shards, by which folders are chosen."""
        schema = self.keys_schema if name == "keys" else self.members_schema
        horizon = self.horizon()
        near = [p for p in parts if (low is None or p.note["high"] >= low) and (high is None or p.note["low"] <= high) and p.note["high"] >= horizon]
        first = max(horizon, horizon if low is None else low)
        frames = []
        for part in near:
            stored = self.spark.read.schema(f"{schema}, own_bucket bigint, own_shard int").parquet(f"{self.log.folder(part)}/{name}")
            era = part.note["era"]
            stored = stored.filter(F.col("bucket") >= first // era * era).filter(F.col("own_bucket") >= first)
            if high is not None:
                stored = stored.filter(F.col("bucket") <= high).filter(F.col("own_bucket") <= high)
            if shards is not None:
                stored = stored.filter(F.col("shard").isin(sorted({s % part.note["shards"] for s in shards}))).filter(F.col("own_shard").isin(list(shards)))
            frames.append(stored.withColumn("bucket", F.col("own_bucket")).withColumn("shard", F.col("own_shard")).drop("own_bucket", "own_shard"))
        if not frames:
            return self.spark.createDataFrame([], schema)
        rows = frames[0]
        for frame in frames[1:]:
            rows = rows.unionByName(frame)
        return rows

    def entries_for(self, groups: DataFrame, parts: Sequence[Part]) -> DataFrame:
        """Key entries that the batch's keys lead to: its columns with those of the entry (near_fp, bucket, first, last).

        ``groups`` has fp and bucket. Only shards that the batch needs, and its time buckets and those before, are read.
        """
        wanted = groups.select("fp", F.col("bucket").alias("own_bucket"))
        keyed = self._keyed(wanted, "own_bucket")
        # Two numbers and at most ``shards`` small ones reach the driver; they prune the folders.
        span = groups.agg(F.min("bucket"), F.max("bucket"), F.count(F.lit(1))).first()
        if span[0] is None or not parts:
            return self.spark.createDataFrame([], f"fp bigint, own_bucket bigint, k int, v bigint, shard int, near_fp bigint, bucket bigint, first {self._order()}, last {self._order()}")
        touched = sorted(r["shard"] for r in keyed.select("shard").distinct().collect())
        stored = self._read("keys", parts, span[0] - 1, span[1], touched).withColumnRenamed("fp", "near_fp")
        if span[2] * self.options.scheme.keys <= BROADCAST_ROWS:
            keyed = F.broadcast(keyed)
        found = stored.join(keyed, ["shard", "k", "v"])
        return found.filter((F.col("bucket") == F.col("own_bucket")) | (F.col("bucket") == F.col("own_bucket") - 1))

    def _order(self) -> str:
        return self.keys_schema.split("first ")[1].split(", last")[0]

    def lookup(self, groups: DataFrame, *, before_batch: int | None = None, writer: str = "batches") -> DataFrame:
        """Known near fingerprints of a batch: fp, near_fp, distance, bucket, first, last (of the known one in that bucket)."""
        o = self.options
        rows = self.entries_for(groups, self.parts(before_batch=before_batch, writer=writer))
        difference = F.col("fp").bitwiseXOR(F.col("near_fp"))
        near = rows.filter(is_near(difference, o.distance, o.num_bands, o.hash_bits)).filter(under_lowest_key(difference, F.col("k"), o.scheme, o.hash_bits))
        return near.select("fp", "near_fp", F.bit_count(difference).alias("distance"), "bucket", "first", "last")

    def verdicts(self, fps: DataFrame, *, before_batch: int | None = None, writer: str = "batches") -> DataFrame:
        """Flags of a materialised batch against itself and the index, as :func:`detect_outbreaks` gives them."""
        o = self.options
        groups = materialize(fingerprint_groups(fps, ttl_seconds=o.ttl_seconds))
        own = materialize(groups.select("fp").distinct())
        known = materialize(self.lookup(groups, before_batch=before_batch, writer=writer))
        options = {"threshold": o.threshold, "num_bands": o.num_bands, "hash_bits": o.hash_bits}
        within = neighbourhood(own, near_pairs(own, **options) if o.ttl_seconds is None else near_pairs_in_time(groups, **options))
        near = materialize(within.unionByName(known.select("fp", "near_fp", "distance")).distinct())
        seen = known.select(F.col("near_fp").alias("fp"), "bucket", "first", "last", F.lit(0).cast("long").alias("n"))
        merged = materialize(
            groups.unionByName(seen).groupBy("fp", "bucket").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
        )
        return attach_verdicts(fps, merged, near, o.hash_bits, o.ttl_seconds)

    def similar(self, fps: DataFrame, *, before_batch: int | None = None, writer: str = "batches") -> DataFrame:
        """All earlier known matches of the batch's messages: message_id, similar_id, similarity.

        Matches within the batch itself are found once the batch has been added.
        """
        o = self.options
        batch = fps.select("message_id", "ts", "fp", time_bucket(o.ttl_seconds).alias("own_bucket"))
        groups = materialize(batch.select("fp", F.col("own_bucket").alias("bucket")).distinct())
        parts = self.parts(before_batch=before_batch, writer=writer)
        near = materialize(self.lookup(groups, before_batch=before_batch, writer=writer).select("fp", "near_fp", "distance", "bucket").distinct())
        span = near.agg(F.min("bucket"), F.max("bucket"), F.count(F.lit(1))).first()
        shards = [r["s"] for r in near.select(self._shard("near_fp").alias("s")).distinct().collect()]  # at most ``shards``
        members = self._read("members", parts, span[0], span[1], sorted(shards)) if shards else self.spark.createDataFrame([], self.members_schema)
        known = members.select(F.col("fp").alias("near_fp"), "bucket", F.col("message_id").alias("similar_id"), F.col("ts").alias("similar_ts"))
        side = F.broadcast(near) if span[2] <= BROADCAST_ROWS else near
        rows = known.join(side, ["near_fp", "bucket"]).join(batch, "fp")
        rows = rows.filter(F.struct("similar_ts", "similar_id") < F.struct("ts", "message_id"))
        if o.ttl_seconds is not None:
            rows = rows.filter(F.unix_micros("ts") - F.unix_micros("similar_ts") < o.ttl_seconds * 1_000_000)
        return rows.select("message_id", "similar_id", (F.lit(1.0) - F.col("distance") / float(o.hash_bits)).alias("similarity"))
