"""Blasts kept up to date batch by batch.

The table holds one label per fingerprint, written once when the fingerprint is first seen, and a log
of relabels: (label, new label) for groups that a later batch connected. Labels are not rewritten;
a reader follows the log. What a batch has to be compared with are the known fingerprints that share a block key with one of
its own, which the stored index finds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.operators.components import connected_components
from siftline.operators.forest import near_components
from siftline.operators.outbreak import fingerprint_groups
from siftline.operators.outbreak_index import IndexOptions, OutbreakIndex
from siftline.session import materialize, remove_folder
from siftline.sources.commits import CommitLog, Part

LABELS, RELABELS = "labels", "relabels"


class BlastIndex:
    """Fingerprint groups below ``root``: what :func:`blast_labels` gives for all batches together."""

    def __init__(self, spark: SparkSession, root: str, options: IndexOptions = IndexOptions(), *, id_type: str = "bigint"):
        if options.ttl_seconds is not None:
            raise ValueError("blasts connect messages of any age")
        self.spark, self.options = spark, options
        self.index = OutbreakIndex(spark, f"{root}/index", options, id_type=id_type)
        self.log = CommitLog(spark, f"{root}/blasts")
        self.schemas = {LABELS: "fp bigint, blast bigint, shard int", RELABELS: "old bigint, new bigint"}

    def _read(self, name: str) -> DataFrame:
        folders = [f"{self.log.folder(p)}/{name}" for p in self.log.snapshot().parts if p.note[name]]
        if not folders:
            return self.spark.createDataFrame([], self.schemas[name])
        # One read per part: their folders are partitioned each by itself.
        frames = [self.spark.read.schema(self.schemas[name]).parquet(f) for f in folders]
        rows = frames[0]
        for frame in frames[1:]:
            rows = rows.unionByName(frame)
        return rows

    def _current(self, labels: DataFrame) -> DataFrame:
        """Labels (fp, blast) after the relabel log; a chain of relabels leads to the smallest label."""
        log = connected_components(self._read(RELABELS).select(F.col("old").alias("u"), F.col("new").alias("v")))
        return labels.join(log.withColumnRenamed("node", "blast"), "blast", "left").select("fp", F.coalesce("component", "blast").alias("blast"))

    def labels(self) -> DataFrame:
        """fp, blast of all fingerprints seen."""
        return self._current(self._read(LABELS).select("fp", "blast"))

    def groups(self) -> DataFrame:
        """Summaries of all messages by fingerprint, for :func:`blast_summary`."""
        members = self.index._read("members", self.index.parts())
        return fingerprint_groups(members.select("message_id", "ts", "fp"))

    def add(self, fps: DataFrame, *, batch: int, writer: str = "batches") -> bool:
        """Add a materialised batch (message_id, ts, fp); False if it was added before.

        The message index and the labels are two commits. A job that fails between them is repeated
        as a whole: the lookup leaves the batch itself out of the index.
        """
        if self.log.has(writer, batch):
            return False
        o = self.options
        groups = materialize(fps.select("fp", F.lit(0).cast("bigint").alias("bucket")).distinct())
        met = self.index.entries_for(groups, self.index.parts(before_batch=batch, writer=writer)).select(F.col("near_fp").alias("fp")).distinct()
        touched = materialize(met.unionByName(groups.select("fp")).distinct())
        shard = F.pmod(F.xxhash64("fp"), F.lit(o.shards)).cast("int")
        needed = [r["s"] for r in touched.select(shard.alias("s")).distinct().collect()]  # at most ``shards``
        stored = self._read(LABELS).filter(F.col("shard").isin(needed)).select("fp", "blast") if needed else self._read(LABELS).select("fp", "blast")
        known = materialize(self._current(stored.join(touched, "fp", "left_semi")))
        merged = near_components(touched, known, threshold=o.threshold, num_bands=o.num_bands, hash_bits=o.hash_bits)
        before = merged.join(known.withColumnRenamed("blast", "old"), "fp", "left")
        fresh = before.filter(F.col("old").isNull()).select("fp", "blast").withColumn("shard", shard)
        moved = before.filter(F.col("old") != F.col("blast")).select("old", F.col("blast").alias("new")).distinct()
        part = Part(self.log.new_part(f"{writer}-{batch}"), {LABELS: not fresh.isEmpty(), RELABELS: not moved.isEmpty()})
        fresh.hint("rebalance", "shard").write.partitionBy("shard").parquet(f"{self.log.folder(part)}/{LABELS}")
        moved.write.parquet(f"{self.log.folder(part)}/{RELABELS}")
        self.index.add(fps, batch=batch, writer=writer)
        if not self.log.commit(add=[part], writer=writer, batch=batch):
            remove_folder(self.spark, self.log.folder(part))
            return False
        return True

    def compact(self) -> None:
        """Apply the relabel log and put all labels into one part."""
        old = self.log.snapshot().parts
        if len(old) < 2:
            return
        part = Part(self.log.new_part("compact"), {LABELS: True, RELABELS: False})
        rows = self.labels().withColumn("shard", F.pmod(F.xxhash64("fp"), F.lit(self.options.shards)).cast("int"))
        rows.hint("rebalance", "shard").write.partitionBy("shard").parquet(f"{self.log.folder(part)}/{LABELS}")
        self.log.commit(add=[part], remove=old)
