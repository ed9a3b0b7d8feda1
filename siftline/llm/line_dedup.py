"""Exact line deduplication over levelled sorted runs of line hashes. Native: no Python on the data path."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftline.llm.common import ASCII_SPACE, ascii_lower, drop_stored, stored
from siftline.session import new_folder, remove_folder


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _hash(key: Column) -> Column:
    """128 bits of a key: XXH64 under two seeds, so that chance collisions stay out of reach at any corpus size."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2"))


def hashed_lines(docs: DataFrame, *, min_chars: int = 20) -> DataFrame:
    """(doc, th, pos, h1, h2) for each line whose key has at least ``min_chars`` code points.

    ``doc`` is the id and ``th`` a hash of the whole text, which tells apart rows that share an id.
    Null and empty texts are one empty line and give no row.
    """
    key = line_key(F.col("line"))
    return (
        docs.select(
            F.col("doc_id").alias("doc"), F.xxhash64("text").alias("th"),
            F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"),
        )
        # A line shorter than the bound cannot have a long enough key; this spares it the key.
        .filter(F.char_length("line") >= min_chars)
        .withColumn("key", key)
        .filter(F.char_length("key") >= min_chars)
        .select("doc", "th", "pos", _hash(F.col("key")).alias("h"))
        .select("doc", "th", "pos", "h.h1", "h.h2")
    )


class LineRuns:
    """Levelled sorted runs of line hashes, one record (h1, h2, n, top) per key and run.

    ``n`` is the number of documents of the run's batches that hold the key and ``top`` the
    largest id among them. A run is an external table bucketed and sorted by
    (h1, h2), so a batch is shuffled once to the bucket layout and merged with every run in
    place: the runs themselves never move. Whenever a level holds ``fan_in`` runs they are
    merged into one run of the next level, so a key is rewritten a logarithmic number of times.
    """

    def __init__(self, spark: SparkSession, *, fan_in: int = 3, buckets: int = 16):
        self.spark, self.fan_in, self.buckets = spark, fan_in, buckets
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, records: DataFrame, level: int) -> None:
        name, path = f"line_run_{uuid.uuid4().hex}", new_folder(self.spark, "line-run")
        (
            records.write.format("parquet").option("path", path).option("compression", "zstd")
            .bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, path))
        if len(self.levels[level]) >= self.fan_in:
            old, self.levels[level] = self.levels[level], []
            self._write(self._merged(old), level + 1)
            for table_name, folder in old:
                self.spark.sql(f"DROP TABLE {table_name}")
                remove_folder(self.spark, folder)

    def _merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        """One record per key of several runs, by merge joins. (A union of bucketed scans followed
        by an aggregate left keys unmerged in Spark 4.1.2, which took it to be partitioned by key.)"""
        out = self.spark.table(runs[0][0])
        for name, _ in runs[1:]:
            more = self.spark.table(name).select("h1", "h2", *[F.col(c).alias(f"_{c}") for c in ("n", "top", "since")])
            out = out.join(more.hint("merge"), ["h1", "h2"], "full").select(
                "h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"),
                F.greatest("top", "_top").alias("top"), F.greatest("since", "_since").alias("since"),
            )
        return out

    def runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """Rows of ``keys`` (with h1, h2) that no run holds: one merge anti-join per run."""
        for name, _ in self.runs():
            keys = keys.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, lines: DataFrame) -> None:
        """Add a batch (doc, h1, h2): its keys as a new run.

        A key that the runs hold already is recorded as a further sighting with a null
        ``since``; one they lack gets the batch's largest id as ``since`` too. Batches may
        come in any order, counts and largest ids are merged by sum and maximum. No id may
        come in two batches.
        """
        records = (
            lines.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
            .groupBy("h1", "h2").agg(F.count("one").alias("n"), F.max("doc").alias("top"))
        )
        records, path = stored(records.repartition(self.buckets, "h1", "h2"), "line-batch")
        fresh = self.unseen(records).select("h1", "h2", F.col("top").alias("since"))
        self._write(records.join(fresh, ["h1", "h2"], "left").select("h1", "h2", "n", "top", "since"), 0)
        drop_stored(self.spark, path)

    def state(self) -> DataFrame:
        """(h1, h2, n, top, since) over all batches."""
        return self._merged(self.runs())

    def drop(self) -> None:
        for name, folder in self.runs():
            self.spark.sql(f"DROP TABLE {name}")
            remove_folder(self.spark, folder)
        self.levels = []


def dedup_lines(
    docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3, batches: int = 4, fan_in: int = 3, buckets: int = 16
) -> DataFrame:
    """Drop lines that many documents share, except in the largest id that holds them.

    ``docs`` has doc_id and text and any other columns, which come back unchanged. Added are
    ``kept_text``, ``n_lines`` (before dropping) and ``n_dropped``. A line's key is the line
    without ASCII white space at its ends, A-Z lower-cased; keys of at least ``min_chars`` code
    points found in at least ``min_docs`` documents lose all lines but those of the largest id.

    Null or empty text is one empty line and stays. Rows that share an id count as one
    document; a null id sorts below all others. Columns named like helper columns are safe.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64("doc"), F.lit(batches))
    lines, lines_path = stored(hashed_lines(docs, min_chars=min_chars).withColumn("batch", batch), "lines", "batch")
    runs = LineRuns(spark, fan_in=fan_in, buckets=buckets)
    for number in range(batches):
        runs.add(lines.filter(F.col("batch") == number).select("doc", "h1", "h2"))
    shared = runs.state().filter(F.col("n") >= min_docs).select("h1", "h2", "top")
    drops = (
        lines.join(shared, ["h1", "h2"])
        .filter(~F.col("doc").eqNullSafe(F.col("top")))
        .select("doc", "th", "pos").distinct()
        .groupBy("doc", "th").agg(F.collect_list("pos").alias("gone"))
    )
    drops, _ = stored(drops, "line-drops")
    runs.drop()
    drop_stored(spark, lines_path)
    row = docs.select(F.struct("*").alias("row"))
    # Always the same join: a broadcast would be chosen for small inputs only.
    found = row.join(
        drops.hint("merge"), F.col("row.doc_id").eqNullSafe(F.col("doc")) & (F.xxhash64("row.text") == F.col("th")), "left"
    )
    parts = F.split(F.coalesce("row.text", F.lit("")), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.coalesce("row.text", F.lit(""))).otherwise(
        F.array_join(F.transform(kept, lambda i: F.element_at(parts, i + 1)), "\n")
    )
    own = {"kept_text": text, "n_lines": F.size(parts).cast("bigint"), "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("bigint")}
    clash = set(own) & set(docs.columns)
    return found.select(
        *[F.col(f"row.`{c}`") for c in docs.columns if c not in clash], *[v.alias(k) for k, v in own.items()]
    )
