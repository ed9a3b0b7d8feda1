"""Seeds, decisions, splits, raw profiles, and the sinks."""

from __future__ import annotations

import csv
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from siftline.operators.dedup import SEQ, file_path, file_position
from siftline.operators.relabel import MANUAL
from siftline.schema import DECISION_SCHEMA, EXTRA_TYPE, LABELS, MODEL_LABELS, RECORD_COLUMNS
from siftline.sources import split_csv
from siftline.sources.commits import CommitLog
from siftline.sources.files import decode_record, list_files, with_charset

SEED_SOURCE = "synthetic_seed"
#: What an append adds to each decision.
STAMP = T.StructType([T.StructField("decided_at", T.LongType()), T.StructField("position", T.LongType())])
CONFIRMED_SCHEMA = "text string, label string, source string, lang string"


def read_seeds(spark: SparkSession, folder: str, *, lang: str = "tr") -> DataFrame:
    """Seed records from YAML files (category, examples with text and optional notes).

    Files are parsed inside the job, one row per file. JSON-lines files (.json, .jsonl) with the
    columns category, text, notes are read as well.
    """
    labels = LABELS

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["value"]):
                data = yaml.safe_load(content)
                if data["category"] not in labels:
                    raise ValueError(f"{path}: unknown category {data['category']!r}")
                rows += [(path, i, data["category"], e["text"], e.get("notes")) for i, e in enumerate(data["examples"])]
            yield pd.DataFrame(rows, columns=["path", "at", "category", "text", "notes"])

    yamls = (
        spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.yaml").load(folder)
        .select(F.col("_metadata.file_path").alias("path"), "value")
        .mapInPandas(parse, "path string, at long, category string, text string, notes string")
    )
    rows = yamls
    if not list_files(spark, folder, "*.json*").isEmpty():
        lines = (
            spark.read.schema("category string, text string, notes string").option("pathGlobFilter", "*.json*").json(folder)
            .select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"), "category", "text", "notes")
        )
        known = F.when(F.col("category").isin(*labels), F.col("category")).otherwise(
            F.raise_error(F.concat(F.lit("unknown category "), "category"))
        )
        rows = yamls.unionByName(lines.withColumn("category", known))
    notes = F.when(
        F.coalesce(F.col("notes"), F.lit("")) != "", F.create_map(F.lit("notes"), F.col("notes"))
    ).otherwise(F.create_map().cast(EXTRA_TYPE))
    return rows.select(
        "text", F.col("category").alias("label"), F.lit(SEED_SOURCE).alias("source"), F.lit(lang).alias("lang"), notes.alias("extra")
    )


def _read_json(spark: SparkSession, path: str, schema, *, position: bool = False) -> DataFrame:
    """Lines of committed batches and of files that lie in the folder itself."""
    empty = spark.createDataFrame([], schema)
    if position:
        empty = empty.withColumn(SEQ, F.lit(None).cast("struct<path:string,block:bigint,row:bigint>"))
    found = empty
    for folders in ([path], CommitLog(spark, path).folders()):
        try:
            rows = spark.read.schema(schema).json(folders) if folders else None
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = None
        if rows is not None:
            found = found.unionByName(rows.select("*", file_position().alias(SEQ)) if position else rows)
    return found


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decision log with a position; blank lines are ignored, a missing log is empty, a missing method is manual.

    The position puts decisions in the order they were made: by the time of their append and
    the order within it. Lines that no append stamped come first, in file order.
    """
    log = _read_json(spark, path, T.StructType([*DECISION_SCHEMA.fields, *STAMP.fields]), position=True)
    stamp = F.lpad(F.coalesce("decided_at", F.lit(0)).cast("string"), 20, "0")
    own = F.col("decided_at").isNull()
    position = F.struct(
        F.when(own, F.concat(stamp, f"{SEQ}.path")).otherwise(stamp).alias("path"),
        F.when(own, F.col(f"{SEQ}.block")).otherwise(F.lit(0)).alias("block"), F.coalesce("position", f"{SEQ}.row").alias("row"),
    )
    kept = log.filter(F.col("text").isNotNull()).withColumn("method", F.coalesce("method", F.lit(MANUAL)))
    return kept.select(*DECISION_SCHEMA.names, position.alias(SEQ))


def append_decisions(decisions: DataFrame, path: str, *, order: Column | None = None, batch: tuple[str, int] | None = None) -> bool:
    """Append decision rows (text, label, original_label, original_source, method); False if they were there already.

    Each is stamped with the time of the append and its place in it: ``order``, a whole
    number, or the order of the frame. ``batch`` names the writer and its batch number; sent again, it adds nothing.
    """
    rows = decisions if "method" in decisions.columns else decisions.withColumn("method", F.lit(MANUAL))
    place = F.monotonically_increasing_id() if order is None else order.cast("bigint")
    stamped = rows.select(*DECISION_SCHEMA.names, F.unix_micros(F.current_timestamp()).alias("decided_at"), place.alias("position"))
    return _append(stamped, path, batch)


def _append(rows: DataFrame, path: str, batch: tuple[str, int] | None) -> bool:
    writer, number = batch or (None, 0)
    return CommitLog(rows.sparkSession, path).append(rows, writer=writer, batch=number, file_format="json")


def read_confirmed(spark: SparkSession, path: str) -> DataFrame:
    return _read_json(spark, path, CONFIRMED_SCHEMA).filter(F.col("text").isNotNull())


def append_confirmed(records: DataFrame, path: str, *, batch: tuple[str, int] | None = None) -> bool:
    """Append human-confirmed records (text, label, source, lang); ``batch`` as in :func:`append_decisions`."""
    return _append(records.select("text", "label", "source", "lang"), path, batch)


def write_corpus(df: DataFrame, out_dir: str) -> tuple[str, str]:
    """Corpus as CSV and Parquet with ``extra`` encoded as JSON."""
    rows = df.select(*[F.to_json("extra").alias(c) if c == "extra" else F.col(c) for c in RECORD_COLUMNS])
    csv, parquet = f"{out_dir}/merged_dataset.csv", f"{out_dir}/merged_dataset.parquet"
    rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(csv)
    rows.write.mode("overwrite").parquet(parquet)
    return csv, parquet


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line, non-ASCII kept, ``extra`` as an object."""
    df.select(*[c for c in df.columns if c in RECORD_COLUMNS]).write.mode("overwrite").json(path)


def write_synthetic(parts: dict[str, DataFrame], out_dir: str) -> None:
    """seeds, augmented and adversarial as JSON lines; an empty seed set is an error."""
    if parts["seeds"].isEmpty():
        raise ValueError("no seed examples found")
    for name, frame in parts.items():
        write_jsonl(frame, f"{out_dir}/{name}.jsonl")


def write_splits(df: DataFrame, path: str, *, batch: tuple[str, int] | None = None) -> bool:
    """Train, validation and test rows as one Parquet table partitioned by ``split``, in place of an earlier one.

    Readers see the old rows until the new ones are complete.
    """
    writer, number = batch or (None, 0)
    rows = df.withColumn("extra", F.to_json("extra"))
    return CommitLog(df.sparkSession, path).append(rows, writer=writer, batch=number, partition_by=["split"], replace=True)


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Split rows with ``extra`` decoded; a named split prunes the other partitions."""
    df = spark.read.parquet(*CommitLog(spark, path).folders())
    if split is not None:
        df = df.filter(F.col("split") == split)
    return df.withColumn("extra", F.from_json("extra", EXTRA_TYPE))


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.coalesce(1).write.mode("overwrite").json(path)


def label_map_table(spark: SparkSession) -> DataFrame:
    """label, label_id: the class order stored next to a model."""
    return spark.createDataFrame(list(zip(MODEL_LABELS, range(len(MODEL_LABELS)))), "label string, label_id int")


def profile_sources(spark: SparkSession, raw_dir: str, *, pattern: str = "*.csv", sep: str = ",", sample: int = 3) -> DataFrame:
    """path, columns, rows, sample (JSON objects), error: one row per delimited file at any depth.

    One pass over all files together, in byte ranges; each file's header counts for itself. What cannot be
    read is told in ``error``: a file of blank lines, a quoted field that is never closed. Spark does not list
    files of no bytes at all.
    """
    found = list_files(spark, raw_dir, pattern, recursive=True)
    ranges = split_csv.scan_ranges(spark, [raw_dir], [sep], first_records=sample + 1, pattern=pattern)
    facts = with_charset(split_csv.file_facts(ranges, [sep]))

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for row in rows.itertuples():
                records = [decode_record(bytes(r), row.charset) for r in row.firsts[0]]
                columns = split_csv.header_names(records[0], sep) if records else None
                cells = [next(csv.reader([r], delimiter=sep, strict=False), []) for r in records[1:]]
                shown = [json.dumps(dict(zip(columns, c)), ensure_ascii=False) for c in cells] if columns else None
                error = "a quoted field is never closed" if row.ends_inside[0] else None if columns else "no content"
                out.append((row.path, columns, int(row.records[0]) - 1 if columns else None, shown, error))
            yield pd.DataFrame(out, columns=["path", "columns", "rows", "sample", "error"]).astype({"rows": "Int64"})

    told = facts.mapInPandas(describe, "path string, columns array<string>, rows bigint, sample array<string>, error string")
    return found.join(told, "path", "left").select(
        "path", "columns", "rows", "sample", F.when(F.col("columns").isNull(), F.coalesce("error", F.lit("no content"))).otherwise(F.col("error")).alias("error")
    )


def profile_folders(spark: SparkSession, raw_dir: str) -> DataFrame:
    """Number of text files per folder: folder, files."""
    files = list_files(spark, raw_dir, "*.txt", recursive=True)
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder")).agg(F.count(F.lit(1)).alias("files"))
