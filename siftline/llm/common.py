"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftline.session import new_folder, remove_folder

#: ASCII white space, as the text contracts use it: space and tab to carriage return.
ASCII_SPACE = " \t\n\x0b\f\r"


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it.

    On a cluster it is installed on all machines or shipped with the job; a path that does not
    exist there is ignored.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Let Python workers take at most so many rows of whole texts at a time, from now on in this session; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= rows:
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, *partition_by: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet below the shared folder and read it back; also its path.

    Unlike a checkpoint the files are compressed and columnar, and later readers prune them.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_stored(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        remove_folder(spark, path)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns called like ``names`` renamed out of an operator's way; what each column is called now."""
    now = {}
    for column in df.columns:
        now[column] = column
        if column.lower() in names:
            now[column] = fresh_name(df, f"_kept_{column}")
            df = df.withColumnRenamed(column, now[column])
    return df, now


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else. Pure ASCII takes the fast built-in path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text falls into fold 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary package keeps a file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
