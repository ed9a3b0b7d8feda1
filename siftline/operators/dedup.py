"""Source merging, keep-first deduplication and corpus counts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from siftline.schema import RECORD_COLUMNS

PRIORITY = "_priority"
SEQ = "_seq"


def file_path() -> Column:
    """The path a row was read from, as a reader takes it (the metadata column holds it as a URI)."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def file_position() -> Column:
    """Place of a row in its files: path, start of its split, row in the split.

    A split is read front to back by one task, so this is file order however splits are
    packed into tasks. Only for a projection directly over the scan.
    """
    return F.struct(
        file_path().alias("path"), F.col("_metadata.file_block_start").cast("bigint").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )


def position_of(df: DataFrame) -> Column:
    """The position column as (path, block, row); a plain number is the row.

    A frame without one is ordered by its content, which is repeatable but says nothing about
    age: give an explicit position where the first row must win.
    """
    if SEQ not in df.columns:
        row = F.xxhash64(*[F.to_json(F.struct("extra")) if c == "extra" else F.col(c) for c in RECORD_COLUMNS if c in df.columns])
    elif df.schema[SEQ].dataType.typeName() == "struct":
        return F.col(SEQ)
    else:
        row = F.col(SEQ).cast("bigint")
    return F.struct(F.lit("").alias("path"), F.lit(0).cast("bigint").alias("block"), row.alias("row"))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], *, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the one that comes first in ``order``.

    One shuffle with map-side combining, so any number of copies of a text collapses
    before it leaves its task. The grouping starts with a hash of the key: the
    aggregation sorts, and comparing eight bytes settles nearly every comparison of long
    texts. The full key still decides equality.

    With ``columns`` only these are returned and shuffled; a string key that is not among them goes
    as its SHA-256, which decides equality in its place.
    """
    columns = df.columns if columns is None else list(columns)
    rest = [c for c in columns if c not in keys]
    best = F.min_by(F.struct(*rest) if rest else F.lit(0), F.struct(*order)).alias("_first")
    strings = {f.name for f in df.schema.fields if f.dataType.typeName() == "string"}
    equal = [F.unhex(F.sha2(c, 256)).alias(f"_{c}_digest") if c in strings and c not in columns else F.col(c) for c in keys]
    grouped = df.groupBy(F.xxhash64(*keys).alias("_hash"), *equal).agg(best)
    kept = {c: F.col(f"_first.{c}") for c in rest}
    return grouped.select(*[kept.get(c, F.col(c)).alias(c) for c in columns])


def union_by_priority(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of record frames in priority order, tagged with (priority, position).

    See :func:`position_of` for what counts as the position.
    """
    tagged = []
    for priority, frame in enumerate(frames):
        tagged.append(frame.select(*RECORD_COLUMNS, F.lit(priority).alias(PRIORITY), position_of(frame).alias(SEQ)))
    merged = tagged[0]
    for frame in tagged[1:]:
        merged = merged.unionByName(frame)
    return merged


def priority_merge(frames: Sequence[DataFrame], *, keep_order: bool = False) -> DataFrame:
    """Union of frames, exact (text, lang) duplicates resolved in favour of the earlier frame."""
    merged = keep_first(union_by_priority(frames), ["text", "lang"], [PRIORITY, SEQ])
    return merged if keep_order else merged.select(*RECORD_COLUMNS)


def merge_sources(sources: Mapping[str, Callable[[], DataFrame]], *, keep_order: bool = False) -> DataFrame:
    """Run each named source in order and merge; a failing source is named in the error."""
    frames = []
    for name, load in sources.items():
        try:
            frames.append(load())
        except Exception as exc:
            raise RuntimeError(f"source {name!r} failed: {exc}") from exc
    if not frames:
        raise ValueError("no sources to merge")
    return priority_merge(frames, keep_order=keep_order)


def corpus_summary(df: DataFrame, dimensions: Sequence[str] = ("source", "label", "lang")) -> DataFrame:
    """Row counts in total and by each dimension, in one pass over the table.

    Output: dimension ('total' or a column name), value, records.
    """
    sets = [[F.col(d)] for d in dimensions] + [[]]
    grouped = df.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(
        F.count(F.lit(1)).alias("records"), F.grouping_id().alias("_gid")
    )
    bits = len(dimensions)
    dimension = F.lit("total")
    value = F.lit(None).cast("string")
    for i, name in enumerate(dimensions):
        only_this = (1 << bits) - 1 - (1 << (bits - 1 - i))
        dimension = F.when(F.col("_gid") == only_this, name).otherwise(dimension)
        value = F.when(F.col("_gid") == only_this, F.col(name)).otherwise(value)
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "records")
