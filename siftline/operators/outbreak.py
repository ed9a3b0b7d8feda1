"""Outbreak detection: which messages repeat an earlier one, and how large each blast is.

Messages are compared through their fingerprints. All joins and aggregates run on
distinct fingerprints and on (fingerprint, time bucket) summaries; pairs of messages are
never formed, so a blast of any size costs as many rows as it has messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from siftline.functions.confusables import strip_confusables
from siftline.functions.hashing import simhash
from siftline.functions.zero_width import strip_zero_width
from siftline.operators.forest import near_components
from siftline.operators.neighbours import BROADCAST_ROWS, bucket_representatives, near_pairs, near_pairs_in_time
from siftline.operators.skew import lookup_join
from siftline.session import materialize


def clean_text(text: Column | str, *, normalize: str = "full") -> Column:
    """Undo invisible characters and look-alike letters before hashing."""
    return strip_confusables(strip_zero_width(text), normalize=normalize)


def fingerprint_messages(
    df: DataFrame,
    *,
    id_col: str = "message_id",
    text_col: str = "text",
    ts_col: str = "ts",
    hash_bits: int = 64,
    shingle_size: int = 4,
    hash_fn: str = "blake2b",
    normalize: str = "full",
) -> DataFrame:
    """Slim table (message_id, ts, fp); the text does not travel further."""
    cleaned = clean_text(text_col, normalize=normalize)
    return df.select(
        F.col(id_col).alias("message_id"),
        F.col(ts_col).cast("timestamp").alias("ts"),
        simhash(cleaned, hash_bits=hash_bits, shingle_size=shingle_size, hash_fn=hash_fn).alias("fp"),
    )


def latest_per_id(fingerprints: DataFrame) -> DataFrame:
    """For inputs with re-sent ids: the latest row of each id."""
    return (
        fingerprints.groupBy("message_id")
        .agg(F.max(F.struct("ts", "fp")).alias("m"))
        .select("message_id", "m.ts", "m.fp")
    )


def time_bucket(ttl_seconds: int | None) -> Column:
    if ttl_seconds is None:
        return F.lit(0).cast("long")
    return F.floor(F.unix_micros("ts") / F.lit(ttl_seconds * 1_000_000))


def fingerprint_groups(fingerprints: DataFrame, *, ttl_seconds: int | None = None) -> DataFrame:
    """One row per fingerprint and time bucket: first and last message, number of messages.

    Buckets are as long as the TTL, so an earlier match lies in the same bucket or in the
    one before.
    """
    order = F.struct("ts", "message_id")
    return fingerprints.groupBy("fp", time_bucket(ttl_seconds).alias("bucket")).agg(
        F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")
    )


def neighbourhood(distinct_fps: DataFrame, pairs: DataFrame) -> DataFrame:
    """Directed relation fp -> near_fp with distance; every fingerprint neighbours itself."""
    return (
        distinct_fps.select("fp", F.col("fp").alias("near_fp"), F.lit(0).alias("distance"))
        .unionByName(pairs.select(F.col("fp_a").alias("fp"), F.col("fp_b").alias("near_fp"), "distance"))
        .unionByName(pairs.select(F.col("fp_b").alias("fp"), F.col("fp_a").alias("near_fp"), "distance"))
    )


def _earliest_by_distance(groups: DataFrame, near: DataFrame, ttl_seconds: int | None) -> DataFrame:
    """Per (fp, bucket): for every distance the first message nearby in the bucket and the
    last one in the bucket before. At most max-distance + 1 entries."""
    nothing = F.lit(None)
    order_type = groups.schema["first"].dataType
    rows_near = near.join(groups.withColumnRenamed("fp", "near_fp"), "near_fp")
    own = F.when(F.col("distance") == 0, F.col("n"))
    same = F.struct(F.col("bucket"), F.col("first"), nothing.cast(order_type).alias("before"), own.alias("n"))
    parts = F.array(same)
    if ttl_seconds is not None:
        later = F.struct(
            (F.col("bucket") + 1).alias("bucket"), nothing.cast(order_type).alias("first"),
            F.col("last").alias("before"), nothing.cast("long").alias("n"),
        )
        parts = F.array(same, later)
    rows = rows_near.select("fp", "distance", F.explode(parts).alias("p")).select("fp", "distance", "p.*")
    per_distance = rows.groupBy("fp", "bucket", "distance").agg(
        F.min("first").alias("first"), F.max("before").alias("before"), F.max("n").alias("n")
    )
    return (
        per_distance.groupBy("fp", "bucket")
        .agg(
            F.array_sort(F.collect_list(F.struct("distance", "first", "before"))).alias("levels"),
            F.coalesce(F.max("n"), F.lit(0)).alias("n"),
        )
        .filter(F.col("n") > 0)
    )


def detect_outbreaks(
    messages: DataFrame,
    *,
    id_col: str = "message_id",
    text_col: str = "text",
    ts_col: str = "ts",
    threshold: float = 0.90,
    num_bands: int = 8,
    hash_bits: int = 64,
    shingle_size: int = 4,
    hash_fn: str = "blake2b",
    ttl_seconds: int | None = None,
    normalize: str = "full",
) -> DataFrame:
    """Flag every message that repeats an earlier one, in (ts, message_id) order.

    Output: message_id, ts, fingerprint, is_outbreak_candidate, best_similarity and
    ``matches``: for each similarity reached, best first, one earlier message (the
    earliest one when there is no TTL). A match is younger than ``ttl_seconds``.
    Use :func:`similar_messages` for the full lists of chosen messages.
    """
    fps = materialize(
        fingerprint_messages(
            messages, id_col=id_col, text_col=text_col, ts_col=ts_col, hash_bits=hash_bits,
            shingle_size=shingle_size, hash_fn=hash_fn, normalize=normalize,
        )
    )
    return flag_fingerprints(fps, threshold=threshold, num_bands=num_bands, hash_bits=hash_bits, ttl_seconds=ttl_seconds)


def flag_fingerprints(
    fps: DataFrame,
    *,
    threshold: float = 0.90,
    num_bands: int = 8,
    hash_bits: int = 64,
    ttl_seconds: int | None = None,
) -> DataFrame:
    """The part of :func:`detect_outbreaks` after fingerprinting; ``fps`` is materialised."""
    groups = materialize(fingerprint_groups(fps, ttl_seconds=ttl_seconds))
    options = {"threshold": threshold, "num_bands": num_bands, "hash_bits": hash_bits}
    if ttl_seconds is None:
        distinct_fps = groups.select("fp")
        pairs = near_pairs(distinct_fps, **options)
    else:
        distinct_fps = groups.select("fp").distinct()
        pairs = near_pairs_in_time(groups, **options)
    near = neighbourhood(distinct_fps, materialize(pairs))
    return attach_verdicts(fps, groups, near, hash_bits, ttl_seconds)


def match_batch(
    fps: DataFrame,
    index: DataFrame,
    *,
    threshold: float = 0.90,
    num_bands: int = 8,
    hash_bits: int = 64,
    ttl_seconds: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Verdicts for a new batch against itself and an index of earlier summaries.

    ``index`` has the columns of :func:`fingerprint_groups` from earlier batches, in any
    number of rows per fingerprint. Returns (verdicts, the batch's own summaries to add to
    the index). A batch that is small next to the index is broadcast (by count), so the
    index is only scanned: once for its fingerprints, once for the rows that matched.
    """
    groups = materialize(fingerprint_groups(fps, ttl_seconds=ttl_seconds))
    new_fps = materialize(groups.select("fp").distinct())
    options = {"threshold": threshold, "num_bands": num_bands, "hash_bits": hash_bits}
    within = neighbourhood(new_fps, near_pairs(new_fps, **options) if ttl_seconds is None else near_pairs_in_time(groups, **options))
    across = near_pairs(new_fps, index.select("fp"), **options)
    known = across.select(F.col("fp_a").alias("fp"), F.col("fp_b").alias("near_fp"), "distance")
    near = materialize(within.unionByName(known).distinct())
    touched = near.select(F.col("near_fp").alias("fp")).distinct()
    if touched.count() <= BROADCAST_ROWS:
        touched = F.broadcast(touched)
    seen = index.join(touched, "fp", "left_semi")
    merged = materialize(
        groups.unionByName(seen.select("fp", "bucket", "first", "last", F.lit(0).cast("long").alias("n")))
        .groupBy("fp", "bucket")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    )
    return attach_verdicts(fps, merged, near, hash_bits, ttl_seconds), groups


def attach_verdicts(fps: DataFrame, groups: DataFrame, near: DataFrame, hash_bits: int, ttl_seconds: int | None) -> DataFrame:
    """Verdicts of messages from fingerprint summaries and the relation of near fingerprints."""
    levels = materialize(_earliest_by_distance(groups, near, ttl_seconds))
    keyed = fps.withColumn("bucket", time_bucket(ttl_seconds))
    joined = lookup_join(keyed, levels, ["fp", "bucket"], weight="n", how="inner")
    return joined.select(
        "message_id", "ts", F.col("fp").alias("fingerprint"), *_verdict(hash_bits, ttl_seconds)
    )


def _verdict(hash_bits: int, ttl_seconds: int | None) -> list[Column]:
    order = F.struct("ts", "message_id")

    def in_bucket(level: Column) -> Column:
        return F.coalesce(level["first"] < order, F.lit(False))

    def just_before(level: Column) -> Column:
        if ttl_seconds is None:
            return F.lit(False)
        age = F.unix_micros("ts") - F.unix_micros(level["before"]["ts"])
        return F.coalesce(age < F.lit(ttl_seconds * 1_000_000), F.lit(False))

    hits = F.filter("levels", lambda level: in_bucket(level) | just_before(level))
    matches = F.transform(
        hits,
        lambda level: F.struct(
            (F.lit(1.0) - level["distance"] / F.lit(float(hash_bits))).alias("similarity"),
            F.when(in_bucket(level), level["first"]["message_id"])
            .otherwise(level["before"]["message_id"])
            .alias("message_id"),
        ),
    )
    return [
        (F.size(hits) > 0).alias("is_outbreak_candidate"),
        F.get(matches, F.lit(0))["similarity"].alias("best_similarity"),
        matches.alias("matches"),
    ]


def flag_crowds(
    fps: DataFrame,
    *,
    threshold: float = 0.90,
    num_bands: int = 8,
    hash_bits: int = 64,
    ttl_seconds: int | None = None,
) -> DataFrame:
    """Exact flags with one earlier match per message, without listing near-duplicate pairs.

    For data in which one campaign sends a huge number of slightly different texts. Nearly
    all of its messages are settled by :func:`bucket_representatives`, in linear work.
    Only messages left without a match, such as the first of a campaign, are looked up
    among all fingerprints. Flags equal those of :func:`flag_fingerprints`.

    Output: message_id, ts, fingerprint, is_outbreak_candidate, match_id, similarity (of
    that match).
    """
    options = {"threshold": threshold, "num_bands": num_bands, "hash_bits": hash_bits}
    keyed_rows = fps.withColumn("bucket", time_bucket(ttl_seconds))
    message = F.struct("ts", "message_id", "fp")
    groups = materialize(
        keyed_rows.groupBy("fp", "bucket").agg(
            F.min(message).alias("first"), F.max(message).alias("last"), F.count(F.lit(1)).alias("n")
        )
    )
    level = F.array(F.struct(F.lit(0).alias("distance"), "first", "before"))
    faces = bucket_representatives(groups, ttl=ttl_seconds is not None, **options)
    faces = materialize(faces.select("fp", "bucket", level.alias("levels"), "n"))

    def judge(rows: DataFrame, levels: DataFrame) -> DataFrame:
        joined = lookup_join(rows, levels, ["fp", "bucket"], weight="n", how="inner").withColumn("fingerprint", F.col("fp"))
        return joined.select("message_id", "ts", "fingerprint", "bucket", *_witness(hash_bits, ttl_seconds))

    settled = materialize(judge(keyed_rows, faces))
    open_rows = settled.filter(F.col("match_id").isNull()).select("message_id", "ts", F.col("fingerprint").alias("fp"), "bucket")
    todo = materialize(open_rows.select("fp").distinct())
    known = materialize(groups.select("fp").distinct())
    pairs = near_pairs(todo, known, **options)
    near = pairs.select(F.col("fp_a").alias("fp"), F.col("fp_b").alias("near_fp"), "distance")
    rest = judge(open_rows, materialize(_earliest_by_distance(groups, near, ttl_seconds)))
    merged = settled.filter(F.col("match_id").isNotNull()).unionByName(rest)
    return merged.select(
        "message_id", "ts", "fingerprint", F.col("match_id").isNotNull().alias("is_outbreak_candidate"), "match_id", "similarity"
    )


def _witness(hash_bits: int, ttl_seconds: int | None) -> list[Column]:
    """One earlier message from ``levels`` and its similarity to the row's fingerprint."""
    order = F.struct("ts", "message_id", "fingerprint")

    def candidate(level: Column) -> Column:
        in_bucket = F.when(level["first"] < order, level["first"])
        if ttl_seconds is None:
            return in_bucket
        age = F.unix_micros("ts") - F.unix_micros(level["before"]["ts"])
        return F.coalesce(in_bucket, F.when(age < F.lit(ttl_seconds * 1_000_000), level["before"]))

    found = F.get(F.filter(F.transform("levels", candidate), lambda c: c.isNotNull()), F.lit(0))
    distance = F.bit_count(found["fp"].bitwiseXOR(F.col("fingerprint")))
    return [
        found["message_id"].alias("match_id"),
        F.when(found.isNotNull(), F.lit(1.0) - distance / F.lit(float(hash_bits))).alias("similarity"),
    ]


def similar_messages(
    chosen: DataFrame,
    fps: DataFrame,
    *,
    threshold: float = 0.90,
    num_bands: int = 8,
    hash_bits: int = 64,
    ttl_seconds: int | None = None,
) -> DataFrame:
    """Every earlier match of the chosen messages, one row each.

    ``chosen`` and ``fps`` have message_id, ts, fp. Meant for the messages someone looks
    at: the result is as large as the answer. Output: message_id, similar_id, similarity;
    order by similarity descending to rank.
    """
    chosen_fps = materialize(chosen.select("fp").distinct())
    known = materialize(fps.select("fp").distinct())
    pairs = near_pairs(chosen_fps, known, threshold=threshold, num_bands=num_bands, hash_bits=hash_bits)
    near = pairs.select(F.col("fp_a").alias("fp"), F.col("fp_b").alias("near_fp"), "distance")
    others = fps.select(
        F.col("fp").alias("near_fp"), F.col("message_id").alias("similar_id"), F.col("ts").alias("similar_ts")
    )
    rows = chosen.join(near, "fp").join(others, "near_fp")
    rows = rows.filter(F.struct("similar_ts", "similar_id") < F.struct("ts", "message_id"))
    if ttl_seconds is not None:
        rows = rows.filter(F.unix_micros("ts") - F.unix_micros("similar_ts") < ttl_seconds * 1_000_000)
    return rows.select(
        "message_id", "similar_id", (F.lit(1.0) - F.col("distance") / float(hash_bits)).alias("similarity")
    )


def top_similar(matches: DataFrame, k: int) -> DataFrame:
    """The ``k`` best matches of every message, ranked: message_id, rank, similar_id, similarity; ties by id.

    Every task keeps its own ``k`` best per message before anything is shuffled, so a message
    with any number of matches sends ``k`` rows per task.
    """
    order = Window.partitionBy("message_id").orderBy(F.desc("similarity"), "similar_id")
    ranked = matches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("message_id", "rank", "similar_id", "similarity")


def blast_labels(groups: DataFrame, *, threshold: float = 0.90, num_bands: int = 8, hash_bits: int = 64) -> DataFrame:
    """Connected groups of near-duplicate fingerprints: fp, blast (smallest fp of the group). No pairs are listed."""
    return near_components(groups.select("fp"), threshold=threshold, num_bands=num_bands, hash_bits=hash_bits)


def blast_summary(groups: DataFrame, labels: DataFrame, *, min_size: int = 2) -> DataFrame:
    """Size, number of variants and time span of every blast with at least ``min_size`` messages.

    Works on the fingerprint summaries; no message rows are read.
    """
    return (
        groups.join(labels, "fp")
        .groupBy("blast")
        .agg(
            F.sum("n").alias("messages"),
            F.count_distinct("fp").alias("variants"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
        )
        .filter(F.col("messages") >= min_size)
        .select(
            "blast", "messages", "variants",
            F.col("first.message_id").alias("first_message_id"),
            F.col("first.ts").alias("first_seen"), F.col("last.ts").alias("last_seen"),
        )
    )


def blast_members(fps: DataFrame, groups: DataFrame, labels: DataFrame) -> DataFrame:
    """Messages with their blast."""
    weighted = materialize(labels.join(groups.groupBy("fp").agg(F.sum("n").alias("n")), "fp"))
    return lookup_join(fps, weighted, ["fp"], weight="n", how="inner").select("message_id", "ts", "fp", "blast")
