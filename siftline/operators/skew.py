"""Building blocks that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    *,
    weight: str | None = None,
    how: str = "left",
    max_hot: int = 1000,
    min_rows: int = 1_000_000,
) -> DataFrame:
    """Many-to-one join whose hot keys never meet in one task.

    ``right`` has one row per key. Keys held by more than ``1/max_hot`` of the left rows
    number fewer than ``max_hot``, so their right rows can be broadcast whatever the data
    size, and their left rows are not shuffled at all. All other keys take an ordinary
    shuffle join. ``weight`` names a column of ``right`` stating how many left rows carry
    the key; without it the left keys are counted. Inputs are read several times and
    should be materialised or cheap to read.
    """
    keys = list(on)
    if weight is None:
        total = left.count()
    else:
        total = right.agg(F.sum(weight)).first()[0] or 0
    if total < min_rows:
        return left.join(right.drop(weight) if weight else right, keys, how)
    if weight is None:
        counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        hot_keys = F.broadcast(counts.filter(F.col("_n") * max_hot > F.lit(total)).select(*keys))
        hot = right.join(hot_keys, keys, "left_semi")
        cold = right.join(hot_keys, keys, "left_anti")
    else:
        is_hot = F.col(weight) * max_hot > F.lit(total)
        hot = right.filter(is_hot).drop(weight)
        cold = right.filter(~is_hot).drop(weight)
        hot_keys = F.broadcast(hot.select(*keys))
    spread_out = left.join(F.broadcast(hot), keys, "inner")
    rest = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return spread_out.unionByName(rest)


def hex_draw(seed: int, *columns: Column | str) -> Column:
    """A uniformly distributed hex string that depends on the seed and the row's key only."""
    parts = [F.col(c) if isinstance(c, str) else c for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def ranked(
    df: DataFrame,
    groups: Sequence[str],
    draw: str,
    ties: Sequence[str],
    *,
    rank: str = "rank",
    size: str | None = None,
    digits: int = 3,
) -> DataFrame:
    """Exact ``row_number`` inside each group without sorting a whole group in one task.

    ``draw`` holds uniform hex strings (see :func:`hex_draw`). Its leading digits cut each
    group into ``16**digits`` slices of nearly equal size; a slice is numbered by itself
    and shifted by the number of rows in the slices before it. Slice counts are a small
    table (groups x slices), joined on the key the slices are already partitioned by.
    ``groups`` must have few distinct values, such as labels; draws must differ between
    rows, so seed them with a row key.
    """
    # A struct is never null itself, so rows with a null group value are ranked as well.
    group = F.struct(*groups) if groups else F.lit(0)
    keys = ["_group", "_slice"]
    sliced = df.withColumn("_group", group).withColumn("_slice", F.substring(draw, 1, digits))
    counts = sliced.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.partitionBy("_group").orderBy("_slice")
    counts = counts.withColumn(
        "_before", F.coalesce(F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    if size:
        counts = counts.withColumn(size, F.sum("_n").over(Window.partitionBy("_group")))
    inside = Window.partitionBy(*keys).orderBy(draw, *ties)
    numbered = sliced.withColumn("_local", F.row_number().over(inside))
    joined = numbered.join(counts.drop("_n"), keys)
    return joined.withColumn(rank, F.col("_before") + F.col("_local")).drop("_group", "_slice", "_before", "_local")


def draw_thresholds(rows: DataFrame, wanted: Sequence[tuple], *, digits: int = 3) -> dict[tuple, str]:
    """For every (group, rank) the bound under which exactly that many of the group's draws lie.

    ``rows`` has ``_group`` (few distinct values) and ``_draw`` (uniform hex strings, see :func:`hex_draw`) and is
    materialised. Each round counts, per wanted rank, the draws with the prefix found so far by their
    next ``digits`` digits, and picks the digits under which the rank lies. Only counts leave a task, and only
    ``16**digits`` numbers per rank reach the driver; nothing is sorted. Equal draws cannot be told apart: a bound that
    falls among them takes in all of them.
    """
    done = {(group, rank): "" for group, rank in wanted if rank <= 0}
    state = {(group, rank): ("", rank) for group, rank in wanted if rank > 0}
    names = {key: i for i, key in enumerate(state)}
    kind = rows.schema["_group"].dataType.simpleString()
    while state:
        targets = rows.sparkSession.createDataFrame([(names[k], k[0], prefix) for k, (prefix, _) in state.items()], f"target int, wanted {kind}, prefix string")
        met = rows.join(F.broadcast(targets), F.col("_group").eqNullSafe(F.col("wanted")) & F.startswith("_draw", "prefix"))
        step = F.substr("_draw", F.length("prefix") + 1, F.lit(digits))
        counts: dict[int, list] = {}
        for row in met.groupBy("target", step.alias("next")).agg(F.count(F.lit(1)).alias("n")).collect():
            counts.setdefault(row["target"], []).append((row["next"], row["n"]))
        left = {}
        for key, (prefix, rank) in state.items():
            for following, n in sorted(counts.get(names[key], [])):
                if rank <= n:
                    break
                rank -= n
            else:
                done[key] = prefix + "~"  # the group has no more rows than that
                continue
            if rank == n or not following or len(prefix) + len(following) >= 32:
                done[key] = prefix + following + "~"
            else:
                left[key] = (prefix + following, rank)
        state = left
    return done
