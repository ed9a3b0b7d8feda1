"""SimHash near-duplicates by multi-index hashing: Hamming balls inside fingerprint segments, then whole distances."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from siftline.llm.common import stored
from siftline.operators.components import connected_components
from siftline.operators.skew import lookup_join

#: Two 32-bit segments: three differing bits leave at most one in either of them.
RADIUS = 3
HALF = (1 << 32) - 1
#: Of the eight 4-bit pieces of the other segment, three differing bits leave five equal.
PIECES = [sum(0xF << 4 * i for i in chosen) for chosen in combinations(range(8), 5)]
SHINGLE_STEP = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(words: list[bytes], *, width: int, seed: int, distinct: bool) -> int:
    """Bits set in over half of the XXH64 hashes of the ``width``-word shingles; fewer words are one shingle, none gives 0."""
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    if width == 1:
        shingles = words
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = ends - np.fromiter(map(len, words), np.int64, len(words))
        last = max(1, len(words) - width + 1)
        stop = ends[min(width, len(words)) - 1 :]
        shingles = [joined[a:b] for a, b in zip(starts[:last].tolist(), stop.tolist())]
    if distinct:
        shingles = set(shingles)
    hashes = np.fromiter((xxh64_intdigest(s, seed) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def add_fingerprints(
    docs: DataFrame, *, text: str = "text", width: int = 3, seeds: Sequence[int] = (42,), distinct: bool = False, out: str = "fps"
) -> DataFrame:
    """Replace ``text`` by ``out``, one signed 64-bit fingerprint per seed.

    Texts are whole; A-Z is lower-cased and words are runs without ASCII white space. Null and
    wordless texts have fingerprint 0.
    """
    rest = [c for c in docs.columns if c not in (text, out)]
    schema = docs.select(*rest).schema.add(out, ArrayType(LongType()), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value in batch.column(text):
                raw = value.as_py()
                words = raw.encode().lower().split() if raw else []
                fps = [fingerprint(words, width=width, seed=s, distinct=distinct) for s in seeds]
                found.append([f - (1 << 64) if f >> 63 else f for f in fps])
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in rest] + [pa.array(found, pa.list_(pa.int64()))], names=[*rest, out]
            )

    return docs.select(*rest, text).mapInArrow(run, schema)


def _half(fp: Column, segment: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if segment else fp.bitwiseAND(F.lit(HALF))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _forest(rows: pd.DataFrame) -> pd.DataFrame:
    """Links that connect what is near in one crowded cell; at most one fewer than its fingerprints."""
    cell = rows.groupby("fp", as_index=False)["core"].max()
    fps, core = cell["fp"].to_numpy(np.int64), cell["core"].to_numpy(bool)
    root = np.arange(len(fps))
    left, right = [], []
    bits = fps.view(np.uint64)
    for i in np.flatnonzero(core):
        near = np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= RADIUS)
        for other in np.unique(root[near]):
            if other != root[i]:
                j = near[np.flatnonzero(root[near] == other)[0]]
                left.append(fps[i])
                right.append(fps[j])
                root[root == other] = root[i]
    return pd.DataFrame({"a": np.array(left, np.int64), "b": np.array(right, np.int64)})


def near_links(fps: DataFrame, *, crowd: int = 256) -> DataFrame:
    """(tag, a, b, crowded): links between distinct fingerprints of one tag at ``RADIUS`` bits or fewer.

    ``fps`` has distinct rows (tag, fp). Each segment value of a fingerprint is stored in a
    table; every value at distance 0 or 1 is looked up in it, so all near pairs are met, and
    the whole distance decides. A table entry that holds more than ``crowd`` fingerprints is
    not joined: its fingerprints and what looks them up are cut into cells that agree on five
    of the eight pieces of the other segment as well, which no crowd can overfill (4096
    stored fingerprints at most), and each cell gives the links that keep its near ones
    connected. Connected components are thus exact, without listing a crowd's pairs.
    """
    segments = [F.struct(F.lit(s).alias("seg"), _half(F.col("fp"), s).alias("key")) for s in (0, 1)]
    entries, _ = stored(fps.select("tag", "fp", F.explode(F.array(*segments)).alias("e")).select("tag", "fp", "e.seg", "e.key"), "simhash-table")
    where = ["tag", "seg", "key"]
    crowds, _ = stored(entries.groupBy(*where).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).drop("n"), "simhash-crowds")
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i).cast("bigint") for i in range(32)])
    probes = entries.select("tag", "seg", F.col("fp").alias("a"), F.explode(F.transform(flips, lambda bit: F.col("key").bitwiseXOR(bit))).alias("key"))
    light = (
        probes.join(entries.join(crowds, where, "left_anti").withColumnRenamed("fp", "b").hint("merge"), where)
        .filter((F.col("a") != F.col("b")) & (_distance("a", "b") <= RADIUS))
        .select("tag", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    members = probes.join(crowds, where, "left_semi").select(
        *where, F.col("a").alias("fp"), (F.when(F.col("seg") == 0, _half(F.col("a"), 0)).otherwise(_half(F.col("a"), 1)) == F.col("key")).alias("core")
    )
    other = F.when(F.col("seg") == 0, _half(F.col("fp"), 1)).otherwise(_half(F.col("fp"), 0))
    cells = F.array(*[F.struct(F.lit(i).alias("i"), other.bitwiseAND(F.lit(mask).cast("bigint")).alias("rest")) for i, mask in enumerate(PIECES)])
    spread = members.select(*where, "fp", "core", F.explode(cells).alias("c")).select(*where, "fp", "core", F.col("c.i").alias("i"), F.col("c.rest").alias("rest"))
    place = [*where, "i", "rest"]
    lively = spread.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.max("core").alias("any")).filter("n > 1 AND any").select(*place)
    dense = (
        spread.join(lively, place)
        .groupBy(*place).applyInPandas(lambda key, rows: _forest(rows).assign(tag=key[0]), "a bigint, b bigint, tag int")
        .select("tag", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    return light.withColumn("crowded", F.lit(False)).unionByName(dense.withColumn("crowded", F.lit(True)))


def simhash_classes(docs: DataFrame, *, width: int = 3, seed: int = 42) -> DataFrame:
    """Add ``fingerprint`` (16 hex digits) and ``component_id``, the smallest doc_id reachable over links.

    Two documents are linked if their fingerprints differ in at most three bits. Null and
    wordless texts have fingerprint 0 and are linked like any other. A null doc_id takes part,
    but a component's id is the smallest id that is not null (null if there is none). Rows that
    share an id or a text are kept apart and share the component. Other columns are dropped.
    """
    rows, _ = stored(add_fingerprints(docs.select("doc_id", "text"), width=width, seeds=(seed,)).select("doc_id", F.col("fps")[0].alias("fp")), "simhash-rows")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    grouped = _components(classes)
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    of_fp = grouped.join(smallest, "component").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(classes: DataFrame) -> DataFrame:
    """Distinct fingerprints with ``component``, equal for those that links connect."""
    links, _ = stored(near_links(classes.select(F.lit(0).alias("tag"), "fp")), "simhash-links")
    found = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def drop_linked(docs: DataFrame, *, width: int = 3, seed: int = 42) -> DataFrame:
    """One row of each group that :func:`simhash_classes` connects, the one with the smallest doc_id; columns unchanged.

    Groups are what fingerprints at three bits or fewer link. A null id comes last; of rows with
    one id the one whose text has the smallest hash stays, of rows alike in id and text any one. Null, empty and wordless
    texts are one group. An empty table stays empty. A group's rows meet in aggregates only,
    which combine before the shuffle, so it may be of any size.
    """
    tagged = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    rows, _ = stored(add_fingerprints(tagged, width=width, seeds=(seed,)).select("doc_id", "th", F.col("fps")[0].alias("fp")), "simhash-rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "th")
    classes, _ = stored(rows.groupBy("fp").agg(F.min(order).alias("first")), "simhash-classes")
    keepers, _ = stored(_components(classes).groupBy("component").agg(F.min("first").alias("k")).select("k.id", "k.th"), "simhash-keepers")
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"))
    kept = row.join(keepers, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")), "left_semi")
    return kept.dropDuplicates(["_id", "_th"]).select("row.*")


def add_shingles(texts: DataFrame, *, width: int) -> DataFrame:
    """(th, s): distinct 64-bit hashes of the ``width``-word shingles of every text; fewer words are one shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            found = []
            for value in batch.column("text"):
                words = value.as_py().encode().lower().split()
                codes = np.fromiter((xxh64_intdigest(w, 1) for w in words), np.uint64, len(words))
                own = min(width, len(codes))
                value = np.full(max(1, len(codes) - width + 1), own, np.uint64)
                for i in range(own):
                    value = (value ^ codes[i : i + len(value)]) * SHINGLE_STEP
                    value ^= value >> np.uint64(29)
                found.append(np.unique(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("th"), pa.array(found, pa.list_(pa.int64()))], names=["th", "s"])

    return texts.select("th", "text").mapInArrow(run, "th bigint, s array<bigint>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets of shingles reach ``similarity`` (Jaccard)."""
    return (
        pairs.join(sets.select(F.col("th").alias("u"), F.col("s").alias("su")), "u").join(sets.select(F.col("th").alias("v"), F.col("s").alias("sv")), "v")
        .withColumn("both", F.size(F.array_intersect("su", "sv")))
        .filter(F.col("both") >= similarity * (F.size("su") + F.size("sv") - F.col("both")))
        .select("u", "v")
    )


def rare_cells(sets: DataFrame, similarity: float) -> DataFrame:
    """(s, th, n, room): texts under the shingles by which every pair at ``similarity`` or more meets.

    Shingles are ordered by the number of texts that hold them. A partner shares at least
    ``similarity`` of a text's n shingles, so it holds one of all but that many less one of the
    rarest. Shingles of one text alone are shared with none: a text with too many of them has no
    partner, and they are left out of the cells. ``room`` is the number of shared shingles from
    this one on, the most that can be common with a text first met here.
    """
    each = sets.select("th", F.size("s").alias("n"), F.explode("s").alias("s"))
    counts, _ = stored(each.groupBy("s").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "near-dup-counts")
    held = lookup_join(each, counts.withColumn("weight", F.col("k")), ["s"], weight="weight", how="inner")
    ranked = held.groupBy("th", "n").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("held"))
    least = F.ceil(F.lit(similarity) * F.col("n") - 1e-9).cast("int")
    first = ranked.withColumn("m", F.size("held")).filter(F.col("m") >= least).withColumn("cut", F.slice("held", F.lit(1), F.col("m") - least + 1))
    return first.select("th", "n", "m", F.posexplode("cut").alias("i", "e")).select("e.s", "th", "n", (F.col("m") - F.col("i")).alias("room"))


def _may_reach(similarity: float) -> Column:
    """Whether two texts that first meet in a cell can share enough."""
    return F.least("room", "room_") >= similarity / (1 + similarity) * (F.col("n") + F.col("n_")) - 1e-9


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _mixed(cells: DataFrame, links: DataFrame, found: str) -> tuple[DataFrame, DataFrame]:
    """Cells with the component of every text over ``links``, those of several components; and the number of texts in each."""
    of = connected_components(links).withColumnRenamed("node", "th")
    placed, _ = stored(cells.drop("component", "size").join(of, "th", "left").withColumn("component", F.coalesce("component", "th")), found)
    sizes, _ = stored(
        placed.groupBy("s").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
        .filter("low <> high").select("s", "size"), found + "-sizes",
    )
    return placed, sizes


def missing_links(sets: DataFrame, links: DataFrame, *, similarity: float, stars: int = 2, block: int = 256) -> DataFrame:
    """Links at ``similarity`` or more that, with ``links``, connect all texts that such pairs connect.

    An exact prefix-filter join. Texts that are connected already need no further link, so the
    first ``stars`` rounds compare the texts of a cell with one of them, each round another,
    which connects large groups of copies with a row per text. Then all pairs of different
    components are compared in the cells that are still mixed; those are cut into blocks
    of about ``block`` texts, and each two blocks meet by themselves.
    """
    cells, _ = stored(rare_cells(sets, similarity), "near-dup-cells")
    known = links
    for turn in range(stars + 1):
        placed, sizes = _mixed(cells, known, f"near-dup-mixed-{turn}")
        cells = lookup_join(placed, sizes.withColumn("weight", F.col("size")), ["s"], weight="weight", how="inner")
        if turn < stars:
            lead = F.min(F.struct(F.xxhash64("th", F.lit(turn)).alias("h"), F.col("th").alias("th_"), F.col("n").alias("n_"), F.col("room").alias("room_"), F.col("component").alias("component_")))
            leads, _ = stored(cells.groupBy("s").agg(lead.alias("lead"), F.count(F.lit(1)).alias("weight")).select("s", "lead.*", "weight"), "near-dup-leads")
            pairs = lookup_join(cells.drop("size"), leads, ["s"], weight="weight", how="inner")
            pairs = pairs.filter((F.col("component") != F.col("component_")) & _may_reach(similarity))
        else:
            blocks = F.ceil(F.col("size") / block).cast("int")
            own = cells.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("th", F.lit("block")), F.col("blocks")).cast("int"))
            left = own.select("s", "th", "n", "room", "component", F.col("own").alias("p"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("q"))
            right = own.select("s", *[F.col(c).alias(c + "_") for c in ("th", "n", "room", "component")], F.col("own").alias("q"), F.explode(F.sequence(F.lit(0), "own")).alias("p"))
            met = (F.col("component") != F.col("component_")) & _may_reach(similarity) & ((F.col("p") < F.col("q")) | (F.col("th") < F.col("th_")))
            same = (F.col("s") == F.col("s_")) & (F.col("p") == F.col("p_")) & (F.col("q") == F.col("q_"))
            pairs = left.join(right.withColumnRenamed("s", "s_").withColumnRenamed("p", "p_").withColumnRenamed("q", "q_"), same & met)
        pairs, _ = stored(_ordered(pairs.select(F.col("th").alias("u"), F.col("th_").alias("v"))), "near-dup-pairs")
        more, _ = stored(_similar(pairs, sets, similarity), "near-dup-more")
        known = known.unionByName(more)
    return known


def drop_near_duplicates(
    docs: DataFrame, *, similarity: float = 0.8, width: int = 5, seeds: Sequence[int] = (1, 2, 3), crowd: int = 256
) -> DataFrame:
    """The rows of ``docs`` with one row kept of each group of near-duplicates; columns unchanged.

    Two texts are linked if their sets of ``width``-word shingles reach ``similarity`` (Jaccard);
    groups are what links connect. Fingerprints of distinct words under several seeds find most
    links: texts are compared with one of their fingerprint, and those of fingerprints within
    three bits with each other. What they miss, :func:`missing_links` finds, so no link between
    different groups is lost, and every link is checked on the shingles.

    Exact copies are found by a hash of the whole text and stand for one another. The row with
    the smallest doc_id stays (a null id comes last); of rows alike in id and text any one.
    Null and wordless texts are copies of one another. An empty table stays empty.
    """
    tagged = docs.select("doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("th", F.xxhash64("text"))
    texts, _ = stored(tagged.groupBy("th").agg(F.min("doc_id").alias("first"), F.first("text").alias("text")), "near-dup-texts")
    fps, _ = stored(add_fingerprints(texts, width=1, seeds=tuple(seeds), distinct=True).select("th", "first", F.posexplode("fps").alias("tag", "fp")), "near-dup-fps")
    sets, _ = stored(add_shingles(texts, width=width), "near-dup-shingles")
    classes, _ = stored(fps.groupBy("tag", "fp").agg(F.min("th").alias("rep")), "near-dup-classes")
    links, _ = stored(near_links(classes.select("tag", "fp"), crowd=crowd), "near-dup-links")
    same = fps.join(classes, ["tag", "fp"]).filter("th <> rep").select(F.col("th").alias("u"), F.col("rep").alias("v"))
    ends = {side: classes.select("tag", F.col("fp").alias(side), F.col("rep").alias(name)) for side, name in (("a", "u"), ("b", "v"))}
    across = links.join(ends["a"], ["tag", "a"]).join(ends["b"], ["tag", "b"]).filter("u <> v").select("u", "v")
    pairs, _ = stored(_ordered(same.unionByName(across)), "near-dup-near")
    checked, _ = stored(_similar(pairs, sets, similarity), "near-dup-checked")
    found = connected_components(missing_links(sets, checked, similarity=similarity))
    ids = fps.filter("tag = 0").select("th", "first")
    grouped = ids.join(found.withColumnRenamed("node", "th"), "th", "left").withColumn("component", F.coalesce("component", "th"))
    order = F.struct(F.col("first").isNull().alias("no_id"), F.col("first").alias("id"), "th")
    keepers, _ = stored(grouped.groupBy("component").agg(F.min(order).alias("k")).select("k.id", "k.th"), "near-dup-keepers")
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"))
    kept = row.join(keepers.hint("merge"), F.col("_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")), "left_semi")
    return kept.dropDuplicates(["_id", "_th"]).select("row.*")
