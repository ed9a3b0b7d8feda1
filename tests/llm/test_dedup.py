"""Line dedup against SQL, SimHash against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import simhash_index
from siftline.llm.line_dedup import LineRuns, dedup_lines, hashed_lines
from siftline.llm.queries import ORACLE

LONG = "this line is long enough to count"


def line_rows():
    rnd = random.Random(3)
    pool = [LONG, LONG.upper(), f"  {LONG}\t", "short", "", "x" * 19, "y" * 20, "ÄÖÜ" * 8, "äöü" * 8, "\x0b" + "z" * 25 + "\x0c", "a fourth line that is long enough"]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(1, 7)))) for i in range(60)]
    return rows + [(60, None), (61, ""), (62, "\n"), (63, LONG + "\n" + LONG), (64, " " * 40)]


@pytest.mark.parametrize("batches,fan_in", [(1, 3), (5, 2)])
def test_line_dedup_equals_sql(spark, batches, fan_in):
    df = spark.createDataFrame(line_rows(), "doc_id bigint, text string").withColumn("n_lines", F.lit("clash")).withColumn("h1", F.lit(7))
    out = dedup_lines(df.repartition(3), batches=batches, fan_in=fan_in, buckets=2)
    assert set(out.columns) == {"doc_id", "text", "h1", "kept_text", "n_lines", "n_dropped"}
    got = out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", line_rows())
    cols = "doc_id, n_lines, n_dropped, kept_sha256"
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT {cols} FROM ({ORACLE['op9_line_dedup']})").fetchall())


def test_line_dedup_of_repeated_rows_null_ids_and_nothing(spark):
    rows = [(5, LONG), (5, LONG), (None, LONG), (9, LONG + "\nkeep"), (1, "keep")]
    got = {(r["doc_id"], r["kept_text"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(5, ""), (None, ""), (9, LONG + "\nkeep"), (1, "keep")}
    assert dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_runs_report_unseen_keys_and_merge(spark):
    runs = LineRuns(spark, fan_in=2, buckets=2)
    frames = [hashed_lines(spark.createDataFrame([(i, f"line number {n} of a long text") for i, n in part], "doc_id bigint, text string")) for part in ([(1, 1), (2, 2)], [(3, 2), (4, 3)], [(5, 3), (6, 4)])]
    news = []
    for frame in frames:
        news.append(runs.unseen(frame.select("h1", "h2").distinct()).count())
        runs.add(frame.select("doc", "h1", "h2"))
    assert news == [2, 1, 1]
    assert sorted(r["n"] for r in runs.state().collect()) == [1, 1, 2, 2]
    assert len(runs.runs()) == 2
    runs.drop()


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("crowd", [256, 2])
def test_links_connect_what_is_near(spark, crowd):
    rnd = random.Random(8)
    fps = set()
    for _ in range(6):
        base = rnd.getrandbits(64)
        for _ in range(25):
            fp = base
            for _ in range(rnd.randrange(6)):
                fp ^= 1 << rnd.randrange(64)
            fps.add(fp)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash_index.near_links(spark.createDataFrame([(0, f) for f in signed], "tag int, fp bigint"), crowd=crowd).collect()
    at = {f: i for i, f in enumerate(signed)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in links:
        assert (fps[at[r["a"]]] ^ fps[at[r["b"]]]).bit_count() <= 3
        root[find(at[r["a"]])] = find(at[r["b"]])
    same = lambda labels: {(i, j) for i in range(len(labels)) for j in range(i) if labels[i] == labels[j]}
    assert same([find(i) for i in range(len(fps))]) == same(brute_components(fps))
    assert any(r["crowded"] for r in links) == (crowd == 2)


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [sum(xxh64_intdigest(s, 42) >> b & 1 for s in shingles) * 2 > len(shingles) for b in range(64)]
    return sum(1 << b for b, on in enumerate(bits) if on)


def test_classes_equal_brute_force(spark):
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(rnd.randrange(40)) for _ in range(120)) for _ in range(4)]
    texts = base + [b + " end" for b in base] + [base[0].upper(), base[0].replace(" ", "\n"), None, "", " \t", "one", "one two", "one two three", "É é"]
    rows = list(enumerate(texts)) + [(2, base[1]), (2, base[1])]
    fps = [plain_fingerprint(t) for _, t in rows]
    labels = brute_components(fps)
    smallest = {l: min(r[0] for r, m in zip(rows, labels) if m == l) for l in labels}
    want = sorted((r[0], f"{f:016x}", smallest[l]) for r, f, l in zip(rows, fps, labels))
    got = simhash_index.simhash_classes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == want
    assert simhash_index.simhash_classes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("crowd", [256, 3])
def test_near_duplicates_keep_one_of_each_group(spark, crowd):
    rnd = random.Random(6)
    text = lambda: [f"w{rnd.randrange(5000)}" for _ in range(200)]
    rows, groups = [], []
    for g in range(6):
        words = text()
        for c in range(5):
            own = list(words)
            if c > 1:
                own[rnd.randrange(200)] = "changed"
            rows.append((len(rows), " ".join(own), "a", 1))
            groups.append(g)
    rows += [(100, None, "a", 1), (101, "", "b", 2), (102, "tiny", "a", 1), (103, "tiny text", "a", 1), (104, "tiny", "a", 1), (104, "tiny", "a", 1), (None, "tiny", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, th string, component int")
    kept = simhash_index.drop_near_duplicates(df, crowd=crowd)
    assert kept.columns == df.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == [0, 5, 10, 15, 20, 25, 100, 102, 103]
    assert simhash_index.drop_near_duplicates(df.limit(0)).count() == 0


def shingle_set(text, width=5):
    words = text.encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute_keepers(rows):
    """The smallest id of every group that pairs at 0.8 or more in five-word shingles connect."""
    sets, group = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return sorted(min(r[0] for r, g in zip(rows, group) if g == own) for own in set(group))


def test_near_duplicates_equal_brute_force_at_the_bound(spark):
    rnd = random.Random(12)
    rows = []
    for n in (40, 120, 400):
        for _ in range(25):
            words = [f"w{int(rnd.paretovariate(0.6)) % 4000}" for _ in range(n)]
            rows.append((len(rows), " ".join(words)))
            edits = max(1, round(n * rnd.choice([0.015, 0.018, 0.021, 0.025])))
            for at in rnd.sample(range(n), edits):
                words[at] = f"new{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    want = brute_keepers(rows)
    assert 75 < len(want) < 140
    got = simhash_index.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == want


def test_near_duplicates_link_members_of_one_word_set(spark):
    rnd = random.Random(13)
    base = [f"w{i}" for i in range(240)]
    rows = []
    for _ in range(12):  # texts of one word set, far from one another, each with a near copy of the same word set
        words = rnd.sample(base, len(base))
        rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join(words[3:] + words[:3])))
    want = brute_keepers(rows)
    assert len(want) == 12
    got = simhash_index.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == want


@pytest.mark.parametrize("crowd", [256, 3])
def test_near_duplicates_of_a_crowd_are_checked_on_shingles(spark, crowd):
    rnd = random.Random(14)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(16):  # fingerprints close by, word order not
        rows.append((i, " ".join(rnd.sample(base, len(base)) + [f"own{i}"])))
    assert brute_keepers(rows) == list(range(16))
    got = simhash_index.drop_near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), crowd=crowd)
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(16))
