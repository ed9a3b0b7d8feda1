"""Fill-in-the-middle, quality and hard-negative operators on small inputs, against brute force where there is one."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import factor_quality, fill_middle as fim, hard_negatives as hard


# ---- fill in the middle

def plain_form(doc_id, text, markers=("<P>", "<S>", "<M>")):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(text)
    if not text or any(m in text for m in markers) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"{markers[1]}{s}{markers[0]}{p}{markers[2]}{m}"
    return n, "psm", a, b - a, f"{markers[0]}{p}{markers[1]}{s}{markers[2]}{m}"


def fim_texts():
    rnd = random.Random(1)
    alphabet = "ab é😀\n<>PSM漢́"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 900))) for _ in range(150)]
    shared = "".join(rnd.choice("the quick brown fox é ") for _ in range(20_000))
    texts += [shared, "x" + shared, shared + "😀" * 5000, "a" * 70_000, "😀" * 30_000, shared * 20]
    texts += ["", None, " ", "<", "<P", "P>", "<P>", "a<S>b", "x" * 255 + "<M>", "x" * 16_383 + "<P>", "😀"]
    return [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (7, texts[7]), (7, "another row of this id")]


def test_fill_middle_equals_brute_force(spark):
    rows = fim_texts()
    df = spark.createDataFrame([(i, t, "mine", 5, "old") for i, t in rows], "doc_id bigint, text string, _draws string, N int, FORM string")
    out = fim.fill_middle(df).withColumn("restored", fim.restored(F.col("output"), F.col("form")))
    assert out.columns == ["doc_id", "text", "_draws", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    got = out.collect()
    assert len(got) == len(rows) and {r["_draws"] for r in got} == {"mine"}
    have = sorted(((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got), key=repr)
    assert have == sorted(((i, t, *plain_form(i, t)) for i, t in rows), key=repr)
    assert all(r["restored"] == (r["text"] or "") for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_middle(df.limit(0)).count() == 0


def test_fill_middle_with_other_markers(spark):
    markers = fim.Markers("<|pre|>", "<|suf|>", "<|mid|>")
    rows = [(i, f"{'word ' * i}<P> tail <|{'suf|>' if i % 9 == 0 else ''}") for i in range(60)]
    out = fim.fill_middle(spark.createDataFrame(rows, "doc_id bigint, text string"), markers=markers, least=4, chunk_bits=3, most=40)
    got = out.withColumn("restored", fim.restored(F.col("output"), F.col("form"), markers)).collect()
    want = {i: plain_form(i, t, markers.all()) for i, t in rows}
    assert all((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == want[r["doc_id"]] and r["restored"] == r["text"] for r in got)


def test_chunks_follow_content_and_are_shared():
    rnd = np.random.default_rng(2)
    shared = rnd.integers(97, 123, 200_000).astype(np.uint8)
    other = np.concatenate([rnd.integers(97, 123, 777).astype(np.uint8), shared])
    ends, moved = fim.chunk_ends(shared, 11, 256, 16_384), fim.chunk_ends(other, 11, 256, 16_384)
    assert ends[-1] == len(shared) and max(np.diff([0, *ends])) <= 16_384 and min(np.diff([0, *ends])[:-1]) >= 256
    assert len({e + 777 for e in ends} & set(moved)) > 0.9 * len(ends)
    # A long text is hashed in blocks, which must not show.
    assert fim.chunk_ends(other, 11, 256, 16_384, at_once=1000) == moved
    memo = fim.Chunks(("<P>",))
    memo.text(shared.tobytes(), ends)
    before = memo.made
    memo.text(other.tobytes(), moved)
    assert memo.made - before < 0.1 * before
    small = fim.Chunks(("<P>",), max_bytes=10_000)
    for _ in range(3):
        counts, marked = small.text(other.tobytes(), moved)
        assert counts[-1] == len(other) and not marked
    assert sum(map(len, [*small.young, *small.old])) < 3 * 30_000


def test_rolling_hash_equals_its_sum():
    data = np.random.default_rng(3).integers(0, 256, 100).astype(np.uint8)
    got = fim.rolling(data)
    for i in range(100):
        assert int(got[i]) == sum(int(fim.VALUES[data[i - k]]) << k for k in range(fim.SPAN) if i >= k) % (1 << 32)


# ---- quality

def test_pair_sum_equals_brute_force():
    rng = np.random.default_rng(4)
    machine = factor_quality.Machine(20, (), 0.3, rng.normal(size=20 + 16 * 16), rng.normal(size=(20 + 16 * 16, 3)))
    counts = np.array([3, 0, 7, 1])
    at, value = rng.choice(machine.places, counts.sum()), rng.normal(size=counts.sum())
    got = machine.odds(at, value, counts)
    for text, end in enumerate(np.cumsum(counts)):
        own = range(end - counts[text], end)
        want = 0.3 + sum(machine.linear[at[i]] * value[i] for i in own)
        want += sum(machine.factors[at[i]] @ machine.factors[at[j]] * value[i] * value[j] for i in own for j in own if i < j)
        assert math.isclose(got[text], want, abs_tol=1e-9)


def quality_rows(n=400):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rnd.randrange(5, 80))]
        if i % 4 == 0:
            words = [w.upper() + "!!" for w in words] if i % 8 else [w + rnd.choice(["***", "&&&", "$$$"]) for w in words]
        rows.append((i, " ".join(words), len(words)))
        labels.append((i, int(i % 4 != 0)))
    return rows, labels


def test_quality_learns_and_handles_odd_rows(spark):
    rows, labels = quality_rows()
    odd = [(9001, None, None), (9002, "", 0), (9003, "\n\t ", -5), (None, "no id", 3), (9004, "abc def " * 60_000, 10**12), (9005, "!!!", 1), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(*r, "clash", "c") for r in rows + odd], "doc_id bigint, text string, size bigint, score string, _label string")
    known = spark.createDataFrame([(*x, 1) for x in labels] + [(3, None, 1), (None, 1, 1), (4, 7, 0), (99999, 0, 0)], "doc_id bigint, quality int, toxic int")
    machine = factor_quality.train(docs, known, metadata=("size",), words=1 << 10, rounds=60)
    out = factor_quality.score(docs, machine)
    assert out.columns == ["doc_id", "text", "size", "_label", "score"]
    got = out.collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    held = {r["doc_id"] for r in docs.filter(factor_quality.held_out(F.col("doc_id"))).collect()}
    assert None in held
    asked = [(i, y) for i, y in labels if i in held]
    assert 90 < len(asked) < 180
    assert sum((by[i] >= 0.5) == (y == 1) for i, y in asked) >= 0.97 * len(asked)
    assert len({r["score"] for r in got if r["doc_id"] == 5}) == 1
    assert factor_quality.score(docs.limit(0), machine).count() == 0


def test_quality_learns_nothing_from_held_out_labels(spark):
    rows, labels = quality_rows(120)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, size bigint")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int")
    turned = known.withColumn("quality", F.when(factor_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (factor_quality.train(docs, k, words=256, rounds=5) for k in (known, turned))
    assert a.bias == b.bias and (a.linear == b.linear).all() and (a.factors == b.factors).all()


def test_quality_without_both_classes(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id bigint, text string")
    ones = docs.select("doc_id", F.lit(1).alias("quality"))
    for labels, want in ((ones.limit(0), 0.5), (ones, None)):
        scores = {round(r["score"], 6) for r in factor_quality.score(docs, factor_quality.train(docs, labels)).collect()}
        assert len(scores) == 1 and (scores == {want} if want else min(scores) > 0.9)


# ---- hard negatives

def plain_negatives(rows, is_anchor, scale=256, keep=5):
    fine = []
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.append((i, [math.floor(x * scale) if abs(x) < 1 << 52 else int(x) * scale for x in v], label))
    anchors = {}
    for i, v, label in fine:
        if is_anchor(i) and (i not in anchors or (label, v) < anchors[i]):
            anchors[i] = (label, v)
    out = []
    for a, (own, av) in anchors.items():
        pairs = []
        for i, v, label in fine:
            if i != a and len(v) == len(av):
                s = sum(x * y for x, y in zip(av, v))
                if -(1 << 63) <= s < 1 << 63:
                    pairs.append((-s, i, label))
        pairs.sort()
        for ps, p, _ in [x for x in pairs if x[2] == own][:keep]:
            near = [x for x in pairs if x[2] != own and 80 * -ps <= 100 * -x[0] <= 100 * -ps][:keep]
            out += [(a, p, k, i, -ps, -s) for k, (s, i, _) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.1, 40.0, 1e9, 1e200])
def test_hard_negatives_equal_brute_force(spark, spread):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=6)
    rows = [(i, ((centre + rng.normal(size=6)) * spread).tolist(), int(rng.integers(0, 4))) for i in range(400)]
    rows += [(1000 + i, rows[10][1], i % 3) for i in range(40)]  # equal vectors
    rows += [(20, rows[3][1], 2), (33, rows[33][1], rows[33][2]), (33, rows[33][1], rows[33][2])]  # repeated ids
    rows += [(2000, None, 1), (2010, [1.0, None] + [0.0] * 4, 1), (2020, [float("nan")] + [1.0] * 5, 1), (2030, [float("inf")] + [1.0] * 5, 1), (2040, [1.0] * 6, None),
             (None, [1.0] * 6, 1), (2050, [1.0, 2.0], 1), (2060, [1.0, 2.0], 1), (2061, [1.0, 2.0], 2), (2070, [], 1), (2080, [0.0] * 6, 1), (2090, [-1.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("cell", F.lit("clash")).withColumn("id", F.lit("x"))
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    got = hard.hard_negatives(df, F.col("vec_id") % 10 == 0, block=100, anchor_block=20).collect()
    assert sorted(tuple(r) for r in got) == want
    assert want or spread > 1e100


def test_hard_negatives_of_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [1.0, 0.7], 2)], "vec_id bigint, embedding array<float>, label int")
    got = hard.hard_negatives(df, F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 131072, 111360)]
    assert hard.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert hard.hard_negatives(df, F.lit(False)).count() == 0


def test_packed_products_equal_plain_ones():
    rng = np.random.default_rng(8)
    for low, high in ((-128, 128), (0, 3), (-90, -80), (-(1 << 30), 1 << 30)):
        a, c = rng.integers(low, high, (7, 16)).astype(np.float64), rng.integers(low, high, (101, 16)).astype(np.float64)
        packed = hard.Packed(c, a)
        assert packed.native == (high < 1 << 20) and (packed.fields >= 2 or not packed.native)
        scores, fits = packed.scores(a)
        exact = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in c] for u in a]
        ok = np.array([[-(1 << 63) <= s < 1 << 63 for s in line] for line in exact])
        assert (np.ones_like(ok) if fits is None else fits).tolist() == ok.tolist()
        assert all(int(scores[i, j]) == exact[i][j] for i in range(7) for j in range(101) if ok[i, j])
