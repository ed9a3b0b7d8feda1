import datetime as dt
import math
import warnings

import pytest
from pyspark.sql import functions as F

from siftline.functions import net
from siftline.functions.zero_width import strip_zero_width
from siftline.functions.confusables import is_homoglyph_attack
from siftline.operators import evaluate as E, metrics as M, redirects as Rd, relabel as R, review as V, synth as S
from siftline.plans import classify as flow, training as T
from siftline.plans.corpus import training_corpus
from siftline.sources import tables
from siftline.streaming import jobs

REC = "text string, label string, source string, lang string"


def records(spark, rows):
    return spark.createDataFrame(rows, REC).withColumn("extra", F.create_map().cast("map<string,string>"))


def seeds(spark):
    return records(spark, [("Hemen tiklayin, bonus kazandiniz.", "spam", "synthetic_seed", "tr"), ("toplanti saat uc.", "bilgilendirme", "synthetic_seed", "tr"), ("kod 123456 kimseyle paylasmayin", "otp", "synthetic_seed", "tr")])


# --- synthetic data


def test_paraphrase_properties(col):
    texts = ["Hemen tiklayin, (bonus) kazandiniz!", "merhaba dunya", "A", "", "x."]
    for n in (1, 3, 8):
        made = col(texts, lambda c: S.paraphrase(c, n))
        for text, variants in zip(texts, made):
            assert len(variants) == n == len(set(variants)) and text not in variants
    assert col(texts, lambda c: S.paraphrase(c, 3)) == col(texts, lambda c: S.paraphrase(c, 3))
    assert col(texts[:1], lambda c: S.paraphrase(c, 3)) != col(texts[:1], lambda c: S.paraphrase(c, 3, seed=7))
    words = {w for options in S.SYNONYMS.values() for w in options}
    assert any(w in v for v in col(texts[:1], S.paraphrase)[0] for w in words)
    assert all(v.count(",") == 1 for v in col(["hemen, gel"], lambda c: S.paraphrase(c, 2))[0])


def test_adversarial_variants(spark, col):
    text = "pasaport randevunuz ayarlandi"
    assert col([text], lambda c: is_homoglyph_attack(S.homoglyph_variant(c, fraction=0.8))) == [True]
    assert col([text], lambda c: S.homoglyph_variant(c, fraction=0.0)) == [text]
    assert col(["AEX bd"], lambda c: S.homoglyph_variant(c, fraction=1.0)) == ["аех bd"]
    assert col([text], lambda c: strip_zero_width(S.zero_width_variant(c, fraction=0.5))) == [text]
    parts = S.synthetic_corpus(seeds(spark), n_per_seed=2)
    rows = {name: df.collect() for name, df in parts.items()}
    assert [len(rows[k]) for k in ("seeds", "augmented", "adversarial")] == [3, 6, 18]
    adv = rows["adversarial"]
    assert {r["extra"]["variant_type"] for r in adv} == {"homoglyph", "zero_width"}
    assert {r["source"] for r in adv} == {S.ADVERSARIAL_SOURCE}
    # the chain adversarial -> augmented -> seed is kept although original_text names the last step only
    roots = {r["text"] for r in rows["seeds"]}
    assert {r["root_text"] for r in adv} == roots and any(r["extra"]["original_text"] not in roots for r in adv)


def test_synthetic_sink(spark, tmp_path):
    tables.write_synthetic(S.synthetic_corpus(seeds(spark), n_per_seed=1), str(tmp_path))
    assert spark.read.json(str(tmp_path / "adversarial.jsonl")).count() == 12
    with pytest.raises(ValueError, match="no seed"):
        tables.write_synthetic(S.synthetic_corpus(seeds(spark).limit(0)), str(tmp_path))


# --- relabelling


def test_relabel_loop(spark):
    corpus = records(spark, [("s1", "spam", "turkish_spam_dataset", "tr"), ("s2 casino", "spam", "turkish_sms_collection", "tr"), ("h1", "bilgilendirme", "turkish_sms_collection", "tr"), ("e", "spam", "sms_spam_collection", "en")])
    pool = R.order_candidates(R.candidate_pool(corpus))
    assert [(r["text"], r["original_label"]) for r in pool.orderBy("position").collect()] == [("s2 casino", "spam"), ("s1", "spam"), ("h1", "ham")]
    decided = spark.createDataFrame([("s1", "skip", "spam", "x", None)], "text string, label string, original_label string, original_source string, method string")
    assert R.next_undecided(pool, decided).collect()[0]["text"] == "s2 casino"
    left = R.undecided(pool, decided)
    made = R.bulk_decisions(left)
    assert [(r["text"], r["label"], r["method"]) for r in made.collect()] == [("s2 casino", "spam", "bulk_rule")]
    assert tuple(R.progress(pool, decided).first()) == (1, 3, 2)
    back = R.decisions_to_records(decided.unionByName(made)).collect()
    assert len(back) == 1 and back[0]["source"] == "manual_relabel" and back[0]["extra"]["method"] == "bulk_rule"


# --- corpus and splits


def test_training_corpus_priorities(spark):
    decisions = spark.createDataFrame([("ortak", "reklam", "ham", "x", None)], "text string, label string, original_label string, original_source string, method string")
    public = records(spark, [("ortak", "bilgilendirme", "pub", "tr"), ("toplanti saat uc.", "reklam", "pub", "tr")])
    df = training_corpus(decisions=decisions, sources={"pub": lambda: public}, seeds=seeds(spark), n_per_seed=1)
    rows = {r["text"]: r for r in df.collect()}
    assert rows["ortak"]["label"] == "reklam" and rows["ortak"]["source"] == "manual_relabel"
    assert rows["toplanti saat uc."]["source"] == "pub"
    assert "otp" not in {r["label"] for r in rows.values()}


def balanced(spark, n=20):
    return records(spark, [(f"{label} {i}", label, "x", "tr") for label in ("bilgilendirme", "reklam", "spam") for i in range(n)])


def test_split_is_stratified_exact_and_repeatable(spark):
    df = balanced(spark)
    got = T.split_dataset(df, val_size=0.2, test_size=0.2).collect()
    counts = {}
    for r in got:
        counts[(r["split"], r["label"])] = counts.get((r["split"], r["label"]), 0) + 1
    assert len(got) == 60 and all(counts[(s, l)] == (12 if s == "train" else 4) for s in ("train", "val", "test") for l in ("bilgilendirme", "reklam", "spam"))
    again = T.split_dataset(df.repartition(7), val_size=0.2, test_size=0.2).collect()
    assert {(r["text"], r["split"]) for r in got} == {(r["text"], r["split"]) for r in again}


def test_split_falls_back_when_a_class_is_too_small(spark):
    df = balanced(spark).unionByName(records(spark, [("tek", "otp", "x", "tr")]))
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        got = T.split_dataset(df, val_size=0.2, test_size=0.2)
    assert any("stratified split failed" in str(w.message) for w in caught)
    assert {r["split"]: r["n"] for r in got.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 37, "val": 12, "test": 12}


def test_grouped_split_keeps_variants_together(spark):
    df = balanced(spark, 12).withColumn("root_text", F.concat("label", F.lit("-"), F.regexp_extract("text", r"(\d+)$", 1).cast("int") % 6))
    got = T.split_dataset(df, val_size=0.2, test_size=0.2, group_col="root_text")
    per_root = got.groupBy("root_text").agg(F.count_distinct("split").alias("n"), F.count("*").alias("rows")).collect()
    assert all(r["n"] == 1 for r in per_root) and sum(r["rows"] for r in per_root) == 36


def test_train_score_evaluate(spark):
    words = {"bilgilendirme": "siparis teslim randevu", "reklam": "indirim kampanya firsat", "spam": "bahis bonus kazandiniz"}
    rows = [(f"{w} mesaj {i}", label, "x", "tr") for label, text in words.items() for i in range(15 if label != "spam" else 5) for w in [text]]
    df = records(spark, rows)
    model, report = T.train_classifier(df, df, num_features=1 << 10, max_iter=8)
    assert {r["candidate"] for r in report.collect()} == {"class_weights", "focal"}
    assert T.evaluate_model(model, df).first()["f1_macro"] > 0.9
    msgs = spark.createDataFrame([("1", "bahis bonus"), ("2", "kodunuz 123456 kimseyle paylasmayin")], "message_id string, text string")
    got = {r["message_id"]: r for r in flow.classify(msgs, flow.ml_scorer(model)).collect()}
    assert got["1"]["label"] == "spam" and abs(sum(got["1"]["probabilities"].values()) - 1) < 1e-9
    assert got["2"]["probabilities"] == {"otp": 0.95}


# --- metrics and losses


def test_focal_loss_and_weights(spark):
    df = spark.createDataFrame([(0.9,), (0.2,)], "p double")
    zero = [r[0] for r in df.select(E.focal_loss("p", gamma=0.0)).collect()]
    assert zero == pytest.approx([-math.log(0.9), -math.log(0.2)])
    two = [r[0] for r in df.select(E.focal_loss("p", alpha=5.0)).collect()]
    assert two == pytest.approx([5 * 0.01 * -math.log(0.9), 5 * 0.64 * -math.log(0.2)])
    assert E.focal_loss_summary(df, E.focal_loss("p", gamma=0.0), reduction="sum").first()[0] == pytest.approx(sum(zero))
    rows = spark.createDataFrame([("spam",)] * 9 + [("reklam",)], "label string")
    weights = {r["label"]: r["weight"] for r in E.class_weights(rows).collect()}
    assert weights == pytest.approx({"spam": 10 / 27, "reklam": 10 / 3, "bilgilendirme": 10 / 3})


def test_macro_metrics(spark):
    pairs = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")]
    row = E.macro_metrics(spark.createDataFrame(pairs, "label string, prediction string")).first()
    assert (row["accuracy"], row["precision_macro"], row["recall_macro"], row["f1_macro"]) == pytest.approx((0.5, (1 + 1 / 3 + 0) / 3, (0.5 + 1 + 0) / 3, (2 / 3 + 0.5 + 0) / 3))
    cases = E.regression_cases(spark.createDataFrame([("spam", "spam", 0.9, "n1"), ("otp", "spam", 0.5, "n2")], "expected string, label string, confidence double, note string"))
    assert tuple(E.regression_summary(cases).first()) == (2, 1, 1, False)
    assert [r["note"] for r in E.regression_failures(cases).collect()] == ["n2"]


def test_histogram_and_counters(spark):
    df = spark.createDataFrame([("spam", 0.95, False, True), ("spam", 0.4, True, False), ("otp", 1.0, False, False)], "label string, confidence double, needs_review boolean, is_outbreak_candidate boolean")
    hist = {r["le"]: r["messages"] for r in M.confidence_histogram(df).collect()}
    assert (hist["0.3"], hist["0.4"], hist["0.9"], hist["1.0"], hist["+Inf"]) == (0, 1, 1, 3, 3)
    assert tuple(M.counters(df).first()) == (3, 1, 1)
    assert {tuple(r) for r in M.messages_by_label(df).collect()} == {("spam", 2), ("otp", 1)}


# --- classification and review


def fixed_scorer(confidence):
    return flow.column_scorer(lambda text: [F.lit(confidence), F.lit((1 - confidence) * 0.6), F.lit((1 - confidence) * 0.4)])


@pytest.mark.parametrize("confidence,flagged", [(0.39, False), (0.4, True), (0.5, True), (0.6, True), (0.61, False), (0.95, False)])
def test_review_band(spark, confidence, flagged):
    df = spark.createDataFrame([(confidence,)], "confidence double")
    assert df.select(V.needs_human_review("confidence")).first()[0] is flagged


def test_ties_go_to_the_lowest_label_id(spark):
    df = spark.createDataFrame([(1,)], "i int").select(F.create_map(F.lit("spam"), F.lit(0.4), F.lit("reklam"), F.lit(0.4), F.lit("bilgilendirme"), F.lit(0.2)).alias("p"))
    assert df.select(E.best_label("p")["label"]).first()[0] == "reklam"


def test_python_scorer_never_sees_rule_rows(spark):
    def load_model():
        def predict(texts):
            assert not any("123456" in t for t in texts)
            return [[0.1, 0.2, 0.7] if "casino" in t else [0.8, 0.1, 0.1] for t in texts]

        return predict

    msgs = spark.createDataFrame([("1", "casino pаra https://bit.ly/x"), ("2", "onay kodu 123456"), ("3", "b​ir")], "message_id string, text string")
    rows = {r["message_id"]: r for r in flow.classify(msgs, flow.batch_scorer(load_model)).collect()}
    assert (rows["1"]["label"], rows["1"]["confidence"], rows["1"]["homoglyph_attack_detected"]) == ("spam", 0.7, True)
    assert rows["1"]["cleaned_text"] == "casino para https://bit.ly/x" and rows["1"]["urls_found"] == ["https://bit.ly/x"]
    assert (rows["2"]["label"], rows["2"]["confidence"], rows["2"]["probabilities"]) == ("otp", 0.95, {"otp": 0.95})
    assert rows["3"]["cleaned_text"] == "bir" and rows["3"]["label"] == "bilgilendirme"


def test_review_flow(spark):
    msgs = spark.createDataFrame([(str(i), f"mesaj {i}") for i in range(4)], "message_id string, text string")
    scored = flow.classify(msgs, fixed_scorer(0.5))
    when = F.timestamp_seconds(F.lit(1000) - F.col("message_id").cast("int"))
    items = V.review_items(scored, created_at=when).checkpoint()
    ids = {r["message_id"]: r["item_id"] for r in items.collect()}
    none = spark.createDataFrame([], "item_id string, decision string, corrected_label string, decided_at int")
    assert [r["message_id"] for r in V.list_pending(items, none, limit=2).collect()] == ["3", "2"]
    decisions = spark.createDataFrame(
        [(ids["0"], "approve", "spam", 1), (ids["0"], "reject", None, 2), (ids["1"], "approve", "", 1), (ids["2"], "reject", None, 1), ("zzz", "approve", None, 1), (ids["3"], "maybe", None, 1), (ids["3"], "approve", "bogus", 1)],
        none.schema,
    )
    resolved, errors = V.resolve(items, decisions)
    got = {r["message_id"]: (r["final_label"], r["appended"]) for r in resolved.collect()}
    assert got == {"0": ("spam", True), "1": ("bilgilendirme", True), "2": (None, False)}
    assert sorted(r["reason"] for r in errors.collect()) == ["unknown decision", "unknown item", "unknown label"]
    confirmed = V.confirmed_records(resolved).collect()
    assert {(r["label"], r["source"], r["lang"]) for r in confirmed} == {("spam", "human_reviewed", "tr"), ("bilgilendirme", "human_reviewed", "tr")}


# --- addresses and redirects


def test_blocked_addresses(col):
    blocked = ["127.0.0.1", "10.1.2.3", "172.16.0.5", "192.168.1.1", "169.254.169.254", "100.64.0.1", "0.0.0.0", "224.0.0.1", "240.0.0.1", "::1", "fe80::1", "fc00::1", "::ffff:127.0.0.1"]
    public = ["8.8.8.8", "1.1.1.1", "2606:4700:4700::1111", "::ffff:8.8.8.8", "172.32.0.1", "100.128.0.1"]
    assert col(blocked, net.is_blocked_ip) == [True] * len(blocked)
    assert col(public, net.is_blocked_ip) == [False] * len(public)
    assert col(["junk", "1.2.3", None], net.is_blocked_ip) == [True, True, None]


def test_ipv4_ranges_agree_with_the_standard_library(col):
    import ipaddress
    import random

    rng = random.Random(1)
    firsts = [0, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240, 255, 8]
    ips = [f"{rng.choice(firsts)}.{rng.choice([0, 18, 19, 51, 64, 127, 128, 168, 254, 16, 31, 32])}.{rng.choice([0, 2, 100, 113])}.{rng.randrange(256)}" for _ in range(500)]

    def blocked(text):
        ip = ipaddress.ip_address(text)
        return ip in ipaddress.ip_network("100.64.0.0/10") or ip.is_private or ip.is_multicast or ip.is_reserved or ip.is_unspecified or ip.is_loopback or ip.is_link_local

    special = {"192.0.0.170", "192.0.0.171"}
    ips = [i for i in ips if i not in special]
    assert col(ips, net.is_blocked_ip) == [blocked(i) for i in ips]


def test_redirects(spark):
    hops = [("http://entry.example/abc", 301, "http://relay.example/y", None), ("http://relay.example/y", 200, None, None), ("http://inward.example/a", 302, "http://intra.example/s", None)]
    hops += [(f"http://circle.example/{i}", 301, f"/{i + 1}", None) for i in range(9)]
    hops += [("http://getonly.example/x", 405, None, None), ("http://getonly.example/x", 200, None, None), ("http://lagging.example/", None, None, "Read timeout"), ("http://broken.example/", None, None, "reset"), ("http://8.8.8.8/ip", 200, None, None)]
    h = spark.createDataFrame(hops, "url string, status int, location string, error string")
    names = ["entry", "relay", "inward", "circle", "getonly", "lagging", "broken", "unlogged"]
    dns = spark.createDataFrame([(f"{n}.example", "8.8.4.4") for n in names] + [("intra.example", "8.8.8.8"), ("intra.example", "169.254.169.254")], "host string, ip string")
    starts = ["http://entry.example/abc", "http://inward.example/a", "http://circle.example/0", "http://getonly.example/x", "http://lagging.example/", "http://broken.example/", "file:///etc/passwd", "http://u:p@entry.example/x", "http://nodns.example/", "http://unlogged.example/", "http://8.8.8.8/ip", "http://127.0.0.1/", "http://[::1]/"]
    got = {r["original_url"]: r for r in Rd.resolve_redirects(spark.createDataFrame([(u,) for u in starts * 2], "url string"), h, dns).collect()}
    assert len(got) == len(starts)
    assert got[starts[0]]["status"] == "ok" and got[starts[0]]["redirect_chain"] == [starts[0], "http://relay.example/y"]
    assert got[starts[0]]["final_url"] == "http://relay.example/y"
    inner = got[starts[1]]
    assert inner["status"] == "blocked_ssrf" and "intra.example" in inner["error"] and inner["redirect_chain"] == [starts[1]]
    loop = got[starts[2]]
    assert loop["status"] == "too_many_redirects" and loop["final_url"] == "http://circle.example/6" and len(loop["redirect_chain"]) == 6
    assert [got[u]["status"] for u in starts[3:]] == ["ok", "timeout", "error", "blocked_ssrf", "blocked_ssrf", "blocked_ssrf", "error", "ok", "blocked_ssrf", "blocked_ssrf"]


# --- streaming


def test_stream_equals_batch_and_replay_is_idempotent(spark, tmp_path):
    base = "Depoda son urunler kaldi, gelin cutt.ly/"
    texts = [base + "x", "toplanti yarin saat uc", base + "x", base + "y", "onay kodu 123456", base + "x", "toplanti yarin saat uc", base + "x"]
    start = dt.datetime(2024, 1, 1)
    rows = [(i, t, start + dt.timedelta(seconds=40 * i)) for i, t in enumerate(texts)]
    schema = "message_id long, text string, ts timestamp"
    df = spark.createDataFrame(rows, schema)
    for low, high in ((0, 3), (3, 5), (5, 8)):
        df.filter((F.col("message_id") >= low) & (F.col("message_id") < high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    jobs.finish(jobs.start_classification_stream(stream, fixed_scorer(0.5), out, str(tmp_path / "state"), ttl_seconds=100), seconds=240)
    got = {r["message_id"]: r for r in jobs.read_results(spark, out).collect()}
    batch = flow.classify_with_outbreaks(df, fixed_scorer(0.5), ttl_seconds=100).collect()
    assert {(k, r["is_outbreak_candidate"], r["label"], r["best_similarity"]) for k, r in got.items()} == {
        (r["message_id"], r["is_outbreak_candidate"], r["label"], r["best_similarity"]) for r in batch
    }
    assert got[2]["is_outbreak_candidate"] and not got[6]["is_outbreak_candidate"]
    assert jobs.read_review_items(spark, out).count() == 7  # the rule row is certain
    # a replayed micro-batch sees the same index and adds nothing to it
    from siftline.operators.outbreak import fingerprint_messages
    from siftline.operators.outbreak_index import IndexOptions, OutbreakIndex

    fps = fingerprint_messages(df.filter("message_id >= 5")).checkpoint()
    index = OutbreakIndex(spark, f"{out}/index", IndexOptions(ttl_seconds=100))
    last = max(p.note["batch"] for p in index.parts())
    before = (index.log.snapshot().version, index._read("members", index.parts()).count())
    assert before[1] == len(rows)
    again = {r["message_id"]: r["is_outbreak_candidate"] for r in jobs.detect_batch(fps, last, f"{out}/index", ttl_seconds=100).collect()}
    assert again == {k: got[k]["is_outbreak_candidate"] for k in (5, 6, 7)}
    assert (index.log.snapshot().version, index._read("members", index.parts()).count()) == before


def test_metrics_stream_appends_closed_windows(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=20 * i), "spam", 0.5, True, i % 2 == 0) for i in range(12)]
    schema = "ts timestamp, label string, confidence double, needs_review boolean, is_outbreak_candidate boolean"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    jobs.finish(jobs.start_metrics_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), watermark="10 minutes"), seconds=240)
    closed = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    assert [r["messages"] for r in closed] == [3, 3, 3] and closed[0]["review_queue"] == 3


def test_resent_and_missing_ids_give_one_row_per_id(spark):
    from siftline.plans.classify import classify_with_outbreaks, column_scorer

    rows = [("a", "first text", 10), ("a", "second text", 20), ("b", "kodunuz", 5), (None, "no id", 7), (None, "no id", 8), (None, "no id either", 9)]
    df = spark.createDataFrame(rows, "message_id string, text string, s long").selectExpr("message_id", "text", "timestamp_seconds(s) AS ts")
    scorer = column_scorer(lambda t: [F.lit(0.4), F.lit(0.3), F.lit(0.3)])
    out = classify_with_outbreaks(df, scorer, hash_fn="md5").collect()
    assert sorted(r["text"] for r in out) == ["kodunuz", "no id", "no id either", "second text"]
    assert all(r["is_outbreak_candidate"] is not None and r["message_id"] for r in out)


def test_training_cuts_texts_once_in_bounded_tasks(spark, monkeypatch):
    """Both fits read counted words, in no more tasks than the cluster has use for and in blocks that outweigh the model."""
    from pyspark.ml.classification import LogisticRegression

    seen, fit = [], LogisticRegression.fit

    def watched(self, data, *rest):
        plan = data._jdf.queryExecution().executedPlan().toString()
        seen.append((data.rdd.getNumPartitions(), self.getMaxBlockSizeInMB(), "RegexTokenizer" in plan or "Join" in plan))
        return fit(self, data, *rest)

    monkeypatch.setattr(LogisticRegression, "fit", watched)
    rows = [(f"{word} text {i} {i % 7}", label) for label, word in (("reklam", "sale"), ("spam", "casino"), ("bilgilendirme", "meeting")) for i in range(20)]
    df = spark.createDataFrame(rows, "text string, label string").repartition(40)
    model, report = T.train_classifier(df, df, num_features=1 << 10, max_iter=8)
    assert T.evaluate_model(model, df).first()["f1_macro"] == 1.0 and report.count() == 2
    assert len(seen) == 2
    assert all(n <= 2 * spark.sparkContext.defaultParallelism and mb >= 16 and not again for n, mb, again in seen)


# --- variants are made in Arrow batches, with the draws that Spark's own hash takes


def test_variants_take_the_draws_of_the_jvm(spark):
    from siftline.functions.draws import row_seed
    from siftline.functions.zero_width import ZERO_WIDTH, inject_zero_width
    from siftline.schema import WHITESPACE

    texts = ["", None, " ", "a", "aeo 😀aeo😀x x", "\n\ta e", "ğüşiİıAEOPCXYI", "uzun bir metin, hemen tiklayin. " * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def in_jvm(purpose, piece):
        chars, base = F.split("t", ""), row_seed(F.col("t"), 42, purpose)
        draw = lambda pos, *more: F.xxhash64(base, pos, *[F.lit(m) for m in more])
        below = lambda value, share: F.pmod(value, F.lit(1_000_000)) / F.lit(1e6) < share
        return F.array_join(F.transform(chars, lambda c, pos: piece(chars, c, pos, draw, below)), "")

    def alike(chars, c, pos, draw, below):
        hit = c.isin(*(S.LATIN + S.LATIN.upper())) & below(draw(pos), 0.3)
        return F.when(hit, F.translate(F.lower(c), S.LATIN, S.CYRILLIC)).otherwise(c)

    def hidden(chars, c, pos, draw, below):
        after = F.get(chars, pos + 1)
        gap = after.isNotNull() & ~c.isin(*WHITESPACE) & ~after.isin(*WHITESPACE)
        which = F.get(F.array(*[F.lit(z) for z in ZERO_WIDTH]), F.pmod(draw(pos, 1), F.lit(len(ZERO_WIDTH))).cast("int"))
        return F.when(gap & below(draw(pos, 0), 0.2), F.concat(c, which)).otherwise(c)

    made = df.select("i", S.homoglyph_variant("t").alias("h"), inject_zero_width("t").alias("z"), S.paraphrase("t", 2).alias("p"))
    assert "lambdafunction" not in made._jdf.queryExecution().toString()  # a lambda a character took a microsecond
    rows = {r["i"]: r for r in made.collect()}
    for r in df.select("i", in_jvm("homoglyph", alike).alias("h"), in_jvm("zero_width", hidden).alias("z")).collect():
        assert (rows[r["i"]]["h"], rows[r["i"]]["z"]) == (r["h"], r["z"])
    assert rows[1]["p"] == [None] and all(len(set(rows[i]["p"]) - {texts[i]}) == 2 for i in rows if i != 1)
