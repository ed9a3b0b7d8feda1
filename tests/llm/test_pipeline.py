"""The pipeline on the smallest table, each stage against a plain version of what it must do."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import simhash_index
from siftline.llm.common import stored, tokenizer_path

SF = "/root/testdata/sf0.001"


def smallest_of_groups(texts):
    """Smallest id of each group of texts that fingerprints at three bits or fewer connect."""
    fps = {i: simhash_index.fingerprint((t or "").encode().lower().split(), width=3, seed=42, distinct=False) for i, t in texts.items()}
    group = {i: i for i in fps}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(fps)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return {root(i) for i in ids}


def test_stages_keep_other_columns(spark):
    rows = [(i, f"{'the garden and house with water ' * 3}{i}\nA shared line of more than twenty\nown {i * 7919}", "mine", 77, "k", 1.5) for i in range(12)]
    rows += [(None, None, "mine", 77, "k", 1.5), (30, "", "mine", 77, "k", 1.5), (3, rows[3][1], "mine", 77, "k", 1.5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept_text string, n_lines int, _key string, _toxicity double").withColumn("n_chars", F.lit(0).cast("bigint"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        seen = {(r["kept_text"], r["n_lines"], r["_key"], r["_toxicity"]) for r in out.collect()}
        assert seen <= {("mine", 77, "k", 1.5)} and (seen or name == "toxicity"), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    lines = {r["text"] for r in corpus_pipeline.drop_shared_lines(spark, docs, SF).collect()}
    assert sum("A shared line" in t for t in lines) == 1
    kept = corpus_pipeline.drop_copies(spark, docs, SF).select("doc_id").collect()
    assert {r["doc_id"] for r in kept} == smallest_of_groups({i: t for i, t, *_ in rows if i is not None}) and len(kept) == len({r["doc_id"] for r in kept})


def test_stages_do_their_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    rows = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs, _ = stored(stage(spark, docs, SF), "pipeline-test")
        after = {r["doc_id"]: r for r in docs.collect()}
        kept[name] = before, after
        if name != "sentencepiece":
            assert docs.columns == columns
        assert set(after) <= set(before)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = kept["toxicity"]
    clean = [i for i in before if labels.get(i) == 0]
    assert sum(i in after for i in clean) >= 0.9 * len(clean)

    before, after = kept["line dedup"]
    assert set(before) == set(after)
    key = lambda line: line.strip(" \t\n\x0b\f\r").lower()
    holders, top = Counter(), {}
    for i, r in before.items():
        for k in {key(x) for x in r["text"].split("\n")}:
            if len(k) >= 20:
                holders[k] += 1
                top[k] = max(top.get(k, -1), i)
    for i, r in before.items():
        lines = [x for x in r["text"].split("\n") if not (holders[key(x)] >= 3 and top[key(x)] != i)]
        assert after[i]["text"] == "\n".join(lines) and after[i]["n_chars"] == len(after[i]["text"])

    before, after = kept["simhash near-dedup"]
    assert set(after) == smallest_of_groups({i: r["text"] for i, r in before.items()})

    before, after = kept["benchmark decontamination"]
    items = [r["text"].lower().split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {i for i, r in before.items() for item in items if " ".join(item) in " ".join(r["text"].lower().split())}
    assert held.isdisjoint(after) and len(before) - len(after) <= len(held) + 2

    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=tokenizer_path(corpus_pipeline.MODEL))
    before, after = kept["sentencepiece"]
    assert set(before) == set(after)
    for i, r in after.items():
        assert list(r["ids"]) == library.encode(r["text"]) and r["decoded"] == library.decode(list(r["ids"]))
    assert rows and corpus_pipeline.ORACLE_SQL is None


def test_entry_registers_every_operator():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_python_workers_take_few_rows_at_a_time(spark, tmp_path):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    try:
        for now, then in (("10000", "2000"), ("0", "2000"), ("500", "500")):
            spark.conf.set(name, now)
            corpus_pipeline.tokenize(spark, docs, str(tmp_path))
            assert spark.conf.get(name) == then
    finally:
        spark.conf.set(name, before)
