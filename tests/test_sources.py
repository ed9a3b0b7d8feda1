import json
import os
import warnings

import pytest
from pyspark.sql import functions as F

from siftline.operators import dedup
from siftline.sources import corpora as C, files as Fi, tables as T


def spec(name):
    return next(s for s in C.SOURCES if s.name == name)


def load(spark, name, path):
    return C.load_source(spark, spec(name), str(path)).orderBy("_seq").collect()


def test_find_column():
    assert Fi.resolve_columns(["ID", "Mesaj Metni", "E-Posta"], {"text": ["text", "mesajmetni"]}) == {"text": "Mesaj Metni"}
    with pytest.raises(Fi.UnresolvedColumns, match="foo"):
        Fi.resolve_columns(["foo", "bar"], {"text": ["text"]}, source="x")


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1254", "iso-8859-9"])
def test_encodings(spark, tmp_path, encoding):
    path = tmp_path / "t.csv"
    path.write_bytes("text,etikett\nşok ĞÜİı 1,spam\n".encode(encoding) + (b"\x81x,ham\n" if encoding == "iso-8859-9" else b""))
    df = Fi.read_csv_robust(spark, str(path))
    rows = df.orderBy("_seq").collect()
    assert df.columns[0] == "text" and rows[0]["text"] == "şok ĞÜİı 1"


def test_files_in_different_encodings(spark, tmp_path):
    for name, encoding in (("a.csv", "utf-8"), ("b.csv", "cp1254")):
        (tmp_path / name).write_bytes(f"metin\nışık {name}\n".encode(encoding))
    rows = Fi.read_csv_robust(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()
    assert {r["metin"] for r in rows} == {"ışık a.csv", "ışık b.csv"}


def test_comma_and_semicolon_layouts(spark, tmp_path):
    a = tmp_path / "a.csv"
    a.write_text('Message,Group\n"Bedava bonus, hemen\ntiklayin",spam\n ,spam\nnan,spam\nYarin toplanti var,Normal \n', encoding="utf-8")
    rows = load(spark, "turkish_sms_collection", a)
    assert [(r["text"], r["label"], r["lang"]) for r in rows] == [("Bedava bonus, hemen\ntiklayin", "spam", "tr"), ("Yarin toplanti var", "bilgilendirme", "tr")]
    b = tmp_path / "b.csv"
    b.write_bytes("Message;Group;GroupText\r\n125 lira;2;Normal\r\nBedava bonus kazandiniz, hemen;1;Spam\r\n".encode())
    rows = load(spark, "turkish_sms_collection", b)
    assert [(r["text"], r["label"]) for r in rows] == [("125 lira", "bilgilendirme"), ("Bedava bonus kazandiniz, hemen", "spam")]


def test_unmapped_label_and_unknown_columns(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("Message,Group\nmerhaba,unknown_label\n ,other\n")
    with pytest.raises(ValueError, match="labels without a mapping: other, unknown_label"):
        load(spark, "turkish_sms_collection", bad)
    foo = tmp_path / "foo.csv"
    foo.write_text("foo,bar\nx,y\n")
    with pytest.raises(Fi.UnresolvedColumns):
        load(spark, "turkish_sms_collection", foo)
    raw = spark.createDataFrame([("a", "zzz")], "text string, label string")
    with pytest.raises(Exception, match="label without a mapping"):
        C.to_records(raw, name="n", lang="tr", label_map=C.SPAM_HAM, check=False).collect()


def test_headerless_tsv_and_v1_v2(spark, tmp_path):
    tsv = tmp_path / "SMSSpamCollection.csv"
    tsv.write_text("ham\tGo until jurong point\nspam\tFree entry\n")
    assert [r["label"] for r in load(spark, "sms_spam_collection", tsv)] == ["bilgilendirme", "spam"]
    v = tmp_path / "spam.csv"
    v.write_bytes("v1,v2,\nham,caf\xe9 ok,\n".encode("latin1"))
    assert load(spark, "sms_spam_collection", v)[0]["text"] == "café ok"


def test_positional_and_numeric_labels(spark, tmp_path):
    spark.createDataFrame([("merhaba", "0"), ("bonus", "1"), (None, None)], "`0.0` string, `0.0.1` string").write.parquet(str(tmp_path / "x.parquet"))
    rows = load(spark, "turkish_spam_dataset", tmp_path / "x.parquet")
    assert sorted((r["text"], r["label"]) for r in rows) == [("bonus", "spam"), ("merhaba", "bilgilendirme")]
    csv = tmp_path / "y.csv"
    csv.write_text("email,Category\nkazandin,1\nmerhaba,0\n")
    assert [r["label"] for r in load(spark, "turkish_spam_dataset", csv)] == ["spam", "bilgilendirme"]


def test_label_folders_and_csv_fallback(spark, tmp_path):
    for folder, name, content in [("e/x/Ham", "1.txt", b"hello"), ("e/spam", "2.txt", b"win \xff cash"), ("e/spam", "3.txt", b"  "), ("e/other", "4.txt", b"no"), ("e/spam/deep", "5.txt", b"no")]:
        os.makedirs(tmp_path / folder, exist_ok=True)
        (tmp_path / folder / name).write_bytes(content)
    rows = load(spark, "enron_spam", tmp_path / "e")
    assert sorted((r["text"], r["label"]) for r in rows) == [("hello", "bilgilendirme"), ("win � cash", "spam")]
    os.makedirs(tmp_path / "f")
    with pytest.raises(ValueError, match="no text files"):
        load(spark, "enron_spam", tmp_path / "f")
    (tmp_path / "f" / "enron.csv").write_text("text,label\nhi,ham\n")
    assert load(spark, "enron_spam", tmp_path / "f")[0]["label"] == "bilgilendirme"


def test_resolver_and_merge(spark, tmp_path):
    raw = tmp_path / "raw"
    os.makedirs(raw / "turkish_sms_collection")
    (raw / "turkish_sms_collection" / "b.csv").write_text("bad\n")
    (raw / "turkish_sms_collection" / "a.csv").write_text("Message,Group\nortak metin,spam\n")
    spark.createDataFrame([("ortak metin", "legitimate", 3), ("yeni", "spam", 4)], "text string, label string, sms_length int").write.parquet(str(raw / "turkishsms_ds" / "train.parquet"))
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        found = C.available_sources(spark, str(raw))
    assert list(found) == ["turkish_sms_collection", "turkishsms_ds"]
    assert sum("[skip]" in str(w.message) for w in caught) == 3
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert "turkishsms_ds" not in C.available_sources(spark, str(raw), skip=["turkishsms_ds"])
    merged = dedup.merge_sources(found)
    assert {(r["text"], r["label"], r["source"]) for r in merged.collect()} == {
        ("ortak metin", "spam", "turkish_sms_collection"), ("yeni", "spam", "turkishsms_ds"),
    }

    def broken():
        raise ValueError("boom")

    with pytest.raises(RuntimeError, match="source 'bad' failed: boom"):
        dedup.merge_sources({"bad": broken})


def record(spark, rows):
    return spark.createDataFrame(rows, "text string, label string, source string, lang string").withColumn(
        "extra", F.create_map(F.lit("k"), F.lit("ş"))
    )


def test_same_text_in_two_languages_and_sinks(spark, tmp_path):
    a = record(spark, [("x", "spam", "a", "tr"), ("x", "otp", "a", "tr")]).coalesce(1)
    b = record(spark, [("x", "reklam", "b", "tr"), ("x", "reklam", "b", "en")])
    merged = dedup.priority_merge([a, b])
    assert sorted((r["lang"], r["label"]) for r in merged.collect()) == [("en", "reklam"), ("tr", "spam")]
    summary = {(r["dimension"], r["value"]): r["records"] for r in dedup.corpus_summary(merged).collect()}
    assert summary[("total", None)] == 2 and summary[("lang", "en")] == 1 and summary[("source", "a")] == 1
    csv, parquet = T.write_corpus(merged, str(tmp_path / "out"))
    assert json.loads(spark.read.parquet(parquet).first()["extra"]) == {"k": "ş"}
    assert spark.read.option("header", True).option("escape", '"').csv(csv).columns == ["text", "label", "source", "lang", "extra"]
    split = merged.withColumn("split", F.lit("train"))
    T.write_splits(split, str(tmp_path / "splits"))
    back = T.read_split(spark, str(tmp_path / "splits"), "train")
    assert back.count() == 2 and back.first()["extra"] == {"k": "ş"}
    assert T.read_split(spark, str(tmp_path / "splits"), "val").count() == 0
    T.write_metrics(T.label_map_table(spark), str(tmp_path / "map"))
    assert spark.read.json(str(tmp_path / "map")).count() == 3


def test_seeds(spark, tmp_path):
    (tmp_path / "a.yaml").write_text('category: spam\nexamples:\n  - text: "bir"\n    notes: "n"\n  - text: "iki"\n', encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('{"category": "otp", "text": "kod 1234"}\n')
    rows = {r["text"]: r for r in T.read_seeds(spark, str(tmp_path)).collect()}
    assert rows["bir"]["extra"] == {"notes": "n"} and rows["iki"]["extra"] == {} and rows["kod 1234"]["label"] == "otp"
    (tmp_path / "c.yaml").write_text("category: nope\nexamples:\n  - text: x\n")
    with pytest.raises(Exception, match="unknown category"):
        T.read_seeds(spark, str(tmp_path)).collect()


def test_decision_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert T.read_decisions(spark, path).count() == 0
    rows = spark.createDataFrame([("a", "spam", "spam", "s"), ("b", "skip", "ham", "s")], "text string, label string, original_label string, original_source string")
    T.append_decisions(rows, path)
    T.append_decisions(rows.limit(1).withColumn("method", F.lit("bulk_rule")), path)
    with open(f"{path}/hand.json", "w") as f:
        f.write('\n{"text": "c", "label": "otp", "original_label": "ham", "original_source": "s"}\n')
    log = T.read_decisions(spark, path).collect()
    assert sorted((r["text"], r["method"]) for r in log) == [("a", "bulk_rule"), ("a", "manual"), ("b", "manual"), ("c", "manual")]
    T.append_confirmed(spark.createDataFrame([("t", "spam", "human_reviewed", "tr")], T.CONFIRMED_SCHEMA), str(tmp_path / "conf"))
    assert T.read_confirmed(spark, str(tmp_path / "conf")).count() == 1


def test_profiles(spark, tmp_path):
    os.makedirs(tmp_path / "s" / "ham")
    (tmp_path / "s" / "x.csv").write_text("a,b\n1,2\n3,4\n")
    (tmp_path / "s" / "ham" / "1.txt").write_text("x")
    (tmp_path / "s" / "empty.csv").write_text("\n\r\n")
    (tmp_path / "s" / "open.csv").write_text('a,b\n1,"2\n')
    (tmp_path / "tr.csv").write_bytes('şehir,"iki\nsatır"\n"a\nb",ğ\n\n1,2\n3,4\n5,6\n'.encode("cp1254"))
    report = {r["path"].rsplit("/", 1)[1]: r.asDict() for r in T.profile_sources(spark, str(tmp_path)).collect()}
    assert len(report) == 4
    assert (report["x.csv"]["columns"], report["x.csv"]["rows"], report["x.csv"]["error"]) == (["a", "b"], 2, None)
    assert report["x.csv"]["sample"] == ['{"a": "1", "b": "2"}', '{"a": "3", "b": "4"}']
    assert report["empty.csv"]["error"] == "no content" and report["empty.csv"]["rows"] is None
    assert "never closed" in report["open.csv"]["error"]
    assert report["tr.csv"]["columns"] == ["şehir", "iki\nsatır"] and report["tr.csv"]["rows"] == 4 and len(report["tr.csv"]["sample"]) == 3
    assert json.loads(report["tr.csv"]["sample"][0]) == {"şehir": "a\nb", "iki\nsatır": "ğ"}
    folders = T.profile_folders(spark, str(tmp_path)).collect()
    assert len(folders) == 1 and folders[0]["folder"].endswith("/ham") and folders[0]["files"] == 1


@pytest.mark.parametrize("name", ["two words.csv", "100%25 off.csv", "a+b.csv", "şık.csv"])
def test_awkward_file_names(spark, tmp_path, name):
    (tmp_path / name).write_bytes("text,label\nbir mesaj,spam\n".encode())
    (tmp_path / "old charset.csv").write_bytes("text,label\nşifre ığü,ham\n".encode("cp1254"))
    paths = [r["path"] for r in Fi.list_files(spark, str(tmp_path), "*.csv").collect()]
    rows = Fi.read_csv_robust(spark, paths).collect()
    assert sorted(r["text"] for r in rows) == ["bir mesaj", "şifre ığü"]


def test_header_that_begins_like_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "x.csv").write_text("ïd,text\n1,a\n", encoding="utf-8")
    (tmp_path / "y.csv").write_text("id,text\n1,a\n", encoding="utf-8-sig")
    assert Fi.read_csv_robust(spark, str(tmp_path / "x.csv")).columns[0] == "ïd"
    assert Fi.read_csv_robust(spark, str(tmp_path / "y.csv")).columns[0] == "id"


def test_first_decision_wins_whatever_the_file_sizes(spark, tmp_path):
    from siftline.plans.corpus import training_corpus
    from siftline.sources.tables import append_decisions, read_decisions

    path = str(tmp_path / "log")
    for label, extra in (("spam", 0), ("reklam", 500), ("bilgilendirme", 5)):
        rows = [("kampanya başladı", label, "ham", "x")] + [(f"{label} {i}", label, "ham", "x") for i in range(extra)]
        append_decisions(spark.createDataFrame(rows, "text string, label string, original_label string, original_source string"), path)
    kept = training_corpus(decisions=read_decisions(spark, path)).filter("text = 'kampanya başladı'").collect()
    assert [r["label"] for r in kept] == ["spam"]


def test_unmapped_labels_are_all_listed(spark):
    df = spark.createDataFrame([(f"L{i % 150}", "t") for i in range(300)] + [(None, "t"), ("spam", "t")], "label string, text string")
    found = C.unmapped_labels(df, C.labels_named("spam")).collect()
    assert len(found) == 151 and {r["records"] for r in found} == {1, 2}
