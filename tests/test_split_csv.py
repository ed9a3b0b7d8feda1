"""Quoted CSV in byte ranges against Spark's reader of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from siftline.operators.dedup import SEQ
from siftline.sources import files, split_csv

CELLS = ["", "a", "plain text", 'say ""hi""', "one\ntwo", "\n\n", "x,y;z", "ğüş", " lead", "trail ", "\r\nwin", '""', "long " * 30]


def plain_states(text, sep):
    """State after each line by a character machine: is a quoted field open?"""
    out, inside, at_start, rest = [], False, True, False
    i = 0
    while i <= len(text):
        c = text[i : i + 1]
        if c in ("\n", ""):
            out.append(inside)
            at_start, rest = (at_start if inside else True), (rest if inside else False)
        elif inside:
            if c == '"':
                if text[i + 1 : i + 2] == '"':
                    i += 1
                else:
                    inside, rest = False, True
        elif c == sep:
            at_start, rest = True, False
        elif c == '"' and at_start and not rest:
            inside, at_start = True, False
        else:
            at_start = False
        i += 1
    return out


def test_line_states_equal_a_character_machine():
    rnd = random.Random(1)
    for _ in range(3000):
        text = "".join(rnd.choice('a,"\n ') for _ in range(rnd.randrange(0, 25)))
        state, got = False, []
        for line in text.split("\n"):
            state = split_csv.ends_inside(line.encode(), b",", state)
            got.append(state)
        assert got == plain_states(text, ","), repr(text)


def write_csv(path, rnd, rows, sep=",", end="\n", charset="utf-8", bom=b""):
    lines = [sep.join(["id", "text", '"no\nte"'])]
    for i in range(rows):
        cells = [rnd.choice(CELLS) for _ in range(2)]
        quoted = ['"' + c + '"' if any(x in c for x in '\n"' + sep) or rnd.random() < 0.2 else c.replace('"', "") for c in cells]
        lines.append(sep.join([str(i), *quoted]))
        if rnd.random() < 0.05:
            lines.append("")
    path.write_bytes(bom + end.join(lines).encode(charset) + (end.encode() if rnd.random() < 0.5 else b""))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("end, bom", [("\n", b""), ("\r\n", b"\xef\xbb\xbf")])
def test_ranges_equal_the_whole_read(spark, tmp_path, end, bom):
    rnd = random.Random(2)
    path = tmp_path / "one.csv"
    write_csv(path, rnd, 400, end=end, bom=bom)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "250")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        facts = files.csv_facts(spark, [str(path)], [","]).collect()
        assert len(facts) == 1 and len(facts[0]["opened"][0]) >= 3
        got = files.read_csv_robust(spark, str(path))
        assert got.columns == ["id", "text", "no\nte", SEQ]
        scans = split_csv._lines(spark, [str(path)])
        assert scans.rdd.getNumPartitions() > 10
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).option("lineSep", end).csv(str(path))
    want = [tuple(r) for r in whole.collect()]
    assert facts[0]["records"][0] == len(want) + 1
    ordered = [tuple(r)[:3] for r in sorted(rows, key=lambda r: tuple(r[SEQ]))]
    if end == "\r\n":  # a lone line feed inside quotes is one in both
        assert [o[0] for o in ordered] == [w[0] for w in want]
    assert ordered == want


def test_records_longer_than_ranges_and_open_ends(spark, tmp_path):
    path = tmp_path / "long.csv"
    long = "line\n" * 400
    path.write_text(f'a,b\n1,"{long}"\n2,x\n3,"{long}{long}"\n4,"never closed\nto the end\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = [tuple(r)[:2] for r in sorted(files.read_csv_robust(spark, str(path)).collect(), key=lambda r: tuple(r[SEQ]))]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got[:3] == [("1", long), ("2", "x"), ("3", long + long)] and got[3][0] == "4" and "to the end" in got[3][1]


def test_charset_is_decided_over_all_ranges(spark, tmp_path):
    for name, charset in (("tr", "cp1254"), ("iso", "iso-8859-9")):
        rows = "\n".join(f'{i},"güneş\nığdır{chr(0x85) if charset != "cp1254" else "€"}"' for i in range(200))
        (tmp_path / f"{name}.csv").write_bytes(f"id,text\n{rows}\n".encode(charset))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        facts = {r["path"].split("/")[-1]: r["charset"] for r in files.csv_facts(spark, [str(tmp_path / "tr.csv"), str(tmp_path / "iso.csv")], [","]).collect()}
        got = files.read_csv_robust(spark, str(tmp_path / "tr.csv")).select("text").distinct().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert facts["tr.csv"] == "cp1254"
    assert [r["text"] for r in got] == ["güneş\nığdır€"]


def test_records_do_not_depend_on_how_the_ranges_were_dealt_before(spark, tmp_path):
    rows = {"utf": [f"line {i}\n{i}, more\nend" for i in range(300)], "tr": [f"ığdır {i}\n{i}, daha\nson" for i in range(300)]}
    for name, charset in (("utf", "utf-8"), ("tr", "cp1254")):
        body = "\n".join(f'{i},"{t}"' for i, t in enumerate(rows[name]))
        (tmp_path / f"{name}.csv").write_bytes(f"id,text\n{body}\n".encode(charset))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    try:
        for name, value in zip(names, ("700", "0")):
            spark.conf.set(name, value)
        got = files.read_csv_robust(spark, [str(tmp_path / "utf.csv"), str(tmp_path / "tr.csv")])
        spark.conf.set(names[0], "450")  # as if there were more cores, or fewer files
        found = sorted(tuple(r) for r in got.select(F.col("id").cast("int").alias("id"), "text").collect())
    finally:
        for name in names:
            spark.conf.unset(name)
    assert found == sorted((i, t) for texts in rows.values() for i, t in enumerate(texts))
