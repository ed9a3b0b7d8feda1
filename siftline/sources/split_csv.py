"""Quoted CSV read in byte ranges, so that one file of any size is read by many tasks.

A line break inside quotes does not end a record, so a task that starts in the middle of a file does
not know whether its first line begins a record. It need not: what a range does to the reader's state (outside or inside a quoted
field) is a function of two values, and functions of consecutive ranges compose. One pass takes these functions, for every
separator in question, together with the facts that decide on the charset, the header and the number of records.
Composing them, one short row per range, gives the state in which each range starts. A second pass cuts the
records. Spark need not deal out the same ranges again, as their size depends on the files read together and on the cores there are, so the
second pass takes nothing from the first about ranges: where records span lines, it cuts the lines from either state until both agree,
which is soon, is written down with what its ranges do, and the rows of the right state are kept. Records that cross from one range into the
next are put together from their pieces, of which a range has two at most.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from siftline.operators.dedup import SEQ, file_path
from siftline.session import new_folder

BOM = b"\xef\xbb\xbf"
# Byte values that have no meaning in the Windows Turkish code page.
UNDEFINED = bytes((0x81, 0x8D, 0x8E, 0x8F, 0x90, 0x9D, 0x9E))

RANGES = (
    "path string, block bigint, valid boolean, undefined boolean, from_outside array<boolean>, from_inside array<boolean>, "
    "records_outside array<bigint>, records_inside array<bigint>, spans_outside array<boolean>, spans_inside array<boolean>, firsts array<array<binary>>"
)
PIECES = "path string, block bigint, assumed boolean, line bigint, kind string, record binary"


def ends_inside(line: bytes, sep: bytes, inside: bool) -> bool:
    """Whether a quoted field is open at the end of a line that starts outside or inside of one.

    Quotes open a field only at its start; doubled ones belong to it; after a closing one the rest up to the separator does.
    """
    at, quoted = 0, sep + b'"'
    while True:
        if not inside:
            if line[at : at + 1] == b'"':
                at += 1
            else:
                at = line.find(quoted, at)
                if at < 0:
                    return False
                at += len(quoted)
        inside = False
        while True:
            end = line.find(b'"', at)
            if end < 0:
                return True
            at = end + 1
            if line[at : at + 1] != b'"':
                break
            at += 1
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)


def _lines(spark: SparkSession, paths: Sequence[str], pattern: str | None = None) -> DataFrame:
    """path, block (start of the byte range) and the bytes of each line, in file order within a task.

    With a ``pattern`` the paths are folders and all files in them that match it, at any depth, are read.
    """
    reader = spark.read.option("lineSep", "\n")
    if pattern is not None:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    raw = reader.text(list(paths))
    return raw.select(file_path().alias("path"), F.col("_metadata.file_block_start").cast("bigint").alias("block"), F.col("value").cast("binary").alias("line"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """Stretches of rows of one byte range: path, block, lines."""
    if not batch.num_rows:
        return
    block = batch.column("block").to_numpy()
    path = batch.column("path").dictionary_encode()
    code = path.indices.to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (code[1:] != code[:-1])])).tolist()
    for start, end in zip(starts, [*starts[1:], batch.num_rows]):
        yield path.dictionary[int(code[start])].as_py(), int(block[start]), batch.column("line").slice(start, end - start)


def _bare(line: bytes) -> bytes:
    return line[:-1] if line.endswith(b"\r") else line


class _Range:
    """What one byte range does, for each separator and each state it may start in."""

    def __init__(self, path: str, block: int, seps: Sequence[bytes], keep: int):
        self.path, self.block, self.seps, self.keep = path, block, seps, keep
        self.state = [[False, True] for _ in seps]
        self.records = [[0, 0] for _ in seps]
        self.spans = [[False, False] for _ in seps]  # whether a line ends inside quotes
        self.open = [[] for _ in seps]  # lines of the first records, if the range starts a file
        self.firsts: list[list[bytes]] = [[] for _ in seps]
        self.valid, self.undefined, self.fresh = True, False, True

    def add(self, lines: pa.Array) -> None:
        try:
            lines.cast(pa.string())
        except pa.ArrowInvalid:
            self.valid = False
            self.undefined |= any(b in UNDEFINED for line in lines.to_pylist() if not _is_utf8(line) for b in line)
        quoted = pc.fill_null(pc.greater_equal(pc.find_substring(lines, b'"'), 0), False).to_numpy(zero_copy_only=False)
        filled = ~pc.is_in(lines, value_set=pa.array([b"", b"\r"], lines.type)).to_numpy(zero_copy_only=False)
        places = np.flatnonzero(quoted).tolist()
        head = self.block == 0 and any(len(f) < self.keep for f in self.firsts)
        if head:  # the first records are wanted whole
            first = range(len(lines)) if len(lines) < 10_000 else range(10_000)
            places = sorted({*places, *first})
        done = 0
        for at in [*places, len(lines)]:
            plain = int(filled[done:at].sum())
            for records, state in zip(self.records, self.state):
                for i in (0, 1):
                    if not state[i]:
                        records[i] += plain
            if at == len(lines):
                break
            self._line(lines[at].as_py())
            done = at + 1

    def _line(self, line: bytes) -> None:
        if self.fresh and self.block == 0:
            line = line.removeprefix(BOM)
        self.fresh = False
        bare = _bare(line)
        for s, sep in enumerate(self.seps):
            for i in (0, 1):
                before = self.state[s][i]
                after = ends_inside(bare, sep, before) if b'"' in bare else before
                self.state[s][i] = after
                self.spans[s][i] |= after
                if not after and (before or bare):
                    self.records[s][i] += 1
                if i == 0 and self.block == 0 and len(self.firsts[s]) < self.keep:
                    self.open[s].append(line)
                    if not after:
                        record = _bare(b"\n".join(self.open[s]))
                        self.open[s] = []
                        if record:
                            self.firsts[s].append(record)

    def row(self) -> tuple:
        turned = [list(x) for x in zip(*self.state)]
        counts = [list(x) for x in zip(*self.records)]
        spans = [list(x) for x in zip(*self.spans)]
        return self.path, self.block, self.valid, self.undefined, *turned, *counts, *spans, self.firsts


def _is_utf8(line: bytes) -> bool:
    try:
        line.decode()
        return True
    except UnicodeDecodeError:
        return False


def scan_ranges(spark: SparkSession, paths: Sequence[str], separators: Sequence[str], *, first_records: int = 1, pattern: str | None = None) -> DataFrame:
    """The first pass: one row per byte range, with ``first_records`` records where a file starts."""
    seps = [s.encode() for s in separators]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("path", pa.string()), ("block", pa.int64()), ("valid", pa.bool_()), ("undefined", pa.bool_()), ("from_outside", pa.list_(pa.bool_())),
            ("from_inside", pa.list_(pa.bool_())), ("records_outside", pa.list_(pa.int64())), ("records_inside", pa.list_(pa.int64())),
            ("spans_outside", pa.list_(pa.bool_())), ("spans_inside", pa.list_(pa.bool_())), ("firsts", pa.list_(pa.list_(pa.binary()))),
        ])
        now: _Range | None = None
        for batch in batches:
            for path, block, lines in _runs(batch):
                if now is None or (now.path, now.block) != (path, block):
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, now.row()))], schema=schema)
                    now = _Range(path, block, seps, first_records)
                now.add(lines)
        if now is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, now.row()))], schema=schema)

    return _lines(spark, paths, pattern).mapInArrow(run, RANGES)


def file_facts(ranges: DataFrame, separators: Sequence[str]) -> DataFrame:
    """One row per file: charset facts and, per separator, records, first records, whether any spans lines, and the ranges that start inside quotes.

    A group is the ranges of one file, a row for each 128 MB or so of it.
    """
    n = len(separators)

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        inside, counts, spans, opened = [False] * n, [0] * n, [False] * n, [[] for _ in range(n)]
        for row in rows.itertuples():
            for s in range(n):
                if inside[s]:
                    opened[s].append(row.block)
                counts[s] += int((row.records_inside if inside[s] else row.records_outside)[s])
                spans[s] |= bool((row.spans_inside if inside[s] else row.spans_outside)[s])
                inside[s] = bool((row.from_inside if inside[s] else row.from_outside)[s])
        counts = [c + i for c, i in zip(counts, inside)]  # a quote that never closes: the rest is one record
        firsts = next((list(f) for f in rows["firsts"] if any(len(x) for x in f)), [[] for _ in range(n)])
        return pd.DataFrame([{
            "path": rows["path"].iloc[0], "valid": bool(rows["valid"].all()), "undefined": bool(rows["undefined"].any()), "records": counts,
            "firsts": [list(f) for f in firsts], "spans": spans, "opened": opened, "ends_inside": inside,
        }])

    kinds = "path string, valid boolean, undefined boolean, records array<bigint>, firsts array<array<binary>>, spans array<boolean>, opened array<array<bigint>>, ends_inside array<boolean>"
    return ranges.groupBy("path").applyInPandas(compose, kinds)


class _Cutter:
    """Cuts the lines of a range into records, from one state on. A header is left out where a file starts."""

    def __init__(self, sep: bytes, inside: bool, header: bool):
        self.sep, self.inside, self.head, self.header = sep, inside, inside, header
        self.open: list[bytes] = []
        self.begun = 0

    def add(self, number: int, line: bytes) -> tuple[int, str, bytes] | None:
        """The record that ends with this line: its first line's number, its kind and its bytes."""
        if b'"' in line:
            self.inside = ends_inside(_bare(line), self.sep, self.inside)
        if not self.open:
            self.begun = number
        self.open.append(line)
        if self.inside:
            return None
        record = _bare(b"\n".join(self.open))
        self.open = []
        if self.head:
            self.head = False
            return self.begun, "head", record
        if not record:
            return None
        if self.header:
            self.header = False
            return None
        return self.begun, "whole", record

    def rest(self) -> tuple[int, str, bytes] | None:
        return (self.begun, "body" if self.head else "tail", b"\n".join(self.open)) if self.open else None


def _pieces(lines: DataFrame, sep: str, header: bool, spanning: bool) -> DataFrame:
    """The second pass: whole records, and the pieces of those that cross ranges.

    kind: whole; tail (starts here, goes on in the next range), body (goes through the range), head (ends here). ``assumed`` is
    null or the state at the range's start, inside or not, without which the row is wrong. A row of kind range says in
    ``line`` in which state the range ends: from outside in the first bit, from inside in the second.
    Without ``spanning`` no record has more than one line.
    """
    mark = sep.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        range_, number, cutters = None, 0, []

        def end() -> None:
            for assumed, cutter in cutters:
                if piece := cutter.rest():
                    found.append((*range_, assumed, *piece))
            if range_ is not None:
                found.append((*range_, None, cutters[0][1].inside + 2 * cutters[-1][1].inside, "range", None))

        def flush() -> Iterator[pa.RecordBatch]:
            if found:
                kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], names=["path", "block", "assumed", "line", "kind", "record"])
                found.clear()

        for batch in batches:
            for path, block, lines in _runs(batch):
                if (path, block) != range_:
                    end()
                    range_, number = (path, block), 0
                    if block == 0 or not spanning:
                        cutters = [(None, _Cutter(mark, False, header and block == 0))]
                    else:
                        cutters = [(inside, _Cutter(mark, inside, False)) for inside in (False, True)]
                for line in lines.to_pylist():
                    if number == 0 and block == 0:
                        line = line.removeprefix(BOM)
                    for assumed, cutter in cutters:
                        if piece := cutter.add(number, line):
                            found.append((*range_, assumed, *piece))
                    number += 1
                    if len(cutters) > 1 and not any(cutter.open for _, cutter in cutters):
                        cutters = [(None, cutters[0][1])]  # both are between records, so they agree from here on
                yield from flush()
        end()
        yield from flush()

    return lines.mapInArrow(run, PIECES)


def _first_states(ranges: DataFrame) -> DataFrame:
    """path, block, inside: the state in which each range starts. A group is the ranges of one file."""

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        inside, states = False, []
        for ends in rows["line"]:
            states.append(inside)
            inside = bool(int(ends) >> inside & 1)
        return pd.DataFrame({"path": rows["path"], "block": rows["block"], "inside": states})

    return ranges.select("path", "block", "line").groupBy("path").applyInPandas(follow, "path string, block bigint, inside boolean")


def _stitched(pieces: DataFrame) -> DataFrame:
    """Records put together from their pieces: each tail with the bodies and the head that follow it in its file.

    Only pieces come here, at most two for each range.
    """
    order = Window.partitionBy("path").orderBy("block", F.col("kind") == "tail")
    numbered = pieces.withColumn("record_no", F.sum((F.col("kind") == "tail").cast("int")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("block", (F.col("kind") == "tail").alias("starts"), "line", "record")))
    joined = numbered.groupBy("path", "record_no").agg(parts.alias("parts"))
    start = F.col("parts")[0]
    text = F.aggregate(F.slice("parts", 2, 1 << 30), start["record"], lambda a, p: F.concat(a, F.lit(b"\n"), p["record"]))
    return joined.select("path", start["block"].alias("block"), start["line"].alias("line"), text.alias("record"))


def read_records(spark: SparkSession, paths: Sequence[str], *, sep: str, header: bool, spanning: bool) -> DataFrame:
    """path, block, line, record (bytes) of every record but headers.

    With ``spanning``, where records may span lines, the pieces are written to the shared folder: what the ranges do and the
    records cut in them have to come from one and the same reading.
    """
    pieces = _pieces(_lines(spark, paths), sep, header, spanning)
    if not spanning:
        return pieces.filter("kind IN ('whole', 'tail')").select("path", "block", "line", "record")
    folder = new_folder(spark, "csv-pieces")
    pieces.write.option("compression", "zstd").parquet(folder)
    pieces = spark.read.schema(PIECES).parquet(folder)
    states = F.broadcast(_first_states(pieces.filter("kind = 'range'")))  # one short row per range
    right = pieces.filter("kind <> 'range'").join(states, ["path", "block"]).filter("assumed IS NULL OR assumed = inside")
    whole = right.filter("kind = 'whole'").select("path", "block", "line", "record")
    return whole.unionByName(_stitched(right.filter("kind <> 'whole'").select("path", "block", "line", "kind", "record")))


def header_names(record: str, sep: str) -> list[str]:
    """Column names of a header record; unnamed and repeated ones get their place."""
    names = next(csv.reader([record], delimiter=sep), [])
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def parse(records: DataFrame, names: Sequence[str], *, sep: str, decode) -> DataFrame:
    """Columns of the records, all strings, and their position. ``decode`` turns the bytes into text."""
    schema = ", ".join(f"f{i} string" for i in range(len(names)))
    fields: Column = F.from_csv(decode(F.col("record")), schema, {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"})
    position = F.struct("path", "block", F.col("line").alias("row"))
    return records.select(fields.alias("fields"), position.alias(SEQ)).select(*[F.col(f"fields.f{i}").alias(n) for i, n in enumerate(names)], SEQ)
