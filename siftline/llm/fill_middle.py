"""Fill-in-the-middle forms of texts, cut by code points with the help of memoized text chunks.

A rolling hash cuts a text into chunks where its own content says so, thus a passage that many
texts share is cut alike in all of them. What cutting a text needs to know of a chunk is small and
can be combined: its code points, whether it holds a marker, and the bytes at its two ends (a
marker may lie across an end). It is worked out once per distinct chunk and kept in a bounded
memory keyed by the whole content, so a chunk is only taken for one seen before if all of its
bytes are equal. Sums of the chunks' counts lead to the chunk in which a cut falls; only that one
is searched for the place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftline.llm.word_codes import slices

#: Bytes that decide on a chunk end; the hash of a place covers this many bytes up to it.
SPAN = 16
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Markers:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _byte_values() -> np.ndarray:
    """A fixed 32-bit value per byte: the high half of odd multiples of the golden ratio, mixed once."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


VALUES = _byte_values()


def rolling(data: np.ndarray) -> np.ndarray:
    """For every place the sum of the values of its last ``SPAN`` bytes, each shifted by its distance."""
    sums = VALUES[data]
    reach = 1
    while reach < SPAN:  # each round doubles the bytes covered
        longer = sums.copy()
        longer[reach:] += sums[:-reach] << np.uint32(reach)
        sums, reach = longer, 2 * reach
    return sums


def chunk_ends(data: np.ndarray, bits: int, least: int, most: int, at_once: int = 1 << 20) -> list[int]:
    """Ends of the chunks of one text's bytes, between code points, the last one at its end.

    A chunk ends where the hash of the bytes before has ``bits`` leading zeros, no sooner than ``least`` bytes
    after the chunk's start and no later than ``most`` and a code point.
    """
    size = len(data)
    found = []
    for start in range(0, size, at_once):
        before = min(start, SPAN - 1)
        own = rolling(data[start - before : start + at_once])[before:]
        found.append(np.flatnonzero(own < np.uint32(1 << (32 - bits))) + (start + 1))
    places = np.concatenate(found) if found else np.zeros(0, np.int64)
    places = places[places < size]
    places = places[(data[places] & 0xC0) != 0x80].tolist()
    ends, last = [], 0
    for place in [*places, size]:
        while place - last > most:
            forced = last + most
            while (data[forced] & 0xC0) == 0x80:
                forced -= 1
            ends.append(forced)
            last = forced
        if place - last >= least or (place == size and place > last):
            ends.append(place)
            last = place
    return ends


class Chunks:
    """Summaries of chunks by content, in two generations of bounded size: what is not met again is forgotten."""

    def __init__(self, markers: Sequence[str], max_bytes: int = 32 << 20):
        self.markers = [m.encode() for m in markers]
        self.edge = max(map(len, self.markers)) - 1
        self.max_bytes, self.bytes, self.young, self.old = max_bytes, 0, {}, {}
        self.made = 0

    def summary(self, chunk: bytes) -> tuple[int, bool, bytes, bytes]:
        """Code points, whether it holds a marker, its first and its last bytes."""
        known = self.young.get(chunk)  # equal content, not just an equal hash
        if known is None:
            known = self.old.get(chunk)
            if known is None:
                self.made += 1
                units = int(((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80).sum())
                known = units, any(m in chunk for m in self.markers), chunk[: self.edge], chunk[len(chunk) - min(self.edge, len(chunk)) :]
            if self.bytes > self.max_bytes:
                self.old, self.young, self.bytes = self.young, {}, 0
            self.young[chunk] = known
            self.bytes += len(chunk) + 200
        return known

    def text(self, data: bytes, ends: list[int]) -> tuple[np.ndarray, bool]:
        """Code points up to the end of each chunk, and whether the text holds a marker, in a chunk or across ends."""
        counts = np.zeros(len(ends) + 1, np.int64)
        marked, tail, start = False, b"", 0
        for i, end in enumerate(ends):
            units, inside, head, last = self.summary(data[start:end])
            counts[i + 1] = counts[i] + units
            if inside or any(m in tail + head for m in self.markers):
                marked = True
            tail = (tail + last)[-self.edge :] if self.edge else b""
            start = end
        return counts, marked


def byte_place(data: np.ndarray, ends: list[int], counts: np.ndarray, cut: int) -> int:
    """The byte at which code point ``cut`` starts; the size of the text for its end."""
    at = int(np.searchsorted(counts, cut, side="right")) - 1
    if at >= len(ends):
        return len(data)
    start = ends[at - 1] if at else 0
    inside = np.flatnonzero((data[start : ends[at]] & 0xC0) != 0x80)
    return start + int(inside[cut - int(counts[at])])


def draws(doc_id: Column, seed: str = "1") -> Column:
    """Four whole numbers from the sha256 of seed and id; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)])


ADDED = (("n", "long", False), ("form", "string", False), ("prefix_chars", "long", True), ("middle_chars", "long", True), ("output", "string", False))


def fill_middle(
    docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", seed: str = "1", markers: Markers = Markers(), plain_percent: int = 10,
    spm_percent: int = 20, chunk_bits: int = 11, least: int = 256, most: int = 16_384, memory: int = 32 << 20,
) -> DataFrame:
    """Add n, form, prefix_chars, middle_chars and output, the text in its fill-in-the-middle form.

    Two cuts, drawn from the id, part the text into prefix, middle and suffix by code points. The
    form is ``plain`` (the text as it is) for empty texts, texts that hold a marker and
    ``plain_percent`` of the others; of the rest ``spm_percent`` are ``spm`` (suffix, prefix,
    middle), all others ``psm`` (prefix, suffix, middle). One narrow pass; ``memory`` bounds the bytes of
    chunks that each worker remembers (twice that) and changes the speed only, as do ``chunk_bits``, ``least``, ``most``.

    Defined cases: a null text counts as empty; a null id draws from the empty id; repeated rows
    are each transformed, alike if id and text are equal; an empty table gives an empty one; texts
    of any length are processed whole. Other columns come back unchanged, one that is named like an
    added column is replaced; names are compared as Spark does.
    """
    spark = docs.sparkSession
    same = (lambda a: a) if spark.conf.get("spark.sql.caseSensitive") == "true" else str.lower
    added = {same(name) for name, _, _ in ADDED}
    kept = [c for c in docs.columns if same(c) not in added]
    helper = "_draws"
    while same(helper) in map(same, docs.columns):
        helper += "_"
    body = helper + "_text"
    schema = docs.select(*kept).schema
    for name, kind, null in ADDED:
        schema = schema.add(name, kind, null)
    p, s, m = markers.all()
    marks = [x.encode() for x in (p, s, m)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Chunks(marks_text, memory)
        for batch in batches:
            start = 0
            for part in slices(batch.column(body).cast(pa.binary())):
                own = batch.slice(start, len(part))
                start += len(part)
                found = [_cut(x.as_py() or b"", d, memo) for x, d in zip(part, own.column(helper).to_pylist())]
                columns = list(zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [own.column(c) for c in kept] + [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()),
                                                     pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.binary()).cast(pa.string())],
                    names=schema.names,
                )

    marks_text = markers.all()

    def _cut(data: bytes, drawn: list[int], memo: Chunks) -> tuple:
        view = np.frombuffer(data, np.uint8)
        ends = chunk_ends(view, chunk_bits, least, most)
        counts, marked = memo.text(data, ends)
        n = int(counts[-1])
        if not n or marked or drawn[2] % 100 >= 100 - plain_percent:
            return n, PLAIN, None, None, data
        first, second = sorted((drawn[0] % (n + 1), drawn[1] % (n + 1)))
        a, b = (byte_place(view, ends, counts, cut) for cut in (first, second))
        prefix, middle, suffix = data[:a], data[a:b], data[b:]
        if drawn[3] % 100 < spm_percent:
            return n, SPM, first, second - first, b"".join((marks[1], suffix, marks[0], prefix, marks[2], middle))
        return n, PSM, first, second - first, b"".join((marks[0], prefix, marks[1], suffix, marks[2], middle))

    ready = docs.select(*kept, draws(F.col(id_col), seed).alias(helper), F.col(text).alias(body))
    return ready.mapInArrow(run, schema)


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text that was transformed, rebuilt from the output and its form alone."""
    p, s, m = (F.lit(x) for x in markers.all())
    middle = F.split_part(output, m, F.lit(2))
    front = F.split_part(output, m, F.lit(1))
    psm = F.concat(F.split_part(F.substring(front, len(markers.prefix) + 1, 1 << 30), s, F.lit(1)), middle, F.split_part(front, s, F.lit(2)))
    spm = F.concat(F.split_part(front, p, F.lit(2)), middle, F.split_part(F.substring(front, len(markers.suffix) + 1, 1 << 30), p, F.lit(1)))
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)
