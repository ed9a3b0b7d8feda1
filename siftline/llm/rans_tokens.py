"""Token ids of a corpus as range-coded blocks: one shared static table, interleaved lanes, parallel decoding.

File format, a folder with two Parquet tables:

``table``: token, freq. Frequencies sum to 2**PRECISION; every token of the corpus has at least 1.
``blocks``: start (ids before the block), the rows it holds (doc ids, text hashes, id counts),
``lanes``, ``payload``, its crc32, the crc32 of the ids, and ``checkpoints``.

A block holds whole documents, 2**18 ids or more unless it ends its part, and is decoded on
its own. Id number i belongs to lane ``i % lanes``; all lanes share one word stream. The
payload is one 64-bit start state per lane, then 32-bit words in the order the decoder takes
them. A checkpoint (lane states and word position every ``CHECKPOINT_STEPS`` steps) lets
decoding begin inside a block: ``read_slice`` decodes the stretches between checkpoints in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftline.llm.common import drop_stored, stored
from siftline.llm.word_codes import Memo, gather, per_text, slices, words_of
from siftline.session import new_folder

PRECISION = 20
LOW = np.uint64(1 << 31)
CHECKPOINT_STEPS = 128
U64 = np.uint64


class Table:
    """A static frequency table, with the decoder's slot lookup."""

    def __init__(self, tokens: np.ndarray, freqs: np.ndarray):
        if len(tokens) and int(freqs.sum()) != 1 << PRECISION:
            raise ValueError("frequencies must sum to 2**PRECISION")
        size = int(tokens.max()) + 1 if len(tokens) else 1
        self.freq = np.zeros(size, U64)
        self.freq[tokens] = freqs
        self.low = np.cumsum(self.freq) - self.freq
        self.slots = np.repeat(np.arange(size, dtype=np.uint32), self.freq.astype(np.int64))


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts as frequencies that sum to 2**PRECISION, each at least 1: ``counts`` are positive and at most 2**PRECISION many."""
    total, room = counts.sum(dtype=np.float64), (1 << PRECISION) - len(counts)
    freqs = 1 + np.floor(counts / total * room).astype(np.int64)
    freqs[np.argmax(freqs)] += (1 << PRECISION) - freqs.sum()
    return freqs


def lanes_for(n: int) -> int:
    """Lanes of a block of n ids: 1024, fewer for a small block so that start states stay small."""
    return max(1, min(1024, n // 64))


def encode_block(ids: np.ndarray, table: Table) -> tuple[bytes, bytes, int]:
    """Payload, checkpoints and lanes of one block."""
    n = len(ids)
    lanes = lanes_for(n)
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, U64)
    freq, low = table.freq[ids], table.low[ids]
    limit = freq << U64(63 - PRECISION)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, bytes]] = []
    written = 0
    for step in range(steps - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x, f = state[: b - a], freq[a:b]
        full = x >= limit[a:b]
        out = x[full].astype(np.uint32)
        if len(out):
            words.append(out)
            written += len(out)
            x = np.where(full, x >> U64(32), x)
        quotient = x // f
        state[: b - a] = (quotient << U64(PRECISION)) + (x - quotient * f) + low[a:b]
        if step and step % CHECKPOINT_STEPS == 0:
            marks.append((step, written, state.tobytes()))
    words.reverse()
    payload = state.astype("<u8").tobytes() + b"".join(w.astype("<u4").tobytes() for w in words)
    checkpoints = b"".join(
        step.to_bytes(4, "little") + (written - after).to_bytes(8, "little") + states
        for step, after, states in reversed(marks)
    )
    return payload, checkpoints, lanes


def decode_block(payload: bytes, n: int, lanes: int, table: Table, *, checkpoints: bytes = b"", first: int = 0) -> np.ndarray:
    """Ids of a block from number ``first`` on; a later start begins at the checkpoint before it."""
    parts = segments(payload, n, lanes, checkpoints) if first else [(0, n, payload[: 8 * lanes], payload[8 * lanes :])]
    found = [run_lanes(states, words, count, table) for begin, count, states, words in parts if begin + count > first]
    out = np.concatenate(found) if found else np.zeros(0, np.uint32)
    return out[len(out) - max(0, n - first) :]


def segments(payload: bytes, n: int, lanes: int, checkpoints: bytes) -> list[tuple[int, int, bytes, bytes]]:
    """A block cut at its checkpoints: (first id, ids, lane states, words), each decodable by itself."""
    width = 12 + 8 * lanes
    marks = [(0, 0, payload[: 8 * lanes])]
    for k in range(0, len(checkpoints), width):
        step, word = int.from_bytes(checkpoints[k : k + 4], "little"), int.from_bytes(checkpoints[k + 4 : k + 12], "little")
        marks.append((step * lanes, word, checkpoints[k + 12 : k + width]))
    words = payload[8 * lanes :]
    ends = [(first, 4 * word) for first, word, _ in marks[1:]] + [(n, len(words))]
    return [(first, end - first, states, words[4 * word : stop]) for (first, word, states), (end, stop) in zip(marks, ends)]


def run_lanes(states: bytes, words: bytes, n: int, table: Table) -> np.ndarray:
    """``n`` ids from lane states on, taking words in order."""
    state, stream = np.frombuffer(states, "<u8").astype(U64), np.frombuffer(words, "<u4").astype(U64)
    lanes, at = len(state), 0
    mask, out = U64((1 << PRECISION) - 1), np.empty(n, np.uint32)
    slots, freq, low = table.slots, table.freq, table.low
    for a in range(0, n, lanes):
        b = min(n, a + lanes)
        x = state[: b - a]
        slot = x & mask
        token = slots[slot.view(np.int64)]
        out[a:b] = token
        token = token.astype(np.int64)
        x = freq[token] * (x >> U64(PRECISION)) + slot - low[token]
        short = np.flatnonzero(x < LOW)
        if len(short):
            x[short] = (x[short] << U64(32)) | stream[at : at + len(short)]
            at += len(short)
        state[: b - a] = x
    return out


class Tokens:
    """Ids of whole Arrow arrays of texts by the tokenizers library, each distinct word once per slice.

    The pre-tokenizer never joins a word to the single space behind it, so a text can be cut
    before every space that has no white space on both sides. Texts with other spaces, found
    by one pattern, are encoded whole.
    """

    SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
    TOUCHING = f"{SPACE} (?:{SPACE}|\\z)"

    def __init__(self, path: str, word_limit: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.normalizer is not None:
            raise ValueError(f"{path}: a tokenizer that normalises texts cannot be run word by word")
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype(np.uint16 if size <= 1 << 16 else np.uint32)
        self.width = np.zeros(size, np.int64)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.width[i] = len(token)
        self.memo = Memo(word_limit)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of " " + word for each word: many words go to the library as one text, cut at byte widths."""
        plain = [w for w in words if w and not w[0].isspace()]
        odd = [w for w in words if not w or w[0].isspace()]
        found = dict(zip(odd, self.whole([" " + w for w in odd])))
        for start in range(0, len(plain), 2000):
            part = plain[start : start + 2000]
            text = " " + " ".join(part)
            ids = np.frombuffer(self.whole([text])[0], self.dtype)
            ends = np.cumsum(self.width[ids])
            data = np.frombuffer(text.encode(), np.uint8)
            borders = np.append(np.flatnonzero(data == 32)[1:], len(data))
            cuts = np.searchsorted(ends, borders)
            if len(ids) != cuts[-1] + 1 or not np.array_equal(ends[cuts], borders):
                found.update(zip(part, self.whole([" " + w for w in part])))
                continue
            raw, size, a = ids.tobytes(), self.dtype.itemsize, 0
            for word, cut in zip(part, cuts.tolist()):
                found[word] = raw[a : (cut + 1) * size]
                a = (cut + 1) * size
        return [found[w] for w in words]

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per slice of texts: all ids, and the number of ids of each text."""
        for part in slices(texts, 8 << 20):
            part = pc.fill_null(part, "")
            touching = np.flatnonzero(pc.match_substring_regex(part, self.TOUCHING).to_numpy(zero_copy_only=False))
            distinct, codes, words = words_of(part)
            pieces = self.memo.fill(distinct, self._words)
            ends, codes = np.cumsum(words), codes.copy()
            begins = ends - words
            # First words have no space before them: each distinct one is encoded once more, as it stands.
            firsts, place = np.unique(codes[begins], return_inverse=True)
            codes[begins] = len(pieces) + place
            pieces += self.whole([distinct[i] for i in firsts.tolist()])
            empty = len(pieces)
            pieces.append(b"")
            for i in touching.tolist():
                codes[begins[i] : ends[i]] = empty
            codes[begins[touching]] = len(pieces) + np.arange(len(touching))
            pieces += self.whole(part.take(pa.array(touching)).to_pylist())
            ids, counts = gather(codes, pieces, self.dtype)
            yield ids, per_text(counts, words)


@lru_cache(maxsize=2)
def _tokens(path: str, word_limit: int) -> Tokens:
    return Tokens(path, word_limit)


def token_blocks(
    docs: DataFrame, tokenizer: str, *, end_id: int | None, block_ids: int = 1 << 18, word_limit: int = 400_000
) -> DataFrame:
    """Rows of whole documents' ids in ascending doc_id: (part, before, doc_ids, hashes, counts, n, ids).

    ``before`` counts the ids of the part's earlier blocks.
    """
    schema = "part int, before bigint, doc_ids array<bigint>, hashes array<bigint>, counts array<bigint>, n bigint, wide boolean, ids binary"
    names = ["part", "before", "doc_ids", "hashes", "counts", "n", "wide", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        tokens = _tokens(tokenizer, word_limit)
        rows: list[tuple] = []
        held = 0

        def row() -> pa.RecordBatch:
            doc_ids, hashes, counts, ids = zip(*rows)
            data = [[part], [before], [list(doc_ids)], [list(hashes)], [list(counts)], [held], [tokens.dtype.itemsize == 4], [b"".join(ids)]]
            kinds = [pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.int64(), pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(data, kinds)], names=names)

        tail = b"" if end_id is None else np.array([end_id], tokens.dtype).tobytes()
        for batch in batches:
            doc_ids, hashes = batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()
            at = 0
            for ids, counts in tokens.encode(batch.column("text")):
                raw, size, a = ids.tobytes(), tokens.dtype.itemsize, 0
                for count in counts.tolist():
                    own = raw[a : a + count * size] + tail
                    a += count * size
                    rows.append((doc_ids[at], hashes[at], len(own) // size, own))
                    held += len(own) // size
                    at += 1
                    if held >= block_ids:
                        yield row()
                        before += held
                        rows, held = [], 0
        if rows:
            yield row()

    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("th"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "th")
    )
    return ordered.mapInArrow(run, schema)


def _counts(blocks: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw, wide in zip(batch.column("ids"), batch.column("wide").to_pylist()):
                own = np.bincount(np.frombuffer(raw.as_buffer(), np.uint32 if wide else np.uint16))
                if len(own) > len(total):
                    own, total = total, own
                total[: len(own)] += own
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["token", "count"])

    return blocks.select("ids", "wide").mapInArrow(run, "token bigint, count bigint").groupBy("token").agg(F.sum("count").alias("count"))


BLOCKS = (
    "start bigint, n bigint, doc_ids array<bigint>, hashes array<bigint>, counts array<bigint>, lanes int, "
    "payload binary, payload_crc32 bigint, ids_crc32 bigint, checkpoints binary"
)


def write_corpus(
    docs: DataFrame, tokenizer: str, path: str, *, end_id: int | None = 2, block_ids: int = 1 << 18, word_limit: int = 400_000
) -> None:
    """Tokenize whole texts and write them to ``path`` in the format above, in ascending doc_id.

    Needs doc_id and text; other columns are ignored. Null text counts as empty and, like it,
    gives only ``end_id``. A null id comes first, rows that share an id follow one another by a
    hash of their text. An empty table writes an empty corpus. The frequency table counts
    every id of the corpus; it has one row per vocabulary entry, whatever the corpus size.
    """
    spark = docs.sparkSession
    blocks, blocks_path = stored(token_blocks(docs, tokenizer, end_id=end_id, block_ids=block_ids, word_limit=word_limit), "token-blocks")
    counted = _counts(blocks).toPandas()  # at most one row per vocabulary entry
    tokens, counts = counted["token"].to_numpy(np.int64), counted["count"].to_numpy(np.int64)
    freqs = scaled(counts) if len(counts) else counts
    table_frame = spark.createDataFrame(list(zip(tokens.tolist(), freqs.tolist())), "token bigint, freq bigint")
    table_frame.coalesce(1).write.parquet(f"{path}/table")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("size")).collect()  # one row per partition
    before, base = 0, []
    for row in sorted(parts, key=lambda r: r["part"]):
        base.append((row["part"], before))
        before += row["size"]
    offsets = F.broadcast(spark.createDataFrame(base, "part int, base bigint"))  # one row per partition
    placed = blocks.join(offsets, "part").withColumn("start", F.col("base") + F.col("before"))
    shared = spark.sparkContext.broadcast((tokens, freqs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                ids = np.frombuffer(own.column("ids")[0].as_buffer(), np.uint32 if own.column("wide")[0].as_py() else np.uint16)
                payload, checkpoints, lanes = encode_block(ids, table)
                more = [[lanes], [payload], [zlib.crc32(payload)], [zlib.crc32(ids.astype("<u4").tobytes())], [checkpoints]]
                kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [own.column(c) for c in ("start", "n", "doc_ids", "hashes", "counts")] + [pa.array(v, k) for v, k in zip(more, kinds)],
                    names=[x.split()[0] for x in BLOCKS.split(", ")],
                )

    placed.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    drop_stored(spark, blocks_path)


def read_corpus(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """Decode every block: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids, in no set order.

    Blocks are decoded in parallel, each by itself. A payload or ids that do not match their
    checksum raise an error that names the block.
    """
    rows = spark.read.parquet(f"{path}/table").collect()  # one row per vocabulary entry
    shared = spark.sparkContext.broadcast((np.array([r["token"] for r in rows], np.int64), np.array([r["freq"] for r in rows], np.int64)))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["payload"]) != row["payload_crc32"]:
                    raise ValueError(f"block at {row['start']}: payload does not match its checksum")
                ids = decode_block(row["payload"], row["n"], row["lanes"], table).astype("<u4")
                raw = ids.tobytes()
                if zlib.crc32(raw) != row["ids_crc32"]:
                    raise ValueError(f"block at {row['start']}: ids do not match their checksum")
                counts = np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                crcs = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist())]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())]
                if with_ids:
                    offsets = np.concatenate([[0], ends]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").drop("checkpoints", "hashes").mapInArrow(run, schema)


def read_slice(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """Ids number ``start`` up to ``stop`` of the corpus: (place, ids), one row per stretch between checkpoints.

    Only blocks that overlap the slice are read. Their stretches are dealt to all tasks, so a
    block that holds one very long text is decoded by many. An empty slice gives no row; a
    payload that does not match its checksum raises an error.
    """
    rows = spark.read.parquet(f"{path}/table").collect()  # one row per vocabulary entry
    shared = spark.sparkContext.broadcast((np.array([r["token"] for r in rows], np.int64), np.array([r["freq"] for r in rows], np.int64)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if zlib.crc32(row["payload"]) != row["payload_crc32"]:
                    raise ValueError(f"block at {row['start']}: payload does not match its checksum")
                for first, n, states, words in segments(row["payload"], row["n"], row["lanes"], row["checkpoints"]):
                    place = row["start"] + first
                    if place < stop and place + n > start:
                        data = [pa.array([place], pa.int64()), pa.array([n], pa.int64()), pa.array([states]), pa.array([words])]
                        yield pa.RecordBatch.from_arrays(data, names=["place", "n", "states", "words"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(*shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                a, b = max(0, start - row["place"]), min(row["n"], stop - row["place"])
                ids = run_lanes(row["states"], row["words"], row["n"], table)[a:b].astype(np.int32)
                offsets = pa.array([0, len(ids)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["place"] + a], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids))], names=["place", "ids"]
                )

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks").filter((F.col("start") < stop) & (F.col("start") + F.col("n") > start))
    found = blocks.select("start", "n", "lanes", "payload", "payload_crc32", "checkpoints").mapInArrow(cut, "place bigint, n bigint, states binary, words binary")
    return found.repartition("place").mapInArrow(decode, "place bigint, ids array<int>")


def corpus_folder(spark: SparkSession) -> str:
    return new_folder(spark, "token-corpus")
