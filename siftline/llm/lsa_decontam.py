"""Benchmark decontamination by latent semantic retrieval and word-level checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from siftline.llm.common import drop_stored, fresh_name, stored
from siftline.llm.word_codes import slices

BUCKETS = 1 << 14
#: A passage is five chunks of eight words; passages start at every chunk.
CHUNK, CHUNKS = 8, 5
#: Items of so many chunks at most are compared with passages of that length as well.
SHORT = 2
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~…“”„‘’«»¿¡–—"
BLOCK = 256
#: Tasks of a round of the fit per core of the cluster.
TASKS = 4
#: Rows that are summed in one step at most, and chunks whose vectors a round holds at once.
RUN, HELD = 64, 1 << 15
#: Contexts in which cuts are measured, and the share of the least value found there that is asked for.
CONTEXTS, SLACK = 16, 0.9
#: Windows whose vectors are held at once.
WINDOWS = 2048
#: Bits of a signature of words, and the sizes of items up to which a region's signature is read before its words.
BITS, CLASSES = 1024, (64, 256)
#: Words of a stretch of text that a longer item is looked for in before it is around each window.
STRETCH = 4096
#: Bytes of words that are hashed at once; a worker keeps the powers for so many.
HASHED = 1 << 16
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Space:
    """Inverse document frequencies, the leading right singular vectors of TF-IDF passages and one over their singular values.

    ``context`` holds the buckets of running words, drawn by document frequency, that cuts are measured with.
    """

    idf: np.ndarray
    basis: np.ndarray
    scale: np.ndarray
    context: np.ndarray

    def rows(self) -> np.ndarray:
        """What a word of each bucket adds to a passage, each direction scaled; the last row, of no word, is zero."""
        return np.vstack([self.basis * self.idf[:, None] * self.scale, np.zeros((1, self.basis.shape[1]), np.float32)])


@dataclass(frozen=True)
class Items:
    """Items, the vectors of them and their passages, and per window length which vectors it is compared with and from which values on."""

    ids: list[int]
    words: list[np.ndarray]
    sets: list[frozenset[int]]
    answers: list[np.ndarray]
    signs: np.ndarray
    owner: np.ndarray
    white: np.ndarray
    direct: np.ndarray
    searches: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse up to ``size``."""
    inverse = np.uint64(pow(int(STEP), -1, 1 << 64))
    one = [np.uint64(1)]
    return tuple(np.concatenate([one, np.multiply.accumulate(np.full(size, base, np.uint64))]) for base in (STEP, inverse))


def string_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every string: its bytes as a polynomial, from running sums over many of them at once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    words = pa.concat_arrays([words])  # starts at offset 0
    ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64))
    size = int(ends[-1])
    data = np.frombuffer(words.buffers()[2], np.uint8, size) if size else np.zeros(0, np.uint8)
    out, first, begin = np.empty(len(words), np.uint64), 0, 0
    while first < len(words):
        last = max(first + 1, int(np.searchsorted(ends, begin + HASHED, side="right")))
        end = int(ends[last - 1])
        out[first:last] = _hashes(data[begin:end], ends[first:last] - begin)
        first, begin = last, end
    return out


def _hashes(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the strings that end where ``ends`` says."""
    size = len(data)
    powers, back = _powers(HASHED) if size <= HASHED else _powers.__wrapped__(size)  # a longer string's are not kept
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:size], dtype=np.uint64)])
    starts = np.concatenate([[0], ends[:-1]])
    value = (sums[ends] - sums[starts]) * back[starts]
    value = (value ^ (value >> np.uint64(32))) * MIX
    return value ^ (value >> np.uint64(29))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, lower-cased and without outer punctuation, and the number per text."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    found = lists.flatten().dictionary_encode()
    trimmed = pc.utf8_trim(found.dictionary, characters=PUNCTUATION)
    table = string_hashes(pc.utf8_lower(pc.if_else(pc.equal(trimmed, ""), found.dictionary, trimmed)))
    codes = found.indices.to_numpy(zero_copy_only=False)
    empty = pc.equal(found.dictionary, "").to_numpy(zero_copy_only=False) if len(found.dictionary) else np.zeros(0, bool)
    if empty.any():  # white space at a text's ends
        keep = ~empty[codes]
        ends = np.cumsum(counts)
        total = np.concatenate([[0], np.cumsum(keep)])
        counts, codes = total[ends] - total[ends - counts], codes[keep]
    return table[codes], counts


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def cut_words(texts: DataFrame) -> DataFrame:
    """``texts`` with ``words`` in place of ``text``: the buckets of its words in order, two bytes a word."""
    rest = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for part in slices(batch.column("text"), 1 << 20):
                hashes, counts = word_hashes(part)
                ends = np.concatenate([[0], np.cumsum(counts)]) * 2
                data = _bucket(hashes).astype(np.uint16)
                words = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(start, len(part)) for c in rest], words], names=[*rest, "words"])
                start += len(part)

    kinds = ", ".join(f"{c} {texts.schema[c].dataType.simpleString()}" for c in rest)
    return texts.select(*rest, "text").mapInArrow(run, f"{kinds}, words binary" if kinds else "words binary")


def _words(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Of slices of a batch: the buckets of all words, the number per text and the first text's row. Texts may be cut already."""
    start = 0
    if "words" in batch.schema.names:
        for part in slices(batch.column("words"), 1 << 19):
            counts = pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64) // 2
            whole = pa.concat_arrays([part])  # starts at offset 0
            size = int(counts.sum())
            yield (np.frombuffer(whole.buffers()[2], np.uint16, size) if size else np.zeros(0, np.uint16)), counts, start
            start += len(part)
    else:
        for part in slices(batch.column("text"), 1 << 20):
            hashes, counts = word_hashes(part)
            yield _bucket(hashes).astype(np.uint16), counts, start
            start += len(part)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """In how many of all documents each bucket of words occurs; a table of fixed size. ``docs`` has their texts or ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for buckets, counts, _ in _words(batch):
                ends = np.cumsum(counts)
                n += len(counts)
                for start in range(0, len(counts), 32):
                    own = counts[start : start + 32]
                    seen = np.zeros((len(own), BUCKETS), bool)
                    a = int(ends[start] - counts[start])
                    seen[np.repeat(np.arange(len(own)), own), buckets[a : a + int(own.sum())]] = True
                    total += seen.view(np.uint8).sum(axis=0, dtype=np.uint8)  # at most 32
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], names=["bucket", "n"])

    rows = docs.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[rows["bucket"].to_numpy()] = rows["n"].to_numpy()  # -1 is the last place: the number of documents
    return df


def chunk_starts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every chunk of all texts, and the number of chunks per text."""
    per = -(-counts // CHUNK)
    first = np.repeat(np.cumsum(counts) - counts, per)
    inner = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    return first + inner * CHUNK, per


def fit_space(docs: DataFrame, benchmark: DataFrame, *, rank: int = 128, docs_weight: float = 3000.0, weight: float = 100.0, rounds: int = 3, seed: int = 7) -> Space:
    """Randomised SVD of TF-IDF passages: block power iteration over a table of passages spread over the cluster.

    Document frequencies count all documents, and the basis is fitted on the passages of all of
    them and of all benchmark items. Each item counts ``weight`` times so that the leading directions tell
    items apart; documents count once each as long as there are ``docs_weight`` of them at most, and as much as
    so many in all if there are more, so that a large table does not drown the items.
    Texts are cut into words once. Each round every task multiplies its passages into the current basis and back; the sums
    are added up per block of rows, so what reaches the driver is the basis alone. Directions
    that no item spans, which lead where items are few, are scaled like those of one item chunk:
    scaled to equal spread, they would drown the items.
    """
    spark = docs.sparkSession
    both = docs.select("text", F.lit(False).alias("item")).unionByName(benchmark.select("text", F.lit(True).alias("item")))
    cut, path = stored(cut_words(both), "lsa-words")
    df = document_frequencies(cut.filter("NOT item").select("words"))
    n = int(df[-1])
    idf = np.log((1 + n) / (1 + df[:-1])).astype(np.float32)
    share = min(1.0, docs_weight / n) if n else 1.0
    # Every task sends its sums, as long as the basis, in each round: so many tasks as the cluster has use for, whatever the input.
    passages = cut.select("words", F.when(F.col("item"), F.lit(weight)).otherwise(F.lit(share)).alias("weight")).coalesce(TASKS * spark.sparkContext.defaultParallelism)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((BUCKETS, rank), np.float32))[0]
    for _ in range(rounds):
        q, r = np.linalg.qr(_gram_times(passages, idf, basis))
        u, squares, _ = np.linalg.svd(r)
        basis = (q @ u).astype(np.float32)
    drop_stored(spark, path)
    often = np.cumsum(df[:-1].astype(np.float64))
    drawn = np.random.default_rng(seed).random((CONTEXTS, CHUNK * CHUNKS)) * often[-1]
    context = np.minimum(np.searchsorted(often, drawn, side="right"), BUCKETS - 1)
    return Space(idf, basis, (1 / np.sqrt(np.maximum(squares, weight))).astype(np.float32), context)


def _segment_sums(rows: np.ndarray, order: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For every segment of ``order`` the sum of the rows it names.

    Segments of equal length are summed together; what is longer than RUN is cut into runs of that length first.
    """
    width = rows.shape[1]
    few = np.empty((WINDOWS, width), rows.dtype)

    def summed(at: np.ndarray, length: int) -> np.ndarray:
        out, steps, once = np.empty((len(at), width), rows.dtype), np.arange(length)[:, None], WINDOWS // length
        for a in range(0, len(at), once):
            places = order[at[a : a + once] + steps].ravel()
            there = np.take(rows, places, axis=0, out=few[: len(places)], mode="clip")
            np.add.reduce(there.reshape(length, -1), axis=0, out=out[a : a + once].reshape(-1))
        return out

    runs, rest = np.divmod(counts, RUN)
    out = np.zeros((len(counts), width), rows.dtype)
    for length in range(1, RUN):
        own = np.flatnonzero(rest == length)
        if len(own):
            out[own] = summed(firsts[own] + RUN * runs[own], length)
    own = np.flatnonzero(runs)
    if len(own):
        ends = np.cumsum(runs[own])
        inner = np.arange(ends[-1]) - np.repeat(ends - runs[own], runs[own])
        out[own] += np.add.reduceat(summed(np.repeat(firsts[own], runs[own]) + RUN * inner, RUN), ends - runs[own])
    return out


def _gram_times(passages: DataFrame, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A' A basis, where the rows of A are the normalised TF-IDF chunks of the texts, each times its weight.

    ``passages`` has the texts or, cut already, their ``words``, and ``weight``.
    """
    rank = basis.shape[1]
    shared = passages.sparkSession.sparkContext.broadcast((idf, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, own = shared.value
        rows = np.vstack([own * weights[:, None], np.zeros((1, rank), np.float32)])  # the last is that of no word
        squares = np.append(weights, np.float32(0)) ** 2
        total = np.zeros((BUCKETS, rank), np.float32)
        more = np.empty((WINDOWS, rank), np.float32)
        for batch in batches:
            weights_of = batch.column("weight").to_numpy(zero_copy_only=False)
            for buckets, counts, at in _words(batch):
                if not len(buckets):
                    continue
                starts, per = chunk_starts(counts)
                grid = np.full((len(starts), CHUNK), BUCKETS, np.uint16)
                grid.ravel()[np.arange(len(buckets)) + np.repeat(CHUNK * np.arange(len(starts)) - starts, np.diff(np.append(starts, len(buckets))))] = buckets
                heavy = np.repeat(weights_of[at : at + len(counts)], per).astype(np.float32)
                for begin in range(0, len(grid), HELD):
                    some = grid[begin : begin + HELD]
                    latent = np.empty((len(some), rank), np.float32)
                    for a in range(0, len(some), WINDOWS):
                        places, sums = some[a : a + WINDOWS].astype(np.int64), latent[a : a + WINDOWS]
                        np.take(rows, places[:, 0], axis=0, out=sums, mode="clip")
                        for place in range(1, CHUNK):
                            sums += np.take(rows, places[:, place], axis=0, out=more[: len(sums)], mode="clip")
                        sums *= (heavy[begin + a :][: len(sums)] / (np.sqrt(squares[places].sum(axis=1)) + 1e-9) ** 2)[:, None]
                    flat = some.ravel()
                    order = np.argsort(flat, kind="stable")[: np.count_nonzero(flat < BUCKETS)]
                    firsts = np.flatnonzero(np.diff(flat[order].astype(np.int64), prepend=-1))
                    total[flat[order[firsts]]] += _segment_sums(latent, order // CHUNK, firsts, np.diff(np.append(firsts, len(order))))
        total *= weights[:, None]
        for block in range(BUCKETS // BLOCK):
            data = total[block * BLOCK : (block + 1) * BLOCK]
            if data.any():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([data.tobytes()], pa.binary())], names=["block", "data"])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        data = sum(np.frombuffer(d, np.float32).astype(np.float64) for d in rows["data"])
        return pd.DataFrame({"block": [key[0]], "data": [data.astype(np.float32).tobytes()]})

    parts = passages.mapInArrow(run, "block bigint, data binary").groupBy("block").applyInPandas(add, "block bigint, data binary").collect()
    shared.destroy()  # its copies on the executors' disks go at once
    out = np.zeros((BUCKETS, rank), np.float32)
    for part in parts:
        out[part["block"] * BLOCK : (part["block"] + 1) * BLOCK] = np.frombuffer(part["data"], np.float32).reshape(BLOCK, rank)
    return out + np.float32(1e-9) * np.random.default_rng(1).standard_normal(out.shape, np.float32)


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with one bit per word of ``a``."""
    where: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        where[word] = where.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for word in b.tolist():
        match = where.get(word, 0)
        both = row & match
        row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def _contexts(space: Space, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per context and number of its words: the sum of their rows and of their squared weights."""
    fill = np.concatenate([np.zeros((CONTEXTS, 1, rows.shape[1]), np.float32), np.cumsum(rows[space.context], axis=1)], axis=1)
    return fill, np.concatenate([np.zeros((CONTEXTS, 1)), np.cumsum(space.idf[space.context] ** 2, axis=1)], axis=1)


def _reached(words: np.ndarray, size: int, space: Space, rows: np.ndarray, contexts: tuple[np.ndarray, np.ndarray], share: float) -> tuple[float, float]:
    """Least cosine, and least part of a window, with which windows that hold an item meet its vector.

    The windows begin up to a chunk before the item's words, of which only ``share``, evenly
    spread, are there; the rest of a window is context.
    """
    vectors = rows[words]
    own = vectors.sum(axis=0)
    plain = own / space.scale
    kept = np.diff(np.floor(np.arange(len(words) + 1) * share + 1e-9)) > 0
    kept[0] = True
    fill, heavy = contexts
    cosine = part = 1.0
    for seen in sorted({min(len(words), size - offset) for offset in range(CHUNK)}):
        there = kept[:seen]
        window = vectors[:seen][there].sum(axis=0) + fill[:, size - int(there.sum())]
        norm = np.sqrt((space.idf[words[:seen][there]] ** 2).sum() + heavy[:, size - int(there.sum())]) + 1e-9
        cosine = min(cosine, float((window @ own / (np.linalg.norm(window, axis=1) * np.linalg.norm(own) + 1e-9)).min()))
        part = min(part, float((window @ (plain / space.scale) / (np.linalg.norm(plain) + 1e-9) / norm).min()))
    return cosine, part


def prepare(benchmark: list[tuple[int, str]], space: Space, *, cosine: float = 0.45, held: float = 0.1, share: float = 0.7) -> Items:
    """Items with words. The answer is what follows the last question mark or, without one, the last third.

    An item has a vector of its own and, if it is longer than a passage, one for each passage of it.
    ``cosine`` and ``held`` are lowered for a vector whose own words, put into contexts, stay below them.
    """
    ids, words, sets, answers, parts, owner = [], [], [], [], [], []
    size = CHUNK * CHUNKS
    rows = space.rows()
    for item, text in benchmark:
        own, _ = word_hashes(pa.array([text], pa.string()))
        if not len(own):
            continue
        tail, _ = word_hashes(pa.array([text.rpartition("?")[2] if "?" in text else ""], pa.string()))
        ids.append(item)
        words.append(own)
        sets.append(frozenset(own.tolist()))
        answers.append(tail if len(tail) else own[-max(1, len(own) // 3) :])
        buckets = _bucket(own)
        pieces = [buckets]
        if len(own) > size:
            pieces += [buckets[min(a, len(own) - size) :][:size] for a in range(0, len(own), size)]
        parts += pieces
        owner += [len(ids) - 1] * len(pieces)
    white = np.array([rows[p].sum(axis=0) for p in parts], np.float32).reshape(len(parts), rows.shape[1])
    direct = white / space.scale
    direct /= np.linalg.norm(direct, axis=1, keepdims=True) + 1e-9
    white /= np.linalg.norm(white, axis=1, keepdims=True) + 1e-9
    searches, contexts = [], _contexts(space, rows)
    lengths = np.array([len(p) for p in parts], np.int64)
    for chunks, least, most in ((CHUNKS, CHUNK * SHORT, size), (SHORT, 0, CHUNK * SHORT)):
        chosen = np.flatnonzero((lengths <= most) | (chunks == CHUNKS))
        cuts, helds = np.full(len(chosen), cosine, np.float32), np.full(len(chosen), held, np.float32)
        for k in np.flatnonzero((lengths[chosen] > least) & (lengths[chosen] <= most)):
            reached, part = _reached(parts[chosen[k]], CHUNK * chunks, space, rows, contexts, share)
            cuts[k], helds[k] = min(cosine, max(SLACK * reached, 1e-3)), min(held, SLACK * part)
        if len(chosen):
            searches.append((chunks, chosen, cuts, helds))
    return Items(ids, words, sets, answers, np.array([signatures(w[:, None]) for w in words]).reshape(len(words), BITS // 64), np.array(owner, np.int64), white, direct / space.scale, searches)


def signatures(hashes: np.ndarray, there: np.ndarray | None = None) -> np.ndarray:
    """For every row of word hashes the set of its words as BITS bits, one a word; for a single column, of all rows."""
    bit = ((hashes >> np.uint64(40)) % np.uint64(BITS)).astype(np.int64)
    sign = np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64))
    if there is not None:
        sign[~there] = 0
    if hashes.shape[1] == 1:
        out = np.zeros(BITS // 64, np.uint64)
        np.bitwise_or.at(out, bit[:, 0] >> 6, sign[:, 0])
        return out
    out = np.zeros((len(hashes), BITS // 64), np.uint64)
    rows = np.arange(len(hashes))
    for place in range(hashes.shape[1]):
        out[rows, bit[:, place] >> 6] |= sign[:, place]
    return out


def _joined(signs: np.ndarray, width: int) -> np.ndarray:
    """The union of every row and the ``width - 1`` behind it."""
    have = 1
    while 2 * have <= width:
        signs = signs[:-have] | signs[have:]
        have *= 2
    return signs if have == width else signs[: len(signs) - (width - have)] | signs[width - have :]


def matches_of(
    part: pa.Array, space: Space, items: Items, *, rows: np.ndarray, share: float, answer: float
) -> Iterator[tuple[int, int, float, float]]:
    """(row of the slice, item number, cosine, share of the item's words in order) that pass all checks; ``rows`` are the space's."""
    hashes, counts = word_hashes(part)
    if not len(hashes) or not len(items.ids):
        return
    starts, per = chunk_starts(counts)
    # one row of word places a chunk; behind each text so many empty rows that no window reaches the next
    text_of = np.repeat(np.arange(len(counts)), per)
    at = np.arange(len(starts)) + (CHUNKS - 1) * text_of
    grid = np.full((len(starts) + (CHUNKS - 1) * (len(counts) + 1), CHUNK), BUCKETS, np.int32)
    sizes = np.diff(np.append(starts, len(hashes)))
    grid.ravel()[np.arange(len(hashes)) + np.repeat(CHUNK * at - starts, sizes)] = _bucket(hashes)
    names = np.zeros(grid.shape, np.uint64)
    names.ravel()[np.arange(len(hashes)) + np.repeat(CHUNK * at - starts, sizes)] = hashes
    margin = CLASSES[-1] // CHUNK + 1
    signs = np.zeros((len(grid) + 2 * margin + CHUNKS, BITS // 64), np.uint64)
    signs[margin : margin + len(grid)] = signatures(names, grid < BUCKETS)
    del names
    chunk_at = np.full(len(grid), -1, np.int64)
    chunk_at[at] = np.arange(len(starts))
    squares = (np.append(space.idf, np.float32(0)) ** 2)[grid].sum(axis=1)
    ends = np.cumsum(counts)
    item_sizes = np.array([len(w) for w in items.words])
    longest = int(item_sizes.max())
    inner = starts - np.repeat(ends - counts, per)
    stretch_of = np.cumsum(np.diff(text_of, prepend=-1).astype(bool) | (inner % STRETCH == 0)) - 1
    stretch_starts = np.flatnonzero(np.diff(stretch_of, prepend=-1))
    held_by: tuple[int, np.ndarray, frozenset[int]] = (-1, hashes[:0], frozenset())
    checked: dict[tuple[int, int], bool] = {}

    def holds(stretch: int, i: int) -> bool:
        """Whether a stretch with the words around it has enough of an item's words, and in order."""
        nonlocal held_by
        if (stretch, i) not in checked:
            if held_by[0] != stretch:
                c = stretch_starts[stretch]
                begin, end = ends[text_of[c]] - counts[text_of[c]], ends[text_of[c]]
                around = hashes[max(starts[c] - longest, begin) : min(starts[c] + STRETCH + CHUNK * CHUNKS + longest, end)]
                held_by = stretch, around, frozenset(around.tolist())
            size = len(items.words[i])
            enough = len(items.sets[i] & held_by[2]) >= len(items.sets[i]) - (1 - share) * size
            checked[stretch, i] = enough and lcs(items.words[i], held_by[1]) >= share * size
        return checked[stretch, i]

    best: dict[tuple[int, int], tuple[float, float]] = {}
    searches = [(chunks, own, (items.white[own] / cuts[:, None]).T.copy(), cuts, helds) for chunks, own, cuts, helds in items.searches]
    lead = CHUNKS - 1
    for a in range(0, len(grid) - lead, WINDOWS):
        b = min(a + WINDOWS, len(grid) - lead)
        sums = np.take(rows, grid[a : b + lead, 0], axis=0, mode="clip")
        more = np.empty_like(sums)
        for place in range(1, CHUNK):
            sums += np.take(rows, grid[a : b + lead, place], axis=0, out=more, mode="clip")
        for chunks, own, targets, cuts, helds in searches:
            window = sums[: b - a].copy()
            weight = squares[a:b].copy()
            for step in range(1, chunks):
                window += sums[step : step + b - a]
                weight += squares[a + step : b + step]
            length = np.sqrt(np.einsum("ij,ij->i", window, window)) + np.float32(1e-9)
            near = window @ targets
            hits = near >= length[:, None]
            ws = np.flatnonzero(hits.any(axis=1))  # few windows meet an item
            inner, rs = np.nonzero(hits[ws])
            ws = ws[inner]
            chunk = chunk_at[a + ws]
            good = chunk >= 0
            ws, rs, chunk = ws[good], rs[good], chunk[good]
            good = np.einsum("ij,ij->i", window[ws], items.direct[own[rs]]) >= helds[rs] * np.sqrt(weight[ws])
            ws, rs, chunk = ws[good], rs[good], chunk[good]
            number = items.owner[own[rs]]
            good = np.ones(len(ws), bool)
            for low, high in zip((0, *CLASSES), CLASSES):  # by signatures: too few words for the share
                some = np.flatnonzero((item_sizes[number] > low) & (item_sizes[number] <= high))
                if len(some):
                    reach = high // CHUNK + 1
                    regions = _joined(signs[margin + a - reach : margin + b + chunks + reach], chunks + 2 * reach)
                    lacks = np.bitwise_count(items.signs[number[some]] & ~regions[ws[some]]).sum(axis=1, dtype=np.int64)
                    good[some] = lacks <= (1 - share) * item_sizes[number[some]] + 1e-9
            some = np.flatnonzero(item_sizes[number] > CLASSES[-1])  # longer items: by the words of a stretch
            if len(some):
                pairs, back = np.unique(stretch_of[chunk[some]] * len(items.ids) + number[some], return_inverse=True)
                good[some] = np.array([holds(*divmod(pair, len(items.ids))) for pair in pairs.tolist()])[back]
            ws, rs, chunk = ws[good], rs[good], chunk[good]
            cosines = near[ws, rs] * cuts[rs] / length[ws]
            order = np.lexsort((-cosines, items.owner[own[rs]], chunk))  # an item's passages by a window: the nearest first
            rs, chunk, cosines = rs[order], chunk[order], cosines[order]
            last, region, before = -1, frozenset(), (-1, -1)
            for c, i, value in zip(chunk.tolist(), items.owner[own[rs]].tolist(), cosines.tolist()):
                text = int(text_of[c])
                if (c, i) == before or (text, i) in best and best[text, i][0] == 1.0:
                    continue
                before = c, i
                first, size = int(starts[c]), len(items.words[i])
                begin, end = int(ends[text] - counts[text]), int(ends[text])
                if c != last:
                    last, region = c, frozenset(hashes[max(first - longest, begin) : min(first + CHUNK * chunks + longest, end)].tolist())
                if len(items.sets[i] & region) < len(items.sets[i]) - (1 - share) * size:  # too few words for the share
                    continue
                place = hashes[max(first - size, begin) : min(first + CHUNK * chunks + size, end)]
                found = lcs(items.words[i], place) / size
                if found >= share and lcs(items.answers[i], place) >= answer * len(items.answers[i]):
                    best[text, i] = max(best.get((text, i), (0, 0)), (found, value))
    for (text, i), (found, near) in sorted(best.items()):
        yield text, i, near, found


def contamination(
    docs: DataFrame, benchmark: DataFrame, *, rank: int = 128, cosine: float = 0.45, held: float = 0.1, share: float = 0.7,
    answer: float = 0.6, docs_weight: float = 3000.0, items_at_once: int = 5000,
) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share): benchmark items found in documents, once per row and item.

    Passages of 40 words at every eighth word are compared with every item, and with every
    passage of a longer item, and
    passages of 16 words with items no longer, in the latent space, each direction scaled to equal
    spread; pairs at ``cosine`` or more, in which the
    latent part holds at least ``held`` of the passage, both less for an item whose own words in
    other text stay below (``prepare``), are checked on the words around it: the
    longest common subsequence must hold ``share`` of the item's words, and ``answer`` of
    those of its answer. Items are taken ``items_at_once`` at a time, so memory is bounded
    whatever the benchmark's size. Null, empty and wordless texts and items match nothing.
    A null doc_id is reported as null.
    """
    spark = docs.sparkSession
    space = fit_space(docs, benchmark, rank=rank, docs_weight=docs_weight)
    n = benchmark.count()
    blocks = max(1, -(-n // items_at_once))
    shared_space = spark.sparkContext.broadcast(space)
    schema = "doc_id bigint, item_id bigint, cosine double, lcs_share double"
    found = None
    for block in range(blocks):
        own = benchmark.filter((F.col("text").isNotNull()) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)).select("item_id", "text")
        items = spark.sparkContext.broadcast(prepare([(r[0], r[1]) for r in own.collect()], space, cosine=cosine, held=held, share=share))

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            rows_of = shared_space.value.rows()
            for batch in batches:
                ids, start = batch.column("doc_id"), 0
                for part in slices(batch.column("text"), 2 << 20):
                    rows = [
                        (ids[start + t].as_py(), items.value.ids[i], near, kept)
                        for t, i, near, kept in matches_of(part, shared_space.value, items.value, rows=rows_of, share=share, answer=answer)
                    ]
                    start += len(part)
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                    columns = list(zip(*rows)) or [()] * 4
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "cosine", "lcs_share"])

        part = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found; a row is known by its id and a hash of its text.

    Columns come back as they were, whatever their names. An empty table or benchmark drops nothing.
    """
    key = fresh_name(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    hits = contamination(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, **options)
    bad, _ = stored(hits.select(F.col("doc_id").alias(key)).distinct(), "contaminated")
    return keyed.join(bad, key, "left_anti").select(*docs.columns)
