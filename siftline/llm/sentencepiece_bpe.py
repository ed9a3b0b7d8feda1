"""Encoding and decoding with a SentencePiece BPE model: last token of every prefix, found with an automaton."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from siftline.llm.word_codes import Memo, gather, per_text, slices, words_of

SPACE = "▁"
#: Stands before the first token of a word; the id of the unknown piece, which is never matched.
START = 0
#: Bytes of text whose words are looked up together, of which a quarter or so may be distinct words.
SLICE = 2 << 20


class PrefixEncoder:
    """Encodes a word in linear time from a table of each prefix's last token.

    A BPE result is the only sequence of tokens in which every neighbouring pair is
    compatible, that is, the pair alone is encoded as just these two. So the result of a
    prefix ends in exactly one token: the match ending there that starts where a solved
    prefix ends and is compatible with that prefix's last token. An automaton lists the
    matches, and the ids are recovered from the end of the word backwards.
    """

    def __init__(self, model_file: str, *, pair_limit: int = 400_000):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        proto = ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        rules, kind = proto.normalizer_spec, proto.trainer_spec
        supported = (
            kind.model_type == kind.BPE and kind.byte_fallback and not kind.treat_whitespace_as_suffix
            and not rules.precompiled_charsmap and rules.add_dummy_prefix
            and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        )
        if not supported:
            raise ValueError(f"{model_file}: a BPE model with byte fallback and identity normalisation is needed")
        normal = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == p.NORMAL}
        if any(p.type == p.USER_DEFINED for p in proto.pieces) or any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError(f"{model_file}: pieces must be user-free and hold the space mark at their start only")
        self.pieces = {i: text for text, (i, _) in normal.items()}
        self.scores = normal
        self.chars = {text for text in normal if len(text) == 1}
        if not self.chars.issuperset("".join(normal)):
            raise ValueError(f"{model_file}: every character of a piece must be a piece")
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == p.BYTE}
        self.automaton = ahocorasick.Automaton()
        for text, (i, _) in normal.items():
            self.automaton.add_word(text, (len(text) - 1, i))
        self.automaton.make_automaton()
        self.size = len(proto.pieces)
        self.lengths = {i: len(text) for i, text in self.pieces.items()}
        self.pair_limit, self.pairs = pair_limit, {}

    def merge(self, text: str) -> list[int]:
        """Plain merging: always the best-scored neighbouring pair, the leftmost of equals."""
        symbols = list(text)
        while True:
            best = None
            for k in range(len(symbols) - 1):
                found = self.scores.get(symbols[k] + symbols[k + 1])
                if found and (best is None or found[1] > best[0]):
                    best = found[1], k
            if best is None:
                return [self.scores[s][0] for s in symbols]
            symbols[best[1] : best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging two pieces' characters gives just these two; from START, whether one gives itself."""
        key = left * self.size + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.pair_limit:
                self.pairs.clear()
            alone = [right] if left == START else [left, right]
            known = self.pairs[key] = self.merge("".join(self.pieces[t] for t in alone)) == alone
        return known

    def known_run(self, text: str) -> list[int]:
        """Ids of a text all of whose characters are pieces."""
        last = [-1] * (len(text) + 1)
        last[0] = START
        pairs, size = self.pairs, self.size
        for end, (back, token) in self.automaton.iter(text):
            if last[end + 1] >= 0:
                continue
            before = last[end - back]
            if before >= 0:
                good = pairs.get(before * size + token)
                if good or good is None and self.compatible(before, token):
                    last[end + 1] = token
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= self.lengths[last[at]]
        ids.reverse()
        return ids

    def encode_word(self, text: str) -> list[int]:
        """Ids of a text with spaces as marks. Characters without a piece become their UTF-8 bytes."""
        if self.chars.issuperset(text):
            return self.known_run(text)
        ids, start = [], 0
        for at, char in enumerate(text):
            if char not in self.chars:
                ids += self.known_run(text[start:at]) if at > start else []
                ids += [self.byte_ids[b] for b in char.encode()]
                start = at + 1
        return ids + (self.known_run(text[start:]) if start < len(text) else [])


class BatchEncoder:
    """Ids of whole Arrow arrays of texts; a piece never crosses the start of a word, so words are encoded apart."""

    def __init__(self, model_file: str, word_limit: int):
        self.encoder = PrefixEncoder(model_file)
        self.memo = Memo(word_limit)

    def forget(self) -> None:
        """Give back what the words of a task took; the model and the pairs it has tested are kept."""
        self.memo = Memo(self.memo.limit)
        pa.default_memory_pool().release_unused()

    def _words(self, words: list[str]) -> list[bytes]:
        encode = self.encoder.encode_word
        return [array("i", encode(SPACE + w)).tobytes() for w in words]

    def _plain(self, text: str) -> bytes:
        """A text whose spaces may touch one another: cut before the first mark of each run."""
        if not text:
            return b""
        marked = SPACE + text.replace(" ", SPACE)
        starts = [i for i in range(len(marked)) if marked[i] == SPACE and (i == 0 or marked[i - 1] != SPACE)] + [len(marked)]
        return b"".join(self.memo.fill([marked[a + 1 : b] for a, b in zip(starts, starts[1:])], self._words))

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per slice of texts: all ids, and the number of ids of each text."""
        dtype = np.dtype(np.int32)
        for part in slices(texts, SLICE):
            distinct, codes, words = words_of(part)
            pieces = self.memo.fill(distinct, self._words)
            odd = [i for i, t in enumerate(part.to_pylist()) if not t or t[0] == " " or "  " in t or SPACE in t]
            if odd:
                # The whole text takes the place of its first word; its other words become empty.
                ends = np.cumsum(words)
                codes = codes.copy()
                empty = len(pieces)
                pieces.append(b"")
                for i in odd:
                    codes[ends[i] - words[i] : ends[i]] = empty
                    codes[ends[i] - words[i]] = len(pieces)
                    pieces.append(self._plain(part[i].as_py() or ""))
            ids, counts = gather(codes, pieces, dtype)
            yield ids, per_text(counts, words)


@lru_cache(maxsize=2)
def _encoder(model_file: str, word_limit: int) -> BatchEncoder:
    return BatchEncoder(model_file, word_limit)


def _texts(library, lists: pa.ListArray) -> pa.Array:
    """The library's decoding of every list, a few at a time; a null list decodes to an empty text.

    Lists are cut from one array of all ids, as Arrow makes a Python number of an id ten times slower.
    """
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    bounds = np.concatenate([[0], ends])
    values = lists.flatten().to_numpy(zero_copy_only=False)
    found: list[str] = []
    for start in range(0, len(lists), 64):
        own = bounds[start : start + 65]
        flat, cuts = values[own[0] : own[-1]].tolist(), (own - own[0]).tolist()
        found += library.decode([flat[a:b] for a, b in zip(cuts, cuts[1:])], num_threads=1)
    return pa.array(found, pa.string())


def encode(
    docs: DataFrame, model_file: str, *, text: str = "text", ids: str = "ids", decoded: str | None = None, word_limit: int = 50_000
) -> DataFrame:
    """Add ``ids``, the token ids of the whole text, as the SentencePiece library gives them.

    No begin or end ids are added and nothing is sampled. Null is treated as empty and gives an
    empty list. With ``decoded`` a column of that name holds the library's decoding of the ids
    as well, made in the same pass. Other columns come back unchanged, except one that has the
    name of an added column, which is replaced. ``word_limit`` bounds the words each worker
    remembers (twice that number and those of a slice) and which it forgets when a task ends, as Spark deals
    tasks to its idle workers by turns; it changes the speed only. ``model_file`` is a path that every executor can read.
    """
    rest = [c for c in docs.columns if c not in (ids, decoded)]
    kinds = {f.name: f for f in docs.schema.fields}
    schema = StructType([kinds[c] for c in rest] + [StructField(ids, ArrayType(IntegerType()), False)])
    if decoded:
        schema = schema.add(decoded, StringType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_file, word_limit)
        try:
            for batch in batches:
                start = 0
                for values, counts in encoder.encode(batch.column(text)):
                    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
                    own = batch.slice(start, len(counts))
                    start += len(counts)
                    more = [lists, _texts(_library(model_file), lists)] if decoded else [lists]
                    yield pa.RecordBatch.from_arrays([own.column(c) for c in rest] + more, names=schema.names)
        finally:
            encoder.forget()

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, model_file: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, the library's decoding of the list ``ids``; a null list decodes to an empty text."""
    rest = [c for c in df.columns if c != text]
    kinds = {f.name: f for f in df.schema.fields}
    schema = StructType([kinds[c] for c in rest] + [StructField(text, StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(model_file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [_texts(library, batch.column(ids))], names=[*rest, text])

    return df.mapInArrow(run, schema)


@lru_cache(maxsize=2)
def _library(model_file: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=model_file)


def digests(ids: Column, decoded: Column) -> list[Column]:
    """Columns that state a list of ids and a decoded text."""
    return [
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(decoded, 256).alias("decoded_sha256"),
    ]
