"""Token blocks and SentencePiece encoding against the libraries."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from siftline.llm.common import tokenizer_path
from siftline.llm.rans_tokens import Table, corpus_folder, decode_block, encode_block, read_corpus, read_slice, scaled, write_corpus
from siftline.llm.sentencepiece_bpe import BatchEncoder, decode, encode

MODEL = tokenizer_path("piece_bpe_32k.model")
BYTES = tokenizer_path("byte_bpe_50k.json")
ODD = ["", None, " ", "  ", "a  b", " lead", "trail ", "line\nline\n\n x", "tab\t\t y", "é漢😀\u200b", "▁mark ▁▁", "x" * 5000, "<|endoftext|> in <|endoftext|>text", "\x1c \x1c", "a \u00a0 b", "\r\n \r\n"]


def random_texts(n, seed):
    rnd = random.Random(seed)
    parts = ["the", "tion", " ", "  ", "\n", "é", "漢", "▁", "ing", ".", "123", "\u3000", "<s>", "😀"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("n", [0, 1, 63, 64, 129, 5000, 70_001, 300_001])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 999).astype(np.uint32)
    tokens, counts = np.unique(np.append(ids, [5, 77]), return_counts=True)
    table = Table(tokens, scaled(counts))
    payload, checkpoints, lanes = encode_block(ids, table)
    assert np.array_equal(decode_block(payload, n, lanes, table), ids)
    for first in {0, n // 3, max(0, n - 1)} - ({0} if n == 0 else set()):
        assert np.array_equal(decode_block(payload, n, lanes, table, checkpoints=checkpoints, first=first), ids[first:])


def test_corpus_holds_the_library_ids(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    texts = ODD + random_texts(200, 1)
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(6, "second row of an id", "x"), (None, "no id", "x")]
    path = corpus_folder(spark)
    write_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(5), BYTES, path, block_ids=300)
    got = sorted(read_corpus(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, *sorted(r[0] for r in rows if r[0] is not None)]
    at, by_id = 0, {}
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
        by_id.setdefault(r["doc_id"], []).append(list(r["ids"]))
    for doc_id, text, _ in rows:
        assert library.encode(text or "", add_special_tokens=False).ids + [2] in by_id[doc_id]


def test_slice_is_decoded_from_checkpoints(spark, monkeypatch):
    monkeypatch.setattr("siftline.llm.rans_tokens.CHECKPOINT_STEPS", 4)
    texts = ["one " * 3, " ".join(random_texts(300, 7)), None, "tail"]
    path = corpus_folder(spark)
    write_corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), BYTES, path)
    every = [i for r in sorted(read_corpus(spark, path).collect(), key=lambda r: r["start"]) for i in r["ids"]]
    assert len(every) > 2000
    for start, stop in [(0, len(every)), (5, 1200), (1111, 1112), (len(every) - 3, len(every) + 9), (7, 7)]:
        got = sorted(read_slice(spark, path, start, stop).collect())
        assert [i for r in got for i in r["ids"]] == every[start:stop]
        assert not got or got[0]["place"] == start
    assert read_slice(spark, path, 0, len(every)).count() > 5


def test_corpus_of_no_documents_and_damage(spark):
    path = corpus_folder(spark)
    write_corpus(spark.createDataFrame([], "doc_id bigint, text string"), BYTES, path)
    assert read_corpus(spark, path).count() == 0
    path = corpus_folder(spark)
    write_corpus(spark.createDataFrame([(1, "some words here")], "doc_id bigint, text string"), BYTES, path)
    bad = spark.read.parquet(f"{path}/blocks").selectExpr("* except (ids_crc32)", "ids_crc32 + 1 AS ids_crc32")
    rows = bad.collect()
    spark.createDataFrame(rows, bad.schema).write.mode("overwrite").parquet(f"{path}/blocks")
    with pytest.raises(Exception, match="checksum"):
        read_corpus(spark, path).collect()


def test_prefix_table_equals_library():
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=MODEL)
    encoder = BatchEncoder(MODEL, 50)
    rnd = random.Random(4)
    pieces = [library.id_to_piece(rnd.randrange(300, 32000)).replace("▁", " ") for _ in range(400)]
    texts = ODD + random_texts(300, 2) + ["".join(rnd.choices(pieces, k=20)) for _ in range(300)]
    got = []
    for ids, counts in encoder.encode(pa.array(texts, pa.string())):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == library.encode([t or "" for t in texts])


def test_encode_and_decode_frames(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=MODEL)
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(ODD)], "doc_id bigint, text string, ids string")
    both = encode(df, MODEL, decoded="back")
    assert both.columns == ["doc_id", "text", "ids", "back"]
    for r in decode(both, MODEL, text="again").collect():
        ids = library.encode(r["text"] or "")
        assert list(r["ids"]) == ids and r["back"] == r["again"] == library.decode(ids)
    assert encode(df.limit(0), MODEL).count() == 0


def test_words_of_a_task_are_forgotten_when_it_ends():
    """Spark deals tasks to all idle workers by turns, so what each keeps adds up."""
    encoder = BatchEncoder(MODEL, 1000)
    texts = pa.array([" ".join(f"w{i}x{j}" for j in range(5_000)) for i in range(60)], pa.string())
    first = [(v.tolist(), c.tolist()) for v, c in encoder.encode(texts)]
    assert len(first) > 1 and encoder.memo.young
    encoder.forget()
    assert not encoder.memo.young and not encoder.memo.old
    assert [(v.tolist(), c.tolist()) for v, c in encoder.encode(texts)] == first


def test_ids_are_not_made_one_by_one():
    """Decoding takes less CPU time than Arrow needs to list the ids, which was two thirds of it."""
    import time

    from siftline.llm.sentencepiece_bpe import _library, _texts

    library = _library(MODEL)
    some = library.encode(random_texts(300, 3))
    lists = pa.array([None, [], *some, None] * 20, pa.list_(pa.int32())).slice(1)

    def least(run):
        took = []
        for _ in range(3):
            start = time.process_time()
            run()
            took.append(time.process_time() - start)
        return min(took)

    assert _texts(library, lists).to_pylist() == [library.decode(x or []) for x in lists.to_pylist()]
    assert least(lambda: _texts(library, lists)) < least(lambda: lists.to_pylist())
