"""Language of mixed texts: script ranges, per-word scores and a Viterbi pass that pays for switching."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from siftline.llm.common import held_out
from siftline.llm.word_codes import slices

#: First code points of ranges that one script fills; a letter belongs to the last range that starts at or before it.
RANGES = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xFB00, "latin"),
    (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"),
)
STARTS = np.array([a for a, _ in RANGES])
SCRIPTS = sorted({name for _, name in RANGES})
SCRIPT_OF = np.array([SCRIPTS.index(name) for _, name in RANGES])
BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Model:
    """Log-probabilities of letter n-grams per language (a table of fixed size) and the scripts each language uses."""

    langs: list[str]
    logs: np.ndarray
    scripts: np.ndarray


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: is it a letter, and which script does it belong to."""
    points = np.arange(0x110000)
    alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return alpha, SCRIPT_OF[np.searchsorted(STARTS, points, "right") - 1].astype(np.uint8)


@dataclass(frozen=True)
class Grams:
    """Of a list of words: letters and script (-1 without a letter) of each; word and bucket of all n-grams of letters."""

    letters: np.ndarray
    script: np.ndarray
    word: np.ndarray
    bucket: np.ndarray


def grams_of(words: pa.Array) -> Grams:
    """N-grams over each word's lower-cased letters, set between two spaces."""
    alpha, scripts = _tables()
    n = len(words)
    lowered = pc.utf8_lower(words)
    codes = np.frombuffer("".join(lowered.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(n), pc.utf8_length(lowered).to_numpy(zero_copy_only=False))
    keep = alpha[codes]
    codes, of = codes[keep], of[keep]
    letters = np.bincount(of, minlength=n)
    kinds = np.bincount(of * len(SCRIPTS) + scripts[codes], minlength=n * len(SCRIPTS)).reshape(n, -1)
    script = np.where(letters > 0, kinds.argmax(axis=1) if n else 0, -1)
    rank = np.cumsum(letters > 0) - 1
    padded = np.full(len(codes) + 2 * int((letters > 0).sum()), 32, np.uint64)
    padded[np.arange(len(codes)) + 2 * rank[of] + 1] = codes
    owner = np.repeat(np.arange(n), np.where(letters > 0, letters + 2, 0))
    rolled, found, places = padded + np.uint64(1), [], []
    for order in ORDERS:
        if order > 1:
            if len(padded) < order:
                break
            rolled = rolled[:-1] * STEP + padded[order - 1 :]
        inside = owner[: len(rolled)] == owner[order - 1 :]
        mixed = (rolled ^ (rolled >> np.uint64(31))) * STEP + np.uint64(order)
        found.append((mixed[inside] >> np.uint64(64 - 15)).astype(np.int64))
        places.append(owner[: len(rolled)][inside])
    empty = np.zeros(0, np.int64)
    return Grams(letters, script, np.concatenate(places or [empty]), np.concatenate(found or [empty]))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct raw words, the code of each word and the words per text; cut at white space."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    found = lists.flatten().dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def train(docs: DataFrame, *, lang: str = "lang", alpha: float = 0.5) -> Model:
    """Count the n-grams of all texts with a language outside the held-out fold; every document counts.

    What is gathered is one number per bucket and language and per script and language. A
    document's text may be mixed; the counts of its own language outweigh the rest.
    """
    rows = docs.filter(F.col(lang).isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col(lang).cast("string").alias("lang"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, at = batch.column("lang").to_pylist(), 0
            for part in slices(batch.column("text")):
                distinct, codes, per = split_words(part)
                grams = grams_of(distinct)
                own = langs[at : at + len(part)]
                at += len(part)
                known = {name: i for i, name in enumerate(dict.fromkeys(own))}
                of_word = np.repeat([known[name] for name in own], per)
                for name, i in known.items():
                    times = np.bincount(codes[of_word == i], minlength=len(distinct))
                    total = counts.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS), np.float64))
                    total[:BUCKETS] += np.bincount(grams.bucket, times[grams.word], BUCKETS)
                    known_script = grams.script >= 0
                    total[BUCKETS:] += np.bincount(grams.script[known_script], times[known_script], len(SCRIPTS))
        for name, total in counts.items():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(total[used].astype(np.int64))], names=["lang", "cell", "n"])

    found = rows.mapInArrow(run, "lang string, cell bigint, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPTS)))
    counts[[langs.index(x) for x in found["lang"]], found["cell"].to_numpy(np.int64)] = found["n"].to_numpy()
    grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
    logs = np.log(grams + alpha) - np.log((grams + alpha).sum(axis=1, keepdims=True))
    used = scripts > 0.001 * scripts.sum(axis=1, keepdims=True)
    return Model(langs, logs.astype(np.float32), used)


class Labeller:
    """Viterbi over the words of texts; ``penalty`` is what a change of language costs."""

    def __init__(self, model: Model, *, penalty: float):
        self.model, self.penalty = model, np.float32(penalty)

    def scores(self, grams: Grams) -> np.ndarray:
        """Per word and language the log-probability of its n-grams, all orders averaged; a script that a language does not use sets it far behind."""
        n = len(grams.letters)
        out = np.stack([np.bincount(grams.word, row[grams.bucket], n) for row in self.model.logs], axis=1).astype(np.float32) / len(ORDERS)
        fits = self.model.scripts[:, np.maximum(grams.script, 0)].T
        narrowed = (grams.script >= 0) & fits.any(axis=1)
        out[narrowed] -= np.where(fits[narrowed], 0, 30).astype(np.float32)
        return out

    def label(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per slice of texts: the language of every word, its letters, and the words of each text."""
        for part in slices(texts, 2 << 20):
            distinct, codes, per = split_words(part)
            grams = grams_of(distinct)
            yield self._paths(self.scores(grams)[codes], per), grams.letters[codes], per

    def _paths(self, emit: np.ndarray, per: np.ndarray) -> np.ndarray:
        """Best labels of all words: texts are advanced together, longest first, one word a step."""
        out = np.zeros(len(emit), np.int32)
        order = np.argsort(-per, kind="stable")
        sizes, first = per[order], (np.cumsum(per) - per)[order]
        n_langs = emit.shape[1]
        steps = int(sizes[0]) if len(sizes) else 0
        alive = np.searchsorted(-sizes, -np.arange(steps), "left")  # texts with more than t words
        offsets = np.concatenate([[0], np.cumsum(alive)])
        back = np.empty((offsets[-1], n_langs), np.int32)
        here = np.arange(n_langs, dtype=np.int32)
        state = np.zeros((len(sizes), n_langs), np.float32)
        for t in range(steps):
            k = alive[t]
            own = state[:k]
            if t:
                best = own.argmax(axis=1)
                jump = own[np.arange(k), best] - self.penalty
                stay = own >= jump[:, None]
                back[offsets[t] : offsets[t] + k] = np.where(stay, here, best[:, None])
                own = np.where(stay, own, jump[:, None])
            state[:k] = own + emit[first[:k] + t]
        current = state.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            k = alive[t]
            out[first[:k] + t] = current[:k]
            if t:
                current[:k] = back[offsets[t] : offsets[t] + k][np.arange(k), current[:k]]
        return out


def identify(docs: DataFrame, model: Model, *, penalty: float = 12.0, spans: bool = False) -> DataFrame:
    """Add ``lang_pred``, ``score`` (that language's share of the letters) and, if asked for, ``spans``.

    ``spans`` is an array of (lang, words, letters) in text order. A null text or one without a
    letter is ``und`` with score 0 and no spans, as is everything if no language was learned.
    Ties go to the language that sorts first. Columns with the names of added ones are replaced.
    """
    rest = [c for c in docs.columns if c not in ("lang_pred", "score", "spans")]
    schema = docs.select(*rest).schema.add("lang_pred", "string", False).add("score", "double", False)
    if spans:
        from pyspark.sql.types import _parse_datatype_string

        schema = schema.add("spans", _parse_datatype_string("array<struct<lang:string,words:int,letters:bigint>>"), False)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        labeller = Labeller(own, penalty=penalty)
        for batch in batches:
            at = 0
            if not own.langs:
                n = batch.num_rows
                extra = [pa.array(["und"] * n), pa.array([0.0] * n)] + ([pa.array([[]] * n, pa.list_(SPAN))] if spans else [])
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + extra, names=schema.names)
                continue
            for labels, letters, per in labeller.label(batch.column("text")):
                text_of = np.repeat(np.arange(len(per)), per)
                shares = np.bincount(text_of * len(own.langs) + labels, letters, len(per) * len(own.langs)).reshape(len(per), -1)
                total, best = shares.sum(axis=1), shares.argmax(axis=1)
                names = [own.langs[b] if t else "und" for b, t in zip(best.tolist(), total.tolist())]
                score = np.where(total > 0, shares[np.arange(len(per)), best] / np.maximum(total, 1), 0.0)
                extra = [pa.array(names, pa.string()), pa.array(score)]
                if spans:
                    extra.append(pa.array([_spans(labels[e - n : e], letters[e - n : e], own.langs) for n, e in zip(per, np.cumsum(per))], pa.list_(SPAN)))
                piece = batch.slice(at, len(per))
                at += len(per)
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in rest] + extra, names=schema.names)

    return docs.mapInArrow(run, schema)


SPAN = pa.struct([("lang", pa.string()), ("words", pa.int32()), ("letters", pa.int64())])


def _spans(labels: np.ndarray, letters: np.ndarray, langs: list[str]) -> list[dict]:
    if not letters.sum():
        return []
    cuts = np.flatnonzero(np.diff(labels, prepend=-1))
    sizes = np.diff(np.append(cuts, len(labels)))
    return [{"lang": langs[labels[c]], "words": int(n), "letters": int(letters[c : c + n].sum())} for c, n in zip(cuts, sizes)]
