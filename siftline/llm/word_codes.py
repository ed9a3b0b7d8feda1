"""Turn texts into token ids word by word, encoding each distinct word once per slice of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Memo:
    """A bounded map with two generations: what was not asked for since the last turn is forgotten."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def fill(self, keys: list, make: Callable[[list], list]) -> list:
        """The values of ``keys``, of which ``make`` computes those not remembered. No value is None."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        values = list(map(young.get, keys))
        missing = []
        for i in [i for i, value in enumerate(values) if value is None]:
            known = old.get(keys[i])
            if known is None:
                missing.append(i)
            else:
                values[i] = young[keys[i]] = known
        if missing:
            asked = [keys[i] for i in missing]
            for i, key, value in zip(missing, asked, make(asked)):
                values[i] = young[key] = value
        return values


def slices(texts: pa.Array, max_bytes: int = 4 << 20) -> Iterator[pa.Array]:
    """Consecutive slices of about ``max_bytes``; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes):
        if total + size > max_bytes and i > start:
            yield texts.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(texts):
        yield texts.slice(start)


def gather(codes: np.ndarray, pieces: list[bytes], dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate ``pieces[c]`` for every code; also the number of items of each."""
    lens = np.fromiter(map(len, pieces), np.int64, len(pieces)) // dtype.itemsize
    pool = np.frombuffer(b"".join(pieces), dtype)
    starts = np.cumsum(lens) - lens
    counts = lens[codes]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total, dtype=np.int64) + np.repeat(starts[codes] - (ends - counts), counts)
    return pool[index], counts


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts split at single spaces: distinct words, the code of every word, and words per text (1 at least)."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    found = lists.flatten().dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def per_text(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Sums of ``counts`` over each text's words."""
    ends = np.cumsum(words)
    total = np.concatenate([[0], np.cumsum(counts)])
    return total[ends] - total[ends - words]
