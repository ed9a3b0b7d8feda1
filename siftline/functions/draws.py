"""Hash-based random draws: reproducible, order-free. Python takes the same draws as the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

_SCALE = 1_000_000


def row_seed(text: Column, seed: int, purpose: str) -> Column:
    """One 64-bit seed per row; hashing the text happens once, not once per draw."""
    return F.xxhash64(F.lit(seed), F.lit(purpose), text)


def char_draw(base: Column, *position: Column | int) -> Column:
    """Uniform draw in [0, 1) for a position under a row seed."""
    parts = [p if isinstance(p, Column) else F.lit(p) for p in position]
    return F.pmod(F.xxhash64(base, *parts), F.lit(_SCALE)) / F.lit(float(_SCALE))


def pick(base: Column, options: Column, size: int, *position: Column | int) -> Column:
    """One element of an array column of known size."""
    parts = [p if isinstance(p, Column) else F.lit(p) for p in position]
    return F.get(options, F.pmod(F.xxhash64(base, *parts), F.lit(size)).cast("int"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    An expression captured by a lambda is otherwise evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rewritten(text: Column, base: Column, change: Callable) -> Column:
    """``text`` with its characters rewritten, many texts at once in Arrow batches; null stays null.

    ``change(codes, last, draw)`` gets the code points of some texts, whether each is its text's last, and ``draw(at, *more)``:
    ``xxhash64(base, position, *more)`` of the characters at the places ``at``. It returns the new code points and, for each old
    one, how many there are in its place. What it uses of a module it imports, as it goes to the workers by value.
    """
    slice_size = 1 << 19  # characters worked on together

    @F.arrow_udf(T.StringType())
    def rewrite(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import numpy as np

        p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

        def turned(x, bits: int):
            return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))

        def mixed(x):
            x = (x ^ (x >> np.uint64(33))) * p2
            x = (x ^ (x >> np.uint64(29))) * p3
            return x ^ (x >> np.uint64(32))

        def of_long(value, seed):
            return mixed(turned((seed + p5 + np.uint64(8)) ^ (turned(value * p2, 31) * p1), 27) * p1 + p4)

        def of_int(value, seed):
            return mixed(turned((seed + p5 + np.uint64(4)) ^ ((value & np.uint64(0xFFFFFFFF)) * p1), 23) * p2 + p3)

        def settle(texts: list, bases) -> list:
            sizes = np.array([len(t) for t in texts], np.int64)
            codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            last = np.zeros(len(codes), bool)
            last[ends[sizes > 0] - 1] = True
            seeds = of_long(bases, np.full(len(bases), 42, np.uint64))

            def draw(at, *more):
                own = np.searchsorted(ends, at, side="right")
                value = of_int((at - starts[own]).astype(np.uint64), seeds[own])
                for m in more:
                    value = of_int(np.uint64(m), value)
                return value.view(np.int64)

            made, counts = change(codes, last, draw)
            whole = made.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
            upto = np.concatenate([[0], np.cumsum(counts)])
            return [whole[a:b] for a, b in zip(upto[starts].tolist(), upto[ends].tolist())]

        for texts, bases in batches:
            done: list = [None] * len(texts)
            values = bases.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            rows, found, size = [], [], 0

            def flush():
                if rows:
                    for row, new in zip(rows, settle(found, values[rows])):
                        done[row] = new
                    rows.clear()
                    found.clear()

            for start in range(0, len(texts), 64):  # the texts become Python's a few at a time
                for row, text in enumerate(texts.slice(start, 64).to_pylist(), start):
                    if text is not None:
                        rows.append(row)
                        found.append(text)
                        size += len(text)
                    if size >= slice_size:
                        flush()
                        size = 0
            flush()
            yield pa.array(done, pa.string())

    return rewrite(text, base)
