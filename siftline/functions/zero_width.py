"""Invisible-character cleaning, reporting and injection."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftline.functions.draws import rewritten, row_seed
from siftline.schema import WHITESPACE

# The invisible characters removed from messages.
ZERO_WIDTH = (
    "\u200b"  # zero width space
    "\u200c"  # zero width non-joiner
    "\u200d"  # zero width joiner
    "\u2060"  # word joiner
    "\ufeff"  # zero width no-break space
    "\u180e"  # mongolian vowel separator
    "\u200e"  # left-to-right mark
    "\u200f"  # right-to-left mark
    "\u2061"  # function application
    "\u2062"  # invisible times
    "\u2063"  # invisible separator
    "\u2064"  # invisible plus
)
# The same characters as ranges: a short class is tested faster than a list of characters.
_CLASS = "[\\u200b-\\u200f\\u2060-\\u2064\\ufeff\\u180e]"


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def strip_zero_width(text: Column | str) -> Column:
    return F.translate(_col(text), ZERO_WIDTH, "")


def contains_zero_width(text: Column | str) -> Column:
    return _col(text).rlike(_CLASS)


def zero_width_report(text: Column | str) -> Column:
    """STRUCT<original, cleaned, removed_count, removed_chars> with chars in text order."""
    column = _col(text)
    removed = F.regexp_extract_all(column, F.lit(_CLASS), F.lit(0))
    return F.struct(
        column.alias("original"),
        strip_zero_width(column).alias("cleaned"),
        F.size(removed).cast("long").alias("removed_count"),
        removed.alias("removed_chars"),
    )


def inject_zero_width(text: Column | str, *, fraction: float = 0.2, seed: int = 42) -> Column:
    """Insert invisible characters into gaps between two non-space characters.

    Every gap is decided by a hash of (seed, text, position), so the result does not
    depend on row order or partitioning.
    """
    column = _col(text)
    spaces, invisible, limit = [ord(c) for c in WHITESPACE], [ord(c) for c in ZERO_WIDTH], fraction

    def change(codes, last, draw):
        import numpy as np

        free = ~np.isin(codes, spaces)
        gaps = np.flatnonzero(free & np.append(free[1:], False) & ~last)
        hits = gaps[np.mod(draw(gaps, 0), 1_000_000) / 1e6 < limit]
        counts = np.ones(len(codes), np.int64)
        counts[hits] = 2
        made = np.repeat(codes, counts)
        made[np.cumsum(counts)[hits] - 1] = np.array(invisible)[np.mod(draw(hits, 1), len(invisible))]
        return made, counts

    return rewritten(column, row_seed(column, seed, "zero_width"), change)
