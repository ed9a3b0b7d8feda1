"""SimHash fingerprints, Hamming similarity and band keys.

A fingerprint is a BIGINT holding the bits of an unsigned value in two's complement.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def shingles(text: Column | str, size: int = 4) -> Column:
    """Distinct character windows of the lower-cased, whitespace-collapsed text (native form)."""
    clean = F.lower(F.btrim(F.regexp_replace(_col(text), r"(?U)[\s\x1c-\x1f]+", " ")))
    n = F.length(clean)
    windows = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(clean, i, F.lit(size)))
    return (
        F.when(n == 0, F.array().cast("array<string>"))
        .when(n <= size, F.array(clean))
        .otherwise(F.array_distinct(windows))
    )


def simhash(text: Column | str, *, hash_bits: int = 64, shingle_size: int = 4, hash_fn: str = "blake2b") -> Column:
    """SimHash of a text, computed in Arrow batches.

    Each task keeps the hashes of the shingles it has met (a bounded table), so a digest
    is computed once per distinct shingle and the rest is vectorised bit counting.
    """
    if hash_bits % 8 or not 8 <= hash_bits <= 64:
        raise ValueError("hash_bits must be a multiple of 8 up to 64")
    if hash_fn not in ("blake2b", "md5"):
        raise ValueError("hash_fn must be 'blake2b' or 'md5'")
    width = hash_bits // 8
    memory_limit = 1 << 20
    slice_size = 1 << 19  # shingles looked up together

    @F.arrow_udf(T.LongType())
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import hashlib

        import numpy as np

        def digest(token: str) -> int:
            data = token.encode("utf-8", "surrogatepass")
            if hash_fn == "blake2b":
                raw = hashlib.blake2b(data, digest_size=width).digest()
            else:
                raw = hashlib.md5(data).digest()[:width]
            return int.from_bytes(raw, "big")

        def digest_grams(grams: np.ndarray) -> np.ndarray:
            shifts = (48, 32, 16, 0)[-shingle_size:]
            tokens = ("".join(chr((int(g) >> s) & 0xFFFF) for s in shifts) for g in grams)
            return np.array([digest(t) for t in tokens], dtype=np.uint64)

        byte_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        known = np.empty(0, dtype=np.uint64)  # sorted shingles met so far
        hashes = np.empty(0, dtype=np.uint64)

        def hashes_of(grams: np.ndarray) -> np.ndarray:
            """Hashes of sorted distinct shingles; what is new is merged into the memory at once."""
            nonlocal known, hashes
            if len(known):
                at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                new = grams[known[at] != grams]
                if not len(new):
                    return hashes[at]
            else:
                new = grams
            if len(known) + len(new) > memory_limit:
                known, hashes = known[:0], hashes[:0]
                new = grams
            merged = np.concatenate([known, new])
            order = np.argsort(merged, kind="stable")
            known, hashes = merged[order], np.concatenate([hashes, digest_grams(new)])[order]
            return hashes[np.searchsorted(known, grams)]

        def vote(values: np.ndarray) -> int:
            # Counting the values of each byte first leaves 256 rows whose bits have to be added up.
            part = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)
            ones = np.concatenate([np.bincount(part[:, i], minlength=256) @ byte_bits for i in range(8)])
            bits = (2 * ones > len(values)).astype(np.uint8)
            return int(np.packbits(bits, bitorder="little").view(np.int64)[0])

        def shingles(text) -> np.ndarray | int | None:
            """A text's packed shingles, repeats included, or its fingerprint where they cannot be packed."""
            if text is None:
                return None
            clean = " ".join(text.split()).lower()
            if not clean:
                return 0
            if len(clean) <= shingle_size:
                return vote(np.array([digest(clean)], dtype=np.uint64))
            codes = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
            n = len(codes) - shingle_size + 1
            if shingle_size > 4 or codes.max() > 0xFFFF:
                tokens = {clean[i : i + shingle_size] for i in range(n)}
                return vote(np.array([digest(t) for t in tokens], dtype=np.uint64))
            packed = codes[:n].copy()
            for i in range(1, shingle_size):
                packed = (packed << np.uint64(16)) | codes[i : i + n]
            return packed

        def settle(found: list) -> list:
            """Fingerprints of a slice of texts, whose shingles are looked up together."""
            grams = [f for f in found if isinstance(f, np.ndarray)]
            if not grams:
                return found
            codes, distinct = pd.factorize(np.concatenate(grams))
            order = np.argsort(distinct)
            values = np.empty(len(distinct), dtype=np.uint64)
            values[order] = hashes_of(distinct[order])
            last = np.empty(len(distinct), dtype=np.int64)  # where a text has each shingle last
            done, start = [], 0
            for f in found:
                if isinstance(f, np.ndarray):
                    own = codes[start : start + len(f)]
                    place = np.arange(len(f))
                    last[own] = place
                    done.append(vote(values[own[last[own] == place]]))
                    start += len(f)
                else:
                    done.append(f)
            return done

        for texts in batches:
            done: list = []
            found: list = []
            size = 0
            # The texts become Python's a few at a time; beside the batch no copy of it is held.
            for text in (t for start in range(0, len(texts), 64) for t in texts.slice(start, 64).to_pylist()):
                found.append(shingles(text))
                size += len(found[-1]) if isinstance(found[-1], np.ndarray) else 1
                if size >= slice_size:
                    done += settle(found)
                    found, size = [], 0
            done += settle(found)
            yield pa.array(done, pa.int64())

    return fingerprint(_col(text))


def hamming_distance(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(_col(a).bitwiseXOR(_col(b)))


def similarity(a: Column | str, b: Column | str, *, hash_bits: int = 64) -> Column:
    """1.0 for identical fingerprints, 0.0 for complementary ones."""
    return F.lit(1.0) - hamming_distance(a, b) / F.lit(float(hash_bits))


def band_values(fingerprint: Column | str, *, num_bands: int = 8, hash_bits: int = 64) -> Column:
    """ARRAY<BIGINT> of band values; band i holds bits [i*w, (i+1)*w)."""
    if hash_bits % num_bands:
        raise ValueError(f"{num_bands} bands do not divide {hash_bits} bits evenly")
    width = hash_bits // num_bands
    column = _col(fingerprint)
    if width == 64:
        return F.array(column)
    mask = (1 << width) - 1
    return F.array(
        *[F.shiftrightunsigned(column, i * width).bitwiseAND(F.lit(mask)) for i in range(num_bands)]
    )


def signed64(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def block_masks(blocks: int, hash_bits: int = 64) -> list[int]:
    """Masks cutting the fingerprint into ``blocks`` runs of nearly equal width."""
    cuts = [i * hash_bits // blocks for i in range(blocks + 1)]
    return [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(cuts, cuts[1:])]


def block_keys(blocks: int, agree: int, hash_bits: int = 64) -> list[tuple[int, int]]:
    """Every choice of ``agree`` blocks as (bit set of the chosen blocks, fingerprint mask)."""
    masks = block_masks(blocks, hash_bits)
    keys = []
    for chosen in combinations(range(blocks), agree):
        keys.append((sum(1 << i for i in chosen), signed64(sum(masks[i] for i in chosen))))
    return keys
