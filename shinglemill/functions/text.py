"""Tokens, normalisers, shingles and sketches as column expressions."""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bracketed placeholders, else runs of word characters; Java's \w is ASCII only.
TOKEN = r"\[[A-Z_0-9]+\]|[\p{L}\p{N}_]+"
WORD = r"[\p{L}\p{N}_]+"
NUMBER = r"\p{Nd}+([.,]\p{Nd}+)?"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    """Placeholders in brackets keep their case, other tokens are lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: F.when(w.startswith("["), w).otherwise(F.lower(w)))


def words_lower(text: Column) -> Column:
    """Word tokens, all lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w))


def surface_norm(surface: Column) -> Column:
    """Tokens of the lower-cased string, joined by blanks."""
    return F.array_join(F.regexp_extract_all(F.lower(surface), F.lit(TOKEN), F.lit(0)), " ")


def _strip_marks(texts):
    def strip(t):
        return t if t is None or t.isascii() else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")

    return texts.map(strip)


def simple_words(text: Column) -> Column:
    """Lower case, numbers to 0, punctuation to blanks, no diacritics, split at white space."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), NUMBER, "0"), r"[^\p{L}\p{N}_\s\u0085  -     　]|_", " ")
    return F.filter(F.split(F.pandas_udf(_strip_marks, "string", F.PandasUDFType.SCALAR)(plain), r"[\s\u0085   -     　]+"), lambda w: w != "")


NORMALISERS = {"plain": tokens, "simple": simple_words}


def shingles_text(words: Column, n: int) -> Column:
    """Distinct word n-grams as text. Fewer words than ``n`` are one shingle, so that no set is empty."""
    if n <= 0:
        raise ValueError("n must be positive")
    return let(words, lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))))


def shingles(words: Column, n: int) -> Column:
    """The same as 32-bit checksums."""
    return F.array_distinct(F.transform(shingles_text(words, n), lambda s: F.crc32(s.cast("binary"))))


def shingles_strict(words: Column, n: int = 5) -> Column:
    """Distinct n-grams as text; texts with fewer than ``n`` words have none."""
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(shingles_text(words, n))


def keyed_shingles(words: Column, n: int, key: bytes) -> Column:
    """Shingle ids that only holders of ``key`` can compute: the first 8 bytes of HMAC-SHA256, little-endian, folded to 32 bits."""
    from shinglemill.functions.keyed import constant_pads, hmac_of

    pads = constant_pads(key)

    def fold(s: Column) -> Column:
        # Folding xors byte i with byte i + 4, and the first byte of a pair is the lowest.
        flip = lambda d, at: F.conv(F.concat(*(F.substring(d, at + i, 2) for i in (6, 4, 2, 0))), 16, 10).cast("bigint")
        return let(hmac_of(pads, s.cast("binary")), lambda d: flip(d, 1).bitwiseXOR(flip(d, 9)))

    return F.array_distinct(F.transform(shingles_text(words, n), fold))


# MinHash: (a x + b) mod p stays below 2 ** 63, so signed longs are exact.
PRIME = 4_294_967_311
BANDINGS = {"28x4": (28, 4), "16x7": (16, 7), "14x8": (14, 8), "8x14": (8, 14), "7x16": (7, 16)}


def minhash_coefficients(count: int = 112, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 2**31 - 1, count, dtype=np.uint64)
    b = rng.integers(0, 2**31 - 1, count, dtype=np.uint64)
    return a, b


def minhash(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The signature of a set of 32-bit ids. As higher-order functions it would take a lambda call for each id and hash."""
    ids, times, plus = ids.astype(np.uint64), a[:, None], b[:, None]
    parts = [((times * ids[i : i + 8_192] + plus) % np.uint64(PRIME)).min(1) for i in range(0, len(ids), 8_192)]
    return np.min(parts, axis=0).astype(np.int64)


def bands(signature: Column, count: int, rows: int) -> Column:
    """The key of every band, as text."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.array_join(F.transform(F.slice(signature, i * rows + 1, F.lit(rows)), lambda v: v.cast("string")), ","))


def unit(vector: Column) -> Column:
    """``vector`` over its length, or over 1e-9 where that is larger."""
    values = vector.cast("array<double>")
    return let(F.greatest(F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x)), F.lit(1e-9)), lambda size: F.transform(values, lambda x: x / size))


def cosine(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(unit(x), unit(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def jaccard(x: Column, y: Column) -> Column:
    """Of two sets; 0 where both are empty."""
    both = F.size(F.array_intersect(x, y))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(x) + F.size(y) - both).cast("double")), F.lit(0.0))
