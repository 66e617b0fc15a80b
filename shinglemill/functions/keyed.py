"""Keyed hashes built from the native sha2, also with a key that differs from row to row."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from shinglemill.functions.text import WORD, let

_HEX = "0123456789ABCDEF"


def _xor(digit: int) -> str:
    return "".join(_HEX[i ^ digit] for i in range(16))


def _pad(key_hex: Column, value: int) -> Column:
    """The key block with every byte xored by ``value``, nibble by nibble."""
    high, low = _xor(value >> 4), _xor(value & 15)
    flip = lambda i: F.concat(F.translate(F.substring(key_hex, i, F.lit(1)), _HEX, high), F.translate(F.substring(key_hex, i + 1, F.lit(1)), _HEX, low))
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(127), F.lit(2)), flip), ""))


def hmac_pads(key: Column) -> Column:
    """``struct(inner, outer)`` of a binary key; worth binding once for many messages."""
    short = F.when(F.octet_length(key) > 64, F.sha2(key, 256)).otherwise(F.hex(key))
    return let(F.rpad(F.upper(short), 128, "0"), lambda block: F.struct(_pad(block, 0x36).alias("inner"), _pad(block, 0x5C).alias("outer")))


def constant_pads(key: bytes) -> Column:
    """The same for a key that is known beforehand, as literals."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    flip = lambda v: F.lit(bytes(x ^ v for x in block))
    return F.struct(flip(0x36).alias("inner"), flip(0x5C).alias("outer"))


def hmac_of(pads: Column, message: Column) -> Column:
    return F.sha2(F.concat(pads["outer"], F.unhex(F.sha2(F.concat(pads["inner"], message), 256))), 256)


def hmac_sha256_hex(key: Column, message: Column) -> Column:
    return hmac_of(hmac_pads(key), message)


def token_of(pads: Column, token: Column) -> Column:
    """``zq`` and ten letters: the first 8 bytes of the token's HMAC in base 26, the least digit first."""
    digest = hmac_of(pads, F.lower(token).cast("binary"))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")
    start = F.struct(half(1).alias("hi"), half(9).alias("lo"), F.lit("zq").alias("out"))

    def digit(state, _):
        low = (state["hi"] % 26) * (1 << 32) + state["lo"]
        return F.struct(F.floor(state["hi"] / 26).alias("hi"), ((low - low % 26) / 26).cast("bigint").alias("lo"), F.concat(state["out"], F.char(low % 26 + 97)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(10)), start, digit)["out"]


def surrogate(surface: Column, pads: Column) -> Column:
    """Every word of ``surface`` as its keyed token, all else as it is."""
    words = F.regexp_extract_all(surface, F.lit(WORD), F.lit(0))
    gaps = F.split(surface, WORD, -1)
    return F.array_join(F.zip_with(gaps, words, lambda g, w: F.concat(g, F.when(w.isNull(), "").otherwise(token_of(pads, w)))), "")
