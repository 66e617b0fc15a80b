"""Release strategies: texts with their spans replaced, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shinglemill.functions import spans as S
from shinglemill.functions.keyed import hmac_pads, surrogate
from shinglemill.functions.text import let, surface_norm

SALT = "shinglemill-experimental-salt"
STRATEGIES = ("RAW", "DROP", "MASK", "TYPE", "ALIAS-DOC", "SUR-DOC", "SUR-CORPUS", "SUR-SUBJECT", "HASH-ENTITY", "FAKER-DOC")
DERIVED = ("SUR-DOC-COLLAPSED", "HASH-COLLAPSED", "SUR-DOC-SKIP", "HASH-SKIP", "YEAR", "YEAR-FAKER", "ALIAS-COLLAPSED")
TOKEN_FORM, HASH_FORM, ALIAS_FORM = r"\bzq[a-z]{10}\b", r"\b[0-9a-f]{64}\b", r"\[([A-Z_]+?)_\d+\]"
CENTURY_YEAR = r"\b(?:1[89]|20)\d\d\b"

_FIRST = "Ada Ben Cleo Dov Elin Finn Gwen Hugo Iris Jon Kaya Lars Mira Nils Orla Pia Quin Rosa Sven Tess".split()
_LAST = "Abel Brandt Castro Dahl Eriksen Falk Garner Holm Ivers Jansen Keller Lund Moreau Novak Ortiz Price Quist Romero Stein Vance".split()
_PLACE = "Alder Birch Cedar Dune Elm Fern Glen Heath Isle Jade".split()
_MONTHS = "January February March April May June July August September October November December".split()
_DAYS = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()
_COUNTRIES = "Austria Belgium Chile Denmark Estonia Finland Greece Hungary Iceland Japan Kenya Latvia Malta Norway Oman Peru Qatar Romania Spain Tunisia".split()


def _literal(pool: list[str]) -> Column:
    return F.array(*map(F.lit, pool))


def _pick(pool: list[str], seed: Column, step: int = 0) -> Column:
    base = F.shiftright(seed, step)
    return F.get(_literal(pool), F.pmod(base, F.lit(len(pool))).cast("int"))


def seed_of(*parts: Column) -> Column:
    """63 bits of the hash of the parts, joined by ``|``."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("bigint")


def fake_value(kind: Column, surface: Column, seed: Column) -> Column:
    """A realistic value of the span's type; the same seed gives the same value."""
    number = lambda top, step: F.pmod(F.shiftright(seed, step), F.lit(top))
    name = F.concat_ws(" ", _pick(_FIRST, seed), _pick(_LAST, seed, 8))
    date = F.concat_ws(" ", F.lpad((number(28, 0) + 1).cast("string"), 2, "0"), _pick(_MONTHS, seed, 6), (number(60, 12) + 1960).cast("string"))
    digits = F.rpad(F.abs(seed).cast("string"), 20, "7")
    redrawn = F.array_join(F.transform(F.split(surface, ""), lambda c: F.when(c.rlike("[0-9]"), F.substring(digits, (F.pmod(F.ascii(c) * 7, F.lit(19)) + 1).cast("int"), F.lit(1))).otherwise(c)), "")
    has_digit = surface.rlike("[0-9]")
    return (
        F.when(kind == "PERSON", name)
        .when(kind == "ORG", F.concat(_pick(_LAST, seed), F.lit(" and "), _pick(_LAST, seed, 8)))
        .when(kind == "LOC", F.concat(_pick(_PLACE, seed), F.lit(" "), _pick(["Bay", "Falls", "Hill", "Port"], seed, 8)))
        .when(kind == "DATETIME", F.when(has_digit, date).otherwise(_pick(_DAYS, seed)))
        .when(kind == "CODE", F.when(has_digit, redrawn).otherwise(F.concat(F.lit("XQ-"), F.lpad(number(10000, 0).cast("string"), 4, "0"))))
        .when(kind == "QUANTITY", (number(99999, 0) + 1).cast("string"))
        .when(kind == "DEM", _pick(_COUNTRIES, seed))
        .when(kind == "EMAIL_ADDRESS", F.concat(F.lower(_pick(_FIRST, seed)), F.lit("."), F.lower(_pick(_LAST, seed, 8)), F.lit("@example.org")))
        .when(kind == "PHONE_NUMBER", F.concat(F.lit("+1 555 "), F.lpad(number(10000000, 0).cast("string"), 7, "0")))
        .when(kind == "IP_ADDRESS", F.concat_ws(".", F.lit("10"), *(number(256, s).cast("string") for s in (0, 8, 16))))
        .otherwise(F.lower(_pick(_PLACE, seed)))
    )


def aliases(spans: Column) -> Column:
    """``[TYPE_k]`` for every span: k counts the entities of a type in the order of their first mention."""
    firsts = F.aggregate(spans, F.array().cast(f"array<{S.SPAN}>"), lambda acc, s: F.when(F.exists(acc, lambda a: a["ent"] == s["ent"]), acc).otherwise(F.concat(acc, F.array(s))))

    def label(known: Column) -> Column:
        def one(s: Column) -> Column:
            place = F.array_position(F.transform(known, lambda k: k["ent"]), s["ent"]).cast("int")
            kind = F.get(known, place - 1)["type"]
            rank = F.size(F.filter(F.slice(known, F.lit(1), place), lambda k: k["type"] == kind))
            return F.concat(F.lit("["), kind, F.lit("_"), rank.cast("string"), F.lit("]"))

        return F.transform(spans, one)

    return let(firsts, label)


def replacements(spans: Column, strategy: str, key: Column, case: Column, salt: str = SALT) -> Column:
    """The array of what stands for every span. A strategy that doesn't exist raises."""
    surface = lambda s: s["surface"]
    if strategy == "RAW":
        return F.transform(spans, surface)
    if strategy == "DROP":
        return F.transform(spans, lambda s: F.lit(""))
    if strategy == "MASK":
        return F.transform(spans, lambda s: F.lit("[PII]"))
    if strategy == "TYPE":
        return F.transform(spans, lambda s: F.concat(F.lit("["), s["type"], F.lit("]")))
    if strategy == "ALIAS-DOC":
        return aliases(spans)
    if strategy in ("SUR-DOC", "SUR-CORPUS", "SUR-SUBJECT"):
        scope = {"SUR-DOC": key, "SUR-CORPUS": F.lit("CORPUS"), "SUR-SUBJECT": F.concat(F.lit("SUBJECT|"), case.cast("string"))}[strategy]
        return let(hmac_pads(F.concat(F.lit(salt + "|"), scope).cast("binary")), lambda pads: F.transform(spans, lambda s: surrogate(s["surface"], pads)))
    if strategy == "HASH-ENTITY":
        own = lambda i: F.unhex(F.sha2(F.concat_ws("|", F.lit(salt), key, i.cast("string")), 256))
        return F.transform(spans, lambda s, i: F.sha2(F.concat(s["surface"].cast("binary"), own(i)), 256))
    if strategy == "FAKER-DOC":
        return F.transform(spans, lambda s: let(seed_of(F.lit(salt), key, s["ent"]), lambda seed: fake_value(s["type"], s["surface"], seed)))
    raise ValueError(strategy)


def _joined(text: Column, spans: Column, values: Column) -> Column:
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(state, x):
        before = F.substring(text, state["at"] + 1, x["s"]["start"] - state["at"])
        return F.struct(x["s"]["end"].alias("at"), F.concat(state["out"], F.array(before, x["v"])).alias("out"))

    pairs = F.zip_with(spans, values, lambda s, v: F.struct(s.alias("s"), v.alias("v")))
    joined = let(F.aggregate(pairs, start, add), lambda e: F.concat(F.array_join(e["out"], ""), F.substring(text, e["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(joined)


def release(text: Column, spans: Column, strategy: str, key: Column, case: Column, salt: str = SALT) -> Column:
    """The text under one of ``STRATEGIES`` or ``DERIVED``. Spans are resolved and in order."""
    if strategy == "RAW":
        return text
    if strategy == "SUR-DOC-COLLAPSED":
        return F.regexp_replace(release(text, spans, "SUR-DOC", key, case, salt), TOKEN_FORM, "[PII]")
    if strategy == "HASH-COLLAPSED":
        return F.regexp_replace(release(text, spans, "HASH-ENTITY", key, case, salt), HASH_FORM, "[PII]")
    if strategy == "SUR-DOC-SKIP":
        return F.regexp_replace(release(text, spans, "SUR-DOC", key, case, salt), TOKEN_FORM, " ")
    if strategy == "HASH-SKIP":
        return F.regexp_replace(release(text, spans, "HASH-ENTITY", key, case, salt), HASH_FORM, " ")
    if strategy == "ALIAS-COLLAPSED":
        return F.regexp_replace(release(text, spans, "ALIAS-DOC", key, case, salt), ALIAS_FORM, r"[$1]")
    if strategy in ("YEAR", "YEAR-FAKER"):
        base = replacements(spans, "SUR-DOC" if strategy == "YEAR" else "FAKER-DOC", key, case, salt)
        years = lambda s: F.array_join(F.regexp_extract_all(s["surface"], F.lit(CENTURY_YEAR), F.lit(0)), " ")
        return _joined(text, spans, F.zip_with(spans, base, lambda s, v: F.when(s["type"] == "DATETIME", years(s)).otherwise(v)))
    return _joined(text, spans, replacements(spans, strategy, key, case, salt))


def redetect_and_collapse(text: Column, detector: str) -> Column:
    """What a detector finds in a released text, as ``[TYPE]``."""
    return let(S.detect(text, detector), lambda found: _joined(text, found, F.transform(found, lambda s: F.concat(F.lit("["), s["type"], F.lit("]")))))


def mention_releases(spans: Column, strategy: str, key: Column, case: Column, salt: str = SALT) -> Column:
    """``ARRAY<STRUCT<released, truth, type>>`` of every mention; placeholders stay as they are, all else is normalised."""
    values = replacements(spans, strategy, key, case, salt)
    norm = lambda v: F.when(v.startswith("["), v).otherwise(surface_norm(v))
    return F.zip_with(spans, values, lambda s, v: F.struct(norm(v).alias("released"), surface_norm(s["surface"]).alias("truth"), s["type"].alias("type")))
