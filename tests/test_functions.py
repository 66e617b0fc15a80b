import hashlib
import hmac
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shinglemill.functions import keyed as K
from shinglemill.functions import release as R
from shinglemill.functions import spans as S
from shinglemill.functions import text as T

TEXT = "Ada Writer met ada@x.org and +1 (555) 123-4567 in 2020, then Ada Writer 10.0.0.1 🙂 é. Call 5551234567"


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


def test_tokens_and_short_shingles(spark):
    assert one(spark, T.tokens(F.lit("Seven Boats near [LOC_2], Rust"))) == ["seven", "boats", "near", "[LOC_2]", "rust"]
    assert one(spark, T.shingles_text(T.tokens(F.lit("Rust, everywhere")), 5)) == ["rust everywhere"]
    assert one(spark, T.shingles(T.tokens(F.lit("Rust, everywhere")), 5)) == [zlib.crc32(b"rust everywhere")]
    assert one(spark, T.shingles(T.tokens(F.lit("")), 5)) == [0]
    assert one(spark, T.shingles_strict(T.words_lower(F.lit("a b c d")))) == []
    with pytest.raises(ValueError):
        T.shingles_text(F.lit(None), 0)


def test_simple_words(spark):
    def plain(s):
        s = re.sub(r"[^\w\s]|_", " ", re.sub(r"\d+([.,]\d+)?", "0", s.lower()))
        return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn").split()

    for s in ("É 1,5 x_y [PII] 3.", "[PERSON_1] über-all", ""):
        assert one(spark, T.simple_words(F.lit(s))) == plain(s)


def test_minhash_and_bands(spark):
    a, b = T.minhash_coefficients(112, 0)
    ids = np.array([5, 2**32 - 1, 77])
    want = [min((int(x) * int(p) + int(q)) % T.PRIME for x in ids) for p, q in zip(a, b)]
    got = T.minhash(ids, a, b)
    assert got.tolist() == want
    bands = one(spark, T.bands(F.array(*map(F.lit, want)), 14, 8))
    assert len(bands) == 14 and bands[1] == ",".join(map(str, want[8:16]))


def test_keyed_hashes(spark):
    for key in (b"k", b"k" * 90):
        assert one(spark, K.hmac_sha256_hex(F.lit(key), F.lit(b"abc"))) == hmac.new(key, b"abc", "sha256").hexdigest()
    n, out = int.from_bytes(hmac.new(b"s", b"ada", "sha256").digest()[:8], "big"), "zq"
    for _ in range(10):
        n, r = divmod(n, 26)
        out += chr(97 + r)
    assert one(spark, K.token_of(K.hmac_pads(F.lit(b"s")), F.lit("Ada"))) == out
    d = int.from_bytes(hmac.new(b"k", b"a b c d e", "sha256").digest()[:8], "little")
    assert one(spark, T.keyed_shingles(T.tokens(F.lit("a b c d e")), 5, b"k")) == [(d ^ d >> 32) & 0xFFFFFFFF]


def test_offsets_and_alignment(spark):
    text = TEXT * 40
    spans = one(spark, S.contact_spans(F.lit(text)))
    want = sorted((m.start(), m.end()) for rx in (r"[\w.+-]+@[\w-]+\.[\w.-]+", r"\+?\d[\d ()-]{7,}\d", r"\b(?:\d{1,3}\.){3}\d{1,3}\b") for m in re.finditer(rx, text))
    assert [(s["start"], s["end"]) for s in spans] == want
    assert one(spark, S.misaligned(F.lit(text), S.contact_spans(F.lit(text)))) == 0
    assert one(spark, S.regex_spans(F.lit(None).cast("string"), "x", "X")) == []


def test_longest_first(spark):
    rows = [(0, 4), (2, 9), (8, 10), (9, 12)]
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("T").alias("type"), F.lit("").alias("surface"), F.lit("").alias("ent")) for a, b in rows))
    assert [(s["start"], s["end"]) for s in one(spark, S.resolve(spans))] == [(2, 9), (9, 12)]
    assert one(spark, S.has_overlap(spans)) and not one(spark, S.has_overlap(S.resolve(spans)))


def test_marking_scopes(spark):
    said = "The ferry of Nora Quist sank off Cape Dulse Point during 1987, says nora  quist."
    text, title = F.lit(said), F.lit("Nora Quist (sailor)")
    found = [[s["surface"] for s in one(spark, S.revision_spans(text, title, scope))] for scope in S.SCOPES]
    assert found == [["Nora Quist", "nora  quist"], ["Nora Quist", "Cape Dulse Point", "nora  quist"], ["Nora Quist", "Cape Dulse Point", "1987", "nora  quist"]]
    assert all(said[s["start"] : s["end"]] == s["surface"] for s in one(spark, S.revision_spans(text, title, "DENSE")))
    with pytest.raises(ValueError):
        S.revision_spans(text, title, "ALL")


def test_marking_density(spark):
    text = F.lit("we saw the old mill burn down twice last winter")
    d = one(spark, S.marking_density(text, S.regex_spans(text, "mill|winter", "X")))
    assert (d["token_share"], d["window_share"]) == (2 / 10, 6 / 6)
    d = one(spark, S.marking_density(text, S.regex_spans(text, "we", "X")))
    assert (d["token_share"], d["window_share"]) == (1 / 10, 1 / 6)


def test_name_tokens(spark):
    assert [s["surface"] for s in one(spark, S.name_tokens(F.lit("Then Ada came. Bob left\nCleo (Dov) saw “Finn”")))] == ["Ada"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([("k1", 7, TEXT), ("k2", 8, "")], "key string, case long, text string")
    return df.withColumn("spans", S.rule_entities(F.col("text")))


def released(docs, strategy):
    return docs.select(R.release(F.col("text"), F.col("spans"), strategy, F.col("key"), F.col("case")).alias("r")).first()["r"]


def test_placeholders(docs):
    assert released(docs, "RAW") == TEXT
    assert released(docs, "MASK").startswith("[PII] met [PII] and [PII] in [PII], then [PII] [PII] 🙂 é.")
    assert released(docs, "DROP").startswith(" met  and  in ")
    assert released(docs, "ALIAS-DOC").startswith("[PERSON_1] met [CODE_1] and [CODE_2] in [DATETIME_1], then [PERSON_1] [CODE_3]")
    assert released(docs, "ALIAS-COLLAPSED") == released(docs, "TYPE")
    with pytest.raises(ValueError):
        released(docs, "OTHER")


def test_hash_depends_on_place(docs):
    own = hashlib.sha256(f"{R.SALT}|k1|0".encode()).digest()
    first = released(docs, "HASH-ENTITY").split()[0]
    assert first == hashlib.sha256(b"Ada Writer" + own).hexdigest()
    assert released(docs, "HASH-ENTITY").count(first) == 1
    assert released(docs, "HASH-COLLAPSED") == released(docs, "MASK")


def test_surrogates(docs):
    doc, corpus = released(docs, "SUR-DOC"), released(docs, "SUR-CORPUS")
    assert doc != corpus and doc.split()[0] == doc.split("then ")[1].split()[0]
    assert released(docs, "SUR-DOC-SKIP").split()[:2] == ["met", "@"]
    assert "in 2020, then" in released(docs, "YEAR") and "in 2020, then" in released(docs, "YEAR-FAKER")
    faked = released(docs, "FAKER-DOC")
    assert faked != TEXT and faked.split()[:2] == faked.split("then ")[1].split()[:2]
