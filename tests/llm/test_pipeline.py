"""The stages of the pipeline, each on its own input."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("shinglemill.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

from shinglemill.llm import dedup, mixing  # noqa: E402

STAGE = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def test_order():
    assert list(STAGE) == ["language_id", "toxicity", "near_duplicates", "mixing", "byte_bpe"]


def test_language_keeps_what_has_letters(spark, docs, small):
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "12 34 --", "en", "s", 8), (9003, "", "en", "s", 0)], SCHEMA)
    out = STAGE["language_id"](spark, docs.unionByName(odd), small)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_toxic_documents_go(spark, docs, small):
    out = STAGE["toxicity"](spark, docs, small)
    kept = {r["doc_id"] for r in out.collect()}
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    clean = [d for d, m in marks.items() if m == 0]
    assert out.columns == docs.columns and sum(d in kept for d in clean) >= 0.9 * len(clean)


def test_one_of_each_group_stays(spark, docs, small):
    extra = spark.createDataFrame([(None, "x y", "en", "s", 3), (None, "x y", "en", "s", 3)], SCHEMA)
    twice = docs.unionByName(docs.filter("doc_id < 3")).unionByName(extra)
    out = STAGE["near_duplicates"](spark, twice, small)
    want = {r["doc_id"] for r in dedup.near_duplicates(docs, words=5).filter("kept").collect()}
    got = [r["doc_id"] for r in out.collect()]
    assert sorted(d for d in got if d is not None) == sorted(want) and got.count(None) == 2


def test_mixing_repeats_rows(spark, docs, small):
    got = collections.Counter(r["doc_id"] for r in STAGE["mixing"](spark, docs, small).collect())
    assert got == {r["doc_id"]: r["copies"] for r in mixing.mix(docs).filter("copies > 0").collect()}


def test_tokens_of_every_row(spark, docs, small):
    out = STAGE["byte_bpe"](spark, docs.unionByName(docs.filter("doc_id = 1")), small)
    want = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in docs.collect()}
    rows = out.collect()
    assert len(rows) == len(want) + 1 and all(r["decoded_sha256"] == want[r["doc_id"]] for r in rows)


def test_mixing_without_ids(spark, docs, small):
    rows = [(None, " ".join("w" * 1 for _ in range(i % 90 + 1)), "en", "s", 1) for i in range(60)] + [(i, "other words " * 30, "en", "t", 1) for i in range(30)]
    odd = spark.createDataFrame(rows, SCHEMA)
    goal = {r["source"]: r["target"] for r in mixing.mix(odd).select("source", "target").distinct().collect()}
    taken = collections.Counter()
    for r in STAGE["mixing"](spark, odd, small).collect():
        taken[r["source"]] += len(r["text"].split())
    assert all(abs(taken[s] - goal[s]) <= 90 for s in goal)


def test_repeated_id_keeps_its_texts(spark, docs, small):
    words = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(1, words("a"), "en", "s", 1), (1, words("a"), "de", "r", 1), (1, words("b"), "en", "s", 1), (2, words("b") + " x", "en", "s", 1)]
    out = STAGE["near_duplicates"](spark, spark.createDataFrame(rows, SCHEMA), small).collect()
    assert sorted((r["doc_id"], r["text"], r["lang"]) for r in out) == [(1, words("a"), "de"), (1, words("b"), "en")]


@pytest.mark.parametrize("name", list(STAGE))
def test_empty_tables_and_other_columns(spark, docs, small, name):
    assert STAGE[name](spark, docs.limit(0), small).count() == 0
    few = docs.filter("doc_id < 20")
    clash = few.select("*", *(F.lit(1).alias(c) for c in ("copies", "kept", "toxicity", "lang_pred", "ids", "_text", "_row")))
    same = lambda df: sorted(map(str, STAGE[name](spark, df, small).collect()))
    assert same(clash) == same(few)


def test_run_is_the_stages_one_after_the_other(spark, docs, small):
    now = docs
    for stage in STAGE.values():
        now = spark.createDataFrame((found := stage(spark, now, small)).collect(), found.schema)
    assert collections.Counter(map(str, now.collect())) == collections.Counter(map(str, corpus_pipeline.run(spark, small).collect()))
