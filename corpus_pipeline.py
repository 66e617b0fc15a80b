"""The document pipeline: language ID, toxicity, near-duplicates, mixing, tokens.

Each stage takes all that its predecessor kept. Its docs are the columns of ``documents``, and so is what it returns, but for
the last. Every stage is run on written input by ``run``, so that a lost executor costs tasks and no stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shinglemill.llm import bpe, dedup, langid, mixing, toxicity
from shinglemill.scratch import Scratch

#: SQL can't express trained networks, so there is none; tests compare every stage with a plain version.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Rows of ids (at most 16 bytes each) up to which they are broadcast to the texts; beyond it both sides are shuffled.
BROADCAST_IDS = 1_000_000


def _side(spark: SparkSession, ids: DataFrame, name: str) -> DataFrame:
    """``ids`` written and counted, broadcast where they are few enough, so that texts needn't be shuffled."""
    ids = Scratch(spark, "pipeline-side").keep(ids, name)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter. Others keep their row; ``lang`` becomes the
    predicted language where it was null. Repeated rows, and rows with a null id, are treated each on its own; an empty table
    stays empty."""
    model = langid.train(docs)
    found = langid.identify(docs.select(*COLUMNS), model)
    known = found if model is None else found.filter("lang_pred <> 'und'")
    known = known.filter(F.col("text").rlike(r"\p{L}"))
    return known.withColumn("lang", F.when(F.col("lang_pred") != "und", F.coalesce("lang", "lang_pred")).otherwise(F.col("lang"))).select(*COLUMNS)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the network takes for toxic. It learns from the labels of this stage's own documents. Repeated rows, and
    rows with a null id, are scored each on its own; an empty table stays empty."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    return toxicity.score_toxicity(docs.select(*COLUMNS), model).filter("toxic_pred = 0").select(*COLUMNS)


def _repeated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Ids of several rows."""
    ids = docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    return Scratch(spark, "pipeline-side").keep(ids, "repeated")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near-duplicates (five-word shingles, similarity 0.8). Rows that
    repeat an id are one document: all its different texts stay with it, each in one row, that of the smallest other columns.
    Rows without an id are kept; an empty table stays empty."""
    kept = dedup.near_duplicates(docs, words=5, percent=80).filter("kept and doc_id is not null").select("doc_id").distinct()
    whole = docs.select(*COLUMNS)
    chosen = whole.join(_side(spark, kept, "kept"), "doc_id", "left_semi").select(*COLUMNS)
    repeated = _repeated(spark, docs)
    if not repeated.isEmpty():
        others = [c for c in COLUMNS if c not in ("doc_id", "text")]
        many = chosen.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("rest")).select("doc_id", "text", "rest.*")
        chosen = chosen.join(repeated, "doc_id", "left_anti").select(*COLUMNS).unionByName(many)
    return chosen.unionByName(whole.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources have their target tokens. Where ids are null or repeated, rows are numbered
    in a written table, as each row is a document of its own to the mix. An empty table stays empty."""
    docs = docs.select(*COLUMNS)
    unique = _repeated(spark, docs).isEmpty() and docs.filter("doc_id is null").isEmpty()
    if unique:
        key, copies = "doc_id", mixing.mix(docs).select("doc_id", "copies")
    else:
        key = "_row"
        docs = Scratch(spark, "pipeline-side").keep(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
        copies = mixing.mix(docs, keep=(key,)).select(key, "copies")
    taken = docs.join(_side(spark, copies.filter("copies > 0"), "copies"), key)
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row, repeated ones and those with a null id too."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language_id", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mixing", mix_sources), ("byte_bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
