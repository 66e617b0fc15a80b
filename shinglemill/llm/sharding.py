"""Jump consistent hashing of stable keys to shards (Lamping and Veach, 2014), with gapless slots in each shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shinglemill.scratch import Scratch

_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Offsets of slot buckets are broadcast up to this many rows (24 bytes each), else joined.
OFFSETS_BROADCAST = 200_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every unsigned 64-bit key, all keys stepping together; no ring and no table."""
    key = keys.astype(np.uint64, copy=True)
    shard, ahead = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    open_ = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(open_):
            shard[open_] = ahead[open_]
            k = key[open_] = key[open_] * np.uint64(2862933555777941757) + np.uint64(1)
            ahead[open_] = ((shard[open_] + 1) * (float(1 << 31) / ((k >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
            open_ = open_[ahead[open_] < shards]
    return shard


def spread(values: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit ids (the finalizer of splitmix64), so that runs of ids are no runs of keys."""
    with np.errstate(over="ignore"):
        z = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def shard_of(key, shards: int):
    """A column with the shard, from 0, of a BIGINT key column. A null key counts as -1."""

    @F.pandas_udf("int")
    def jump(ids: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(spread(ids.to_numpy(np.int64)), shards).astype(np.int32))

    return jump(F.coalesce(key.cast("bigint"), F.lit(-1)))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40, rows_per_bucket: int = 20_000) -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``.

    The law is ``key``: the key and the number of shards alone decide, and with one shard more (``grown_shard``) rows
    move into the new shard only. ``size`` is the text's UTF-8 bytes plus 16, however long it is. Slots count from 0 without
    gaps in every shard. They follow buckets of hashed rows, so that no task sorts a whole shard; a bucket that repeated rows
    have made large is dealt out again by row number. A null text has 0 bytes, a null key is a key of its own, an empty
    table gives no rows, and other columns of ``docs`` are ignored.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("k"), (F.octet_length(body) + 16).cast("bigint").alias("size"), F.crc32(body).alias("crc"))
    rows = rows.withColumn("shard", shard_of(F.col("k"), shards)).withColumn("grown", shard_of(F.col("k"), shards + 1))
    rows = scratch.keep(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    buckets = max(1, -(-rows.count() // (shards * rows_per_bucket)))
    named = F.concat_ws("|", F.coalesce(F.col("k").cast("string"), F.lit("")), F.col("crc").cast("string"))
    bucket = F.conv(F.substring(F.md5(named.cast("binary")), 1, 8), 16, 10).cast("bigint") % buckets
    rows = rows.withColumn("bucket", bucket if buckets > 1 else F.lit(0).cast("bigint"))
    large = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * rows_per_bucket)
    large = scratch.keep(large.select("shard", "bucket", F.ceil(F.col("n") / rows_per_bucket).alias("parts")), "large")
    rows = rows.join(F.broadcast(large) if shards * buckets <= OFFSETS_BROADCAST else large, ["shard", "bucket"], "left")
    rows = rows.withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("row"), F.col("parts"))).otherwise(0))
    before = Window.partitionBy("shard").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "bucket", "part").agg(F.count("*").alias("n")).select("shard", "bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if shards * buckets <= OFFSETS_BROADCAST:
        offsets = F.broadcast(offsets)
    within = F.row_number().over(Window.partitionBy("shard", "bucket", "part").orderBy("k", "crc", "size"))
    return (
        rows.withColumn("rank", within)
        .join(offsets, ["shard", "bucket", "part"])
        .select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).cast("bigint").alias("slot"), F.col("grown").alias("grown_shard"))
    )


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: int = 40, files_per_shard: int = 8) -> None:
    """Writes whole rows as parquet under ``path/shard=N/``. Each shard is dealt out to several tasks and files."""
    placed = docs.withColumn("shard", shard_of(F.col(key), shards))
    spread_rows = F.pmod(F.xxhash64(key), F.lit(files_per_shard))
    placed.repartition(shards * files_per_shard, "shard", spread_rows).write.partitionBy("shard").mode("errorifexists").parquet(path)


def op2_jump_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _jump_sql(shards: int) -> str:
    """The shard of every key, stepped through in unsigned arithmetic."""
    return f"""WITH RECURSIVE j AS (SELECT k, (key * 2862933555777941757 + 1) % 18446744073709551616 AS key, 0::BIGINT AS b FROM z
UNION ALL SELECT k, (key * 2862933555777941757 + 1) % 18446744073709551616, n FROM (SELECT k, key, trunc((b + 1) * (2147483648.0::DOUBLE / ((key // 8589934592) + 1)::DOUBLE))::BIGINT AS n FROM j) WHERE n < {shards})
SELECT k, max(b) AS shard FROM j GROUP BY k"""


#: The table of CRC-32 for the bytes of a text; fixed value: the reflected polynomial.
_CRC_TABLE = "(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"
_WRAP = "% 18446744073709551616::UHUGEINT"
#: The same by SQL, with a bucket for each 20,000 rows of a shard, as long as repeated rows make none of them large.
ORACLES = {
    "op2_jump_hash_shards": f"""WITH t AS (SELECT {_CRC_TABLE} AS t), d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
h AS (SELECT doc_id, text, hex(encode(text)) AS h FROM d),
c AS (SELECT doc_id, (octet_length(encode(text)) + 16)::BIGINT AS size, xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(h) // 2), lambda i: (('0x' || substr(h, 2 * i + 1, 2))::BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM h, t),
a AS (SELECT DISTINCT doc_id AS k, ((CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END)::UHUGEINT + 11400714819323198485) {_WRAP} AS z FROM documents),
b AS (SELECT k, (xor(z, z >> 30) * 13787848793156543929) {_WRAP} AS z FROM a),
e AS (SELECT k, (xor(z, z >> 27) * 10723151780598845931) {_WRAP} AS z FROM b),
z AS (SELECT k, xor(z, z >> 31) AS key FROM e),
s AS ({_jump_sql(40)}), g AS ({_jump_sql(41)}),
n AS (SELECT greatest(1, ceil(count(*) / 800000.0))::BIGINT AS n FROM documents),
r AS (SELECT doc_id, size, text_crc32, s.shard, g.shard AS grown, ('0x' || substr(md5(doc_id || '|' || text_crc32), 1, 8))::BIGINT % n AS bucket FROM c JOIN s ON s.k = doc_id JOIN g ON g.k = doc_id, n)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown::INT AS grown_shard FROM r""",
}
QUERIES = {"op2_jump_hash_shards": op2_jump_hash_shards}
