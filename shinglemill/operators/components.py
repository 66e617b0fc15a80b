"""Connected components by alternating large-star and small-star steps, all on DataFrames.

Every step shuffles by node with partial aggregates first, so a node with very many neighbours costs its mappers,
not one reducer; the joins that follow are plain equi-joins, which adaptive execution splits where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shinglemill.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", label: str = "components") -> DataFrame:
    """``(id, component)`` for every id on an edge between two different ids; component is the smallest reachable id.

    Nulls on either side and self-loops are ignored; repeated and reversed edges count once. An empty edge table
    gives an empty result. Ids without an edge are absent: callers coalesce to the id itself. An id may be a struct of a setting and
    a document, so that one run serves several graphs.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, label)
    now = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).filter("u <> v").distinct()
    now = scratch.keep(now, "0")
    mark = _fingerprint(now)
    step = 0
    while mark[0]:
        step += 1
        now = scratch.keep(_small_star(_large_star(now)), str(step))
        was, mark = mark, _fingerprint(now)
        scratch.drop(str(step - 1))
        if mark == was:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())
