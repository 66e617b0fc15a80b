"""Seeded choices by hash: the same in Spark and in SQL, on any number of machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(seed: int | str, *parts: Column) -> Column:
    """The hex MD5 of seed and parts, joined by ``|``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)).cast("binary"))


def draw(seed: int | str, *parts: Column) -> Column:
    """A number in [0, 2 ** 32) from the first 8 hex digits."""
    return F.conv(F.substring(digest(seed, *parts), 1, 8), 16, 10).cast("bigint")


def uniform(seed: int | str, *parts: Column) -> Column:
    return draw(seed, *parts) / float(1 << 32)


def lowest(rows: DataFrame, order: Column, n: int) -> DataFrame:
    """The ``n`` rows of the lowest ``order`` (a hex digest). Counts by its first four digits tell where to cut, so only the
    rows of one digit group in 65,536 are ranked."""
    rows = rows.withColumn("_order", order).withColumn("_group", F.substring("_order", 1, 4))
    counts = rows.groupBy("_group").count().orderBy("_group").collect()  # 65,536 rows at most
    before, cut = 0, None
    for r in counts:
        if before + r["count"] > n:
            cut = r["_group"]
            break
        before += r["count"]
    if cut is None:
        return rows.drop("_order", "_group")
    rank = F.row_number().over(Window.partitionBy("_group").orderBy("_order"))
    edge = rows.filter(F.col("_group") == cut).withColumn("_rank", rank).filter(F.col("_rank") <= n - before).drop("_rank")
    return rows.filter(F.col("_group") < cut).unionByName(edge).drop("_order", "_group")
