"""Sinks of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _finite(df: DataFrame) -> DataFrame:
    """NaN and infinities as null; JSON has neither."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)) for c in floats})


def json_report(df: DataFrame, path: str) -> None:
    """A small result as JSON lines in one file, written once: an existing path raises, and the committer makes it appear whole."""
    _finite(df).coalesce(1).write.mode("errorifexists").json(path)


def parquet_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Written once, like ``json_report``."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def merge_parts(parts: list[DataFrame], key: str) -> DataFrame:
    """Partial results by key; a key in two parts raises."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    if out.groupBy(key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"{key} repeats")
    return out


def latex_rows(df: DataFrame) -> list[str]:
    """A small result as rows of a table: doubles with three digits."""
    show = lambda v: "--" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("_", r"\_")
    return [" & ".join(map(show, r)) + r" \\" for r in df.collect()]
