"""Resampling statistics. Spark sums outcomes up by cluster; only sums of clusters that can matter reach the driver, whose
seeded generators make intervals reproducible."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mcnemar(only_first: int, only_second: int) -> float:
    """The exact two-sided binomial probability of so uneven a split of the discordant cases."""
    n, k = only_first + only_second, min(only_first, only_second)
    if n == 0:
        return 1.0
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    top = max(log)
    return min(1.0, 2 * math.exp(top) * sum(math.exp(x - top) for x in log))


def discordance(paired: DataFrame, first: str, second: str) -> tuple[int, int, int, int]:
    """``(n, only first, only second, both)`` of two boolean columns."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    a, b = F.col(first), F.col(second)
    r = paired.agg(F.count("*").alias("n"), n(a & ~b).alias("x"), n(~a & b).alias("y"), n(a & b).alias("z")).first()
    return r["n"], r["x"], r["y"], r["z"]


def paired_bootstrap(paired: DataFrame, first: str, second: str, reps: int = 2000, seed: int = 20261001) -> dict:
    """The difference of two shares over the same cases, its percentile interval, and McNemar's test. A resample's difference
    depends on how many cases of each kind it draws, so a multinomial draw stands for drawing cases."""
    n, x, y, z = discordance(paired, first, second)
    if not n:
        raise ValueError("no cases")
    drawn = np.random.default_rng(seed).multinomial(n, [x / n, y / n, 1 - (x + y) / n], reps)
    diff = (drawn[:, 0] - drawn[:, 1]) / n
    low, high = np.percentile(diff, [2.5, 97.5])
    return {"diff": (x - y) / n, "lo": float(low), "hi": float(high), "only_first": x, "only_second": y, "p": mcnemar(x, y)}


def cluster_bootstrap(rows: DataFrame, value: str, group: str, reps: int = 2000, seed: int = 20261001, ratio: bool = True) -> tuple[float, float, float]:
    """``(estimate, low, high)`` of a mean (``ratio``) or total, whole groups being drawn; the bounds are sorted draws. Groups equal in
    sum and size are drawn as one kind by a multinomial, so their number doesn't reach the driver, nor cost draws."""
    per_group = rows.groupBy(group).agg(F.sum(value).cast("double").alias("s"), F.count(value).alias("n"))
    kinds = per_group.groupBy("s", "n").agg(F.count("*").alias("k")).orderBy("s", "n").collect()
    if not kinds or reps <= 0:
        raise ValueError("rows and a positive number of draws are needed")
    s, n, k = (np.array([r[c] for r in kinds], float) for c in "snk")
    drawn = np.random.default_rng(seed).multinomial(int(k.sum()), k / k.sum(), reps)
    value_of = lambda times: times @ s / (times @ n if ratio else 1)
    draws = np.sort(value_of(drawn))
    return float(value_of(k)), float(draws[int(0.025 * (reps - 1))]), float(draws[int(0.975 * (reps - 1))])


def multinomial_bootstrap(rows: DataFrame, value: str, group: str, reps: int = 2000, seed: int = 0) -> tuple[float, float, float]:
    """``(total, low, high)``: groups with a total of 0 are only counted, so they needn't reach the driver one by one."""
    sums = rows.groupBy(group).agg(F.sum(value).cast("double").alias("s")).groupBy("s").count().orderBy("s").collect()
    values, counts = np.array([r["s"] for r in sums], float), np.array([r["count"] for r in sums], float)
    n = int(counts.sum())
    if not n:
        raise ValueError("no groups")
    totals = np.random.default_rng(seed).multinomial(n, counts / n, reps) @ values
    low, high = np.percentile(totals, [2.5, 97.5])
    return float(values @ counts), float(low), float(high)


def page_bootstrap(values: list[float], reps: int = 2000, seed: int = 20261004) -> tuple[float, float, float]:
    """Mean of pages with the 50th and 1950th of 2000 sorted resampled means."""
    rng = random.Random(seed)
    draws = sorted(sum(values[rng.randrange(len(values))] for _ in values) / len(values) for _ in range(reps))
    return sum(values) / len(values), draws[int(reps * 0.0245)], draws[int(reps * 0.9745)]
