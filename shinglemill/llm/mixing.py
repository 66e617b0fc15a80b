"""Mixing sources to target weights by entropy balancing.

Every document d of source s has a rate r in (0, 2), how often the mix takes it. Of all rates that meet the token
constraint of each source, sum of r times size = target, those with the largest entropy
``-(r log r + (2 - r) log(2 - r))`` are exponentially tilted: r / (2 - r) = exp(lambda_s * size / mean size). The multipliers
lambda_s solve a convex dual by Newton iterations; each iteration is one distributed aggregate over (source, size, number of
documents), which holds all that the dual needs. Rates are then rounded into 0, 1 or 2 copies by order sampling, so that a
source's taken tokens miss its target by less than a document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shinglemill.llm.memory import small_batches, small_table
from shinglemill.scratch import Scratch

#: Multipliers are the model; the driver holds one small row for each source, and refuses more sources than this.
MAX_SOURCES = 1_000_000
#: Up to this many sources their rows (about 60 bytes) are broadcast, beyond it joined.
BROADCAST_SOURCES = 20_000
WORDS = r"[^\x20\x09-\x0D]+"
_RADIX = 1_024
_UNIT = 1 << 20


def targets(sizes: dict, weights: list[float], share: float = 1.5, ceiling: float = 2.0) -> dict:
    """Target tokens of every source: ``share`` of all tokens by weight, at most ``ceiling`` times the source, the excess
    shared out again by weight among the others until none is above. Weights repeat over sources by code point, null last."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed, left = {}, share * sum(sizes.values())
    open_ = list(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > ceiling * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / total for s in open_}
        for s in over:
            fixed[s] = ceiling * sizes[s]
        left -= sum(fixed[s] for s in over)
        open_ = [s for s in open_ if s not in fixed]
    return fixed


def _with(df: DataFrame, side: list[tuple], schema: str) -> DataFrame:
    """``df`` joined null-safely by source with a row for each source, broadcast where their number allows it."""
    right = small_table(df.sparkSession, side, "_s string, " + schema)
    right = F.broadcast(right) if len(side) <= BROADCAST_SOURCES else right
    return df.join(right, df["source"].eqNullSafe(right["_s"])).drop("_s")


def _rate(lam, ratio):
    return F.when(lam == float("inf"), F.lit(2.0)).otherwise(2.0 / (1.0 + F.exp(-F.least(F.greatest(lam * ratio, F.lit(-700.0)), F.lit(700.0)))))


def solve(histogram: DataFrame, goal: dict, totals: dict, rounds: int = 500, tolerance: float = 1e-7) -> dict:
    """The multiplier of every source. ``histogram``: source, size, n. Sums are taken in integers, so reruns agree exactly.
    Steps that leave the bracket of a root halve it; raises where ``rounds`` don't suffice."""
    lam, low, high = {}, {}, {}
    for s, (size, n) in totals.items():
        lam[s] = 0.0 if not size else float("inf") if goal[s] >= 2 * size else -float("inf") if goal[s] <= 0 else 0.0
        low[s], high[s] = -float("inf"), float("inf")
    open_ = {s for s in lam if math.isfinite(lam[s]) and totals[s][0]}
    for step_number in range(rounds + 1):
        if not open_:
            break
        if step_number == rounds:
            raise RuntimeError(f"no multiplier for {len(open_)} sources after {rounds} iterations")
        side = [(s, lam[s], totals[s][0] / totals[s][1]) for s in open_]
        ratio = F.col("size") / F.col("mean")
        rated = _with(histogram, side, "lam double, mean double").withColumn("r", _rate(F.col("lam"), ratio))
        tokens = F.sum((F.round(F.col("size") * F.col("r") * _UNIT).cast("decimal(30,0)") * F.col("n")).cast("decimal(38,0)"))
        slope = F.sum((F.round(F.col("size") * ratio * F.col("r") * (2 - F.col("r")) / 2 * _UNIT).cast("decimal(30,0)") * F.col("n")).cast("decimal(38,0)"))
        for row in rated.groupBy("source").agg(tokens.alias("t"), slope.alias("h")).collect():
            s, gap, h = row["source"], int(row["t"]) / _UNIT - goal[row["source"]], int(row["h"]) / _UNIT
            if abs(gap) <= max(tolerance * goal[s], 1e-3):
                open_.discard(s)
                continue
            low[s], high[s] = (low[s], lam[s]) if gap > 0 else (lam[s], high[s])
            step = lam[s] - gap / h if h > 0 else math.nan
            if not low[s] < step < high[s]:
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s] + high[s]) else (2 * lam[s] - 1 if gap > 0 else 2 * lam[s] + 1)
            if step == lam[s]:  # no double lies between
                open_.discard(s)
            lam[s] = step
    return lam


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, id_col: str = "doc_id", text: str = "text", source: str = "source", keep: tuple = (), seed: int = 17) -> DataFrame:
    """``(id, source, size, source_size, target, rate, copies, taken)`` and the columns ``keep`` for every row of ``docs``.

    Size is the number of words, 0 for a null or empty text, however long it is; a document without words has rate 1, one
    copy and takes nothing. A null source is a source of its own, last in order. Repeated rows, also those with a null
    id, are documents of their own with the same draw. Ties of the draw go by id, then size, and rows equal in all of these
    are told apart by number. Only id, text, source and ``keep`` are read, so other columns never clash. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "mix")
    body = F.coalesce(F.col(text), F.lit(""))
    rows = scratch.keep(docs.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), F.regexp_count(body, F.lit(WORDS)).cast("bigint").alias("size"), *(F.col(c).alias(f"_{c}") for c in keep)).withColumn("row", F.monotonically_increasing_id()), "sizes")
    histogram = scratch.keep(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    found = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = {r["source"]: (int(r["size"]), int(r["n"])) for r in found}
    goal = targets({s: size for s, (size, _) in totals.items()}, list(weights), share)
    lam = solve(histogram, goal, totals)
    scratch.drop("histogram")

    side = [(s, size, float(goal[s]), float(lam[s]), size / n if size else 1.0) for s, (size, n) in totals.items()]
    rated = _with(rows, side, "source_size long, target double, lam double, mean double")
    rated = rated.withColumn("rate", _rate(F.col("lam"), F.col("size") / F.col("mean"))).drop("lam", "mean")
    rated = rated.withColumn("base", F.floor("rate").cast("int"))
    part = F.col("rate") - F.col("base")
    draw = (F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    # Taken in the order of draw / part, up to the tokens that whole copies leave open; part is the chance of being taken.
    rated = rated.withColumn("order", F.when((part > 0) & (F.col("size") > 0), draw / part))
    rated = scratch.keep(rated.withColumn("digits", F.when(F.col("order").isNotNull(), _digits(F.col("order"), F.col("row")))), "rated")
    cuts = _cuts(rated, goal)

    known = {c[0] for c in cuts}
    cuts += [(s, None, 0, 0.0) for s in totals if s not in known]
    rated = _with(rated, cuts, "cut array<long>, before long, need double")
    place = F.slice("digits", F.lit(1), F.size("cut"))
    on_cut = F.coalesce(place == F.col("cut"), F.lit(False))
    near = Window.partitionBy("source", "cut").orderBy("order", "id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    inside = rated.filter(on_cut).withColumn("reached", F.col("before") + F.sum("size").over(near))
    inside = inside.withColumn("extra", (F.col("reached") - F.col("size") / 2 <= F.col("need")).cast("int")).drop("reached")
    before_cut = F.col("digits").isNotNull() & (F.col("cut").isNull() | (place < F.col("cut")))
    others = rated.filter(~on_cut).withColumn("extra", F.coalesce(before_cut, F.lit(False)).cast("int"))
    copies = F.col("base") + F.col("extra")
    return inside.unionByName(others).select(
        F.col("id").alias(id_col), "source", "size", "source_size", "target", F.round("rate", 6).alias("rate"), copies.alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"), *(F.col(f"_{c}").alias(c) for c in keep)
    )


def _digits(order, row):
    """The order as an array of digits in base ``_RADIX``, then those of the hashed row number, which tell equal orders apart."""
    whole = F.least(F.floor(order / (1 + order) * float(_RADIX**5)).cast("bigint"), F.lit(_RADIX**5 - 1))
    of = lambda value, count: [F.floor(value / _RADIX**k).cast("bigint") % _RADIX for k in reversed(range(count))]
    return F.array(*of(whole, 5), *of(F.pmod(F.xxhash64(row), F.lit(_RADIX**3)), 3))


def _cuts(rated: DataFrame, goal: dict) -> list[tuple]:
    """``(source, digits, before, need)`` of every source that is cut: the leading digits of the rows on the cut, the words in front of
    them, and the words to be taken by order. Digit by digit, until few rows share them, so no task ranks more than those."""
    based = rated.groupBy("source").agg(F.sum(F.col("base") * F.col("size")).alias("based"), F.sum(F.when(F.col("digits").isNotNull(), F.col("size"))).alias("sized")).collect()
    need = {r["source"]: float(goal[r["source"]]) - r["based"] for r in based}
    open_ = {r["source"]: ([], 0) for r in based if (r["sized"] or 0) > need[r["source"]]}
    done, depth = [], 0
    while open_:
        depth += 1
        side = [(s, digits, before, need[s]) for s, (digits, before) in open_.items()]
        rows = _with(rated.filter("digits is not null"), side, "lead array<long>, before long, need double")
        rows = rows.filter(F.slice("digits", F.lit(1), F.lit(depth - 1)) == F.col("lead")) if depth > 1 else rows
        sums = rows.groupBy("source", F.get("digits", F.lit(depth - 1)).alias("digit")).agg(F.sum("size").alias("sized"), F.count("*").alias("n"), F.first("before").alias("before"), F.first("need").alias("need"))
        upto = Window.partitionBy("source").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("reached", F.col("before") + F.sum("sized").over(upto)).filter("reached > need")
        for r in sums.groupBy("source").agg(F.min_by(F.struct("digit", "n", (F.col("reached") - F.col("sized")).alias("before")), "digit").alias("c")).collect():
            s, c = r["source"], r["c"]
            digits = [*open_.pop(s)[0], c["digit"]]
            if c["n"] <= _RADIX or depth == 8:
                done.append((s, digits, int(c["before"]), need[s]))
            else:
                open_[s] = (digits, int(c["before"]))
    return done


def op5_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES = {"op5_entropy_balanced_mix": op5_entropy_balanced_mix}
