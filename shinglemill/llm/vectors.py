"""Near-duplicate embeddings by random-hyperplane sign hashing, with exact cosines and distributed components.

A table's key is the label and ``bits`` signs of projections onto random hyperplanes. Bits grow with the logarithm of the
number of vectors, and the tables are as many as keep the chance of missing a pair at the threshold below ``miss``. Vectors that
meet in a table are compared in double precision in blocks. A pair is counted in the first table in which it meets, so
blocks give each vector a number of links and the root of a spanning tree, and no pair is ever written.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shinglemill.operators.components import connected_components
from shinglemill.scratch import Scratch

#: Members of a bucket that are compared in one task; larger buckets are cut into pairs of blocks.
BLOCK = 1_024


def plan_tables(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a key and number of tables for ``n`` vectors."""
    bits = max(6, math.ceil(math.log2(max(n, 2))) - 2)
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-same))


def comparable(vector):
    """Whether an array column is a vector that takes part: not null or empty, no null, all finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _keys(classes: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    def run(batches):
        planes = {}
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            keys = [None] * len(vectors)
            by_size: dict = {}
            for i, v in enumerate(vectors):
                by_size.setdefault(len(v), []).append(i)
            for d, rows in by_size.items():
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).standard_normal((d, bits * tables))
                signs = (np.array([vectors[i] for i in rows], np.float64) @ planes[d] > 0).reshape(len(rows), tables, bits)
                packed = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2)
                for i, k in zip(rows, packed):
                    keys[i] = k
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.list_(pa.int64()))], [*batch.schema.names, "keys"])

    return classes.mapInArrow(run, "rep long, label string, vector array<double>, weight long, keys array<long>")


def _compare(groups: DataFrame, threshold: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, links, roots = [], [], []
            for table, group in zip(batch.column("table").to_pylist(), batch.column("group")):
                v = group.values
                rep, weight, side = (v.field(f).to_numpy(zero_copy_only=False) for f in ("rep", "weight", "side"))
                x = v.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1)
                keys = v.field("keys").flatten().to_numpy(zero_copy_only=False).reshape(len(rep), -1)
                x = x / np.sqrt((x * x).sum(1, keepdims=True))
                near = x @ x.T >= threshold
                if side.any():
                    near &= side[:, None] != side[None, :]
                np.fill_diagonal(near, False)
                if not near.any():
                    continue
                count = near.copy()
                i, j = np.nonzero(near)
                if table:
                    for at in range(0, len(i), 65_536):
                        p, q = i[at : at + 65_536], j[at : at + 65_536]
                        count[p, q] = ~(keys[p, :table] == keys[q, :table]).any(1)
                root = np.full(len(rep), -1)
                for start in np.flatnonzero(near.any(1)):
                    if root[start] < 0:
                        root[start], front = start, np.array([start])
                        while len(front):
                            front = np.flatnonzero(near[front].any(0) & (root < 0))
                            root[front] = start
                linked = np.flatnonzero(root >= 0)
                ids.append(rep[linked])
                links.append((count * weight[None, :]).sum(1)[linked])
                roots.append(rep[root[linked]])
            flat = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (ids, links, roots)]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in flat], ["rep", "links", "root"])

    return groups.mapInArrow(run, "rep long, links long, root long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, miss: float = 1e-6, seed: int = 5) -> DataFrame:
    """``(id, n_links, component_id, kept)`` for every row of ``vectors``.

    Rows are linked when their labels are equal and not null and their cosine, in double precision, is at least ``threshold``.
    n_links counts the other rows linked directly. Rows with a null id or label, and vectors that are null, empty, zero or
    hold null or non-finite components link with nothing; so do vectors of different lengths. Vectors of any length are read whole. Equal vectors are one class
    with a weight. Rows that repeat an id and vector count as vectors of their own with that id. Other columns are
    ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "near-vectors")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))  # one zero
    takes_part = comparable(F.col("vector")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    classes = rows.filter(takes_part).groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    classes = scratch.keep(classes.select("rep", "label", "vector", "weight"), "classes")
    bits, tables = plan_tables(classes.count(), threshold, miss)
    keyed = scratch.keep(_keys(classes, bits, tables, seed), "keyed")

    places = keyed.select("rep", "label", F.size("vector").alias("d"), F.posexplode("keys").alias("table", "key"))
    sizes = places.groupBy("label", "d", "table", "key").agg(F.count("*").alias("size")).filter("size > 1")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = places.join(sizes.withColumn("blocks", blocks), ["label", "d", "table", "key"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("rep", "label", "d", "table", "key", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), (F.col("block") > F.col("with")).cast("int").alias("side"))
    full = placed.join(keyed.select("rep", "label", "vector", "weight", "keys"), ["rep", "label"]).filter(F.size("vector") == F.col("d"))
    groups = full.groupBy("label", "d", "table", "key", "p", "q").agg(F.collect_list(F.struct("rep", "vector", "weight", "keys", "side")).alias("group"))
    compared = scratch.keep(_compare(groups.select("table", "group"), threshold), "compared")
    component = connected_components(compared, "rep", "root", "near-vectors-components")

    summed = compared.groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = classes.select("label", "vector", "rep", "weight").join(summed, "rep", "left").join(component.select(F.col("id").alias("rep"), "component"), "rep", "left")
    per_class = per_class.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.withColumn("label", F.when(takes_part, F.col("label"))).join(per_class, ["label", "vector"], "left")
    component_id = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(True)).alias("kept"))


def op3_hyperplane_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The same by SQL: all pairs of a label, links followed to the smallest id.
ORACLES = {
    "op3_hyperplane_near_vectors": """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS i, b.vec_id AS j FROM g a JOIN g b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
e AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.j FROM r JOIN e ON r.b = e.i),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM e WHERE e.i = c.vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c""",
}
QUERIES = {"op3_hyperplane_near_vectors": op3_hyperplane_near_vectors}
