"""Approximate nearest neighbours with a hierarchical k-means tree and best-bin-first search.

The tree is fitted on a bounded sample of distinct vectors; every vector is then filed under the leaf that a descent to the
nearest child reaches. A query keeps its open nodes in a priority queue by distance to their centres and visits leaves in the
order in which they come up. How many it visits is calibrated: for a sample of queries the true neighbours are found by
brute force over all vectors, and visits are widened until the share of them in visited leaves reaches ``recall``.

Equal vectors are one candidate that keeps its smallest ids, more of which no result can hold, so copies don't crowd a leaf.
Leaves and their queries meet in blocks of bounded size. Vectors of different lengths have no distance, so each length has a
tree of its own.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shinglemill.llm.memory import ship, unship
from shinglemill.llm.vectors import comparable
from shinglemill.scratch import Scratch

#: Candidates, and queries, in a block.
BLOCK, QUERY_BLOCK = 4_096, 512
#: Numbers of the sample that trees are fitted on; it has fewer vectors where they are long.
SAMPLE_NUMBERS = 1 << 23


class KMeansTree:
    def __init__(self, x: np.ndarray, leaf_points: int, branching: int = 8, rounds: int = 8, seed: int = 9):
        self.centres, self.children, self.leaf = [x.mean(0) if len(x) else np.zeros(x.shape[1])], [[]], [-1]
        self.leaves = 0
        rng = np.random.default_rng(seed)
        stack = [(0, x)]
        while stack:
            node, points = stack.pop()
            parts = self._split(points, branching, rounds, rng) if len(points) > leaf_points else []
            if len(parts) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for centre, part in parts:
                self.children[node].append(len(self.centres))
                self.centres.append(centre)
                self.children.append([])
                self.leaf.append(-1)
                stack.append((len(self.centres) - 1, part))
        self.child_centres = [np.array([self.centres[c] for c in kids]) for kids in self.children]

    @staticmethod
    def _split(x, k, rounds, rng):
        centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(rounds):
            nearest = _squares(x, centres).argmin(1)
            centres = np.array([x[nearest == i].mean(0) if (nearest == i).any() else centres[i] for i in range(len(centres))])
        nearest = _squares(x, centres).argmin(1)
        return [(centres[i], x[nearest == i]) for i in range(len(centres)) if (nearest == i).any()]

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of ``x``."""
        out = np.empty(len(x), np.int32)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                nearest = _squares(x[rows], self.child_centres[node]).argmin(1)
                stack += [(kid, rows[nearest == i]) for i, kid in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray, most: int, sizes: dict | None = None, least: int = 0) -> list[int]:
        """The first ``most`` leaves, best bin first, and more until they hold ``least`` rows by ``sizes``."""
        queue, found, held = [(0.0, 0)], [], 0
        while queue and (len(found) < most or held < least):
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                found.append(self.leaf[node])
                held += sizes.get(self.leaf[node], 0) if sizes else 0
                continue
            for d, kid in zip(((self.child_centres[node] - q) ** 2).sum(1).tolist(), self.children[node]):
                heapq.heappush(queue, (d, kid))
        return found


class Forest:
    """A tree for each length of vectors, with leaves numbered through."""

    def __init__(self, samples: dict[int, np.ndarray], leaf_points: dict[int, int]):
        self.trees, self.first, self.leaves = {}, {}, 0
        for d in sorted(samples):
            self.trees[d], self.first[d] = KMeansTree(samples[d], leaf_points[d]), self.leaves
            self.leaves += self.trees[d].leaves

    def file(self, x: np.ndarray) -> np.ndarray:
        return self.trees[x.shape[1]].file(x) + self.first[x.shape[1]]

    def visits(self, q: np.ndarray, most: int, sizes: dict | None = None, least: int = 0) -> list[int]:
        first = self.first[len(q)]
        own = {leaf - first: n for leaf, n in sizes.items()} if sizes and first else sizes
        return [first + leaf for leaf in self.trees[len(q)].visits(q, most, own, least)]


def _squares(x, y):
    return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None]


def nearest_rows(queries: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """For each query the positions in ``x`` and exact distances of the k nearest, ties to smaller ids."""
    near = _squares(queries, x)
    size = (x * x).sum(1).max(initial=0) + (queries * queries).sum(1)
    kth = np.partition(near, min(k, len(x)) - 1, 1)[:, min(k, len(x)) - 1] + 1e-9 * size
    for q, row, bound in zip(queries, near, kth):
        some = np.flatnonzero(row <= bound)
        exact = np.sqrt(((x[some] - q) ** 2).sum(1))
        order = np.lexsort((ids[some], exact))[:k]
        yield some[order], exact[order]


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _by_length(column):
    """``(rows, matrix)`` of every length among a column's vectors."""
    offsets = np.asarray(column.offsets)
    sizes, flat = np.diff(offsets), np.asarray(column.values)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[offsets[rows][:, None] + np.arange(d)]


def search(vectors: DataFrame, queries, k: int = 10, recall: float = 0.97, id_col: str = "vec_id", vector: str = "embedding", sample: int = 50_000, calibration: int = 200, seed: int = 3) -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` nearest rows found for every row that the condition ``queries`` picks.

    score is the Euclidean distance in double precision on the vectors as given; ties go to the smaller id. A query's
    own id is no candidate; with fewer candidates all are returned. A query whose leaves hold too few goes on to further ones.
    Candidates have the query's length. Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite
    components take no part. Rows that repeat id and vector count once. Other columns are ignored. An empty table, or one
    without queries, gives no rows. ``sample`` bounds the vectors that trees are fitted on, fewer where they are very long.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), queries.alias("asks"))
    rows = rows.filter(comparable(F.col("vector")) & F.col("id").isNotNull())
    rows = rows.select("id", F.transform("vector", lambda x: x + F.lit(0.0)).alias("vector"), F.coalesce("asks", F.lit(False)).alias("asks")).distinct()
    rows = scratch.keep(rows, "rows")

    ordered = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    few = rows.withColumn("r", ordered).filter(F.col("r") <= k + 1)  # limited before the shuffle as well
    classes = few.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("cid"), "vector", "ids")
    classes = scratch.keep(classes, "classes")

    draw = F.xxhash64("cid", F.lit(seed))
    counts = {r["d"]: r["count"] for r in classes.groupBy(F.size("vector").alias("d")).count().collect()}  # a row for each length
    n = sum(counts.values())
    sample = min(sample, max(1_000, SAMPLE_NUMBERS * max(n, 1) // max(1, sum(d * c for d, c in counts.items()))))
    picked = classes.filter(draw / float(1 << 63) < 2 * min(1.0, 1.1 * sample / max(n, 1)) - 1).orderBy(draw, "cid").select("vector").limit(sample)
    picked = picked.toArrow()["vector"].combine_chunks()
    samples = {d: np.empty((0, d)) for d in counts} | {x.shape[1]: x for _, x in _by_length(picked)}
    # About sqrt(n) / 2 leaves balance what a query spends on choosing leaves and on scanning them.
    tree = Forest(samples, {d: max(16, math.ceil(2 * len(samples[d]) / math.sqrt(c))) for d, c in counts.items()})
    del picked, samples
    shared = ship(spark, tree)

    def file(batches):
        forest = unship(shared)
        for batch in batches:
            leaf = np.empty(batch.num_rows, np.int32)
            for at, x in _by_length(batch.column("vector")):
                leaf[at] = forest.file(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    filed = scratch.keep(classes.select("cid", "vector").mapInArrow(file, "cid long, vector array<double>, leaf int"), "filed")
    asking = scratch.keep(rows.filter("asks").select(F.col("id").alias("query_id"), "vector").join(classes.select("vector", "cid"), "vector"), "asking")
    ask_classes = asking.groupBy("cid").agg(F.first("vector").alias("vector"))
    visits = _calibrate(filed, ask_classes, tree, k, recall, calibration, seed)

    held = {r["leaf"]: r["count"] for r in filed.groupBy("leaf").count().collect()}  # as many as the tree has leaves

    def bins(batches):
        forest = unship(shared)
        for batch in batches:
            found = [None] * batch.num_rows
            for at, x in _by_length(batch.column("vector")):
                for i, q in zip(at.tolist(), x):
                    found[i] = forest.visits(q, visits, held, k + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], [*batch.schema.names, "leaves"])

    visited = ask_classes.mapInArrow(bins, "cid long, vector array<double>, leaves array<int>").select("cid", "vector", F.explode("leaves").alias("leaf"))
    visited = scratch.keep(visited, "visited")
    block = lambda name, size: F.pmod(F.xxhash64("cid"), F.ceil(F.col("n") / size)).cast("int").alias(name)
    leaf_sizes, ask_sizes = filed.groupBy("leaf").agg(F.count("*").alias("n")), visited.groupBy("leaf").agg(F.count("*").alias("n"))
    asked = visited.join(F.broadcast(ask_sizes), "leaf").groupBy("leaf", block("part", QUERY_BLOCK)).agg(F.collect_list(F.struct("cid", "vector")).alias("asked"))
    blocks = filed.join(F.broadcast(leaf_sizes), "leaf").groupBy("leaf", block("block", BLOCK)).agg(F.collect_list(F.struct("cid", "vector")).alias("held"))
    best = _top(blocks.join(asked, "leaf").select("asked", "held"), k + 1)
    near = Window.partitionBy("asking").orderBy("score", "cid")
    best = best.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1)
    expanded = best.join(classes.select("cid", "ids"), "cid").select("asking", "score", F.explode("ids").alias("id"))
    expanded = expanded.withColumn("r", F.row_number().over(Window.partitionBy("asking").orderBy("score", "id"))).filter(F.col("r") <= k + 1)
    answers = asking.select("query_id", F.col("cid").alias("asking")).join(expanded, "asking").filter("id <> query_id")
    answers = answers.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).filter(F.col("rank") <= k)
    return answers.select("query_id", "rank", F.col("id").alias(id_col), "score")


#: Queries whose best candidates a task holds before it passes them on.
_HELD = 20_000


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """``(asking, cid, score)``: of all blocks that a task compares the k best of each query."""

    def run(batches):
        best: dict[int, list] = {}

        def flush():
            rows = [(q, c, d) for q, mine in best.items() for d, c in mine]
            best.clear()
            flat = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int64()), pa.array(flat[2], pa.float64())], ["asking", "cid", "score"])

        for batch in batches:
            for asked, held in zip(batch.column("asked"), batch.column("held")):
                qs, hs = asked.values, held.values
                cids = hs.field("cid").to_numpy()
                for q, (at, dist) in zip(qs.field("cid").to_pylist(), nearest_rows(_matrix(qs.field("vector")), _matrix(hs.field("vector")), cids, k)):
                    found = list(zip(dist.tolist(), cids[at].tolist()))
                    best[q] = heapq.nsmallest(k, best[q] + found) if q in best else found
                if len(best) >= _HELD:
                    yield flush()
        yield flush()

    return pairs.mapInArrow(run, "asking long, cid long, score double")


def _calibrate(filed: DataFrame, ask_classes: DataFrame, tree: Forest, k: int, recall: float, calibration: int, seed: int) -> int:
    """The least number of leaves whose visit finds the share ``recall`` of the true neighbours of some queries."""
    probes = ask_classes.orderBy(F.xxhash64("cid", F.lit(seed + 1)), "cid").limit(calibration).collect()
    if not probes:
        return 1
    own = np.array([r["cid"] for r in probes])
    q = [np.array(r["vector"], np.float64) for r in probes]
    alike = {d: [i for i, v in enumerate(q) if len(v) == d] for d in map(len, q)}
    stacked = {d: np.array([q[i] for i in which]) for d, which in alike.items()}

    def brute(batches):
        best: list = [[] for _ in own]
        for batch in batches:
            cids, leaves = batch.column("cid").to_numpy(), batch.column("leaf").to_numpy()
            for rows, x in _by_length(batch.column("vector")):
                d = x.shape[1]
                if d not in alike:
                    continue
                for i, (at, dist) in zip(alike[d], nearest_rows(stacked[d], x, cids[rows], k + 1)):
                    best[i] += zip(dist.tolist(), cids[rows][at].tolist(), leaves[rows][at].tolist())
                    best[i].sort()
                    del best[i][k + 1 :]
        flat = [(i, *hit) for i, mine in enumerate(best) for hit in mine]
        types = [pa.int32(), pa.float64(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in flat], t) for j, t in enumerate(types)], ["probe", "score", "cid", "leaf"])

    hits = filed.mapInArrow(brute, "probe int, score double, cid long, leaf int")
    top = hits.withColumn("r", F.row_number().over(Window.partitionBy("probe").orderBy("score", "cid"))).filter(F.col("r") <= k + 1).collect()
    order = [{leaf: i for i, leaf in enumerate(tree.visits(v, tree.leaves), 1)} for v in q]
    ranks = np.sort([order[r["probe"]][r["leaf"]] for r in top if r["cid"] != own[r["probe"]]])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) if len(ranks) else 1


def op8_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


QUERIES = {"op8_kmeans_tree_search": op8_kmeans_tree_search}
