"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds its distinct word shingles. ``collections`` A-keys and as many B-keys, each of ``rows`` minhashes, are
combined pairwise into ``collections ** 2`` table keys of ``2 * rows`` minhashes: 49 tables from 28 minhashes by default, where
plain banding computes 196. Two sets of similarity s meet in a table with probability (1 - (1 - s ** rows) ** collections) ** 2,
which is 0.998 at 0.8, 0.9997 at 0.85 and 0.99998 at 0.9.

Equal sets are one class, so copies cost nothing beyond their sketch. Candidates are verified on full sets of words, never on
sketches, in two rounds: each class with the nearest of the smallest members of its buckets; then, in the buckets whose
members aren't yet in one component, every pair from different components that a 1024-bit parity map doesn't rule out. The
map gives a lower bound of the symmetric difference, so it loses no link. Large buckets are compared in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shinglemill.llm.memory import collect_garbage, small_batches, trimmed
from shinglemill.operators.components import connected_components
from shinglemill.scratch import Scratch

#: Members of a bucket that are compared in one task; larger buckets are cut into pairs of blocks.
BLOCK = 2_048
#: Ids of candidates are broadcast to the scan of texts up to this many (16 bytes each), beyond it joined.
BROADCAST_IDS = 1_000_000
_BITS, _MEMO = 1_024, 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SCHEMA = "doc_id long, tfp long, n long, hi long, lo long, a array<long>, b array<long>, bits array<long>"


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def exact_set(text: str, width: int) -> set:
    words = words_of(text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width))))


class _Hashes(dict):
    def __missing__(self, word):
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < _MEMO:
            self[word] = value
        return value


def _mix(x, seed: int):
    x = (x ^ np.uint64(seed)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: list[bytes], width: int, memo: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than ``width`` are one shingle, none are none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    width = min(width, n)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = (out ^ h[k : n - width + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(_mix(out, 0x5851F42D4C957F2D))


class Sketcher:
    def __init__(self, width: int, collections: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.width, self.collections, self.rows = width, collections, rows
        self.flip = rng.integers(0, 2**63, (2 * collections * rows, 1), dtype=np.uint64)
        self.times = rng.integers(0, 2**63, (2 * collections * rows, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, text: str | None, memo: dict) -> tuple:
        s = shingle_hashes(words_of(text or ""), self.width, memo)
        if not len(s):
            return 0, 0, 0, None, None, None
        low = np.full(len(self.flip), 2**64 - 1, np.uint64)
        for at in range(0, len(s), 16_384):  # bounded memory for texts of any length
            part = (s[at : at + 16_384] ^ self.flip) * self.times
            low = np.minimum(low, part.min(1))
        halves = low.reshape(2, self.collections, self.rows)
        key = np.zeros((2, self.collections), np.uint64)
        for r in range(self.rows):
            key = _mix(key ^ halves[:, :, r], 0x1234567 + r)
        odd = np.bincount((s >> np.uint64(20)).astype(np.int64) & (_BITS - 1), minlength=_BITS) & 1
        bits = np.packbits(odd.astype(np.uint8)).view(np.int64)
        hi, lo = np.bitwise_xor.reduce(_mix(s, 0xABCDEF)), _mix(s, 0x1337).sum(dtype=np.uint64)
        return len(s), int(hi.view(np.int64)), int(lo.view(np.int64)), key[0].view(np.int64), key[1].view(np.int64), bits


def _sketches(docs: DataFrame, sketcher: Sketcher) -> DataFrame:
    """The sketch of every row, with a number of its own; the numbers hold once the table is written."""

    def run(batches):
        memo = _Hashes()
        for batch in batches:
            ids, prints, texts = batch.columns
            with np.errstate(over="ignore"):
                rows = [sketcher(t.as_py(), memo) for t in texts]
            columns = list(zip(*rows)) if rows else [[]] * 6
            types = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([ids, prints, *(pa.array(c, t) for c, t in zip(columns, types))], ["doc_id", "tfp", "n", "hi", "lo", "a", "b", "bits"])

    return docs.mapInArrow(trimmed(run), _SCHEMA).withColumn("row", F.monotonically_increasing_id())


def _verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Of ``(x, y)`` those whose full sets are linked. Texts are fetched for candidates only."""
    ids = pairs.select(F.col("x").alias("id")).unionByName(pairs.select(F.col("y").alias("id"))).distinct()
    ids = scratch.keep(ids.join(scratch.reps.select(F.col("rep").alias("id"), "doc", F.col("tfp").alias("print")), "id"), f"{name}-ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.join(side, (F.col("doc_id") == F.col("doc")) & (F.col("tfp") == F.col("print"))).select("id", "text")
    texts = scratch.keep(texts.groupBy("id").agg(F.min("text").alias("text")), f"{name}-texts")
    joined = pairs.join(texts.select(F.col("id").alias("x"), F.col("text").alias("tx")), "x").join(texts.select(F.col("id").alias("y"), F.col("text").alias("ty")), "y")

    def run(batches):
        last: dict = {}

        def sets(key, text):
            if key not in last:
                if len(last) >= 8:
                    last.pop(next(iter(last)))
                last[key] = exact_set(text, width)
            return last[key]

        for batch in batches:
            found = []
            for x, y, tx, ty in zip(*(c.to_pylist() for c in batch.columns)):
                p, q = sets(x, tx), sets(y, ty)
                both = len(p & q)
                if both and 100 * both >= percent * (len(p) + len(q) - both):
                    found.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["x", "y"])

    return scratch.keep(joined.select("x", "y", "tx", "ty").mapInArrow(trimmed(run), "x long, y long"), f"{name}-links")


def _apart(members: DataFrame, percent: int, collections: int) -> DataFrame:
    """Pairs of one bucket's block pair that are in different components and that sizes and parity maps allow, each from the first
    table in which they meet. members: ``table``, and ``group``: array of (rep, label, n, bits, a, b, side), side 0 for the first
    block, 1 for the second; equal blocks have side 0 only."""

    def run(batches):
        for batch in batches:
            xs, ys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for table, group in zip(batch.column("table").to_pylist(), batch.column("group")):
                v = group.values
                a, b = (v.field(f).flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) for f in ("a", "b"))
                rep, label, n, side = (v.field(f).to_numpy(zero_copy_only=False) for f in ("rep", "label", "n", "side"))
                maps = v.field("bits").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(rep), -1)
                first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                within = not len(second)
                second = first if within else second
                for at in range(0, len(first), 64):
                    rows = first[at : at + 64]
                    differ = np.bitwise_count(maps[rows, None] ^ maps[None, second]).sum(2, dtype=np.int64)
                    may = (100 - percent) * (n[rows, None] + n[None, second]) >= (100 + percent) * differ
                    may &= label[rows, None] != label[None, second]
                    may &= 100 * np.minimum(n[rows, None], n[None, second]) >= percent * np.maximum(n[rows, None], n[None, second])
                    i, j = np.nonzero(may)
                    i, j = rows[i], second[j]
                    here = (a[i] == a[j]).argmax(1) * collections + (b[i] == b[j]).argmax(1) == table
                    x, y = rep[i[here]], rep[j[here]]
                    xs.append(np.minimum(x, y))
                    ys.append(np.maximum(x, y))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], ["x", "y"])

    return members.mapInArrow(trimmed(run), "x long, y long").distinct()


def _documents_of(links: DataFrame, reps: DataFrame) -> DataFrame:
    """Links of classes as links of their smallest ids."""
    of = lambda x, u: reps.select(F.col("rep").alias(x), F.col("doc").alias(u))
    return links.join(of("x", "u"), "x").join(of("y", "v"), "y").select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, collections: int = 7, rows: int = 2, seed: int = 11) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets. component_id is the smallest id
    reachable over links, kept tells whether it is the row's own. A null or empty text, or one of white space, has an
    empty set and is linked with nothing. A row with a null id is linked with nothing, has no component and is kept. Rows
    that repeat an id are one document, linked with all that one of its texts is linked with. Texts of any length are read
    whole; their minhashes are taken in blocks. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    collect_garbage(spark)
    scratch = Scratch(spark, "near-duplicates")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("tfp"), F.col(text).alias("text"))
    sketches = scratch.keep(_sketches(docs, Sketcher(words, collections, rows, seed)), "sketches")
    known = sketches.filter("n > 0 and doc_id is not null")
    reps = known.groupBy("hi", "lo", "n").agg(F.min(F.struct("doc_id", "row", "tfp")).alias("r"), *(F.first(c).alias(c) for c in ("a", "b", "bits")))
    reps = scratch.reps = scratch.keep(reps.select("hi", "lo", "n", F.col("r.row").alias("rep"), F.col("r.doc_id").alias("doc"), F.col("r.tfp").alias("tfp"), "a", "b", "bits"), "reps")
    same = _repeated_ids(known, reps, scratch)

    keys = reps.select("rep", F.posexplode("a").alias("i", "x"), "b").select("rep", "i", "x", F.posexplode("b").alias("j", "y"))
    keys = keys.select("rep", F.xxhash64("i", "j", "x", "y").alias("key"), (F.col("i") * collections + F.col("j")).cast("smallint").alias("table"))
    pivots = keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("other")).filter("pivot < other").drop("other")
    members = scratch.keep(keys.join(pivots, "key"), "members")

    maps = reps.select("rep", "n", "bits")
    differ = F.aggregate(F.zip_with("bits", "bits2", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    stars = members.filter("rep <> pivot").select("rep", "pivot").distinct().join(maps, "rep").join(maps.select(F.col("rep").alias("pivot"), F.col("n").alias("n2"), F.col("bits").alias("bits2")), "pivot")
    stars = stars.select("rep", "pivot", (F.col("n") + F.col("n2")).alias("sum"), differ.alias("differ")).filter((100 - percent) * F.col("sum") >= (100 + percent) * F.col("differ"))
    nearest = stars.groupBy("rep").agg(F.min_by("pivot", F.struct(F.col("differ") / F.col("sum"), "pivot")).alias("pivot"))
    first = _verify(scratch.keep(nearest.select(F.col("pivot").alias("x"), F.col("rep").alias("y")), "first"), docs, words, percent, scratch, "first")
    first = scratch.keep(_documents_of(first, reps), "first-documents")
    label = connected_components(first, "u", "v", "near-duplicates-first").select(F.col("id").alias("doc"), "component")
    label = reps.select("rep", "doc").join(label, "doc", "left").select("rep", F.coalesce("component", "doc").alias("label"))

    labelled = scratch.keep(members.select("key", "rep", "table").join(label, "rep"), "labelled")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count("*").alias("size"), F.bit_xor(F.xxhash64("rep")).alias("same"), F.min("table").alias("table")).filter("l < m")
    # Tables often repeat a bucket: the first of them stands for all, as its pairs can't have met earlier in another of them.
    mixed = mixed.groupBy("same", "size").agg(F.min(F.struct("table", "key")).alias("k")).select("size", "k.table", "k.key")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = labelled.drop("table").join(mixed.select("key", "table", blocks.alias("blocks")), "key").withColumn("block", block)
    placed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("key", "table", "rep", "label", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"), (F.col("block") > F.col("with")).cast("int").alias("side"))
    grouped = placed.join(reps.select("rep", "n", "bits", "a", "b"), "rep").groupBy("key", "table", "p", "q")
    grouped = grouped.agg(F.collect_list(F.struct("rep", "label", "n", "bits", "a", "b", "side")).alias("group")).select("table", "group")
    second = _verify(scratch.keep(_apart(grouped, percent, collections), "second"), docs, words, percent, scratch, "second")
    links = first.unionByName(_documents_of(second, reps)).unionByName(same)
    component = connected_components(links, "u", "v", "near-duplicates-last")

    classes = reps.select("hi", "lo", "n", "doc").join(component.select(F.col("id").alias("doc"), "component"), "doc", "left").select("hi", "lo", "n", F.coalesce("component", "doc").alias("component"))
    out = sketches.select("doc_id", "n", "hi", "lo").join(classes, ["hi", "lo", "n"], "left")
    component_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    scratch.drop("members", "labelled", "first", "second", "first-texts", "second-texts")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"))


def _repeated_ids(known: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """``(u, v)``: ids that repeat with different sets, and the smallest id of each of these sets."""
    one = F.xxhash64("hi", "lo", "n")
    ids = known.groupBy("doc_id").agg(F.min(one).alias("least"), F.max(one).alias("most")).filter("least < most").select("doc_id")
    ids = scratch.keep(ids, "repeated")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = known.select("doc_id", "hi", "lo", "n").join(side, "doc_id").distinct()
    return sets.join(reps.select("hi", "lo", "n", "doc"), ["hi", "lo", "n"]).select(F.col("doc_id").alias("u"), F.col("doc").alias("v"))


def op1_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)


#: The same by SQL: shingles met in an inverted index, links followed to the smallest id.
ORACLES = {
    "op1_minhash_near_duplicates": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - 3) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.j FROM r JOIN e ON r.b = e.i),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""",
}
QUERIES = {"op1_minhash_near_duplicates": op1_minhash_near_duplicates}
