"""Near-duplicate decisions: components, their representatives, and what the choice of release does to them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shinglemill.functions import text as T
from shinglemill.functions.release import release
from shinglemill.operators import similarity as sim
from shinglemill.operators.components import connected_components
from shinglemill.scratch import Scratch


def labelled(docs: DataFrame, component: DataFrame) -> DataFrame:
    """``docs`` with their component; a document without an edge is its own."""
    return docs.join(component.select(F.col("id").alias("idx"), "component"), "idx", "left").withColumn("component", F.coalesce("component", "idx"))


def representatives(docs: DataFrame) -> DataFrame:
    """The documents that stand for their component: those of the smallest index."""
    return docs.filter("idx = component")


def class_components(classes: DataFrame, pairs: DataFrame, theta: float) -> DataFrame:
    """``(idx, component)`` from classes of equal sets and pairs of their representatives at ``theta``."""
    linked = connected_components(pairs.filter(F.col("jaccard") >= theta), "a", "b")
    return classes.join(linked.select(F.col("id").alias("rep"), "component"), "rep", "left").select("idx", F.coalesce("component", "rep").alias("component"))


def decide(docs: DataFrame, strategy: str = "RAW", theta: float = 0.7, n: int = 5, normaliser: str = "plain") -> tuple[DataFrame, DataFrame]:
    """``(membership, hits)``: ``(idx, case, is_copy, component)``, and ``(idx, hit)`` whether each copy reaches ``theta`` with its original."""
    words = Scratch(docs.sparkSession, "decide").keep(sim.shingle_words(docs, strategy, normaliser), "words")
    classes, pairs = sim.similar_classes(words, theta, n)
    component = class_components(classes, pairs, theta)
    membership = docs.select("idx", "case", "is_copy").join(component, "idx", "left").withColumn("component", F.coalesce("component", "idx"))
    hits = sim.known_pairs(docs, _paired_sets(docs, words, n)).select("idx", (F.col("jaccard") >= theta).alias("hit"))
    return membership, hits


def _paired_sets(docs: DataFrame, words: DataFrame, n: int) -> DataFrame:
    """``(idx, set)`` of copies and the originals that have one."""
    ids = docs.select("idx", "case").join(docs.filter("is_copy").select("case").distinct(), "case", "left_semi")
    return sim.sets_of_words(words.join(ids, "idx", "left_semi"), n)


def release_variants(docs: DataFrame, bodies: list, normaliser: str = "plain") -> DataFrame:
    """``(idx, mask, words)`` of the different texts among ``bodies``, the columns of a text under each setting: ``mask`` has the bits of the
    settings that give the text, and ``idx`` is that of the document times the number of settings, plus a number within the document. Most
    documents have nothing to replace, so one text serves all settings."""
    k = len(bodies)

    def distinct(texts):
        mask = lambda t: sum((F.when(F.get(texts, F.lit(s)).eqNullSafe(t), F.lit(1 << s)).otherwise(F.lit(0)).cast("long") for s in range(k)), F.lit(0).cast("long"))
        return F.transform(F.array_distinct(texts), lambda t, j: F.struct(j.alias("j"), mask(t).alias("mask"), t.alias("text")))

    found = docs.select("idx", F.explode(T.let(F.array(*bodies), distinct)).alias("v"))
    words = F.transform(T.NORMALISERS[normaliser](F.col("v.text")), lambda w: F.xxhash64(w))
    return found.select((F.col("idx") * k + F.col("v.j")).alias("idx"), F.col("v.mask").alias("mask"), words.alias("words"))


def decide_settings(docs: DataFrame, settings: dict, theta: float = 0.7, n: int = 5, normaliser: str = "plain") -> tuple[DataFrame, DataFrame]:
    """``decide`` for several ``settings``, names with the column of the released text: ``(membership, hits)`` with the column ``setting``. One
    join serves all of them: it compares the different texts of every document and notes the settings in which each counts."""
    k, names = len(settings), F.array(*map(F.lit, settings))
    if k > 62:
        raise ValueError("at most 62 settings")
    ends = docs.agg(F.min("idx").alias("low"), F.max("idx").alias("high")).first()
    if ends["low"] is not None and not -(1 << 63) // k < ends["low"] <= ends["high"] < (1 << 63) // k - 1:
        # Ids that leave no room for a number within the document: one setting after another.
        parts = [(name, decide(docs.withColumn("text", body), "RAW", theta, n, normaliser)) for name, body in settings.items()]
        named = [[part.withColumn("setting", F.lit(name)) for part in both] for name, both in parts]
        return tuple(reduce(DataFrame.unionByName, side) for side in zip(*named))
    scratch = Scratch(docs.sparkSession, "decide")
    bodies = list(settings.values())
    classes, pairs = sim.similar_classes(release_variants(docs, bodies, normaliser), theta, n)
    each = lambda mask: F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.bit_get(mask, s) == 1))
    document = F.expr(f"(idx - pmod(idx, {k})) div {k}").alias("idx")
    # Links in each setting, and the smallest document of each component in it: a class may have members in some settings only.
    of = lambda x: classes.filter("idx = rep").select(F.col("idx").alias(x), F.col("settings").alias(f"s{x}"))
    edges = pairs.filter(F.col("jaccard") >= theta).select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", each(F.col("sa").bitwiseAND(F.col("sb"))).alias("s"))
    node = lambda x: F.struct("s", F.col(x).alias("rep"))
    linked = connected_components(edges.select(node("a").alias("src"), node("b").alias("dst"))).select("id.s", "id.rep", F.col("component.rep").alias("root"))
    members = classes.select(document, "rep", each(F.col("mask")).alias("s"))
    roots = members.groupBy("s", "rep").agg(F.min("idx").alias("low")).join(linked, ["s", "rep"], "left").withColumn("root", F.coalesce("root", "rep"))
    roots = scratch.keep(roots, "roots")
    lows = roots.groupBy("s", "root").agg(F.min("low").alias("component"))
    component = members.join(roots.join(lows, ["s", "root"]).select("s", "rep", "component"), ["s", "rep"]).select("s", "idx", "component")
    own = docs.select("idx", "case", "is_copy", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("s"))
    membership = own.join(component, ["s", "idx"], "left").select(F.get(names, F.col("s")).alias("setting"), "idx", "case", "is_copy", F.coalesce("component", "idx").alias("component"))
    # Copies and their originals, in all different texts.
    cases = docs.filter("is_copy").select("case").distinct()
    chosen = docs.join(F.broadcast(cases) if cases.count() <= sim.BROADCAST_IDS else cases, "case", "left_semi")
    sets = sim.sets_of_words(release_variants(chosen, bodies, normaliser), n).select(document, "mask", "set")
    both = chosen.select("idx", "case", "is_copy").join(sets, "idx")
    first = both.filter("not is_copy").select("case", F.col("mask").alias("mo"), F.col("set").alias("so"))
    met = both.filter("is_copy").join(first, "case").filter("(mask & mo) <> 0")
    scored = met.select("idx", F.col("mask").bitwiseAND(F.col("mo")).alias("common"), (T.jaccard(F.col("so"), F.col("set")) >= theta).alias("hit"))
    return membership, scored.select(each(F.col("common")).alias("s"), "idx", "hit").select(F.get(names, F.col("s")).alias("setting"), "idx", "hit")


def theta_sweep(docs: DataFrame, thetas: list[float], strategy: str = "RAW", n: int = 5, normaliser: str = "plain") -> DataFrame:
    """``(theta, idx, case, is_copy, component, hit)``: similarity is computed once, at the smallest theta."""
    scratch = Scratch(docs.sparkSession, "sweep")
    words = scratch.keep(sim.shingle_words(docs, strategy, normaliser), "words")
    classes, pairs = sim.similar_classes(words, min(thetas), n)
    known = scratch.keep(sim.known_pairs(docs, _paired_sets(docs, words, n)).select("idx", "jaccard"), "known")
    out = None
    for theta in thetas:
        component = class_components(classes, pairs, theta)
        one = docs.select("idx", "case", "is_copy").join(component, "idx", "left").join(known, "idx", "left").select(F.lit(theta).alias("theta"), "idx", "case", "is_copy", F.coalesce("component", "idx").alias("component"), (F.col("jaccard") >= theta).alias("hit"))
        out = one if out is None else out.unionByName(one)
    return out


def minhash_decision(docs: DataFrame, signatures: DataFrame, banding: str = "14x8") -> DataFrame:
    """``(idx, case, is_copy, component)`` from the buckets of a banding; candidates aren't verified. ``signatures`` of one seed
    serve all bandings."""
    count, rows = T.BANDINGS[banding]
    bands = signatures.select("idx", F.posexplode(T.bands(F.col("signature"), count, rows)).alias("band", "key"))
    return labelled(docs.select("idx", "case", "is_copy"), connected_components(sim.band_stars(bands)))


def minhash_decisions(signatures: DataFrame, bandings: tuple) -> DataFrame:
    """``(setting, banding, idx, component)`` of the documents with a link, for every banding over ``signatures (setting, idx, signature)``: the settings are part of
    the node, so one run of the components serves all of them."""
    hashed = lambda count, rows: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.xxhash64(F.slice("signature", i * rows + 1, F.lit(rows))))
    keys = signatures.select("setting", "idx", F.concat(*(hashed(*T.BANDINGS[b]) for b in bandings)).alias("keys"))
    return banding_decisions(Scratch(signatures.sparkSession, "bandings").keep(keys, "keys"), bandings)


def banding_decisions(keys: DataFrame, bandings: tuple) -> DataFrame:
    """The same from ``sim.band_keys`` of the ``bandings``, which should be a written table. Buckets are formed for one setting after another,
    and only the links of their members with their smallest ones are written."""
    spark = keys.sparkSession
    scratch = Scratch(spark, "bandings")
    ends, end = [], 0
    for b in bandings:
        end += T.BANDINGS[b][0]
        ends.append(end)
    banding = reduce(lambda other, i: F.when(F.col("band") < ends[i], F.lit(i)).otherwise(other), reversed(range(len(bandings))), F.lit(None).cast("int"))
    stars = None
    for setting in sorted(r["setting"] for r in keys.select("setting").distinct().collect()):
        bands = keys.filter(F.col("setting") == setting).select("idx", F.posexplode("keys").alias("band", "key"))
        low = bands.groupBy("band", "key").agg(F.min("idx").alias("src"), F.max("idx").alias("top")).filter("src < top").drop("top")
        linked = bands.join(low, ["band", "key"]).filter("idx > src").select(F.lit(setting).alias("setting"), banding.alias("banding"), "src", "idx").distinct()
        linked = scratch.keep(linked, f"stars-{setting}")
        stars = linked if stars is None else stars.unionByName(linked)
        sim.free_shuffles(spark)
    names = F.array(*map(F.lit, bandings))
    if stars is None:
        return keys.select("setting", F.lit("").alias("banding"), "idx", F.col("idx").alias("component")).limit(0)
    node = lambda c: F.struct("setting", "banding", F.col(c).alias("id"))
    linked = connected_components(stars.select(node("src").alias("src"), node("idx").alias("dst")))
    return linked.select("id.setting", F.get(names, F.col("id.banding")).alias("banding"), F.col("id.id").alias("idx"), F.col("component.id").alias("component"))


def union_partition(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(id, component)`` of documents that meet in either of two partitions ``(idx, component)``."""
    return connected_components(first.select("idx", "component").unionByName(second.select("idx", "component")), "idx", "component")


def removed(membership: DataFrame) -> DataFrame:
    return membership.filter("idx <> component").select("idx")


def removed_difference(first: DataFrame, second: DataFrame, docs: DataFrame) -> DataFrame:
    """What two settings remove alone and together: documents, their median words."""
    both = removed(first).withColumn("f", F.lit(True)).join(removed(second).withColumn("s", F.lit(True)), "idx", "full_outer")
    side = F.when(F.col("f") & F.col("s"), "both").when(F.col("f"), "first_only").otherwise("second_only")
    words = docs.select("idx", F.size(T.tokens(F.col("text"))).alias("words"))
    return both.select("idx", side.alias("removed_by")).join(words, "idx").groupBy("removed_by").agg(F.count("*").alias("documents"), F.median("words").alias("median_words"))


def paragraph_dedup(docs: DataFrame, strategy: str = "RAW", min_words: int = 0) -> DataFrame:
    """``(idx, pos, words, removed)`` of the paragraphs of originals: equal word sequences are kept where they occur first."""
    body = release(F.col("text"), F.col("spans"), strategy, F.col("key"), F.col("case")) if strategy != "RAW" else F.col("text")
    parts = docs.filter("not is_copy").select("idx", F.posexplode(F.split(body, r"\n+")).alias("pos", "p"))
    worded = parts.select("idx", "pos", T.tokens(F.col("p")).alias("w")).select("idx", "pos", F.size("w").alias("words"), F.sha2(F.array_join("w", " "), 256).alias("h")).filter(F.col("words") >= max(1, min_words))
    worded = Scratch(docs.sparkSession, "paragraphs").keep(worded, "paragraphs")
    first = worded.groupBy("h").agg(F.min(F.struct("idx", "pos")).alias("first"))
    return worded.join(first, "h").select("idx", "pos", "words", (F.struct("idx", "pos") != F.col("first")).alias("removed"))


def first_in_group(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_r", rank).filter("_r = 1").drop("_r")
