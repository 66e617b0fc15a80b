"""Outcome measures of decisions and releases, each as a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shinglemill.functions import spans as S
from shinglemill.functions import text as T
from shinglemill.functions.release import mention_releases, release
from shinglemill.operators.similarity import release_shingles
from shinglemill.scratch import Scratch

EPS = 1e-9


def _ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def validate_membership(membership: DataFrame) -> DataFrame:
    """Rows ``(problem, n)`` for what a membership table must not have: two originals of a case, copies without an original,
    components that aren't their own representative."""
    own = membership.filter("not is_copy")
    twice = own.groupBy("case").count().filter("count > 1").agg(F.count("*").alias("n")).select(F.lit("original cases must be unique").alias("problem"), "n")
    orphan = membership.filter("is_copy").join(own.select("case"), "case", "left_anti").agg(F.count("*").alias("n")).select(F.lit("every copy needs its original").alias("problem"), "n")
    roots = membership.filter("idx = component").select(F.col("idx").alias("component"))
    loose = membership.join(roots, "component", "left_anti").agg(F.count("*").alias("n")).select(F.lit("components must be representatives").alias("problem"), "n")
    return twice.unionByName(orphan).unionByName(loose).filter("n > 0")


def copies_detected(membership: DataFrame) -> DataFrame:
    """``(idx, case, detected)``: whether a copy is in its original's component."""
    first = membership.filter("not is_copy").select("case", F.col("component").alias("root"))
    return membership.filter("is_copy").join(first, "case").select("idx", "case", (F.col("component") == F.col("root")).alias("detected"))


def lost_cases(membership: DataFrame) -> DataFrame:
    """Cases none of whose documents is kept; a kept copy preserves its case."""
    kept = membership.filter("idx = component").select("case")
    return membership.select("case").distinct().join(kept, "case", "left_anti")


def residual_copies(membership: DataFrame) -> DataFrame:
    """Copies whose case keeps two documents or more."""
    many = membership.filter("idx = component").groupBy("case").count().filter("count >= 2")
    return membership.filter("is_copy").join(many, "case", "left_semi").select("idx", "case")


def score_membership(membership: DataFrame, hits: DataFrame) -> DataFrame:
    """``(copies, pipeline_recall, pair_recall, lost, residual, kept)`` in a row; recalls are null without copies."""
    share = lambda df, c: df.agg(F.count("*").alias("n"), F.avg(F.col(c).cast("double")).alias("share"))
    d, h = share(copies_detected(membership), "detected").first(), share(hits, "hit").first()
    lost, residual, kept = lost_cases(membership).count(), residual_copies(membership).count(), membership.filter("idx = component").count()
    return membership.sparkSession.createDataFrame([(d["n"], d["share"], h["share"], lost, residual, kept)], "copies long, pipeline_recall double, pair_recall double, lost long, residual long, kept long")


def false_merges(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(pairs, cases)``: pairs ``(i, j)`` of different cases, and the cases in them."""
    of = lambda x: docs.select(F.col("idx").alias(x), F.col("case").alias(f"c{x}"))
    bad = pairs.join(of("i"), "i").join(of("j"), "j").filter("ci <> cj")
    return bad.select(F.struct("i", "j").alias("pair"), F.explode(F.array("ci", "cj")).alias("case")).agg(F.countDistinct("pair").alias("pairs"), F.countDistinct("case").alias("cases"))


def mention_items(docs: DataFrame, strategy: str, only_type: str | None = None) -> DataFrame:
    """``(case, released, truth, type)`` of every mention in an original."""
    items = docs.filter("not is_copy").select("case", F.explode(mention_releases(F.col("spans"), strategy, F.col("key"), F.col("case"))).alias("m")).select("case", "m.*")
    return items.filter(F.col("type") == only_type) if only_type else items


def cross_pairs(items: DataFrame, *keys: str) -> DataFrame:
    """``(n)``: pairs of mentions of different cases with equal keys, none empty: the sum of (T² - Σ v²) / 2 over keys."""
    used = items
    for k in keys:
        used = used.filter(F.col(k).isNotNull() & (F.col(k) != ""))
    per_case = used.groupBy(*keys, "case").agg(F.count("*").alias("v"))
    return _pairs_of(per_case, *keys).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n"))


def _pairs_of(per_case: DataFrame, *keys: str) -> DataFrame:
    return per_case.groupBy(*keys).agg(((F.sum("v") * F.sum("v") - F.sum(F.col("v") * F.col("v"))) / 2).cast("long").alias("p"))


def linkage(docs: DataFrame, strategy: str, only_type: str | None = None) -> DataFrame:
    """``(truth, predicted, correct, recall, precision)`` of linking mentions across cases by their released string. Mentions are
    released and normalised once, and counted by true string, released string and both in one plan."""
    named = lambda c: F.when(F.col(c) != "", F.col(c))
    t, r = named("truth"), named("released")
    keys = F.array(*(F.struct(F.lit(what).alias("what"), key.alias("key")) for what, key in (("truth", F.struct(t.alias("x"), F.lit("").alias("y"))), ("predicted", F.struct(r.alias("x"), F.lit("").alias("y"))), ("correct", F.struct(t.alias("x"), r.alias("y"))))))
    counted = mention_items(docs, strategy, only_type).groupBy("case", "truth", "released").agg(F.count("*").alias("c"))
    used = counted.select("case", "c", F.explode(keys).alias("k")).select("case", "c", "k.what", "k.key.x", "k.key.y").filter("x is not null and y is not null")
    pairs = _pairs_of(used.groupBy("what", "x", "y", "case").agg(F.sum("c").alias("v")), "what", "x", "y")
    n = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("p"))), F.lit(0)).alias(what)
    return pairs.agg(n("truth"), n("predicted"), n("correct")).select("*", _ratio(F.col("correct"), F.col("truth")).alias("recall"), _ratio(F.col("correct"), F.col("predicted")).alias("precision"))


def released_linkage(docs: DataFrame, membership: DataFrame, strategy: str) -> DataFrame:
    """Linkage of persons on what is published: every kept document counts, copies included."""
    kept = membership.filter("idx = component").select("idx")
    return linkage(docs.filter(F.size("spans") > 0).join(kept, "idx", "left_semi").withColumn("is_copy", F.lit(False)), strategy, "PERSON")


def paired_documents(docs: DataFrame) -> DataFrame:
    """Copies and the originals that have one: all that measures of pairs read."""
    return docs.join(docs.filter("is_copy").select("case").distinct(), "case", "left_semi")


def window_sets(docs: DataFrame, n: int = 5, *more: Column) -> DataFrame:
    """``(idx, case, is_copy, every, unmarked)``: all shingles of lower-cased tokens, and those of windows without a marked one."""

    def windows(ts: Column) -> Column:
        spread = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(ts) - (n - 1)))
        return F.transform(spread, lambda i: T.let(F.slice(ts, i, F.lit(n)), lambda w: F.struct(F.array_join(F.transform(w, lambda t: t["token"]), " ").alias("s"), F.exists(w, lambda t: t["marked"]).alias("marked"))))

    def sets(w: Column) -> Column:
        texts = lambda x: F.array_distinct(F.transform(x, lambda v: v["s"]))
        return F.struct(texts(w).alias("every"), texts(F.filter(w, lambda x: ~x["marked"])).alias("unmarked"))

    both = T.let(T.let(S.marked_tokens(F.col("text"), F.col("spans"), T.TOKEN), windows), sets)
    return docs.select("idx", "case", "is_copy", both.alias("w"), *more).select("idx", "case", "is_copy", "w.*", *docs.select(*more).columns)


def dose(docs: DataFrame, strategies: tuple = ("SUR-DOC", "HASH-ENTITY", "FAKER-DOC"), n: int = 5) -> DataFrame:
    """For every copy: the share of shingles that marking touches, similarity as it is, as predicted after document-scoped
    replacement, (1 - m) J / (1 + m J), and as observed under each strategy. Only copies and their originals are released, each
    once, and one join brings them together."""
    names = {s: s.lower().replace("-", "_") for s in strategies}
    w = window_sets(paired_documents(docs), n, *(release_shingles(s, n).alias(name) for s, name in names.items()))
    w = Scratch(docs.sparkSession, "dose").keep(w, "sets")
    o = w.filter("not is_copy").select("case", F.col("every").alias("oa"), F.col("unmarked").alias("ou"), *(F.col(x).alias(f"o_{x}") for x in names.values()))
    both = w.filter("is_copy").join(o, "case").withColumn("s", F.array_intersect("oa", "every"))
    rest = F.size(F.array_intersect(F.array_intersect("s", "ou"), F.col("unmarked")))
    m_doc = 1 - F.size("ou") / F.greatest(F.size("oa"), F.lit(1))
    m_shared = 1 - rest / F.greatest(F.size("s"), F.lit(1))
    rows = both.select("idx", "case", m_doc.alias("m_doc"), m_shared.alias("m_shared"), T.jaccard(F.col("oa"), F.col("every")).alias("j_raw"), *(T.jaccard(F.col(f"o_{x}"), F.col(x)).alias(f"j_{x}") for x in names.values()))
    form = lambda m: (1 - F.col(m)) * F.col("j_raw") / (1 + F.col(m) * F.col("j_raw"))
    return rows.withColumn("j_pred", form("m_doc")).withColumn("j_pred_shared", form("m_shared"))


def marking_conditions(docs: DataFrame, n: int = 5) -> DataFrame:
    """``(idx, case, consistent, same_marked)``: no shingle of the pair is marked in one place and unmarked in another; both have the
    same marked shingles in common."""
    w = Scratch(docs.sparkSession, "conditions").keep(window_sets(paired_documents(docs), n), "sets").withColumn("touched", F.array_except("every", "unmarked"))
    o = w.filter("not is_copy").select("case", F.col("every").alias("oe"), F.col("unmarked").alias("ou"), F.col("touched").alias("ot"))
    both = w.filter("is_copy").join(o, "case")
    clash = F.size(F.array_intersect(F.array_union("ot", "touched"), F.array_union("ou", "unmarked")))
    shared = F.array_intersect("oe", "every")
    same = F.size(F.array_except(F.array_intersect(shared, F.col("ot")), F.col("touched"))) + F.size(F.array_except(F.array_intersect(shared, F.col("touched")), F.col("ot")))
    return both.select("idx", "case", (clash == 0).alias("consistent"), (same == 0).alias("same_marked"))


def screening(rows: DataFrame, theta: float = 0.7) -> DataFrame:
    """Counts of the warning rule m_doc > (1 - theta) / (1 + theta) by ``setting``, on pairs that the raw text keeps at theta."""
    limit = (1 - theta) / (1 + theta)
    base, reach, warn = F.col("j_raw") >= theta - EPS, F.col("j_sur_doc") >= theta - EPS, F.col("m_doc") > limit + EPS
    n = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("setting").agg(F.count("*").alias("n"), n(base).alias("raw_pairs"), n(base & ~reach).alias("lost"), n(base & ~reach & warn).alias("warned_lost"), n(base & reach & warn).alias("warned_kept"), n(base & ~reach & ~warn).alias("missed"), n(base & reach & ~warn).alias("silent_kept"), F.median("m_doc").alias("median_m_doc"))


def predictor_summary(rows: DataFrame, theta: float = 0.7) -> DataFrame:
    """Errors of both forms of the prediction by ``setting``, and where prediction and observation disagree at theta."""
    limit = (1 - theta) / (1 + theta)
    err = lambda p: F.abs(F.col("j_sur_doc") - F.col(p))
    reach = F.col("j_sur_doc") >= theta - EPS
    n = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("setting").agg(
        F.count("*").alias("n"), F.avg(err("j_pred_shared")).alias("mae_shared"), F.max(err("j_pred_shared")).alias("max_shared"), F.avg(err("j_pred")).alias("mae_doc"), F.max(err("j_pred")).alias("max_doc"),
        F.median("m_doc").alias("median_m"), F.avg((F.col("j_raw") >= theta).cast("double")).alias("recall_raw"), F.avg(reach.cast("double")).alias("recall_observed"), F.avg((F.col("j_pred_shared") >= theta - EPS).cast("double")).alias("recall_predicted"),
        n((F.col("m_shared") > limit + EPS) & reach).alias("bound_violations"), n((F.col("j_pred_shared") >= theta - EPS) != reach).alias("disagree_shared"), n((F.col("j_pred") >= theta - EPS) != reach).alias("disagree_doc"),
    )


def touched_recall(docs: DataFrame, membership: DataFrame) -> DataFrame:
    """``(n, recall)`` over copies where either side has a span."""
    marked = docs.groupBy("case").agg(F.max((F.size("spans") > 0).cast("int")).alias("touched"))
    return copies_detected(membership).join(marked.filter("touched = 1"), "case", "left_semi").agg(F.count("*").alias("n"), F.avg(F.col("detected").cast("double")).alias("recall"))


def detector_quality(gold: DataFrame, found: DataFrame) -> DataFrame:
    """``(tp, fp, fn, precision, recall, direct_missed)`` by characters from ``(idx, spans)`` of both; direct_missed counts gold spans that
    aren't covered in full."""
    chars = lambda d: d.select("idx", F.explode("spans").alias("s")).select("idx", F.explode(F.sequence(F.col("s.start"), F.col("s.end") - 1)).alias("c")).distinct()
    g, f = chars(gold).withColumn("g", F.lit(1)), chars(found).withColumn("f", F.lit(1))
    j = g.join(f, ["idx", "c"], "full_outer").agg(F.count(F.when(F.col("g").isNotNull() & F.col("f").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("g").isNull(), 1)).alias("fp"), F.count(F.when(F.col("f").isNull(), 1)).alias("fn"))
    covered = gold.select("idx", F.posexplode("spans").alias("k", "s")).select("idx", "k", F.explode(F.sequence(F.col("s.start"), F.col("s.end") - 1)).alias("c")).join(f, ["idx", "c"], "left").groupBy("idx", "k").agg(F.min(F.coalesce("f", F.lit(0))).alias("all"))
    missed = covered.filter("`all` = 0").count()
    return j.select("tp", "fp", "fn", _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), F.lit(missed).cast("long").alias("direct_missed"))


def removal_skew(membership: DataFrame, attributes: DataFrame, column: str) -> DataFrame:
    """``(value, corpus, lost)``: cases by an attribute, in the corpus and among the lost ones."""
    cases = membership.select("case").distinct().join(attributes.select("case", F.col(column).alias("value")).distinct(), "case", "left")
    gone = lost_cases(membership).withColumn("gone", F.lit(1))
    return cases.join(gone, "case", "left").groupBy("value").agg(F.count("*").alias("corpus"), F.count("gone").alias("lost"))


def without_types(docs: DataFrame, types: list[str], only: bool) -> DataFrame:
    """``docs`` with the spans of some types only, or of all others: category ablation."""
    return docs.withColumn("spans", spans_without(types, only))


def spans_without(types: list[str], only: bool) -> Column:
    keep = lambda s: s["type"].isin(types) if only else ~s["type"].isin(types)
    return F.filter("spans", keep)


def paragraph_stats(paragraphs: DataFrame) -> DataFrame:
    gone = F.col("removed").cast("long")
    return paragraphs.agg(F.count("*").alias("paragraphs"), F.sum(gone).alias("removed"), _ratio(F.sum(gone), F.count("*")).alias("share"), _ratio(F.sum(F.when(F.col("removed"), F.col("words")).otherwise(0)), F.sum("words")).alias("word_share"), F.countDistinct(F.when(F.col("removed"), F.col("idx"))).alias("documents"))


def exposure(docs: DataFrame, found: str, strategy: str = "FAKER-DOC", most: int = 5, dictionary: DataFrame | None = None) -> DataFrame:
    """What comparing released texts gives away: name-like words rare in the release are flagged in an original (rule ``one``), or
    in original and copy (``two``), less a dictionary of surrogates where there is one. ``docs`` has gold spans; ``found`` names the
    column of the spans that the release replaced. Returns ``(rule, flagged, leaked_found, surrogates, leaked, precision, recall)``."""
    rel = release(F.col("text"), F.col(found), strategy, F.col("key"), F.col("case"))
    surfaces = lambda found: F.array_distinct(F.transform(found, lambda s: s["surface"]))
    hidden = lambda s, gold, seen: S.overlaps(s["start"], s["end"], gold) & ~S.overlaps(s["start"], s["end"], seen)
    # Every array that a lambda reads is bound first: an expression inside a lambda is evaluated for each element.
    leaks = lambda t: T.let(S.of_types(F.col("spans"), ["PERSON", "ORG", "LOC"]), lambda gold: T.let(F.col(found), lambda seen: surfaces(F.filter(t, lambda s: hidden(s, gold, seen)))))
    raw = T.let(S.name_tokens(F.col("text")), lambda t: F.struct(surfaces(t).alias("raw"), leaks(t).alias("leak")))
    d = docs.select("idx", "case", "is_copy", surfaces(S.name_tokens(rel)).alias("rel"), raw.alias("of")).select("idx", "case", "is_copy", "rel", "of.*")
    d = Scratch(docs.sparkSession, "exposure").keep(d, "names")
    rare = d.select(F.explode("rel").alias("t")).groupBy("t").count().filter(F.col("count") <= most).select("t")
    c = d.filter("is_copy").select("case", F.col("idx").alias("copy"), F.col("rel").alias("crel"), F.col("raw").alias("craw"))
    pairs = d.filter("not is_copy").join(c, "case")
    leaked = pairs.agg(F.sum(F.size(F.array_intersect("leak", "craw"))).alias("n")).first()["n"] or 0
    cand = pairs.select("copy", F.explode("rel").alias("t"), "crel", F.array_intersect("leak", "craw").alias("l"), F.array_except("rel", "raw").alias("sur")).join(rare, "t", "left_semi")
    cand = cand.select("copy", "t", F.array_contains("crel", F.col("t")).alias("both"), F.array_contains("l", F.col("t")).alias("hit"), F.array_contains("sur", F.col("t")).alias("fake"))
    known = dictionary.select("t").distinct().withColumn("known", F.lit(True)) if dictionary is not None else None
    cand = cand.join(known, "t", "left").withColumn("known", F.coalesce("known", F.lit(False))) if known is not None else cand.withColumn("known", F.lit(False))
    rules = {"one": F.lit(True), "two": F.col("both")} | ({"one_minus_dict": ~F.col("known"), "two_minus_dict": F.col("both") & ~F.col("known")} if known is not None else {})
    rows = cand.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), v.alias("on")) for k, v in rules.items()))).alias("r")).select("r.*", "hit", "fake").filter("on")
    n = lambda x: F.sum(F.col(x).cast("long"))
    return rows.groupBy("rule").agg(F.count("*").alias("flagged"), n("hit").alias("leaked_found"), n("fake").alias("surrogates")).withColumn("leaked", F.lit(leaked).cast("long")).withColumn("precision", F.col("leaked_found") / F.greatest("flagged", F.lit(1))).withColumn("recall", F.col("leaked_found") / F.greatest("leaked", F.lit(1)))


def summary(rows: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    return rows.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"), F.median(c).alias("median"), F.percentile(c, 0.25).alias("q25"), F.percentile(c, 0.75).alias("q75"))
