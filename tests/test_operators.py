import numpy as np
import pytest
from pyspark.sql import functions as F

from shinglemill.functions import spans as S
from shinglemill.functions import text as T
from shinglemill.operators import corpus as C
from shinglemill.operators import decide as D
from shinglemill.operators import metrics as M
from shinglemill.operators import similarity as sim
from shinglemill.operators import stats
from shinglemill.operators.components import connected_components
from shinglemill.operators.select import digest, lowest
from shinglemill.sources import readers, writers


def members(spark, cases, copies, components):
    rows = [(i, c, k, m) for i, (c, k, m) in enumerate(zip(cases, copies, components))]
    return spark.createDataFrame(rows, "idx long, case string, is_copy boolean, component long")


def work(spark, texts, cases, copies):
    rows = [(i, str(i), c, k, t, None) for i, (t, c, k) in enumerate(zip(texts, cases, copies))]
    df = spark.createDataFrame(rows, "idx long, key string, case long, is_copy boolean, text string, copy_kind string")
    return df.withColumn("spans", S.regex_spans(F.col("text"), r"\bAlice\b", "PERSON"))


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 460)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    used = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: find(x) for x in used}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_transitive_detection(spark):
    m = members(spark, "ABA", [False, False, True], [0, 0, 0])
    hits = spark.createDataFrame([(2, False)], "idx long, hit boolean")
    r = M.score_membership(m, hits).first()
    assert (r["pipeline_recall"], r["pair_recall"], r["lost"], r["kept"]) == (1.0, 0.0, 1, 1)
    assert [x["case"] for x in M.lost_cases(m).collect()] == ["B"]
    assert M.validate_membership(m).count() == 0


def test_kept_copy_preserves_its_case(spark):
    assert M.lost_cases(members(spark, "AA", [False, True], [1, 1])).count() == 0


def test_invalid_memberships(spark):
    assert M.validate_membership(members(spark, "AA", [False, False], [0, 1])).count() == 1
    assert M.validate_membership(members(spark, "AB", [False, True], [0, 1])).count() == 1
    assert M.validate_membership(members(spark, "AB", [False, False], [1, 0])).count() == 1


def test_union_of_partitions(spark):
    of = lambda xs: spark.createDataFrame(list(enumerate(xs)), "idx long, component long")
    assert {r["component"] for r in D.union_partition(of([0, 0, 2]), of([0, 1, 1])).collect()} == {0}


def test_document_scope_breaks_copies(spark):
    docs = work(spark, ["Alice alpha beta gamma delta"] * 3, [0, 1, 0], [False, False, True])
    for strategy, recall in (("RAW", 1.0), ("SUR-DOC", 0.0)):
        m, hits = D.decide(docs, strategy)
        assert M.score_membership(m, hits).first()["pipeline_recall"] == recall
    link = lambda d: tuple(M.linkage(d, "SUR-CORPUS").first())[:3]
    assert link(docs) == (1, 1, 1) and link(docs.filter("idx = 0")) == (0, 0, 0)


def test_similarity_join_is_exact(spark):
    rng = np.random.default_rng(1)
    sets = [sorted({int(x) for x in rng.integers(0, 40, 12)}) for _ in range(60)] + [[1, 2, 3]] * 3 + [[]] * 2
    df = spark.createDataFrame(list(enumerate(sets)), "idx long, set array<long>")
    for theta in (0.3, 0.5, 1.0):
        want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and len(set(a) & set(b)) >= theta * len(set(a) | set(b))}
        assert {(r["i"], r["j"]) for r in sim.jaccard_pairs(df, theta).collect()} == want
    with pytest.raises(ValueError):
        sim.similar_classes(df, 0)


def test_forced_collision(spark):
    docs = work(spark, ["a b c d e", "f g h i j"], [0, 0], [False, True])
    r = sim.hashed_versus_full(docs, lambda s: F.lit(1)).first()
    assert (r["full"], r["hashed"]) == (0.0, 1.0)
    edges = lambda *e: spark.createDataFrame(list(e), "i long, j long")
    assert tuple(sim.compare_graphs(edges((0, 1), (1, 2)), edges((0, 1))).first()) == (1, 1, 0)


def test_mixed_markers(spark):
    docs = C.mixed_markers(work(spark, ["Alice x", "Alice a@b.org"], [0, 0], [False, True]), "contact")
    assert [[s["surface"] for s in r["spans"]] for r in docs.orderBy("idx").collect()] == [["Alice"], ["a@b.org"]]


def test_paragraphs_and_copies(spark):
    docs = work(spark, ["a Alice\n\nb Alice\nc\n", "", "x"], [0, 1, 2], [False] * 3)
    ps = docs.select(C.paragraphs(F.col("text")).alias("p")).collect()
    assert [(p["start"], p["end"], p["text"]) for p in ps[0]["p"]] == [(0, 9, "a Alice\n\n"), (9, 17, "b Alice\n"), (17, 19, "c\n"), (19, 19, "")]
    copies = C.paragraph_copy(docs, 1)
    assert copies.select(S.misaligned(F.col("text"), F.col("spans")).alias("m")).agg(F.sum("m")).first()[0] == 0
    made = C.add_copies(docs, 2, "real", "web", 3)
    assert made.count() == 5 and made.filter("is_copy").select("idx").agg(F.min("idx")).first()[0] > 2
    assert [r["kind"] for r in C.span_alignment(docs).collect()] == ["original"]


def test_omission(spark):
    text = " ".join(f"E{i} E{i}" for i in range(10))
    one = spark.createDataFrame([(0, "0", 0, False, text, None)], "idx long, key string, case long, is_copy boolean, text string, copy_kind string")
    entities = one.withColumn("spans", S.regex_spans(F.col("text"), r"E\d", "X"))
    out, counts = C.omit_spans(entities, "entity", 20, 7)
    assert out.select(F.size("spans")).first()[0] == 16
    assert (counts.first()["inconsistent_share"], counts.first()["units_dropped"]) == (0.0, 2)
    same = one.withColumn("text", F.lit(" ".join(["E1"] * 10))).withColumn("spans", S.regex_spans(F.col("text"), r"E\d", "X"))
    out, counts = C.omit_spans(same, "mention", 20, 7)
    assert out.select(F.size("spans")).first()[0] == 8
    assert counts.first()["inconsistent_share"] == pytest.approx(16 / 45)


def test_lowest(spark):
    rows = spark.range(1000)
    want = [r["id"] for r in rows.orderBy(digest(1, F.col("id"))).limit(137).collect()]
    assert sorted(r["id"] for r in lowest(rows, digest(1, F.col("id")), 137).collect()) == sorted(want)


def test_theta(spark):
    sets = spark.createDataFrame([(0, list(range(10))), (1, list(range(1, 10))), (2, [0, 1, 2, 3, 4, 5, 20])], "idx long, set array<long>")
    classes, pairs = sim.similar_classes(sets, 0.5)
    kept = {t: D.class_components(classes, pairs, t).filter("idx = component").count() for t in (0.5, 0.7)}
    assert kept == {0.5: 1, 0.7: 2}


def test_dose_is_exact_where_marking_is_consistent(spark):
    a = "Alice one two three four five six seven eight nine ten eleven"
    docs = work(spark, [a, a + " twelve"], [0, 0], [False, True])
    r = M.dose(docs, ("SUR-DOC",)).first()
    assert r["j_sur_doc"] == pytest.approx(r["j_pred_shared"], abs=1e-12)
    assert tuple(M.marking_conditions(docs).first())[2:] == (True, True)


def test_exposure(spark):
    text = "we saw Zelda at noon"
    rows = [(0, "a", 0, False, text), (1, "b", 0, True, text)]
    docs = spark.createDataFrame(rows, "idx long, key string, case long, is_copy boolean, text string").withColumn("spans", S.regex_spans(F.col("text"), "Zelda", "PERSON")).withColumn("found", F.array().cast(f"array<{S.SPAN}>"))
    got = {r["rule"]: (r["flagged"], r["leaked_found"], r["recall"]) for r in M.exposure(docs, "found").collect()}
    assert got == {"one": (1, 1, 1.0), "two": (1, 1, 1.0)}


def test_bootstrap(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 0), (-1.0, 1)], "v double, g int")
    assert stats.cluster_bootstrap(df, "v", "g", 1000, 7) == (pytest.approx(1 / 3), -1.0, 1.0)
    assert stats.cluster_bootstrap(df, "v", "g", 1000, 7, ratio=False) == (1.0, -2.0, 4.0)
    assert stats.mcnemar(0, 0) == 1.0 and stats.mcnemar(0, 5) == pytest.approx(2 / 32)
    total, low, high = stats.multinomial_bootstrap(df, "v", "g")
    assert total == 1.0 and low <= 1 <= high


def test_revision_pairs(spark):
    rows = [(1, 1, "2025-01-01", "wikitext", "a"), (1, 2, "2025-02-01", "wikitext", "b"), (1, 3, "2026-02-01", "wikitext", "c"), (2, 4, "2025-01-01", "wikitext", "d")]
    got = C.select_revision_pairs(spark.createDataFrame(rows, "page long, revid long, ts string, model string, content string"), "2026-01-01").collect()
    assert [(r["newer"], r["older"]) for r in got] == [(2, 1)]


def test_readers_and_writers(spark, tmp_path):
    body = '[{"doc_id": "d1", "text": "Ann met Bo", "meta": {"year": "1"}, "annotations": {"a2": {"entity_mentions": []}, "a1": {"entity_mentions": [{"start_offset": 0, "end_offset": 3, "entity_type": "PERSON", "identifier_type": "DIRECT", "entity_id": "e1"}, {"start_offset": 8, "end_offset": 10, "entity_type": "PERSON", "identifier_type": "NO_MASK", "entity_id": "e2"}]}}}]'
    (tmp_path / "a.json").write_text(body)
    docs = readers.gold_spans(readers.annotated_json(spark, [str(tmp_path / "a.json")]))
    assert [(s["surface"], s["type"]) for s in docs.first()["spans"]] == [("Ann", "PERSON")]
    (tmp_path / "mail").mkdir()
    (tmp_path / "mail" / "1").write_text("  Hello\nthere \n@subject\nHi")
    assert readers.mail_tree(spark, str(tmp_path / "mail")).first()["body"] == "Hello\nthere"
    assert readers.verify_manifest(spark, str(tmp_path / "mail"), [{"file": "1", "bytes": 3, "sha256": "x"}, {"file": "2", "bytes": 1, "sha256": "y"}]).count() == 2
    out = str(tmp_path / "r")
    writers.json_report(spark.createDataFrame([(1, float("nan"))], "a int, b double"), out)
    assert spark.read.json(out).columns == ["a"]
    with pytest.raises(Exception):
        writers.json_report(spark.range(1), out)


def test_retries(spark):
    members_ = spark.createDataFrame([(0, 1, "a"), (1, 2, "b"), (2, 3, "c")], "place int, pageid long, title string")
    page = lambda i: (i, ([(i,)],))
    rows = lambda *ids: spark.createDataFrame([(i, {"query": {"pages": [{"pageid": i}]}}) for i in ids], "pageid long, response struct<query:struct<pages:array<struct<pageid:long>>>>")
    found, missing = readers.merge_retries(members_, rows(1), rows(3))
    assert [r["pageid"] for r in found.collect()] == [1, 3] and [r["pageid"] for r in missing.collect()] == [2]
    for bad in (rows(1), rows(9)):
        with pytest.raises(ValueError):
            readers.merge_retries(members_, rows(1), bad)


def test_stream(spark, tmp_path):
    from shinglemill.streaming.incremental import first_seen

    spark.createDataFrame([(1, "2024-01-01 00:00:00", "a b"), (2, "2024-01-01 00:01:00", "a  b"), (3, "2024-01-01 00:02:00", "c")], "id int, ts string, text string").select("id", F.to_timestamp("ts").alias("ts"), "text").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = first_seen(spark.readStream.schema("id int, ts timestamp, text string").parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT count(*) FROM seen").first()[0] == 2


def test_contained_in_matches_other_documents(spark):
    def sets(*rows):
        return spark.createDataFrame(list(rows), "idx long, set array<long>")

    whole, part, odd = [16 * i for i in range(100)], [16 * i for i in range(90)], [16 * i for i in range(500, 510)]
    docs = sets((0, whole), (1, part), (2, [*part[:85], *odd]), (3, [7]), (4, [16 * i + 1600 * 9 for i in range(5)]))
    got = {r["idx"]: (r["match"], round(r["containment"], 6)) for r in sim.contained_in(docs, docs, others=True).collect()}
    assert got == {0: (1, 1.0), 1: (0, 0.9), 2: (1, round(85 / 90, 6))}
    assert all(r["idx"] == r["match"] for r in sim.contained_in(docs, docs).filter("idx = 0").collect())


def test_contained_in_query(spark, small):
    from shinglemill.plans import documents

    found = documents.contained_in(spark, small).collect()
    assert found and all(r["idx"] != r["match"] and r["containment"] >= 0.8 for r in found)
    corpus = documents._corpus(spark, small)
    last = {r["idx"] for r in corpus.filter("is_copy").select("idx").collect()}
    assert any(r["match"] in last and r["idx"] not in last for r in found)


def test_minhash_bandings_of_three_seeds(spark, small):
    from shinglemill.functions import text as T
    from shinglemill.plans import documents

    rows = documents.minhash_bandings(spark, small).collect()
    assert sorted((r["banding"], r["seed"]) for r in rows) == sorted((name, seed) for name in T.BANDINGS for seed in range(3))
    assert len({r["documents"] for r in rows}) == 1 and all(0 < r["removed"] < r["documents"] for r in rows)


def test_cosine_threshold_takes_whole_vectors_of_equal_length(spark):
    import numpy as np

    from shinglemill.operators.similarity import cosine_threshold

    made = np.random.default_rng(4).normal(size=(40, 6))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(made)]
    odd = [(90, None), (91, []), (92, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (93, [float("nan")] * 6), (94, [1.0, 2.0]), (95, [2.0, 4.0])]
    pairs = spark.createDataFrame([(0, 1), (2, 3), (4, 92), (94, 95), (5, 94)], "a long, b long")
    got = cosine_threshold(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"), pairs, 0.9).first()
    unit = made / np.linalg.norm(made, axis=1, keepdims=True)
    every = np.append((unit @ unit.T)[np.triu_indices(40, 1)], 1.0)
    asked = [unit[0] @ unit[1], unit[2] @ unit[3], 1.0]
    assert abs(got["tau"] - np.quantile(every, 0.9)) < 1e-9
    assert got["n"] == 3 and abs(got["median_positive"] - np.median(asked)) < 1e-9
    assert abs(got["recall"] - np.mean([c >= got["tau"] for c in asked])) < 1e-9


def test_one_run_of_components_serves_all_bandings(spark):
    from pyspark.sql import functions as F

    from shinglemill.operators import decide

    signed = spark.createDataFrame([(i, [7 * (i // 3)] * 100 + [i] * 12) for i in range(9)], "idx long, signature array<long>")
    linked = decide.minhash_decisions(signed.withColumn("setting", F.lit(0)), ("14x8", "7x16"))
    for banding in ("14x8", "7x16"):
        docs = signed.select("idx", F.col("idx").alias("case"), F.lit(False).alias("is_copy"))
        plain = {tuple(r) for r in decide.minhash_decision(docs, signed, banding).select("idx", "component").collect()}
        assert {tuple(r) for r in linked.filter(F.col("banding") == banding).select("idx", "component").collect()} == plain


def test_similarity_join_of_words(spark):
    rng = np.random.default_rng(5)
    bases = [" ".join(f"w{x}" for x in rng.integers(0, 300, 40)) for _ in range(12)]
    texts = [" ".join(t.split()[k:]) + " tail" * (k % 2) for t in bases for k in range(5)] + ["", "", "one two", "One, two", "[A_1] [a_1]", bases[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
    sets = {r["idx"]: set(r["s"]) for r in df.select("idx", T.shingles_text(T.tokens(F.col("text")), 5).alias("s")).collect()}
    words = sim.shingle_words(df)
    for theta in (0.5, 0.7):
        want = {(i, j): len(a & b) / len(a | b) for i, a in sets.items() for j, b in sets.items() if i < j and len(a & b) >= theta * len(a | b)}
        assert {(r["i"], r["j"]): r["jaccard"] for r in sim.jaccard_pairs(words, theta, 5).collect()} == want and len(want) > 50
        assert {(r["a"], r["b"]): r["containment"] for r in sim.containment_pairs(words, theta, 5).collect()} == {(i, j): len(sets[i] & sets[j]) / len(sets[j]) for i, j in want}
