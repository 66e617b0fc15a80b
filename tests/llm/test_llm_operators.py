"""Every operator against a plain version, and on nulls, empty and repeated rows, clashing columns and empty tables."""

import base64
import collections
import hashlib
import os
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("shinglemill.llm")

import shinglemill.llm as llm  # noqa: E402
from shinglemill.llm import ann, bpe, dedup, langid, licenses, mixing, sharding, toxicity, vectors, warc  # noqa: E402
from shinglemill.scratch import Scratch  # noqa: E402

EN, DE = "the of and that this with from there were their", "der die und nicht mit sich auf eine werden schon"
CLASH = ("size", "shard", "slot", "n", "rep", "id", "key", "component", "kept", "label", "rank", "score", "lang_pred", "toxicity", "copies", "hi", "a", "ids", "_text", "vector", "_found")


def documents(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASH)))


@pytest.fixture(scope="module")
def docs(spark):
    long = " ".join(f"w{i % 977}" for i in range(40_000))
    base = " ".join(f"t{i}" for i in range(60))
    rows = [(1, base, "en", "a", 1), (2, base.upper(), "en", "a", 1), (3, base + " x", "en", "b", 1), (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \t\n", "de", "c", 3), (7, "one two", "de", "c", 1), (8, "One  TWO", None, "c", 1), (9, long, "en", "a", 1), (9, long, "en", "a", 1), (10, "completely other words in here now", "en", None, 1), (None, base, "en", "a", 1), (11, "ÀB one two", "en", "a", 1)]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


def collected(df, key="doc_id"):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r[key]].append(r)
    return out


# 1 -------------------------------------------------------------------------------------------------------------------


def brute_components(texts: dict, width, percent):
    sets = {d: dedup.exact_set(t or "", width) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_near_duplicates_edge_cases(docs, none):
    got = collected(dedup.near_duplicates(docs, words=4))
    assert {d: (r[0]["n_shingles"], r[0]["component_id"]) for d, r in got.items() if d} == brute_components({r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"]}, 4, 80)
    assert len(got[9]) == 2 and got[None][0]["kept"] and got[None][0]["component_id"] is None
    assert got[8][0]["component_id"] == 7 and got[5][0]["n_shingles"] == 0 and got[4][0]["kept"]
    assert dedup.near_duplicates(none).count() == 0


def test_ids_that_repeat_with_other_texts(spark):
    words = lambda name: " ".join(f"{name}{i}" for i in range(60))
    rows = [(1, words("a")), (1, words("b")), (2, words("b") + " x"), (3, words("a") + " y"), (5, words("c")), (4, words("d")), (5, words("d"))]
    got = dedup.near_duplicates(documents(spark, [(i, t, None, None, 0) for i, t in rows])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)} and len(got) == 7


def test_near_duplicates_in_a_crowd(spark):
    """A group whose similarities spread over the threshold: every link inside large mixed buckets counts."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for d in range(150):
        words = list(base)
        for _ in range(int(rng.integers(0, 9))):
            words[int(rng.integers(0, 120))] = f"x{rng.integers(0, 10**6)}"
        texts[d] = " ".join(words)
    df = documents(spark, [(d, t, None, None, 0) for d, t in texts.items()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in dedup.near_duplicates(df, words=4).collect()}
    want = brute_components(texts, 4, 80)
    assert got == want and 1 < len({c for _, c in want.values()}) < 150


def test_near_duplicate_blocks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 8)
    test_near_duplicates_in_a_crowd(spark)


def test_near_duplicates_whole_table(spark, small):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in dedup.op1_minhash_near_duplicates(spark, small).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert got == brute_components(texts, 4, 80)


# 2 -------------------------------------------------------------------------------------------------------------------


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.random.default_rng(0).integers(0, 2**63, 500, dtype=np.uint64)
    for n in (1, 2, 40, 41):
        assert sharding.jump_hash(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]


def test_many_rows_of_one_key(spark):
    df = documents(spark, [(i % 3 if i < 900 else None, "same", None, None, 0) for i in range(1_200)])
    got = sharding.assign(df, shards=2, rows_per_bucket=20).collect()
    for shard in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in got)))


def test_shards(docs, none):
    rows = sharding.assign(docs, rows_per_bucket=1).collect()
    assert len(rows) == docs.count()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 40) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = collected(sharding.assign(docs))
    assert (by[4][0]["size"], by[4][0]["text_crc32"]) == (16, 0)
    assert (by[11][0]["size"], by[11][0]["text_crc32"]) == (16 + len("ÀB one two".encode()), zlib.crc32("ÀB one two".encode()))
    assert len({r["shard"] for r in by[9]}) == 1
    assert sharding.assign(none).count() == 0


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()


# 3 -------------------------------------------------------------------------------------------------------------------


def embedded(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").select("*", *(F.lit(1).alias(c) for c in ("id", "rep", "weight", "keys", "vector", "links", "leaf", "cid")))


def test_near_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 16))
    rows = [(i, [float(x) for x in (centres[i % 6] + rng.standard_normal(16) * 0.09 * (i % 3)).astype(np.float32)], i % 2) for i in range(120)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, rows[0][1], None), (203, None, 0), (204, [0.0] * 16, 0), (205, [float("nan")] + [1.0] * 15, 0), (206, [None] + [1.0] * 15, 0), (207, [], 0), (208, [1.0] * 3, 0), (209, [float("inf")] * 16, 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(embedded(spark, rows)).collect()}
    good = [(i, np.array(v, float), l) for i, v, l in rows if i <= 201]
    links, root = collections.Counter(), {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, u, a) in enumerate(good):
        for j, v, b in good[:n]:
            if a == b and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.98:
                links.update((i, j))
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert got == {i: (links[i], find(i), find(i) == i) for i, _, _ in rows}
    assert vectors.near_vectors(embedded(spark, [])).count() == 0


def test_near_vector_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 5)
    test_near_vectors(spark)


# 4 and 6 -------------------------------------------------------------------------------------------------------------


def test_language_id(spark, small, docs, none):
    rng = np.random.default_rng(1)
    make = lambda words: " ".join(rng.choice(words.split(), 60))
    rows = [(i, make(EN if i % 2 else DE), "en" if i % 2 else "de", None, 0) for i in range(120)]
    model = langid.train(documents(spark, rows), per_language=60)
    fresh = documents(spark, [(i, make(EN if i % 2 else DE), None, None, 0) for i in range(40)])
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify(fresh, model).collect()}
    assert sum(found[i] == ("en" if i % 2 else "de") for i in found) >= 39
    odd = collected(langid.identify(docs, model))
    assert odd[4][0]["lang_pred"] == odd[5][0]["lang_pred"] == odd[6][0]["lang_pred"] == "und"
    assert all(0 <= r["lang_score"] <= 1 for rs in odd.values() for r in rs) and len(odd[9]) == 2
    assert langid.identify(none, model).count() == 0 and langid.train(none) is None
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


def test_language_id_held_out(spark, small):
    got = {r["doc_id"]: r for r in langid.op4_language_id(spark, small).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())
    held = [d for d, r in got.items() if r["held_out"] and len(docs[d]["text"]) > 100]
    assert np.mean([got[d]["lang_pred"] == docs[d]["lang"] for d in held]) >= 0.95


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(400):
        words = [f"{a}{b}" for a, b in zip(rng.choice(EN.split(), 150), rng.choice(DE.split(), 150))]
        bad = i % 4 == 0
        if bad:
            words[int(rng.integers(0, 150))] = str(rng.choice(["scum", "loweiau", "loweier", "loweien"]))
        rows.append((i, " ".join(words), None, None, 0))
        marks.append((i, int(bad)))
    model = toxicity.train(documents(spark, rows[:300]), spark.createDataFrame(marks[:300], "doc_id long, toxic int"), per_class=80)
    found = {r["doc_id"]: r["toxic_pred"] for r in toxicity.score_toxicity(documents(spark, rows[300:]), model).collect()}
    assert np.mean([found[i] == m for i, m in marks[300:]]) >= 0.9
    odd = collected(toxicity.score_toxicity(docs, model))
    assert odd[4][0]["toxicity"] == odd[5][0]["toxicity"] == odd[6][0]["toxicity"] == 0 and len(odd[9]) == 2
    assert toxicity.score_toxicity(none, model).count() == 0
    assert toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert {r["toxic_pred"] for r in toxicity.score_toxicity(docs, None).collect()} == {0}


def test_gradient():
    """The network's backward pass against differences."""
    rng = np.random.default_rng(0)
    net = toxicity.AttentiveGru()
    net.learned = {k: np.ones(toxicity.HASHED, np.float32) for k in ("word", "gram")}
    words = toxicity.Words(["aa", "bb", "cc"])
    net.w["word"][words.rows] = rng.normal(0, 1, (3, toxicity.DIM))
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    ids, mask, y = np.array([[0, 1, 2, 0], [2, 1, 0, 0]]), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], float), np.array([1.0, 0.0])

    def loss():
        z = net._pool(net._run(net.project(words), ids, mask), mask)[2]
        return np.mean(np.log1p(np.exp(-z * (2 * y - 1))))

    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    before = {k: v.copy() for k, v in net.w.items()}
    net.step(words, ids, mask, y, np.ones(2), moments, 1, 0.0)
    net.w = before
    for k in ("u", "wx", "v", "out", "b"):
        at = tuple(int(rng.integers(0, s)) for s in net.w[k].shape)
        kept, eps = net.w[k][at], 1e-3
        net.w[k][at] = kept + eps
        up = loss()
        net.w[k][at] = kept - eps
        down = loss()
        net.w[k][at] = kept
        assert moments[k][0][at] * 10 == pytest.approx((up - down) / (2 * eps), rel=0.02, abs=1e-5)


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        windows = toxicity.Windows([np.arange(n)])
        ids, mask = windows.rows(np.arange(len(windows)))
        assert set(ids[mask > 0].tolist()) == set(range(n))


def test_pieces_have_the_windows_of_the_whole():
    text = " ".join(f"w{i}" for i in range(2 * toxicity._PIECE + 77))
    names = {w: i for i, w in enumerate(toxicity.words_of(text))}
    cut = lambda parts: [w.rows(np.arange(len(w)))[0].tolist() for w in (toxicity.Windows([np.array([names[x] for x in p])]) for p in parts)]
    assert [r for part in cut(toxicity.pieces_of(text)) for r in part] == cut([list(names)])[0]


# 5 -------------------------------------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, None: 100}, [5, 2, 1]) == {"a": 200.0, "b": pytest.approx(500 / 3), None: pytest.approx(250 / 3)}
    assert mixing.targets({"a": 0}, [1]) == {"a": 0.0}


def test_mix(spark, docs, none):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 90))), None, [None, "a", "b", "ä"][int(rng.integers(0, 4))], 0) for i in range(600)]
    df = documents(spark, rows)
    first = sorted(tuple(r) for r in mixing.mix(df).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect())
    assert first == sorted(tuple(r) for r in mixing.mix(df.repartition(7)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken").collect())
    sizes = collections.Counter()
    for d, t, _, s, _ in rows:
        sizes[s] += len(t.split())
    goal = mixing.targets(dict(sizes), [5, 2, 1])
    taken = collections.Counter()
    for d, s, size, total, target, copies, got in first:
        assert size == len(rows[d][1].split()) and total == sizes[s] and target == pytest.approx(goal[s]) and got == copies * size <= 2 * size
        taken[s] += got
    assert all(abs(taken[s] - goal[s]) <= 90 for s in goal)
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(none).count() == 0


def test_mix_with_one_key(spark):
    """Rows without an id that are equal in everything still meet the target."""
    rows = [(None, "a b c d", None, "s", 0)] * 6_000 + [(i, "x " * (i % 9), None, "t", 0) for i in range(2_000)]
    got = mixing.mix(documents(spark, rows), weights=(1, 10)).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 10 for r in got)


def test_mix_whole_table(spark, small):
    rows = mixing.op5_entropy_balanced_mix(spark, small).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == {d: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in texts.items()}
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
    goal = mixing.targets(dict(sizes), [5, 2, 1])
    for s in sizes:
        mine = [r for r in rows if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(goal[s]) and abs(sum(r["taken"] for r in mine) - goal[s]) <= max(r["size"] for r in mine)
        assert all(r["taken"] <= 2 * r["size"] for r in mine)


def test_rates_are_exponentially_tilted(spark):
    rows = [(i, " ".join(["w"] * (5 + i)), None, "ab"[i % 2], 0) for i in range(80)]
    got = mixing.mix(documents(spark, rows)).filter("rate < 1.999").collect()
    tilt = [(r["source"], np.log(r["rate"] / (2 - r["rate"])) / r["size"]) for r in got]
    for s in {s for s, _ in tilt}:
        assert np.ptp([t for x, t in tilt if x == s]) < 1e-4


# 7 -------------------------------------------------------------------------------------------------------------------


def test_toxicity_whole_table(spark, small):
    for r in toxicity.op6_toxicity(spark, small).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)


def test_toxicity_learns_from_long_documents(spark):
    rng = np.random.default_rng(4)
    plain = [f"{a}{b}" for a in ("ri", "mo", "ta", "le", "su") for b in ("ver", "ster", "ble", "nd", "lk", "ply")]
    prose = lambda n: " ".join(rng.choice(plain, n))
    rows = [(i, f"{prose(500)} {'you worthless stupid scum shut up ' * 4}{prose(500)}" if i % 3 == 0 else prose(1_000), int(i % 3 == 0)) for i in range(120)]
    assert all(len(r[1]) > 4_000 for r in rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(frame.filter("doc_id < 90").drop("toxic"), frame.filter("doc_id < 90").select("doc_id", "toxic"))
    assert model is not None
    got = toxicity.score_toxicity(frame.filter("doc_id >= 90"), model).collect()
    assert sum(r["toxic"] == r["toxic_pred"] for r in got) >= 27


def test_search_fills_k_from_small_leaves(spark):
    rng = np.random.default_rng(5)
    groups = [rng.normal(rng.normal(0, 100, 8), 0.01, (30, 8)) for _ in range(60)] + [rng.normal(5_000, 0.01, (4, 8))]
    x = np.concatenate(groups)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = ann.search(frame, F.col("vec_id") >= 0).collect()
    ranks = {i: sorted(r["rank"] for r in rows if r["query_id"] == i) for i in (0, 900, *range(1800, 1804))}
    assert all(found == list(range(1, 11)) for found in ranks.values()), ranks
    assert len(rows) == 10 * len(x)


def test_license_scan(spark, small, docs, none):
    scanner = licenses.Scanner()
    mit = licenses.NOTICES[4][1]
    wrapped = "Intro.\n" + "\n".join(mit[i : i + 60] for i in range(0, len(mit), 60)) + "\n\nrest"
    assert [(h[0], h[4] <= 9) for h in scanner(wrapped)] == [("MIT", True)]
    assert [h[0] for h in scanner("x All rights reserved. y\nReleased under the MIT License.")] == ["proprietary", "MIT"]
    assert scanner("a licence to print money") == []
    got = licenses.op7_license_notices(spark, small).collect()
    fixed = {"Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3": "GPL-3.0", "Released under the MIT License": "MIT", "All rights reserved": "proprietary"}
    want = []
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        for words, name in fixed.items():
            at = r["text"].find(words)
            while at >= 0:
                want.append((r["doc_id"], name, at, at + len(words)))
                at = r["text"].find(words, at + 1)
    assert sorted((r["doc_id"], r["license"], r["start"], r["end"]) for r in got) == sorted(want)
    assert licenses.scan(docs).count() == 0 and licenses.scan(none).count() == 0


def test_license_inside_prose():
    scanner = licenses.Scanner()
    around = "The quarterly report of the river council lists bridges, ferries and seven new wells near the old mill. " * 8
    for notice, name in (("All rights reserved.", "proprietary"), ("Released under the MIT License.", "MIT"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0")):
        assert [(h[0], h[1]) for h in scanner(f"{around}{notice} {around}")] == [(name, len(around))]
    assert [h[0] for h in scanner("Copyright (c) 2014-2021 Example Publishing Corporation, Springfield. All rights reserved.")] == ["proprietary"]


def test_several_licenses_in_a_line():
    scanner = licenses.Scanner()
    five = ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "All rights reserved."]
    names = ["GPL-3.0", "Apache-2.0", "MIT", "CC-BY-NC-4.0", "proprietary"]
    assert [h[0] for h in scanner(" ".join(five))] == names
    assert [h[0] for h in scanner(" ".join(five[::-1]))] == names[::-1]
    assert [h[0] for h in scanner(licenses.NOTICES[6][1] + " Licensed under CC BY-NC 4.0.")] == ["GPL-3.0-or-later", "CC-BY-NC-4.0"]
    edited = licenses.NOTICES[6][1].replace("redistribute it", "share it")  # an exact notice behind one with a difference hides it no more
    assert [(h[0], h[4]) for h in scanner(edited + " " + licenses.NOTICES[6][1])] == [("GPL-3.0-or-later", 1), ("GPL-3.0-or-later", 0)]
    assert [h[0] for h in scanner(" ".join(five * 40))] == names * 40


def test_word_differences():
    def plain(a, b):
        best = None
        for i in range(len(b) + 1):
            for j in range(i, len(b) + 1):
                row = list(range(j - i + 1))
                for x, w in enumerate(a, 1):
                    new = [x]
                    for y, v in enumerate(b[i:j], 1):
                        new.append(min(row[y] + 1, new[-1] + 1, row[y - 1] + (w != v)))
                    row = new
                best = row[-1] if best is None else min(best, row[-1])
        return best

    rng = np.random.default_rng(6)
    for _ in range(60):
        a, b = (list(rng.choice(list("abc"), int(rng.integers(0, 7)))) for _ in range(2))
        assert licenses.word_differences(a, b)[0] == plain(a, b)


# 8 -------------------------------------------------------------------------------------------------------------------


def plain_search(rows, k):
    out = {}
    good = sorted({(i, tuple(v)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)})
    for q, u in good:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((np.array(u) - np.array(v)) ** 2).sum())), i) for i, v in good if i != q)
            out[q] = near[:k]
    return out


def test_search_exact_when_all_leaves_are_visited(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.standard_normal(8).astype(np.float32)], 0) for i in range(350)]
    rows += [(400 + i, rows[0][1], 0) for i in range(30)] + [(500, None, 0), (600, [0.0] * 8, 0), (700, [float("nan")] * 8, 0), (None, rows[3][1], 0), (5, rows[5][1], 0)]
    got = collections.defaultdict(list)
    for r in ann.search(embedded(spark, rows), F.col("vec_id") % 100 == 0, recall=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    want = plain_search(rows, 10)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], rtol=1e-14)
    assert ann.search(embedded(spark, []), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(embedded(spark, rows[1:4]), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(embedded(spark, rows[:3]), F.col("vec_id") % 100 == 0).count() == 2


def test_search_by_length(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(150)] + [(200, [1.0, 2.0, 3.0]), (201, [1.0, 2.0, 4.0]), (300, [5.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got if r["query_id"] >= 200] == [(200, 201, 1.0)]
    assert sum(r["query_id"] == 0 for r in got) == 10


def test_search_recall(spark):
    d = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"], 0) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = collections.defaultdict(set)
    for r in ann.op8_kmeans_tree_search(spark, d).collect():
        got[r["query_id"]].add(r["vec_id"])
    want = plain_search(rows, 10)
    assert np.mean([len(got[q] & {i for _, i in near}) / len(near) for q, near in want.items()]) >= 0.9


# 9 -------------------------------------------------------------------------------------------------------------------


def test_archives(spark):
    rows = [(1, "u", "xé"), (2, "u", "xé"), (3, None, None), (4, "v", ""), (None, "w", "xé"), (9, "q r\n", "y\r\n\r\nWARC/1.1\r\n" * 9000), (9, "q", "y\r\n\r\nWARC/1.1\r\n" * 9000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("digest", F.lit(2))
    path = Scratch(spark, "warc-test").path("a")
    warc.write_archives(pages, path, segment_bytes=1000, records_per_file=10)
    records = warc.read_archives(spark, path)
    by = {(r["page_id"], r["payload_bytes"]): r for r in warc.resolve_revisits(records).collect()}
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert (by[1, 3]["record_type"], by[1, 3]["refers_to"], by[1, 3]["payload_digest"]) == ("revisit", 2, sha("xé"))
    assert by[2, 3]["record_type"] == "response" and by[None, 3]["refers_to"] == 2
    assert by[3, 0]["refers_to"] == 4 and by[4, 0]["payload_digest"] == sha("")
    assert records.filter("page_id = 9 and status = 'ok'").count() == 2
    assert bytes(records.filter("page_id = 9").first()["payload"]).decode() == rows[-1][2]


def test_no_pages(spark):
    path = Scratch(spark, "warc-test").path("b")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.resolve_revisits(warc.read_archives(spark, path)).count() == 0


def test_broken_segments(spark, tmp_path):
    whole = warc.records_of(1, "u", b"z" * 5000, False, 1000)
    assert len(whole) == 6
    (tmp_path / "part-0").write_bytes(b"".join(r + b"\r\n\r\n" for r in reversed(whole)))
    ok = warc.read_archives(spark, str(tmp_path)).collect()
    assert [(r["status"], bytes(r["payload"])) for r in ok] == [("ok", b"z" * 5000)]
    (tmp_path / "part-0").write_bytes(b"".join(r + b"\r\n\r\n" for i, r in enumerate(whole) if i != 2))
    assert [r["status"] for r in warc.read_archives(spark, str(tmp_path)).collect()] == ["incomplete"]
    assert warc.dechunk(warc.chunked(b"abc" * 9999, 7)) == b"abc" * 9999
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nab\r\n0\r\n\r\n")


def test_pages_whole_table(spark, small):
    got = {r["page_id"]: r for r in warc.op9_warc_reassembly(spark, small).collect()}
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    top = collections.defaultdict(int)
    for p in pages:
        top[p["html"]] = max(top[p["html"]], p["page_id"])
    for p in pages:
        r, body = got[p["page_id"]], p["html"].encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if top[p["html"]] == p["page_id"] else ("revisit", top[p["html"]]))


# 10 ------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})


@pytest.mark.parametrize("frequent", [700_000, 5, 0])
def test_tokens(spark, tokenizer, frequent):
    path, plain = tokenizer
    texts = [None, "", "a  b", "  x\n\n y ", "a\x1c \x1cb", "　　a ᠎", "it's we'll I'M", "x" * 3000, "日本語 テスト  ①②", "🙂" * 20 + "\t\r\n", " \n", "a \x85b", "naïve café\xa0z", "b\x1f\x1e  \x1d c", "ǅ ꟾ ½¾ a_b", "the the the"]
    df = documents(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)] + [(15, texts[15], None, None, 0)])
    encoded = bpe.encode(df, path, public_tokenizers.PATTERN, frequent=frequent)
    got = collected(encoded)
    for i, t in enumerate(texts):
        assert got[i][0]["ids"] == plain.encode_ordinary(t or ""), t
    assert len(got[15]) == 2
    assert {r["doc_id"]: bytes(r["content"]).decode() for r in bpe.decode(encoded, path).collect()} == {i: t or "" for i, t in enumerate(texts)}


def test_long_words(spark, tokenizer):
    """A word of 200,000 letters takes seconds; the heap gives what the fold gives; few remembered words change nothing."""
    path, plain = tokenizer
    ranks = bpe.read_ranks(path)
    words = ["internationalization" * 20, "zqxj" * 100, "日本語" * 90, "aaa", "a"]
    assert [bpe.merge_long(w.encode(), ranks, max(map(len, ranks))) for w in words] == [plain.encode_ordinary(w) for w in words]
    texts = ["b" * 200_000, *words, " ".join(f"x{i}y" for i in range(3_000))]
    df = documents(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]).repartition(2)
    encoded = bpe.encode(df, path, public_tokenizers.PATTERN, frequent=0, most_fresh=2)
    got = {r["doc_id"]: r for r in bpe.decode(encoded, path).collect()}
    assert all(bytes(got[i]["content"]).decode() == t for i, t in enumerate(texts))
    assert all(got[i]["ids"] == plain.encode_ordinary(t) for i, t in enumerate(texts) if i)


def test_no_tokens(none, tokenizer):
    assert bpe.encode(none, tokenizer[0], public_tokenizers.PATTERN).count() == 0


def test_token_digests(spark, small, tokenizer):
    got = {r["doc_id"]: r for r in bpe.op10_byte_bpe(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = tokenizer[1].encode_ordinary(r["text"])
        x = got[r["doc_id"]]
        assert (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest())


def test_latin_classes_match():
    import regex

    split = bpe.Splitter(public_tokenizers.PATTERN)
    text = "".join(map(chr, range(1, 0x250))) * 2 + " a1 é² it's"
    assert split.latin(text) == split.full(text)
    assert regex.findall(public_tokenizers.PATTERN, "it's 12 é") == split("it's 12 é")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_matches_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df, want = llm.queries()[name](spark, small), con.execute(llm.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_workers_need_no_package(tmp_path, small):
    """All queries with the package on the driver's path only."""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    (tmp_path / "run.py").write_text(f"""
import sys
from shinglemill.session import local_session
from shinglemill import llm
spark = local_session(2, "3g", 2)
spark.range(1).mapInArrow(lambda parts: (b for b in parts if __import__("importlib.util").util.find_spec("shinglemill") is None), "id long").collect()[0]
print(sorted((n, q(spark, {small!r}).count() > 0) for n, q in llm.queries().items()))
""")
    code = f"import sys; sys.path.insert(0, {repo!r}); exec(open('run.py').read())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.count("True") == 10, done.stderr[-2000:]


def test_every_number_is_registered():
    assert {q.split("_")[0] for q in llm.queries()} == {f"op{i}" for i in range(1, 11)}
