"""Near duplicates, split overlap, top N and nearest vectors against brute force."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrion.llm import knn, neardup, overlap, queries, topn

WORDS = [f"w{i}" for i in range(400)]


def edited(rng, words, share):
    out = [w for w in words if rng.random() > share / 2]
    out += rng.sample(WORDS, max(0, int(len(words) * share / 2)))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    rows = []
    for k in range(60):
        base = rng.sample(WORDS, rng.choice([12, 15, 30, 60, 150]))
        for j in range(rng.choice([1, 2, 4])):
            rows.append((f"p{k:03d}_{j}", " ".join(base if j == 0 else edited(rng, base, rng.choice([0.05, 0.2, 0.35])))))
    rows += [("dup1", rows[0][1].upper()), ("dup2", rows[0][1] + " "), ("short", "a b c"), ("null", None), ("empty", "")]
    rows += [(f"same{i}", "the common words of all texts " + " ".join(WORDS[:10])) for i in range(5)]
    return rows


def brute_pairs(rows, jaccard=0.7, least=12):
    sets = [(i, frozenset(re.findall("[a-z0-9]+", t.lower()))) for i, t in rows if t]
    sets = [x for x in sets if len(x[1]) >= least]
    return {tuple(sorted((a[0], b[0]))) for a, b in itertools.combinations(sets, 2) if len(a[1] & b[1]) >= jaccard * len(a[1] | b[1]) - 1e-12}


def frame(spark, rows):
    return spark.createDataFrame(rows, "passage_id string, text string").withColumn("ingested_at", F.lit("2025-01-01").cast("timestamp"))


def test_near_duplicates_equal_brute_force(spark, texts):
    want = brute_pairs(texts)
    got = [tuple(r) for r in neardup.found(frame(spark, texts)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40


def test_oversize_buckets_lose_nothing(spark, texts):
    reps, _ = neardup.representatives(frame(spark, texts), "passage_id", "text")
    plain = {tuple(r)[:2] for r in neardup.similar_sets(reps).collect()}
    tight = {tuple(r)[:2] for r in neardup.similar_sets(reps, bucket=2, most=5).collect()}
    assert plain == tight


def test_the_tables_find_nearly_all_alone(spark, texts):
    reps, _ = neardup.representatives(frame(spark, texts), "passage_id", "text")
    want = {tuple(r)[:2] for r in neardup.similar_sets(reps).collect()}
    known = neardup.frequencies(reps)
    covered = {tuple(r) for r in neardup.covering_pairs(reps, known, 0.7, 12).collect()}
    assert len(want & covered) >= 0.95 * len(want)
    assert want <= {tuple(r) for r in neardup.crowded_pairs(reps, known, 0.7).collect()} | covered


def test_groups(spark, texts):
    got = {r["passage_id"]: r for r in neardup.groups(frame(spark, texts)).collect()}
    assert got["same0"]["copies"] == 5 and got["same3"]["group_id"] == "same0"
    linked = {x for pair in brute_pairs(texts) for x in pair}
    assert set(got) == linked
    assert neardup.found(frame(spark, texts).limit(0)).count() == 0 and neardup.groups(frame(spark, texts).limit(0)).count() == 0


def test_covering_guarantee():
    rng = random.Random(2)
    for size in (12, 20, 45, 130):
        for _ in range(30):
            a = rng.sample(range(1, 10**6), size)
            most = neardup.radius(size, 0.7)
            drop = rng.randint(0, most)
            b = a[drop // 2 :] + rng.sample(range(10**6, 2 * 10**6), drop - drop // 2)
            inter, union = len(set(a) & set(b)), len(set(a) | set(b))
            if inter < 0.7 * union:
                continue
            tokens = np.array(a + b, dtype=np.uint64)
            row = np.array([0] * len(a) + [1] * len(b))
            member, key, _ = neardup.covering_keys(row, tokens, np.ones(len(tokens), dtype=np.float32), np.array([len(a), len(b)]), 0.7, 12)
            assert set(key[member == 0]) & set(key[member == 1])


# --- overlap ---------------------------------------------------------------------------------------------------

COLUMNS = "question_id string, dataset string, split string, question string, gold_passages array<string>, ingested_at timestamp"


def test_overlap_rules(spark):
    rows = [
        ("t1", "a", " Train", "Who built the Ｏld mill?", ["t1__mill_sent0"]),
        ("d1", "a", "DEV", "who built THE old mill", ["d1__other_sent0"]),
        ("d2", "b", "test", "Who built the very old stone mill?", ["d2__mill_full", "d2__mill_full", None]),
        ("d3", "b", "test", "Who built the very old stone mill?", ["d3__no_title_sent1"]),
        ("v1", "b", "validation", "?!", ["v1__mill_sent0"]),
        ("n1", "b", None, "Who built the old mill?", ["n1__mill_sent0"]),
        ("t2", "a", "train", None, None),
        ("t1", "a", " Train", "Who built the Ｏld mill?", ["t1__mill_sent0"]),
    ]
    q = spark.createDataFrame([(*r, None) for r in rows], COLUMNS).withColumn("kind", F.lit("x"))
    assert {tuple(r) for r in overlap.found(q).collect()} == {("d1", "t1"), ("d2", "t1")}
    got = {(r["split"], r["dataset"]): r.asDict() for r in overlap.report(q).collect()}
    assert got[("dev", "a")]["exact_pairs"] == 1 and got[("test", "b")]["near_questions"] == 1 and got[("test", "b")]["questions"] == 2
    assert overlap.found(q.limit(0)).count() == 0


def test_overlap_of_copies_equals_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choices("abcdefghij", k=rng.choice([3, 5, 8]))) for _ in range(25)] + ["who built the mill"] * 12
    rows = []
    for i in range(260):
        titles = [f"q__{rng.choice(['mill', 'mill', 'quay', 'no_title'])}_sent{rng.randint(0, 2)}" for _ in range(rng.choice([0, 1, 1, 2]))]
        rows.append((f"q{i}", rng.choice("xy"), rng.choice(["train", "train", "dev", "test"]), rng.choice(texts), titles))
    want, near, exact = set(), {}, {}
    named = lambda r: {t.split("__")[1].rsplit("_sent", 1)[0] for t in r[4]} - {"no_title"}
    for a in (r for r in rows if r[2] == "train"):
        for b in (r for r in rows if r[2] != "train"):
            x, y = set(a[3].split()), set(b[3].split())
            same = a[3] == b[3]
            if same or named(a) & named(b) and len(x & y) >= 0.6 * len(x | y) - 1e-9:
                want.add(tuple(sorted((a[0], b[0]))))
                counts = exact if same else near
                counts[b[2], b[1]] = counts.get((b[2], b[1]), 0) + 1
    q = spark.createDataFrame([(*r, None) for r in rows], COLUMNS)
    got = [tuple(r) for r in overlap.found(q).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    for r in overlap.report(q).collect():
        assert (r["exact_pairs"], r["near_pairs"]) == (exact.get((r["split"], r["dataset"]), 0), near.get((r["split"], r["dataset"]), 0))
    few = {tuple(r) for r in overlap.near_classes(overlap.prepare(q), most_common=3).select("train_class", "eval_class", "copies").collect()}
    assert few == {tuple(r) for r in overlap.near_classes(overlap.prepare(q)).select("train_class", "eval_class", "copies").collect()}


# --- top N -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("heavy", [1, 150, 10**9])
def test_top_n_equals_brute_force(spark, heavy):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "a", "b", None]), f"c{rng.randint(0, 300)}", rng.choice([0.5, 0.25, rng.random(), None, float("nan"), -0.0, 0.0])) for _ in range(900)]
    rows += [("none", "x", None), ("none", "y", float("nan"))]
    best: dict = {}
    for g, i, s in rows:
        if g is not None and s is not None and s == s:
            best.setdefault(g, {})
            best[g][i] = max(best[g].get(i, -9), s)
    want = {(g, i) for g, items in best.items() for i, _ in sorted(items.items(), key=lambda x: (-x[1], x[0]))[:10]}
    df = spark.createDataFrame(rows, "g string, i string, s double").withColumn("rank", F.lit(1)).withColumn("grp", F.lit("z"))
    got = topn.top_n(df, "g", "i", "s", 10, heavy).collect()
    assert {(r["g"], r["i"]) for r in got} == want and len(got) == len(want)
    assert topn.top_n(df.limit(0), "g", "i", "s", 10, heavy).count() == 0


# --- vectors ---------------------------------------------------------------------------------------------------


def brute_knn(vectors, k):
    ids = np.array(sorted(vectors))
    matrix = np.array([vectors[i] for i in ids], dtype=np.float32).astype(np.float64)
    norms = np.linalg.norm(matrix, axis=1)
    sims = np.round((matrix @ matrix.T) / (norms[:, None] * norms[None, :]), 10)
    out = {}
    for r, i in enumerate(ids):
        order = [c for c in np.lexsort((ids, -sims[r])) if c != r][:k]
        out[int(i)] = [int(ids[c]) for c in order]
    return out


@pytest.mark.parametrize("spread", [0.1, 1.0])
def test_nearest_equals_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(knn, "BLOCK", 32)
    monkeypatch.setattr(knn, "VISITORS", 40)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    vectors = {i: (centres[i % 12] + spread * rng.normal(size=8)).astype(np.float32) for i in range(300)}
    for i in range(300, 312):
        vectors[i] = vectors[5]  # more copies than k
    vectors[400] = vectors[7] * np.float32(2)  # the same direction
    want = brute_knn(vectors, 5)
    rows = [(i, v.tolist(), "x") for i, v in vectors.items()]
    rows += [(0, vectors[0].tolist(), "x"), (900, None, "x"), (901, [0.0] * 8, "x"), (902, [1.0], "x"), (903, [float("nan")] * 8, "x"), (None, [1.0] * 8, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, sim string")
    got: dict = {}
    for r in knn.nearest(df, "vec_id", "embedding", 5, 8).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other"])
    assert got == want


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r["id"], r["other"]) for r in knn.nearest(df, "vec_id", "embedding", 5, 2).collect()) == [(1, 2), (2, 1)]
    assert knn.nearest(df.limit(0), "vec_id", "embedding", 5, 2).count() == 0


def test_int8_bound_holds():
    rng = np.random.default_rng(1)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(40, 96)), rng.normal(size=(50, 96))))
    ac, as_, an, ae = knn.quantise(a)
    bc, bs, bn, be = knn.quantise(b)
    approx = (ac.astype(np.float32) @ bc.astype(np.float32).T) * as_[:, None] * bs[None, :]
    bound = an[:, None] * be[None, :] + ae[:, None] * bn[None, :] + ae[:, None] * be[None, :] + 1e-6
    assert (np.abs(approx - a @ b.T) <= bound).all()


# --- registry --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() >= 0
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
