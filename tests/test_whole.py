"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

import difflib
import random
import re

import pytest

from pyspark.sql import functions as F

from quarrion.operators import examples as E
from quarrion.operators import metrics as M
from quarrion.operators import models as O
from quarrion.operators import nearmiss as N
from quarrion.operators import retrieval as R
from quarrion.operators.ordinals import with_group_ranks
from quarrion.plans import base, registry


def test_packages_keep_long_lists(spark):
    rows = [("q", f"d{i:02}", 4) for i in range(25)] + [("q", f"n{i:02}", 0) for i in range(30)] + [("r", "d00", 2)]
    judged = spark.createDataFrame(rows, "query_id string, doc_id string, score int")
    got = sorted(tuple(r) for r in E.package_rows(judged).collect())
    want = [("q", "neg", i + 1, f"n{i:02}", 0) for i in range(30)] + [("q", "pos", i + 1, f"d{i:02}", 4) for i in range(25)]
    assert got == want
    one = E.training_packages(judged, 20).collect()
    assert len(one) == 1 and (len(one[0]["pos"]), len(one[0]["hard_neg"]), len(one[0]["neg"])) == (20, 0, 20)


def test_package_query_keeps_all_judged(spark, data):
    judged = registry.QUERIES["qrels_dedupe"](spark, data)
    positive = judged.where("score >= 3").select("query_id").distinct()
    assert registry.QUERIES["training_packages_all"](spark, data).count() == judged.join(positive, "query_id", "left_semi").count()


def combined(a, b):
    x, y = (set(re.findall("[a-z0-9]+", t)) for t in (a, b))
    if not x or not y:
        return 0.0
    n = len(x & y)
    return round(0.4 * n / len(x | y) + 0.3 * n / min(len(x), len(y)) + 0.3 * difflib.SequenceMatcher(None, a, b).ratio(), 6)


@pytest.mark.parametrize("least", [0.4, 0.6])
@pytest.mark.parametrize("within", [None, True, False])
def test_scored_pairs_are_those_of_brute_force(spark, data, within, least):
    sets = registry_sets(spark, data).limit(250).localCheckpoint()
    rows = [(r["id"], r["category"], r["label"]) for r in sets.collect()]
    fits = lambda c, d: within is None or (c == d) == within
    want = {(a, b): s for a, c, x in rows for b, d, y in rows if a != b and fits(c, d) and (s := combined(x, y)) >= least}
    assert {(r["a"], r["b"]): r["score"] for r in N.scored_over(sets, least, within, both=True).collect()} == want
    got = N.scored_over(sets, least, within).collect()
    assert {(r["a"], r["b"]): r["score"] for r in got} == {k: s for k, s in want.items() if k[0] < k[1]} and len(got) == len({(r["a"], r["b"]) for r in got})


def registry_sets(spark, data):
    from quarrion.plans.dataset_queries import _sets

    extra = [("x1", "c", "who"), ("x2", "c", "who was the first"), ("x3", "d", "Who?"), ("x4", "d", "??")]
    more = N.label_sets(spark.createDataFrame(extra, "i string, c string, t string"), "i", "t", F.col("c"))
    return more.unionByName(_sets(spark, data).orderBy("id"))


def test_examples_have_siblings(spark):
    rows = [("q", "d1", 4), ("q", "d2", 0), ("q", "d6", 2), ("r", "d2", 3), ("r", "d3", 4), ("s", "d1", 4), ("s", "d4", 3), ("s", "d6", 3), ("t", "d5", 4), ("u", "d2", 1)]
    judged = spark.createDataFrame(rows, "query_id string, doc_id string, score int")
    mapped = spark.createDataFrame([("q", "r")], "id string, neighbour string")
    categories = spark.createDataFrame([("q", "x"), ("r", "x"), ("s", "x"), ("t", "y"), ("u", "x")], "id string, category string")
    got = E.retriever_examples(judged, mapped, categories).collect()
    assert len(got) == len({(r["query_id"], r["doc_id"]) for r in got})
    assert {(r["query_id"], r["doc_id"]): r["label_type"] for r in got} == {
        ("q", "d1"): "pos", ("q", "d2"): "easy", ("q", "d6"): "hard", ("q", "d3"): "near_miss", ("q", "d4"): "sibling",
        ("r", "d2"): "pos", ("r", "d3"): "pos", ("r", "d1"): "sibling", ("r", "d4"): "sibling", ("r", "d6"): "sibling",
        ("s", "d1"): "pos", ("s", "d4"): "pos", ("s", "d6"): "pos", ("s", "d2"): "sibling", ("s", "d3"): "sibling", ("t", "d5"): "pos",
    }


def test_sibling_query_is_that_of_brute_force(spark, data, monkeypatch):
    monkeypatch.setattr(E, "SIBLING_BLOCK", 7)
    own = {(r["query_id"], r["doc_id"]): r["label_type"] for r in registry.QUERIES["retriever_examples"](spark, data).collect()}
    category = {r["question_id"]: (r["dataset"] or "").strip() or "uncategorized" for r in base.questions(spark, data).collect()}
    pool = {}
    for (q, doc), kind in own.items():
        if kind == "pos" and q in category:
            pool.setdefault(category[q], set()).add(doc)
    want = own | {(q, doc): "sibling" for q in {q for q, _ in own} if q in category for doc in pool.get(category[q], ()) if (q, doc) not in own}
    got = [(r["query_id"], doc, r["label_type"]) for r in registry.QUERIES["retriever_examples_all"](spark, data).collect() for doc in r["docs"]]
    assert len(got) == len(want) and {(q, doc): kind for q, doc, kind in got} == want and "sibling" in want.values()


def test_trick_queries_become_examples(spark):
    pairs = [("q", "r", ["A: only x", "(b) - only y", "no label", '{"query": "z", "target_query_id": "r"}']), ("q", "s", ["A: only x"]), ("", "r", ["A: w"])]
    tricks = E.parse_tricks(spark.createDataFrame(pairs, "query_id string, near_miss_id string, trick_queries array<string>"))
    assert sorted((r["near_miss_id"], r["target"], r["target_query_id"], r["text"]) for r in tricks.collect()) == [("r", "A", "q", "only x"), ("r", "B", "r", "only y"), ("r", "B", "r", "z")]
    examples = spark.createDataFrame([("q", "d1", "pos", 1), ("q", "d2", "easy", 0), ("s", "d3", "pos", 1)], "query_id string, doc_id string, label_type string, label int")
    assert sorted((r["text"], r["doc_id"], r["label"]) for r in E.trick_examples(tricks, examples).collect()) == [("only x", "d1", 1), ("only x", "d2", 0)]


def test_model_filters_pairs(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.8), ("b", "c", 0.7)], "a string, b string, score double")
    labels = spark.createDataFrame([(x, x * 2, "k") for x in "abc"], "id string, label string, category string")
    picked = lambda answer: sorted((r["a"], r["b"]) for r in O.filter_pairs(pairs, labels, lambda: lambda prompts: [answer] * len(prompts)).collect())
    assert picked('<think>x</think>{"near_miss_ids": [" c ", "", "zz"]}') == [("a", "c"), ("b", "c")]
    assert picked("none") == [] and picked('{"near_miss_ids": "c"}') == []
    assert sorted((r["a"], r["b"]) for r in O.filter_pairs(pairs, labels, keep=1).collect()) == [("a", "b"), ("a", "c")]


def test_compared_runs_have_means_and_p(spark):
    rows = spark.createDataFrame([(float(i), 0.0) for i in (1, 2, 3, 4, -5)], "a double, b double")
    got = M.compare_runs(rows, "a", "b").collect()[0]
    # 10 of the 32 subsets of 1..5 have a sum of 5 or less
    assert (got["mean_a"], got["mean_b"], got["w"], got["p"]) == (1.0, 0.0, 5.0, 0.625)
    tied = spark.createDataFrame([(1.0, 0.0), (1.0, 0.0), (0.0, 1.0), (3.0, 0.0), (2.0, 2.0)], "a double, b double")
    # n = 4, w = 2, variance 4 * 5 * 9 / 24 - (27 - 3) / 48 = 7, z = 3 / sqrt(7)
    assert M.compare_runs(tied, "a", "b").collect()[0]["p"] == pytest.approx(0.256839, abs=1e-6)
    assert M.compare_runs(tied.where("a = b"), "a", "b").collect()[0]["p"] == 1.0


def test_guards_have_equal_marks(spark, tmp_path):
    texts = ["a " + "-" * 15 + " b", "a " + "-" * 16 + " b", "x" * 150, "a" * 16, "_" * 16, "a. " * 2000, ("a! " * 40), "-=" * 16]
    spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["too_long"], r["long_token"], r["same_marks"], r["too_many_marks"]) for r in registry.QUERIES["text_guards_all"](spark, str(tmp_path)).collect()}
    marks = lambda t: sum(33 <= ord(c) <= 126 and not c.isalnum() for c in t)
    brute = lambda t: (len(t) > 5000, any(len(w) >= 150 for w in t.split()), bool(re.search(r"([^\w\s])\1{15,}", t)), len(t) > 100 and marks(t) > 0.2 * len(t))
    assert got == {f"d{i}": brute(t) for i, t in enumerate(texts)} and got["d1"] == (False, False, True, False)


def test_ranks_of_groups_that_span_partitions(spark):
    rows = spark.createDataFrame([("hot" if i % 7 else None, i * 37 % 101, i) for i in range(2000)] + [("one", 5, 0)], "g string, s int, i int")
    got = with_group_ranks(rows.repartition(4), ["g"], [F.desc("s"), F.asc("i")], "rank").collect()
    want: dict = {}
    for g, s, i in sorted(((r["g"], r["s"], r["i"]) for r in got), key=lambda x: (-x[1], x[2])):
        want.setdefault(g, []).append((s, i))
    assert len(got) == 2001 and all(want[r["g"]][r["rank"] - 1] == (r["s"], r["i"]) for r in got)
    assert with_group_ranks(rows.limit(0), ["g"], [F.asc("i")], "rank").count() == 0


@pytest.mark.parametrize("blocks", [(8192, 32768), (3, 7)])
def test_overlap_tiles_give_ranks_of_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(R, "OVERLAP_QUERIES", blocks[0])
    monkeypatch.setattr(R, "OVERLAP_DOCUMENTS", blocks[1])
    asks = {f"q{i}": [w for j, w in enumerate("abcdefgh") if i >> (j % 4) & 1 or j == i % 3] for i in range(11)} | {"none": ["zz"], "long": [f"w{i}" for i in range(300)]}
    texts = {f"d{i * 37 % 101:03}": [w for j, w in enumerate("abcdefghxy") if i * (j + 3) % 7 < 3] for i in range(60)} | {"dé": ["a"], "w": [f"w{i}" for i in range(290)], "null": None}
    queries = spark.createDataFrame(list(asks.items()), "query_id string, tokens array<string>")
    docs = spark.createDataFrame(list(texts.items()), "doc_id string, tokens array<string>")
    want = {}
    for q, a in asks.items():
        scored = sorted((-n, x) for x, b in texts.items() if b and (n := len(set(a) & set(b))))
        want |= {(q, x): (-n, i + 1) for i, (n, x) in enumerate(scored)}
    hits = spark.createDataFrame([(q, x, n) for (q, x), (n, i) in want.items() if i % 3], "query_id string, doc_id string, score int")
    tiles = R.overlap_tiles(queries, docs, 4, hits).localCheckpoint()
    got = {(r["query_id"], r["doc_id"]): (r["score"], r["rank"]) for r in R.best_of_tiles(tiles, 4).collect()}
    assert got == {k: v for k, v in want.items() if v[1] <= 4}
    got = {(r["query_id"], r["doc_id"]): (r["score"], r["rank"]) for r in R.hits_of_tiles(tiles).collect()}
    assert got == {k: v for k, v in want.items() if v[1] % 3}


def test_overlap_ranking_pairs_nothing_outside_tiles(spark, data, monkeypatch):
    def whole(*_):
        raise AssertionError("every query would be paired with every document that shares a token")

    monkeypatch.setattr(R, "token_overlap", whole)
    for name in ("token_overlap_ndcg", "ccr_report", "pair_confusion", "pair_confusion_wide", "top_confused"):
        registry.QUERIES[name](spark, data)


def test_confusions_of_sets_are_those_of_the_map(spark, monkeypatch):
    rows = [(f"q{i}", "c", " ".join("abcdefg"[j] for j in range(7) if (i * 5 + j * j) % 4)) for i in range(16)] + [("x", "c", "")]
    sets = N.label_sets(spark.createDataFrame(rows, "i string, c string, t string"), "i", "t", F.col("c"))
    positives = spark.createDataFrame([(f"q{i}", f"d{j}") for i in range(16) for j in (i % 5, i % 7)], "query_id string, doc_id string").distinct()
    top = spark.createDataFrame([(f"q{i}", f"d{j}") for i in range(16) for j in range(7)] + [("x", "d1")], "query_id string, doc_id string")
    for least in (0.2, 0.6):
        mapped = N.near_miss_map(N.shared_term_pairs(sets, least), sets)[0]
        want = sorted(tuple(r) for r in N.confusions(top, positives, mapped).collect())
        with monkeypatch.context() as m:
            m.setattr(N, "shared_term_pairs", None)
            got = sorted(tuple(r) for r in N.confusions_of_sets(top, positives, sets, least).collect())
        assert got == want and want


def test_random_scores_take_numbers_of_any_size(spark, tmp_path):
    number = 987_654_321_012_345_678
    rows = [(f"q_{number}", f"p{i}__chunk0", i / 10) for i in range(4)]
    spark.createDataFrame(rows, "query_id string, chunk_id string, score double").write.parquet(f"{tmp_path}/retrieval_scores.parquet")
    got = {(r["passage_id"], r["score"]) for r in registry.QUERIES["random_topk"](spark, str(tmp_path)).collect()}
    score = {f"p{i}": round(((number * 7919 + 62 + i * 100) * 2654435761 + 17) % 1000003 / 1000003, 6) for i in range(4)}
    assert got == set(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:3])


@pytest.mark.parametrize("least", [0.2, 0.5, 0.6, 1.0])
@pytest.mark.parametrize("within", [None, True, False])
def test_term_pairs_are_those_of_brute_force(spark, monkeypatch, within, least):
    monkeypatch.setattr(N, "TOKEN_BLOCK", 5)
    rows = [(f"q{i}", "cd"[i % 2], [w for j, w in enumerate("abcdefghij") if (i * i + 3 * j * i + j) % 7 < 1 + i % 6]) for i in range(50)]
    sets = spark.createDataFrame([(i, c, " ".join(t), t) for i, c, t in rows], "id string, category string, label string, tokens array<string>")
    fits = lambda c, d: within is None or (c == d) == within
    pairs = {(a, b): (set(x), set(y)) for a, c, x in rows for b, d, y in rows if a < b and x and y and fits(c, d)}
    want = {k: (len(x & y) / len(x | y), len(x & y) / min(len(x), len(y))) for k, (x, y) in pairs.items() if len(x & y) / len(x | y) >= least}
    got = N.shared_term_pairs(sets, least, within).collect()
    assert {(r["a"], r["b"]): (r["jaccard"], r["overlap"]) for r in got} == want and len(got) == len(want)


def test_term_pairs_that_share_too_little_are_not_intersected(spark):
    names = [f"n{i} m{i}" for i in range(60)]
    rows = [(f"q{i}", "c", f"{x} what is kept beneath the {i % 3}x {i % 4}y {i % 5}z inside w{i % 7} hall") for i, x in enumerate(names)]
    sets = N.label_sets(spark.createDataFrame(rows, "i string, c string, t string"), "i", "t", F.col("c"))
    small = N.token_rows(sets)
    meet = N.meeting(small, small.withColumn("most", F.col("n")), ())
    bits = F.bit_count(F.col("s_bits").bitwiseAND(F.bitwise_not("l_bits")))
    shared = F.size(F.array_intersect("s_ts", "l_ts"))
    assert meet.where(bits > F.col("s_n") - shared).count() == 0 and meet.where(bits > 1).count() > meet.count() / 2


def test_matching_length_is_that_of_difflib():
    draw = random.Random(1)
    for k in range(1500):
        letters = ("ab", "abcde fgé", "the quick brown fox")[k % 3]
        a, b = ("".join(draw.choice(letters) for _ in range(draw.randrange(40))) for _ in "ab")
        assert N.matching_length(a, b, N.places_of(b)) == sum(x.size for x in difflib.SequenceMatcher(None, a, b).get_matching_blocks())


def test_term_pairs_are_compared_in_arrays(spark, monkeypatch):
    def built(*_):
        raise AssertionError("a row would be built of each pair that has a token in common")

    monkeypatch.setattr(N, "meeting", built)
    monkeypatch.setattr(N, "PAIR_SLICE", 7)
    monkeypatch.setattr(N, "TOKEN_SLICE", 50)
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(1, long), (2, f"{long} one more"), (3, "w1 w2"), (4, "W2 w1"), (5, ""), (6, "alone")]
    sets = N.label_sets(spark.createDataFrame([(i, "c", t) for i, t in rows], "i int, c string, t string"), "i", "t", F.col("c"))
    got = {(r["a"], r["b"]): (r["jaccard"], r["overlap"]) for r in N.shared_term_pairs(sets, 0.6).collect()}
    assert got == {(1, 2): (400 / 402, 1.0), (3, 4): (1.0, 1.0)}


def test_only_queries_with_positives_are_paired(spark, data, monkeypatch):
    seen = []
    pairs = N.shared_term_pairs
    monkeypatch.setattr(N, "shared_term_pairs", lambda sets, *x, **y: [seen.append({r["id"] for r in sets.select("id").collect()}), pairs(sets, *x, **y)][1])
    rows = registry.QUERIES["retriever_examples"](spark, data).collect()
    assert seen and all(ids <= {r["query_id"] for r in rows if r["label_type"] == "pos"} for ids in seen)


def test_best_of_repeated_judgements_counts(spark):
    judged = spark.createDataFrame([("q", "d1", 0), ("q", "d1", 2), ("q", "d2", 4), ("q", "d2", 1), ("q", None, 4), ("r", "d3", 3)], "query_id string, doc_id string, score int")
    mapped = spark.createDataFrame([("q", "r"), ("r", "q"), ("q", "s"), ("s", "q")], "id string, neighbour string")
    got = sorted((r["query_id"], r["doc_id"], r["label_type"]) for r in E.retriever_examples(judged, mapped).collect())
    assert got == [("q", "d1", "hard"), ("q", "d2", "pos"), ("q", "d3", "near_miss"), ("r", "d2", "near_miss"), ("r", "d3", "pos")]


def test_sibling_counts_list_no_siblings(spark, data, monkeypatch):
    listed = {}
    for r in registry.QUERIES["retriever_examples_all"](spark, data).collect():
        listed[r["label_type"], r["difficulty"]] = listed.get((r["label_type"], r["difficulty"]), 0) + len(r["docs"])

    def built(*_, **__):
        raise AssertionError("siblings would be listed")

    monkeypatch.setattr(E, "example_blocks", built)
    got = registry.QUERIES["split_by_difficulty_all"](spark, data).collect()
    assert {(r["label_type"], r["difficulty"]): r["n"] for r in got} == listed and ("sibling", "hard") in listed


def test_counts_of_queries_without_category(spark):
    rows = [("q", "d1", 4), ("q", "d2", 0), ("r", "d2", 3), ("r", "d3", 4), ("n", "d1", 4), ("n", "d9", 2)]
    judged = spark.createDataFrame(rows, "query_id string, doc_id string, score int")
    mapped = spark.createDataFrame([("q", "r")], "id string, neighbour string")
    categories = spark.createDataFrame([("q", "x"), ("r", "x")], "id string, category string")
    got = {r["label_type"]: r["n"] for r in E.example_counts(judged, mapped, categories).collect()}
    # n has no siblings; of d1, d2 and d3, q has labels for all and r for two
    assert got == {"pos": 4, "easy": 1, "hard": 1, "near_miss": 1, "sibling": 1}


def test_labels_are_not_kept_beside_their_siblings(spark, data, monkeypatch):
    kept = []
    cut = E.checkpointed
    monkeypatch.setattr(E, "checkpointed", lambda df, *x: [kept.append(df.columns), cut(df, *x)][1])
    registry.QUERIES["retriever_examples_all"](spark, data)
    assert kept and not any("label_type" in columns for columns in kept)
