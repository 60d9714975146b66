"""Model calls with attempts, grades, readers, choosers; walk records; sinks and readers that go with them."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarrion.operators import asking, entities, graph, metrics, nearmiss, retrieval, selection
from quarrion.sources import readers, sinks


def scripted(*replies):
    """A model whose n-th call on a task gives the n-th reply to every prompt; an exception is raised."""

    def make():
        calls = iter(replies)

        def run(prompts: pd.Series) -> list:
            reply = next(calls)
            if isinstance(reply, Exception):
                raise reply
            return [reply] * len(prompts)

        return run

    return make


def one(spark, text="q"):
    return spark.createDataFrame([(text,)], "p string").coalesce(1)


@pytest.mark.parametrize(
    ("replies", "want"),
    [(("4",), (4, 0.8, True, 1)), (("many", "3"), (3, 0.6, True, 2)), ((OSError(), OSError(), "2"), (2, 0.4, True, 3)), (("9", "9", "about 7"), (5, 1.0, False, 3)), ((None, None, "no"), (0, 0.0, False, 3))],
)
def test_grades_are_asked_again(spark, replies, want):
    rows = spark.createDataFrame([("a", "b")], "question string, sentence string").coalesce(1)
    r = asking.grade_sentences(rows, "question", "sentence", scripted(*replies)).first()["grade"]
    assert (r["score"], r["normalised"], r["valid"], r["attempts"]) == want and r["prompt_tokens"] > 0


def test_grades_of_nulls_and_totals(spark):
    rows = spark.createDataFrame([("old mill", "the old mill", 1), (None, "x", 1), ("mill", None, 2)], "question string, sentence string, grade int").drop("grade")
    graded = asking.grade_sentences(rows, "question", "sentence")
    assert sorted(r["grade"]["score"] for r in graded.collect()) == [0, 0, 5]
    assert asking.grade_totals(graded).first()["invalid"] == 0
    assert asking.grade_sentences(rows.limit(0), "question", "sentence").count() == 0


def test_null_prompts_are_not_sent(spark):
    rows = spark.createDataFrame([(None,), ("x",)], "p string").coalesce(1)
    got = {r["p"]: r["reply"] for r in asking.ask(rows, "p", scripted(None, "ok")).collect()}
    assert got[None]["attempts"] == 0 and got[None]["prompt_tokens"] == 0 and got["x"]["attempts"] == 2 and got["x"]["accepted"]


def test_reader_falls_back(spark):
    questions = spark.createDataFrame([("q1", "who?"), ("q2", "what?")], "question_id string, question string").coalesce(1)
    ranked = spark.createDataFrame([("q1", 1, "The mill stood here. It fell.")], "question_id string, rank int, text string")
    got = {r["question_id"]: r for r in asking.answer_with_model(questions, ranked, 100).collect()}
    assert got["q1"]["answer"] == "The mill stood here" and got["q1"]["n_selected"] == 1
    assert got["q2"]["answer"] == "unknown" and got["q2"]["attempts"] == 0 and not got["q2"]["accepted"]
    thought = asking.answer_with_model(questions, ranked, 100, model=scripted("", "<think>hm</think>\nAnswer: Bo."))
    assert {r["question_id"]: (r["answer"], r["attempts"]) for r in thought.collect()}["q1"] == ("Bo", 2)


def test_chooser():
    edges = [{"query_id": "q", "oq_id": "o", "dst": "x"}, {"query_id": "q", "oq_id": "o", "dst": "y"}]
    assert asking.model_chooser(scripted("2"))(edges)["dst"] == "y" and asking.model_chooser(scripted("null"))(edges) is None
    assert asking.model_chooser(scripted("hm", "1"))(edges)["dst"] == "x" and asking.model_chooser(scripted())([]) is None
    for bad in (scripted("3"), scripted("0"), scripted("x", "y"), scripted("true", "1.5")):
        with pytest.raises(ValueError):
            asking.model_chooser(bad)(edges)


def test_balanced_models(spark):
    rows = spark.range(40).select(F.col("id").cast("string").alias("p")).repartition(4)
    got = asking.ask(rows, "p", asking.balanced(scripted("a", "a"), scripted("b", "b")))
    assert {r["reply"]["text"] for r in got.collect()} == {"a", "b"}


def test_walk_records(spark):
    seeds = spark.createDataFrame([("q", "s", 0)], "query_id string, src string, place int")
    edges = spark.createDataFrame([("s", "a", "o1", 0.1), ("a", "b", "o1", 0.2), ("b", "s", "o1", 0.3)], "src string, dst string, oq_id string, conditioned_score double")
    steps = graph.traverse(seeds, edges, 3)
    gold = spark.createDataFrame([("q", ["b", "z"])], "query_id string, gold array<string>")
    r = graph.walk_results(steps, seeds, gold).first()
    assert (r["steps"], r["repeats"], r["hops"], r["precision"], r["recall"], r["f1"]) == (3, 1, 3, 0.333333, 0.5, 0.4)
    assert {x["passage"]: x["visits"] for x in r["visited"]} == {"s": 2, "a": 1, "b": 1}
    hops = {h["hop"]: (h["expanded_from"], h["new_passages"]) for h in graph.walk_hops(steps, seeds).collect()}
    assert hops == {0: (["s"], ["a"]), 1: (["a"], ["b"])}
    alone = graph.walk_results(steps.limit(0), seeds, gold.limit(0)).first()
    assert (alone["steps"], alone["recall"]) == (0, 0.0)
    chosen = graph.traverse(seeds, edges, 3, asking.model_chooser(lambda: lambda prompts: ["null"]))
    assert chosen.count() == 0


def test_ranks_and_quantiles_of_few(spark):
    rows = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 2.0), ("g", "c", 2.0), ("h", "a", None)], "g string, i string, s double")
    got = retrieval.ranks_of(rows.where("i = 'c'").select("g", "i", "s"), rows, "g", "i", "s").first()
    assert got["rank"] == 2
    q = {r["g"]: r["median_s"] for r in metrics.exact_quantiles(rows, ["s"], {"median": 0.5}, "g").collect()}
    assert q == {"g": 2.0, "h": None}
    assert metrics.exact_quantiles(rows, ["s"], {"p90": 0.9}).first()["p90_s"] == 2.0
    assert retrieval.row_ranks(rows.where("s > 0"), "g", ("s",), "i", 1).first()["i"] == "b"


def test_greedy_takes_empty_items_until_the_budget_is_met(spark):
    rows = spark.createDataFrame([("g", 1, 0), ("g", 2, 6), ("g", 3, 6), ("g", 4, 4), ("g", 5, 0), (None, 1, 0), (None, 2, 3)], "g string, rank int, size int")
    got = {(r["g"], r["rank"]) for r in selection.greedy_budget(rows, "g", "rank", "size", 10).collect()}
    assert got == {("g", 1), ("g", 2), ("g", 4), (None, 1), (None, 2)}


def test_usage_conflicts_and_rates(spark):
    log = spark.createDataFrame([("q1", "tokens", "5", 1), ("q1", "tokens", "7", 2), ("q2", "tokens", "1", 1), ("q1", "model", "a", 1), ("q2", "model", "b", 1), ("q1", "time", "4", 1)], "q string, k string, v string, s int")
    totals = metrics.merge_totals(log, "q", "k", "v", "s")
    got = {r["k"]: r for r in totals.collect()}
    assert got["tokens"]["total"] == 13 and not got["tokens"]["conflict"] and got["model"]["first_text"] == "a" and got["model"]["conflict"]
    assert metrics.derived_rates(totals, "k", "time", tokens="tokens").first()["tokens_per_second"] == 3.25
    assert metrics.derived_rates(totals.limit(0), "k", "time", tokens="tokens").first()["tokens_per_second"] == 0


def test_sinks_and_readers(spark, tmp_path):
    examples = spark.createDataFrame([("q", "d", "pos", 1), ("q", "e", "hard", 0)], "query_id string, doc_id string, label_type string, label int")
    sinks.write_examples(examples, f"{tmp_path}/x")
    assert sorted(map(tuple, sinks.read_examples(spark, f"{tmp_path}/x").select(*examples.columns).collect())) == sorted(map(tuple, examples.collect()))
    labels = spark.createDataFrame([("a", "c"), ("b", "c"), ("z", "d")], "id string, category string")
    pairs = spark.createDataFrame([("a", "b"), ("a", "gone")], "a string, b string")
    bundle = nearmiss.ontology(labels, pairs)
    summary = json.loads(sinks.ontology_summary(labels, bundle.near_misses, bundle.unknown))
    assert summary == {"categories": 2, "labels": 3, "largest_category": 2, "near_miss_pairs": 2, "unknown_ids": 1}
    assert [tuple(r) for r in nearmiss.siblings_of(labels, labels.where("id = 'a'")).collect()] == [("a", "b")]
    tricks = spark.createDataFrame([("q", "n", "A", "x"), ("q", "n", "B", "y")], "query_id string, near_miss_id string, target string, text string")
    sinks.write_tricks(tricks, f"{tmp_path}/t")
    assert spark.read.json(f"{tmp_path}/t").first()["trick_queries"] == ["A: x", "B: y"]
    assert "1 more rows are not shown." in sinks.markdown_report("t", labels, 2)
    (tmp_path / "r.json").write_text(json.dumps({"pairs": [{"query_id": "q", "near_miss_id": "n", "hits": 2, "hit_rate": 0.4}, {"query_id": None}]}, indent=1))
    assert [tuple(r) for r in readers.read_confusion_report(spark, f"{tmp_path}/r.json").collect()] == [("q", "n", 2, 0.4)]
    (tmp_path / "a.json").write_text(json.dumps([{"id": f"i{k}"} for k in range(30)]))
    (tmp_path / "c.csv").write_text("id\n" + "".join(f"i{k}\n" for k in range(30)))
    for rows in (readers.read_json_array(spark, f"{tmp_path}/a.json", "id string", 20), readers.read_csv(spark, f"{tmp_path}/c.csv", "id string", 20)):
        assert {r["ordinal"]: r["id"] for r in rows.collect()} == {k: f"i{k}" for k in range(20)}


def test_random_scores(spark):
    rows = asking.random_scores(spark.range(1000), F.col("id"), 3).collect()
    assert all(0 <= r["score"] < 1 for r in rows) and 0.45 < sum(r["score"] for r in rows) / 1000 < 0.55


def test_tricks_by_model(spark):
    pairs = spark.createDataFrame([("mills", "quays")], "x string, y string").coalesce(1)
    got = asking.tricks_by_model(pairs, "x", "y", 3, scripted("none", "A: mills by quays\nB - quays\nnoise\n[B]: quays at mills\nA: mills by quays"))
    assert sorted((r["ordinal"], r["target"], r["trick"]) for r in got.collect()) == [(0, "A", "mills by quays"), (1, "B", "quays at mills")]
    assert asking.tricks_by_model(pairs, "x", "y", 3, scripted("no", None)).count() == 3
    assert asking.tricks_by_model(pairs.limit(0), "x", "y", 3, scripted()).count() == 0


TEXT = "In May Dr. Vera Low met the Harbour Council at Dover. The Old Mill Bridge crosses River Dane near Pelburg. She wrote \u201cThe Long Way Home\u201d before the Battle of Hakan. Today it stands. On Monday the English won."


def test_entities(spark):
    rows = spark.createDataFrame([("a", TEXT), ("b", None), ("c", ""), (None, "no names here")], "id string, text string").withColumn("label", F.lit(1))
    found = {r["text"]: r["label"] for r in entities.entities(rows, "id", "text").collect()}
    want = {"Vera Low": "PERSON", "Harbour Council": "ORG", "Dover": "GPE", "Old Mill Bridge": "FAC", "River Dane": "LOC", "Pelburg": "GPE", "The Long Way Home": "WORK_OF_ART", "Battle of Hakan": "EVENT"}
    assert want.items() <= found.items() and not {"Today", "Monday", "English", "May", "She"} & set(found)
    words = {r["id"]: r["keywords"] for r in entities.entity_keywords(rows, "id", "text").collect()}
    assert len(words) == 4 and words["b"] == [] and "pelburg" in words["a"] and words["a"] == sorted(set(words["a"]))
    custom = entities.entity_keywords(rows, "id", "text", lambda: lambda text: [("1874", "DATE"), ("Old Quay", "FAC")])
    assert {r["id"]: r["keywords"] for r in custom.collect()}["a"] == ["old_quay"]
