"""Hand-computed cases of the surprising rules, and edge cases, of the core operators."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quarrion.functions import text as X
from quarrion.operators import examples as E
from quarrion.operators import graph as G
from quarrion.operators import ingest
from quarrion.operators import metrics as M
from quarrion.operators import nearmiss as N
from quarrion.operators import report as P
from quarrion.operators import retrieval as R
from quarrion.operators import selection as C
from quarrion.operators.components import connected_components
from quarrion.schemas import SCHEMAS, schema
from quarrion.sources import readers, sinks
from quarrion.streaming.incremental import stream_chunks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def test_text(spark):
    lit = F.lit
    assert one(spark, X.clean_text(lit("A<b>B</b>|C [[x]] {{y}} == h == D"))) == "A B C D"
    assert one(spark, X.clean_text(lit("<nowiki>k</nowiki> ﬁ"))) == "k fi"
    assert one(spark, X.safe_title(lit("--"))) == "no_title" and one(spark, X.safe_title(lit("A & B!"))) == "a_b"
    assert one(spark, X.normalise_keyword(lit("Café's Déjà & Vu"))) == "cafe_deja_and_vu"
    assert one(spark, X.canonical_keyword(lit("us"))) == "united_states" and one(spark, X.canonical_keyword(lit("1999"))) is None
    assert one(spark, X.normalise_answer(lit("The  Cat, a dog."))) == "cat dog"
    assert one(spark, X.estimate_tokens(lit("a b c"))) == 4 and one(spark, X.estimate_tokens(lit(""))) == 0
    assert one(spark, X.truncate_words(lit(" a  b c"), 2)) == "a b" and one(spark, X.truncate_words(lit("a  b"), 2)) == "a  b"
    assert one(spark, X.final_answer(lit("answer: x\nFinal answer: y z "))) == "y z"
    assert one(spark, X.first_fragment(lit(".\n b. c"))) == "b"
    assert one(spark, X.accept_answer(lit("x x x x"))) is None and one(spark, X.accept_answer(lit("x x x"))) == "x x x"
    assert one(spark, X.clean_tokens(F.array(lit("unknown"), lit("a"), lit("a")))) == ["a"]
    assert one(spark, X.strip_think(lit("<think>a\nb</think> c"))) == "c" and one(spark, X.strip_think(lit("<THINK> c"))) == "c"
    assert tuple(one(spark, X.parse_score(lit(" 4 "), 0, 5))) == (4, False)
    assert tuple(one(spark, X.parse_score(lit("score -7"), 0, 5))) == (0, True)
    assert tuple(one(spark, X.parse_score(lit("none"), 0, 5))) == (None, True)
    assert tuple(one(spark, X.parse_labelled(lit("(b) - Only x")))) == ("B", "Only x") and one(spark, X.parse_labelled(lit("x"))) is None
    assert one(spark, X.truncating_int(lit("2.9"))) == 2 and one(spark, X.truncating_int(lit("x"))) is None
    got = one(spark, X.parse_variant(lit("da_exit_discourse_aware_chunks_standard_sentences_hybrid_k20_s5")))
    assert tuple(got) == ("DA_EXIT", "hybrid", 20, 5, "discourse_aware_chunks", "standard_sentences")


def test_greedy_passes_over_packing_stops(spark):
    rows = spark.createDataFrame([("q", 1, 5), ("q", 2, 7), ("q", 3, 3), ("q", 4, 2), ("q", 5, 1)], "q string, rank int, size int")
    assert sorted(r["rank"] for r in C.greedy_budget(rows, "q", "rank", "size", 10).collect()) == [1, 3, 4]
    assert C.greedy_budget(rows, "q", "rank", "size", 0).count() == 0
    texts = spark.createDataFrame([("q", 1, "a b c"), ("q", 2, "a " * 50), ("q", 3, "x")], "q string, rank int, text string")
    assert [r["rank"] for r in C.pack_passages(texts, "q", "rank", "text", 20).collect()] == [1]
    first = C.pack_passages(texts.where("rank = 2"), "q", "rank", "text", 12).collect()
    assert len(first) == 1 and first[0]["truncated"] and first[0]["text"] == " ".join(["a"] * 10)


def test_min_max_and_ties(spark):
    rows = spark.createDataFrame([("q", "b", 1.0), ("q", "a", 1.0)], "q string, d string, s double")
    assert [r[0] for r in rows.select(R.min_max("s", "q")).collect()] == [0.0, 0.0]
    assert [r["d"] for r in R.row_ranks(rows, "q", "s", "d").orderBy("rank").collect()] == ["a", "b"]


def test_sparse_pool_has_zero_scores(spark):
    docs = spark.createDataFrame([(1, ["x"]), (2, ["y"]), (3, []), (4, ["x", "y"])], "doc_id int, keywords array<string>")
    q = spark.createDataFrame([("q", ["x"])], "query_id string, keywords array<string>")
    got = R.sparse_topk(q, docs, 3).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [1, 4, 2] and got[2]["score"] == 0.0


def test_ndcg_and_recall_rules(spark):
    rows = spark.createDataFrame([("q", 1, 0), ("q", 2, 1)], "q string, rank int, rel int")
    assert round(M.ndcg(rows, "q", "rank", "rel").collect()[0]["ndcg"], 4) == 0.6309
    assert M.ndcg(rows.where("rel = 0"), "q", "rank", "rel").collect()[0]["ndcg"] == 0.0
    pair = F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("a"))
    assert one(spark, M.recall_at(*pair, 5)) == 0.5 and one(spark, M.precision_at(*pair, None)) == 0.5


def test_answer_scores(spark):
    assert one(spark, M.token_f1(F.lit("the a a"), F.lit("an"))) == 1.0
    assert one(spark, M.token_f1(F.lit("x x y"), F.lit("x z"))) == pytest.approx(0.4)
    best = one(spark, M.best_over_golds(F.lit("Cat."), F.array(F.lit("dog"), F.lit("the cat"))))
    assert tuple(best) == (1.0, 1.0)
    assert tuple(one(spark, M.best_over_golds(F.lit(" "), F.array(F.lit("the"))))) == (0.0, 0.0)


def test_threshold_choice(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.4, 1)], "p double, y int")
    assert M.choose_threshold(M.threshold_sweep(rows, "p", "y")).collect()[0]["precision"] == 1.0
    none = M.choose_threshold(M.threshold_sweep(rows.where("y = 0"), "p", "y")).collect()[0]
    assert (none["tau"], none["f1"]) == (0.5, -1.0)
    assert M.choose_threshold(M.threshold_sweep(rows.limit(0), "p", "y")).collect()[0]["tau"] == 0.5


def test_wilcoxon_ties(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (0.0, 1.0), (3.0, 0.0), (2.0, 2.0)], "a double, b double")
    got = M.wilcoxon(rows, "a", "b").collect()[0]
    assert (got["pairs"], got["w_plus"], got["w_minus"], got["w"]) == (3, 4.5, 1.5, 1.5)


def test_near_miss(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("a", "z")], "a string, b string")
    catalog = spark.createDataFrame([("a",), ("b",)], "id string")
    mapped, unknown = N.near_miss_map(pairs, catalog)
    assert sorted(map(tuple, mapped.collect())) == [("a", "b"), ("b", "a")] and [r[0] for r in unknown.collect()] == ["z"]
    labels = spark.createDataFrame([(1, "alpha beta", " "), (2, "Beta alpha", None), (3, "gamma", "x")], "id int, t string, c string")
    sets = N.label_sets(labels, "id", "t", F.col("c"))
    assert [tuple(r)[:2] for r in N.shared_term_pairs(sets, 0.6, within=True).collect()] == [(1, 2)]
    scored = N.score_pairs(N.shared_term_pairs(sets, 0.6), sets).collect()[0]
    assert scored["jaccard"] == 1.0 and 0 < scored["seq_ratio"] < 1


def test_examples_have_one_label(spark):
    judged = spark.createDataFrame([("q", "d1", 4), ("q", "d2", 0), ("r", "d2", 3), ("r", "d3", 4), ("s", "d4", 1)], "query_id string, doc_id string, score int")
    mapped = spark.createDataFrame([("q", "r")], "id string, neighbour string")
    got = {(r["query_id"], r["doc_id"]): r["label_type"] for r in E.retriever_examples(judged, mapped).collect()}
    assert got == {("q", "d1"): "pos", ("q", "d2"): "easy", ("q", "d3"): "near_miss", ("r", "d2"): "pos", ("r", "d3"): "pos"}


def test_shards_and_batches(spark):
    rows = spark.range(10).select(F.col("id"), (F.col("id") < 3).alias("y"))
    got = {r["id"]: r["shard"] for r in E.shards(rows, "id", 4).collect()}
    assert [list(got.values()).count(k) for k in range(4)] == [3, 3, 2, 2] and got[0] == 0 and got[9] == 3
    batches = E.minibatches(rows, F.col("y"), F.col("id"), "id", 4, 1).groupBy("batch").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("int")).alias("p")).collect()
    assert len(batches) == 3 and all(b["p"] == 1 and b["n"] <= 4 for b in batches)


def test_traverse_counts_repeats(spark):
    edges = spark.createDataFrame([("a", "b", "1", 0.5), ("b", "a", "1", 0.1), ("c", "b", "1", 0.2), ("b", "d", "2", 0.9)], "src string, dst string, oq_id string, conditioned_score double")
    seeds = spark.createDataFrame([("q", "a", 0), ("q", "c", 1)], "query_id string, src string, place int")
    steps = [(r["hop"], r["src"], r["dst"], r["repeat"]) for r in G.traverse(seeds, edges, 3).orderBy("hop", "src", "dst").collect()]
    assert steps == [(0, "a", "b", False), (0, "c", "b", True), (1, "b", "a", True)]
    assert {(r["node"], r["hop"]) for r in G.reachable(seeds, edges, 2).collect()} == {("a", 0), ("c", 0), ("b", 1), ("d", 2)}


def test_components(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)], "a int, b int")
    got = {r["node"]: r["component"] for r in connected_components(path).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100
    assert connected_components(path.limit(0)).count() == 0


def test_reports(spark):
    assert one(spark, P.percent_delta(F.lit(1.0), F.lit(0.0))) is None and one(spark, P.percent_delta(F.lit(1.0), F.lit(2.0), True)) == 50.0
    rows = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (3.0, 5.0), (4.0, None)], "x double, y double")
    assert sorted((r["x"], r["y"]) for r in P.pareto_front(rows, "x", "y").collect()) == [(1.0, 2.0), (3.0, 5.0)]
    assert [r[0] for r in P.column_shares(rows.select(F.lit(3.0).alias("c")), ["c"]).limit(1).collect()] == [0.5]


def test_sources(spark, tmp_path):
    lines = tmp_path / "a.jsonl"
    lines.write_text('{"a":"x","b":"y"}\n\nnot json\n{"a":"z"\n')
    assert [tuple(r) for r in readers.read_jsonl(spark, str(lines), "a string, b string").collect()] == [("x", "y")]
    qrels = tmp_path / "q.tsv"
    qrels.write_text("query-id\tcorpus-id\tscore\nq\td\t2.9\nq\te\tx\n \td\t1\n")
    assert [tuple(r) for r in readers.read_qrels(spark, str(qrels)).collect()] == [("q", "d", 2)]
    assert readers.parse_pairs({"pairs": [["a", "b"], {"a": "c", "b": " d "}, ["x", "x"], ["a", "b"], ["", "y"]]}) == [("a", "b"), ("c", "d")]
    assert readers.parse_pairs({"a": ["b", "c"], "d": "e"}) == [("a", "b"), ("a", "c"), ("d", "e")]
    summary = tmp_path / "runs" / "ds" / "dev"
    summary.mkdir(parents=True)
    (summary / "summary_metrics_x.json").write_text(json.dumps({"meta": {"v": "k"}, "accuracy": {"f1": 0.5, "v": "last"}}))
    got = readers.read_summaries(spark, str(tmp_path / "runs"), readers.T.StructType.fromDDL("meta struct<v:string>, accuracy struct<f1:double,v:string>"))
    assert readers.flatten_sections(got, ["meta", "accuracy"]).collect()[0].asDict() == {"dataset": "ds", "split": "dev", "v": "last", "f1": 0.5}
    pages = spark.createDataFrame([("p", "", "0\tHello.\n1\t\nx\ty")], schema("wiki_pages"))
    assert [tuple(r) for r in readers.wiki_sentences(pages).collect()] == [("p", 0, "Hello.")]
    claims = spark.createDataFrame([(1, "c", "l", "v", [[["1", "2", "P", "3"], ["1", "2"]], [["1", "2", "P", "3"], ["1", "2", None, "0"]]])], schema("claims"))
    assert readers.flat_evidence(claims).collect()[0]["gold"] == ["P_sent3"]
    assert all(schema(name) for name in SCHEMAS)


def test_ingest(spark):
    raw = spark.createDataFrame(
        [("q1", "Who?", "Ann", [("A b", ["One.", "Two <b>x</b>."]), ("--", ["Three.", " "])], [("A b", 1), ("--", 0), ("gone", 3)])], schema("nested_context")
    )
    tables = ingest.ingest_contexts(raw, "ds", "dev")
    q = tables["questions"].collect()[0]
    assert q["gold_passages"] == ["q1__no_title_sent0", "q1__a_b_sent1"] and q["gold_passages_full"] == ["q1__no_title_full", "q1__a_b_full"]
    assert {r["passage_id"]: r["text"] for r in tables["full_passages"].collect()} == {"q1__a_b_full": "One. Two x .", "q1__no_title_full": "Three."}
    assert tables["passages"].count() == 3 and tables["chunks"].count() == 2 and tables["discourse_chunks"].count() == 2
    queries = spark.createDataFrame([("c1", "cap", "Dev"), ("c2", "tax", "train"), ("c3", "all", None)], "query_id string, text string, split string")
    corpus = spark.createDataFrame([("d1", "One."), ("d2", "word " * 300)], "doc_id string, text string")
    qrels = spark.createDataFrame([("c1", "d1", 4), ("c1", "d1", 1), ("c1", "zz", 4), ("c2", "d2", 3), ("c3", "d2", 2)], "query_id string, doc_id string, score int")
    clause = ingest.ingest_clauses(queries, corpus, qrels, "dev")
    assert {r["query_id"]: [tuple(x) for x in r["qrels"]] for r in clause["questions"].collect()} == {"c1": [("d1", 4, "pos")], "c3": [("d2", 2, "hard")]}
    assert [r["query_id"] for r in clause["packages"].collect()] == ["c1"]
    assert {r["passage_id"] for r in clause["chunks"].collect()} >= {"d1", "d2__chunk0", "d2__chunk1"}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    out = str(tmp_path / "t")
    assert sinks.write_jsonl(rows, out, "versioned") == out and sinks.write_jsonl(rows, out, "versioned") == out + ".v2"
    assert [r["k"] for r in sinks.unprocessed(rows, rows, "k", "v").collect()] == ["b"]
    assert sinks.append_unprocessed(rows, str(tmp_path / "p"), "k") == 2 and sinks.append_unprocessed(rows, str(tmp_path / "p"), "k") == 0
    assert [sinks.model_shards(m) for m in ("x-7b", "x-19B", "x-70b", "x")] == [4, 2, 1, 1]


def test_incremental_ingest_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("a", "t", "One. Two."), ("b", "t", "Three."), ("a", "t", "One. Two."), ("c", "t", None)], "passage_id string, title string, text string")
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows.write.parquet(source)
    for _ in range(2):
        stream_chunks(spark, source, rows.schema, target, state).awaitTermination()
    assert sorted(r["passage_id"] for r in spark.read.parquet(target).collect()) == ["a__chunk0", "b__chunk0"]
    spark.createDataFrame([("d", "t", "Four.")], rows.schema).write.mode("append").parquet(source)
    stream_chunks(spark, source, rows.schema, target, state).awaitTermination()
    assert spark.read.parquet(target).count() == 3
