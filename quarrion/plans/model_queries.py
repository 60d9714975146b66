"""Queries of model calls, grades, baselines, thresholds, usage totals, walk records and confusable pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.functions.ids import ordinal_of
from quarrion.operators import asking as A
from quarrion.operators import graph as G
from quarrion.operators import metrics as M
from quarrion.operators import nearmiss as N
from quarrion.operators import retrieval as T
from quarrion.operators.chunking import chunk_alignment as alignment
from quarrion.plans import base as B
from quarrion.plans import graph_queries, metric_queries, retrieval_queries
from quarrion.session import checkpointed, spread, table

Frame = DataFrame
#: Similarity of near-miss questions and depth of the ranking for the wide confusion queries.
WIDE_MAP, WIDE_DEPTH = 0.2, 50


def _gold_pairs(spark: SparkSession, d: str) -> Frame:
    q = B.questions(spark, d).where("question IS NOT NULL").select("question_id", "question")
    p = B.passages(spark, d).where("text IS NOT NULL").select("passage_id", "text")
    return B.gold(spark, d).select("question_id", "passage_id").join(q, "question_id").join(p, "passage_id")


def usefulness_grades(spark: SparkSession, d: str) -> Frame:
    """Grade of each gold passage for its question, by the default grader."""
    rows = A.grade_sentences(_gold_pairs(spark, d), "question", "text")
    return rows.select("question_id", "passage_id", "grade.score", "grade.normalised", "grade.valid", "grade.attempts")


def usefulness_totals(spark: SparkSession, d: str) -> Frame:
    """Sentences, invalid grades and attempts of each question."""
    rows = A.grade_totals(A.grade_sentences(_gold_pairs(spark, d), "question", "text"), "question_id")
    return rows.select("question_id", "sentences", "invalid", "attempts")


def model_answers(spark: SparkSession, d: str) -> Frame:
    """Answers of the default reader over packed passages, with its counters."""
    ranked = retrieval_queries._ranked_texts(spark, d).withColumnRenamed("query_id", "question_id")
    return A.answer_with_model(B.questions(spark, d), ranked, 300, 150)


def random_topk(spark: SparkSession, d: str) -> Frame:
    """Three judged passages of each query by the random scorer, the baseline of a ranking."""
    rows = B.scores(spark, d).select("query_id", "passage_id", (F.pmod(F.coalesce(ordinal_of(F.col("query_id")), F.lit(0)), F.lit(1000003)) * 7919 + F.length("passage_id") * 31 + F.floor(F.col("score") * 1000)).cast("bigint").alias("n"))
    scored = A.random_scores(rows, F.col("n"), 17)
    return T.row_ranks(scored, "query_id", "score", "passage_id", 3).select("query_id", "passage_id", F.round("score", 6).alias("score"), "rank")


def top_partners(spark: SparkSession, d: str) -> Frame:
    """Two best partners of each passage by Jaccard index, then by score."""
    rows = table(spark, d, "scored_pairs").where("jaccard IS NOT NULL AND score IS NOT NULL").groupBy("left_id", "right_id").agg(F.max("jaccard").alias("jaccard"), F.max("score").alias("score"))
    return T.row_ranks(rows, "left_id", ("jaccard", "score"), "right_id", 2).select("left_id", "right_id", "rank")


def tau_confusion(spark: SparkSession, d: str) -> Frame:
    """Confusion counts at the chosen threshold."""
    rows = table(spark, d, "scored_pairs").withColumn("y", (F.col("jaccard") >= 0.7).cast("int"))
    return M.confusion_at(rows, "score", "y", checkpointed(metric_queries.tau_choice(spark, d)))


def _usage(spark: SparkSession, d: str) -> Frame:
    e = table(spark, d, "events")
    return e.select("user_id", "event_type", F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("value").cast("string")).alias("v"), "event_id")


def usage_totals(spark: SparkSession, d: str) -> Frame:
    """Totals of the merged usage log per key, and whether its texts differ."""
    return M.merge_totals(_usage(spark, d), "user_id", "event_type", "v", "event_id")


def usage_rates(spark: SparkSession, d: str) -> Frame:
    """Clicks and purchases for each unit of views, from totals."""
    rates = M.derived_rates(usage_totals(spark, d), "event_type", "view", clicks="click", purchases="purchase")
    return rates.select(*(F.round(c, 4).alias(c) for c in rates.columns))


def percentiles_run(spark: SparkSession, d: str) -> Frame:
    """Medians and 90th percentiles of F1, exact match, tokens, time and tokens a second per variant."""
    rows = metric_queries._judged(spark, d).withColumn("tps", F.try_divide("reader_total_tokens", "wall_time_sec"))
    return M.median_p90(rows, ["f1", "em", "reader_total_tokens", "wall_time_sec", "tps"], "variant")


def answer_rates(spark: SparkSession, d: str) -> Frame:
    """Total, mean and median seconds of all answers, and questions and calls a second."""
    rows = B.results(spark, d).groupBy("question_id").agg(F.sum("wall_time_sec").alias("s"), F.count(F.lit(1)).alias("c")).where("question_id IS NOT NULL")
    times = M.walk_times(rows, "question_id", "s", "c")
    return times.select(*(F.round(c, 4).alias(c) for c in times.columns))


def walk_results(spark: SparkSession, d: str) -> Frame:
    """Record of each query's walk with its measures."""
    starts = graph_queries.seeds(spark, d)
    steps = checkpointed(graph_queries.traverse(spark, d))
    return G.walk_results(steps, starts, graph_queries.hop_gold(spark, d)).withColumn("visited", F.size("visited"))


def walk_hop_metrics(spark: SparkSession, d: str) -> Frame:
    """Precision, recall and F1 of the passages that the walks reach, up to each hop."""
    hops = checkpointed(G.walk_hops(checkpointed(graph_queries.traverse(spark, d)), graph_queries.seeds(spark, d)))
    return M.hop_metrics(hops, graph_queries.hop_gold(spark, d), "query_id")


def pair_confusion_wide(spark: SparkSession, d: str) -> Frame:
    """Near-miss pairs whose gold passages are among the fifty best of each other, for a looser map."""
    top, positives = retrieval_queries._overlap_tops(spark, d, WIDE_DEPTH), retrieval_queries._positives(spark, d)
    return N.pair_confusion(N.confusions_of_sets(top, positives, retrieval_queries._question_sets(spark, d), WIDE_MAP), WIDE_DEPTH)


def top_confused(spark: SparkSession, d: str) -> Frame:
    """The ten most confused of those pairs."""
    return N.top_confused(pair_confusion_wide(spark, d), 10)


def sibling_rows(spark: SparkSession, d: str) -> Frame:
    """Siblings of every query question: the others of its dataset."""
    labels = N.label_sets(B.questions(spark, d), "question_id", "question", F.col("dataset"))
    return N.siblings_of(labels, labels.where(B.is_query(F.col("id"))).select("id"))


def chunk_alignment(spark: SparkSession, d: str) -> Frame:
    """Sentence range of every discourse-aware chunk and whether its ends are those of sentences."""
    return alignment(spread(table(spark, d, "documents")), None, "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        usefulness_grades, usefulness_totals, model_answers, random_topk, top_partners, tau_confusion, usage_totals, usage_rates, percentiles_run,
        answer_rates, walk_results, walk_hop_metrics, pair_confusion_wide, top_confused, sibling_rows, chunk_alignment,
    )
}

_GRADES = f"""{B.Q}, {B.P}, {B.G},
x AS (SELECT g.question_id, g.passage_id, {B.TOKENS.format(x='question')} AS want, {B.TOKENS.format(x='text')} AS have
    FROM g JOIN q USING (question_id) JOIN p USING (passage_id) WHERE question IS NOT NULL AND text IS NOT NULL),
gr AS (SELECT question_id, passage_id, CAST(5 * len(list_intersect(want, have)) // greatest(1, len(want)) AS INT) AS score FROM x)"""
_WIDE = f"WITH {retrieval_queries._RANKED}, {retrieval_queries._MAP.replace('>= 0.6', f'>= {WIDE_MAP}')}, {retrieval_queries._CONFUSED.replace('k.rank <= 5', f'k.rank <= {WIDE_DEPTH}')}"
_WIDE += f", pc AS (SELECT query_id, neighbour, count(*) AS hits, round(count(*) / {WIDE_DEPTH}, 6) AS hit_rate FROM cf GROUP BY 1, 2)"
_TOTALS = """u AS (SELECT user_id, event_type, event_id, CASE WHEN event_type = 'error' THEN props ELSE CAST(value AS VARCHAR) END AS v FROM events),
m AS (SELECT user_id, event_type, round(sum(try_cast(v AS DOUBLE)), 6) AS total, arg_max(v, event_id) FILTER (try_cast(v AS DOUBLE) IS NULL AND v IS NOT NULL) AS t FROM u GROUP BY 1, 2),
tt AS (SELECT event_type, count(*) AS queries, round(sum(total), 6) AS total, arg_min(t, user_id) FILTER (t IS NOT NULL) AS first_text, coalesce(min(t) <> max(t), false) AS conflict FROM m GROUP BY 1)"""
_SCORES = f"""{B.S}, n AS (SELECT query_id, passage_id, (coalesce(CAST(nullif(regexp_extract(query_id, '([0-9]{{1,18}})$', 1), '') AS BIGINT), 0) * 7919
    + length(passage_id) * 31 + CAST(floor(score * 1000) AS BIGINT)) AS n FROM s)"""
_TIMES = f"{B.R}, x AS (SELECT question_id, sum(wall_time_sec) AS s, count(*) AS c FROM r WHERE question_id IS NOT NULL GROUP BY 1)"

_GOLD = "gd AS (SELECT DISTINCT query_id, passage_id FROM t WHERE rank <= 3), gn AS (SELECT query_id, count(*) AS n FROM gd GROUP BY 1)"
_RATIOS = "round(p, {d}) AS precision, round(r, {d}) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), {d}) AS f1"

ORACLE_SQL = {
    "walk_results": f"""WITH RECURSIVE {graph_queries.WALK}, {_GOLD}, vs AS (SELECT query_id, src AS p FROM s0 WHERE src IS NOT NULL UNION SELECT query_id, dst FROM wk),
        v AS (SELECT vs.query_id, count(*) AS visited, count(gd.passage_id) AS hits FROM vs LEFT JOIN gd ON gd.query_id = vs.query_id AND gd.passage_id = vs.p GROUP BY 1),
        k AS (SELECT query_id, count(*) AS steps, count(*) FILTER (repeat) AS repeats, max(hop) + 1 AS hops FROM wk GROUP BY 1),
        x AS (SELECT query_id, visited, coalesce(steps, 0) AS steps, coalesce(repeats, 0) AS repeats, coalesce(hops, 0) AS hops, hits / visited AS p, coalesce(hits / nullif(n, 0), 0) AS r
              FROM v LEFT JOIN k USING (query_id) LEFT JOIN gn USING (query_id))
        SELECT query_id, visited, steps, repeats, hops, {_RATIOS.format(d=6)} FROM x""",
    "walk_hop_metrics": f"""WITH RECURSIVE {graph_queries.WALK}, {_GOLD}, nw AS (SELECT DISTINCT query_id, hop, dst FROM wk WHERE NOT repeat),
        hs AS (SELECT DISTINCT query_id, 0 AS hop FROM s0 WHERE src IS NOT NULL UNION SELECT query_id, hop FROM nw),
        c AS (SELECT hs.query_id, hs.hop, gn.n, (SELECT count(*) FROM nw WHERE nw.query_id = hs.query_id AND nw.hop <= hs.hop) AS seen,
              (SELECT count(*) FROM nw JOIN gd ON gd.query_id = nw.query_id AND gd.passage_id = nw.dst WHERE nw.query_id = hs.query_id AND nw.hop <= hs.hop) AS hits FROM hs JOIN gn USING (query_id)),
        x AS (SELECT query_id, hop, coalesce(hits / nullif(seen, 0), 0) AS p, coalesce(hits / nullif(n, 0), 0) AS r FROM c)
        SELECT query_id, hop, {_RATIOS.format(d=4)} FROM x""",
    "usefulness_grades": f"WITH {_GRADES} SELECT question_id, passage_id, score, score / 5 AS normalised, true AS valid, 1 AS attempts FROM gr",
    "usefulness_totals": f"WITH {_GRADES} SELECT question_id, count(*) AS sentences, 0 AS invalid, count(*) AS attempts FROM gr GROUP BY 1",
    "random_topk": f"""WITH {_SCORES}, y AS (SELECT query_id, passage_id, ((n * 2654435761 + 17) % 1000003 + 1000003) % 1000003 / 1000003.0 AS z FROM n),
        t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY z DESC, passage_id) AS rank FROM y)
        SELECT query_id, passage_id, round(z, 6) AS score, rank FROM t WHERE rank <= 3""",
    "top_partners": """WITH x AS (SELECT left_id, right_id, max(jaccard) AS j, max(score) AS s FROM scored_pairs WHERE jaccard IS NOT NULL AND score IS NOT NULL GROUP BY 1, 2)
        SELECT * FROM (SELECT left_id, right_id, row_number() OVER (PARTITION BY left_id ORDER BY j DESC, s DESC, right_id) AS rank FROM x) WHERE rank <= 2""",
    "tau_confusion": f"""WITH p AS (SELECT score, jaccard >= 0.7 AS y FROM scored_pairs WHERE score IS NOT NULL AND jaccard IS NOT NULL),
        g AS (SELECT k, round(0.3 + k * 0.0075, 4) AS tau FROM (SELECT unnest(range(0, 81)) AS k)),
        s AS (SELECT k, tau, count(*) FILTER (score >= tau AND y) AS tp, count(*) FILTER (score >= tau AND NOT y) AS fp, count(*) FILTER (score < tau AND y) AS fn,
              count(*) FILTER (score < tau AND NOT y) AS tn FROM g, p GROUP BY 1, 2),
        r AS (SELECT *, tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS re FROM s),
        c AS (SELECT * FROM r ORDER BY CASE WHEN round(pr, 6) >= 0.8 THEN 0 ELSE 1 END, CASE WHEN round(pr, 6) >= 0.8 THEN 0 ELSE -pr END, k LIMIT 1)
        SELECT tau, tp, fp, fn, tn, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM c""",
    "usage_totals": f"WITH {_TOTALS} SELECT * FROM tt",
    "usage_rates": f"""WITH {_TOTALS}, y AS (SELECT coalesce(sum(total) FILTER (event_type = 'view'), 0) AS s, coalesce(sum(total) FILTER (event_type = 'click'), 0) AS c,
        coalesce(sum(total) FILTER (event_type = 'purchase'), 0) AS p FROM tt)
        SELECT round(s, 4) AS seconds, round(c, 4) AS clicks, round(p, 4) AS purchases, round(CASE WHEN s > 0 THEN c / s ELSE 0 END, 4) AS clicks_per_second,
        round(CASE WHEN s > 0 THEN p / s ELSE 0 END, 4) AS purchases_per_second FROM y""",
    "percentiles_run": f"""WITH {metric_queries._JUDGED}, y AS (SELECT *, reader_total_tokens / nullif(wall_time_sec, 0) AS tps FROM j) SELECT variant, """
    + ", ".join(f"round(quantile_cont({c}::DOUBLE, {share}), 6) AS {name}_{c}" for c in ("f1", "em", "reader_total_tokens", "wall_time_sec", "tps") for name, share in (("median", 0.5), ("p90", 0.9)))
    + " FROM y GROUP BY 1",
    "answer_rates": f"""WITH {_TIMES} SELECT round(sum(s), 4) AS total_seconds, round(avg(s), 4) AS mean_seconds, round(count(s) / sum(s), 4) AS qps, round(sum(c) / sum(s), 4) AS cps,
        round(median(s), 4) AS median_seconds FROM x""",
    "pair_confusion_wide": f"{_WIDE} SELECT * FROM pc",
    "top_confused": f"{_WIDE} SELECT * FROM pc ORDER BY hits DESC, query_id, neighbour LIMIT 10",
    "sibling_rows": f"""WITH {B.Q}, c AS (SELECT question_id AS id, coalesce(nullif(trim(dataset), ''), 'uncategorized') AS cat FROM q WHERE question_id IS NOT NULL),
        a AS (SELECT question_id AS id FROM q WHERE {B.IS_QUERY})
        SELECT x.id, y.id AS sibling FROM a JOIN c x USING (id) JOIN c y ON x.cat = y.cat AND x.id <> y.id""",
}
