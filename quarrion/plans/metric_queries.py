"""Queries of retrieval, answer, classifier, usage and time measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrion.functions.ids import passage_of
from quarrion.operators import metrics as M
from quarrion.operators.retrieval import row_ranks
from quarrion.plans import base as B
from quarrion.session import checkpointed, table

Frame = DataFrame


def _retrieved(spark: SparkSession, d: str) -> Frame:
    """(question_id, units): chunk ids of the ten best rows of each query, best first."""
    rows = table(spark, d, "retrieval_scores").where("score IS NOT NULL AND NOT isnan(score)").select("query_id", "chunk_id", "score").distinct()
    top = row_ranks(rows, "query_id", "score", "chunk_id", 10)
    lists = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("x"))
    return lists.select(F.col("query_id").alias("question_id"), F.transform("x", lambda x: x["chunk_id"]).alias("units"))


def hits_recall_precision(spark: SparkSession, d: str) -> Frame:
    """Hits, recall and precision of retrieved passages against the gold list, repeats in it included."""
    q = B.questions(spark, d).select("question_id", F.filter(F.coalesce("gold_passages_full", F.array()), lambda x: x.isNotNull()).alias("gold"))
    rows = _retrieved(spark, d).join(q, "question_id").withColumn("got", M.passages_of(F.col("units")))
    got, gold = F.col("got"), F.col("gold")
    return rows.select(
        "question_id",
        M.hits_at(got, gold, 5).alias("hits_5"),
        F.round(M.recall_at(got, gold, 5), 6).alias("recall_5"),
        F.round(M.precision_at(got, gold, 5), 6).alias("precision_5"),
        F.round(M.precision_at(got, gold, None), 6).alias("precision_all"),
    )


def _first_hits(spark: SparkSession, d: str) -> Frame:
    rows = table(spark, d, "retrieval_scores").where("score IS NOT NULL AND NOT isnan(score)").select("query_id", "chunk_id", "score").distinct()
    scored = rows.select(F.col("query_id").alias("question_id"), F.col("chunk_id").alias("item"), "score")
    gold = B.gold(spark, d).select("question_id", F.col("passage_id").alias("gold"))
    return M.first_hit_ranks(scored, gold, "question_id")


def first_hit_ranks(spark: SparkSession, d: str) -> Frame:
    """Rank of the first retrieved chunk of a gold passage."""
    return _first_hits(spark, d)


def recall_curve(spark: SparkSession, d: str) -> Frame:
    """Share of questions with a gold passage among the first k, for k up to 20."""
    return M.recall_curve(_first_hits(spark, d), B.questions(spark, d).select("question_id"), 20)


def _judged(spark: SparkSession, d: str) -> Frame:
    """Answers with their gold answer's exact match and F1."""
    q = B.questions(spark, d).select("question_id", F.col("gold_answer").alias("gold"))
    rows = B.results(spark, d).join(q, "question_id").where("gold IS NOT NULL")
    best = M.best_over_golds(F.col("raw_answer"), F.array("gold"))
    return rows.withColumn("m", best).select("*", "m.em", "m.f1").drop("m")


def exact_match_f1(spark: SparkSession, d: str) -> Frame:
    """Exact match and token F1 of every answer."""
    return _judged(spark, d).select("result_id", "em", F.round("f1", 6).alias("f1"))


def mean_em_f1(spark: SparkSession, d: str) -> Frame:
    """Mean exact match and F1 per variant, in percent."""
    return _judged(spark, d).groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("em") * 100, 4).alias("em"), F.round(F.avg("f1") * 100, 4).alias("f1")
    )


def binary_f1_confusion(spark: SparkSession, d: str) -> Frame:
    """Confusion counts of claim verdicts per variant."""
    rows = _judged(spark, d).withColumn("g", F.lower(F.trim("gold"))).where("g IN ('supported', 'refuted')")
    return M.confusion(rows, F.coalesce("normalised_answer", F.lit("")).contains("supported"), F.col("g") == "supported", "variant")


def tau_sweep(spark: SparkSession, d: str) -> Frame:
    """Precision and F1 of scored pairs at 81 thresholds; a pair of Jaccard index 0.7 or more is positive."""
    rows = table(spark, d, "scored_pairs").withColumn("y", (F.col("jaccard") >= 0.7).cast("int"))
    return M.threshold_sweep(rows, "score", "y")


def tau_choice(spark: SparkSession, d: str) -> Frame:
    """The threshold chosen from that sweep for a precision of 0.8."""
    return M.choose_threshold(tau_sweep(spark, d))


def label_balance(spark: SparkSession, d: str) -> Frame:
    """Exact matches and others per dataset, and the weight of a match."""
    return M.label_balance(_judged(spark, d), F.col("em") == 1, "dataset")


def _hops(spark: SparkSession, d: str) -> tuple[Frame, Frame]:
    from quarrion.plans.graph_queries import hop_log, hop_gold

    return checkpointed(hop_log(spark, d)), hop_gold(spark, d)


def hop_metrics(spark: SparkSession, d: str) -> Frame:
    """Precision, recall and F1 of the passages new up to each hop."""
    return M.hop_metrics(*_hops(spark, d), "query_id")


def traversal_summary(spark: SparkSession, d: str) -> Frame:
    """Means and counts over all walks."""
    hops, gold = _hops(spark, d)
    visits = table(spark, d, "retrieval_scores").groupBy("query_id", passage_of(F.col("chunk_id")).alias("passage")).agg(F.count(F.lit(1)).alias("visits"))
    return M.traversal_summary(hops, gold, visits, "query_id")


def log_loss(spark: SparkSession, d: str) -> Frame:
    """Weighted log loss of the older run's scores for pairs of Jaccard index 0.7 or more."""
    rows = table(spark, d, "scored_pairs").withColumn("y", (F.col("jaccard") >= 0.7).cast("int"))
    return M.weighted_log_loss(rows, "score", "y", 3.0)


def gold_attention(spark: SparkSession, d: str) -> Frame:
    """Share of retrieval rows that are of gold passages."""
    visits = table(spark, d, "retrieval_scores").groupBy("query_id", passage_of(F.col("chunk_id")).alias("passage")).agg(F.count(F.lit(1)).alias("visits"))
    gold = B.gold(spark, d).groupBy(F.col("question_id").alias("query_id")).agg(F.collect_set("passage_id").alias("gold"))
    return M.gold_attention(visits, gold, "query_id")


def first_gold_hop(spark: SparkSession, d: str) -> Frame:
    """The hop at which the first gold passage was reached."""
    return M.first_gold_hop(*_hops(spark, d), "query_id")


def hop_depth_histogram(spark: SparkSession, d: str) -> Frame:
    """How deep the walks went."""
    return M.depth_histogram(_hops(spark, d)[0], "query_id")


def usage_merge(spark: SparkSession, d: str) -> Frame:
    """Sums of numeric event values per user and type, and the last that is text."""
    value = F.when(F.col("event_type") == "error", F.col("props")).otherwise(F.col("value").cast("string"))
    log = table(spark, d, "events").select("user_id", "event_type", "event_id", value.alias("v"))
    return M.merge_usage(log, "user_id", "event_type", "v", "event_id")


def usage_full_outer(spark: SparkSession, d: str) -> Frame:
    """Usage of two phases per user, of either or both."""
    e = table(spark, d, "events")
    phase = lambda t: e.where(F.col("event_type") == t).groupBy("user_id").agg(F.round(F.sum("value"), 6).alias(t), F.count(F.lit(1)).alias(f"n_{t}"))
    return phase("view").join(phase("signup"), "user_id", "full_outer").fillna(0)


def percentiles(spark: SparkSession, d: str) -> Frame:
    """Medians and 90th percentiles of time and tokens per variant."""
    return M.median_p90(B.results(spark, d), ["wall_time_sec", "reader_total_tokens"], "variant")


def throughput(spark: SparkSession, d: str) -> Frame:
    """Tokens, queries and calls a second per variant."""
    sums = B.results(spark, d).groupBy("variant").agg(
        F.sum("reader_total_tokens").alias("t"), F.countDistinct("question_id").alias("q"), F.count(F.lit(1)).alias("c"), F.sum("wall_time_sec").alias("s")
    )
    return sums.select("variant", M.throughput(F.col("t"), F.col("q"), F.col("c"), F.coalesce("s", F.lit(0.0))).alias("x")).select("variant", "x.*")


def reader_timing(spark: SparkSession, d: str) -> Frame:
    """Total, mean and median time per variant and reader, and time per question and answer."""
    s = F.sum("wall_time_sec")
    rows = B.results(spark, d)
    medians = M.exact_quantiles(rows, ["wall_time_sec"], {"median": 0.5}, "variant", "reader_model").withColumnRenamed("median_wall_time_sec", "median")
    sums = rows.groupBy("variant", "reader_model").agg(
        F.round(s, 4).alias("total"),
        F.round(F.avg("wall_time_sec"), 6).alias("mean"),
        F.round(F.coalesce(F.try_divide(s * 1000, F.countDistinct("question_id")), F.lit(0.0)), 4).alias("ms_per_question"),
        F.round(F.coalesce(F.try_divide(s * 1000, F.count(F.lit(1))), F.lit(0.0)), 4).alias("ms_per_answer"),
    )
    return sums.join(medians, ["variant", "reader_model"])


def wilcoxon_w(spark: SparkSession, d: str) -> Frame:
    """Signed-rank statistic of two variants' times on the same questions, per dataset."""
    r = B.results(spark, d)
    time = lambda v, n: r.where(F.col("variant") == v).groupBy("dataset", "question_id").agg(F.round(F.avg("wall_time_sec"), 6).alias(n))
    paired = time("baseline_dense_k20", "a").join(time("baseline_hybrid_k20", "b"), ["dataset", "question_id"])
    return M.wilcoxon(paired, "a", "b", "dataset")


def windowed_counts(spark: SparkSession, d: str) -> Frame:
    """Events per hour and type."""
    from quarrion.streaming.incremental import windowed_counts as counts

    return counts(table(spark, d, "events"), "ts", "event_type", "value", "1 hour", "1 hour")


def running_usage(spark: SparkSession, d: str) -> Frame:
    """Running totals of a user's events in time order."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, d, "events")
    return e.select("event_id", F.round(F.sum("value").over(order), 4).alias("running"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        hits_recall_precision, first_hit_ranks, recall_curve, exact_match_f1, mean_em_f1, binary_f1_confusion, tau_sweep, tau_choice,
        label_balance, hop_metrics, traversal_summary, log_loss, gold_attention, first_gold_hop, hop_depth_histogram, usage_merge, usage_full_outer,
        percentiles, throughput, reader_timing, wilcoxon_w, windowed_counts, running_usage,
    )
}

_C = r"regexp_replace(regexp_replace({x}, '__sent[0-9]+$', ''), '__chunk[0-9]+$', '')"
_RAW = """c AS (SELECT query_id AS question_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT DISTINCT query_id, chunk_id, score FROM retrieval_scores WHERE score IS NOT NULL AND NOT isnan(score)))"""


def _answer(x: str) -> str:
    plain = rf"regexp_replace(lower({x}), '[!-/:-@\[-`{{-~]', '', 'g')"
    return f"list_filter(regexp_split_to_array({plain}, '{B.WS}+'), lambda w: w NOT IN ('a', 'an', 'the', ''))"


_JUDGED = f"""{B.Q}, {B.R}, j0 AS (SELECT r.*, q.gold_answer AS gold FROM r JOIN q USING (question_id) WHERE q.gold_answer IS NOT NULL),
j1 AS (SELECT *, coalesce({_answer('raw_answer')}, []) AS pa, coalesce({_answer('gold')}, []) AS ga, coalesce(trim(raw_answer) <> '', false) AS said FROM j0),
j2 AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(pa), lambda w: least(len(list_filter(pa, lambda x: x = w)), len(list_filter(ga, lambda x: x = w))))), 0) AS common FROM j1),
j AS (SELECT *, CASE WHEN NOT said THEN 0.0 WHEN pa = ga THEN 1.0 ELSE 0.0 END AS em,
  CASE WHEN NOT said THEN 0.0 WHEN len(pa) = 0 AND len(ga) = 0 THEN 1.0 WHEN common = 0 THEN 0.0 ELSE 2.0 * common / (len(pa) + len(ga)) END AS f1 FROM j2)"""
_SWEEP = """sw AS (SELECT t.step, round(0.3 + t.step * 0.0075, 4) AS tau,
  count(*) FILTER (y = 1 AND (score >= 0.3 AND least(floor((score - 0.3) / 0.0075 + 1e-9), 80) >= t.step)) AS tp,
  count(*) FILTER (y = 0 AND (score >= 0.3 AND least(floor((score - 0.3) / 0.0075 + 1e-9), 80) >= t.step)) AS fp, count(*) FILTER (y = 1) AS pos
  FROM (SELECT CAST(unnest(range(0, 81)) AS INT) AS step) t, (SELECT score, CAST(jaccard >= 0.7 AS INT) AS y FROM scored_pairs WHERE score IS NOT NULL AND jaccard IS NOT NULL) GROUP BY 1),
sv AS (SELECT step, tau, tp, fp, pos - tp AS fn, round(tp / greatest(tp + fp, 1), 6) AS precision, round(2 * tp / greatest(tp + fp + pos, 1), 6) AS f1 FROM sw)"""

ORACLE_SQL = {
    "hits_recall_precision": f"""WITH {B.Q}, {_RAW}, l AS (SELECT question_id, list(DISTINCT p) AS ids, min(f) AS f FROM (SELECT question_id, {_C.format(x='chunk_id')} AS p, 0 AS f FROM c WHERE rank <= 10) GROUP BY 1),
        o AS (SELECT question_id, p, min(rank) AS first FROM (SELECT question_id, {_C.format(x='chunk_id')} AS p, rank FROM c WHERE rank <= 10) GROUP BY 1, 2),
        w AS (SELECT question_id, list(p ORDER BY first) AS got FROM o GROUP BY 1),
        x AS (SELECT question_id, got, list_filter(coalesce(gold_passages_full, []), lambda x: x IS NOT NULL) AS gold FROM w JOIN q USING (question_id))
        SELECT question_id, CASE WHEN list_has_any(got[1:5], gold) THEN 1.0 ELSE 0.0 END AS hits_5,
        round(CASE WHEN len(gold) > 0 THEN len(list_intersect(list_distinct(got[1:5]), list_distinct(gold))) / len(gold) ELSE 0 END, 6) AS recall_5,
        round(len(list_intersect(got[1:5], list_distinct(gold))) / greatest(len(got[1:5]), 1), 6) AS precision_5,
        round(len(list_intersect(got, list_distinct(gold))) / greatest(len(got), 1), 6) AS precision_all FROM x""",
    "first_hit_ranks": f"""WITH {B.Q}, {B.G}, {_RAW} SELECT question_id, min(rank) AS first_hit FROM c JOIN g USING (question_id)
        WHERE chunk_id = passage_id OR starts_with(chunk_id, passage_id || '__') GROUP BY 1""",
    "recall_curve": f"""WITH {B.Q}, {B.G}, {_RAW}, f AS (SELECT question_id, min(rank) AS h FROM c JOIN g USING (question_id) WHERE chunk_id = passage_id OR starts_with(chunk_id, passage_id || '__') GROUP BY 1)
        SELECT CAST(k AS INT) AS k, round((SELECT count(*) FROM f WHERE h <= k) / greatest((SELECT count(*) FROM q), 1), 6) AS recall FROM (SELECT unnest(range(1, 21)) AS k)""",
    "exact_match_f1": f"WITH {_JUDGED} SELECT result_id, em, round(f1, 6) AS f1 FROM j",
    "mean_em_f1": f"WITH {_JUDGED} SELECT variant, count(*) AS n, round(avg(em) * 100, 4) AS em, round(avg(f1) * 100, 4) AS f1 FROM j GROUP BY 1",
    "binary_f1_confusion": f"""WITH {_JUDGED}, x AS (SELECT variant, contains(coalesce(normalised_answer, ''), 'supported') AS p, lower(trim(gold)) = 'supported' AS a FROM j WHERE lower(trim(gold)) IN ('supported', 'refuted')),
        y AS (SELECT variant, count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn FROM x GROUP BY 1),
        z AS (SELECT *, tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS re FROM y)
        SELECT variant, tp, fp, fn, tn, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM z""",
    "tau_sweep": f"WITH {_SWEEP} SELECT * FROM sv",
    "tau_choice": f"""WITH {_SWEEP}, a AS (SELECT * FROM sv WHERE precision >= 0.8 ORDER BY step LIMIT 1), b AS (SELECT * FROM sv WHERE precision > 0 ORDER BY precision DESC, step LIMIT 1)
        SELECT coalesce((SELECT tau FROM a), (SELECT tau FROM b), 0.5) AS tau, coalesce((SELECT precision FROM a), (SELECT precision FROM b), 0.0) AS precision, coalesce((SELECT f1 FROM a), (SELECT f1 FROM b), -1.0) AS f1""",
    "label_balance": f"""WITH {_JUDGED}, x AS (SELECT dataset, count(*) FILTER (em = 1) AS positives, count(*) FILTER (em <> 1) AS negatives FROM j GROUP BY 1)
        SELECT *, round(negatives / greatest(positives, 1), 6) AS pos_weight FROM x""",
    "gold_attention": f"""WITH {B.Q}, {B.G}, x AS (SELECT query_id, {_C.format(x='chunk_id')} AS p, count(*) AS n FROM retrieval_scores GROUP BY 1, 2)
        SELECT query_id, round(sum(CASE WHEN g.passage_id IS NOT NULL THEN n ELSE 0 END) / sum(n), 6) AS attention FROM x LEFT JOIN g ON g.question_id = x.query_id AND g.passage_id = x.p GROUP BY 1""",
    "usage_merge": """WITH x AS (SELECT user_id, event_type, event_id, CASE WHEN event_type = 'error' THEN props ELSE CAST(value AS VARCHAR) END AS v FROM events)
        SELECT user_id, event_type, round(sum(try_cast(v AS DOUBLE)), 6) AS total, arg_max(v, event_id) FILTER (try_cast(v AS DOUBLE) IS NULL AND v IS NOT NULL) AS last_text FROM x GROUP BY 1, 2""",
    "usage_full_outer": """WITH a AS (SELECT user_id, round(sum(value), 6) AS s, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, round(sum(value), 6) AS s, count(*) AS n FROM events WHERE event_type = 'signup' GROUP BY 1)
        SELECT user_id, coalesce(a.s, 0) AS "view", coalesce(a.n, 0) AS n_view, coalesce(b.s, 0) AS signup, coalesce(b.n, 0) AS n_signup FROM a FULL OUTER JOIN b USING (user_id)""",
    "percentiles": f"""WITH {B.R} SELECT variant, round(quantile_cont(wall_time_sec, 0.5), 6) AS median_wall_time_sec, round(quantile_cont(wall_time_sec, 0.9), 6) AS p90_wall_time_sec,
        round(quantile_cont(reader_total_tokens, 0.5), 6) AS median_reader_total_tokens, round(quantile_cont(reader_total_tokens, 0.9), 6) AS p90_reader_total_tokens FROM r GROUP BY 1""",
    "throughput": f"""WITH {B.R}, x AS (SELECT variant, sum(reader_total_tokens) AS t, count(DISTINCT question_id) AS q, count(*) AS c, coalesce(sum(wall_time_sec), 0) AS s FROM r GROUP BY 1)
        SELECT variant, round(CASE WHEN s > 0 THEN t / s ELSE 0 END, 6) AS tps, round(CASE WHEN s > 0 THEN q / s ELSE 0 END, 6) AS qps, round(CASE WHEN s > 0 THEN c / s ELSE 0 END, 6) AS cps FROM x""",
    "reader_timing": f"""WITH {B.R} SELECT variant, reader_model, round(sum(wall_time_sec), 4) AS total, round(avg(wall_time_sec), 6) AS mean, round(median(wall_time_sec), 6) AS median,
        round(coalesce(sum(wall_time_sec) * 1000 / nullif(count(DISTINCT question_id), 0), 0), 4) AS ms_per_question, round(coalesce(sum(wall_time_sec) * 1000 / count(*), 0), 4) AS ms_per_answer FROM r GROUP BY 1, 2""",
    "wilcoxon_w": f"""WITH {B.R}, m AS (SELECT dataset, question_id, variant, round(avg(wall_time_sec), 6) AS v FROM r GROUP BY 1, 2, 3),
        x AS (SELECT dataset, round(a.v - b.v, 9) AS d FROM m a JOIN m b USING (dataset, question_id) WHERE a.variant = 'baseline_dense_k20' AND b.variant = 'baseline_hybrid_k20' AND a.v IS NOT NULL AND b.v IS NOT NULL),
        y AS (SELECT dataset, d, rank() OVER (PARTITION BY dataset ORDER BY abs(d)) AS lo, count(*) OVER (PARTITION BY dataset, abs(d)) AS n FROM x WHERE d <> 0),
        z AS (SELECT dataset, count(*) AS pairs, sum(CASE WHEN d > 0 THEN lo + (n - 1) / 2 ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN lo + (n - 1) / 2 ELSE 0 END) AS w_minus FROM y GROUP BY 1)
        SELECT *, least(w_plus, w_minus) AS w, round((least(w_plus, w_minus) - pairs * (pairs + 1) / 4) / sqrt(pairs * (pairs + 1) * (2 * pairs + 1) / 24), 6) AS z FROM z""",
    "log_loss": """WITH x AS (SELECT least(greatest(score, 1e-7), 1 - 1e-7) AS p, CAST(jaccard >= 0.7 AS INT) AS y FROM scored_pairs WHERE score IS NOT NULL AND jaccard IS NOT NULL)
        SELECT count(*) AS n, round(avg(-(3.0 * y * ln(p) + (1 - y) * ln(1 - p))), 6) AS loss FROM x""",
    "windowed_counts": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "running_usage": """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS running, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events""",
}
