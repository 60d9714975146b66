"""Queries that compare runs, and relational reports over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.functions.text import assign_approach
from quarrion.operators import report as P
from quarrion.plans import base as B
from quarrion.plans.metric_queries import _JUDGED, _judged
from quarrion.session import table

Frame = DataFrame


def _runs(spark: SparkSession, d: str) -> Frame:
    rows = _judged(spark, d)
    return rows.select(
        "variant", "retriever", "dataset", "em", "f1", "wall_time_sec", F.coalesce("reader_total_tokens", F.lit(0)).alias("tokens"), F.coalesce("wall_time_sec", F.lit(0.0)).alias("seconds")
    )


def run_rollup(spark: SparkSession, d: str) -> Frame:
    """Means and totals per variant and dataset."""
    return P.run_rollup(_runs(spark, d), ["variant", "dataset"])


def run_cube(spark: SparkSession, d: str) -> Frame:
    """The same for every combination of variant and dataset."""
    return P.run_rollup(_runs(spark, d), ["variant", "dataset"], cube=True)


def group_metric(spark: SparkSession, d: str) -> Frame:
    """Numbers among normalised answers per retriever and dataset."""
    return P.group_metrics(B.results(spark, d), ["retriever", "dataset"], "normalised_answer")


def delta_pct(spark: SparkSession, d: str) -> Frame:
    """Change of two variants against each other per dataset, in percent."""
    mean = lambda v, c: F.avg(F.when(F.col("variant") == v, F.col(c)))
    a, b = "da_exit_hybrid_k20_s10", "baseline_hybrid_k20"
    sums = _runs(spark, d).groupBy("dataset").agg(mean(a, "f1").alias("fa"), mean(b, "f1").alias("fb"), mean(a, "wall_time_sec").alias("ta"), mean(b, "wall_time_sec").alias("tb"))
    return sums.select("dataset", P.percent_delta(F.col("fa"), F.col("fb")).alias("f1_delta"), P.percent_delta(F.col("ta"), F.col("tb"), True).alias("time_delta"))


def heatmap_norm(spark: SparkSession, d: str) -> Frame:
    """Measures of each variant and dataset as shares of their ranges."""
    rows = run_rollup(spark, d).select("variant", "dataset", "em", "f1", "seconds", F.lit(1.0).alias("constant"))
    return P.column_shares(rows, ["em", "f1", "seconds", "constant"])


def pareto_front(spark: SparkSession, d: str) -> Frame:
    """Questions of least mean time for their mean F1."""
    rows = _judged(spark, d).groupBy("question_id").agg(F.round(F.avg("wall_time_sec"), 6).alias("x"), F.round(F.avg("f1"), 6).alias("y"))
    return P.pareto_front(rows, "x", "y")


def label_rows(spark: SparkSession, d: str) -> Frame:
    """First-match approach labels of runs, and the count of answers of each."""
    v = F.col("variant")
    cases = [("DA_EXIT", v.startswith("da_exit_")), ("EXIT", v.startswith("exit_")), ("RAG", v.startswith("baseline_"))]
    rows = B.results(spark, d).select(P.label_first(cases, "unmatched").alias("label"), assign_approach("variant", "retriever").alias("approach"))
    return rows.groupBy("label", "approach").agg(F.count(F.lit(1)).alias("n"))


def label_rows_multi(spark: SparkSession, d: str) -> Frame:
    """All labels that hold for each run."""
    v = F.col("variant")
    cases = [("hybrid", v.contains("hybrid")), ("k20", v.contains("k20")), ("exit", v.contains("exit"))]
    return P.label_all(B.results(spark, d).select("variant"), cases).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def pricing_summary(spark: SparkSession, d: str) -> Frame:
    """Sums and means of line items per flag and status."""
    rows = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 4).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


def nation_volume(spark: SparkSession, d: str) -> Frame:
    """Net volume per customer nation and year: a star join of five tables."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.groupBy("r_name", "n_name", F.year("o_orderdate").cast("int").alias("year")).agg(F.round(F.sum(net), 4).alias("volume"), F.countDistinct("o_orderkey").alias("orders"))


QUERIES = {
    f.__name__: f
    for f in (run_rollup, run_cube, group_metric, delta_pct, heatmap_norm, pareto_front, label_rows, label_rows_multi, pricing_summary, nation_volume)
}

_RUNS = f"{_JUDGED}, rn AS (SELECT variant, dataset, em, f1, coalesce(reader_total_tokens, 0) AS tokens, coalesce(wall_time_sec, 0) AS seconds, wall_time_sec FROM j)"
_ROLL = """count(*) AS answers, round(avg(em) * 100, 4) AS em, round(avg(f1) * 100, 4) AS f1, sum(tokens) AS tokens, round(sum(seconds), 4) AS seconds,
  round(coalesce(sum(tokens) / nullif(sum(seconds), 0), 0), 4) AS tps"""


def _share(c: str) -> str:
    return f"round(CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.5 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END, 6) AS {c}"


ORACLE_SQL = {
    "run_rollup": f"WITH {_RUNS} SELECT variant, dataset, {_ROLL} FROM rn GROUP BY 1, 2",
    "run_cube": f"WITH {_RUNS} SELECT variant, dataset, {_ROLL} FROM rn GROUP BY CUBE (variant, dataset)",
    "group_metric": f"""WITH {B.R}, x AS (SELECT retriever, dataset, try_cast(normalised_answer AS DOUBLE) AS v FROM r) SELECT retriever, dataset, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median,
        min(v) AS least, max(v) AS greatest FROM x WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1, 2""",
    "delta_pct": f"""WITH {_RUNS}, x AS (SELECT dataset, avg(f1) FILTER (variant = 'da_exit_hybrid_k20_s10') AS fa, avg(f1) FILTER (variant = 'baseline_hybrid_k20') AS fb,
        avg(wall_time_sec) FILTER (variant = 'da_exit_hybrid_k20_s10') AS ta, avg(wall_time_sec) FILTER (variant = 'baseline_hybrid_k20') AS tb FROM rn GROUP BY 1)
        SELECT dataset, round((fa - fb) * 100 / nullif(abs(fb), 0), 6) AS f1_delta, round(-((ta - tb) * 100 / nullif(abs(tb), 0)), 6) AS time_delta FROM x""",
    "heatmap_norm": f"""WITH {_RUNS}, x AS (SELECT variant, dataset, round(avg(em) * 100, 4) AS em, round(avg(f1) * 100, 4) AS f1, round(sum(seconds), 4) AS seconds, 1.0 AS constant FROM rn GROUP BY 1, 2)
        SELECT variant, dataset, {_share('em')}, {_share('f1')}, {_share('seconds')}, {_share('constant')} FROM x""",
    "pareto_front": f"""WITH {_JUDGED}, x AS (SELECT question_id, round(avg(wall_time_sec), 6) AS x, round(avg(f1), 6) AS y FROM j GROUP BY 1), z AS (SELECT * FROM x WHERE x IS NOT NULL AND y IS NOT NULL)
        SELECT x, y, question_id FROM z a WHERE NOT EXISTS (SELECT 1 FROM z b WHERE (b.x < a.x AND b.y >= a.y) OR (b.x = a.x AND b.y > a.y))""",
    "label_rows": f"""WITH {B.R} SELECT CASE WHEN starts_with(variant, 'da_exit_') THEN 'DA_EXIT' WHEN starts_with(variant, 'exit_') THEN 'EXIT' WHEN starts_with(variant, 'baseline_') THEN 'RAG' ELSE 'unmatched' END AS label,
        CASE WHEN starts_with(variant, 'da_exit_') THEN 'DA_EXIT' WHEN starts_with(variant, 'exit_') THEN 'EXIT' WHEN retriever IN ('dense', 'sparse', 'hybrid') THEN retriever ELSE 'unknown' END AS approach, count(*) AS n FROM r GROUP BY 1, 2""",
    "label_rows_multi": f"""WITH {B.R} SELECT label, count(*) AS n FROM (SELECT 'hybrid' AS label FROM r WHERE contains(variant, 'hybrid') UNION ALL SELECT 'k20' FROM r WHERE contains(variant, 'k20') UNION ALL SELECT 'exit' FROM r WHERE contains(variant, 'exit')) GROUP BY 1""",
    "pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 4) AS sum_net, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
    "nation_volume": """SELECT r_name, n_name, CAST(year(o_orderdate) AS INT) AS "year", round(sum(l_extendedprice * (1 - l_discount)), 4) AS volume, count(DISTINCT o_orderkey) AS orders
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3""",
}
