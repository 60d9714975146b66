"""Queries of walks over the passage graph that retrieval lists make: each passage leads to the next of a list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.operators import graph as G
from quarrion.operators.components import connected_components
from quarrion.plans import base as B
from quarrion.session import checkpointed

Frame = DataFrame
HOPS = 3


def edges(spark: SparkSession, d: str) -> Frame:
    """(src, dst, oq_id, conditioned_score): from each of a query's ten best passages to the next one."""
    t = B.ranked(spark, d)
    a = t.select("query_id", "rank", F.col("passage_id").alias("src"))
    b = t.select("query_id", (F.col("rank") - 1).alias("rank"), F.col("passage_id").alias("dst"), F.col("score").alias("conditioned_score"))
    return a.join(b, ["query_id", "rank"]).select("src", "dst", F.col("query_id").alias("oq_id"), "conditioned_score")


def seeds(spark: SparkSession, d: str) -> Frame:
    """(query_id, src, place): the gold passages of each query."""
    q = B.questions(spark, d).where(B.is_query(F.col("question_id")))
    return q.select(F.col("question_id").alias("query_id"), F.posexplode("gold_passages_full").alias("place", "src")).where("src IS NOT NULL")


def edge_candidates(spark: SparkSession, d: str) -> Frame:
    """Edges out of every seed, in order of choice."""
    rows = G.edge_candidates(seeds(spark, d).select("query_id", "src").distinct(), edges(spark, d))
    return rows.select("query_id", "src", "dst", "oq_id", "place")


def edge_candidates_biased(spark: SparkSession, d: str) -> Frame:
    """The same by the score of the node that they lead to."""
    rows = G.edge_candidates(seeds(spark, d).select("query_id", "src").distinct(), edges(spark, d), biased=True)
    return rows.select("query_id", "src", "dst", "oq_id", "place")


def edge_candidates_next(spark: SparkSession, d: str) -> Frame:
    """Edges out of every seed after the first choice of each was taken."""
    first = checkpointed(edge_candidates(spark, d).where("place = 1").select("query_id", "src", "dst", "oq_id"))
    rows = G.edge_candidates(seeds(spark, d).select("query_id", "src").distinct(), edges(spark, d), first)
    return rows.select("query_id", "src", "dst", "oq_id", "place")


def reachability(spark: SparkSession, d: str) -> Frame:
    """Passages within three steps of a query's seeds."""
    return G.reachable(seeds(spark, d), edges(spark, d), HOPS)


def hop_log(spark: SparkSession, d: str) -> Frame:
    """(query_id, hop, expanded_from, new_passages) of that walk."""
    seen = reachability(spark, d)
    new = seen.where("hop > 0").groupBy("query_id", (F.col("hop") - 1).alias("hop")).agg(F.array_sort(F.collect_set("node")).alias("new_passages"))
    old = seen.where(F.col("hop") < HOPS).groupBy("query_id", "hop").agg(F.array_sort(F.collect_set("node")).alias("expanded_from"))
    joined = old.join(new, ["query_id", "hop"], "left")
    return joined.select("query_id", "hop", "expanded_from", F.coalesce("new_passages", F.array().cast("array<string>")).alias("new_passages"))


def hop_gold(spark: SparkSession, d: str) -> Frame:
    """(query_id, gold): the query's three best passages, what the walk is to find."""
    t = B.ranked(spark, d, 3)
    return t.groupBy("query_id").agg(F.array_sort(F.collect_set("passage_id")).alias("gold"))


def traverse(spark: SparkSession, d: str) -> Frame:
    """Edges taken by the walks of all queries."""
    return G.traverse(seeds(spark, d), edges(spark, d), HOPS)


def traverse_biased(spark: SparkSession, d: str) -> Frame:
    """Edges taken when the score decides."""
    return G.traverse(seeds(spark, d), edges(spark, d), HOPS, biased=True)


def question_components(spark: SparkSession, d: str) -> Frame:
    """Connected components of the passages that share a question's gold list."""
    q = B.questions(spark, d).select(F.filter("gold_passages_full", lambda x: x.isNotNull()).alias("g")).where("size(g) > 0")
    pairs = q.select(F.col("g")[0].alias("a"), F.explode("g").alias("b"))
    return connected_components(pairs)


QUERIES = {f.__name__: f for f in (edge_candidates, edge_candidates_biased, edge_candidates_next, reachability, traverse, traverse_biased, question_components)}

_EDGES = f"""{B.S}, {B.T10}, {B.Q}, e AS (SELECT a.passage_id AS src, b.passage_id AS dst, a.query_id AS oq_id, b.score AS conditioned_score FROM t a JOIN t b ON a.query_id = b.query_id AND b.rank = a.rank + 1),
sd AS (SELECT DISTINCT question_id AS query_id, unnest(gold_passages_full) AS src FROM q WHERE {B.IS_QUERY}),
ss AS (SELECT * FROM sd WHERE src IS NOT NULL)"""
_REACH = f"""{_EDGES}, w AS (SELECT query_id, src AS node, 0 AS hop FROM ss UNION SELECT w.query_id, e.dst, w.hop + 1 FROM w JOIN e ON e.src = w.node WHERE w.hop < 3),
sn AS (SELECT query_id, node, min(hop) AS hop FROM w GROUP BY 1, 2)"""
_LOG = f"""{_REACH}, o AS (SELECT query_id, hop, list(node) AS f FROM sn WHERE hop < 3 GROUP BY 1, 2), nw AS (SELECT query_id, hop - 1 AS hop, list(node) AS n FROM sn WHERE hop > 0 GROUP BY 1, 2),
hl AS (SELECT o.query_id, o.hop, f AS expanded_from, coalesce(n, []) AS new_passages FROM o LEFT JOIN nw USING (query_id, hop)),
gd AS (SELECT query_id, list(DISTINCT passage_id) AS gold FROM t WHERE rank <= 3 GROUP BY 1)"""



def _walk(first: str, later: str) -> str:
    """SQL tables of the walk, the last one ``wk``: a recursion step takes one node of the frontier; lists hold what was visited and taken."""
    options = "list({{'oq': oq_id, 'dst': dst}} ORDER BY {0})"
    last = "idx = len(front)"
    return f"""{_EDGES}, el AS (SELECT src AS at, {options.format(first)} AS l0, {options.format(later)} AS l1 FROM e GROUP BY 1),
        s0 AS (SELECT question_id AS query_id, gold_passages_full[i] AS src, i FROM (SELECT question_id, gold_passages_full, unnest(range(1, len(gold_passages_full) + 1)) AS i FROM q WHERE {B.IS_QUERY})),
        w AS (SELECT query_id, 0 AS hop, list(src ORDER BY i, src) AS front, 1 AS idx, CAST([] AS VARCHAR[]) AS follow, CAST([] AS VARCHAR[]) AS visited, CAST([] AS VARCHAR[]) AS taken,
                     CAST(NULL AS VARCHAR) AS src, CAST(NULL AS VARCHAR) AS dst, CAST(NULL AS VARCHAR) AS oq_id, CAST(NULL AS BOOLEAN) AS repeat, 0 AS at_hop
              FROM s0 WHERE src IS NOT NULL GROUP BY 1
        UNION ALL
        SELECT query_id, CASE WHEN {last} THEN hop + 1 ELSE hop END, CASE WHEN {last} THEN f ELSE front END, CASE WHEN {last} THEN 1 ELSE idx + 1 END, CASE WHEN {last} THEN CAST([] AS VARCHAR[]) ELSE f END,
               CASE WHEN got AND NOT again THEN list_append(v, c.dst) ELSE v END, CASE WHEN got THEN list_append(taken, node || '|' || c.dst || '|' || c.oq) ELSE taken END,
               CASE WHEN got THEN node END, c.dst, c.oq, CASE WHEN got THEN again END, hop
        FROM (SELECT *, CASE WHEN got AND NOT again THEN list_append(follow, c.dst) ELSE follow END AS f FROM (
            SELECT *, c IS NOT NULL AS got, coalesce(list_contains(v, c.dst), false) AS again FROM (
            SELECT y.*, list_append(visited, node) AS v, list_filter(CASE WHEN hop = 0 THEN l0 ELSE l1 END, lambda z: NOT list_contains(taken, node || '|' || z.dst || '|' || z.oq))[1] AS c
            FROM (SELECT *, front[idx] AS node FROM w WHERE hop < {HOPS} AND len(front) > 0) y LEFT JOIN el ON el.at = node)))),
        wk AS (SELECT query_id, at_hop AS hop, src, dst, oq_id, repeat FROM w WHERE src IS NOT NULL)"""


WALK = _walk("oq_id, dst", "oq_id, dst")


ORACLE_SQL = {
    "edge_candidates": f"WITH {_EDGES} SELECT query_id, src, dst, oq_id, row_number() OVER (PARTITION BY query_id, src ORDER BY oq_id, dst) AS place FROM ss JOIN e USING (src)",
    "edge_candidates_biased": f"WITH {_EDGES} SELECT query_id, src, dst, oq_id, row_number() OVER (PARTITION BY query_id, src ORDER BY conditioned_score DESC, oq_id, dst) AS place FROM ss JOIN e USING (src)",
    "edge_candidates_next": f"""WITH {_EDGES}, c AS (SELECT query_id, src, dst, oq_id, row_number() OVER (PARTITION BY query_id, src ORDER BY oq_id, dst) AS place FROM ss JOIN e USING (src))
        SELECT query_id, src, dst, oq_id, place - 1 AS place FROM c WHERE place > 1""",
    "traverse": f"WITH RECURSIVE {WALK} SELECT * FROM wk",
    "traverse_biased": f"WITH RECURSIVE {_walk('conditioned_score DESC, oq_id, dst', 'conditioned_score, oq_id, dst')} SELECT * FROM wk",
    "reachability": f"WITH RECURSIVE {_REACH} SELECT query_id, node, hop FROM sn",
    "hop_metrics": f"""WITH RECURSIVE {_LOG}, x AS (SELECT hl.query_id, hl.hop, (SELECT count(*) FROM sn WHERE sn.query_id = hl.query_id AND sn.hop BETWEEN 1 AND hl.hop + 1) AS seen,
        (SELECT count(*) FROM sn WHERE sn.query_id = hl.query_id AND sn.hop BETWEEN 1 AND hl.hop + 1 AND list_contains(gd.gold, sn.node)) AS hits, len(gd.gold) AS n FROM hl JOIN gd USING (query_id)),
        y AS (SELECT query_id, hop, coalesce(hits / nullif(seen, 0), 0) AS p, coalesce(hits / nullif(n, 0), 0) AS r FROM x)
        SELECT query_id, hop, round(p, 4) AS precision, round(r, 4) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM y""",
    "traversal_summary": f"""WITH RECURSIVE {_LOG}, x AS (SELECT hl.query_id, hl.hop, (SELECT count(*) FROM sn WHERE sn.query_id = hl.query_id AND sn.hop BETWEEN 1 AND hl.hop + 1) AS seen,
        (SELECT count(*) FROM sn WHERE sn.query_id = hl.query_id AND sn.hop BETWEEN 1 AND hl.hop + 1 AND list_contains(gd.gold, sn.node)) AS hits, len(gd.gold) AS n FROM hl JOIN gd USING (query_id)),
        y AS (SELECT query_id, hop, coalesce(hits / nullif(seen, 0), 0) AS p, coalesce(hits / nullif(n, 0), 0) AS r FROM x),
        z AS (SELECT query_id, arg_max(round(p, 4), hop) AS p, arg_max(round(r, 4), hop) AS r, arg_max(round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4), hop) AS f1, max(hop) + 1 AS depth FROM y GROUP BY 1),
        fh AS (SELECT query_id, min(CASE WHEN hop = 0 AND list_has_any(expanded_from, gold) THEN 0 WHEN list_has_any(new_passages, gold) THEN hop END) AS h FROM hl JOIN gd USING (query_id) GROUP BY 1),
        cv AS (SELECT query_id, CAST((SELECT count(*) FROM sn WHERE sn.query_id = gd.query_id AND list_contains(gd.gold, sn.node)) = len(gd.gold) AS INT) AS c FROM gd WHERE query_id IN (SELECT query_id FROM hl)),
        vs AS (SELECT query_id, regexp_replace(regexp_replace(chunk_id, '__sent[0-9]+$', ''), '__chunk[0-9]+$', '') AS passage, count(*) AS n FROM retrieval_scores GROUP BY 1, 2),
        atn AS (SELECT query_id, round(sum(CASE WHEN list_contains(gd.gold, passage) THEN n ELSE 0 END) / sum(n), 6) AS a FROM vs JOIN gd USING (query_id) GROUP BY 1)
        SELECT count(*) AS queries, round(avg(p), 4) AS mean_precision, round(avg(r), 4) AS mean_recall, round(avg(f1), 4) AS mean_f1, round(avg(coalesce(a, 0)), 4) AS mean_gold_attention,
        sum(c) AS all_gold_found, sum(CASE WHEN h = 0 THEN 1 ELSE 0 END) AS gold_in_first_hop, round(avg(h), 2) AS mean_first_gold_hop, round(avg(depth), 2) AS mean_depth, max(depth) AS max_depth
        FROM z JOIN cv USING (query_id) LEFT JOIN fh USING (query_id) LEFT JOIN atn USING (query_id)""",
    "first_gold_hop": f"""WITH RECURSIVE {_LOG} SELECT query_id, min(CASE WHEN hop = 0 AND list_has_any(expanded_from, gold) THEN 0 WHEN list_has_any(new_passages, gold) THEN hop END) AS first_gold_hop
        FROM hl JOIN gd USING (query_id) GROUP BY 1""",
    "hop_depth_histogram": f"""WITH RECURSIVE {_LOG}, x AS (SELECT query_id, coalesce(max(CASE WHEN len(expanded_from) > 0 OR len(new_passages) > 0 THEN hop END) + 1, 0) AS depth FROM hl GROUP BY 1)
        SELECT CAST(b.depth AS INT) AS depth, count(x.query_id) AS n FROM (SELECT unnest(range(0, (SELECT max(depth) + 1 FROM x))) AS depth) b LEFT JOIN x ON x.depth = b.depth GROUP BY 1""",
    "question_components": """WITH RECURSIVE x AS (SELECT DISTINCT question_id, list_filter(gold_passages_full, lambda x: x IS NOT NULL) AS g FROM questions),
        p AS (SELECT g[1] AS a, unnest(g) AS b FROM x WHERE len(g) > 0), u AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
        w AS (SELECT a AS node, a AS seen FROM u UNION SELECT w.node, u.b FROM w JOIN u ON u.a = w.seen) SELECT node, min(seen) AS component FROM w GROUP BY 1""",
}
