"""Queries of retrieval, ranking and selection under budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.functions.text import count_words, label_tokens
from quarrion.operators import nearmiss as N
from quarrion.operators import retrieval as T
from quarrion.operators import selection as C
from quarrion.operators.metrics import gains_at
from quarrion.plans import base as B
from quarrion.session import checkpointed

Frame = DataFrame


def _overlap_sides(spark: SparkSession, d: str) -> tuple[Frame, Frame]:
    """Queries and passages with their tokens."""
    q = B.questions(spark, d).where(B.is_query(F.col("question_id")) & F.col("question").isNotNull())
    q = q.select(F.col("question_id").alias("query_id"), F.array_distinct(label_tokens("question")).alias("tokens"))
    return q, B.passages(spark, d).select(F.col("passage_id").alias("doc_id"), F.array_distinct(label_tokens("text")).alias("tokens"))


def _overlap_gold(spark: SparkSession, d: str, q: Frame) -> Frame:
    """(query_id, doc_id, rel, score): gold passages that share a token with their query."""
    gold = B.gold(spark, d).select(F.col("question_id").alias("query_id"), F.col("passage_id").alias("doc_id"), "rel").join(q, "query_id")
    pairs = gold.join(B.passages(spark, d).select(F.col("passage_id").alias("doc_id"), "text"), "doc_id")
    shared = F.size(F.array_intersect("tokens", F.array_distinct(label_tokens("text"))))
    return pairs.select("query_id", "doc_id", "rel", shared.alias("score")).where("score > 0")


def _overlap_tops(spark: SparkSession, d: str, k: int) -> Frame:
    """(query_id, doc_id) of the k passages that share most tokens with each query."""
    return T.best_of_tiles(T.overlap_tiles(*_overlap_sides(spark, d), k), k).select("query_id", "doc_id")


def _overlap_gains(spark: SparkSession, d: str, k: int, depths: dict[str, int | None]) -> tuple[Frame, Frame]:
    """nDCG of the token-overlap ranking of each query that shares a token with a passage, and the tiles it is of."""
    q, docs = _overlap_sides(spark, d)
    hits = checkpointed(_overlap_gold(spark, d, q))
    tiles = checkpointed(T.overlap_tiles(q, docs, k, hits.drop("rel")))
    ranked = T.hits_of_tiles(tiles).join(hits.drop("score"), ["query_id", "doc_id"]).select("query_id", "rank", "rel")
    asked = tiles.where("before IS NULL").select("query_id").distinct()
    return gains_at(asked.join(ranked, "query_id", "left"), "query_id", "rank", "rel", depths), tiles


def token_overlap_ndcg(spark: SparkSession, d: str) -> Frame:
    """nDCG of the token-overlap ranking of each query, of all candidates and of ten."""
    depths = {"ndcg": None, "ndcg_10": 10}
    gains, _ = _overlap_gains(spark, d, 1, depths)
    return gains.select("query_id", *(F.round(name, 6).alias(name) for name in depths))


def _question_sets(spark: SparkSession, d: str) -> Frame:
    return N.label_sets(B.questions(spark, d).where("question IS NOT NULL"), "question_id", "question", F.col("dataset"))


def _positives(spark: SparkSession, d: str) -> Frame:
    return B.gold(spark, d).where("rel >= 3").select(F.col("question_id").alias("query_id"), F.col("passage_id").alias("doc_id"))


def ccr_report(spark: SparkSession, d: str) -> Frame:
    """Confusion of the token-overlap ranking with near-miss questions' gold passages."""
    gains, tiles = _overlap_gains(spark, d, 5, {"ndcg": None, "ndcg_at_k": 5})
    top = T.best_of_tiles(tiles, 5)
    confused = N.confusions_of_sets(top.select("query_id", "doc_id"), _positives(spark, d), _question_sets(spark, d), 0.6)
    return N.confusion_summary(gains, top, confused)


def pair_confusion(spark: SparkSession, d: str) -> Frame:
    """Near-miss question pairs whose gold passages were retrieved for each other."""
    return N.pair_confusion(N.confusions_of_sets(_overlap_tops(spark, d, 5), _positives(spark, d), _question_sets(spark, d), 0.6), 5)


def _keyword_docs(spark: SparkSession, d: str) -> Frame:
    p = B.passages(spark, d)
    return p.select(F.col("passage_id").alias("doc_id"), F.coalesce(B.keywords(F.col("text")), F.array()).alias("keywords"))


def _keyword_queries(spark: SparkSession, d: str) -> Frame:
    q = B.questions(spark, d).where(B.is_query(F.col("question_id")) & F.col("question").isNotNull())
    return q.select(F.col("question_id").alias("query_id"), B.keywords(F.col("question")).alias("keywords"))


def bm25_stats(spark: SparkSession, d: str) -> Frame:
    """Document frequency and idf of every keyword."""
    terms, _ = T.bm25_statistics(_keyword_docs(spark, d))
    return terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, d: str) -> Frame:
    """Ten best passages of each query by BM25 over keyword sets."""
    return T.sparse_topk(_keyword_queries(spark, d), _keyword_docs(spark, d), 10)


def dense_topk(spark: SparkSession, d: str) -> Frame:
    """Five best vectors of each query vector by inner product."""
    docs = B.vectors(spark, d)
    return T.dense_topk(B.vector_queries(docs), docs, 5)


def hybrid_topk(spark: SparkSession, d: str) -> Frame:
    """Ten best by the blend of dense and sparse scores."""
    docs = B.vectors(spark, d)
    return T.hybrid_topk(B.vector_queries(docs), docs, 10)


def hybrid_no_keywords(spark: SparkSession, d: str) -> Frame:
    """The same where queries have no keywords."""
    docs = B.vectors(spark, d)
    bare = B.vector_queries(docs).withColumn("keywords", F.array().cast("array<string>"))
    return T.hybrid_topk(bare, docs, 10)


def seed_selection(spark: SparkSession, d: str) -> Frame:
    """Twenty seeds of each query."""
    docs = B.vectors(spark, d)
    return T.select_seeds(B.vector_queries(docs), docs).select("query_id", "doc_id", "rank")


def node_similarity(spark: SparkSession, d: str) -> Frame:
    """Similarity of each query to its five densest neighbours, as a walk rates nodes."""
    docs = B.vectors(spark, d)
    queries = B.vector_queries(docs)
    return T.node_similarity(queries, docs, T.dense_topk(queries, docs, 5))


def minmax_norm(spark: SparkSession, d: str) -> Frame:
    """Retrieval scores as shares of their query's range."""
    return T.shares_of_range(B.scores(spark, d), "score", "query_id", "share").select("query_id", "passage_id", F.round("share", 6).alias("share"))


def _ranked_texts(spark: SparkSession, d: str) -> Frame:
    return B.ranked(spark, d).join(B.passages(spark, d).select("passage_id", "text"), "passage_id")


def greedy_budget_select(spark: SparkSession, d: str) -> Frame:
    """Retrieved passages chosen greedily within 120 words, in rank order."""
    rows = _ranked_texts(spark, d).withColumn("size", count_words("text"))
    return C.greedy_budget(rows, "query_id", "rank", "size", 120, "score", 0.05).select("query_id", "passage_id", "rank", "size")


def pack_passages(spark: SparkSession, d: str) -> Frame:
    """Retrieved passages packed into 300 tokens, each cut to 150 words."""
    packed = C.pack_passages(_ranked_texts(spark, d), "query_id", "rank", "text", 300, 150)
    return packed.select("query_id", "rank", "tokens", "truncated")


def packing_counts(spark: SparkSession, d: str) -> Frame:
    """Counters of that packing."""
    rows = _ranked_texts(spark, d)
    return C.packing_counters(rows, C.pack_passages(rows, "query_id", "rank", "text", 300, 150), "query_id")


def reader_budget(spark: SparkSession, d: str) -> Frame:
    """Context budgets of answers in a window of 4,096 tokens, and the window that gives the budget back."""
    base, out = F.coalesce("reader_prompt_tokens", F.lit(0)), F.coalesce("reader_output_tokens", F.lit(0))
    rows = B.results(spark, d).select("result_id", C.reader_budget(F.lit(4096), base, out).alias("b"), base.alias("p"), out.alias("o"))
    return rows.select("result_id", "b.*", C.window_for_context(F.col("b.context_budget"), F.col("p"), F.col("o")).alias("window"))


def helpfulness_rank(spark: SparkSession, d: str) -> Frame:
    """Five most helpful passages of each query by score and share of the query's visits."""
    rows = B.table(spark, d, "retrieval_scores").where("score IS NOT NULL AND NOT isnan(score)")
    visits = rows.groupBy("query_id", B.passage_of(F.col("chunk_id")).alias("passage_id")).agg(F.max("score").alias("similarity"), F.count(F.lit(1)).alias("visits"))
    return C.rank_helpful(visits, "query_id", "passage_id", "similarity", "visits").select("query_id", "passage_id", "helpfulness", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        token_overlap_ndcg, ccr_report, pair_confusion, bm25_stats, bm25_topk, dense_topk, hybrid_topk, hybrid_no_keywords,
        seed_selection, node_similarity, minmax_norm, greedy_budget_select, pack_passages, packing_counts, reader_budget, helpfulness_rank,
    )
}

_TOK = B.TOKENS
_RANKED = f"""{B.Q}, {B.P}, {B.G},
qt AS (SELECT DISTINCT question_id AS query_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS w FROM q WHERE {B.IS_QUERY} AND question IS NOT NULL),
dt AS (SELECT DISTINCT passage_id AS doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM p),
o AS (SELECT query_id, doc_id, CAST(count(*) AS INT) AS score FROM qt JOIN dt USING (w) GROUP BY 1, 2),
k AS (SELECT o.query_id, o.doc_id, score, coalesce(rel, 0) AS rel, row_number() OVER (PARTITION BY o.query_id ORDER BY score DESC, o.doc_id) AS rank
      FROM o LEFT JOIN g ON g.question_id = o.query_id AND g.passage_id = o.doc_id)"""
_NDCG = """i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS ideal FROM k),
n AS (SELECT query_id, sum((pow(2.0, rel) - 1) / log2(rank + 1)) AS a, sum((pow(2.0, rel) - 1) / log2(ideal + 1)) AS b,
  sum(CASE WHEN rank <= {k} THEN (pow(2.0, rel) - 1) / log2(rank + 1) ELSE 0 END) AS c, sum(CASE WHEN ideal <= {k} THEN (pow(2.0, rel) - 1) / log2(ideal + 1) ELSE 0 END) AS e
  FROM i GROUP BY 1),
m AS (SELECT query_id, CASE WHEN b > 0 THEN a / b ELSE 0 END AS ndcg, CASE WHEN e > 0 THEN c / e ELSE 0 END AS ndcg_k FROM n)"""
_MAP = f"""ls AS (SELECT question_id AS id, {_TOK.format(x='question')} AS t FROM q WHERE question IS NOT NULL),
mp AS (SELECT x.id, y.id AS neighbour FROM ls x JOIN ls y ON x.id <> y.id AND len(list_intersect(x.t, y.t)) > 0
  AND len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))) >= 0.6 - 1e-12)"""
_CONFUSED = """pos AS (SELECT question_id AS query_id, passage_id AS doc_id FROM g WHERE rel >= 3),
cf AS (SELECT k.query_id, k.doc_id, mp.neighbour FROM k JOIN mp ON mp.id = k.query_id JOIN pos ON pos.query_id = mp.neighbour AND pos.doc_id = k.doc_id
  WHERE k.rank <= 5 AND NOT EXISTS (SELECT 1 FROM pos z WHERE z.query_id = k.query_id AND z.doc_id = k.doc_id))"""
_KD = f"""{B.P}, kd AS (SELECT passage_id AS doc_id, coalesce({B.KEYWORDS.format(x='text')}, []) AS kw FROM p),
cs AS (SELECT count(*) AS n_docs, avg(len(kw)) AS avgdl FROM kd),
tm AS (SELECT term, count(*) AS df FROM (SELECT unnest(kw) AS term FROM kd) GROUP BY 1),
idf AS (SELECT term, df, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf FROM tm, cs)"""
_KQ = f"kq AS (SELECT question_id AS query_id, {B.KEYWORDS.format(x='question')} AS kw FROM q WHERE {B.IS_QUERY} AND question IS NOT NULL)"
_WEIGHT = "idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl))"
_VEC = f"""{B.V}, vq AS (SELECT doc_id AS query_id, unit AS qu, {{qkw}} AS qkw FROM v WHERE doc_id % 50 = 0),
cs AS (SELECT count(*) AS n_docs, avg(len(kw)) AS avgdl FROM v),
tm AS (SELECT term, count(*) AS df FROM (SELECT unnest(kw) AS term FROM v) GROUP BY 1),
idf AS (SELECT term, df, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) AS idf FROM tm, cs),
bm AS (SELECT query_id, doc_id, sum({_WEIGHT}) AS bm25 FROM (SELECT DISTINCT query_id, unnest(qkw) AS term FROM vq) JOIN idf USING (term)
  JOIN (SELECT doc_id, len(kw) AS dl, unnest(kw) AS term FROM v) USING (term), cs GROUP BY 1, 2),
dn AS (SELECT query_id, doc_id, round_even(list_inner_product(qu, unit), 12) AS s FROM vq, v),
dp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS r FROM dn) WHERE r <= {{dk}}),
dm AS (SELECT query_id, doc_id, CASE WHEN max(s) OVER (PARTITION BY query_id) = min(s) OVER (PARTITION BY query_id) THEN 0
  ELSE (s - min(s) OVER (PARTITION BY query_id)) / (max(s) OVER (PARTITION BY query_id) - min(s) OVER (PARTITION BY query_id)) END AS dense FROM dp),
sp AS (SELECT query_id, doc_id FROM (SELECT vq.query_id, v.doc_id, row_number() OVER (PARTITION BY vq.query_id ORDER BY round_even(coalesce(bm25, 0), 4) DESC, v.doc_id) AS r
  FROM vq CROSS JOIN v LEFT JOIN bm ON bm.query_id = vq.query_id AND bm.doc_id = v.doc_id WHERE len(vq.qkw) > 0) WHERE r <= {{k}}),
cd AS (SELECT query_id, doc_id, coalesce(dense, 0) AS dense, coalesce(bm25, 0) AS bm25, len(qkw) > 0 AS worded
  FROM (SELECT query_id, doc_id FROM dm UNION SELECT query_id, doc_id FROM sp) LEFT JOIN dm USING (query_id, doc_id) LEFT JOIN bm USING (query_id, doc_id) JOIN vq USING (query_id)),
sn AS (SELECT *, CASE WHEN max(bm25) OVER (PARTITION BY query_id) = min(bm25) OVER (PARTITION BY query_id) THEN 0
  ELSE (bm25 - min(bm25) OVER (PARTITION BY query_id)) / (max(bm25) OVER (PARTITION BY query_id) - min(bm25) OVER (PARTITION BY query_id)) END AS sparse FROM cd),
bl AS (SELECT query_id, doc_id, round_even(CASE WHEN worded THEN 0.5 * dense + 0.5 * sparse ELSE dense END, 4) AS score FROM sn),
hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bl)"""


def _hybrid(k: int, qkw: str = "qkw") -> str:
    return "WITH " + _VEC.replace("{dk}", str(5 * k)).replace("{k}", str(k)).replace("{qkw}", qkw)


_TEXTS = f"{B.S}, {B.T10}, {B.P}, x AS (SELECT t.*, text FROM t JOIN p USING (passage_id))"
_NW = f"regexp_extract_all({{x}}, '{B.NON_WS.replace('{', '{{').replace('}', '}}')}+')"
_EST = f"CASE WHEN coalesce(length({{x}}), 0) = 0 THEN 0 ELSE CAST(floor(len({_NW}) * 1.3) AS INT) + 1 END"
_STRIP = f"regexp_replace(text, '^{B.WS}+|{B.WS}+$', '', 'g')"
_PACK = f"""{_TEXTS}, y AS (SELECT query_id, rank, {_STRIP} AS full_text FROM x),
z AS (SELECT query_id, rank, full_text, CASE WHEN len({_NW.format(x='full_text')}) <= 150 THEN full_text ELSE array_to_string(({_NW.format(x='full_text')})[1:150], ' ') END AS text FROM y WHERE full_text <> ''),
u AS (SELECT *, {_EST.format(x='text')} AS tokens, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM z),
a AS (SELECT *, sum(tokens + 2) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM u),
b AS (SELECT query_id, rank, full_text, CASE WHEN used > 300 THEN array_to_string(({_NW.format(x='text')})[1:298], ' ') ELSE text END AS text FROM a WHERE used <= 300 OR place = 1),
pk AS (SELECT query_id, rank, {_EST.format(x='text')} AS tokens, text <> full_text AS truncated FROM b)"""

ORACLE_SQL = {
    "token_overlap_ndcg": f"WITH {_RANKED}, {_NDCG.format(k=10)} SELECT query_id, round(ndcg, 6) AS ndcg, round(ndcg_k, 6) AS ndcg_10 FROM m",
    "ccr_report": f"""WITH {_RANKED}, {_NDCG.format(k=5)}, {_MAP}, {_CONFUSED}, c AS (SELECT count(*) AS d FROM (SELECT DISTINCT query_id, doc_id FROM cf)),
        f AS (SELECT count(*) AS queries, round(avg(ndcg), 6) AS mean_ndcg, round(avg(ndcg_k), 6) AS mean_ndcg_at_k FROM m)
        SELECT queries, mean_ndcg, mean_ndcg_at_k, (SELECT count(*) FROM k WHERE rank <= 5) AS slots, d AS confused_docs, (SELECT count(DISTINCT query_id) FROM cf) AS confused_queries,
        round(coalesce(d / nullif((SELECT count(*) FROM k WHERE rank <= 5), 0), 0), 6) AS ccr_docs, round(coalesce((SELECT count(DISTINCT query_id) FROM cf) / nullif(queries, 0), 0), 6) AS ccr_queries FROM f, c""",
    "pair_confusion": f"WITH {_RANKED}, {_MAP}, {_CONFUSED} SELECT query_id, neighbour, count(*) AS hits, round(count(*) / 5, 6) AS hit_rate FROM cf GROUP BY 1, 2",
    "bm25_stats": f"WITH {_KD} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_topk": f"""WITH {B.Q}, {_KD}, {_KQ}, bm AS (SELECT query_id, doc_id, sum({_WEIGHT}) AS s FROM (SELECT DISTINCT query_id, unnest(kw) AS term FROM kq) JOIN idf USING (term)
        JOIN (SELECT doc_id, len(kw) AS dl, unnest(kw) AS term FROM kd) USING (term), cs GROUP BY 1, 2),
        al AS (SELECT kq.query_id, kd.doc_id, round_even(coalesce(s, 0), 4) AS score FROM kq CROSS JOIN kd LEFT JOIN bm ON bm.query_id = kq.query_id AND bm.doc_id = kd.doc_id)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM al) WHERE rank <= 10""",
    "dense_topk": f"""WITH {B.V}, vq AS (SELECT doc_id AS query_id, unit AS qu FROM v WHERE doc_id % 50 = 0),
        dn AS (SELECT query_id, doc_id, round_even(list_inner_product(qu, unit), 4) AS score FROM vq, v)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dn) WHERE rank <= 5""",
    "hybrid_topk": _hybrid(10) + " SELECT query_id, doc_id, score, rank FROM hy WHERE rank <= 10",
    "hybrid_no_keywords": _hybrid(10, "CAST([] AS VARCHAR[])") + " SELECT query_id, doc_id, score, rank FROM hy WHERE rank <= 10",
    "seed_selection": _hybrid(20) + " SELECT query_id, doc_id, rank FROM hy WHERE rank <= 20",
    "node_similarity": _hybrid(10)
    + """, n5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round_even(s, 4) DESC, doc_id) AS r5 FROM dn) WHERE r5 <= 5)
        SELECT query_id, doc_id, round_even(0.5 * list_inner_product(vq.qu, v.unit) + 0.5 * coalesce(bm25, 0), 4) AS similarity FROM n5 JOIN vq USING (query_id) JOIN v USING (doc_id) LEFT JOIN bm USING (query_id, doc_id)""",
    "minmax_norm": f"""WITH {B.S} SELECT query_id, passage_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 0
        ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS share FROM s WINDOW w AS (PARTITION BY query_id)""",
    "greedy_budget_select": f"""WITH RECURSIVE {_TEXTS}, y AS (SELECT query_id, passage_id, rank, coalesce(len({_NW.format(x='text')}), 0) AS size FROM x WHERE score >= 0.05),
        z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM y WHERE size <= 120),
        w AS (SELECT query_id, passage_id, rank, size, i, true AS taken, CAST(size AS BIGINT) AS used FROM z WHERE i = 1
        UNION ALL SELECT z.query_id, z.passage_id, z.rank, z.size, z.i, w.used < 120 AND w.used + z.size <= 120,
          CASE WHEN w.used < 120 AND w.used + z.size <= 120 THEN w.used + z.size ELSE w.used END FROM w JOIN z ON z.query_id = w.query_id AND z.i = w.i + 1)
        SELECT query_id, passage_id, rank, size FROM w WHERE taken""",
    "pack_passages": f"WITH {_PACK} SELECT query_id, rank, tokens, truncated FROM pk",
    "packing_counts": f"""WITH {_PACK}, n AS (SELECT query_id, count(*) AS n_candidates FROM y WHERE full_text <> '' GROUP BY 1),
        m AS (SELECT query_id, count(*) AS n_selected, sum(CAST(truncated AS INT)) AS n_truncated, sum(tokens + 2) AS used_tokens FROM pk GROUP BY 1)
        SELECT query_id, n_candidates, coalesce(n_selected, 0) AS n_selected, coalesce(n_truncated, 0) AS n_truncated, coalesce(used_tokens, 0) AS used_tokens,
        n_candidates - coalesce(n_selected, 0) AS n_dropped FROM n LEFT JOIN m USING (query_id)""",
    "reader_budget": f"""WITH {B.R}, x AS (SELECT result_id, coalesce(reader_prompt_tokens, 0) AS p, least(coalesce(reader_output_tokens, 0), 256) AS reserved FROM r),
        y AS (SELECT *, greatest(0, 4096 - reserved - 64) AS prompt_budget FROM x), z AS (SELECT *, greatest(prompt_budget - p, 0) AS context_budget FROM y)
        SELECT result_id, reserved, prompt_budget, context_budget, CASE WHEN context_budget <= 0 THEN 0 ELSE context_budget + p + reserved + 64 END AS "window" FROM z""",
    "helpfulness_rank": r"""WITH x AS (SELECT query_id, regexp_replace(regexp_replace(chunk_id, '__sent[0-9]+$', ''), '__chunk[0-9]+$', '') AS passage_id, max(score) AS sim, count(*) AS n
        FROM retrieval_scores WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2),
        y AS (SELECT query_id, passage_id, round(0.5 * (sim + n / sum(n) OVER (PARTITION BY query_id)), 9) AS helpfulness FROM x)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY helpfulness DESC, passage_id) AS rank FROM y) WHERE rank <= 5""",
}
