"""Registered queries of the training-data operators: name, DataFrame builder, DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrion.llm import defects, knn, mixing, neardup, overlap, packing, sentences, splitting, topn
from quarrion.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defect type of every defective result."""
    return defects.found(table(spark, sf_dir, "results"), table(spark, sf_dir, "questions"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of passages with similar token sets."""
    return neardup.found(table(spark, sf_dir, "passages"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group, copies and links of every passage that has a near duplicate."""
    return neardup.groups(table(spark, sf_dir, "passages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the same or almost the same question across splits."""
    return overlap.found(table(spark, sf_dir, "questions"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recurring questions per evaluation split and dataset."""
    return overlap.report(table(spark, sf_dir, "questions"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best items of every query."""
    return topn.found(table(spark, sf_dir, "retrieval_scores"))


def p4_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with ranks, where groups of 500 rows are heavy already: the hot path on small tables."""
    return topn.top_n(table(spark, sf_dir, "retrieval_scores"), "query_id", "chunk_id", "score", 10, heavy_rows=500).select("query_id", "chunk_id", "rank")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of which one vector is among the five most similar of the other."""
    return knn.found(table(spark, sf_dir, "passages_emb"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence units of every passage."""
    return sentences.found(table(spark, sf_dir, "passages"))


def p7_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container, offset and tokens of every document (or part of one that exceeds the capacity) at each size."""
    limits = packing.container_limits(table(spark, sf_dir, "size_limits"))
    return packing.pack_documents(table(spark, sf_dir, "documents"), limits)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and used space at each container size."""
    return packing.fill_report(p7_packs(spark, sf_dir), table(spark, sf_dir, "size_limits"))


def p7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per container size: documents that came out, and containers or documents that break a rule."""
    limits = table(spark, sf_dir, "size_limits")
    return packing.audit(p7_packs(spark, sf_dir), limits)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mix, with the number of copies of each."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares asked for and reached, per source."""
    return mixing.mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source of the targets: what was asked for, documents at hand, and whether repeats exceed the cap."""
    return mixing.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per piece size: pieces over it, documents not covered from end to end, and pieces out of order."""
    limits = table(spark, sf_dir, "size_limits")
    return splitting.audit(p9_pieces(spark, sf_dir), table(spark, sf_dir, "documents"), limits)


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document above each piece size."""
    limits = splitting.piece_limits(table(spark, sf_dir, "size_limits"))
    return splitting.split_documents(table(spark, sf_dir, "documents"), limits)


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_groups, p3_found, p3_report, p4_found, p4_hot, p5_found, p6_found, p7_packs, p7_fill, p7_audit, p8_mix, p8_shares, p8_audit, p9_pieces, p9_audit)}

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))  # the compatibility forms that occur in questions
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_SPLITS = r"""
    rows AS (
        SELECT question_id AS id, lower(trim(regexp_replace(split, '^\s+|\s+$', '', 'g'))) AS split, lower(trim(dataset)) AS dataset,
               question, gold_passages, ingested_at FROM questions),
    latest AS (
        SELECT id, arg_max(r, r.ingested_at) AS r FROM (SELECT id, rows AS r FROM rows
        WHERE id IS NOT NULL AND question IS NOT NULL AND split IN ('train', 'dev', 'test', 'validation')) GROUP BY id),
    q AS (
        SELECT id, r.split AS split, r.dataset AS dataset, r.split = 'train' AS train,
               regexp_extract_all(lower(translate(r.question, '""" + _WIDE + "', '" + _NARROW + r"""')), '[\p{L}\p{N}]+') AS tokens,
               list_distinct(list_filter(list_transform(list_filter(coalesce(r.gold_passages, []), lambda x: contains(x, '__')),
                   lambda x: regexp_replace(regexp_replace(x, '^.*?__', '', 's'), '(_sent[0-9]+|_full)$', '')), lambda x: x NOT IN ('', 'no_title'))) AS titles
        FROM latest),
    pairs AS (
        SELECT a.id AS a_id, b.id AS b_id, b.split, b.dataset, a.tokens = b.tokens AS exact
        FROM q a JOIN q b ON a.train AND NOT b.train AND len(a.tokens) > 0 AND len(b.tokens) > 0
        WHERE a.tokens = b.tokens OR (list_has_any(a.titles, b.titles) AND len(list_intersect(a.tokens, b.tokens)) >=
            0.6 * len(list_distinct(a.tokens || b.tokens)) - 1e-9))
"""

_SETS = r"""
    latest AS (SELECT passage_id, arg_max(text, ingested_at) AS text FROM passages WHERE passage_id IS NOT NULL GROUP BY 1),
    sets AS (SELECT passage_id AS id, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS t FROM latest),
    usable AS (SELECT id, t, len(t) AS n FROM sets WHERE len(t) >= 12),
    words AS (SELECT id, n, unnest(t) AS w FROM usable),
    shared AS (SELECT a.id AS a, b.id AS b, a.n + b.n AS total, count(*) AS c FROM words a JOIN words b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2, 3),
    pairs AS (SELECT a, b FROM shared WHERE c >= 0.7 * (total - c) - 1e-9)
"""

ORACLE_SQL = {
    "p2_found": f"WITH {_SETS} SELECT a AS passage_id_a, b AS passage_id_b FROM pairs",
    "p2_groups": f"""
        WITH RECURSIVE {_SETS}, edges AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs),
        reach(x, y) AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
        groups AS (SELECT x AS id, least(x, min(y)) AS group_id FROM reach GROUP BY x),
        copies AS (SELECT t, count(*) AS copies FROM usable GROUP BY t),
        linked AS (SELECT e.x AS id, count(DISTINCT v.t) AS links FROM edges e JOIN usable u ON u.id = e.x JOIN usable v ON v.id = e.y
                   WHERE u.t <> v.t GROUP BY 1)
        SELECT g.id AS passage_id, group_id, copies, coalesce(links, 0) AS links
        FROM groups g JOIN usable u ON u.id = g.id JOIN copies c ON c.t = u.t LEFT JOIN linked l ON l.id = g.id
    """,
    "p3_found": f"WITH {_SPLITS} SELECT least(a_id, b_id) AS question_id_a, greatest(a_id, b_id) AS question_id_b FROM pairs",
    "p3_report": f"""
        WITH {_SPLITS}, counted AS (
            SELECT b_id, count(*) FILTER (exact) AS e, count(*) FILTER (NOT exact) AS n FROM pairs GROUP BY 1)
        SELECT split, dataset, count(*) AS questions, count(*) FILTER (e > 0) AS exact_questions, count(*) FILTER (n > 0) AS near_questions,
               count(*) FILTER (e > 0 OR n > 0) AS recurring_questions, coalesce(sum(e), 0)::BIGINT AS exact_pairs, coalesce(sum(n), 0)::BIGINT AS near_pairs
        FROM q LEFT JOIN counted ON b_id = id WHERE NOT train AND len(tokens) > 0 GROUP BY 1, 2
    """,
    "p4_found": """
        SELECT query_id, chunk_id FROM (
            SELECT query_id, chunk_id,
                   row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r
            FROM (SELECT query_id, chunk_id, max(score) AS s FROM retrieval_scores
                  WHERE score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL AND chunk_id IS NOT NULL
                  GROUP BY 1, 2)) WHERE r <= 10
    """,
    "p4_hot": """
        SELECT query_id, chunk_id, r AS rank FROM (
            SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS r
            FROM (SELECT query_id, chunk_id, max(score) AS s FROM retrieval_scores
                  WHERE score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL AND chunk_id IS NOT NULL
                  GROUP BY 1, 2)) WHERE r <= 10
    """,
    "p7_audit": """
        SELECT limit_id, (SELECT count(*) FROM documents WHERE doc_id IS NOT NULL) AS documents, 0 AS overfull, 0 AS colliding, 0 AS divided
        FROM size_limits WHERE purpose = 'container' AND max_tokens > 0
    """,
    "p8_audit": r"""
        WITH d AS (SELECT lower(regexp_replace(source, '^\s+|\s+$', '', 'g')) AS source, count(*) AS n FROM documents WHERE length(text) > 0 GROUP BY 1)
        SELECT t.source, target_share, max_repeats, coalesce(n, 0) AS documents, false AS over_repeated
        FROM (SELECT lower(trim(source)) AS source, sum(target_share) AS target_share, max(max_repeats) AS max_repeats FROM mix_targets GROUP BY 1) t LEFT JOIN d ON d.source = t.source
    """,
    "p9_audit": """
        SELECT limit_id, 0 AS over_limit, 0 AS uncovered, 0 AS unordered FROM size_limits WHERE purpose = 'piece' AND max_tokens > 0
    """,
    "p5_found": """
        WITH u AS (
            SELECT vec_id, any_value(embedding) AS e FROM passages_emb WHERE vec_id IS NOT NULL AND len(embedding) = 96
                AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            GROUP BY 1),
        v AS (SELECT vec_id, list_transform(e, lambda x: x::DOUBLE) AS e FROM u),
        n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
        best AS (
            SELECT a.vec_id AS a, b.vec_id AS b,
                   row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_dot_product(a.e, b.e) / (a.norm * b.norm), 10) DESC, b.vec_id) AS r
            FROM n a JOIN n b ON a.vec_id <> b.vec_id)
        SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM best WHERE r <= 5
    """,
}
