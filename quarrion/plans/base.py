"""Tables as the queries use them, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.functions.ids import ordinal_of, passage_of, question_of
from quarrion.functions.text import label_tokens
from quarrion.operators.retrieval import l2_normalise, row_ranks
from quarrion.session import table

#: Every how many of the rows are queries of a search.
QUERY_STEP = 50
DIM = 96


def questions(spark: SparkSession, d: str) -> DataFrame:
    """One row a question; repeated deliveries are equal."""
    return table(spark, d, "questions").drop("ingested_at").dropDuplicates(["question_id"])


def passages(spark: SparkSession, d: str) -> DataFrame:
    """One row a passage."""
    return table(spark, d, "passages").drop("ingested_at").dropDuplicates(["passage_id"])


def results(spark: SparkSession, d: str) -> DataFrame:
    """One row an answer."""
    return table(spark, d, "results").drop("ingested_at").dropDuplicates(["result_id"])


def scores(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, passage_id, score): the best score of each passage; null and NaN scores left out."""
    rows = table(spark, d, "retrieval_scores").where("score IS NOT NULL AND NOT isnan(score)")
    return rows.groupBy("query_id", passage_of(F.col("chunk_id")).alias("passage_id")).agg(F.max("score").alias("score"))


def ranked(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """(query_id, passage_id, score, rank): the k best passages of each query."""
    return row_ranks(scores(spark, d), "query_id", "score", "passage_id", k)


def gold(spark: SparkSession, d: str) -> DataFrame:
    """(question_id, passage_id, rel): gold passages with 2 and one more for each gold sentence, at most 4."""
    q = questions(spark, d)
    whole = q.select("question_id", F.explode("gold_passages_full").alias("passage_id")).where("passage_id IS NOT NULL").distinct()
    parts = q.select("question_id", F.explode("gold_passages").alias("s")).where("s IS NOT NULL").distinct()
    parts = parts.groupBy("question_id", F.regexp_replace("s", "_sent[0-9]+$", "_full").alias("passage_id")).agg(F.count(F.lit(1)).alias("n"))
    joined = whole.join(parts, ["question_id", "passage_id"], "left")
    return joined.select("question_id", "passage_id", F.least(F.lit(4), 2 + F.coalesce("n", F.lit(0))).cast("int").alias("rel"))


def is_query(question_id: Column) -> Column:
    """Whether a question is one of a search's queries."""
    return ordinal_of(question_id) % QUERY_STEP == 0


def keywords(text: Column) -> Column:
    """Keyword set of a text: distinct tokens of six or more characters."""
    return F.filter(F.array_distinct(label_tokens(text)), lambda t: F.length(t) >= 6)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, unit, keywords, title): usable vectors of unit length and their passages' keywords."""
    e = table(spark, d, "passages_emb").where(F.size("embedding") == DIM).dropDuplicates(["vec_id"])
    e = e.where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))).select("vec_id", "passage_id", l2_normalise(F.col("embedding")).alias("unit"))
    joined = e.where("unit IS NOT NULL").join(passages(spark, d), "passage_id", "left")
    return joined.select(F.col("vec_id").alias("doc_id"), "unit", F.coalesce(keywords(F.col("text")), F.array()).alias("keywords"), "title")


def vector_queries(docs: DataFrame) -> DataFrame:
    """(query_id, q_unit, keywords): every vector whose id is divisible by the step, asked by its passage's title."""
    rows = docs.where(F.col("doc_id") % QUERY_STEP == 0)
    words = F.coalesce(keywords(F.col("title")), F.array())
    return rows.select(F.col("doc_id").alias("query_id"), F.col("unit").alias("q_unit"), words.alias("keywords"))


def question_id_of(passage_id: Column) -> Column:
    """The question id in a passage id."""
    return question_of(passage_id)


WS, NON_WS = r"[\t\n\x{0B}\f\r \x{85}\p{Z}]", r"[^\t\n\x{0B}\f\r \x{85}\p{Z}]"

_ONCE = "{n} AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {o}) rn FROM {t}) WHERE rn = 1)"
Q = _ONCE.format(n="q", k="question_id", o="ingested_at", t="questions")
P = _ONCE.format(n="p", k="passage_id", o="ingested_at", t="passages")
R = _ONCE.format(n="r", k="result_id", o="ingested_at", t="results")
S = r"""s AS (SELECT query_id, regexp_replace(regexp_replace(chunk_id, '__sent[0-9]+$', ''), '__chunk[0-9]+$', '') AS passage_id,
    max(score) AS score FROM retrieval_scores WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2)"""
T10 = """t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM s) WHERE rank <= 10)"""
G = r"""g0 AS (SELECT DISTINCT question_id, unnest(gold_passages_full) AS passage_id FROM q),
g1 AS (SELECT question_id, regexp_replace(s, '_sent[0-9]+$', '_full') AS passage_id, count(*) AS n
    FROM (SELECT DISTINCT question_id, unnest(gold_passages) AS s FROM q) WHERE s IS NOT NULL GROUP BY 1, 2),
g AS (SELECT g0.question_id, g0.passage_id, CAST(least(4, 2 + coalesce(n, 0)) AS INT) AS rel
    FROM g0 LEFT JOIN g1 USING (question_id, passage_id) WHERE g0.passage_id IS NOT NULL)"""
IS_QUERY = r"(CAST(nullif(regexp_extract(question_id, '([0-9]{1,18})$', 1), '') AS BIGINT) % 50 = 0)"
KEYWORDS = "list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+')), lambda w: length(w) >= 6)"
TOKENS = "list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"
V = f"""e0 AS (SELECT vec_id, any_value(passage_id) AS passage_id, any_value(CAST(embedding AS DOUBLE[])) AS e FROM passages_emb
    WHERE len(embedding) = 96 AND NOT list_has_any(list_transform(embedding, lambda x: x IS NULL OR isnan(x)), [true]) GROUP BY 1),
{P},
v AS (SELECT vec_id AS doc_id, title, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS unit,
    coalesce({KEYWORDS.format(x='text')}, []) AS kw, coalesce({KEYWORDS.format(x='title')}, []) AS qkw
    FROM e0 LEFT JOIN p USING (passage_id) WHERE list_inner_product(e, e) > 0)"""
