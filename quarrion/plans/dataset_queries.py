"""Queries of segmentation, chunking, near misses, training examples, splits and ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrion.functions.ids import full_of, ordinal_of, passage_of
from quarrion.functions.text import relevance_band
from quarrion.operators import discourse as D
from quarrion.operators import examples as E
from quarrion.operators import models as O
from quarrion.operators import nearmiss as N
from quarrion.operators.chunking import ChunkConfig, chunk_table
from quarrion.operators.entities import entity_keywords as entity_words
from quarrion.plans import base as B
from quarrion.plans.metric_queries import _JUDGED
from quarrion.session import checkpointed, spread, table
from quarrion.sources.readers import unaliased
from quarrion.sources.sinks import unprocessed

Frame = DataFrame


# --- segmentation and chunks -----------------------------------------------------------------------------------


def sentence_split(spark: SparkSession, d: str) -> Frame:
    """Sentences of passages by the rule splitter."""
    return D.sentence_rows(B.passages(spark, d)).select("sentence_id", "span_start", "span_end")


def discourse_flags(spark: SparkSession, d: str) -> Frame:
    """Whether each sentence points back."""
    return D.sentence_rows(B.passages(spark, d)).select("sentence_id", "anaphoric")


def sentence_candidates(spark: SparkSession, d: str) -> Frame:
    """Sentences of passages with the context that markers ask for."""
    return D.expand_sentences(D.sentence_rows(B.passages(spark, d))).select("parent_id", "sent_idx", "context_start", "span_end", "expanded", "context")


def discourse_passages(spark: SparkSession, d: str) -> Frame:
    """Expanded sentences without those that an expansion repeats."""
    return D.discourse_passages(D.sentence_rows(B.passages(spark, d))).select("sentence_id", "expanded", "context")


def anaphora_hits(spark: SparkSession, d: str) -> Frame:
    """Markers of passages that point back."""
    return D.anaphora_table(B.passages(spark, d), "passage_id", "text")


def chunk_standard(spark: SparkSession, d: str) -> Frame:
    """Chunks of documents, 200 words with 30 overlapping."""
    return chunk_table(spread(table(spark, d, "documents")), id_col="doc_id").drop("text")


def chunk_discourse(spark: SparkSession, d: str) -> Frame:
    """Chunks of documents that follow discourse markers."""
    return chunk_table(spread(table(spark, d, "documents")), id_col="doc_id", discourse=True).drop("text")


def context_lookup(spark: SparkSession, d: str) -> Frame:
    """The chunk that gives the context of each running sentence number of a passage."""
    chunks = chunk_table(B.passages(spark, d), ChunkConfig(60, 15, 10))
    rows = D.sentence_rows(chunks.select(F.col("passage_id").alias("parent_id"), "text"), "parent_id").select("parent_id", "sent_idx")
    joined = rows.join(chunks.select(F.col("passage_id").alias("parent_id"), "source_id", "chunk_index", F.col("text").alias("chunk_text")), "parent_id")
    return D.context_lookup(joined.select("source_id", "chunk_index", "sent_idx", "chunk_text"))


# --- near misses -----------------------------------------------------------------------------------------------


def _sets(spark: SparkSession, d: str) -> Frame:
    return N.label_sets(B.questions(spark, d).where("question IS NOT NULL"), "question_id", "question", F.col("dataset"))


def near_miss_pairs_intra(spark: SparkSession, d: str) -> Frame:
    """Similar questions of one dataset."""
    return _rounded(N.shared_term_pairs(_sets(spark, d), 0.6, within=True))


def near_miss_pairs_cross(spark: SparkSession, d: str) -> Frame:
    """Similar questions of different datasets."""
    return _rounded(N.shared_term_pairs(_sets(spark, d), 0.6, within=False))


def _rounded(pairs: Frame) -> Frame:
    return pairs.select("a", "b", F.round("jaccard", 6).alias("jaccard"), F.round("overlap", 6).alias("overlap"))


def seq_ratio(spark: SparkSession, d: str) -> Frame:
    """All pairs of questions of a combined score of 0.6, with their sequence ratio."""
    return N.scored_over(_sets(spark, d), 0.6)


def near_miss_mined(spark: SparkSession, d: str) -> Frame:
    """Best partners of each question over all questions, six within its dataset and two of others, one row a pair."""
    scored = lambda within: N.scored_over(_sets(spark, d), 0.6, within, both=True)
    pairs = N.top_pairs(scored(True), 6).unionByName(N.top_pairs(scored(False), 2))
    return pairs.select("a", "b", "score")


def near_miss_top(spark: SparkSession, d: str) -> Frame:
    """Three best partners of each left passage of the older run, one row a pair."""
    pairs = table(spark, d, "scored_pairs").where("score IS NOT NULL").groupBy("left_id", "right_id").agg(F.max("score").alias("score"))
    return N.top_pairs(pairs, 3, "left_id", "right_id").select("a", "b", F.round("score", 6).alias("score"))


def _pairs(spark: SparkSession, d: str) -> Frame:
    return table(spark, d, "scored_pairs").where("jaccard >= 0.7").select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))


def _catalog(spark: SparkSession, d: str) -> Frame:
    return B.passages(spark, d).select(F.col("passage_id").alias("id"), F.substring_index("passage_id", "_", 1).alias("category"))


def near_miss_map(spark: SparkSession, d: str) -> Frame:
    """Near-miss passages in both directions."""
    return N.near_miss_map(_pairs(spark, d), _catalog(spark, d))[0]


def unknown_near_miss(spark: SparkSession, d: str) -> Frame:
    """Ends of pairs that are no question of the train split."""
    q = B.questions(spark, d).where(F.lower(F.trim("split")) == "train").select(F.col("question_id").alias("id"))
    pairs = _pairs(spark, d).select(F.substring_index("a", "__", 1).alias("a"), F.substring_index("b", "__", 1).alias("b"))
    return N.near_miss_map(pairs, q)[1]


def sibling_map(spark: SparkSession, d: str) -> Frame:
    """Passages of the same dataset, counted."""
    return N.sibling_counts(_catalog(spark, d))


def ontology_summary(spark: SparkSession, d: str) -> Frame:
    """Labels and near-miss links per category."""
    return N.ontology_summary(_catalog(spark, d), near_miss_map(spark, d))


def trick_queries_template(spark: SparkSession, d: str) -> Frame:
    """Four trick queries for each pair of near-miss titles."""
    titles = B.passages(spark, d).where("title IS NOT NULL").select("passage_id", "title")
    pairs = _pairs(spark, d).where("a < b").distinct()
    named = pairs.join(titles.select(F.col("passage_id").alias("a"), F.col("title").alias("ta")), "a").join(titles.select(F.col("passage_id").alias("b"), F.col("title").alias("tb")), "b")
    return N.trick_queries(named, "ta", "tb", 4).select("a", "b", "ordinal", "target", "trick")


# --- examples --------------------------------------------------------------------------------------------------


def _judgements(spark: SparkSession, d: str) -> Frame:
    """(query_id, doc_id, score): retrieval scores as grades from 0 to 4."""
    rows = table(spark, d, "retrieval_scores").where("score IS NOT NULL AND NOT isnan(score)")
    return rows.select("query_id", passage_of(F.col("chunk_id")).alias("doc_id"), F.least(F.lit(4), F.floor(F.col("score") * 5)).cast("int").alias("score"))


def qrels_dedupe(spark: SparkSession, d: str) -> Frame:
    """Best grade of each query and passage."""
    return E.best_judgements(_judgements(spark, d))


def relevance_bands(spark: SparkSession, d: str) -> Frame:
    """Passages per query and band."""
    return qrels_dedupe(spark, d).groupBy("query_id", relevance_band("score").alias("band")).agg(F.count(F.lit(1)).alias("n"))


def training_packages(spark: SparkSession, d: str) -> Frame:
    """All positives, hard and easy negatives of each query, best first, in lists of a thousand."""
    docs = F.array_join(F.transform("docs", lambda x: F.concat(x["doc_id"], F.lit(":"), x["score"].cast("string"))), " ")
    return E.package_blocks(qrels_dedupe(spark, d)).select("query_id", "band", "block", docs.alias("docs"))


def training_packages_all(spark: SparkSession, d: str) -> Frame:
    """All positives, hard and easy negatives of each query, one ranked row a document."""
    return E.package_rows(qrels_dedupe(spark, d))


def _examples(spark: SparkSession, d: str) -> tuple[Frame, Frame, Frame]:
    """Judgements, positives, and near-miss questions in both directions; only of questions that have positives, since no
    others have examples or give them."""
    judged = _judgements(spark, d)
    positives = checkpointed(E.positives_of(judged))
    sets = _sets(spark, d).join(positives.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi")
    pairs = checkpointed(N.shared_term_pairs(sets, 0.6).select("a", "b"))
    ends = [F.struct(F.col(x).alias("id"), F.col(y).alias("neighbour")) for x, y in ("ab", "ba")]
    return judged, positives, pairs.select(F.explode(F.array(*ends)).alias("e")).select("e.*")


def _categories(spark: SparkSession, d: str) -> Frame:
    return N.label_sets(B.questions(spark, d), "question_id", "question", F.col("dataset")).select("id", "category")


def retriever_examples(spark: SparkSession, d: str) -> Frame:
    """Labelled passages of each query with near-miss negatives."""
    judged, positives, mapped = _examples(spark, d)
    rows = E.retriever_examples(judged, mapped, positives=positives)
    return rows.select("query_id", "doc_id", "label_type", "label", E.difficulty(F.col("label_type")).alias("difficulty"))


def retriever_examples_all(spark: SparkSession, d: str) -> Frame:
    """Labelled passages of each query with near-miss and sibling negatives, siblings many to an array."""
    judged, positives, mapped = _examples(spark, d)
    rows = E.example_blocks(judged, mapped, _categories(spark, d), positives)
    return rows.select("query_id", "label_type", "label", E.difficulty(F.col("label_type")).alias("difficulty"), "docs")


def split_by_difficulty_all(spark: SparkSession, d: str) -> Frame:
    """Examples per label type and difficulty, siblings included."""
    judged, positives, mapped = _examples(spark, d)
    counts = E.example_counts(judged, mapped, _categories(spark, d), positives)
    return counts.select("label_type", E.difficulty(F.col("label_type")).alias("difficulty"), "n")


def split_by_difficulty(spark: SparkSession, d: str) -> Frame:
    """Examples per label type and difficulty, and those of an early and a late epoch."""
    counts = checkpointed(retriever_examples(spark, d).groupBy("label_type", "difficulty").agg(F.count(F.lit(1)).alias("n")))
    early = E.curriculum(counts, 0, 2).groupBy("label_type").agg(F.sum("n").alias("early"))
    late = E.curriculum(counts, 3, 2, mixed=False).groupBy("label_type").agg(F.sum("n").alias("late"))
    return counts.join(early, "label_type", "left").join(late, "label_type", "left").fillna(0)


def carve_split(spark: SparkSession, d: str) -> Frame:
    """A tenth of the questions as validation."""
    return E.carve_validation(B.questions(spark, d), "question_id", ordinal_of(F.col("question_id")), 0.1, 13)


def carve_passages(spark: SparkSession, d: str) -> Frame:
    """The part of each passage, by its question."""
    parts = carve_split(spark, d)
    p = B.passages(spark, d).select("passage_id", F.substring_index("passage_id", "__", 1).alias("question_id"))
    return p.join(parts, "question_id").select("passage_id", "part")


def seeded_sample(spark: SparkSession, d: str) -> Frame:
    """Five questions of each dataset in seeded order."""
    return E.seeded_sample(B.questions(spark, d), ordinal_of(F.col("question_id")), "question_id", 5, 7, "dataset").select("dataset", "question_id")


def resume_antijoin(spark: SparkSession, d: str) -> Frame:
    """Passages that no retrieval row is of."""
    done = table(spark, d, "retrieval_scores").select(passage_of(F.col("chunk_id")).alias("passage_id"), "score")
    return unprocessed(B.passages(spark, d).select("passage_id"), done, "passage_id", "score")


def resume_unanswered(spark: SparkSession, d: str) -> Frame:
    """Questions that no answer but ``unknown`` is known of."""
    done = B.results(spark, d).select("question_id", F.nullif("normalised_answer", F.lit("unknown")).alias("answer"))
    return unprocessed(B.questions(spark, d).select("question_id", "dataset"), done, "question_id", "answer")


def shards(spark: SparkSession, d: str) -> Frame:
    """Documents in four contiguous shards."""
    return E.shards(table(spark, d, "documents").select("doc_id"), "doc_id", 4)


def minibatches(spark: SparkSession, d: str) -> Frame:
    """Answers dealt out to batches of 32, each with a correct one while they last."""
    from quarrion.plans.metric_queries import _judged

    return E.minibatches(_judged(spark, d).select("result_id", "em"), F.col("em") == 1, F.col("result_id"), "result_id", 32, 5)


def sentence_examples(spark: SparkSession, d: str) -> Frame:
    """Gold sentences, others of the question's passages, and random ones."""
    q = B.questions(spark, d)
    gold = q.select("question_id", ordinal_of(F.col("question_id")).alias("number"), F.filter(F.coalesce("gold_passages", F.array()), lambda x: x.isNotNull()).alias("gold"))
    s = D.sentence_rows(B.passages(spark, d)).select(F.regexp_replace("parent_id", "_full$", F.concat(F.lit("_sent"), F.col("sent_idx").cast("string"))).alias("sentence_id"), F.substring_index("parent_id", "__", 1).alias("question_id"))
    s = s.withColumn("number", F.pmod(F.crc32("sentence_id"), F.lit(1000000)))
    return E.sentence_examples(gold.where("number IS NOT NULL"), s, 2, 2, 11)


# --- joins of ingest -------------------------------------------------------------------------------------------


def alias_resolution(spark: SparkSession, d: str) -> Frame:
    """Gold passages with near-copies replaced by the copy of least id."""
    kept = _pairs(spark, d).where("a > b").groupBy(F.col("a").alias("dropped_id")).agg(F.min("b").alias("kept_id"))
    gold = B.questions(spark, d).select("question_id", F.filter("gold_passages_full", lambda x: x.isNotNull()).alias("gold"))
    return unaliased(gold, kept, "question_id").select("question_id", F.array_join("gold", " ").alias("gold"))


def gold_texts(spark: SparkSession, d: str) -> Frame:
    """Gold passages' titles in order, missing passages counted."""
    q = B.questions(spark, d).select("question_id", F.posexplode(F.array_distinct("gold_passages_full")).alias("place", "passage_id")).where("passage_id IS NOT NULL")
    joined = q.join(B.passages(spark, d).select("passage_id", F.coalesce("title", F.lit("")).alias("title"), F.lit(1).alias("known")), "passage_id", "left")
    titles = F.transform(F.array_sort(F.collect_list(F.when(F.col("known") == 1, F.struct("place", "title")))), lambda x: x["title"])
    return joined.groupBy("question_id").agg(F.array_join(titles, "|").alias("titles"), F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("missing"))


def question_passages(spark: SparkSession, d: str) -> Frame:
    """Passages of each question, nested in id order."""
    p = B.passages(spark, d).select(F.substring_index("passage_id", "__", 1).alias("question_id"), "passage_id")
    rows = B.questions(spark, d).select("question_id").join(p, "question_id", "left")
    return rows.groupBy("question_id").agg(F.array_join(F.array_sort(F.collect_list("passage_id")), " ").alias("passages"), F.count("passage_id").alias("n"))


def same_question_negatives(spark: SparkSession, d: str) -> Frame:
    """Passages of a question that are not gold."""
    p = B.passages(spark, d).select(F.substring_index("passage_id", "__", 1).alias("question_id"), "passage_id")
    gold = B.gold(spark, d).select("question_id", "passage_id")
    return p.join(B.questions(spark, d).select("question_id"), "question_id", "left_semi").join(gold, ["question_id", "passage_id"], "left_anti").select("question_id", "passage_id")


def gold_levels(spark: SparkSession, d: str) -> Frame:
    """Full-passage ids of gold sentences that the full gold list lacks."""
    q = B.questions(spark, d)
    parts = q.select("question_id", F.explode("gold_passages").alias("s")).where("s IS NOT NULL").select("question_id", full_of(F.col("s")).alias("passage_id")).distinct()
    return parts.join(B.gold(spark, d).select("question_id", "passage_id"), ["question_id", "passage_id"], "left_anti")


def latest_delivery(spark: SparkSession, d: str) -> Frame:
    """Deliveries of each passage, and the last."""
    last = Window.partitionBy("passage_id").orderBy(F.desc("ingested_at"))
    rows = table(spark, d, "passages").withColumn("r", F.row_number().over(last)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("passage_id")))
    return rows.where("r = 1").select("passage_id", "n", F.date_format("ingested_at", "yyyy-MM-dd HH:mm:ss").alias("last"))


# --- models ----------------------------------------------------------------------------------------------------


def embed(spark: SparkSession, d: str) -> Frame:
    """Vectors of passage titles by the default encoder, rounded."""
    rows = O.embed(B.passages(spark, d).select("passage_id", "title"), "passage_id", "title")
    return rows.select("vec_id", "passage_id", F.transform("embedding", lambda x: F.round(x, 4)).alias("embedding"))


def entity_keywords(spark: SparkSession, d: str) -> Frame:
    """Keywords of the names in passages."""
    return entity_words(B.passages(spark, d), "passage_id", "text")


def extractive_answer(spark: SparkSession, d: str) -> Frame:
    """Answers of the default reader from the retrieved passages."""
    q = B.questions(spark, d).where("question IS NOT NULL").select("question_id", "question")
    rows = B.ranked(spark, d, 5).join(B.passages(spark, d).select("passage_id", "text"), "passage_id").where("text IS NOT NULL")
    return O.answer_extractively(q, rows.select(F.col("query_id").alias("question_id"), "rank", "text"), 400, 150)


def pair_scores(spark: SparkSession, d: str) -> Frame:
    """Scores of the default pair scorer for retrieved passages."""
    q = B.questions(spark, d).where("question IS NOT NULL").select(F.col("question_id").alias("query_id"), "question")
    rows = B.ranked(spark, d, 5).select("query_id", "passage_id").join(q, "query_id").join(B.passages(spark, d).select("passage_id", "text"), "passage_id")
    return O.score_pairs(rows, "question", "text").select("query_id", "passage_id", F.round("score", 6).alias("score"))


QUERIES = {
    f.__name__: f
    for f in (
        sentence_split, discourse_flags, sentence_candidates, discourse_passages, anaphora_hits, chunk_standard, chunk_discourse, context_lookup,
        near_miss_pairs_intra, near_miss_pairs_cross, seq_ratio, near_miss_top, near_miss_mined, near_miss_map, unknown_near_miss, sibling_map, ontology_summary,
        trick_queries_template, qrels_dedupe, relevance_bands, training_packages, training_packages_all, retriever_examples, retriever_examples_all, split_by_difficulty,
        split_by_difficulty_all, carve_split,
        carve_passages, seeded_sample, resume_antijoin, resume_unanswered, shards, minibatches, sentence_examples, alias_resolution, gold_texts,
        question_passages, same_question_negatives, gold_levels, latest_delivery, embed, entity_keywords, extractive_answer, pair_scores,
    )
}

_C = r"regexp_replace(regexp_replace(chunk_id, '__sent[0-9]+$', ''), '__chunk[0-9]+$', '')"
_LS = f"ls AS (SELECT question_id AS id, coalesce(nullif(trim(dataset), ''), 'uncategorized') AS cat, {B.TOKENS.format(x='question')} AS t FROM q WHERE question IS NOT NULL)"
_PAIRS = """pr AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.t, y.t)) AS n, len(x.t) AS na, len(y.t) AS nb FROM ls x JOIN ls y ON x.id < y.id {on} AND len(list_intersect(x.t, y.t)) > 0),
ps AS (SELECT a, b, n / (na + nb - n) AS jaccard, n / least(na, nb) AS overlap FROM pr WHERE n / (na + nb - n) >= 0.6 - 1e-12)"""
_SP = "sp AS (SELECT left_id AS a, right_id AS b FROM scored_pairs WHERE jaccard >= 0.7)"
_CAT = "ct AS (SELECT passage_id AS id, split_part(passage_id, '_', 1) AS category FROM p)"
_BOTH = "bo AS (SELECT DISTINCT * FROM (SELECT a AS id, b AS neighbour FROM sp UNION ALL SELECT b, a FROM sp) WHERE id <> neighbour)"
_MAPPED = f"{B.P}, {_SP}, {_CAT}, {_BOTH}, mp AS (SELECT id, neighbour FROM bo WHERE id IN (SELECT id FROM ct) AND neighbour IN (SELECT id FROM ct))"
_QR = f"""qr AS (SELECT query_id, {_C} AS doc_id, max(CAST(least(4, floor(score * 5)) AS INT)) AS score FROM retrieval_scores WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY 1, 2)"""
_BAND = "CASE WHEN score >= 3 THEN 'pos' WHEN score >= 2 THEN 'hard' WHEN score <= 1 THEN 'neg' END"
_EX = f"""{B.Q}, {_QR}, {_LS}, {_PAIRS.format(on='')}, nm AS (SELECT a AS id, b AS neighbour FROM ps UNION SELECT b, a FROM ps),
ow AS (SELECT query_id, doc_id, CASE {_BAND} WHEN 'pos' THEN 'pos' WHEN 'neg' THEN 'easy' ELSE 'hard' END AS label_type FROM qr WHERE {_BAND} IS NOT NULL),
al AS (SELECT * FROM ow UNION ALL SELECT nm.id, ow.doc_id, 'near_miss' FROM nm JOIN ow ON ow.query_id = nm.neighbour AND label_type = 'pos'),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY list_position(['pos', 'easy', 'hard', 'near_miss', 'sibling'], label_type)) AS n FROM al WHERE query_id IN (SELECT query_id FROM ow WHERE label_type = 'pos')),
ex AS (SELECT query_id, doc_id, label_type, CAST(label_type = 'pos' AS INT) AS label, CASE label_type WHEN 'pos' THEN 'pos' WHEN 'easy' THEN 'easy' ELSE 'hard' END AS difficulty FROM rk WHERE n = 1)"""
_NUM = r"CAST(nullif(regexp_extract(question_id, '([0-9]{1,18})$', 1), '') AS BIGINT)"
_CARVE = f"""{B.Q}, cv AS (SELECT question_id, row_number() OVER (ORDER BY ({_NUM} * 2654435761 + 13) % 1000003, question_id) AS n, round_even(count(*) OVER () * 0.1, 0) AS want FROM q),
pt AS (SELECT question_id, CASE WHEN n <= want THEN 'val' ELSE 'train' END AS part FROM cv)"""
_TITLES = N.TRICK_TEMPLATES[:4]
_TRICKS = " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{t}' AS target, '{x}' AS template" for i, (t, x) in enumerate(_TITLES)
)


ORACLE_SQL = {
    "minibatches": f"""WITH {_JUDGED}, n AS (SELECT result_id, em, row_number() OVER (ORDER BY CASE WHEN em = 1 THEN 0 ELSE 1 END, (result_id * 2654435761 + 5) % 1000003, result_id) - 1 AS k, count(*) OVER () AS c FROM j)
        SELECT result_id, em, CAST(k % greatest(CAST(ceil(c / 32) AS BIGINT), 1) AS INT) AS batch FROM n""",
    "near_miss_pairs_intra": f"WITH {B.Q}, {_LS}, {_PAIRS.format(on='AND x.cat = y.cat')} SELECT a, b, round(jaccard, 6) AS jaccard, round(overlap, 6) AS overlap FROM ps",
    "near_miss_pairs_cross": f"WITH {B.Q}, {_LS}, {_PAIRS.format(on='AND x.cat <> y.cat')} SELECT a, b, round(jaccard, 6) AS jaccard, round(overlap, 6) AS overlap FROM ps",
    "near_miss_top": """WITH x AS (SELECT left_id, right_id, max(score) AS score FROM scored_pairs WHERE score IS NOT NULL GROUP BY 1, 2),
        y AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS r FROM x)
        SELECT least(left_id, right_id) AS a, greatest(left_id, right_id) AS b, round(max(score), 6) AS score FROM y WHERE r <= 3 AND left_id <> right_id GROUP BY 1, 2""",
    "near_miss_map": f"WITH {_MAPPED} SELECT id, neighbour FROM mp",
    "unknown_near_miss": f"""WITH {B.Q}, sp AS (SELECT split_part(left_id, '__', 1) AS a, split_part(right_id, '__', 1) AS b FROM scored_pairs WHERE jaccard >= 0.7), {_BOTH}
        SELECT DISTINCT id FROM bo WHERE id NOT IN (SELECT question_id FROM q WHERE lower(trim(split)) = 'train')""",
    "sibling_map": f"WITH {B.P}, {_CAT} SELECT id, category, count(*) OVER (PARTITION BY category) - 1 AS siblings FROM ct",
    "ontology_summary": f"""WITH {_MAPPED}, l AS (SELECT id, count(*) AS n FROM mp GROUP BY 1)
        SELECT category, count(*) AS labels, count(n) AS labels_with_near_miss, coalesce(sum(n), 0) AS links FROM ct LEFT JOIN l USING (id) GROUP BY 1""",
    "trick_queries_template": f"""WITH {B.P}, {_SP}, x AS (SELECT DISTINCT a, b FROM sp WHERE a < b), t AS ({_TRICKS})
        SELECT a, b, ordinal, target, replace(replace(template, '{{a}}', pa.title), '{{b}}', pb.title) AS trick FROM x JOIN p pa ON pa.passage_id = a AND pa.title IS NOT NULL JOIN p pb ON pb.passage_id = b AND pb.title IS NOT NULL, t""",
    "qrels_dedupe": f"WITH {_QR} SELECT * FROM qr",
    "relevance_bands": f"WITH {_QR} SELECT query_id, {_BAND} AS band, count(*) AS n FROM qr GROUP BY 1, 2",
    "training_packages": f"""WITH {_QR}, x AS (SELECT *, {_BAND} AS band FROM qr), y AS (SELECT *, row_number() OVER (PARTITION BY query_id, band ORDER BY score DESC, doc_id) AS r
        FROM x WHERE band IS NOT NULL AND query_id IN (SELECT query_id FROM x WHERE band = 'pos'))
        SELECT query_id, band, CAST((r - 1) // 1000 AS INT) AS block, string_agg(doc_id || ':' || CAST(score AS VARCHAR), ' ' ORDER BY r) AS docs FROM y GROUP BY 1, 2, 3""",
    "training_packages_all": f"""WITH {_QR}, x AS (SELECT *, {_BAND} AS band FROM qr) SELECT query_id, band, row_number() OVER (PARTITION BY query_id, band ORDER BY score DESC, doc_id) AS rank, doc_id, score
        FROM x WHERE band IS NOT NULL AND query_id IN (SELECT query_id FROM x WHERE band = 'pos')""",
    "retriever_examples": f"WITH {_EX} SELECT * FROM ex",
    "split_by_difficulty": f"""WITH {_EX} SELECT label_type, difficulty, count(*) AS n, count(*) FILTER (difficulty IN ('pos', 'easy')) AS early, count(*) FILTER (difficulty IN ('pos', 'hard')) AS late FROM ex GROUP BY 1, 2""",
    "split_by_difficulty_all": f"""WITH {_EX}, ct AS (SELECT question_id AS id, coalesce(nullif(trim(dataset), ''), 'uncategorized') AS cat FROM q WHERE question_id IS NOT NULL),
        mb AS (SELECT ex.query_id, ex.doc_id, ct.cat FROM ex JOIN ct ON ct.id = ex.query_id WHERE label_type = 'pos'),
        pl AS (SELECT DISTINCT cat, doc_id FROM mb), qs AS (SELECT DISTINCT query_id, cat FROM mb),
        sb AS (SELECT count(*) AS n FROM qs JOIN pl USING (cat) WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.query_id = qs.query_id AND ex.doc_id = pl.doc_id))
        SELECT label_type, difficulty, count(*) AS n FROM ex GROUP BY 1, 2 UNION ALL SELECT 'sibling', 'hard', n FROM sb WHERE n > 0""",
    "carve_split": f"WITH {_CARVE} SELECT question_id, part FROM pt",
    "carve_passages": f"WITH {_CARVE}, {B.P} SELECT passage_id, part FROM p JOIN pt ON pt.question_id = split_part(passage_id, '__', 1)",
    "seeded_sample": f"""WITH {B.Q} SELECT dataset, question_id FROM (SELECT dataset, question_id, row_number() OVER (PARTITION BY dataset ORDER BY ({_NUM} * 2654435761 + 7) % 1000003, question_id) AS r FROM q) WHERE r <= 5""",
    "resume_antijoin": f"WITH {B.P} SELECT passage_id FROM p WHERE passage_id NOT IN (SELECT {_C} FROM retrieval_scores WHERE score IS NOT NULL)",
    "resume_unanswered": f"""WITH {B.Q}, {B.R} SELECT question_id, dataset FROM q WHERE question_id NOT IN
        (SELECT question_id FROM r WHERE question_id IS NOT NULL AND normalised_answer <> 'unknown')""",
    "shards": "SELECT doc_id, CAST(ntile(4) OVER (ORDER BY doc_id) - 1 AS INT) AS shard FROM documents",
    "alias_resolution": f"""WITH {B.Q}, {_SP}, k AS (SELECT a AS dropped, min(b) AS kept FROM sp WHERE a > b GROUP BY 1), x AS (SELECT question_id, l[i] AS g, i FROM (SELECT question_id, list_filter(gold_passages_full, lambda x: x IS NOT NULL) AS l, unnest(range(1, len(list_filter(gold_passages_full, lambda x: x IS NOT NULL)) + 1)) AS i FROM q)),
        y AS (SELECT question_id, coalesce(kept, g) AS g, min(i) AS i FROM x LEFT JOIN k ON dropped = g GROUP BY 1, 2) SELECT question_id, string_agg(g, ' ' ORDER BY i) AS gold FROM y GROUP BY 1""",
    "gold_texts": f"""WITH {B.Q}, {B.P}, x AS (SELECT question_id, gold_passages_full[i] AS g, min(i) AS i FROM (SELECT question_id, gold_passages_full, unnest(range(1, len(gold_passages_full) + 1)) AS i FROM q) GROUP BY 1, 2)
        SELECT question_id, coalesce(string_agg(coalesce(title, ''), '|' ORDER BY i) FILTER (p.passage_id IS NOT NULL), '') AS titles, count(*) FILTER (p.passage_id IS NULL) AS missing FROM x LEFT JOIN p ON p.passage_id = g WHERE g IS NOT NULL GROUP BY 1""",
    "question_passages": f"""WITH {B.Q}, {B.P} SELECT question_id, coalesce(string_agg(passage_id, ' ' ORDER BY passage_id), '') AS passages, count(passage_id) AS n FROM q LEFT JOIN p ON split_part(passage_id, '__', 1) = question_id GROUP BY 1""",
    "same_question_negatives": f"""WITH {B.Q}, {B.P}, {B.G} SELECT q.question_id, passage_id FROM p JOIN q ON q.question_id = split_part(passage_id, '__', 1)
        WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.question_id = q.question_id AND g.passage_id = p.passage_id)""",
    "gold_levels": f"""WITH {B.Q}, {B.G}, x AS (SELECT DISTINCT question_id, regexp_replace(regexp_replace(regexp_replace(s, '__sent[0-9]+$', ''), '__chunk[0-9]+$', ''), '_sent[0-9]+$', '_full') AS passage_id FROM (SELECT question_id, unnest(gold_passages) AS s FROM q) WHERE s IS NOT NULL)
        SELECT question_id, passage_id FROM x WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.question_id = x.question_id AND g.passage_id = x.passage_id)""",
    "latest_delivery": "SELECT passage_id, count(*) AS n, strftime(max(ingested_at) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS last FROM passages GROUP BY 1",
    "pair_scores": f"""WITH {B.Q}, {B.P}, {B.S}, {B.T10}, x AS (SELECT t.query_id, t.passage_id, {B.TOKENS.format(x='q.question')} AS a, coalesce({B.TOKENS.format(x='p.text')}, []) AS b
        FROM t JOIN q ON q.question_id = t.query_id AND question IS NOT NULL JOIN p USING (passage_id) WHERE rank <= 5)
        SELECT query_id, passage_id, round(CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0 END, 6) AS score FROM x""",
}
