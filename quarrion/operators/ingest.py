"""Ingest of whole datasets: raw records to questions, sentence passages, full passages and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.functions.ids import full_passage_id, sentence_passage_id
from quarrion.functions.text import clean_text, relevance_band, split_alias
from quarrion.operators.chunking import ChunkConfig, chunk_table
from quarrion.operators.examples import best_judgements, training_packages
from quarrion.sources.readers import field_map_context


def in_split(split: Column, wanted: str) -> Column:
    """Whether a row belongs to a split; rows of a blank split belong to all."""
    name = split_alias(split)
    return F.coalesce(name, F.lit("")).isin("", "valid" if wanted in ("dev", "validation") else wanted)


def ingest_contexts(raw: DataFrame, dataset: str, split: str, config: ChunkConfig | None = None) -> dict[str, DataFrame]:
    """Tables of records with nested titled sentence lists (``_id``, question, answer, context, supporting_facts).

    ``questions`` has the gold ids of both levels in order, ``passages`` one row a sentence, ``full_passages`` one a
    title, ``chunks`` and ``discourse_chunks`` their chunks. Blank texts are left out, ids come once.
    """
    rows = field_map_context(raw).withColumn("text", clean_text("sentence")).where("text <> ''")
    qid, title = F.col("question_id"), F.col("title")
    rows = rows.withColumn("passage_id", sentence_passage_id(qid, title, F.col("sent_idx"))).withColumn("full_id", full_passage_id(qid, title))
    passages = rows.select("passage_id", "title", "text").dropDuplicates(["passage_id"])
    parts = F.array_sort(F.collect_list(F.struct("sent_idx", "text")))
    full = rows.groupBy(F.col("full_id").alias("passage_id")).agg(F.min("title").alias("title"), F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("gold"), F.struct("title", "sent_idx", "passage_id", "full_id"))))
    gold = rows.groupBy("question_id").agg(ordered.alias("g"))
    questions = raw.select(F.col("_id").alias("question_id"), "question", F.col("answer").alias("gold_answer")).join(gold, "question_id", "left")
    listed = lambda c: F.array_distinct(F.transform(F.coalesce("g", F.array()), lambda x: x[c]))
    questions = questions.select(
        "question_id", F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), "question", "gold_answer",
        listed("passage_id").alias("gold_passages"), listed("full_id").alias("gold_passages_full"),
    )
    return {
        "questions": questions,
        "passages": passages,
        "full_passages": full,
        "chunks": chunk_table(full, config),
        "discourse_chunks": chunk_table(full, config, discourse=True),
    }


def ingest_clauses(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, split: str, config: ChunkConfig | None = None) -> dict[str, DataFrame]:
    """Tables of a clause dataset: judged questions of a split, training packages, the corpus and its chunks.

    Judgements of unknown queries and documents are dropped, the best of a pair counts. A document of one chunk keeps
    its id; the chunks of others are numbered.
    """
    asked = queries.where(in_split(F.col("split"), split))
    judged = best_judgements(qrels).join(asked.select("query_id"), "query_id", "left_semi").join(corpus.select("doc_id"), "doc_id", "left_semi")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "doc_id", relevance_band("score").alias("band"))))
    lists = judged.groupBy("query_id").agg(F.transform(listed, lambda x: F.struct(x["doc_id"].alias("doc_id"), (-x["far"]).alias("score"), x["band"].alias("band"))).alias("qrels"))
    chunks = chunk_table(corpus, config, id_col="doc_id", keep=())
    chunks = chunks.withColumn("passage_id", F.when(F.col("chunk_count") == 1, F.col("source_id")).otherwise(F.col("passage_id")))
    return {"questions": asked.join(lists, "query_id"), "packages": training_packages(judged), "corpus": corpus, "chunks": chunks}
