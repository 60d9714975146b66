"""Where models plug in: encoders, scorers and readers, with deterministic defaults.

Each is a function on Arrow batches of columns, made once per worker; a real model takes the place of the default.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.functions.text import accept_answer, first_fragment, strip, strip_think
from quarrion.operators.ordinals import with_row_numbers
from quarrion.operators.retrieval import row_ranks
from quarrion.operators.selection import pack_passages

TextModel = Callable[[], Callable[[pd.Series], list]]
PairModel = Callable[[], Callable[[pd.Series, pd.Series], list]]


def hashing_encoder(dim: int = 64) -> TextModel:
    """Default encoder: hashed bags of words of unit length."""

    def make() -> Callable[[pd.Series], list]:
        def encode(texts: pd.Series) -> list:
            out = []
            for text in texts:
                vector = np.zeros(dim)
                for word in re.findall(r"\w+", (text or "").lower()):
                    code = zlib.crc32(word.encode())
                    vector[code % dim] += 1 if code & 0x10000 else -1
                norm = np.linalg.norm(vector)
                out.append((vector / norm if norm else vector).astype(np.float32))
            return out

        return encode

    return make


def overlap_scorer() -> PairModel:
    """Default pair scorer: share of the query's words that the text has."""

    def make() -> Callable[[pd.Series, pd.Series], list]:
        def score(queries: pd.Series, texts: pd.Series) -> list:
            out = []
            for query, text in zip(queries, texts, strict=True):
                want = set(re.findall(r"[a-z0-9]+", (query or "").lower()))
                out.append(len(want & set(re.findall(r"[a-z0-9]+", (text or "").lower()))) / len(want) if want else 0.0)
            return out

        return score

    return make


def embed(df: DataFrame, id_col: str, text_col: str, model: TextModel | None = None, offset: int = 0) -> DataFrame:
    """(vec_id, id, embedding): vec_id counts from ``offset`` by id."""
    make = model or hashing_encoder()

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = make()
        for texts in batches:
            yield pd.Series(run(texts))

    rows = with_row_numbers(df.select(id_col, text_col), id_col, "vec_id")
    return rows.select((F.col("vec_id") + offset).cast("bigint").alias("vec_id"), F.col(id_col), encode(F.col(text_col)).alias("embedding"))


def score_pairs(df: DataFrame, query_col: str, text_col: str, model: PairModel | None = None, name: str = "score") -> DataFrame:
    """``df`` with a model's score of each (query, text)."""
    make = model or overlap_scorer()

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        run = make()
        for queries, texts in batches:
            yield pd.Series(run(queries, texts), dtype="float64")

    return df.withColumn(name, score(F.col(query_col), F.col(text_col)))


def answer_extractively(questions: DataFrame, ranked: DataFrame, budget: int, cap: int | None = None) -> DataFrame:
    """(question_id, answer, passages): default reader, the first fragment of the best-scoring packed passage.

    ``ranked`` has (question_id, rank, text). Without any passage, or if the answer is rejected, it is ``unknown``.
    """
    packed = pack_passages(ranked, "question_id", "rank", "text", budget, cap)
    scored = score_pairs(packed.join(questions.select("question_id", "question"), "question_id"), "question", "text")
    best = scored.groupBy("question_id").agg(
        F.max_by("text", F.struct("score", (-F.col("rank")).alias("r"))).alias("text"), F.count(F.lit(1)).alias("passages")
    )
    out = questions.select("question_id").join(best, "question_id", "left")
    said = F.nullif(strip(F.coalesce(accept_answer(first_fragment("text")), F.lit(""))), F.lit(""))
    return out.select("question_id", F.coalesce(said, F.lit("unknown")).alias("answer"), F.coalesce("passages", F.lit(0)).alias("passages"))


def first_candidates(keep: int = 3) -> TextModel:
    """Default candidate filter: the first ids of the prompt's list."""

    def make() -> Callable[[pd.Series], list]:
        def pick(prompts: pd.Series) -> list:
            return [json.dumps({"near_miss_ids": re.findall(r"(?m)^\d+\. (.*?) \| ", x or "")[:keep]}) for x in prompts]

        return pick

    return make


def picked_ids(answer: Column) -> Column:
    """Trimmed ids of a model's ``{"near_miss_ids": [...]}``; none if it is no such JSON."""
    ids = F.from_json(strip_think(answer), "near_miss_ids array<string>")["near_miss_ids"]
    return F.filter(F.transform(F.coalesce(ids, F.array()), strip), lambda x: x.isNotNull() & (x != ""))


def filter_pairs(pairs: DataFrame, labels: DataFrame, model: TextModel | None = None, most: int = 6, keep: int = 3) -> DataFrame:
    """``pairs`` (a, b, score) that a model picks for either end out of its ``most`` best partners.

    ``labels`` has (id, label, category). Ids that the model makes up are dropped.
    """
    make = model or first_candidates(keep)

    @F.pandas_udf("string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = make()
        for prompts in batches:
            yield pd.Series(run(prompts), dtype="object")

    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "score").unionByName(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "score"))
    best = row_ranks(both, "id", "score", "other", most)
    named = best.join(labels.select(F.col("id").alias("other"), "label", "category"), "other")
    line = F.format_string("%s | %s (category: %s)", "other", "label", "category")
    lists = named.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
    lines = F.array_join(F.transform("x", lambda x: F.concat(x["rank"].cast("string"), F.lit(". "), x["line"])), "\n")
    asked = lists.join(labels.select("id", "label"), "id").select("id", prompt("near_miss", F.col("label"), lines, F.lit(keep)).alias("asked"))
    picked = asked.select("id", F.explode(picked_ids(ask("asked"))).alias("other"))
    kept = picked.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    return pairs.join(kept, ["a", "b"], "left_semi")


# Prompt templates (fixed values of the data model's prompts are the caller's; these are ours).
PROMPTS = {
    "reader": "Context:\n%s\n\nQuestion: %s\nAnswer:",
    "pair": "Query: %s\nClause: %s\nRelevant:",
    "sentence": "Question: %s\nSentence: %s\nUsefulness from %d to %d:",
    "near_miss": "Query: %s\n\nCandidates:\n%s\n\nUp to %d that are easy to confuse with the query but distinct, as JSON {\"near_miss_ids\": [...]}:",
    "trick": "Query A: %s\nQuery B: %s\n\n%d queries that are easy to take for the other one, a line each, labelled A: or B: by the one meant:",
    "edge": "Query: %s\nEdges:\n%s\nBest edge or null:",
}


def prompt(kind: str, *parts: Column) -> Column:
    """A prompt of the named kind."""
    return F.format_string(PROMPTS[kind], *parts)
