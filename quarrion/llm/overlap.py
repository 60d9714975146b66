"""The same or almost the same record in two splits.

Records are canonicalised (NFKC, lower case, runs of letters and digits) in one Arrow pass. Exact matches meet in
a join of hashes of the whole token list. For near ones, rows of one side with the same list and titles are one class
first; classes meet in a join on (shared title, prefix token): two token sets of the wanted similarity share at least
one of their first tokens, so a title that a third of all records have is spread over the rare tokens of its records.
Candidates are verified exactly.

Split counts need no pairs of records: they are counted by hash and by class, so groups of copies cost one row.

Null ids, splits and questions and empty token lists are in no pair; a repeated id counts once, with its latest row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrion.session import checkpointed

#: Least Jaccard index of the token sets of questions that share a title.
JACCARD = 0.6
#: Words that come last in the order of prefixes, at most; so many hashes go to every task.
MOST_COMMON = 4096
TRAIN, EVALUATION = "train", ("dev", "test", "validation")

_TOKEN = re.compile(r"[^\W_]+")


@F.pandas_udf(T.ArrayType(T.StringType()))
def canonical_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Runs of letters and digits after NFKC and lower case; none of a null."""
    for texts in batches:
        yield pd.Series(
            [_TOKEN.findall(unicodedata.normalize("NFKC", x).lower()) if isinstance(x, str) else [] for x in texts]
        )


canonical_tokens = canonical_tokens.asNondeterministic()  # else the filter on its result runs it once more


def clean_split(column: str) -> Column:
    """A split's name after trim and lower case."""
    return F.lower(F.regexp_replace(column, r"(?U)^\s+|\s+$", ""))


def gold_titles(column: str) -> Column:
    """Distinct titles of passage ids: without all up to the first ``__`` and without the last ``_sent{i}`` or ``_full``."""
    parted = F.filter(F.coalesce(column, F.array()), lambda x: x.isNotNull() & x.contains("__"))
    titles = F.transform(parted, lambda x: F.regexp_replace(F.regexp_replace(x, r"(?s)^.*?__", ""), r"(_sent[0-9]+|_full)$", ""))
    return F.array_distinct(F.filter(titles, lambda x: (x != "") & (x != "no_title")))


def first_words(common: list[int]) -> Callable[..., Column]:
    """A function that gives the first n of an array of words, those of ``common`` last and the most frequent at the end."""
    places = {word: len(common) - k for k, word in enumerate(common)}

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def first(words: pd.Series, count: pd.Series) -> pd.Series:
        return pd.Series([sorted(row.tolist(), key=lambda w: (places.get(w, 0), w))[:n] for row, n in zip(words, count, strict=True)])

    return first.asNondeterministic()  # else the filter that explode implies runs it once more


def prepare(questions: DataFrame) -> DataFrame:
    """(id, train, split, dataset, hash, words, titles, class) of each question of a known split, one row an id.

    ``words`` are the hashes of the different tokens, ``hash`` is of the whole token list; ``class`` is the same for
    rows of one side with the same list and titles. Checkpointed, as it is read several times.
    """
    rows = questions.select(
        F.col("question_id").alias("id"), clean_split("split").alias("split"), "dataset", "question", "gold_passages", "ingested_at"
    ).where(F.col("split").isin(TRAIN, *EVALUATION) & F.col("id").isNotNull() & F.col("question").isNotNull())
    latest = F.max_by(F.struct("split", "dataset", "question", "gold_passages"), F.struct("ingested_at", F.xxhash64("question", "gold_passages")))
    rows = rows.groupBy("id").agg(latest.alias("row")).select("id", "row.*")
    rows = rows.withColumn("tokens", canonical_tokens("question")).where(F.size("tokens") > 0)
    rows = rows.select(
        "id",
        (F.col("split") == TRAIN).alias("train"),
        "split",
        F.lower(F.trim("dataset")).alias("dataset"),
        F.unhex(F.sha2(F.array_join("tokens", " "), 256)).alias("hash"),
        F.transform(F.array_distinct("tokens"), lambda x: F.xxhash64(x)).alias("words"),
        F.array_sort(gold_titles("gold_passages")).alias("titles"),
    )
    named = F.concat_ws("\u0001", F.col("train").cast("string"), F.hex("hash"), F.array_join("titles", "\u0001"))
    return checkpointed(rows.withColumn("class", F.unhex(F.md5(named))))


def exact_pairs(rows: DataFrame) -> DataFrame:
    """(train_id, eval_id) of equal token lists."""
    left = rows.where("train").select("hash", F.col("id").alias("train_id"))
    right = rows.where("NOT train").select("hash", F.col("id").alias("eval_id"))
    return left.join(right, "hash").select("train_id", "eval_id")


def near_classes(rows: DataFrame, threshold: float = JACCARD, most_common: int = MOST_COMMON) -> DataFrame:
    """(train_class, eval_class, copies) of classes of different token lists that share a title and reach
    ``threshold``; ``copies`` counts the training rows.

    Copies are one class before any pair is formed. Two sets of the wanted similarity share one of their first words
    in any common order; here the ``most_common`` words come last, the others in the order of their hashes.
    """
    members = rows.where(F.size("titles") > 0).groupBy("class").agg(
        F.first("train").alias("train"), F.first("hash").alias("hash"), F.first("words").alias("words"), F.first("titles").alias("titles"), F.count(F.lit(1)).alias("copies")
    )
    classes = checkpointed(members)
    df = classes.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    common = [r["word"] for r in df.orderBy(F.desc("df"), "word").limit(most_common).collect()]
    size = F.size("words")
    count = (size - F.ceil(size * F.lit(threshold) - 1e-9) + 1).cast("int")
    keyed = classes.select("class", "train", "titles", size.alias("size"), first_words(common)("words", count).alias("first"))
    keyed = keyed.select("class", "train", "size", "titles", F.explode("first").alias("word"))
    keyed = keyed.select("class", "train", "size", "word", F.explode("titles").alias("title"))
    keyed = keyed.select("class", "train", "size", F.xxhash64("title", "word").alias("key"))
    left = keyed.where("train").select("key", F.col("class").alias("train_class"), F.col("size").alias("m"))
    right = keyed.where("NOT train").select("key", F.col("class").alias("eval_class"), F.col("size").alias("n"))
    met = left.join(right, "key").where(F.least("m", "n") >= F.greatest("m", "n") * F.lit(threshold) - 1e-9)
    candidates = met.select("train_class", "eval_class").distinct()
    side = lambda name, letter: classes.select(F.col("class").alias(name), *(F.col(c).alias(f"{letter}_{c}") for c in ("hash", "words", "titles", "copies")))
    checked = candidates.join(side("train_class", "a"), "train_class").join(side("eval_class", "b"), "eval_class")
    shared = F.size(F.array_intersect("a_words", "b_words"))
    whole = F.size("a_words") + F.size("b_words") - shared
    checked = checked.where("a_hash <> b_hash").where(F.arrays_overlap("a_titles", "b_titles")).where(shared >= whole * F.lit(threshold) - 1e-9)
    return checked.select("train_class", "eval_class", F.col("a_copies").alias("copies"))


def overlaps(questions: DataFrame) -> DataFrame:
    """(train_id, eval_id, kind) of every pair across splits, kind ``exact`` or ``near``."""
    rows = prepare(questions)
    exact = exact_pairs(rows).withColumn("kind", F.lit("exact"))
    left = rows.where("train").select(F.col("class").alias("train_class"), F.col("id").alias("train_id"))
    right = rows.where("NOT train").select(F.col("class").alias("eval_class"), F.col("id").alias("eval_id"))
    near = near_classes(rows).join(left, "train_class").join(right, "eval_class").select("train_id", "eval_id", F.lit("near").alias("kind"))
    return exact.unionByName(near)


def found(questions: DataFrame) -> DataFrame:
    """p3_found: (question_id_a, question_id_b), a < b, of every pair across splits."""
    pairs = overlaps(questions)  # a pair is either exact or near, and each comes once
    return pairs.select(F.least("train_id", "eval_id").alias("question_id_a"), F.greatest("train_id", "eval_id").alias("question_id_b"))


def report(questions: DataFrame) -> DataFrame:
    """Per evaluation split and dataset: questions, those that recur in training, and pairs, exact and near.

    Everything is counted by class, with the number of rows as weight; no pair of rows is formed.
    """
    rows = prepare(questions)
    train = rows.where("train").groupBy("hash").agg(F.count(F.lit(1)).alias("copies"))
    held = rows.where("NOT train").groupBy("split", "dataset", "hash", "class").agg(F.count(F.lit(1)).alias("rows"))
    near = near_classes(rows).groupBy(F.col("eval_class").alias("class")).agg(F.sum("copies").alias("near"))
    both = held.join(train, "hash", "left").join(near, "class", "left")
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("rows"))), F.lit(0))
    return both.groupBy("split", "dataset").agg(
        F.sum("rows").alias("questions"),
        count(F.col("copies").isNotNull()).alias("exact_questions"),
        count(F.col("near").isNotNull()).alias("near_questions"),
        count(F.coalesce("copies", "near").isNotNull()).alias("recurring_questions"),
        F.coalesce(F.sum(F.col("copies") * F.col("rows")), F.lit(0)).alias("exact_pairs"),
        F.coalesce(F.sum(F.col("near") * F.col("rows")), F.lit(0)).alias("near_pairs"),
    )
