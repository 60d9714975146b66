"""Sentences of passages and their discourse markers: sentence rows, flags, expansion, and the cover filter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrion.functions.ids import sentence_id
from quarrion.functions.markers import anaphora_hits, rule_sentences

_TEXT, _INT = T.StringType(), T.IntegerType()
_HIT = T.StructType().add("marker", _TEXT).add("start", _INT).add("end", _INT).add("category", _TEXT).add("direction", _TEXT).add("kind", _TEXT)
_SENTENCE = T.StructType().add("span_start", _INT).add("span_end", _INT).add("text", _TEXT).add("anaphoric", T.BooleanType())


@F.pandas_udf(T.ArrayType(_SENTENCE))
def sentence_structs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Sentences of each text and whether each points back."""
    for texts in batches:
        out = []
        for text in texts:
            spans = rule_sentences(text) if isinstance(text, str) else []
            rows = []
            for a, b in spans:
                piece = text[a:b]
                rows.append({"span_start": a, "span_end": b, "text": piece, "anaphoric": bool(anaphora_hits(piece, rule_sentences(piece)))})
            out.append(rows)
        yield pd.Series(out)


@F.pandas_udf(T.ArrayType(_HIT))
def anaphora_structs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Marker hits of each text."""
    for texts in batches:
        yield pd.Series([[h.__dict__ for h in anaphora_hits(x, rule_sentences(x))] if isinstance(x, str) else [] for x in texts])


# else the filter that explode implies runs them once more
sentence_structs = sentence_structs.asNondeterministic()
anaphora_structs = anaphora_structs.asNondeterministic()


def sentence_rows(df: DataFrame, id_col: str = "passage_id", text_col: str = "text") -> DataFrame:
    """(parent_id, sent_idx, sentence_id, span_start, span_end, text, anaphoric) of every sentence."""
    found = df.select(F.col(id_col).alias("parent_id"), sentence_structs(F.col(text_col)).alias("found"))
    rows = found.select("parent_id", F.posexplode("found").alias("sent_idx", "s"))
    return rows.select("parent_id", "sent_idx", sentence_id(F.col("parent_id"), F.col("sent_idx")).alias("sentence_id"), "s.*")


def expand_sentences(sentences: DataFrame, extension: int = 1) -> DataFrame:
    """``sentences`` with ``context`` and ``expanded``: an anaphoric one is preceded by its ``extension`` predecessors.

    Expansion looks backward only; markers that point forward are none.
    """
    order = Window.partitionBy("parent_id").orderBy("sent_idx")
    before = F.collect_list("text").over(order.rowsBetween(-extension, 0))
    first = F.first("span_start").over(order.rowsBetween(-extension, 0))
    grown = F.col("anaphoric") & (F.col("sent_idx") > 0) & F.lit(extension > 0)
    return sentences.select(
        "*",
        F.when(grown, F.array_join(before, " ")).otherwise(F.col("text")).alias("context"),
        F.when(grown, first).otherwise(F.col("span_start")).alias("context_start"),
        grown.alias("expanded"),
    )


def discourse_passages(sentences: DataFrame, extension: int = 1) -> DataFrame:
    """Expanded sentences without those, not expanded themselves, that the next one's expansion repeats."""
    order = Window.partitionBy("parent_id").orderBy("sent_idx")
    grown = expand_sentences(sentences, extension)
    covered = ~F.col("expanded") & F.coalesce(F.lead("expanded").over(order), F.lit(False))
    return grown.withColumn("_covered", covered).where("NOT _covered").drop("_covered")


def anaphora_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, marker, start, end, category, direction, kind) of every marker that points back."""
    found = df.select(F.col(id_col), anaphora_structs(F.col(text_col)).alias("found"))
    return found.select(id_col, F.explode("found").alias("h")).select(id_col, "h.*")


def context_lookup(sentences: DataFrame) -> DataFrame:
    """(source_id, ordinal, context): running sentence numbers over the chunks of a source, repeated ones included.

    ``sentences`` has (source_id, chunk_index, sent_idx, chunk_text). The first chunk of a number gives its context.
    """
    counts = sentences.groupBy("source_id", "chunk_index").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rows = sentences.join(counts, ["source_id", "chunk_index"]).withColumn("ordinal", (F.col("base") + F.col("sent_idx")).cast("int"))
    return rows.groupBy("source_id", "ordinal").agg(F.min_by("chunk_text", "chunk_index").alias("context"))
