"""Identifiers that hold join keys: builders and parsers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrion.functions.text import safe_title


def sentence_passage_id(question_id: Column, title: Column, index: Column) -> Column:
    """Id of a sentence passage of a question."""
    return F.concat(question_id, F.lit("__"), safe_title(title), F.lit("_sent"), index.cast("string"))


def full_passage_id(question_id: Column, title: Column) -> Column:
    """Id of a full passage of a question."""
    return F.concat(question_id, F.lit("__"), safe_title(title), F.lit("_full"))


def chunk_id(source_id: Column, index: Column) -> Column:
    """Id of a chunk of a source."""
    return F.concat(source_id, F.lit("__chunk"), index.cast("string"))


def sentence_id(parent_id: Column, index: Column) -> Column:
    """Id of a sentence of a chunk."""
    return F.concat(parent_id, F.lit("__sent"), index.cast("string"))


def passage_of(unit_id: Column) -> Column:
    """The passage id in the id of a chunk or of one of its sentences."""
    return F.regexp_replace(F.regexp_replace(unit_id, "__sent[0-9]+$", ""), "__chunk[0-9]+$", "")


def full_of(unit_id: Column) -> Column:
    """The full-passage id that belongs to a sentence passage's id."""
    return F.regexp_replace(passage_of(unit_id), "_sent[0-9]+$", "_full")


def question_of(unit_id: Column, nested: bool = False) -> Column:
    """The question id in a passage id; with ``nested``, of ids that hold ``__`` themselves and end in ``_sent``."""
    if nested:
        return F.regexp_replace(unit_id, "_sent.*$", "")
    return F.substring_index(unit_id, "__", 1)


def ordinal_of(question_id: Column) -> Column:
    """The number at the end of a question id; null if there is none."""
    return F.nullif(F.regexp_extract(question_id, "([0-9]{1,18})$", 1), F.lit("")).try_cast("bigint")
