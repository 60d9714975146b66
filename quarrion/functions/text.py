"""Text scalars as Column functions. All but Unicode normal forms stay in the JVM.

White space is the Unicode property in every function here. A null text gives null unless a function says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WS = r"[\t\n\x0B\f\r \x85\p{Z}]"
NON_WS = r"[^\t\n\x0B\f\r \x85\p{Z}]"

#: Keyword aliases of the data model, and the words that are dropped (fixed values).
KEYWORD_ALIASES = {
    "u": "united_states",
    "us": "united_states",
    "u_s": "united_states",
    "u_s_a": "united_states",
    "united_states_of_america": "united_states",
    "the_united_states": "united_states",
    "u_s_navy": "united_states_navy",
    "u_s_air_force": "united_states_air_force",
    "u_s_army": "united_states_army",
    "u_s_marine_corps": "united_states_marine_corps",
    "uk": "united_kingdom",
    "u_k": "united_kingdom",
    "great_britain": "united_kingdom",
    "un": "united_nations",
    "u_n": "united_nations",
}
KEYWORDS_DROPPED = ["what_year", "the_years", "year"]
NUMBER_WORDS = "one two three four five six seven eight nine ten first second third".split()
#: Retrievers that a variant name may hold (fixed values).
RETRIEVERS = ["dense", "sparse", "hybrid"]
#: Prefixes of variant names and the method labels that they stand for (fixed values of the runs' data).
METHODS = [("da_exit_", "DA_EXIT"), ("exit_", "EXIT")]


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column


def collapse(text: str | Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_col(text), f"{WS}+", " "), "^ | $", "")


def strip(text: str | Column) -> Column:
    """``text`` without white space at its ends."""
    return F.regexp_replace(_col(text), f"^{WS}+|{WS}+$", "")


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility composition, for which Spark has no function."""
    for texts in batches:
        yield texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(T.StringType())
def ascii_fold(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility decomposition without what is not ASCII."""
    for texts in batches:
        yield texts.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode(), na_action="ignore")


def clean_text(text: str | Column, compose: bool = True) -> Column:
    """Plain text of wiki-like markup: nowiki unwrapped, tags, templates, links, notes, headings and bars as blanks."""
    out = nfkc(_col(text)) if compose else _col(text)
    for pattern, to in (
        (r"(?is)<nowiki>(.*?)</nowiki>", "$1"),
        (r"<[^>]+>", " "),
        (r"(?s)\{\{.*?\}\}", " "),
        (r"(?d)\[\[.*?\]\]", " "),
        (r"(?d)\[.*?\]", " "),
        (r"(?d)={2,}.*?={2,}", " "),
        (rf"{WS}*\|{WS}*", " "),
    ):
        out = F.regexp_replace(out, pattern, to)
    return collapse(out)


def safe_title(title: str | Column) -> Column:
    """Identifier form of a title; ``no_title`` for one without letters or digits of ASCII, or null."""
    slug = F.trim(F.regexp_replace(F.lower(_col(title)), "[^0-9A-Za-z]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit("no_title"))


def normalise_keyword(text: str | Column, fold: bool = True) -> Column:
    """Keyword form: clean, lower, ASCII, ``&`` spelled out, underscores for what is not a word, no possessive."""
    out = F.lower(clean_text(text, compose=fold))
    if fold:
        out = ascii_fold(out)
    out = F.regexp_replace(out, "&", " and ")
    out = F.regexp_replace(F.regexp_replace(strip(out), "[^0-9A-Za-z_]+", "_"), "_s_", "_")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "_s$", ""), "_+", "_"), F.lit("_"))


def canonical_keyword(keyword: str | Column) -> Column:
    """The alias of a keyword, or itself; null for dropped words, bare numbers and number words."""
    word = _col(keyword)
    aliases = F.create_map(*[F.lit(x) for pair in KEYWORD_ALIASES.items() for x in pair])
    named = F.coalesce(F.try_element_at(aliases, word), word)
    noise = word.isin(*KEYWORDS_DROPPED) | named.rlike("^[0-9]+$") | named.isin(*NUMBER_WORDS)
    return F.when(~noise, named)


def normalise_answer(text: str | Column) -> Column:
    """Answer form for matching: lower case, no ASCII punctuation, no articles, single blanks."""
    out = F.regexp_replace(F.lower(_col(text)), r"[!-/:-@\[-`{-~]", "")
    return collapse(F.regexp_replace(out, r"(?U)\b(a|an|the)\b", " "))


def label_tokens(text: str | Column) -> Column:
    """Runs ``[a-z0-9]+`` of the lower-cased text."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("[a-z0-9]+"), F.lit(0))


def words(text: str | Column) -> Column:
    """Words between white space."""
    return F.regexp_extract_all(_col(text), F.lit(f"{NON_WS}+"), F.lit(0))


def count_words(text: str | Column) -> Column:
    """Number of words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(_col(text), F.lit(f"{NON_WS}+")), F.lit(0))


def estimate_tokens(text: str | Column) -> Column:
    """Model-free token estimate: 1.3 a word and one more; 0 for an empty or null text."""
    return F.when(F.coalesce(F.length(_col(text)), F.lit(0)) == 0, 0).otherwise((F.floor(count_words(text) * 1.3) + 1).cast("int"))


def truncate_words(text: str | Column, budget: int | Column) -> Column:
    """The first ``budget`` words joined by blanks; the text as it is when it has no more."""
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    cut = F.array_join(F.slice(words(text), F.lit(1), F.greatest(limit, F.lit(0)).cast("int")), " ")
    return F.when(count_words(text) <= limit, _col(text)).otherwise(cut)


def final_answer(text: str | Column) -> Column:
    """What follows the last "answer" label on its line, else the stripped text."""
    label = r"(?i)(?:final answer|answer(?: is)?)[\t\n\x0B\f\r \x85\p{Z}]*:?[\t\n\x0B\f\r \x85\p{Z}]*([^\n]+)"
    return strip(F.coalesce(F.try_element_at(F.regexp_extract_all(_col(text), F.lit(label), F.lit(1)), F.lit(-1)), _col(text)))


def first_fragment(text: str | Column) -> Column:
    """The first part between full stops and line breaks that is not blank; empty if there is none."""
    parts = F.filter(F.transform(F.split(_col(text), r"[.\n]"), strip), lambda x: x != "")
    return F.when(_col(text).isNotNull(), F.coalesce(F.get(parts, F.lit(0)), F.lit("")))


def accept_answer(text: str | Column, max_words: int = 40, repeats: int = 3) -> Column:
    """``text``, or null if it has too many words or repeats one too often."""

    def fits(said: Column) -> Column:
        often = F.exists(F.array_distinct(said), lambda w: F.size(F.filter(said, lambda x: x == w)) > repeats)
        return (F.size(said) <= max_words) & ~often

    # held in an array, so that the text is not divided again for each word
    return F.when(F.get(F.transform(F.array(words(text)), fits), F.lit(0)), _col(text))


def clean_tokens(tokens: str | Column) -> Column:
    """Distinct tokens in order; ``unknown`` only if there is nothing else."""
    kept = F.array_distinct(_col(tokens))
    known = F.filter(kept, lambda t: t != "unknown")
    return F.when(F.size(known) > 0, known).otherwise(kept)


def strip_think(text: str | Column) -> Column:
    """``text`` without a reasoning block at its start, or its unclosed tag."""
    out = F.regexp_replace(_col(text), rf"(?is)^<think>.*?</think>{WS}*", "")
    return strip(F.regexp_replace(out, rf"(?i)^<think>{WS}*", ""))


def reasons(model: str | Column) -> Column:
    """Whether a model's name is of the reasoning family."""
    name = F.lower(_col(model))
    return name.contains("r1") | (name.contains("deepseek") & name.contains("distill"))


def parse_score(text: str | Column, low: int, high: int) -> Column:
    """struct(score, invalid): an exact in-range number is valid; else the first number, clamped; else null."""
    if low > high:
        raise ValueError("low must not exceed high")
    bare = strip(text)
    exact = F.when(bare.rlike("^[0-9]{1,9}$"), bare.try_cast("int"))
    valid = F.coalesce(exact.between(low, high), F.lit(False))
    first = F.nullif(F.regexp_extract(bare, "(-?[0-9]+)", 1), F.lit(""))
    number = first.try_cast("decimal(38,0)")
    clamped = F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(low)), F.lit(high)).cast("int"))
    return F.struct(F.when(valid, exact).otherwise(clamped).alias("score"), (~valid).alias("invalid"))


def score_to_unit(score: str | Column, low: int, high: int) -> Column:
    """A score as a share of its scale; 0 on a scale of one value."""
    return F.lit(0.0) if high == low else (_col(score) - low) / (high - low)


def parse_variant(variant: str | Column) -> Column:
    """struct(method, retriever, top_k_chunks, top_k_sentences, chunking_mode, sentence_mode) of a run's variant name."""
    name = _col(variant)
    method = F.coalesce(*[F.when(name.startswith(prefix), label) for prefix, label in METHODS])
    rest = F.regexp_replace(name, "^(da_)?exit_", "")
    tokens = F.filter(F.split(rest, "_"), lambda t: t != "")
    retriever = F.get(F.filter(tokens, lambda t: t.isin(*RETRIEVERS)), F.lit(0))
    at = F.when(retriever.isNull(), F.size(tokens) + 1).otherwise(F.array_position(tokens, retriever)).cast("int")
    before, after = F.slice(tokens, F.lit(1), at - 1), F.slice(tokens, at + 1, F.greatest(F.size(tokens) - at, F.lit(0)))

    def number(letter: str) -> Column:
        hits = F.filter(after, lambda t: t.rlike(f"^{letter}[0-9]+$"))
        return F.try_element_at(F.transform(hits, lambda t: F.substring(t, 2, 20).try_cast("int")), F.lit(-1))

    chunks = F.array_position(before, F.lit("chunks")).cast("int")
    behind = F.slice(before, chunks + 1, F.greatest(F.size(before) - chunks, F.lit(0)))
    ends = F.array_position(behind, F.lit("sentences")).cast("int")
    implied = (
        F.when(F.slice(before, 1, 2) == F.array(F.lit("discourse"), F.lit("aware")), "discourse_aware_chunks")
        .when(F.get(before, F.lit(0)) == "standard", "standard_chunks")
        .when(F.size(before) > 0, F.array_join(before, "_"))
    )
    chunking = F.when(chunks > 0, F.array_join(F.slice(before, F.lit(1), chunks), "_")).otherwise(implied)
    sentence = F.when((chunks > 0) & (ends > 0), F.array_join(F.slice(behind, F.lit(1), ends), "_")).otherwise(F.lit("standard_sentences"))
    return F.struct(
        method.alias("method"),
        retriever.alias("retriever"),
        number("k").alias("top_k_chunks"),
        number("s").alias("top_k_sentences"),
        chunking.alias("chunking_mode"),
        sentence.alias("sentence_mode"),
    )


def assign_approach(variant: str | Column, retriever: str | Column) -> Column:
    """Approach label of a run."""
    name = _col(variant)
    method = F.coalesce(*[F.when(name.startswith(prefix), label) for prefix, label in METHODS])
    return F.coalesce(method, F.when(_col(retriever).isin(*RETRIEVERS), _col(retriever)), F.lit("unknown"))


def parse_labelled(text: str | Column) -> Column:
    """struct(target, text) of a text labelled A or B; null if it is not."""
    pattern = rf"(?i)^{WS}*[(\[]?{WS}*([AB]){WS}*[)\]]?{WS}*[:\-|]{WS}*([^\n]+)$"
    bare = strip(text)
    body = strip(F.regexp_extract(bare, pattern, 2))
    return F.when(bare.rlike(pattern) & (body != ""), F.struct(F.upper(F.regexp_extract(bare, pattern, 1)).alias("target"), body.alias("text")))


def split_alias(split: str | Column) -> Column:
    """A split's name: trimmed, lower case, ``dev`` as ``valid``."""
    name = F.lower(strip(split))
    return F.when(name.isin("dev", "validation"), "valid").otherwise(name)


def relevance_band(score: str | Column, pos: int = 3, hard: int = 2, neg: int = 1) -> Column:
    """pos from ``pos`` on, hard from ``hard`` on, neg up to ``neg``; null between."""
    value = _col(score)
    return F.when(value >= pos, "pos").when(value >= hard, "hard").when(value <= neg, "neg")


def truncating_int(text: str | Column) -> Column:
    """The integer part of a number's text; null if it is none."""
    return _col(text).try_cast("double").try_cast("int")
