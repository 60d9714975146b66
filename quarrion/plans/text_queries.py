"""Queries of text scalars, units and markers."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrion.functions import markers as M
from quarrion.functions import text as X
from quarrion.functions.ids import full_passage_id, passage_of, question_of
from quarrion.operators.chunking import token_windows, unit_table
from quarrion.operators.models import prompt
from quarrion.plans import base as B
from quarrion.session import spread, table

Frame = DataFrame


def clean_text(spark: SparkSession, d: str) -> Frame:
    """Markup-free text of every document, without Unicode composition."""
    return spread(table(spark, d, "documents")).select("doc_id", X.clean_text("text", compose=False).alias("clean"))


def clean_text_nfkc(spark: SparkSession, d: str) -> Frame:
    """The same after Unicode composition."""
    return spread(table(spark, d, "documents")).select("doc_id", X.clean_text("text").alias("clean"))


def safe_title_ids(spark: SparkSession, d: str) -> Frame:
    """Identifier forms of passage titles and the ids built from them."""
    p = B.passages(spark, d)
    return p.select("passage_id", X.safe_title("title").alias("safe"), full_passage_id(question_of(F.col("passage_id")), F.col("title")).alias("full_id"))


def keyword_normalise(spark: SparkSession, d: str) -> Frame:
    """Keyword forms of passage titles."""
    return B.passages(spark, d).select("passage_id", X.normalise_keyword("title").alias("keyword"))


def canonical_keywords(spark: SparkSession, d: str) -> Frame:
    """Canonical keywords of the words of gold answers."""
    words = B.questions(spark, d).select("question_id", F.posexplode(X.label_tokens("gold_answer")).alias("place", "word"))
    return words.select("question_id", "place", "word", X.canonical_keyword("word").alias("keyword"))


def answer_normalise(spark: SparkSession, d: str) -> Frame:
    """Answer forms of raw answers."""
    return B.results(spark, d).select("result_id", X.normalise_answer("raw_answer").alias("answer"))


def token_estimate(spark: SparkSession, d: str) -> Frame:
    """Words and estimated tokens of documents."""
    return table(spark, d, "documents").select("doc_id", X.count_words("text").alias("words"), X.estimate_tokens("text").alias("tokens"))


def truncate_budget(spark: SparkSession, d: str) -> Frame:
    """Documents cut to 64 words."""
    return table(spark, d, "documents").select("doc_id", X.truncate_words("text", 64).alias("cut"))


def answer_parts(spark: SparkSession, d: str) -> Frame:
    """Final answer, first fragment and acceptance of raw answers."""
    return B.results(spark, d).select(
        "result_id",
        X.final_answer("raw_answer").alias("final_answer"),
        X.first_fragment("raw_answer").alias("fragment"),
        X.accept_answer("raw_answer").isNotNull().alias("accepted"),
    )


def answer_tokens(spark: SparkSession, d: str) -> Frame:
    """Distinct tokens of normalised answers, in order."""
    return B.results(spark, d).select("result_id", F.array_join(X.clean_tokens(X.words("normalised_answer")), " ").alias("tokens"))


def think_strip(spark: SparkSession, d: str) -> Frame:
    """Answers without the reasoning block before them."""
    block = F.concat(F.lit("<think>"), F.coalesce("question", F.lit("")), F.lit("</think> "), F.col("raw_answer"))
    return B.results(spark, d).select("result_id", X.strip_think(block).alias("answer"), X.reasons("reader_model").alias("reasons"))


def score_parse(spark: SparkSession, d: str) -> Frame:
    """Grades from 0 to 5 read from normalised answers."""
    rows = B.results(spark, d).select("result_id", X.parse_score(F.col("normalised_answer"), 0, 5).alias("p"))
    return rows.select("result_id", "p.score", "p.invalid", F.round(X.score_to_unit("p.score", 0, 5), 6).alias("unit"))


def variant_parse(spark: SparkSession, d: str) -> Frame:
    """Fields of run variant names."""
    rows = table(spark, d, "results").select("variant", "retriever").distinct()
    parsed = rows.select("variant", F.col("retriever").alias("given"), X.parse_variant("variant").alias("p"), X.assign_approach("variant", "retriever").alias("approach"))
    return parsed.select("variant", "given", "p.*", "approach")


def trick_label_parse(spark: SparkSession, d: str) -> Frame:
    """Texts labelled A or B among raw answers."""
    rows = B.results(spark, d).select("result_id", X.parse_labelled("raw_answer").alias("p")).where("p IS NOT NULL")
    return rows.select("result_id", "p.target", F.col("p.text").alias("body"))


def trick_labels(spark: SparkSession, d: str) -> Frame:
    """Targets and texts of questions that carry one of four label forms, by their number; one form is no label."""
    q = B.questions(spark, d).where("question IS NOT NULL").withColumn("n", F.pmod(F.length("question"), F.lit(4)))
    forms = F.when(F.col("n") == 0, F.concat(F.lit("A: "), "question")).when(F.col("n") == 1, F.concat(F.lit(" (b) - "), "question"))
    labelled = forms.when(F.col("n") == 2, F.concat(F.lit("[A]|"), "question")).otherwise(F.concat(F.lit("C: "), "question"))
    rows = q.select("question_id", X.parse_labelled(labelled).alias("p")).where("p IS NOT NULL")
    return rows.select("question_id", "p.target", F.col("p.text").alias("body"))


def paragraph_units(spark: SparkSession, d: str) -> Frame:
    """Paragraphs of documents."""
    return unit_table(table(spark, d, "documents"), "doc_id", "text", "paragraph")


def line_units(spark: SparkSession, d: str) -> Frame:
    """Lines of passages."""
    return unit_table(B.passages(spark, d), "passage_id", "text", "line")


def token_window_table(spark: SparkSession, d: str) -> Frame:
    """Windows of 40 words of passages, overlapping by 10."""
    rows = token_windows(B.passages(spark, d), "passage_id", "text", 40, 10)
    return rows.select("passage_id", "window", F.array_join("tokens", " ").alias("tokens"))


def text_guards(spark: SparkSession, d: str) -> Frame:
    """Tests by which documents are kept whole by the sentence splitter."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", M.fitness(F.col("text")).alias("f"))
    return rows.select("doc_id", "f.too_long", "f.long_token", "f.too_many_marks")


def text_guards_all(spark: SparkSession, d: str) -> Frame:
    """All four tests by which documents are kept whole, with that of equal marks, which DuckDB's expressions cannot say."""
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", M.fitness(F.col("text")).alias("f"))
    return rows.select("doc_id", "f.*")


def marker_counts(spark: SparkSession, d: str) -> Frame:
    """Temporal, inline and parenthetical markers of passages."""
    text = F.col("text")
    return B.passages(spark, d).select(
        "passage_id",
        M.count_markers(text, M.TEMPORAL).alias("temporal"),
        M.count_markers(text, M.PARENTHETICAL).alias("inline"),
        M.count_markers(text, M.CONDITIONAL).alias("conditional"),
        M.count_parenthetical(text).alias("parenthetical"),
    )


def split_names(spark: SparkSession, d: str) -> Frame:
    """Canonical split names of questions."""
    return B.questions(spark, d).select("question_id", X.split_alias("split").alias("split_name"))


def reader_prompts(spark: SparkSession, d: str) -> Frame:
    """Reader prompts of questions with their gold answer as context."""
    q = B.questions(spark, d).where("question IS NOT NULL")
    return q.select("question_id", prompt("reader", F.coalesce("gold_answer", F.lit("")), F.col("question")).alias("prompt"))


def passage_id_normalise(spark: SparkSession, d: str) -> Frame:
    """Passage and question ids in chunk ids."""
    rows = table(spark, d, "retrieval_scores").select("chunk_id").distinct()
    passage = passage_of(F.col("chunk_id"))
    return rows.select("chunk_id", passage.alias("passage_id"), question_of(passage).alias("question_id"))


def number_parse(spark: SparkSession, d: str) -> Frame:
    """Integer parts of numeric normalised answers."""
    return B.results(spark, d).select("result_id", X.truncating_int("normalised_answer").alias("number"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_text, clean_text_nfkc, safe_title_ids, keyword_normalise, canonical_keywords, answer_normalise, token_estimate,
        truncate_budget, answer_parts, answer_tokens, think_strip, score_parse, variant_parse, trick_label_parse, trick_labels,
        paragraph_units, line_units, token_window_table, text_guards, text_guards_all, marker_counts, split_names, reader_prompts,
        passage_id_normalise, number_parse,
    )
}

_WS, _NW = B.WS, B.NON_WS


def _collapse(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _clean(x: str) -> str:
    for pattern, to in (
        (r"(?is)<nowiki>(.*?)</nowiki>", r"\1"),
        ("<[^>]+>", " "),
        (r"(?s)\{\{.*?\}\}", " "),
        (r"\[\[.*?\]\]", " "),
        (r"\[.*?\]", " "),
        ("={2,}.*?={2,}", " "),
        (rf"{_WS}*\|{_WS}*", " "),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return _collapse(x)


_SAFE = "coalesce(nullif(trim(regexp_replace(lower(title), '[^0-9A-Za-z]+', '_', 'g'), '_'), ''), 'no_title')"
_FOLD = f"regexp_replace(strip_accents(lower({_clean('title')})), '[^\\x00-\\x7F]', '', 'g')"
_KEYWORD = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    + _strip(f"replace({_FOLD}, '&', ' and ')")
    + ", '[^0-9A-Za-z_]+', '_', 'g'), '_s_', '_', 'g'), '_s$', ''), '_+', '_', 'g'), '_')"
)
_PLAIN = r"regexp_replace(lower(raw_answer), '[!-/:-@\[-`{-~]', '', 'g')"
_ARTICLES = _collapse(f"list_aggregate(list_filter(regexp_split_to_array({_PLAIN}, '{_WS}+'), lambda w: w NOT IN ('a', 'an', 'the')), 'string_agg', ' ')")


def _words(x: str) -> str:
    return f"regexp_extract_all({x}, '{_NW}+')"


_ALIAS = "CASE word " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.KEYWORD_ALIASES.items()) + " ELSE word END"
_NUMBERS = ", ".join(f"'{w}'" for w in X.NUMBER_WORDS)
_LABEL = rf"(?i)(?:final answer|answer(?: is)?){_WS}*:?{_WS}*([^\n]+)"
_UNITS = """SELECT {id}, CAST(i - 1 AS INT) AS unit_index, u[i] AS unit FROM (SELECT {id}, u, unnest(range(1, len(u) + 1)) AS i FROM (
    SELECT {id}, list_filter(list_transform(regexp_split_to_array(text, '{pat}'), lambda x: {strip}), lambda x: x <> '') AS u FROM {t} WHERE text IS NOT NULL))"""


def _count(phrases: list[str]) -> str:
    return f"coalesce(len(regexp_extract_all(text, '(?i)\\b(?:{M.any_phrase(phrases)})\\b')), 0)"


# runs of one mark, spelled out for engines whose expressions can't refer back; letters, digits and blanks are none
_MARKS = [chr(c) for c in (*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x5F), 0x60, *range(0x7B, 0x7F), 0xB7, *range(0x2010, 0x2028), *range(0x3001, 0x3004))]
_SAME = "|".join(f"{re.escape(c)}{{16,}}" for c in _MARKS).replace("'", "''")
# compatibility forms of one character, and those of several that occur in texts
_ONE = [chr(c) for c in range(0xA0, 0xFFFF) if not 0xD800 <= c < 0xE000 and len(unicodedata.normalize("NFKC", chr(c))) == 1 and unicodedata.normalize("NFC", chr(c)) != unicodedata.normalize("NFKC", chr(c))]
_COMPOSED = "text"
for _c in "…½¼¾ﬁﬂ™№℃\u0e33":
    _COMPOSED = f"replace({_COMPOSED}, '{_c}', '{unicodedata.normalize('NFKC', _c)}')"
_TO = "".join(unicodedata.normalize("NFKC", c) for c in _ONE).replace("'", "''")
_COMPOSED = f"nfc_normalize(translate({_COMPOSED}, '{''.join(_ONE)}', '{_TO}'))"
_BODY = rf"\b(?:{M.any_phrase(M.PARENTHETICAL)})\b"

ORACLE_SQL = {
    "clean_text": f"SELECT doc_id, {_clean('text')} AS clean FROM documents",
    "safe_title_ids": f"WITH {B.P} SELECT passage_id, {_SAFE} AS safe, split_part(passage_id, '__', 1) || '__' || {_SAFE} || '_full' AS full_id FROM p",
    "keyword_normalise": f"WITH {B.P} SELECT passage_id, {_KEYWORD} AS keyword FROM p",
    "canonical_keywords": f"""WITH {B.Q}, w AS (SELECT question_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
        SELECT question_id, regexp_extract_all(lower(gold_answer), '[a-z0-9]+') AS l FROM q)), x AS (SELECT question_id, CAST(i - 1 AS INT) AS place, l[i] AS word FROM w)
        SELECT question_id, place, word, CASE WHEN word IN ('what_year', 'the_years', 'year') OR regexp_full_match({_ALIAS}, '[0-9]+')
        OR {_ALIAS} IN ({_NUMBERS}) THEN NULL ELSE {_ALIAS} END AS keyword FROM x""",
    "answer_normalise": f"WITH {B.R} SELECT result_id, CASE WHEN raw_answer IS NULL THEN NULL ELSE coalesce({_ARTICLES}, '') END AS answer FROM r",
    "token_estimate": f"""SELECT doc_id, coalesce(len({_words('text')}), 0) AS words,
        CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE CAST(floor(len({_words('text')}) * 1.3) AS INT) + 1 END AS tokens FROM documents""",
    "truncate_budget": f"""SELECT doc_id, CASE WHEN len({_words('text')}) <= 64 THEN text
        ELSE array_to_string(({_words('text')})[1:64], ' ') END AS cut FROM documents""",
    "answer_parts": f"""WITH {B.R} SELECT result_id,
        {_strip(f"coalesce(regexp_extract_all(raw_answer, '{_LABEL}', 1)[-1], raw_answer)")} AS final_answer,
        CASE WHEN raw_answer IS NOT NULL THEN coalesce(list_filter(list_transform(regexp_split_to_array(raw_answer, '[.\\n]'), lambda x: {_strip('x')}), lambda x: x <> '')[1], '') END AS fragment,
        coalesce(len({_words('raw_answer')}) <= 40 AND coalesce(list_max(map_values(list_histogram({_words('raw_answer')}))), 0) <= 3, false) AS accepted FROM r""",
    "think_strip": f"""WITH {B.R} SELECT result_id, {_strip('raw_answer')} AS answer,
        coalesce(contains(lower(reader_model), 'r1') OR (contains(lower(reader_model), 'deepseek') AND contains(lower(reader_model), 'distill')), NULL) AS reasons FROM r""",
    "score_parse": f"""WITH {B.R}, x AS (SELECT result_id, {_strip('normalised_answer')} AS b FROM r),
        y AS (SELECT result_id, b, regexp_full_match(b, '[0-9]{{1,9}}') AND coalesce(try_cast(b AS INT), -1) BETWEEN 0 AND 5 AS ok FROM x),
        z AS (SELECT result_id, CASE WHEN ok THEN try_cast(b AS INT) ELSE CASE WHEN try_cast(nullif(regexp_extract(b, '(-?[0-9]+)', 1), '') AS DECIMAL(38, 0)) IS NOT NULL THEN CAST(least(greatest(try_cast(nullif(regexp_extract(b, '(-?[0-9]+)', 1), '') AS DECIMAL(38, 0)), 0), 5) AS INT) END END AS score, NOT coalesce(ok, false) AS invalid FROM y)
        SELECT result_id, CASE WHEN score IS NULL THEN NULL ELSE score END AS score, invalid, round(score / 5.0, 6) AS unit FROM z""",
    "trick_label_parse": f"""WITH {B.R}, x AS (SELECT result_id, {_strip('raw_answer')} AS b FROM r)
        SELECT result_id, upper(regexp_extract(b, '{{0}}', 1)) AS target, {_strip("regexp_extract(b, '{0}', 2)")} AS body
        FROM x WHERE regexp_matches(b, '{{0}}') AND {_strip("regexp_extract(b, '{0}', 2)")} <> ''""".replace("{{0}}", "{0}").replace(
        "{0}", rf"(?i)^{_WS}*[(\[]?{_WS}*([AB]){_WS}*[)\]]?{_WS}*[:\-|]{_WS}*([^\n]+)$"
    ),
    "trick_labels": f"""WITH {B.Q}, x AS (SELECT question_id, length(question) % 4 AS n, {_strip('question')} AS b FROM q WHERE question IS NOT NULL)
        SELECT question_id, CASE WHEN n = 1 THEN 'B' ELSE 'A' END AS target, b AS body FROM x WHERE n < 3 AND b <> '' AND NOT contains(b, chr(10))""",
    "answer_tokens": f"""WITH {B.R}, x AS (SELECT result_id, {_words('normalised_answer')} AS l FROM r),
        y AS (SELECT result_id, list_filter(l, lambda t, i: list_position(l, t) = i) AS u FROM x), z AS (SELECT result_id, u, list_filter(u, lambda t: t <> 'unknown') AS k FROM y)
        SELECT result_id, CASE WHEN u IS NULL THEN NULL WHEN len(k) > 0 THEN array_to_string(k, ' ') ELSE array_to_string(u, ' ') END AS tokens FROM z""",
    "variant_parse": """WITH x AS (SELECT DISTINCT variant, retriever AS given FROM results),
        y AS (SELECT *, CASE WHEN starts_with(variant, 'da_exit_') THEN 'DA_EXIT' WHEN starts_with(variant, 'exit_') THEN 'EXIT' END AS method,
              list_filter(string_split(regexp_replace(variant, '^(da_)?exit_', ''), '_'), lambda t: t <> '') AS l FROM x),
        z AS (SELECT *, list_filter(l, lambda t: t IN ('dense', 'sparse', 'hybrid'))[1] AS retriever FROM y),
        w AS (SELECT *, CASE WHEN retriever IS NULL THEN l ELSE l[1 : list_position(l, retriever) - 1] END AS b, CASE WHEN retriever IS NULL THEN [] ELSE l[list_position(l, retriever) + 1 :] END AS a FROM z),
        v AS (SELECT *, list_position(b, 'chunks') AS c FROM w),
        u AS (SELECT *, CASE WHEN c > 0 THEN b[c + 1 :] ELSE [] END AS behind FROM v)
        SELECT variant, given, method, retriever, try_cast(list_filter(a, lambda t: regexp_full_match(t, 'k[0-9]+'))[-1][2:] AS INT) AS top_k_chunks,
               try_cast(list_filter(a, lambda t: regexp_full_match(t, 's[0-9]+'))[-1][2:] AS INT) AS top_k_sentences,
               CASE WHEN c > 0 THEN array_to_string(b[1 : c], '_') WHEN b[1] = 'discourse' AND b[2] = 'aware' THEN 'discourse_aware_chunks' WHEN b[1] = 'standard' THEN 'standard_chunks'
                    WHEN len(b) > 0 THEN array_to_string(b, '_') END AS chunking_mode,
               CASE WHEN list_position(behind, 'sentences') > 0 THEN array_to_string(behind[1 : list_position(behind, 'sentences')], '_') ELSE 'standard_sentences' END AS sentence_mode,
               coalesce(method, CASE WHEN given IN ('dense', 'sparse', 'hybrid') THEN given END, 'unknown') AS approach FROM u""",
    "clean_text_nfkc": f"SELECT doc_id, {_clean(_COMPOSED)} AS clean FROM documents",
    "paragraph_units": _UNITS.format(id="doc_id", pat=rf"\n{_WS}*\n+", strip=_strip("x"), t="documents"),
    "line_units": f"WITH {B.P} " + _UNITS.format(id="passage_id", pat=r"\n+", strip=_strip("x"), t="p"),
    "token_window_table": f"""WITH {B.P}, x AS (SELECT passage_id, {_words('text')} AS l FROM p), y AS (SELECT passage_id, l,
        unnest(range(0, CAST(greatest(ceil((len(l) - 40) / 30.0), 0) AS INT) + 1)) AS w FROM x WHERE len(l) > 0)
        SELECT passage_id, CAST(w AS INT) AS "window", array_to_string(l[w * 30 + 1 : w * 30 + 40], ' ') AS tokens FROM y""",
    "text_guards": rf"""SELECT doc_id, length(text) > 5000 AS too_long, regexp_matches(text, '{_NW}{{150,}}') AS long_token,
        length(text) > 100 AND len(regexp_extract_all(text, '[!-/:-@\[-`{{-~]')) > length(text) * 0.2 AS too_many_marks FROM documents WHERE text IS NOT NULL""",
    "text_guards_all": rf"""SELECT doc_id, length(text) > 5000 AS too_long, regexp_matches(text, '{_NW}{{150,}}') AS long_token, regexp_matches(text, '{_SAME}') AS same_marks,
        length(text) > 100 AND len(regexp_extract_all(text, '[!-/:-@\[-`{{-~]')) > length(text) * 0.2 AS too_many_marks FROM documents WHERE text IS NOT NULL""",
    "marker_counts": rf"""WITH {B.P} SELECT passage_id, {_count(M.TEMPORAL)} AS temporal, {_count(M.PARENTHETICAL)} AS inline, {_count(M.CONDITIONAL)} AS conditional,
        coalesce(len(regexp_extract_all(text, '(?i),\s*{_BODY}\s*,')) + len(regexp_extract_all(text, '(?i)\(\s*{_BODY}\s*\)')), 0) AS parenthetical FROM p""",
    "split_names": f"""WITH {B.Q}, x AS (SELECT question_id, lower({_strip('split')}) AS n FROM q)
        SELECT question_id, CASE WHEN n IN ('dev', 'validation') THEN 'valid' ELSE n END AS split_name FROM x""",
    "reader_prompts": f"""WITH {B.Q} SELECT question_id, 'Context:' || chr(10) || coalesce(gold_answer, '') || chr(10) || chr(10) || 'Question: ' || question || chr(10) || 'Answer:' AS prompt
        FROM q WHERE question IS NOT NULL""",
    "passage_id_normalise": r"""WITH x AS (SELECT DISTINCT chunk_id, regexp_replace(regexp_replace(chunk_id, '__sent[0-9]+$', ''), '__chunk[0-9]+$', '') AS passage_id FROM retrieval_scores)
        SELECT chunk_id, passage_id, split_part(passage_id, '__', 1) AS question_id FROM x""",
    "number_parse": f"WITH {B.R} SELECT result_id, try_cast(trunc(try_cast(normalised_answer AS DOUBLE)) AS INT) AS number FROM r",
}
