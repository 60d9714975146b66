"""Asking models row by row: attempts, acceptance, token counts, and the operators built on that.

A model is a factory, called once a task, of a function from a batch of prompts to replies (None for a failed call).
``ask`` sends a prompt again while its reply is not accepted, up to a number of attempts, and never fails a job for a
bad reply: what remains is flagged, and the operators have a defined fallback.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrion.functions.text import accept_answer, estimate_tokens, final_answer, first_fragment, parse_labelled, parse_score, score_to_unit, strip, strip_think
from quarrion.operators.examples import mixed_order
from quarrion.operators.graph import EdgeChooser
from quarrion.operators.models import TextModel, prompt
from quarrion.operators.nearmiss import trick_queries
from quarrion.operators.selection import pack_passages, packing_counters

#: Scale of usefulness (fixed values of the data model) and attempts by default.
LOW, HIGH, ATTEMPTS = 0, 5, 3
_REPLY = "struct<text:string,attempts:int,accepted:boolean>"


def balanced(*models: TextModel) -> TextModel:
    """One of several models by the task's partition: calls are spread over endpoints without a coordinator."""

    def make() -> Callable[[pd.Series], list]:
        context = TaskContext.get()
        return models[(context.partitionId() if context else 0) % len(models)]()

    return make


def ask(df: DataFrame, prompt_col: str, model: TextModel, accept: Callable[[str], bool] | None = None, attempts: int = ATTEMPTS, name: str = "reply") -> DataFrame:
    """``df`` with ``name``: struct of text, attempts, accepted, prompt_tokens and output_tokens.

    The reply of the last attempt is kept. A null prompt is not sent. Every attempt counts the prompt's tokens again.
    """
    fits = accept or (lambda text: bool(text.strip()))

    @F.pandas_udf(_REPLY)
    def send(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run = model()
        for prompts in batches:
            texts: list[str | None] = [None] * len(prompts)
            used, good = [0] * len(prompts), [False] * len(prompts)
            todo = [k for k, x in enumerate(prompts) if isinstance(x, str)]
            for _ in range(attempts):
                if not todo:
                    break
                try:
                    replies = run(prompts.iloc[todo])
                except Exception:  # a failed batch is a failed attempt of its rows
                    replies = [None] * len(todo)
                for k, reply in zip(todo, replies, strict=True):
                    used[k] += 1
                    texts[k] = reply
                    good[k] = isinstance(reply, str) and fits(reply)
                todo = [k for k in todo if not good[k]]
            yield pd.DataFrame({"text": pd.Series(texts, dtype="object"), "attempts": used, "accepted": good})

    send = send.asNondeterministic()  # a model is asked once, whatever is done with its reply
    asked = df.withColumn(name, send(F.col(prompt_col)))
    r = F.col(name)
    tokens = estimate_tokens(F.col(prompt_col)) * r["attempts"], estimate_tokens(r["text"])
    return asked.withColumn(name, F.struct(r["text"].alias("text"), r["attempts"].alias("attempts"), r["accepted"].alias("accepted"), tokens[0].alias("prompt_tokens"), tokens[1].alias("output_tokens")))


def overlap_grader(low: int = LOW, high: int = HIGH) -> TextModel:
    """Default grader: the share of the question's words that the sentence has, on the scale, rounded down."""

    def make() -> Callable[[pd.Series], list]:
        def grade(prompts: pd.Series) -> list:
            out = []
            for text in prompts:
                question, _, rest = text.removeprefix("Question: ").partition("\nSentence: ")
                sentence = rest.rpartition("\nUsefulness from ")[0]
                want, have = (set(re.findall(r"[a-z0-9]+", x.lower())) for x in (question, sentence))
                out.append(str(low + (high - low) * len(want & have) // max(1, len(want))))
            return out

        return grade

    return make


def grade_sentences(
    df: DataFrame, question: str, sentence: str, model: TextModel | None = None, low: int = LOW, high: int = HIGH, attempts: int = ATTEMPTS
) -> DataFrame:
    """``df`` with ``grade``: struct of score, normalised, valid, attempts and token counts.

    A reply must be a number of the scale; after the last attempt the first number in it is used, clamped, else ``low``,
    and the grade is flagged as not valid.
    """
    number = re.compile(r"\s*\d{1,9}\s*")
    fits = lambda text: bool(number.fullmatch(text)) and low <= int(text) <= high
    asked = df.withColumn("_prompt", prompt("sentence", F.coalesce(question, F.lit("")), F.coalesce(sentence, F.lit("")), F.lit(low), F.lit(high)))
    asked = ask(asked, "_prompt", model or overlap_grader(low, high), fits, attempts, "_reply")
    parsed = parse_score(F.col("_reply.text"), low, high)
    asked = asked.withColumn("_score", F.coalesce(parsed["score"], F.lit(low))).withColumn("_valid", F.coalesce(~parsed["invalid"], F.lit(False)))
    grade = F.struct(
        F.col("_score").alias("score"), score_to_unit("_score", low, high).alias("normalised"), F.col("_valid").alias("valid"),
        F.col("_reply.attempts").alias("attempts"), F.col("_reply.prompt_tokens").alias("prompt_tokens"), F.col("_reply.output_tokens").alias("output_tokens"),
    )
    return asked.withColumn("grade", grade).drop("_prompt", "_reply", "_score", "_valid")


def grade_totals(graded: DataFrame, *group: str) -> DataFrame:
    """Sentences, invalid grades, attempts and tokens of each group."""
    return graded.groupBy(*group).agg(
        F.count(F.lit(1)).alias("sentences"), F.sum((~F.col("grade.valid")).cast("int")).alias("invalid"), F.sum("grade.attempts").alias("attempts"),
        F.sum("grade.prompt_tokens").alias("prompt_tokens"), F.sum("grade.output_tokens").alias("output_tokens"),
    )


def first_line_reader() -> TextModel:
    """Default reader: the first line of the context."""

    def make() -> Callable[[pd.Series], list]:
        return lambda prompts: [(re.match(r"Context:\n([^\n]*)", x) or [None, ""])[1] for x in prompts]

    return make


def answer_with_model(
    questions: DataFrame, ranked: DataFrame, budget: int, cap: int | None = None, model: TextModel | None = None, attempts: int = 2
) -> DataFrame:
    """(question_id, answer, accepted, attempts, token counts, packing counters): a reader over packed passages.

    ``ranked`` has (question_id, rank, text). Reasoning blocks are cut off, the answer is what follows its label, up to
    the first stop. A question without passages is not asked; it and a rejected reply are answered ``unknown``.
    """
    packed = pack_passages(ranked, "question_id", "rank", "text", budget, cap)
    context = packed.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("x"))
    context = context.select("question_id", F.array_join(F.transform("x", lambda x: x["text"]), "\n").alias("context"))
    rows = questions.select("question_id", "question").join(context, "question_id", "left")
    rows = rows.withColumn("_prompt", F.when(F.col("context").isNotNull(), prompt("reader", F.col("context"), F.coalesce("question", F.lit("")))))
    asked = ask(rows, "_prompt", model or first_line_reader(), None, attempts)
    said = F.nullif(strip(F.coalesce(accept_answer(first_fragment(final_answer(strip_think(F.col("reply.text"))))), F.lit(""))), F.lit(""))
    out = asked.select("question_id", F.coalesce(said, F.lit("unknown")).alias("answer"), said.isNotNull().alias("accepted"), "reply.attempts", "reply.prompt_tokens", "reply.output_tokens")
    counters = packing_counters(ranked, packed, "question_id")
    return out.join(counters, "question_id", "left").fillna(0, ["n_candidates", "n_selected", "n_truncated", "n_dropped", "used_tokens"])


def model_chooser(model: TextModel, attempts: int = 2) -> EdgeChooser:
    """A chooser of edges for ``graph.traverse``: the model gets a numbered list and replies a number, or null for none.

    A reply that is neither is asked again; a number out of range is an error, as it is no edge of the list.
    """

    def choose(candidates: list[dict]) -> dict | None:
        if not candidates:
            return None
        lines = "\n".join(f"{k}. {e['oq_id']} -> {e['dst']}" for k, e in enumerate(candidates, 1))
        asked = pd.Series([f"Query: {candidates[0].get('query_id', '')}\nEdges:\n{lines}\nBest edge or null:"])
        run = model()
        for _ in range(attempts):
            reply = run(asked)[0]
            try:
                number = json.loads(reply.strip()) if isinstance(reply, str) else ""
            except ValueError:
                continue
            if number is None:
                return None
            if isinstance(number, int) and not isinstance(number, bool):
                if not 1 <= number <= len(candidates):
                    raise ValueError(f"edge {number} of {len(candidates)}")
                return candidates[number - 1]
        raise ValueError("no edge in the reply")

    return choose


def tricks_by_model(pairs: DataFrame, a: str, b: str, n: int, model: TextModel, attempts: int = 2) -> DataFrame:
    """``pairs`` with up to ``n`` trick queries each: (ordinal, target, trick), by a model.

    A line of the reply counts if it is labelled A or B and repeats neither query nor another line. A pair without any
    such line after the last attempt gets the templates'.
    """
    label = re.compile(r"(?im)^\s*[(\[]?\s*[ab]\s*[)\]]?\s*[:\-|]\s*\S")
    rows = pairs.withColumn("_prompt", prompt("trick", F.col(a), F.col(b), F.lit(n)))
    rows = ask(rows, "_prompt", model, lambda text: bool(label.search(text)), attempts, "_reply")
    lines = F.transform(F.split(strip_think(F.coalesce("_reply.text", F.lit(""))), "\n"), parse_labelled)
    new = F.filter(F.array_distinct(lines), lambda x: x.isNotNull() & (x["text"] != F.col(a)) & (x["text"] != F.col(b)))
    rows = rows.withColumn("_lines", F.slice(new, 1, n)).select(*pairs.columns, "_lines")
    kept = rows.where(F.size("_lines") > 0).select(*pairs.columns, F.posexplode("_lines").alias("ordinal", "_t"))
    kept = kept.select(*pairs.columns, "ordinal", F.col("_t.target").alias("target"), F.col("_t.text").alias("trick"))
    return kept.unionByName(trick_queries(rows.where(F.size("_lines") == 0).drop("_lines"), a, b, n))


def random_scores(df: DataFrame, number: Column, seed: int, name: str = "score") -> DataFrame:
    """``df`` with the random scorer's score in [0, 1): the same for the same number and seed, in any engine."""
    mixed = mixed_order(number, seed)
    return df.withColumn(name, mixed / F.lit(1000003.0))
