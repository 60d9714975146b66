"""Choice of ranked items under budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrion.functions.text import estimate_tokens, strip, truncate_words

#: Room that a prompt leaves free, and the most that an answer may reserve.
SAFETY_MARGIN, OUTPUT_RESERVE, SEPARATOR = 64, 256, 2


def greedy_budget(df: DataFrame, group: str, rank: str, size: str, budget: int, score: str | None = None, least: float | None = None) -> DataFrame:
    """The rows of ``df`` chosen in rank order: one that does not fit is passed over, and choice ends when the budget
    is met exactly. Rows below ``least`` are passed over too.

    Whether a row is taken depends on those taken before, so each group is folded once. What is taken of one size are
    the first of that size, at most ``budget // size``, so the others are left out before and a list has at most about
    ``budget * log(budget)`` items, however large the group is. Rows of size 0 are taken until the budget is met.
    """
    if budget <= 0:
        return df.limit(0)
    fits = df.where(F.col(size) <= budget)
    if score is not None and least is not None:
        fits = fits.where(F.col(score) >= least)
    items = F.array_sort(F.collect_list(F.struct(F.col(rank).cast("long").alias("r"), F.col(size).cast("long").alias("s"))))
    first = F.row_number().over(Window.partitionBy(group, size).orderBy(rank))
    sized = fits.where(F.col(size) > 0).select(group, rank, size, first.alias("_n")).where(F.col("_n") <= F.lit(int(budget)))
    sized = sized.where(F.col("_n") * F.col(size) <= budget)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("taken"))

    def step(acc: Column, item: Column) -> Column:
        take = (acc["used"] < budget) & (acc["used"] + item["s"] <= budget)
        return F.when(
            take, F.struct((acc["used"] + item["s"]).alias("used"), F.concat(acc["taken"], F.array(item["r"])).alias("taken"))
        ).otherwise(acc)

    folded = sized.groupBy(group).agg(F.aggregate(items, start, step).alias("fold"))
    folded = folded.select(F.col(group).alias("_group"), "fold.taken", F.when(F.col("fold.used") >= budget, F.element_at("fold.taken", -1)).alias("_met"))
    rank_of, empty = F.col(rank).cast("long"), F.col(size) <= 0
    joined = fits.join(folded, F.col(group).eqNullSafe(F.col("_group")), "left")
    kept = F.when(empty, F.coalesce(rank_of < F.col("_met"), F.lit(True))).otherwise(F.array_contains("taken", rank_of))
    return joined.where(kept).drop("_group", "taken", "_met")


def pack_passages(df: DataFrame, group: str, rank: str, text: str, budget: int, cap: int | None = None, separator: int = SEPARATOR) -> DataFrame:
    """(group, rank, text, tokens, truncated) packed in rank order until the first that does not fit.

    Each text is cut to ``cap`` words before. If the very first does not fit it is cut to what is left.
    """
    rows = df.select(F.col(group), F.col(rank), strip(F.col(text)).alias("full")).where("full <> ''")
    rows = rows.withColumn("text", truncate_words("full", cap) if cap else F.col("full"))
    rows = rows.withColumn("tokens", estimate_tokens("text"))
    order = Window.partitionBy(group).orderBy(rank)
    rows = rows.withColumn("used", F.sum(F.col("tokens") + separator).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("place", F.row_number().over(order))
    left = budget - separator
    squeezed = (F.col("place") == 1) & (F.col("used") > budget) & F.lit(left > 0)
    rows = rows.where((F.col("used") <= budget) | squeezed)
    rows = rows.withColumn("text", F.when(squeezed, truncate_words("text", left)).otherwise(F.col("text")))
    return rows.select(group, rank, "text", estimate_tokens("text").alias("tokens"), (F.col("text") != F.col("full")).alias("truncated"))


def packing_counters(candidates: DataFrame, packed: DataFrame, group: str, separator: int = SEPARATOR) -> DataFrame:
    """Counters of a packing: candidates, selected, dropped, truncated, tokens used. Blank texts are no candidates."""
    n = candidates.where(strip(F.col("text")) != "").groupBy(group).agg(F.count(F.lit(1)).alias("n_candidates"))
    m = packed.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_selected"),
        F.sum(F.col("truncated").cast("int")).alias("n_truncated"),
        F.sum(F.col("tokens") + separator).alias("used_tokens"),
    )
    out = n.join(m, group, "left").fillna(0, ["n_selected", "n_truncated", "used_tokens"])
    return out.withColumn("n_dropped", F.col("n_candidates") - F.col("n_selected"))


def reader_budget(window: Column, base_tokens: Column, output_tokens: Column, margin: int = SAFETY_MARGIN, reserve: int = OUTPUT_RESERVE) -> Column:
    """struct(reserved, prompt_budget, context_budget) of a reader's context window."""
    reserved = F.least(output_tokens, F.lit(reserve))
    prompt = F.greatest(F.lit(0), window - reserved - margin)
    return F.struct(reserved.alias("reserved"), prompt.alias("prompt_budget"), F.greatest(prompt - base_tokens, F.lit(0)).alias("context_budget"))


def window_for_context(context: Column, base_tokens: Column, output_tokens: Column, margin: int = SAFETY_MARGIN, reserve: int = OUTPUT_RESERVE) -> Column:
    """The window that leaves ``context`` tokens for passages; 0 for none."""
    return F.when(context <= 0, 0).otherwise(context + base_tokens + F.least(output_tokens, F.lit(reserve)) + margin)


def rank_helpful(df: DataFrame, group: str, item: str, similarity: str, visits: str, k: int = 5) -> DataFrame:
    """The k items of highest mean of query similarity and share of visits."""
    totals = df.groupBy(F.col(group).alias("_group")).agg(F.sum(visits).alias("_all"))  # in parts, not in one window
    share = F.coalesce(F.try_divide(F.col(visits), F.col("_all")), F.lit(0.0))
    scored = df.join(totals, F.col(group).eqNullSafe(F.col("_group"))).withColumn("helpfulness", F.round(0.5 * (F.coalesce(F.col(similarity), F.lit(0.0)) + share), 9))
    window = Window.partitionBy(group).orderBy(F.desc("helpfulness"), F.asc(item))
    return scored.drop("_group", "_all").withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def by_threshold(df: DataFrame, score: str, least: float | None) -> DataFrame:
    """Rows of at least ``least``; all if it is None."""
    return df if least is None else df.where(F.col(score) >= least)
