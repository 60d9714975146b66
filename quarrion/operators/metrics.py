"""Measures of retrieval, answers, classifiers, confusion, hops, usage and time."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrion.functions.ids import passage_of
from quarrion.functions.text import normalise_answer
from quarrion.operators.retrieval import ranks_of

# --- retrieval -------------------------------------------------------------------------------------------------


def hits_at(retrieved: Column, gold: Column, k: int) -> Column:
    """1 if any of the first ``k`` is gold, else 0."""
    return F.when(F.arrays_overlap(F.slice(retrieved, 1, k), gold), 1.0).otherwise(0.0)


def recall_at(retrieved: Column, gold: Column, k: int) -> Column:
    """Distinct gold items among the first ``k`` by the length of the gold list, repeats included; 0 without gold."""
    got = F.size(F.array_intersect(F.slice(retrieved, 1, k), gold))
    return F.when(F.size(gold) > 0, got / F.size(gold)).otherwise(0.0)


def precision_at(retrieved: Column, gold: Column, k: int | None) -> Column:
    """Gold items among the distinct first ``k`` (all if None) by their number; 0 for none."""
    top = F.array_distinct(retrieved if k is None else F.slice(retrieved, 1, k))
    return F.when(F.size(top) > 0, F.size(F.array_intersect(top, gold)) / F.size(top)).otherwise(0.0)


def passages_of(units: Column) -> Column:
    """Distinct passage ids of chunk or sentence ids, in order."""
    return F.array_distinct(F.transform(units, passage_of))


def ndcg(ranked: DataFrame, group: str, rank: str, relevance: str, k: int | None = None) -> DataFrame:
    """(group, ndcg): gain 2^rel - 1, discount log2(rank + 1), ideal order of the same candidates; 0 if that has none."""
    ideal = Window.partitionBy(group).orderBy(F.desc(relevance), F.asc(rank))
    rows = ranked.select(F.col(group), F.col(rank).alias("r"), F.col(relevance).alias("rel"), F.row_number().over(ideal).alias("i"))
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1

    def total(place: str) -> Column:
        value = gain / F.log2(F.col(place) + 1.0)
        return F.sum(value if k is None else F.when(F.col(place) <= k, value).otherwise(0.0))

    sums = rows.groupBy(group).agg(total("r").alias("dcg"), total("i").alias("idcg"))
    return sums.select(group, F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def gains_at(hits: DataFrame, group: str, rank: str, relevance: str, depths: dict[str, int | None]) -> DataFrame:
    """nDCG as ``ndcg`` gives it, at several depths at once, from the relevant rows alone: others gain nothing.

    ``hits`` has the rank and relevance of each relevant candidate; a group without one may have a row with nulls.
    """
    ideal = Window.partitionBy(group).orderBy(F.desc_nulls_last(relevance), F.asc(rank))
    rows = hits.select(F.col(group), F.col(rank).alias("r"), F.col(relevance).alias("rel"), F.row_number().over(ideal).alias("i"))
    gain = F.coalesce(F.pow(F.lit(2.0), F.col("rel")) - 1, F.lit(0.0))

    def total(place: str, depth: int | None) -> Column:
        value = gain / F.log2(F.coalesce(F.col(place), F.lit(1)) + 1.0)
        return F.sum(value if depth is None else F.when(F.col(place) <= depth, value).otherwise(0.0))

    def share(depth: int | None) -> Column:
        return F.when(total("i", depth) > 0, total("r", depth) / total("i", depth)).otherwise(0.0)

    return rows.groupBy(group).agg(*(share(depth).alias(name) for name, depth in depths.items()))


def first_hit_ranks(scored: DataFrame, gold: DataFrame, group: str) -> DataFrame:
    """(group, first_hit): least rank of an id that is a gold id or begins with one and ``__``.

    ``scored`` has (group, item, score), ``gold`` (group, gold). A gold id equals an item or one of its prefixes before
    ``__``, so this is an equi-join on those prefixes. Only the best such row of a group is ranked.
    """
    parts = F.split("item", "__")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "__"))
    rows = scored.select(group, "item", "score", F.explode(heads).alias("gold"))
    hits = rows.join(gold.select(group, "gold").distinct(), [group, "gold"], "left_semi")
    best = hits.groupBy(group).agg(F.min(F.struct((-F.col("score")).alias("s"), "item")).alias("x"))
    best = best.select(group, F.col("x.item").alias("item"), (-F.col("x.s")).alias("score"))
    return ranks_of(best, scored, group, "item", "score").select(group, F.col("rank").alias("first_hit"))


def recall_curve(first_hits: DataFrame, questions: DataFrame, depth: int) -> DataFrame:
    """(k, recall): share of ``questions`` whose first hit is at k or before, for k = 1 .. depth."""
    total = questions.count()
    hits = first_hits.where(F.col("first_hit") <= depth).groupBy("first_hit").agg(F.count(F.lit(1)).alias("n"))
    ks = first_hits.sparkSession.range(1, depth + 1).select(F.col("id").cast("int").alias("k"))
    joined = ks.join(F.broadcast(hits), F.col("k") == F.col("first_hit"), "left")
    running = F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return joined.select("k", F.round(running / F.lit(float(max(total, 1))), 6).alias("recall"))


# --- answers ---------------------------------------------------------------------------------------------------


def exact_match(prediction: Column, gold: Column) -> Column:
    """1 if both have the same answer form."""
    return (normalise_answer(prediction) == normalise_answer(gold)).cast("double")


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the token multisets of the answer forms; 1 if both are empty, 0 if one is."""
    a, b = (F.filter(F.split(normalise_answer(x), " "), lambda t: t != "") for x in (prediction, gold))

    def score(pair: Column) -> Column:
        said, want = pair["a"], pair["b"]
        count = lambda tokens, w: F.size(F.filter(tokens, lambda t: t == w))
        common = F.aggregate(F.array_distinct(said), F.lit(0), lambda acc, w: acc + F.least(count(said, w), count(want, w)))
        both_empty = (F.size(said) == 0) & (F.size(want) == 0)
        return F.when(both_empty, 1.0).when(common == 0, 0.0).otherwise(2.0 * common / (F.size(said) + F.size(want)))

    # held in a struct, so that the answer forms are not made again for each token
    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), score), F.lit(0))


def best_over_golds(prediction: Column, golds: Column) -> Column:
    """struct(em, f1): the best over a list of gold answers; 0 for a null or blank prediction."""
    em = F.array_max(F.transform(golds, lambda g: exact_match(prediction, g)))
    f1 = F.array_max(F.transform(golds, lambda g: token_f1(prediction, g)))
    said = F.coalesce(F.trim(prediction) != "", F.lit(False))
    return F.struct(F.when(said, F.coalesce(em, F.lit(0.0))).otherwise(0.0).alias("em"), F.when(said, F.coalesce(f1, F.lit(0.0))).otherwise(0.0).alias("f1"))


# --- classifiers -----------------------------------------------------------------------------------------------


def confusion(df: DataFrame, predicted: Column, actual: Column, *group: str) -> DataFrame:
    """Counts tp, fp, fn, tn and precision, recall, F1 (denominators at least 1)."""
    flag = lambda c: F.sum(c.cast("int"))
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    counts = df.groupBy(*group).agg(flag(p & a).alias("tp"), flag(p & ~a).alias("fp"), flag(~p & a).alias("fn"), flag(~p & ~a).alias("tn"))
    precision = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    recall = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return counts.select("*", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def threshold_sweep(df: DataFrame, probability: str, label: str, low: float = 0.3, high: float = 0.9, steps: int = 80) -> DataFrame:
    """(step, tau, tp, fp, fn, precision, f1) at ``steps + 1`` thresholds; one pass over the data.

    Each row is counted once, at the last threshold that it reaches; running sums from the top give the rest.
    """
    width = (high - low) / steps
    p = F.col(probability)
    last = F.least(F.floor((p - low) / width + 1e-9), F.lit(steps)).cast("int")
    rows = df.where(p.isNotNull() & F.col(label).isNotNull()).select(F.when(p >= low, last).otherwise(-1).alias("step"), F.col(label).alias("y"))
    counted = rows.groupBy("step").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(-1, steps + 1).select(F.col("id").cast("int").alias("step"))
    table = grid.join(F.broadcast(counted), "step", "left").fillna(0)
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = table.select("step", F.sum("pos").over(above).alias("tp"), F.sum("n").over(above).alias("taken"), F.sum("pos").over(whole).alias("all"))
    tp, fp, fn = F.col("tp"), F.col("taken") - F.col("tp"), F.col("all") - F.col("tp")
    precision = tp / F.greatest(tp + fp, F.lit(1))
    f1 = 2 * tp / F.greatest(2 * tp + fp + fn, F.lit(1))
    return table.where("step >= 0").select(
        "step", F.round(low + F.col("step") * width, 4).alias("tau"), "tp", fp.alias("fp"), fn.alias("fn"),
        F.round(precision, 6).alias("precision"), F.round(f1, 6).alias("f1"),
    )


def choose_threshold(sweep: DataFrame, target: float = 0.8) -> DataFrame:
    """One row: the least threshold whose precision reaches ``target``, else the first of greatest precision.

    Where no precision is above 0 the threshold is 0.5 with F1 -1.
    """
    good = F.min(F.when(F.col("precision") >= target, F.struct("step", "tau", "precision", "f1")))
    best = F.max(F.when(F.col("precision") > 0, F.struct("precision", (-F.col("step")).alias("order"), "tau", "f1")))
    one = sweep.agg(good.alias("good"), best.alias("best"))
    return one.select(
        F.coalesce("good.tau", "best.tau", F.lit(0.5)).alias("tau"),
        F.coalesce("good.precision", "best.precision", F.lit(0.0)).alias("precision"),
        F.coalesce("good.f1", "best.f1", F.lit(-1.0)).alias("f1"),
    )


def confusion_at(df: DataFrame, probability: str, label: str, tau: DataFrame) -> DataFrame:
    """Counts and measures at the one threshold of ``tau`` (``choose_threshold``): a row is positive from it on."""
    rows = df.where(F.col(probability).isNotNull() & F.col(label).isNotNull()).select(F.col(probability).alias("_p"), F.col(label).alias("_y"))
    met = rows.join(F.broadcast(tau.select("tau")), F.lit(True))  # one row
    return confusion(met, F.col("_p") >= F.col("tau"), F.col("_y") == 1, "tau")


def label_balance(df: DataFrame, label: Column, *group: str) -> DataFrame:
    """Positives, negatives and the weight of a positive."""
    counts = df.groupBy(*group).agg(F.sum(label.cast("int")).alias("positives"), F.sum((~label).cast("int")).alias("negatives"))
    return counts.withColumn("pos_weight", F.round(F.col("negatives") / F.greatest("positives", F.lit(1)), 6))


def weighted_log_loss(df: DataFrame, probability: str, label: str, pos_weight: float, *group: str) -> DataFrame:
    """(n, loss): mean binary cross-entropy with weighted positives; probabilities are kept off 0 and 1."""
    p = F.least(F.greatest(F.col(probability), F.lit(1e-7)), F.lit(1 - 1e-7))
    loss = -(pos_weight * F.col(label) * F.log(p) + (1 - F.col(label)) * F.log(1 - p))
    rows = df.where(F.col(probability).isNotNull() & F.col(label).isNotNull())
    return rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(loss), 6).alias("loss"))


# --- hops ------------------------------------------------------------------------------------------------------


def hop_metrics(hops: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(key, hop, precision, recall, f1) of the passages new up to each hop; seeds do not count.

    ``hops`` has (key, hop, new_passages array), ``gold`` (key, gold array).
    """
    firsts = hops.select(key, "hop", F.explode("new_passages").alias("p")).groupBy(key, "p").agg(F.min("hop").alias("hop"))
    wanted = gold.select(key, F.explode(F.array_distinct("gold")).alias("p"), F.size(F.array_distinct("gold")).alias("n_gold"))
    marked = firsts.join(wanted.withColumn("hit", F.lit(1)), [key, "p"], "left")
    per_hop = marked.groupBy(key, "hop").agg(F.count(F.lit(1)).alias("new"), F.count("hit").alias("hits"))
    rows = hops.select(key, "hop").distinct().join(per_hop, [key, "hop"], "left").join(gold.select(key, F.size(F.array_distinct("gold")).alias("n_gold")), key)
    run = Window.partitionBy(key).orderBy("hop").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(key, "hop", "n_gold", F.coalesce(F.sum("new").over(run), F.lit(0)).alias("seen"), F.coalesce(F.sum("hits").over(run), F.lit(0)).alias("hits"))
    precision = F.coalesce(F.try_divide("hits", "seen"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "n_gold"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return rows.select(key, "hop", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def gold_attention(visits: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(key, attention): visits of gold passages by all visits."""
    wanted = gold.select(key, F.explode(F.array_distinct("gold")).alias("passage")).withColumn("hit", F.lit(1))
    joined = visits.join(wanted, [key, "passage"], "left")
    share = F.try_divide(F.sum(F.when(F.col("hit") == 1, F.col("visits")).otherwise(0)), F.sum("visits"))
    return joined.groupBy(key).agg(F.round(F.coalesce(share, F.lit(0.0)), 6).alias("attention"))


def first_gold_hop(hops: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """(key, first_gold_hop): 0 if a seed is gold, else the first hop with a new gold passage; null if none has."""
    rows = hops.join(gold, key)
    seeded = (F.col("hop") == 0) & F.arrays_overlap("expanded_from", "gold")
    fresh = F.arrays_overlap("new_passages", "gold")
    return rows.groupBy(key).agg(F.min(F.when(seeded, 0).when(fresh, F.col("hop"))).alias("first_gold_hop"))


def depth_histogram(hops: DataFrame, key: str) -> DataFrame:
    """(depth, n): how many queries' deepest hop with any passage is each, empty depths included."""
    busy = (F.size("expanded_from") > 0) | (F.size("new_passages") > 0)
    depths = hops.groupBy(key).agg(F.coalesce(F.max(F.when(busy, F.col("hop"))) + 1, F.lit(0)).alias("depth"))
    counts = depths.groupBy("depth").agg(F.count(F.lit(1)).alias("n"))
    bins = counts.agg(F.max("depth").alias("top")).where("top IS NOT NULL").select(F.explode(F.sequence(F.lit(0), F.col("top"))).alias("depth"))
    return bins.join(counts, "depth", "left").fillna(0, ["n"])


def walk_times(times: DataFrame, key: str, seconds: str, calls: str) -> DataFrame:
    """One row: total, mean and median seconds of walks, and queries and model calls a second."""
    rows = times.select(F.col(key), F.col(seconds).cast("double").alias("s"), F.col(calls).alias("c"))
    sums = rows.agg(
        F.round(F.sum("s"), 6).alias("total_seconds"), F.round(F.avg("s"), 6).alias("mean_seconds"),
        F.round(F.coalesce(F.try_divide(F.count("s"), F.sum("s")), F.lit(0.0)), 6).alias("qps"), F.round(F.coalesce(F.try_divide(F.sum("c"), F.sum("s")), F.lit(0.0)), 6).alias("cps"),
    )
    return sums.join(F.broadcast(exact_quantiles(rows, ["s"], {"median": 0.5}).withColumnRenamed("median_s", "median_seconds")), F.lit(True))


def traversal_summary(hops: DataFrame, gold: DataFrame, visits: DataFrame, key: str) -> DataFrame:
    """One row over all walks: mean precision, recall and F1 after the last hop, mean attention, coverage counts,
    mean first gold hop and mean depth. ``walk_times`` has the times.

    A walk covers its gold passages if all of them are among its seeds or the passages it reached.
    """
    last = hop_metrics(hops, gold, key).groupBy(key).agg(F.max_by(F.struct("precision", "recall", "f1"), "hop").alias("m"))
    first = first_gold_hop(hops, gold, key)
    busy = (F.size("expanded_from") > 0) | (F.size("new_passages") > 0)
    reached = hops.groupBy(key).agg(
        F.array_distinct(F.flatten(F.collect_list(F.concat("expanded_from", "new_passages")))).alias("seen"),
        F.coalesce(F.max(F.when(busy, F.col("hop"))) + 1, F.lit(0)).alias("depth"),
    )
    covered = reached.join(gold, key).select(key, "depth", (F.size(F.array_except("gold", "seen")) == 0).cast("int").alias("covered"))
    attention = gold_attention(visits, gold, key)
    rows = covered.join(last, key, "left").join(first, key, "left").join(attention, key, "left")
    mean = lambda c, d=4: F.round(F.avg(c), d)
    return rows.agg(
        F.count(F.lit(1)).alias("queries"),
        mean("m.precision").alias("mean_precision"),
        mean("m.recall").alias("mean_recall"),
        mean("m.f1").alias("mean_f1"),
        mean(F.coalesce("attention", F.lit(0.0))).alias("mean_gold_attention"),
        F.sum("covered").alias("all_gold_found"),
        F.sum(F.coalesce((F.col("first_gold_hop") == 0).cast("int"), F.lit(0))).alias("gold_in_first_hop"),
        mean("first_gold_hop", 2).alias("mean_first_gold_hop"),
        mean("depth", 2).alias("mean_depth"),
        F.max("depth").alias("max_depth"),
    )


# --- usage and time --------------------------------------------------------------------------------------------


def merge_usage(log: DataFrame, query: str, key: str, value: str, shard: str) -> DataFrame:
    """(query, key, total, last_text): sums of numeric values, and the text value of the last shard where it is none."""
    number = F.expr(f"try_cast({value} AS double)")
    return log.groupBy(query, key).agg(
        F.round(F.sum(number), 6).alias("total"), F.max_by(F.when(number.isNull(), F.col(value)), F.when(number.isNull(), F.col(shard))).alias("last_text")
    )


def merge_totals(log: DataFrame, query: str, key: str, value: str, shard: str) -> DataFrame:
    """(key, queries, total, first_text, conflict) over all queries of ``merge_usage``: numbers are summed up, of texts
    the one of the least query counts, and ``conflict`` says whether another query has another text."""
    merged = merge_usage(log, query, key, value, shard)
    return merged.groupBy(key).agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.sum("total"), 6).alias("total"),
        F.min_by("last_text", F.when(F.col("last_text").isNotNull(), F.col(query))).alias("first_text"),
        F.coalesce(F.min("last_text") != F.max("last_text"), F.lit(False)).alias("conflict"),
    )


def derived_rates(totals: DataFrame, key: str, seconds: str, **measures: str) -> DataFrame:
    """One row: each named measure's total, that of ``seconds``, and ``{name}_per_second``, from sums and not from means."""
    total = lambda k: F.coalesce(F.sum(F.when(F.col(key) == k, F.col("total"))), F.lit(0.0))
    sums = totals.agg(total(seconds).alias("seconds"), *(total(k).alias(name) for name, k in measures.items()))
    rate = lambda name: F.round(F.when(F.col("seconds") > 0, F.col(name) / F.col("seconds")).otherwise(0.0), 6)
    return sums.select("*", *(rate(name).alias(f"{name}_per_second") for name in measures))


def throughput(tokens: Column, queries: Column, calls: Column, seconds: Column) -> Column:
    """struct of tokens, queries and calls a second; 0 where no time passed."""
    rate = lambda x: F.round(F.when(seconds > 0, x / seconds).otherwise(0.0), 6)
    return F.struct(rate(tokens).alias("tps"), rate(queries).alias("qps"), rate(calls).alias("cps"))


def exact_quantiles(df: DataFrame, columns: list[str], shares: dict[str, float], *group: str) -> DataFrame:
    """Exact, interpolated quantiles ``{name}_{column}`` of each column, in one pass; nulls are left out.

    Equal values are counted in parts first, then a running count finds the two values that a quantile lies between.
    The running count streams over sorted values that may spill; no task holds the values of a group in memory.
    """
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))
    rows = df.select(*(F.col(g) for g in group), F.explode(pairs).alias("x")).select(*group, "x.*")
    counted = rows.groupBy(*group, "column", "value").agg(F.count("value").alias("n"))
    values = Window.partitionBy(*group, "column").orderBy("value")
    upto = F.sum("n").over(values.rowsBetween(Window.unboundedPreceding, 0))
    met = counted.withColumn("_to", upto).withColumn("_all", F.sum("n").over(values.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))

    def quantile(column: str, share: float) -> Column:
        place = (F.col("_all") - 1) * F.lit(share)
        at = lambda i: F.max(F.when((F.col("column") == column) & (i < F.col("_to")) & (i >= F.col("_to") - F.col("n")), F.col("value")))
        part = F.max(F.when(F.col("column") == column, place - F.floor(place)))
        low, high = at(F.floor(place)), at(F.ceil(place))
        return F.round(low + (high - low) * part, 6)

    return met.groupBy(*group).agg(*(quantile(c, share).alias(f"{name}_{c}") for c in columns for name, share in shares.items()))


def median_p90(df: DataFrame, columns: list[str], *group: str) -> DataFrame:
    """Exact median and 90th percentile, interpolated, of each column, in one pass."""
    return exact_quantiles(df, columns, {"median": 0.5, "p90": 0.9}, *group)


def wilcoxon(df: DataFrame, a: str, b: str, *group: str) -> DataFrame:
    """Signed-rank statistic of paired scores: ranks of |a - b| (ties averaged, zeros left out), W the lesser sum.

    Equal differences are one row before they are ranked, so the window runs over distinct values.
    """
    diffs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*group, F.round(F.col(a) - F.col(b), 9).alias("d"))
    sizes = diffs.where("d <> 0").groupBy(*group, F.abs("d").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("d") > 0).cast("int")).alias("up")
    )
    order = Window.partitionBy(*group).orderBy("size") if group else Window.orderBy("size")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rank = upto - (F.col("n") - 1) / 2
    ranked = sizes.withColumn("rank", rank)
    sums = ranked.groupBy(*group).agg(
        F.sum("n").alias("pairs"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("n") - F.col("up"))).alias("w_minus")
    )
    n = F.col("pairs").cast("double")
    z = (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return sums.withColumn("w", F.least("w_plus", "w_minus")).withColumn("z", F.round(z, 6))


def signed_rank_p(pairs: int, w: float, ties: float, exact: bool) -> float:
    """Two-sided p of a signed-rank sum: from all sign patterns if ``exact``, else the normal one with tie correction."""
    if not pairs:
        return 1.0
    if exact:
        ways = [1]
        for rank in range(1, pairs + 1):
            ways = [(ways[i] if i < len(ways) else 0) + (ways[i - rank] if i >= rank else 0) for i in range(len(ways) + rank)]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**pairs)
    variance = pairs * (pairs + 1) * (2 * pairs + 1) / 24 - ties / 48
    return math.erfc(abs(w - pairs * (pairs + 1) / 4) / math.sqrt(2 * variance)) if variance > 0 else 1.0


@F.pandas_udf(T.DoubleType())
def _signed_rank_p(pairs: pd.Series, w: pd.Series, ties: pd.Series, exact: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_p(int(a), b, c, bool(d)) for a, b, c, d in zip(pairs, w, ties, exact, strict=True)], dtype="float64")


def compare_runs(df: DataFrame, a: str, b: str, *group: str) -> DataFrame:
    """``wilcoxon`` with the means of both runs and p; exact for up to 50 pairs without ties and zeros."""
    known = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    means = known.groupBy(*group).agg(F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.count(F.lit(1)).alias("n"))
    sizes = known.select(*group, F.abs(F.round(F.col(a) - F.col(b), 9)).alias("d")).where("d > 0").groupBy(*group, "d").agg(F.count(F.lit(1)).cast("double").alias("t"))
    ties = sizes.groupBy(*group).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    on = list(group) or F.lit(True)
    out = means.join(wilcoxon(df, a, b, *group), on, "left").join(ties, on, "left").fillna(0, ["pairs", "w", "w_plus", "w_minus", "ties"])
    exact = (F.col("ties") == 0) & (F.col("n") == F.col("pairs")) & (F.col("n") <= 50)
    return out.withColumn("p", _signed_rank_p(F.col("pairs"), F.col("w"), F.col("ties"), exact)).drop("n", "ties")
