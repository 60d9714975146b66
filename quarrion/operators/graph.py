"""Walks over passage graphs, hop by hop."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrion.operators.components import connected_components
from quarrion.session import checkpointed

__all__ = ["connected_components", "edge_candidates", "reachable", "traverse"]

#: Chooses one of the candidate edges of a node, or none: the extension point for models.
EdgeChooser = Callable[[list[dict]], dict | None]


def first_edge(candidates: list[dict]) -> dict | None:
    """The default choice: the first candidate."""
    return candidates[0] if candidates else None


def edge_candidates(frontier: DataFrame, edges: DataFrame, used: DataFrame | None = None, biased: bool = False, hop: int = 0) -> DataFrame:
    """(query_id, src, dst, oq_id, place): edges out of the frontier that were not used, in order of choice.

    The order is by (oq_id, dst); ``biased`` puts the node's conditioned score first, best first at hop 0, least
    first after.
    """
    rows = frontier.join(edges, "src")
    if used is not None:
        rows = rows.join(used, ["query_id", "src", "dst", "oq_id"], "left_anti")
    keys = [F.col("oq_id"), F.col("dst")]
    if biased:
        keys.insert(0, F.desc("conditioned_score") if hop == 0 else F.asc("conditioned_score"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "src").orderBy(*keys)))


def reachable(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(query_id, node, hop): every node within ``hops`` steps of a seed, at its least number of steps."""
    seen = seeds.select("query_id", F.col("src").alias("node")).distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        step = front.select("query_id", F.col("node").alias("src")).join(edges.select("src", "dst"), "src")
        step = step.select("query_id", F.col("dst").alias("node")).distinct()
        front = checkpointed(step.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen


def walk_hops(steps: DataFrame, seeds: DataFrame) -> DataFrame:
    """(query_id, hop, expanded_from, new_passages) of the walks that ``traverse`` gives, as the hop measures take them.

    Hop 0 begins with the seeds; every later one with what the hop before reached for the first time. A node that a walk
    reaches is new only where it was not visited before.
    """
    new = steps.where("NOT repeat").groupBy("query_id", "hop").agg(F.array_sort(F.collect_set("dst")).alias("new_passages"))
    first = seeds.groupBy("query_id").agg(F.array_sort(F.collect_set("src")).alias("front")).withColumn("hop", F.lit(0))
    later = new.select("query_id", F.col("new_passages").alias("front"), (F.col("hop") + 1).alias("hop"))
    fronts = first.unionByName(later).withColumnRenamed("front", "expanded_from")
    last = F.coalesce(F.max("hop").over(Window.partitionBy("query_id")), F.lit(0))
    joined = fronts.join(new, ["query_id", "hop"], "left").withColumn("_last", last)
    return joined.where((F.col("hop") == 0) | F.col("new_passages").isNotNull()).select(
        "query_id", "hop", "expanded_from", F.coalesce("new_passages", F.array().cast("array<string>")).alias("new_passages")
    )


def walk_results(steps: DataFrame, seeds: DataFrame, gold: DataFrame) -> DataFrame:
    """One record a query: seeds, passages visited with the number of visits, steps, repeats, and precision, recall
    and F1 of the visited passages against ``gold`` (query_id, gold array)."""
    visits = seeds.select("query_id", F.col("src").alias("passage")).unionByName(steps.select("query_id", F.col("dst").alias("passage")))
    visits = visits.groupBy("query_id", "passage").agg(F.count(F.lit(1)).cast("int").alias("visits"))
    lists = visits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("passage", "visits"))).alias("visited"))
    walked = steps.groupBy("query_id").agg(
        F.count(F.lit(1)).cast("int").alias("steps"), F.sum(F.col("repeat").cast("int")).cast("int").alias("repeats"), (F.max("hop") + 1).alias("hops")
    )
    rows = lists.join(walked, "query_id", "left").join(gold, "query_id", "left").fillna(0, ["steps", "repeats", "hops"])
    wanted = F.array_distinct(F.coalesce("gold", F.array().cast("array<string>")))
    hits = F.size(F.array_intersect(F.transform("visited", lambda x: x["passage"]), wanted))
    precision, recall = hits / F.size("visited"), F.coalesce(F.try_divide(hits, F.size(wanted)), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return rows.select("query_id", "visited", "steps", "repeats", "hops", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def traverse(seeds: DataFrame, edges: DataFrame, hops: int, choose: EdgeChooser = first_edge, biased: bool = False) -> DataFrame:
    """(query_id, hop, src, dst, oq_id, repeat): the edges that each query's walk takes.

    In each hop every node of the frontier takes at most one edge that was not taken before; a target visited before
    is a repeat and is not expanded again. The order within a hop matters, so a query is walked by one task, over the
    edges that it can reach in ``hops`` steps and no others; these come by joins, not by a broadcast of the graph.
    ``seeds`` has (query_id, src, place).
    """
    near = reachable(seeds, edges, hops - 1).select("query_id", F.col("node").alias("src"))
    local = near.join(edges, "src").select("query_id", "src", "dst", "oq_id", "conditioned_score", F.lit(None).cast("int").alias("place"))
    starts = seeds.select("query_id", "src", F.lit(None).cast("string").alias("dst"), F.lit(None).cast("string").alias("oq_id"), F.lit(None).cast("double").alias("conditioned_score"), "place")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows["query_id"].iloc[0]
        front = rows[rows["place"].notna()].sort_values(["place", "src"])["src"].tolist()
        out_edges: dict = {}
        for edge in rows[rows["place"].isna()].to_dict("records"):
            out_edges.setdefault(edge["src"], []).append(edge)
        taken: set = set()
        visited: set = set()
        steps = []
        for hop in range(hops):
            following = []
            for node in front:
                visited.add(node)
                options = [e for e in out_edges.get(node, []) if (node, e["dst"], e["oq_id"]) not in taken]
                sign = -1 if hop == 0 else 1
                options.sort(key=lambda e: ((sign * e["conditioned_score"],) if biased else ()) + (e["oq_id"], e["dst"]))
                edge = choose(options)
                if edge is None:
                    continue
                taken.add((node, edge["dst"], edge["oq_id"]))
                again = edge["dst"] in visited
                steps.append((key, hop, node, edge["dst"], edge["oq_id"], again))
                if not again:
                    following.append(edge["dst"])
                    visited.add(edge["dst"])
            front = following
        return pd.DataFrame(steps, columns=["query_id", "hop", "src", "dst", "oq_id", "repeat"])

    both = local.unionByName(starts)
    schema = f"query_id {seeds.schema['query_id'].dataType.simpleString()}, hop int, src string, dst string, oq_id string, repeat boolean"
    return both.groupBy("query_id").applyInPandas(walk, schema)
