"""Tables for comparing runs: labels, group aggregates, deltas, normalised columns, Pareto fronts and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrion.operators.metrics import exact_quantiles


def label_first(cases: list[tuple[str, Column]], unmatched: str | None = None) -> Column:
    """The name of the first predicate that holds; ``unmatched`` or null for none."""
    out = F.lit(unmatched).cast("string")
    for name, predicate in reversed(cases):
        out = F.when(F.coalesce(predicate, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def label_all(df: DataFrame, cases: list[tuple[str, Column]], name: str = "label") -> DataFrame:
    """One row per predicate that holds."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit(False)), F.lit(n)) for n, p in cases]))
    return df.withColumn(name, F.explode(found))


def group_metrics(df: DataFrame, groups: list[str], metric: str) -> DataFrame:
    """Count, mean, median, least and greatest of a metric that may be text; what is no number is left out."""
    value = F.expr(f"try_cast({metric} AS double)")
    rows = df.select(*groups, F.when(~F.isnan(value), value).alias("v")).where("v IS NOT NULL")
    stats = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("least"), F.max("v").alias("greatest")
    )
    medians = exact_quantiles(rows, ["v"], {"median": 0.5}, *groups).select(*(F.col(g).alias(f"_{g}") for g in groups), F.col("median_v").alias("median"))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    return stats.join(medians, same).drop(*(f"_{g}" for g in groups))


def percent_delta(a: Column, b: Column, lower_is_better: bool = False) -> Column:
    """(a - b) / |b| in percent, its sign turned where less is better; null for b = 0."""
    delta = F.try_divide((a - b) * 100.0, F.abs(b))
    return F.round(-delta if lower_is_better else delta, 6)


def column_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column as a share of its range over all rows; 0.5 where constant, null where null.

    The ranges are one row, joined; no window over all rows.
    """
    spans = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"_{c}") for c in columns])
    joined = df.join(F.broadcast(spans), F.lit(True))
    for c in columns:
        lo, hi = F.col(f"_{c}.lo"), F.col(f"_{c}.hi")
        share = F.when(F.col(c).isNull(), None).when(hi == lo, 0.5).otherwise((F.col(c) - lo) / (hi - lo))
        joined = joined.withColumn(c, F.round(share, 6)).drop(f"_{c}")
    return joined


def pareto_front(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rows that no other row beats: by x upward, those whose y exceeds all before; ties in x go to the greater y.

    Each range partition keeps its own front first; what is left is small, and one window finishes it.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    best = rows.groupBy(x).agg(F.max(y).alias(y))
    front = best.repartitionByRange(x).withColumn("_p", F.spark_partition_id())
    before = lambda *keys: F.max(y).over(Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, -1))
    front = front.withColumn("_m", before("_p")).where(F.col("_m").isNull() | (F.col(y) > F.col("_m")))
    front = front.withColumn("_m", before(F.lit(0))).where(F.col("_m").isNull() | (F.col(y) > F.col("_m"))).drop("_p", "_m")
    return rows.join(front, [x, y], "left_semi")


def run_rollup(runs: DataFrame, keys: list[str], cube: bool = False) -> DataFrame:
    """Means and totals per run: answers, tokens, seconds and tokens a second. ``runs`` is one row an answer."""
    grouped = runs.cube(*keys) if cube else runs.groupBy(*keys)
    return grouped.agg(
        F.count(F.lit(1)).alias("answers"),
        F.round(F.avg("em") * 100, 4).alias("em"),
        F.round(F.avg("f1") * 100, 4).alias("f1"),
        F.sum("tokens").alias("tokens"),
        F.round(F.sum("seconds"), 4).alias("seconds"),
        F.round(F.coalesce(F.try_divide(F.sum("tokens"), F.sum("seconds")), F.lit(0.0)), 4).alias("tps"),
    )
