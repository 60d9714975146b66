"""Top N items within every group, by a hot-cold split.

Exact group counts part the groups. The heavy groups' names are few and are broadcast after a check of their
number; were they more than ``MOST_HEAVY``, they would be joined instead. Light groups go through one shuffle on the group key, which serves the
deduplication and the window both. Heavy groups are deduplicated on (group, item), so no task gets a whole
group, range-sorted by (group, score, item) over many partitions, cut to N within each partition before any
further shuffle, and merged.

Null and NaN scores are left out, and so are null groups or items; a group without any score has no row. An
item counts once, with its highest score. Ties go to the smaller item in byte order. ``n`` < 1 gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrion.session import parallelism

#: Rows from which a group is heavy. The heavy list then has at most rows / HEAVY_ROWS entries.
HEAVY_ROWS = 100_000
#: Heavy groups up to which their names are broadcast.
MOST_HEAVY = 20_000


def _ranked(df: DataFrame, n: int, *keys: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc("item"))
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= n)


def top_n(
    df: DataFrame, group: str, item: str, score: str, n: int, heavy_rows: int = HEAVY_ROWS, pieces: int | None = None
) -> DataFrame:
    """(group, item, score, rank) of the ``n`` best items of each group."""
    rows = df.select(F.col(group).alias("grp"), F.col(item).alias("item"), F.col(score).cast("double").alias("score"))
    rows = rows.where(F.col("grp").isNotNull() & F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    rows = rows.withColumn("score", F.col("score") + F.lit(0.0))  # -0.0 and 0.0 tie
    heavy = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= heavy_rows).select("grp")
    names = heavy.limit(MOST_HEAVY + 1).collect()
    if len(names) <= MOST_HEAVY:
        heavy = F.broadcast(df.sparkSession.createDataFrame(names, heavy.schema))
    pieces = pieces or 4 * parallelism(df.sparkSession)

    light = rows.join(heavy, "grp", "left_anti") if names else rows
    light = light.repartition("grp").groupBy("grp", "item").agg(F.max("score").alias("score"))
    light = _ranked(light, n, "grp").select("grp", "item", "score", "rank")
    columns = [F.col("grp").alias(group), F.col("item").alias(item), F.col("score").alias(score), "rank"]
    if not names:
        return light.select(*columns)

    hot = rows.join(heavy, "grp", "left_semi").groupBy("grp", "item").agg(F.max("score").alias("score"))
    hot = hot.repartitionByRange(pieces, F.asc("grp"), F.desc("score"), F.asc("item"))
    hot = _ranked(hot.withColumn("piece", F.spark_partition_id()), n, "grp", "piece").drop("rank", "piece")
    hot = _ranked(hot, n, "grp")

    return light.unionByName(hot.select("grp", "item", "score", "rank")).select(*columns)


def found(retrieval_scores: DataFrame) -> DataFrame:
    """p4_found: (query_id, chunk_id) of the ten best items of each query."""
    return top_n(retrieval_scores, "query_id", "chunk_id", "score", 10).select("query_id", "chunk_id")
