"""Row numbers over a whole table, and ranks within groups of any size, without one task that sorts them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrion.session import checkpointed, parallelism


def with_row_numbers(df: DataFrame, order: str, name: str, total: str | None = None) -> DataFrame:
    """``df`` with ``name``, counting from 0 by ``order`` (unique), and ``total``, the number of rows.

    Rows are range-partitioned and sorted within partitions; the sizes of the partitions give each one's first
    number. The sorted rows are checkpointed, as sizes and rows must come of the same ranges.
    """
    pieces = 2 * parallelism(df.sparkSession)
    ranged = df.repartitionByRange(pieces, order).sortWithinPartitions(order)
    ranged = checkpointed(ranged.withColumn("_piece", F.spark_partition_id()).withColumn("_id", F.monotonically_increasing_id()))
    sizes = ranged.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("_n").over(Window.partitionBy(F.lit(0)))
    bases = sizes.select("_piece", "_first", before.alias("_base"), whole.alias(total or "_total"))
    out = ranged.join(F.broadcast(bases), "_piece").withColumn(name, F.col("_base") + F.col("_id") - F.col("_first"))
    return out.drop("_piece", "_id", "_first", "_base", *([] if total else ["_total"]))


def with_group_ranks(df: DataFrame, groups: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, from 1 within each group by ``order``, where a group may hold any share of the rows.

    Rows are range-partitioned by group and order, so a large group is spread over many partitions; ranks within a
    partition and the group's rows in the partitions before add up. The partitioned rows are checkpointed, as sizes and
    rows must come of the same ranges.
    """
    pieces = 2 * parallelism(df.sparkSession)
    keys = [F.col(g).asc() for g in groups]
    ranged = checkpointed(df.repartitionByRange(pieces, *keys, *order).withColumn("_piece", F.spark_partition_id()))
    sizes = ranged.groupBy(*groups, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)), F.col("_piece").alias("_p"), before.alias("_base"))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]
    within = F.row_number().over(Window.partitionBy("_piece", *groups).orderBy(*order))
    out = ranged.withColumn("_r", within).join(bases, [F.col("_piece") == F.col("_p"), *same])
    return out.withColumn(name, (F.col("_base") + F.col("_r")).cast("int")).drop("_piece", "_p", "_base", "_r", *(f"_g{i}" for i in range(len(groups))))
