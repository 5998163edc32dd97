"""Global row numbers without gathering rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.session import cut_lineage


def with_row_index(df: DataFrame, *order: str | Column, name: str = "row_index") -> DataFrame:
    """df with its rows' numbers from 0 in that order.

    Rows are dealt by ranges and numbered inside each range; the ranges' sizes (one row
    per partition) are added up and joined back.  The dealt rows are written to the
    checkpoint folder, as ranges are sampled and could differ if they were made anew.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = cut_lineage(dealt.withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("_before"))
    # One row per partition: the broadcast is bounded by the number of partitions.
    rows = dealt.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    return rows.withColumn(name, F.col("_before") + inside).drop("_part", "_before", "_at")
