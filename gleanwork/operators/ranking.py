"""Positions in a total order, given out without bringing the rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanwork.session import cut


def numbered(df: DataFrame, order: list[Column], out: str = "rank") -> DataFrame:
    """``df`` with ``out``: 1, 2, ... in the given order.

    The rows are sorted by ranges; a row's number is its place within its range plus the rows of
    the ranges before it. Only the sizes of the ranges come to the driver, one for each partition.
    """
    row = F.monotonically_increasing_id()
    held = cut(df.orderBy(*order).withColumn("_row", row))
    part, place = F.shiftright("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1)
    sizes = held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, starts = 0, []
    for r in sizes:
        starts.append((r["part"], before))
        before += r["n"]
    if not starts:
        return held.select(*df.columns, F.lit(0).cast("long").alias(out))
    first = df.sparkSession.createDataFrame(starts, "_part long, _before long")
    return held.withColumn("_part", part).join(F.broadcast(first), "_part").select(*df.columns, (F.col("_before") + place + 1).alias(out))


def without_first(df: DataFrame, order: list[Column], drop: int) -> DataFrame:
    """``df`` without its first ``drop`` rows in the given order, unsorted otherwise."""
    ranked = numbered(df, order, "_rank")
    return ranked.filter(F.col("_rank") > drop).drop("_rank")
