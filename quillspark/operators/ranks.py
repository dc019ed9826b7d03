"""Places and running sums over a whole table, without a task that holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.storage import materialize

_ROW = (1 << 33) - 1


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in range partitions of the order, with the partition's number and the place in it."""
    at = F.monotonically_increasing_id()
    return materialize(df.orderBy(*order).select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit(_ROW)).alias("_row")), "ranged")


def _before(ranged: DataFrame, total: Column) -> DataFrame:
    """(_part, _before): what stands before each partition. The driver sees one row a partition."""
    sums = ranged.groupBy("_part").agg(total.alias("n")).collect()
    at, rows = 0, []
    for r in sorted(sums, key=lambda r: r["_part"]):
        rows.append((r["_part"], at))
        at += r["n"] or 0
    return F.broadcast(ranged.sparkSession.createDataFrame(rows, "_part long, _before long"))


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds each row's place in the order, from 1 on. Equal rows get places in any order."""
    ranged = _ranged(df, order)
    return ranged.join(_before(ranged, F.count("*")), "_part").withColumn(name, F.col("_before") + F.col("_row") + 1).select(*df.columns, name)


def running(df: DataFrame, order: list[Column], size: Column, name: str = "running") -> DataFrame:
    """Adds the sum of ``size`` over all rows up to each one; the order has to tell rows apart. Null sizes count as none."""
    ranged = _ranged(df.withColumn("_size", F.coalesce(size, F.lit(0)).cast("long")), order)
    within = F.sum("_size").over(Window.partitionBy("_part").orderBy("_row"))
    return ranged.join(_before(ranged, F.sum("_size")), "_part").withColumn(name, F.col("_before") + within).select(*df.columns, name)


def numbered(df: DataFrame, first: int = 0, name: str = "doc") -> DataFrame:
    """Adds a number to each row, without gaps from ``first`` on, in any order; nothing is shuffled."""
    at = F.monotonically_increasing_id()
    held = materialize(df.select("*", F.shiftright(at, 33).alias("_part"), at.bitwiseAND(F.lit(_ROW)).alias("_row")), "numbered")
    return held.join(_before(held, F.count("*")), "_part").withColumn(name, F.col("_before") + F.col("_row") + first).select(*df.columns, name)
