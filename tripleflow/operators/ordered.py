"""Row numbers and running sums over a whole table, without one task that holds it.

The table is split into ranges of the order, one per task, and written; the sums of the ranges are carried forward on the driver (a row per
range), and windows run within a range. Rows that are equal in the order must be equal in what depends on it, or the order made total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *(F.col(c).asc_nulls_first() for c in order)).withColumn("__range", F.spark_partition_id()), "ranged")


def _carry(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """A row per range with the sums of all ranges before it; the ranges are as many as shuffle partitions."""
    names = list(sums)
    rows = df.groupBy("__range").agg(*(F.coalesce(F.sum(sums[n]).cast("double"), F.lit(0.0)).alias(n) for n in names)).orderBy("__range").collect()
    out, so_far = [], [0.0] * len(names)
    for r in rows:
        out.append((r["__range"], *so_far))
        so_far = [a + r[n] for a, n in zip(so_far, names)]
    return F.broadcast(df.sparkSession.createDataFrame(out, "__range int, " + ", ".join(f"`__c_{n}` double" for n in names)))


def numbered(df: DataFrame, order: list[str], name: str = "id", start: int = 0) -> DataFrame:
    """``df`` with its row numbers in ``order`` (ascending, nulls first), from ``start``. An action."""
    split = _ranged(df, order)
    within = Window.partitionBy("__range").orderBy(*(F.col(c).asc_nulls_first() for c in order))
    one = _carry(split, {"n": F.lit(1)})
    return split.join(one, "__range").withColumn(name, (F.col("__c_n") + F.row_number().over(within) - 1 + start).cast("long")).drop("__range", "__c_n")


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """``df`` with running sums ``{new column: summed column}`` in ``order``, its own row included. An action."""
    split = _ranged(df, order)
    within = Window.partitionBy("__range").orderBy(*(F.col(c).asc_nulls_first() for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    carried = split.join(_carry(split, {n: F.col(c) for n, c in sums.items()}), "__range")
    return carried.withColumns({n: F.col(f"__c_{n}") + F.sum(c).over(within) for n, c in sums.items()}).drop("__range", *(f"__c_{n}" for n in sums))
