"""Results per key where a few keys hold most rows: multi-level tree aggregation.

Rows are combined in chunks of the input first: a chunk is a slice of an input partition, so its size is fixed by
``spark.sql.files.maxPartitionBytes`` and not by the keys. The states (key, chunk) are then merged ``fan_in`` chunks at a time, in
log(chunks) rounds, so that no task ever receives more than ``fan_in`` states of a key, whatever share of the rows it has.
Distinct counts are exact: pairs (key, value) are made distinct by the hash of the pair, which spreads a hot key over all
tasks, and the pairs are counted through the same tree.

Defined results: a null key forms no group (but its rows count in ``total``); ties, repeated rows and empty tables need no
case of their own; an empty table gives no groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slices of an input partition.
SLICES = 4


def tree_sum(df: DataFrame, keys: list[str], sums: list[str], chunk: Column, chunks: int, fan_in: int = 16) -> DataFrame:
    """Sums per key through rounds of merging; ``chunk`` numbers the rows' chunks from 0 to ``chunks`` - 1."""
    state = df.select(*keys, *sums, chunk.cast("long").alias("chunk"))
    while chunks > 1:
        state = state.groupBy(*keys, "chunk").agg(*(F.sum(c).alias(c) for c in sums))
        chunks = -(-chunks // fan_in)
        state = state.withColumn("chunk", F.floor(F.col("chunk") / fan_in))
    return state.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def input_chunk(df: DataFrame) -> tuple[Column, int]:
    """The chunk of each row of a scan, and how many there are at most."""
    n = max(1, df.rdd.getNumPartitions())
    place = F.monotonically_increasing_id()
    return F.shiftright(place, 33) * SLICES + place % SLICES, n * SLICES


def profile(df: DataFrame, key: Column, distinct: dict[str, Column] | None = None, fan_in: int = 16) -> DataFrame:
    """Per key ``rows`` and for each entry of ``distinct`` the exact number of its distinct non-null values."""
    distinct = distinct or {}
    keyed = df.select(key.alias("key"), *(c.alias(f"d_{n}") for n, c in distinct.items())).where(F.col("key").isNotNull())
    chunk, chunks = input_chunk(df)
    out = tree_sum(keyed.select("key", F.lit(1).cast("long").alias("rows"), chunk.alias("at")), ["key"], ["rows"], F.col("at"), chunks, fan_in)
    spread = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for n in distinct:
        pairs = keyed.select("key", F.col(f"d_{n}").alias("v")).where(F.col("v").isNotNull()).distinct()
        states = pairs.select("key", F.lit(1).cast("long").alias(n), F.pmod(F.xxhash64("key", "v"), F.lit(spread)).alias("at"))
        counts = tree_sum(states, ["key"], [n], F.col("at"), spread, fan_in).withColumnRenamed("key", "k2")
        out = out.join(counts, F.col("key") == F.col("k2"), "left").drop("k2").withColumn(n, F.coalesce(F.col(n), F.lit(0).cast("long")))
    return out


def heavy_keys(df: DataFrame, key: Column, share: float) -> DataFrame:
    """Keys with at least ``share`` of all rows of ``df``, rows without a key included: ``(key, rows, total)``."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return profile(df, key).crossJoin(F.broadcast(total)).where(F.col("rows") >= F.col("total") * F.lit(share))
