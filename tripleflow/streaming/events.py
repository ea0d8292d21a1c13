"""Streams of events: progress per key, changes, averages that forget, windows, buffered sinks. Each works on a stream and on a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, key: str, order: list[str], values: list[str]) -> DataFrame:
    """The last values of each key; on a stream with output mode ``update`` or ``complete``."""
    return events.groupBy(key).agg(*(F.max_by(v, F.struct(*order)).alias(v) for v in values), F.count(F.lit(1)).alias("n"))


def windows(events: DataFrame, at: str, size: str, by: list[str], value: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Count and sum per window of event time; ``late``: how long a stream waits for late events."""
    src = events.withWatermark(at, late) if late else events
    w = F.window(at, size, slide) if slide else F.window(at, size)
    got = src.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return got.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, by: str, late: str | None = None) -> DataFrame:
    """Events of a key less than ``gap`` apart, as sessions."""
    src = events.withWatermark(at, late) if late else events
    got = src.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return got.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    """A stream's first event of each key within a span of time."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def _settle(rows: DataFrame, key: str, value: str, order: list[str], horizon: Column) -> tuple[DataFrame, DataFrame]:
    """The changes among the rows up to ``horizon``, and what is kept: the last of them per key (``done``), and the rows beyond."""
    w = Window.partitionBy(key)
    ordered = w.orderBy(F.col("done").desc(), *order)
    last = F.max(F.when(F.col("done"), F.struct(*order))).over(w)
    on_time = rows.withColumn("__last", last).where(F.col("done") | F.col("__last").isNull() | (F.struct(*order) >= F.col("__last"))).drop("__last")
    placed = on_time.withColumn("__settled", F.col("done") | (F.col(order[0]) <= horizon))
    marked = placed.withColumns({"__before": F.lag(value).over(ordered), "__n": F.row_number().over(ordered)})
    out = marked.where("__settled and not done").where((F.col("__n") == 1) | ~F.col(value).eqNullSafe(F.col("__before")))
    newest = F.row_number().over(Window.partitionBy(key, "__settled").orderBy("done", *(F.col(c).desc() for c in order)))
    kept = placed.withColumn("__k", newest).where(~F.col("__settled") | (F.col("__k") == 1)).withColumn("done", F.col("__settled"))
    names = list(dict.fromkeys([key, value, *order]))
    return out.select(*names), kept.select(*names, "done")


def changed(stream: DataFrame, key: str, value: str, order: list[str], path: str, checkpoint: str, late: str = "0 seconds", once_only: bool = False):
    """Appends a stream's events whose value differs from the one before of their key to ``path``; the first counts. Gives the query.

    Events are put in ``order`` (event time first, then what tells equals apart), across the batches and triggers of the stream: an event is settled
    when one has been seen that is ``late`` younger, and waits in a buffer till then. Events older than a settled one of their key come too late and
    are left out; so are those without a time. A trigger reads the state of the one before it, which holds the last event of each key and
    the buffer, and names what it writes by its number, so that a repeated trigger writes the same again.
    ``changed_rest`` gives what is still in the buffer when a stream has ended."""
    names = list(dict.fromkeys([key, value, *order]))

    def trigger(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*names).where(F.col(order[0]).isNotNull()).withColumn("done", F.lit(False))
        if epoch:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/state/{epoch - 1}"))
        newest = rows.agg(F.max(order[0]).alias("newest"))
        placed = rows.crossJoin(F.broadcast(newest)).withColumn("__horizon", F.col("newest") - F.expr(f"interval {late}"))
        out, kept = _settle(placed, key, value, order, F.col("__horizon"))
        kept.write.mode("overwrite").parquet(f"{path}/state/{epoch}")
        out.write.mode("overwrite").parquet(f"{path}/changes/epoch={epoch}")

    w = stream.writeStream.foreachBatch(trigger).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once_only else w).start()


def changed_rest(spark: SparkSession, path: str, key: str, value: str, order: list[str], epoch: int) -> DataFrame:
    """The changes among the events that wait in the buffer after trigger ``epoch``, all of them settled now."""
    return _settle(spark.read.parquet(f"{path}/state/{epoch}"), key, value, order, F.col(order[0]))[0]


def ewma(events: DataFrame, key: str, order: list[str], value: str, keep: float = 0.8) -> DataFrame:
    """``(key, ewma)``: old * keep + new * (1 - keep) over a key's values in order, beginning with the first.

    By weights of the place from the end, so that values are summed where they are and a key's rows never meet in one array.
    """
    w = Window.partitionBy(key)
    placed = events.withColumn("__k", F.row_number().over(w.orderBy(*(F.col(c).desc() for c in order))) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    weight = F.pow(F.lit(keep), F.col("__k")) * F.when(F.col("__k") == F.col("__n") - 1, F.lit(1.0)).otherwise(F.lit(1 - keep))
    return placed.groupBy(key).agg(F.sum(F.col(value) * weight).alias("ewma"))


def buffered(stream: DataFrame, path: str, checkpoint: str, seconds: int = 30, rows_per_file: int = 5000, once_only: bool = False):
    """Appends a stream to Parquet files of at most ``rows_per_file`` rows, every ``seconds``; columns may come later. Gives the query."""

    def flush(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("batch", F.lit(epoch)).write.mode("append").option("maxRecordsPerFile", rows_per_file).option("mergeSchema", "true").parquet(path)

    w = stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once_only else w.trigger(processingTime=f"{seconds} seconds")).start()
