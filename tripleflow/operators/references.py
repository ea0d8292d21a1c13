"""References to records that do not exist, by signed counts from change deltas.

Every change is a delta: a record's life adds +1 to the existence count of its key and -1 when it ends; a reference adds +1 to the
reference count of its key. ``period_state`` sums the deltas per (key, month) and carries the existence count into each month;
within a month the deltas are run in order of time, so each reference meets the count that holds at its instant. A key with
references and an existence count of zero is an orphan. ``merge_state`` adds new deltas to kept counts, so that the current
report needs only what changed.

Scale: deltas are summed before they are shuffled; a (key, month) of more than ROWS_A_TASK references is split into as many salted parts
as bring it below that, each with a copy of the few life deltas of that key and month. The list of such keys is bounded: at most
``1 / HOT_SHARE`` of them can hold that share of all references, and only they are broadcast.

Defined results: null is no reference, nor is null instant one that can be tested: such a row is an orphan, as no life covers
it; lives without a start or label count for nothing; a blank reference is a key like any other; records stored twice add two to
the count and take it away one by one; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import entity_key
from ..storage import written

#: References of a (key, month) that one task takes at most, unless they are less than HOT_SHARE of all.
ROWS_A_TASK, HOT_SHARE = 50_000, 1 / 100_000
#: A life delta comes before a reference of the same instant.
LIFE, REFERENCE = 0, 1


def life_deltas(records: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """``(key, at, delta)``: the changes of the existence count, summed per key and instant."""
    lived = records.select(entity_key(key).alias("key"), F.col(start).alias("start"), F.col(end).alias("end")).where(F.col("key").isNotNull() & F.col("start").isNotNull())
    lived = lived.where(F.col("end").isNull() | (F.col("start") < F.col("end")))
    changes = F.array(
        F.struct(F.col("start").alias("at"), F.lit(1).cast("long").alias("delta")),
        F.struct(F.col("end").alias("at"), F.lit(-1).cast("long").alias("delta")),
    )
    flat = lived.select("key", F.explode(changes).alias("c")).select("key", "c.at", "c.delta").where(F.col("at").isNotNull())
    return flat.groupBy("key", "at").agg(F.sum("delta").alias("delta")).where(F.col("delta") != 0)


def reference_rows(rows: DataFrame, tab: str, field: str, row_id: str, key: str, at: str) -> DataFrame:
    """``(tab, field, row_id, key, at)`` of the non-null references of one field."""
    return rows.select(F.lit(tab).alias("tab"), F.lit(field).alias("field"), F.col(row_id).cast("long").alias("row_id"), entity_key(key).alias("key"), F.col(at).alias("at")).where(F.col("key").isNotNull())


def month_of(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def period_state(lives: DataFrame, references: DataFrame) -> DataFrame:
    """``(key, month, refs, born, carry)``: references and the sum of life deltas of each month, and the existence count carried
    into it. A key has as many rows as months in which it changed or was referred to."""
    life = lives.groupBy("key", month_of(F.col("at")).alias("month")).agg(F.sum("delta").alias("born"), F.lit(0).cast("long").alias("refs"))
    refs = references.groupBy("key", month_of(F.col("at")).alias("month")).agg(F.lit(0).cast("long").alias("born"), F.count(F.lit(1)).alias("refs"))
    both = life.unionByName(refs).groupBy("key", "month").agg(F.sum("born").alias("born"), F.sum("refs").alias("refs"))
    past = Window.partitionBy("key").orderBy(F.col("month").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("carry", F.coalesce(F.sum("born").over(past), F.lit(0).cast("long")))


def orphans(lives: DataFrame, references: DataFrame, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """The references ``(tab, field, row_id, key, at, month)`` whose key has an existence count of zero at their instant.
    Writes the state of the periods: an action."""
    state = written(period_state(lives, references).where(F.col("refs") > 0), "periods")
    total = state.agg(F.sum("refs")).first()[0] or 0
    large = state.where(F.col("refs") > max(rows_a_task, total * HOT_SHARE))
    hot = F.broadcast(large.select("key", "month", F.ceil(F.col("refs") / rows_a_task).cast("int").alias("salts")))

    refs = references.withColumn("month", month_of(F.col("at"))).join(hot, ["key", "month"], "left")
    refs = refs.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("tab", "field", "row_id"), F.col("salts")), F.lit(0)).cast("int"))
    spread = lambda df: df.join(hot, ["key", "month"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1)))
    life = lives.withColumn("month", month_of(F.col("at"))).join(state.select("key", "month"), ["key", "month"], "left_semi")
    none = lambda kind: F.lit(None).cast(kind)
    carried = spread(state.where(F.col("carry") != 0)).select("key", "month", "salt", none("timestamp").alias("at"), F.lit(LIFE).alias("kind"), F.col("carry").alias("delta"), none("string").alias("tab"), none("string").alias("field"), none("long").alias("row_id"))
    within = spread(life).select("key", "month", "salt", "at", F.lit(LIFE).alias("kind"), "delta", none("string").alias("tab"), none("string").alias("field"), none("long").alias("row_id"))
    referring = refs.select("key", "month", "salt", "at", F.lit(REFERENCE).alias("kind"), F.lit(0).cast("long").alias("delta"), "tab", "field", "row_id")
    run = Window.partitionBy("key", "month", "salt").orderBy(F.col("at").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stream = carried.unionByName(within).unionByName(referring).withColumn("existing", F.sum("delta").over(run))
    return stream.where((F.col("kind") == REFERENCE) & ((F.col("existing") <= 0) | F.col("at").isNull())).select("tab", "field", "row_id", "key", "at", "month")


def report(found: DataFrame) -> DataFrame:
    """Orphans per table, field and month: rows and keys."""
    pairs = found.groupBy("tab", "field", "month", "key").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("tab", "field", "month").agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_keys"))


def merge_state(kept: DataFrame | None, lives: DataFrame, references: DataFrame) -> DataFrame:
    """``(key, refs, existing)``: the signed counts after the deltas; ``kept`` is the result of an earlier call. Keys without counts drop out."""
    deltas = lives.select("key", F.lit(0).cast("long").alias("refs"), F.col("delta").alias("existing")).unionByName(
        references.select("key", F.lit(1).cast("long").alias("refs"), F.lit(0).cast("long").alias("existing"))
    )
    if kept is not None:
        deltas = kept.select("key", "refs", "existing").unionByName(deltas)
    return deltas.groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing")).where((F.col("refs") != 0) | (F.col("existing") != 0))


def maintained(lives: DataFrame, references: DataFrame, cuts: list[str]) -> DataFrame:
    """The state after all deltas, kept from one period to the next: the deltas up to each of ``cuts`` (instants) are merged into the state
    that was written at the one before, so that a period reads its own deltas and the state. Deltas without an instant are of the last period. An action."""
    state, last = None, None
    for cut in [*cuts, None]:
        after = F.lit(True) if last is None else F.col("at") > F.lit(last).cast("timestamp")
        of = (after & (F.col("at") <= F.lit(cut).cast("timestamp"))) if cut else (after | F.col("at").isNull())
        if last is None and cut is None:
            of = F.lit(True)
        state = merge_state(state, lives.where(of), references.where(of))
        if cut:
            state, last = written(state, "counts"), cut
    return state


def current_orphans(state: DataFrame) -> DataFrame:
    """Keys with references and no existing record."""
    return state.where((F.col("refs") > 0) & (F.col("existing") <= 0)).select("key", "refs")
