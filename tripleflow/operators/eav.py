"""Attribute rows (s, p, o) into one row per entity with typed columns: column-block pivoting.

One pass over the rows fills a slot table with a row per cell (entity, attribute), divided into blocks of ``block_size`` attributes and bucketed by
entity, all blocks identically. Each block is pivoted over its buckets, and the blocks are joined bucket by bucket, without another shuffle.

Scale: rows are combined per cell before they are shuffled, so an entity with a third of all rows costs a row per cell and input task.
Whether the values of a cell differ is told by their hashes of 64 bits, which keeps the aggregation free of sorts. Buckets follow from
the number of rows, blocks from the number of attributes. Only the attribute table (one row per column of the result) is on the driver.

Defined results: rows with null s are of no entity and left out; null, blank or unknown p give no column, but their entity has
a row; repeated rows count once; empty tables give no rows; extra columns of the input are ignored. The column of an attribute of many
values (``multi_valued``) is a sorted array of its distinct readable values. A cell of more than MAX_IN_CELL values is null in the wide table
and named in ``overflow``; its values are the rows of ``multi_values``, which has the values of all such cells, one a row. ``unreadable`` names the attributes of
the entity with values that could not be read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_key, trimmed
from ..functions.values import typed, with_reading
from ..storage import bucketed, buckets_for, written

#: More attributes than this aren't held on the driver.
MAX_ATTRIBUTES = 100_000
#: Values that an array in the wide table holds at most.
MAX_IN_CELL = 10_000


@dataclass(frozen=True)
class Attribute:
    label: str
    value_type: str
    unit: str | None
    multi_valued: bool


def attributes(relation_map: DataFrame) -> list[Attribute]:
    """The attributes in order of their id. An action; the list is bounded by MAX_ATTRIBUTES, beyond which it raises."""
    rows = relation_map.select("id", "label", "value_type", "unit", "multi_valued").orderBy("id", "label").limit(MAX_ATTRIBUTES + 1).collect()
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
    first: dict[str, Attribute] = {}
    for r in rows:
        if r.label is not None:
            first.setdefault(r.label, Attribute(r.label, r.value_type or "string", r.unit, bool(r.multi_valued)))
    return list(first.values())


def readings(triples: DataFrame, attrs: list[Attribute]) -> DataFrame:
    """Rows ``(s, p, k, state, canon, shown)``: k is the place of p among the attributes, null if it is not there."""
    spark = triples.sparkSession
    rows = [(a.label, k, a.value_type, a.unit) for k, a in enumerate(attrs)]
    known = F.broadcast(spark.createDataFrame(rows, "label string, k int, value_type string, unit string"))
    base = triples.select(entity_key("s").alias("s"), trimmed("p").alias("p"), F.col("o").cast("string").alias("o")).where(F.col("s").isNotNull())
    joined = base.join(known, base.p == known.label, "left")
    return with_reading(joined).select("s", "p", "k", "state", "canon", "shown")


def _each(c: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(c, lambda x: f(x))


def _typed(kind: str, cell: Column) -> Column:
    return typed(cell["canon"], cell["shown"], kind)


def _cells(rows: DataFrame) -> DataFrame:
    """The state of each cell ``(s, k)``: whether it has an unreadable value, the least and the greatest hash of its values, and how many rows."""
    code = F.xxhash64("canon")
    return rows.groupBy("s", "k").agg(
        F.max((F.col("state") == "bad").cast("int")).alias("bad"), F.min(F.when(F.col("canon").isNotNull(), code)).alias("lo"), F.max(F.when(F.col("canon").isNotNull(), code)).alias("hi"), F.count(F.lit(1)).alias("n_rows")
    )


def _with_values(rows: DataFrame, most: int) -> DataFrame:
    """``_cells`` with ``vals``, the distinct values (canon, shown) of a cell in order, null if there are more than ``most``, and ``over``, whether there are."""
    distinct = written(rows.groupBy("s", "k", "state", "canon").agg(F.min("shown").alias("shown")), "values")
    counted = distinct.where("state = 'ok'").groupBy("s", "k").agg(F.count(F.lit(1)).alias("n"))
    large = counted.where(F.col("n") > most).select("s", "k")
    held = distinct.where("state = 'ok'").join(large, ["s", "k"], "left_anti").groupBy("s", "k").agg(F.array_sort(F.collect_list(F.struct("canon", "shown"))).alias("vals"))
    states = _cells(distinct)
    missed = large.withColumn("over", F.lit(True))
    return states.join(held, ["s", "k"], "left").join(missed, ["s", "k"], "left")


def pivot_blocks(triples: DataFrame, relation_map: DataFrame, block_size: int | None = None, buckets: int | None = None, values: bool = True, most: int = MAX_IN_CELL) -> DataFrame:
    """One row per entity: ``s``, a column per attribute in its type (an array if it is of many values), ``unfilled``, the single-valued
    attributes that can't be filled because a value is unreadable or values differ, ``unreadable`` and ``overflow``. Without ``values``
    only ``s``, ``unfilled`` and ``unreadable``. Writes the slot table: an action."""
    spark = triples.sparkSession
    attrs = attributes(relation_map)
    block_size = block_size or max(8, -(-len(attrs) // 16))
    buckets = buckets or buckets_for(spark, triples.count())
    blocks = [attrs[i : i + block_size] for i in range(0, len(attrs), block_size)] or [[]]
    rows = readings(triples, attrs).select("s", F.coalesce("k", F.lit(-1)).alias("k"), "state", "canon", "shown")
    cells = _with_values(rows, most) if values else _cells(rows)
    slots = cells.select("*", F.greatest(F.floor(F.col("k") / block_size), F.lit(0)).cast("int").alias("block"))
    table = spark.table(bucketed(slots, "eav", "s", buckets, "block"))
    wide = table.select("s").distinct()
    named: list[Column] = []
    flags: dict[str, list[Column]] = {"unfilled": [], "unreadable": [], "overflow": []}
    for b, block in enumerate(blocks):
        picked = []
        for i, a in enumerate(block):
            here = F.col("k") == b * block_size + i
            clash = F.lit(False) if a.multi_valued else (F.col("bad") == 1) | (F.col("lo") != F.col("hi"))
            marks = {"unfilled": clash, "unreadable": F.col("bad") == 1} | ({"overflow": F.col("over")} if values else {})
            for name, when in marks.items():
                picked.append(F.max(F.when(here & when, F.lit(1))).alias(f"{name}_{b}_{i}"))
                flags[name].append(F.when(F.col(f"{name}_{b}_{i}") == 1, F.lit(a.label)))
            if values:
                full = here if a.multi_valued else here & ~F.coalesce(clash, F.lit(False))
                picked.append(F.max(F.when(full, F.col("vals"))).alias(f"v_{b}_{i}"))
                v = F.col(f"v_{b}_{i}")
                one = partial(_typed, a.value_type)
                named.append((_each(v, one) if a.multi_valued else one(F.get(v, F.lit(0)))).alias(a.label))
        if picked:
            wide = wide.join(table.where(F.col("block") == b).groupBy("s").agg(*picked), "s", "left")
    listed = [(F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")).alias(name) for name, found in flags.items() if values or name != "overflow"]
    return wide.select(F.col("s"), *named, *listed)


def multi_values(triples: DataFrame, relation_map: DataFrame) -> DataFrame:
    """All readable values of the attributes of many values: ``(s, p, value, n_rows)``, a row per distinct value."""
    attrs = attributes(relation_map)
    many = [a.label for a in attrs if a.multi_valued]
    rows = readings(triples.where(trimmed("p").isin(*many)) if many else triples.limit(0), attrs)
    return rows.where(F.col("state") == "ok").groupBy("s", "p", F.col("canon").alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))


def cell_texts(wide: DataFrame, attrs: list[Attribute]) -> DataFrame:
    """The filled cells of a wide table, one a row: ``(s, p, n_values, value)``, values as text, those of many by " | "."""
    as_text = lambda kind, c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kind == "timestamp" else c.cast("string")
    parts = []
    for a in attrs:
        c = F.col(f"`{a.label}`")
        each = _each(c, partial(as_text, a.value_type)) if a.multi_valued else F.array(as_text(a.value_type, c))
        parts.append(F.when(c.isNotNull(), F.struct(F.lit(a.label).alias("p"), F.size(each).cast("long").alias("n_values"), F.array_join(F.array_sort(each), " | ").alias("value"))))
    return wide.select("s", F.inline(F.array_compact(F.array(*parts))))


def unfillable(wide: DataFrame) -> DataFrame:
    """The cells ``(s, p)`` of the result of ``pivot_blocks`` that can't be filled."""
    return wide.select("s", F.explode("unfilled").alias("p"))
