"""Vectors of entities: distances, scores, features, averages, fallbacks for unknown entities, and training."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import delete, new_path, written


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


#: Queries of a search that are sent to the executors at a time, about.
QUERIES_AT_ONCE = 5_000


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: x - y)
    return F.sqrt(dot(d, d))


def normalized(v: Column) -> Column:
    """Of length one; the zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))


def transe(h: Column, r: Column, t: Column, p: int = 2) -> Column:
    """-|h + r - t| in the L1 or L2 norm."""
    d = F.zip_with(F.zip_with(h, r, lambda x, y: x + y), t, lambda x, y: x - y)
    return -F.aggregate(d, F.lit(0.0), lambda s, x: s + F.abs(x)) if p == 1 else -F.sqrt(dot(d, d))


def triple_features(h: Column, r: Column, t: Column) -> Column:
    """h, r, t, the score, h * t and |h - t| by element, and the three lengths: 5 d + 4 values."""
    return F.concat(h, r, t, F.array(transe(h, r, t)), F.zip_with(h, t, lambda x, y: x * y), F.zip_with(h, t, lambda x, y: F.abs(x - y)), F.array(norm(h), norm(r), norm(t)))


def nearest(rows: DataFrame, key: str, vector: str, asked: DataFrame, k: int = 10, metric: str = "cosine") -> DataFrame:
    """``(query, key, place, value)``: the ``k`` rows nearest to each query (query, qv), itself left out; exact.

    ``value`` is the cosine, from high to low, or the euclidean distance, from low to high. The queries go
    to all executors in blocks of about QUERIES_AT_ONCE and meet the rows in blocks; each batch of rows gives ``k`` rows per query at most, so what is shuffled doesn't
    grow with the vectors.
    """
    held = asked.select(F.col("query").cast("long"), doubles(F.col("qv")).alias("qv"))
    n_blocks = max(1, -(-held.count() // QUERIES_AT_ONCE))
    parts = [held.where(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == i) for i in range(n_blocks)]
    return reduce(DataFrame.unionAll, (_nearest(rows, key, vector, part.collect(), k, metric) for part in parts))


def _nearest(rows: DataFrame, key: str, vector: str, held: list, k: int, metric: str) -> DataFrame:
    """``nearest`` for the queries ``held`` on the driver."""
    sent = rows.sparkSession.sparkContext.broadcast((np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            own = batch.column(0).to_numpy()
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            dots = q @ v.T
            if metric == "cosine":
                value = dots / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :], 1e-300)
                cost = -value
            else:
                value = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * dots, 0))
                cost = value.copy()
            cost[ids[:, None] == own[None, :]] = np.inf
            n = min(k, len(own))
            best = np.argpartition(cost, n - 1, axis=1)[:, :n]
            edge = np.take_along_axis(cost, best, 1).max(axis=1)
            i, j = np.nonzero((cost <= edge[:, None]) & np.isfinite(cost))  # ties at the edge too
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(own[j]), pa.array(value[i, j])], ["query", key, "value"])

    got = rows.select(F.col(key).cast("long").alias(key), doubles(F.col(vector)).alias("v")).where(F.col("v").isNotNull()).mapInArrow(run, f"query long, {key} long, value double")
    near = F.round("value", 9)
    order = Window.partitionBy("query").orderBy(near.desc() if metric == "cosine" else near.asc(), key)
    return got.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def score_triples(t: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Triples (s, p, o) with ``score``; -infinity where a part has no vector (label, v)."""
    e, r = entities.select("label", "v"), relations.select("label", "v")
    j = t.join(r.toDF("p", "rv"), "p", "left").join(e.toDF("s", "hv"), "s", "left").join(e.toDF("o", "tv"), "o", "left")
    return j.select(*t.columns, F.coalesce(transe(F.col("hv"), F.col("rv"), F.col("tv")), F.lit(float("-inf"))).alias("score"))


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, v)``: the mean vector of each key, element by element; only sums are shuffled."""
    parts = rows.select(key, F.posexplode(doubles(F.col(vector))).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))


def padded(v: Column, width: int) -> Column:
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), width)), 1, width)


def oov_kind(label: Column) -> Column:
    """uuid, date, number, code or text, by the look of a label."""
    return (
        F.when(label.rlike(r"^[0-9A-Za-z]{32}$"), "uuid").when(label.contains("T") & label.rlike(r"(Z|[+-]\d{2}:\d{2})$"), "date").when(label.rlike(r"^\d+$"), "number")
        .when(label.rlike(r"^[A-Z0-9_]+$"), "code").otherwise("text")
    )


def input_quality(t: DataFrame, entities: DataFrame) -> DataFrame:
    """Per kind of label: entities of the triples, and those without a row in the map (label)."""
    labels = t.select(F.explode(F.array("s", "o")).alias("label")).distinct()
    known = entities.select("label", F.lit(1).alias("hit")).distinct()
    return labels.join(known, "label", "left").groupBy(oov_kind(F.col("label")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("hit").isNull()).alias("n_unknown"))


def hybrid_score(parts: DataFrame, scores: list[str], penalty: str) -> DataFrame:
    """``score``: the mean of the scores that are there, 0.5 if none is, less the penalty, within 0 and 1; ``verdict`` by 0.3 and 0.5."""
    there = F.array_compact(F.array(*(F.col(c).cast("double") for c in scores)))
    mean = F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda s, x: s + x) / F.size(there)).otherwise(F.lit(0.5))
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean - F.coalesce(F.col(penalty), F.lit(0.0))))
    return parts.withColumn("score", F.round(s, 9)).withColumn("verdict", F.when(F.col("score") < 0.3, "reject").when(F.col("score") < 0.5, "review").otherwise("accept"))


def sample_weights(rows: DataFrame, active: str) -> DataFrame:
    """``weight``: 1 + log(1 + active) / 2, divided by its mean."""
    w = 1 + 0.5 * F.log1p(F.col(active).cast("double"))
    mean = rows.agg(F.avg(w).alias("mean"))
    return rows.crossJoin(F.broadcast(mean)).withColumn("weight", F.round(w / F.col("mean"), 9)).drop("mean")


#: Entities and numbers of a block of vectors in training, and relations that every task holds, at most.
BLOCK, NUMBERS, MAX_RELATIONS = 262_144, 4_194_304, 100_000
#: Facts that a task trains on, about, and tasks of a job.
FACTS, TASKS = 2_000_000, 64


def _start(n: int, dim: int, seed: int, kind: str, spark) -> DataFrame:
    """``(id, v)`` with numbers that the hash of id, place and seed gives, uniform within 6 / sqrt(dim)."""
    one = lambda i: (F.pmod(F.xxhash64("id", i, F.lit(f"{kind}{seed}")), F.lit(2_000_001)) - 1_000_000) / F.lit(1e6) * F.lit(6 / dim**0.5)
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(dim)), one).alias("v"))


def _vector_blocks(vectors: DataFrame, n_blocks: int) -> DataFrame:
    """``(block, ids, vectors)``, a row for each block."""

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("id").combine_chunks()
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table([t.column("block").slice(0, 1), pa.array([t.column("id").to_numpy().tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], names=["block", "ids", "vectors"])

    return vectors.withColumn("block", F.pmod("id", F.lit(n_blocks)).cast("int")).groupBy("block").applyInArrow(pack, "block int, ids binary, vectors binary")


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _train_cell(e: np.ndarray, r: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, margin: float, rate: float, dice: np.random.Generator) -> None:
    """One pass of descent over facts (a, b, c), places in e and r, which it changes; each fact against one with a corrupted end."""
    for at in range(0, len(a), 256):
        h, p, t = a[at : at + 256], b[at : at + 256], c[at : at + 256]
        bad, swap = dice.integers(0, len(e), len(h)), dice.random(len(h)) < 0.5
        h2, t2 = np.where(swap, bad, h), np.where(swap, t, bad)
        d, d2 = e[h] + r[p] - e[t], e[h2] + r[p] - e[t2]
        n, n2 = (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9 for x in (d, d2))
        on = (margin + n - n2 > 0).astype(float) * rate
        g, g2 = on * d / n, on * d2 / n2
        for m, ids, grad in ((e, h, -g), (e, t, g), (r, p, g2 - g), (e, h2, g2), (e, t2, -g2)):
            np.add.at(m, ids, grad)


def train_transe(indexed: DataFrame, n_entities: int, n_relations: int, dim: int = 16, epochs: int = 5, margin: float = 1.0, rate: float = 0.05, seed: int = 42) -> DataFrame:
    """``(kind, id, v)``: TransE vectors by averaged stochastic descent over (s_id, p_id, o_id). An action.

    Entities are in blocks of at most BLOCK. A task takes the facts between two blocks with the vectors of just these, and trains a copy of them;
    corrupted ends are of the same blocks. After each epoch the moves of a vector are averaged over the tasks that changed it. Vectors and moves are rows of
    whole blocks in the shared folder, read by the tasks that need them, without a shuffle, and deleted after their epoch: disk is that of the facts, two copies of
    the vectors and the moves of one epoch. The relations, at most MAX_RELATIONS, go to every task."""
    if n_relations > MAX_RELATIONS:
        raise ValueError(f"more than {MAX_RELATIONS} relations")
    spark = indexed.sparkSession
    n_blocks = max(1, -(-n_entities // max(1, min(BLOCK, NUMBERS // dim))))
    part = lambda c: F.pmod(c, F.lit(n_blocks)).cast("int")
    facts = written(indexed.select("s_id", "p_id", "o_id").distinct(), "facts")
    n_facts = facts.count()
    facts = facts.select(F.least(part("s_id"), part("o_id")).alias("lo"), F.greatest(part("s_id"), part("o_id")).alias("hi"), "s_id", "p_id", "o_id")
    slices = max(1, -(-n_facts // (FACTS * (n_blocks * (n_blocks + 1) // 2))))
    sliced = facts.withColumn("slice", F.pmod(F.xxhash64("s_id", "p_id", "o_id"), F.lit(slices)).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("s_id", "ascending"), ("p_id", "ascending"), ("o_id", "ascending")]).combine_chunks()
        cols = [pa.array([t.column(n).to_numpy().astype(np.int64).tobytes()], pa.binary()) for n in ("s_id", "p_id", "o_id")]
        return pa.table([*(t.column(n).slice(0, 1) for n in ("lo", "hi", "slice")), *cols], names=["lo", "hi", "slice", "s", "p", "o"])

    cells = written(sliced.groupBy("lo", "hi", "slice").applyInArrow(pack, "lo int, hi int, slice int, s binary, p binary, o binary"), "cells")
    places = [tuple(r) for r in cells.select("lo", "hi", "slice").orderBy("lo", "hi", "slice").collect()]
    start = written(_start(n_relations, dim, seed, "r", spark), "relations").orderBy("id").toArrow()
    rel = np.array(start["v"].to_pylist(), float).reshape(-1, dim)
    none = lambda n: F.lit(None).cast("binary").alias(n)
    ints = lambda x: np.frombuffer(x, np.int64)
    nums = lambda x: np.frombuffer(x, np.float64).reshape(-1, dim)
    tables = lambda schema, of: pa.RecordBatch.from_arrays([pa.array([r[i] for r in of], t) for i, t in enumerate(schema.values())], list(schema))

    def jobs(parts: list[DataFrame], path: str) -> None:
        """Writes parts of one task each, TASKS of them in a job."""
        for at in range(0, len(parts), TASKS):
            reduce(DataFrame.unionAll, parts[at : at + TASKS]).write.mode("append").parquet(path)

    def stored(path: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(path)

    block_schema, move_schema = "block int, ids binary, vectors binary", "kind string, block int, tag int, ids binary, d binary"
    here = new_path(spark, "blocks")
    _vector_blocks(_start(n_entities, dim, seed, "e", spark), n_blocks).write.parquet(here)
    for epoch in range(epochs):
        blocks = stored(here, block_schema)
        sent = spark.sparkContext.broadcast(rel)

        def step(batches: Iterator[pa.RecordBatch], epoch=epoch, sent=sent) -> Iterator[pa.RecordBatch]:
            cell, got = None, {}
            for batch in batches:
                for k in range(batch.num_rows):
                    row = [batch.column(c)[k].as_py() for c in range(7)]
                    if row[0] == "facts":
                        cell = row[1:]
                    else:
                        got[row[1]] = (ints(row[4]), _unit(nums(row[5])))
            (tag, pair, piece), (a, b, c) = cell[:3], map(ints, cell[3:])
            lo, hi = divmod(pair, n_blocks)
            own = [got[x] for x in dict.fromkeys((lo, hi))]
            ids, e0 = (np.concatenate([x[i] for x in own]) for i in (0, 1))
            order = np.argsort(ids)
            ids, e0, r0 = ids[order], e0[order], sent.value
            e, r = e0.copy(), r0.copy()
            mix = np.random.default_rng([seed, epoch, lo, hi, piece])
            turn = mix.permutation(len(a))
            _train_cell(e, r, np.searchsorted(ids, a)[turn], b[turn], np.searchsorted(ids, c)[turn], margin, rate, mix)
            out = []
            for x in dict.fromkeys((lo, hi)):
                hit = np.nonzero((ids % n_blocks == x) & (e != e0).any(axis=1))[0]
                out.append(("e", x, tag, ids[hit].tobytes(), (e[hit] - e0[hit]).astype(np.float32).tobytes()))
            hit = np.nonzero((r != r0).any(axis=1))[0]
            out.append(("r", 0, tag, hit.astype(np.int64).tobytes(), (r[hit] - r0[hit]).astype(np.float32).tobytes()))
            yield tables({"kind": pa.string(), "block": pa.int32(), "tag": pa.int32(), "ids": pa.binary(), "d": pa.binary()}, out)

        def mean(rows: list[tuple[int, bytes, bytes]], ids: np.ndarray) -> np.ndarray:
            """The mean move of each id over the tasks that moved it."""
            total, n = np.zeros((len(ids), dim)), np.zeros((len(ids), 1))
            for _, which, d in sorted(rows, key=lambda x: x[0]):
                at = np.searchsorted(ids, ints(which))
                total[at] += np.frombuffer(d, np.float32).reshape(-1, dim)
                n[at] += 1
            return total / np.maximum(n, 1)

        def apply(batches: Iterator[pa.RecordBatch], mean=mean) -> Iterator[pa.RecordBatch]:
            old, rows = None, []
            for batch in batches:
                for k in range(batch.num_rows):
                    kind, block, tag, ids, d = (batch.column(c)[k].as_py() for c in range(5))
                    if kind == "v":
                        old = block, ints(ids), _unit(nums(d))
                    else:
                        rows.append((tag, ids, d))
            block, ids, v = old
            yield tables({"block": pa.int32(), "ids": pa.binary(), "vectors": pa.binary()}, [(block, ids.tobytes(), (v + mean(rows, ids)).tobytes())])

        moves, after = new_path(spark, "moves"), new_path(spark, "blocks")
        spark.createDataFrame([], move_schema).write.parquet(moves)
        trained = []
        for tag, (lo, hi, piece) in enumerate(places):
            mine = cells.where((F.col("lo") == lo) & (F.col("hi") == hi) & (F.col("slice") == piece))
            mine = mine.select(F.lit("facts").alias("kind"), F.lit(tag).alias("tag"), F.lit(lo * n_blocks + hi).alias("pair"), "slice", "s", "p", "o")
            theirs = blocks.where(F.col("block").isin(lo, hi)).select(F.lit("vectors"), "block", F.lit(0), F.lit(0), "ids", "vectors", none("o"))
            trained.append(mine.unionAll(theirs).coalesce(1).mapInArrow(step, move_schema))
        jobs(trained, moves)
        moved = stored(moves, move_schema)
        before = lambda x: blocks.where(F.col("block") == x).select(F.lit("v").alias("kind"), "block", F.lit(0).alias("tag"), "ids", F.col("vectors").alias("d"))
        jobs([before(x).unionAll(moved.where((F.col("kind") == "e") & (F.col("block") == x))).coalesce(1).mapInArrow(apply, block_schema) for x in range(min(n_blocks, n_entities))], after)
        rel = rel + mean([(m.tag, bytes(m.ids), bytes(m.d)) for m in moved.where("kind = 'r'").toLocalIterator()], np.arange(n_relations))
        delete(spark, moves)
        delete(spark, here)
        here = after

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, v = ints(batch.column(1)[k].as_py()), nums(batch.column(2)[k].as_py())
                for at in range(0, len(ids), 10_000):
                    flat = v[at : at + 10_000]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * dim, pa.int32()), pa.array(flat.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(["entity"] * len(flat)), pa.array(ids[at : at + 10_000]), lists], ["kind", "id", "v"])

    schema = "kind string, id long, v array<double>"
    entities = stored(here, block_schema).mapInArrow(unpack, schema)
    return entities.unionByName(spark.createDataFrame([("relation", i, v) for i, v in enumerate(rel.tolist())], schema))


def vectors_of(labels: DataFrame, entities: DataFrame) -> DataFrame:
    """``(label, v)`` of the wanted labels; null where there is no vector."""
    return labels.select("label").join(entities.select("label", "v"), "label", "left")


def statistics(vectors: DataFrame) -> DataFrame:
    """One row over vectors (kind, id, v): entities, relations, dimension and numbers in all."""
    n = lambda kind: F.count_if(F.col("kind") == kind)
    return vectors.agg(n("entity").alias("n_entities"), n("relation").alias("n_relations"), F.max(F.size("v")).alias("dim"), F.coalesce(F.sum(F.size("v")), F.lit(0)).cast("long").alias("n_numbers"))
