"""Most similar vectors for every vector: a permutation index whose lists lose no pair.

Every vector is represented by the order of its nearest pivots, a sample of the vectors (``place``). It lives in the cell of the first of them, and
is posted in the list of every pivot q to whose cell a vector similar enough could belong. For unit vectors x of cell p, the margin
(x.p - x.q) / |p - q| is the distance of x to the plane between p and q. If y of cell q has a cosine of at least ``least`` to x, their distance is at most
d = sqrt(2 - 2 least), and as the plane is between them, their margins sum to at most d: one of the two has a margin of at most d / 2 and is posted in the list of the other's pivot.
So the lists hold every pair, however the vectors crowd, and the length of a vector's order that is posted follows from ``least`` and not from a constant.
Each vector posted in a list is compared with those that live there. As all that is posted is compared, a rank by the distance of
orders would decide nothing for pairs, and there is none.

Exact copies are one representative in the comparison, and come back as rows in both results. Cells are packed in blocks of about CHUNK
rows in the shared folder, pivots that are near to each other together; a cell of more rows has several blocks. A task compares two blocks of bounded size: the posted rows
of either with the cells of the other. On 60,000 vectors a row is posted in 16 % of the lists, and the share falls with the root of
the number of pivots, which grows with the root of the rows up to MAX_PIVOTS.

A top-k search meets every block of the rows asked for with every block of all rows, exactly.

Defined results: null, empty, zero, NaN-bearing or infinite vectors, vectors with null elements and those of other lengths take no part; an entity
may have several rows, a row is what is compared; in a top-k report the copies of a row come first, and ties (cosines equal to DIGITS digits) go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Rows of a block, and those of them that are multiplied at a time.
CHUNK, STEP = 8192, 512
#: Pivots for each root of the number of rows, and how many there are at most.
PIVOTS_A_ROOT, MAX_PIVOTS = 4, 4096
#: Digits to which a top-k report compares cosines.
DIGITS = 12


def usable(rows: DataFrame, vec_id: str, vector: str, dimension: int) -> DataFrame:
    """``(id, v)`` of the vectors that take part, as they are."""
    v = F.col(vector)
    ok = (F.size(v) == dimension) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.coalesce(ok, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), v.cast("array<float>").alias("v"))


def representatives(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rep, v)``, a row per different vector, and ``(id, rep)``, all rows. Copies are found by the SHA-256 of their numbers, so that ids are
    shuffled and not vectors. Writes the second."""
    keyed = vectors.select("id", F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256).alias("h"))
    members = written(keyed.join(keyed.groupBy("h").agg(F.min("id").alias("rep")), "h").select("id", "rep"), "members")
    copies = members.where(F.col("id") != F.col("rep")).select(F.col("id").alias("rep"))
    return vectors.select(F.col("id").alias("rep"), "v").join(copies, "rep", "left_anti"), members


PACKED = "block int, cells binary, ids binary, vectors binary"


def unit(m: np.ndarray) -> np.ndarray:
    """The rows in double precision and of length one."""
    m = m.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def choose_pivots(reps: DataFrame, n: int) -> np.ndarray:
    """The pivots: a sample by a hash of the ids, those near to each other in a row. Bounded by MAX_PIVOTS. An action."""
    most = max(1, min(MAX_PIVOTS, int(PIVOTS_A_ROOT * math.sqrt(n))))
    rows = reps.select("v").orderBy(F.xxhash64("rep", F.lit(5)), "rep").limit(most).collect()
    if not rows:
        return np.zeros((0, 1), np.float32)
    p = unit(np.array([r.v for r in rows]))
    seeds = p[: max(1, int(math.sqrt(len(p))))]
    near = p @ seeds.T
    return p[np.lexsort((-near.max(axis=1), near.argmax(axis=1)))].astype(np.float32)


def place(reps: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``(cell, rep, v)``: the vectors with the nearest of the pivots."""
    sent = reps.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                cell = (unit(v).astype(np.float32) @ p.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), part.column(0), part.column(1)], ["cell", "rep", "v"])

    return reps.select("rep", "v").mapInArrow(run, "cell int, rep long, v array<float>")


def packed(placed: DataFrame, name: str) -> DataFrame:
    """PACKED: the rows ``(cell, rep, v)`` in blocks of about CHUNK rows, by cell and id. Writes them.

    The sizes of the cells are on the driver: at most MAX_PIVOTS."""
    spark = placed.sparkSession
    sizes = placed.groupBy("cell").count().orderBy("cell").collect()
    plan, block, filled = [], -1, CHUNK
    for cell, n in sizes:
        if filled + n > CHUNK:
            block, filled = block + 1, 0
        own = -(-n // CHUNK)
        plan.append((cell, block, own))
        filled += n
        if own > 1:
            block, filled = block + own - 1, CHUNK
    where = F.broadcast(spark.createDataFrame(plan, "cell int, first int, own int"))

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("cell", "ascending"), ("rep", "ascending")]).combine_chunks()
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        raw = [t.column("cell").to_numpy().astype(np.int32), t.column("rep").to_numpy(), v.astype(np.float32)]
        return pa.table([t.column("block").slice(0, 1), *(pa.array([x.tobytes()], pa.binary()) for x in raw)], names=["block", "cells", "ids", "vectors"])

    keyed = placed.join(where, "cell").select((F.col("first") + F.pmod(F.xxhash64("rep", F.lit(3)), F.col("own"))).cast("int").alias("block"), "cell", "rep", "v")
    return written(keyed.groupBy("block").applyInArrow(pack, PACKED), name)


class Block:
    """A block in memory: its ids, unit vectors, cells, and the rows of each cell."""

    def __init__(self, cells: bytes, ids: bytes, vectors: bytes) -> None:
        self.cell = np.frombuffer(cells, np.int32)
        self.ids = np.frombuffer(ids, np.int64)
        self.v = unit(np.frombuffer(vectors, np.float32).reshape(len(self.ids), -1))
        self.v32 = self.v.astype(np.float32)
        self.cells, self.starts = np.unique(self.cell, return_index=True)
        self.ends = np.append(self.starts[1:], len(self.cell))
        self.at = np.searchsorted(self.cells, self.cell)

    def posted(self, pivots: np.ndarray, other: Block, most: float) -> np.ndarray:
        """Which rows are posted in the list of each cell of ``other``: those with a margin of at most ``most``."""
        p, q = pivots[self.cells], pivots[other.cells]
        gap = np.sqrt(np.maximum(2 - 2 * p @ q.T, 0))
        own = np.einsum("ij,ij->i", self.v32, p[self.at])
        return own[:, None] - self.v32 @ q.T <= np.maximum(most * gap, 0)[self.at] + 1e-4


def similar_in(a: Block, b: Block, same: bool, pivots: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The ids of the pairs of two blocks with a cosine of at least ``least``, each pair once."""
    half = math.sqrt(max(0.0, 2 - 2 * least)) / 2
    slack = (a.v.shape[1] + 8) * float(np.finfo(np.float32).eps)  # more than a product in single precision can be off
    a_to_b = a.posted(pivots, b, half)
    b_to_a = a_to_b if same else b.posted(pivots, a, half)
    for one, two, there, back, first in ((a, b, a_to_b, b_to_a, True),) if same else ((a, b, a_to_b, b_to_a, True), (b, a, b_to_a, a_to_b, False)):
        for c, (lo, hi) in enumerate(zip(two.starts, two.ends)):
            rows = np.nonzero(there[:, c])[0]
            for at in range(0, len(rows), CHUNK // 4):
                sel = rows[at : at + CHUNK // 4]
                near = one.v32[sel] @ two.v32[lo:hi].T
                i, j = np.nonzero(near >= least - slack)
                if not len(i):
                    continue
                value, i, j = near[i, j], sel[i], j + lo
                met = back[j, one.at[i]]  # the other is posted here too: the pair is met twice
                keep = (~met | (i < j)) & (i != j) if same else np.ones(len(i), bool) if first else ~met
                edge = np.nonzero(keep & (value < least + slack))[0]
                for few in np.array_split(edge, len(edge) // 100_000 + 1):
                    keep[few] = np.einsum("ij,ij->i", one.v[i[few]], two.v[j[few]]) >= least
                if keep.any():
                    yield one.ids[i[keep]], two.ids[j[keep]]


def similar_pairs(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """``(id_a, id_b)``: the pairs of rows ``(id, v)`` with a cosine of at least ``least``, smaller id first. Exact. An action."""
    reps, members = representatives(vectors)
    pivots = choose_pivots(reps, reps.count())
    sent = vectors.sparkSession.sparkContext.broadcast(pivots)
    blocks = packed(place(reps, pivots), "blocks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Block] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = [batch.column(c)[k].as_py() for c in range(8)]
                for n, parts in ((row[0], row[2:5]), (row[1], row[5:8])):
                    if n not in held:
                        if len(held) > 3:
                            held.clear()
                        held[n] = Block(*parts)
                a, b = (held.get(row[0]) or Block(*row[2:5])), held[row[1]]
                for x, y in similar_in(a, b, row[0] == row[1], sent.value, least):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    two = blocks.toDF("block_b", "cells_b", "ids_b", "vectors_b")
    met = blocks.join(two, F.col("block") <= F.col("block_b")).select("block", "block_b", "cells", "ids", "vectors", "cells_b", "ids_b", "vectors_b")
    near = met.mapInArrow(compare, "a long, b long")
    ma, mb = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = near.join(ma, "a").join(mb, "b").select("x", "y")
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("rep")
    same = members.join(copies, "rep", "left_semi")
    within = same.select(F.col("id").alias("x"), "rep").join(same.select(F.col("id").alias("y"), "rep"), "rep").where(F.col("x") < F.col("y")).select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def most_similar(vectors: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """``(id, neighbour, place, cosine)``: of each row asked for (its ``id``), the ``k`` most similar other rows, its own copies first. Exact. An action."""
    reps, members = representatives(vectors)
    wanted = members.join(asked.select("id"), "id", "left_semi")
    pivots = choose_pivots(reps, reps.count())
    queries = packed(place(reps.join(wanted.select("rep").distinct(), "rep", "left_semi"), pivots), "queries").toDF("block_a", "cells_a", "ids_a", "vectors_a")
    cells = queries.crossJoin(packed(place(reps, pivots), "blocks")).select("ids_a", "vectors_a", "ids", "vectors")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a_ids, a_bytes, b_ids, b_bytes = (batch.column(c)[r].as_py() for c in range(4))
                x, y = np.frombuffer(a_ids, np.int64), np.frombuffer(b_ids, np.int64)
                a, b = (unit(np.frombuffer(v, np.float32).reshape(len(n), -1)) for n, v in ((x, a_bytes), (y, b_bytes)))
                for at in range(0, len(x), STEP):
                    near = np.round(a[at : at + STEP] @ b.T, DIGITS)
                    near[x[at : at + STEP, None] == y[None, :]] = -2
                    n = min(k, len(y))
                    edge = np.partition(near, len(y) - n, axis=1)[:, len(y) - n]
                    i, j = np.nonzero((near >= edge[:, None]) & (near > -2))  # ties at the edge too
                    order = np.lexsort((y[j], -near[i, j], i))
                    i, j = i[order], j[order]
                    best = np.arange(len(i)) - np.searchsorted(i, i) < k
                    i, j = i[best], j[best]
                    yield pa.RecordBatch.from_arrays([pa.array(x[at + i]), pa.array(y[j]), pa.array(near[i, j])], ["a", "b", "cosine"])

    order = Window.partitionBy("a").orderBy(F.col("cosine").desc(), "b")
    top = cells.mapInArrow(compare, "a long, b long, cosine double").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("a", "b", "cosine")
    # The first k + 1 rows of a group are all that k places can show of it, the row itself left out.
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1).select(F.col("rep").alias("b"), F.col("id").alias("neighbour"))
    groups = top.unionByName(wanted.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("cosine")).distinct())
    rows = wanted.join(groups.join(first, "b"), F.col("rep") == F.col("a")).where(F.col("neighbour") != F.col("id"))
    places = Window.partitionBy("id").orderBy((F.col("a") == F.col("b")).desc(), F.col("cosine").desc(), "neighbour")
    return rows.withColumn("place", F.row_number().over(places)).where(F.col("place") <= k).select("id", "neighbour", "place", "cosine")
