"""Frequency of every distinct term: recursive radix spilling.

1. ``occurrences`` cuts each row into terms and counts (field, term, record) per input batch.
2. ``spill`` writes these to the shared folder in partitions by bits of the hash of the term, a file each.
3. ``aggregate`` gives each partition to a DuckDB of its own, with a memory limit and a spill folder, in the task that reads its file.
   A partition above ``limit`` rows is split by the next bits instead, again and again; the bits of the record's hash follow those of the
   term's, so that one term with very many records is split too. Records of one term in different partitions are different
   records, so their counts add up to the exact total.

Scale: one shuffle, of the pre-counted occurrences, for each level of the recursion, a level having the oversized partitions only; the partitions
are as many as the rows ask for; no partition above ``limit`` rows is counted (up to equal 64-bit hashes); the driver holds the row
counts of at most ``2 ** MAX_BITS`` partitions a level.

Defined results: rows with null record don't count; null values have no terms; a term counts once per row; empty tables give no
terms; texts are used whole.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_key, trimmed
from ..storage import bucketed, local_path, new_path, shared_dir

#: Rows of a partition beyond which it is split, and how many hash bits a level takes at most.
LIMIT, MAX_BITS = 1_000_000, 11
#: Terms that a row is expected to have, from which the bits of the first level follow.
TERMS_A_ROW = 3
#: Levels that take bits of the term's hash; deeper ones take bits of the record's.
TERM_LEVELS = 3
RARE_RECORDS, COMMON_SHARE = 2, 0.07
DUCKDB_MEMORY = "400MB"


def terms_of(text: str) -> set[str]:
    """The terms of a text: NFC, lower case, split at white space, freed at both ends of all but letters and digits, kept if two or
    more letters remain and nothing else."""
    out = set()
    # letter by letter, as SQL does: else İ becomes an i and a mark, which is no letter, and a word ends in another sigma than it has within
    for piece in unicodedata.normalize("NFC", text).replace("\u0130", "i").replace("\u03a3", "\u03c3").lower().split():
        if not piece.isalpha():
            i, j = 0, len(piece)
            while i < j and not piece[i].isalnum():
                i += 1
            while j > i and not piece[j - 1].isalnum():
                j -= 1
            piece = piece[i:j]
            if not piece.isalpha():
                continue
        if len(piece) > 1:
            out.add(piece)
    return out


def occurrences(rows: DataFrame) -> DataFrame:
    """``(field, term, record, n)`` of rows (record, p, o), combined per batch of input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            n: Counter[tuple[str, str, str]] = Counter()
            for record, p, o in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if p is not None:
                    n["p", p, record] += 1
                if o is not None:
                    found = known.get(o) if len(o) < 200 else None
                    if found is None:
                        found = tuple(terms_of(o))
                        if len(o) < 200:
                            if len(known) > 50_000:
                                known.clear()
                            known[o] = found
                    for t in found:
                        n["o", t, record] += 1
            keys = list(n)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array(list(n.values()), pa.int64())], ["field", "term", "record", "n"])

    return rows.select("record", "p", "o").mapInArrow(run, "field string, term string, record string, n long")


def _bits(level: int, bits: int) -> Column:
    """The partition of a row at a level: ``bits`` bits of the term's hash, beyond TERM_LEVELS of the record's."""
    h, k = (F.col("h"), level) if level < TERM_LEVELS else (F.col("hr"), level - TERM_LEVELS)
    return F.shiftrightunsigned(h, k * MAX_BITS).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def bits_for(rows: int, limit: int) -> int:
    """How many bits part ``rows`` into partitions of about an eighth of ``limit``, within MAX_BITS."""
    return max(1, min(MAX_BITS, math.ceil(math.log2(max(2.0, 8 * rows / limit)))))


def spill(rows: DataFrame, level: int, bits: int) -> DataFrame:
    """``rows`` on disk, bucketed by their hash bits: all rows of a ``part`` are in one file of its bucket. An action."""
    placed = rows.withColumn("part", _bits(level, bits))
    return rows.sparkSession.table(bucketed(placed, "radix", "part", 1 << bits))


def _count_part(t: pa.Table, spill_root: str | None) -> pa.Table:
    """The counts of one partition, by a DuckDB of its own that spills under ``spill_root``, or not at all if the shared folder is no file path: ``limit`` rows fit."""
    import shutil

    import duckdb

    folder = f"{spill_root}/tripleflow/duck-{uuid.uuid4().hex[:12]}" if spill_root else ""
    db = duckdb.connect(config={"memory_limit": DUCKDB_MEMORY, "threads": 1, "temp_directory": folder})
    try:
        db.register("t", t)
        return db.sql("select field, term, sum(n)::bigint n_rows, count(*) n_records from (select field, term, record, sum(n) n from t group by all) group by all").to_arrow_table()
    finally:
        db.close()
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


def aggregate(rows: DataFrame, out: str, limit: int, bits: int, level: int = 0) -> None:
    """Appends ``(field, term, n_rows, n_records)`` of the partitions of ``rows`` to the folder ``out``.

    Partitions of at most ``limit`` rows are counted where they lie; each larger one is split by the next bits, and so on. The driver holds
    the sizes of the partitions of one level, at most ``2 ** MAX_BITS`` of them, for each level it is in.
    """
    spark = rows.sparkSession
    disk = spill(rows, level, bits)
    last = level + 1 >= TERM_LEVELS + 64 // MAX_BITS
    sizes = {r["part"]: r["count"] for r in disk.groupBy("part").count().collect()}
    large = [] if last else sorted(k for k, n in sizes.items() if n > limit)
    root = local_path(shared_dir(spark))
    small = disk.where(~F.col("part").isin(large)) if large else disk
    if len(large) < len(sizes):
        got = small.groupBy("part").applyInArrow(lambda t: _count_part(t, root), "field string, term string, n_rows long, n_records long")
        got.write.mode("append").parquet(out)
    for k in large:
        aggregate(disk.where(F.col("part") == k).drop("part"), out, limit, bits_for(sizes[k], limit), level + 1)


def term_counts(triples: DataFrame, limit: int = LIMIT, bits: int | None = None) -> DataFrame:
    """``(field, term, n_rows, n_records)`` of the values of p and the terms of o. Spills and counts: an action."""
    spark = triples.sparkSession
    rows = triples.select(entity_key("s").alias("record"), trimmed("p").alias("p"), F.col("o").cast("string").alias("o")).where(F.col("s").isNotNull())
    occ = occurrences(rows).withColumns({"h": F.xxhash64("field", "term"), "hr": F.xxhash64("record")})
    bits = bits or bits_for(TERMS_A_ROW * triples.count(), limit)
    out = new_path(spark, "counts")
    schema = "field string, term string, n_rows long, n_records long"
    spark.createDataFrame([], schema).write.parquet(out)
    aggregate(occ, out, limit, bits)
    # a term whose records were split has a row for each part
    return spark.read.schema(schema).parquet(out).groupBy("field", "term").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records"))


def marked(counts: DataFrame, triples: DataFrame, rare: int = RARE_RECORDS, common: float = COMMON_SHARE) -> DataFrame:
    """``counts`` with ``mark``: rare (in at most ``rare`` records), common (in at least the share ``common`` of all), or null. A term
    that is both, in a very small table, has a row for either."""
    total = triples.select(entity_key("s").alias("s")).where(F.col("s").isNotNull()).distinct().agg(F.count(F.lit(1)).alias("records"))
    marks = F.array_compact(F.array(F.when(F.col("n_records") <= rare, F.lit("rare")), F.when(F.col("n_records") >= F.col("records") * F.lit(common), F.lit("common"))))
    return counts.crossJoin(F.broadcast(total)).select("field", "term", "n_rows", "n_records", F.explode_outer(marks).alias("mark"))
