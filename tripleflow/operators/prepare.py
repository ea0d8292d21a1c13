"""Preparing a graph for training: optimising its density, and chains of steps that are skipped when nothing they depend on has changed.

Defined results: thresholds are floors that the percentile of degrees may raise; where no setting reaches the target, the strictest result stays; triples are added in
the order of their md5; empty tables stay empty.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from . import graph as g
from .relational import exact_sample, exact_split

#: By how much the thresholds for degrees and supports are relaxed, in the order of trial.
DEGREES, SUPPORTS = (1.5, 1.0, 0.5), (1.0, 0.5, 0.2)


@dataclass(frozen=True)
class Targets:
    """What a graph is optimised for."""

    share: float = 0.05
    min_degree: int = 2
    min_support: int = 10
    triples: int = 0


def filtered(t: DataFrame, share: float, min_degree: int, min_support: int) -> DataFrame:
    """Triples whose ends have enough rows, then those whose relation has enough triples left."""
    return g.balance_relations(g.percentile_filter(t, share, min_degree), min_support)


def relaxed(t: DataFrame, targets: Targets, kept: DataFrame) -> DataFrame:
    """The first of nine settings, each from the thresholds as given, that keeps four fifths of the target; ``kept`` if none does. An action."""
    for degree in DEGREES:
        for support in SUPPORTS:
            got = written(filtered(t, targets.share, max(1, int(targets.min_degree * degree)), max(1, int(targets.min_support * support))), "relaxed")
            if got.count() >= 0.8 * targets.triples:
                return got
    return kept


def touching(t: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples one end of which at least is among ``entities`` (entity)."""
    e = entities.select("entity").distinct()
    marked = t.join(e.select(F.col("entity").alias("s"), F.lit(True).alias("__s")), "s", "left").join(e.select(F.col("entity").alias("o"), F.lit(True).alias("__o")), "o", "left")
    return marked.where(F.col("__s") | F.col("__o")).select(*t.columns)


def augmented(kept: DataFrame, original: DataFrame, target: int) -> DataFrame:
    """``kept`` with triples up to ``target``: missing inverses of symmetric relations, then triples of the original that touch an entity of
    ``kept``. An action."""
    need = target - kept.count()
    if need <= 0:
        return kept
    inverse = written(exact_sample(g.augment_inverse(kept), ["s", "p", "o"], need), "inverse")
    rest = need - inverse.count()
    out = kept.select("s", "p", "o").unionByName(inverse)
    if rest > 0:
        entities = g.entity_labels(kept).distinct().withColumnRenamed("label", "entity")
        more = touching(original.select("s", "p", "o").distinct(), entities).join(out, ["s", "p", "o"], "left_anti")
        out = out.unionByName(exact_sample(more, ["s", "p", "o"], rest))
    return out


def optimized(t: DataFrame, targets: Targets) -> DataFrame:
    """The distinct triples by degree and support, relaxed where less than four fifths of the target are left, and augmented up to it. An action."""
    original = t.select("s", "p", "o").distinct()
    kept = written(filtered(original, targets.share, targets.min_degree, targets.min_support), "optimized")
    if kept.count() < 0.8 * targets.triples:
        kept = relaxed(original, targets, kept)
    return augmented(kept, original, targets.triples)


def prepared(t: DataFrame, targets: Targets, shares: tuple[float, ...] = (0.8, 0.1, 0.1)) -> dict[str, DataFrame]:
    """The tables of a training: ``entities`` and ``relations`` (id, label), and the indexed ``triples`` (s_id, p_id, o_id, split). An action."""
    best = written(exact_split(optimized(t, targets), ["s", "p", "o"], shares), "prepared")
    entities, relations = written(g.vocabulary(g.entity_labels(best)), "entities"), written(g.vocabulary(best.select(F.col("p").alias("label"))), "relations")
    parts = [g.index_triples(best.where(F.col("split") == n), entities, relations).withColumn("split", F.lit(n)) for n in ("train", "valid", "test")]
    return {"entities": entities, "relations": relations, "triples": parts[0].unionByName(parts[1]).unionByName(parts[2])}


def improvements(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how density, mean degree and size changed from one graph to the other; infinite from nothing."""
    a, b = g.quality(before).select("density", "mean_degree", "n_triples").toDF("d0", "m0", "n0"), g.quality(after).select("density", "mean_degree", "n_triples").toDF("d1", "m1", "n1")
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(F.lit(float("inf")))
    return a.crossJoin(b).select(ratio(F.col("d1"), F.col("d0")).alias("density_ratio"), ratio(F.col("m1"), F.col("m0")).alias("degree_ratio"), ratio(F.col("n1"), F.col("n0")).alias("size_ratio"))


class Steps:
    """A chain of steps with their results in a folder. A step is skipped if it ended before with the same inputs and parameters and its
    result is there; a step that runs makes all later ones run again."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log: list[tuple[str, bool, int]] = []
        self._rerun = False
        self._before = ""

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _fingerprint(self, path: str) -> list[tuple[str, int, int]]:
        """Name, length and time of each file of an input."""
        fs, where = self._fs(path)
        if not fs.exists(where):
            return []
        files, out = fs.listFiles(where, True), []
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return sorted(out)

    def _mark(self, name: str) -> str | None:
        fs, where = self._fs(f"{self.folder}/{name}.done")
        return self.spark.read.text(f"{self.folder}/{name}.done").first()[0] if fs.exists(where) else None

    def run(self, name: str, f: Callable[[], DataFrame], inputs: list[str] = (), params: dict | None = None) -> DataFrame:
        """The result of ``f``, from an earlier run if that still holds. An action."""
        what = json.dumps([name, self._before, [self._fingerprint(p) for p in inputs], params or {}], sort_keys=True, default=str)
        key = hashlib.md5(what.encode()).hexdigest()
        self._before = key
        path = f"{self.folder}/{name}"
        fs, where = self._fs(f"{path}/_SUCCESS")
        skip = not self._rerun and self._mark(name) == key and fs.exists(where)
        if not skip:
            self._rerun = True
            f().write.mode("overwrite").parquet(path)
            self.spark.createDataFrame([(key,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.done")
        out = self.spark.read.parquet(path)
        self.log.append((name, skip, out.count()))
        return out

    def report(self) -> DataFrame:
        """``(place, step, skipped, n_rows)`` of the steps so far."""
        return self.spark.createDataFrame([(i, *r) for i, r in enumerate(self.log)], "place int, step string, skipped boolean, n_rows long")
