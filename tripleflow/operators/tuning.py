"""Searches for parameters and comparisons of models: driver-side loops over distributed training, with a row per trial.

Defined results: trials are in order; one that raises is a row with its error and no value, and the others go on; a search without a value has no best trial.
"""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written

RUNS = "trial int, params string, value double, state string, error string"


def grid(space: dict[str, list]) -> list[dict[str, Any]]:
    """All settings of a space, the last parameter changing fastest."""
    return [dict(zip(space, values)) for values in itertools.product(*space.values())]


def sampled(space: dict[str, list | tuple], n: int, seed: int = 42) -> list[dict[str, Any]]:
    """``n`` settings by a seeded generator: of a list one element, of a pair (low, high) a number between."""
    dice = random.Random(seed)
    draw = lambda of: dice.choice(of) if isinstance(of, list) else dice.randint(*of) if all(isinstance(x, int) for x in of) else dice.uniform(*of)
    return [{name: draw(of) for name, of in space.items()} for _ in range(n)]


def search(spark: SparkSession, objective: Callable[..., float], settings: list[dict[str, Any]], done: DataFrame | None = None) -> DataFrame:
    """RUNS of the objective over settings. ``done``: the runs of an earlier search, whose settings aren't tried again. An action."""
    seen = {r.params: r for r in done.collect()} if done is not None else {}
    rows = []
    for k, setting in enumerate(settings):
        text = json.dumps(setting, sort_keys=True)
        if text in seen and seen[text].state == "COMPLETE":
            rows.append((k, text, seen[text].value, "COMPLETE", None))
            continue
        try:
            rows.append((k, text, float(objective(**setting)), "COMPLETE", None))
        except Exception as e:  # noqa: BLE001
            rows.append((k, text, None, "FAIL", f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, RUNS)


def best(runs: DataFrame, maximize: bool = True) -> dict[str, Any] | None:
    """The setting of the best value, of equals the first. An action."""
    value = F.col("value") if maximize else -F.col("value")
    got = runs.where(F.col("value").isNotNull()).orderBy(value.desc(), "trial").limit(1).collect()
    return json.loads(got[0].params) if got else None


def compared(spark: SparkSession, models: dict[str, Callable[[], DataFrame]], evaluate: Callable[[DataFrame], DataFrame], value: str) -> DataFrame:
    """``(name, value, error)`` of the models by falling value: each gives scored rows, which ``evaluate`` turns into one row with the column ``value``. An action."""
    rows = []
    for name, scores in models.items():
        try:
            rows.append((name, float(evaluate(scores()).first()[value]), None))
        except Exception as e:  # noqa: BLE001
            rows.append((name, None, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, f"name string, {value} double, error string").orderBy(F.col(value).desc_nulls_last(), "name")


def save_model(vectors: DataFrame, entities: DataFrame, relations: DataFrame, path: str, settings: dict[str, Any] | None = None) -> None:
    """Vectors (kind, id, v) with their labels, and the settings they were trained with. An action."""
    labels = entities.select(F.lit("entity").alias("kind"), "id", "label").unionByName(relations.select(F.lit("relation").alias("kind"), "id", "label"))
    vectors.join(labels, ["kind", "id"], "left").write.mode("overwrite").parquet(f"{path}/vectors")
    vectors.sparkSession.createDataFrame([(json.dumps(settings or {}, sort_keys=True),)], "settings string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, Any]]:
    """``entities`` and ``relations`` (id, label, v), and the settings."""
    v = spark.read.parquet(f"{path}/vectors")
    of = lambda kind: v.where(F.col("kind") == kind).select("id", "label", "v")
    return of("entity"), of("relation"), json.loads(spark.read.text(f"{path}/settings").first()[0])


def ingested(kept_docs: DataFrame, kept_triples: DataFrame, new_docs: DataFrame, key: str, order: list[str], doc_id: str, data: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents put into a store, then their triples: ``(documents, triples, counts)``.

    Documents are kept once per ``key``, the last in ``order``; triples (s, p, o, confidence) once, those of the new documents with confidence 1. An action."""
    from .relational import upsert_greatest, upsert_latest
    from .triples import json_to_triples

    docs = written(upsert_latest(kept_docs, new_docs, key, order), "documents")
    flat = json_to_triples(new_docs, doc_id, data).where("s is not null and p is not null and o is not null")
    fresh = flat.select(F.concat_ws("/", F.col("doc_id").cast("string"), "s").alias("s"), "p", "o", F.lit(1.0).alias("confidence"))
    triples = written(upsert_greatest(kept_triples, fresh), "triples")
    count = lambda df, name: df.agg(F.lit(name).alias("tab"), F.count(F.lit(1)).alias("n"))
    return docs, triples, count(docs, "documents").unionByName(count(triples, "triples"))


def overridden(base: dict[str, Any], changes: dict[str, Any]) -> dict[str, Any]:
    """``base`` with the members of ``changes``, objects member by member; neither is changed."""
    out = dict(base)
    for k, v in changes.items():
        out[k] = overridden(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
