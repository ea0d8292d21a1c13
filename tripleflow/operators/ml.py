"""Models over features of triples: boosted trees, stacking, cross-validation, rules of trees, and features of document structure."""

from __future__ import annotations

import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _assembled(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="keep")


def boosted(features: list[str], label: str, rounds: int = 20, depth: int = 4, seed: int = 42) -> Pipeline:
    """Boosted trees over numeric columns."""
    return Pipeline(stages=[_assembled(features), GBTClassifier(featuresCol="__features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=seed)])


def probability(model: PipelineModel, rows: DataFrame, name: str = "p") -> DataFrame:
    """``rows`` with the chance of class 1."""
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).select(*rows.columns, name)


def stacked(rows: DataFrame, first: list[list[str]], label: str, key: str, folds: int = 3) -> DataFrame:
    """``rows`` with ``p``: a logistic model over the chances that a boosted model gives for each group of columns, all out of fold. Fits: an action."""
    data = rows.withColumn("__fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    names = [f"__p{i}" for i in range(len(first))]
    parts = None
    for k in range(folds):
        rest, own = data.where(F.col("__fold") != k), data.where(F.col("__fold") == k)
        for columns, name in zip(first, names):
            own = probability(boosted(columns, label, rounds=5, depth=3).fit(rest), own, name)
        parts = own if parts is None else parts.unionByName(own)
    final = Pipeline(stages=[_assembled(names), LogisticRegression(featuresCol="__features", labelCol=label, regParam=0.01)]).fit(parts)
    return probability(final, parts).select(*rows.columns, "p")


def cross_validated(rows: DataFrame, features: list[str], label: str, folds: int = 3, seed: int = 42) -> CrossValidatorModel:
    """Grid search over depth by cross-validated area under the ROC curve. Fits: an action."""
    pipeline = boosted(features, label, rounds=5)
    grid = ParamGridBuilder().addGrid(pipeline.getStages()[-1].maxDepth, [2, 4]).build()
    return CrossValidator(estimator=pipeline, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, seed=seed).fit(rows)


_SPLIT = re.compile(r"^(\s*)(If|Else) \(feature (\d+) (<=|>) ([-\d.E]+)\)$")
_LEAF = re.compile(r"^(\s*)Predict: ([-\d.E]+)$")


def tree_rules(model: PipelineModel, features: list[str], least: float = 0.0) -> list[tuple[str, float]]:
    """(text, value) of the paths of the trees of a boosted model to leaves whose value is at least ``least`` in absolute terms:
    ``valid_data(X) <= lessThan(a(X), 0.1000), greaterEqual(b(X), 2.0000)``, or ``invalid_data`` if the value isn't positive. Names of features lose
    blanks and underscores. A tree of one leaf has no path and gives no rule.

    Spark's trees send a value equal to a threshold to the lower side; thresholds lie between the values seen."""
    out, path = [], []
    for line in model.stages[-1].toDebugString.splitlines():
        if m := _SPLIT.match(line):
            path = [p for p in path if p[0] < len(m[1])]
            name = re.sub("[_ ]", "", features[int(m[3])])
            path.append((len(m[1]), f"{'lessThan' if m[4] == '<=' else 'greaterEqual'}({name}(X), {float(m[5]):.4f})"))
        elif (m := _LEAF.match(line)) and abs(float(m[2])) >= least and (conditions := [p[1] for p in path if p[0] < len(m[1])]):
            out.append((f"{'valid_data' if float(m[2]) > 0 else 'invalid_data'}(X) <= " + ", ".join(conditions), float(m[2])))
        elif line.lstrip().startswith("Tree "):
            path = []
    return out


def importances(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """Features by falling importance; equals by name."""
    v = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, v)), key=lambda x: (-x[1], x[0]))


def structure_features(flat: DataFrame) -> DataFrame:
    """A row per document from its leaves (doc_id, p, o, o_type): counts by kind, depths, lengths, and how many leaves are null or dates."""
    depth = F.size(F.split("p", r"[.\[]"))
    n = lambda kind: F.count_if(F.col("o_type") == kind).alias(f"n_{kind}")
    return flat.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_leaves"), *(n(k) for k in ("string", "int", "double", "bool", "null", "json")), F.max(depth).alias("max_depth"), F.round(F.avg(depth), 6).alias("mean_depth"),
        F.coalesce(F.max(F.length("o")), F.lit(0)).alias("max_length"), F.count_if(F.col("o").rlike(r"^\d{4}-\d{2}-\d{2}")).alias("n_dates"), F.count_if(F.col("p").contains("[")).alias("n_in_lists"),
    )
