"""Exact ranking, classification and calibration metrics. Curves over a whole table use running sums by ranges, not one sorted task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running


def _r(c: Column, name: str) -> Column:
    return F.round(c, 9).alias(name)


def mrr_hits(scores: DataFrame, query: list[str], score: str, cand: str, true: str, k: int = 10) -> DataFrame:
    """One row: over the true candidates, the mean of 1 / rank and the shares within 1, 3 and ``k``; ranks are ordinal within the query.
    ``n_queries`` counts all queries. Without a true candidate the metrics are 0 and ``n_queries`` is the number of rows."""
    ranks = scores.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(F.col(score).desc(), cand)))
    hit = F.col(true) == 1
    mean = lambda c, name: _r(F.coalesce(F.avg(F.when(hit, c)), F.lit(0.0)), name)
    return ranks.agg(
        F.count_if(hit).alias("n_true"), F.when(F.count_if(hit) > 0, F.countDistinct(*query)).otherwise(F.count(F.lit(1))).alias("n_queries"), mean(1 / F.col("rank"), "mrr"),
        *(mean((F.col("rank") <= n).cast("double"), f"hits_{n}") for n in sorted({1, 3, k})),
    )


def single_query(scores: DataFrame, score: str, tie: str, label: str, k: int = 10) -> DataFrame:
    """One row, the whole table as one query: 1 / place of the first positive, and whether one is among the first ``k``."""
    n = running(scores.select((-F.col(score)).alias("neg"), tie, F.col(label).alias("label"), F.lit(1).alias("one")), ["neg", tie], {"place": "one"})
    return n.agg(_r(F.coalesce(1 / F.min(F.when(F.col("label") == 1, F.col("place"))), F.lit(0.0)), "mrr"), F.coalesce(F.max(F.when(F.col("place") <= k, F.col("label"))), F.lit(0)).cast("double").alias("hits"))


def curve(scores: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score, from high to low: true and false positives at it and above, and at it alone."""
    per = scores.groupBy((-F.col(score)).alias("neg")).agg(F.sum(label).cast("double").alias("pos"), F.sum(1 - F.col(label)).cast("double").alias("negs"))
    return running(per, ["neg"], {"tp": "pos", "fp": "negs"})


def roc_auc(scores: DataFrame, score: str, label: str) -> DataFrame:
    """One row ``roc_auc``, ties counted half; 0.5 if there is one class only."""
    c = curve(scores, score, label)
    won = F.sum(F.col("negs") * (F.col("tp") - F.col("pos") / 2))
    return c.agg(_r(F.coalesce(won / F.nullif(F.sum("pos") * F.sum("negs"), F.lit(0.0)), F.lit(0.5)), "roc_auc"))


def average_precision(scores: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the sum over distinct scores of the step in recall times precision."""
    c = curve(scores, score, label)
    return c.agg(_r(F.coalesce(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.nullif(F.sum("pos"), F.lit(0.0)), F.lit(0.0)), "average_precision"))


def best_threshold(scores: DataFrame, score: str, label: str, metric: str = "f1", min_precision: float = 0.0, min_recall: float = 0.0) -> DataFrame:
    """One row: the score whose use as threshold is best by f1, precision, recall or balanced accuracy under the constraints; the higher of equals."""
    c = curve(scores, score, label)
    total = c.agg(F.sum("pos").alias("p"), F.sum("negs").alias("n"))
    j = c.crossJoin(F.broadcast(total)).withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.col("tp") / F.greatest("p", F.lit(1.0))})
    value = {
        "f1": 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + 1e-8), "precision": F.col("precision"), "recall": F.col("recall"),
        "balanced_accuracy": (F.col("recall") + 1 - F.col("fp") / F.greatest("n", F.lit(1.0))) / 2,
    }[metric]
    ok = j.where((F.col("precision") >= min_precision) & (F.col("recall") >= min_recall)).withColumn("value", F.round(value, 9)).withColumn("threshold", -F.col("neg"))
    best = ok.agg(F.max_by(F.struct("threshold", "value", "precision", "recall"), F.struct("value", "threshold")).alias("b"))
    return best.select("b.threshold", "b.value", _r(F.col("b.precision"), "precision"), _r(F.col("b.recall"), "recall"))


def ndcg(scores: DataFrame, query: list[str], score: str, tie: str, label: str, k: int = 10) -> DataFrame:
    """One row: the mean over queries with a positive of DCG at ``k`` over the ideal one."""
    w = Window.partitionBy(*query)
    placed = scores.withColumn("place", F.row_number().over(w.orderBy(F.col(score).desc(), tie))).withColumn("ideal", F.row_number().over(w.orderBy(F.col(label).desc(), tie)))
    gain = lambda place: F.sum(F.when(F.col(place) <= k, F.col(label) / F.log2(F.col(place) + 1)).otherwise(0.0))
    per = placed.groupBy(*query).agg(gain("place").alias("dcg"), gain("ideal").alias("best")).where("best > 0")
    return per.agg(F.count(F.lit(1)).alias("n_queries"), _r(F.avg(F.col("dcg") / F.col("best")), "ndcg"))


def confusion(scores: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """One row: the four counts, accuracy, precision, recall and f1 at a threshold."""
    hit, y = F.col(score) >= threshold, F.col(label) == 1
    c = scores.agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count_if(~hit & ~y).alias("tn"))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("*", _r(share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), "accuracy"), _r(p, "precision"), _r(r, "recall"), _r(F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)), "f1"))


def class_stats(scores: DataFrame, score: str, label: str, threshold: float = 0.5) -> DataFrame:
    """Per class count, mean, population deviation, least and largest score, and accuracy at a threshold."""
    right = (F.col(score) >= threshold).cast("int") == F.col(label)
    return scores.groupBy(label).agg(F.count(F.lit(1)).alias("n"), _r(F.avg(score), "mean"), _r(F.stddev_pop(score), "std"), F.min(score).alias("low"), F.max(score).alias("high"), _r(F.avg(right.cast("double")), "accuracy"))


def exact_quantiles(scores: DataFrame, score: str, shares: tuple[float, ...]) -> DataFrame:
    """One row ``q``: the exact quantiles, interpolated between neighbours, from running counts over the distinct scores: no task holds them all."""
    per = scores.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("x")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    c = running(per, ["x"], {"upto": "n"})
    total = c.agg(F.sum("n").alias("all"))
    j = c.crossJoin(F.broadcast(total))
    picked = []
    for i, share in enumerate(shares):
        at = F.lit(share) * (F.col("all") - 1)
        lo, hi = F.floor(at), F.ceil(at)
        holds = lambda k: (k < F.col("upto")) & (k >= F.col("upto") - F.col("n"))
        picked += [F.max(F.when(holds(lo), F.col("x"))).alias(f"lo{i}"), F.max(F.when(holds(hi), F.col("x"))).alias(f"hi{i}"), F.max(at - lo).alias(f"f{i}")]
    one = j.agg(*picked)
    return one.select(F.array(*(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"f{i}") for i in range(len(shares)))).alias("q"))


def quartile_stats(scores: DataFrame, score: str, label: str) -> DataFrame:
    """Per quartile of the score, both ends included (so a score on an edge is in two): count and share of positives; edges 0 and 1."""
    q = exact_quantiles(scores, score, (0.25, 0.5, 0.75))
    edges = F.concat(F.array(F.lit(0.0)), F.col("q"), F.array(F.lit(1.0)))
    spans = q.select(F.posexplode(F.arrays_zip(F.slice(edges, 1, 4).alias("lo"), F.slice(edges, 2, 4).alias("hi"))).alias("quartile", "e")).select(F.col("quartile") + 1, "e.*").toDF("quartile", "lo", "hi")
    hits = scores.join(F.broadcast(spans), (F.col(score) >= F.col("lo")) & (F.col(score) <= F.col("hi")))
    return hits.groupBy("quartile").agg(F.count(F.lit(1)).alias("n"), _r(F.avg(F.col(label).cast("double")), "positive_share"))


def improvement(results: DataFrame, name: str, value: str, baseline: str) -> DataFrame:
    """Each result against the one called ``baseline``: percent, and its place. The results are a handful of rows."""
    base = results.where(F.col(name) == baseline).agg(F.first(value).alias("base"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col(value).desc(), name))
    return results.crossJoin(F.broadcast(base)).select(name, value, _r((F.col(value) - F.col("base")) / F.col("base") * 100, "percent"), place.alias("place"))


def platt(scores: DataFrame, score: str, label: str, folds: int = 5, key: str | None = None) -> DataFrame:
    """``scores`` with ``calibrated``: a logistic function of the score, for each fold fitted on the others. Fits: an action."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    x = scores.withColumn("__s", F.col(score).cast("double")).withColumn("__y", F.col(label).cast("double")).withColumn("__fold", F.pmod(F.xxhash64(key or score), F.lit(folds)))
    data = VectorAssembler(inputCols=["__s"], outputCol="__x").transform(x)
    out = None
    for k in range(folds):
        model = LogisticRegression(featuresCol="__x", labelCol="__y", probabilityCol="__p", regParam=0.0).fit(data.where(F.col("__fold") != k))
        part = model.transform(data.where(F.col("__fold") == k)).withColumn("calibrated", vector_to_array("__p")[1]).select(*scores.columns, "calibrated")
        out = part if out is None else out.unionByName(part)
    return out


def isotonic(scores: DataFrame, score: str, label: str) -> DataFrame:
    """``scores`` with ``calibrated`` by isotonic regression, clipped to its range. Fits: an action."""
    from pyspark.ml.regression import IsotonicRegression

    data = scores.withColumn("__y", F.col(label).cast("double")).withColumn("__x", F.col(score).cast("double"))
    return IsotonicRegression(featuresCol="__x", labelCol="__y", predictionCol="calibrated").fit(data).transform(data).drop("__y", "__x")


def all_metrics(scores: DataFrame, score: str, tie: str, label: str) -> DataFrame:
    """One row, the whole table as one query: mrr, hits at 1, 3 and 10, areas under both curves, ndcg at 10 and accuracy above 0.5. With one class
    only, the areas are 0.5 and the share of positives."""
    firsts = single_query(scores, score, tie, label, 1).select("mrr", F.col("hits").alias("hits_1"))
    for k in (3, 10):
        firsts = firsts.crossJoin(single_query(scores, score, tie, label, k).select(F.col("hits").alias(f"hits_{k}")))
    y = F.col(label).cast("double")
    shares = scores.agg(_r(F.avg(((F.col(score) > 0.5).cast("int") == F.col(label)).cast("double")), "accuracy"), F.avg(y).alias("__share"), F.countDistinct(label).alias("__classes"))
    gain = ndcg(scores.withColumn("__q", F.lit(1)), ["__q"], score, tie, label).select(F.coalesce("ndcg", F.lit(0.0)).alias("ndcg_10"))
    j = firsts.crossJoin(roc_auc(scores, score, label)).crossJoin(average_precision(scores, score, label)).crossJoin(gain).crossJoin(shares)
    return j.withColumn("average_precision", F.when(F.col("__classes") > 1, F.col("average_precision")).otherwise(F.round("__share", 9))).drop("__share", "__classes")


def trials(runs: DataFrame, value: str, state: str) -> DataFrame:
    """One row over the trials of a search: how many there are, ended and failed, the best value, and the mean and sample deviation of all values."""
    return runs.agg(
        F.count(F.lit(1)).alias("n_trials"), F.count_if(F.col(state) == "COMPLETE").alias("n_complete"), F.count_if(F.col(state) == "FAIL").alias("n_failed"), F.max(value).alias("best"),
        _r(F.coalesce(F.avg(value), F.lit(0.0)), "mean"), _r(F.coalesce(F.stddev_samp(value), F.lit(0.0)), "std"),
    )


def patience(losses: DataFrame, by: list[str], epoch: str, loss: str, most: int, least_gain: float = 0.0) -> DataFrame:
    """``losses`` with ``best`` (the least loss up to an epoch), ``waited`` (epochs since it fell by more than ``least_gain``) and ``stopped`` (whether training has ended by then)."""
    w = Window.partitionBy(*by).orderBy(epoch)
    before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = before.isNull() | (F.col(loss) < before - least_gain)
    placed = losses.withColumns({"best": F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__n": F.row_number().over(w), "__better": better})
    since = F.max(F.when(F.col("__better"), F.col("__n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    waited = placed.withColumn("waited", (F.col("__n") - since).cast("int"))
    stop = F.max((F.col("waited") >= most).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return waited.withColumn("stopped", stop).drop("__n", "__better")


def raw_rank(scores: DataFrame, query: list[str], score: str, true: str) -> DataFrame:
    """``(query, rank)``: one more than the candidates that score above the best true one of each query; queries without a true one have none."""
    own = scores.where(F.col(true) == 1).groupBy(*query).agg(F.max(score).alias("__t"))
    return scores.join(own, query).groupBy(*query).agg((F.count_if(F.col(score) > F.col("__t")) + 1).alias("rank"))


def spread(df: DataFrame, rows: list[str], columns: str, names: list, value: str) -> DataFrame:
    """A row per ``rows`` with a column for each of ``names``: the first value there."""
    return df.groupBy(*rows).pivot(columns, names).agg(F.first(value, ignorenulls=True))


def experiments(runs: DataFrame, metric: str, start: str, end: str) -> DataFrame:
    """Runs with a metric by falling metric, with their duration in minutes and place; nulls drop out."""
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col(metric).desc(), start))
    minutes = F.round((F.col(end).cast("double") - F.col(start).cast("double")) / 60, 6)
    return runs.where(F.col(metric).isNotNull()).withColumns({"minutes": minutes, "place": place})


def balance(importances: DataFrame, order: str, value: str) -> DataFrame:
    """One row: the shares of the first feature (hybrid) and of the others (symbolic), and whether that is balanced, partly, or not."""
    first = F.min_by(value, order)
    parts = importances.agg(first.alias("h"), (F.sum(value) - first).alias("s"))
    total = F.nullif(F.col("h") + F.col("s"), F.lit(0.0))
    shares = parts.select(_r(F.col("h") / total, "hybrid"), _r(F.col("s") / total, "symbolic"))
    return shares.withColumn("verdict", F.when(F.col("symbolic") >= 0.15, "balanced").when(F.col("symbolic") >= 0.05, "partial").when(F.col("symbolic").isNotNull(), "failed"))
