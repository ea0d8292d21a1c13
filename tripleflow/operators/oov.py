"""Entities without a vector: how bad it is, what to do, and vectors to stand in for theirs.

Defined results: null labels are no entities; where no entity has a vector there is none to stand in; ties between candidates go to the
greater label. Stand-ins carry no noise: the same input gives the same vector.

Candidates are exact, though few pairs are compared letter by letter. Labels with the same first or last four characters meet by a join; what they leave of
the ``k`` places to be beaten decides which other labels, by length and kind, can come in at all. A pair's matching stretches are at most its longest common
subsequence, which is found for whole columns of labels at once by bits; only pairs that may still enter are compared. Where few unknown labels
share an end with any known one, the time of the second step grows with the product of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .embed import doubles, mean_vectors, oov_kind

# The weights of the experts by strategy, and what the quality of the data leaves of a confidence.
EXPERTS = {
    "base": {"symbolic": 0.4, "hybrid": 0.35, "neural": 0.25},
    "high_oov": {"symbolic": 0.6, "hybrid": 0.2, "neural": 0.2},
    "few_rules": {"symbolic": 0.2, "hybrid": 0.5, "neural": 0.3},
    "balanced": {"symbolic": 0.33, "hybrid": 0.34, "neural": 0.33},
}
QUALITY = {"excellent": 1.0, "good": 0.95, "fair": 0.85, "poor": 0.7}
#: Unknown labels that are sent to the executors at a time.
AT_ONCE = 2000
#: Labels of a group with the same end that meet those of another at a time: unknown and known ones.
UNKNOWN_OF_END, KNOWN_OF_END = 500, 20_000


def complexity(n_relations: Column, n_triples: Column, n_entities: Column, n_kinds: Column) -> Column:
    """From 0 to about 1: relations of 20, triples per entity of 5, and kinds of 5, averaged."""
    return (F.least(n_relations / 20, F.lit(1.0)) + F.least(n_triples / F.greatest(n_entities, F.lit(1)) / 5, F.lit(1.0)) + n_kinds / 5) / 3


def strategy(oov_ratio: Column, n_triples: Column, complexity: Column) -> Column:
    return F.when(oov_ratio > 0.8, "high_oov").when(n_triples < 50, "few_rules").when(complexity > 0.7, "balanced").otherwise("base")


def data_quality(oov_ratio: Column, complexity: Column) -> Column:
    return F.when((oov_ratio < 0.2) & (complexity > 0.5), "excellent").when((oov_ratio < 0.5) & (complexity > 0.3), "good").when(oov_ratio < 0.8, "fair").otherwise("poor")


def quality_by(t: DataFrame, entities: DataFrame, by: str) -> DataFrame:
    """Per group ``by`` of triples: triples, relations, entities, kinds of labels, the share of unknown entities, and what follows from them."""
    labels = t.select(by, F.explode(F.array("s", "o")).alias("label")).where(F.col("label").isNotNull()).distinct()
    known = entities.select("label", F.lit(1).alias("hit")).distinct()
    e = labels.join(known, "label", "left").groupBy(by).agg(F.count(F.lit(1)).alias("n_entities"), F.countDistinct(oov_kind(F.col("label"))).alias("n_kinds"), F.avg(F.col("hit").isNull().cast("double")).alias("oov_ratio"))
    r = t.groupBy(by).agg(F.count(F.lit(1)).alias("n_triples"), F.countDistinct("p").alias("n_relations"))
    j = r.join(e, by).withColumn("complexity", complexity(F.col("n_relations"), F.col("n_triples"), F.col("n_entities"), F.col("n_kinds")))
    return j.withColumns({"strategy": strategy(F.col("oov_ratio"), F.col("n_triples"), F.col("complexity")), "quality": data_quality(F.col("oov_ratio"), F.col("complexity"))})


def expert_weights(rows: DataFrame, strategy: str, violations: str, coverage: str) -> DataFrame:
    """``rows`` with the weights ``w_symbolic``, ``w_hybrid`` and ``w_neural``: those of the strategy, moved by rules violated (more than 5, or
    none) and by a symbolic coverage below 0.3, of a sum of 1. An unknown strategy has null weights."""
    base = {x: F.coalesce(*(F.when(F.col(strategy) == s, F.lit(w[x])) for s, w in EXPERTS.items())) for x in ("symbolic", "hybrid", "neural")}
    many, none, thin = F.col(violations) > 5, F.col(violations) == 0, F.col(coverage) < 0.3
    moved = {
        "symbolic": base["symbolic"] * F.when(many, 1.2).when(none, 0.8).otherwise(1.0) * F.when(thin, 0.8).otherwise(1.0),
        "hybrid": base["hybrid"] * F.when(many, 0.9).when(none, 1.1).otherwise(1.0),
        "neural": base["neural"] * F.when(thin, 1.2).otherwise(1.0),
    }
    total = moved["symbolic"] + moved["hybrid"] + moved["neural"]
    return rows.withColumns({f"w_{x}": c / total for x, c in moved.items()})


def adjusted_confidence(confidence: Column, quality: Column, oov_ratio: Column, agreement: Column) -> Column:
    """A confidence after the quality of its input, the share of unknown entities and the agreement of the experts, from 0.1 to 0.99."""
    factor = F.coalesce(*(F.when(quality == q, F.lit(v)) for q, v in QUALITY.items()), F.lit(QUALITY["poor"]))
    c = confidence * factor * F.when(oov_ratio > 0.6, 1 - (oov_ratio - 0.6)).otherwise(1.0) * F.when(agreement < 0.5, 0.8).when(agreement > 0.8, 1.1).otherwise(1.0)
    return F.least(F.greatest(c, F.lit(0.1)), F.lit(0.99))


def _kind(s: str) -> str:
    import re

    if re.fullmatch("[0-9A-Za-z]{32}", s):
        return "uuid"
    if "T" in s and re.search(r"(Z|[+-]\d{2}:\d{2})$", s):
        return "date"
    return "number" if re.fullmatch("[0-9]+", s) else "code" if re.fullmatch("[A-Z0-9_]+", s) else "text"


def _kind_column(label: Column) -> Column:
    """``_kind`` of a column."""
    return (
        F.when(label.rlike(r"\A[0-9A-Za-z]{32}\z"), "uuid").when(label.contains("T") & label.rlike(r"(Z|[+-]\p{Nd}{2}:\p{Nd}{2})\n?\z"), "date")
        .when(label.rlike(r"\A[0-9]+\z"), "number").when(label.rlike(r"\A[A-Z0-9_]+\z"), "code").otherwise("text")
    )


def alike(a: str, b: str, least: float = 0.0) -> float:
    """How alike a known label b is to a: fifths for the length, the first and the last four characters, the kind, and the matching stretches;
    a value below ``least`` may be too low."""
    score = 0.2 * (1 - abs(len(b) - len(a)) / max(1, len(a))) + 0.2 * b.startswith(a[:4]) + 0.2 * b.endswith(a[-4:]) + 0.2 * (_kind(a) == _kind(b))
    return score + 0.2 * SequenceMatcher(None, a, b).ratio() if score + 0.2 >= least else score


class _Labels:
    """Known labels as columns: the bound of how alike they are to another, for all at once."""

    def __init__(self, labels: list[str]) -> None:
        self.labels = labels
        self.length = np.array([len(b) for b in labels], np.int64)
        self.kind = np.array([_kind(b) for b in labels])
        wide = int(self.length.max(initial=0))
        flat = np.zeros((len(labels), wide), np.uint32)
        letters = np.frombuffer("".join(labels).encode("utf-32-le", "surrogatepass"), np.uint32)
        flat[np.arange(wide)[None, :] < self.length[:, None]] = letters + 1  # 0 is beyond the end
        self.alphabet, code = np.unique(flat, return_inverse=True)
        self.code = np.ascontiguousarray(code.reshape(flat.shape).T.astype(np.uint32))

    def common(self, a: str, at: np.ndarray) -> np.ndarray:
        """The length of the longest common subsequence with ``a``, or more: the sum over stretches of ``a`` of 63 letters."""
        out = np.zeros(len(at), np.int64)
        code = self.code[: int(self.length[at].max(initial=0)), at]
        for lo in range(0, len(a), 63):
            part = a[lo : lo + 63]
            bits: dict[int, int] = {}
            for i, c in enumerate(part):
                bits[ord(c) + 1] = bits.get(ord(c) + 1, 0) | 1 << i
            masks = np.array([bits.get(c, 0) for c in self.alphabet.tolist()], np.uint64)
            v = np.full(len(at), np.uint64(2**64 - 1))
            for row in code:  # the bits of v that are 0 are the letters of a matched so far
                u = v & masks[row]
                v = (v + u) | (v - u)
            out += np.bitwise_count(~v & np.uint64(2 ** len(part) - 1))
        return out

    def base(self, a: str, at: np.ndarray) -> np.ndarray:
        """``alike`` without the matching stretches, added up in the same order."""
        starts, ends = np.ones(len(at), bool), np.ones(len(at), bool)
        code = {c - 1: i for i, c in enumerate(self.alphabet.tolist())}
        for text, hit, back in ((a[:4], starts, False), (a[-4:], ends, True)):
            hit &= self.length[at] >= len(text)
            for i, c in enumerate(text):
                if ord(c) not in code:
                    hit[:] = False
                    break
                k = np.nonzero(hit)[0]
                row = self.length[at[k]] - len(text) + i if back else np.full(len(k), i)
                hit[k] = self.code[row, at[k]] == code[ord(c)]
        return 0.2 * (1 - np.abs(self.length[at] - len(a)) / max(1, len(a))) + 0.2 * starts + 0.2 * ends + 0.2 * (self.kind[at] == _kind(a))

    def best(self, a: str, k: int, least: float, edge: float, at: np.ndarray | None = None) -> list[tuple[float, str]]:
        """The ``k`` labels (of the places ``at``) most alike to ``a``, above ``least`` and not below ``edge``."""
        at = np.arange(len(self.labels)) if at is None else at
        base = self.base(a, at)
        both = np.maximum(self.length[at] + len(a), 1)
        top = lambda n: base + 0.2 * np.where(self.length[at] + len(a) > 0, 2 * n / both, 1.0) + 2e-9
        floor = max(least, edge)
        keep = top(np.minimum(self.length[at], len(a))) >= floor
        at, base, both = at[keep], base[keep], both[keep]
        bound = top(self.common(a, at))
        found: list[tuple[float, str]] = []
        for i in np.argsort(-bound, kind="stable").tolist():
            if bound[i] < max(floor, found[-1][0] if len(found) == k else floor):
                break
            b = self.labels[at[i]]
            score = round(alike(a, b), 9)
            if score > least and score >= edge and (len(found) < k or (score, b) > found[-1]):
                found = sorted([*found, (score, b)], reverse=True)[:k]
        return found


def _rows(got: list[tuple[str, float, str]]) -> pa.RecordBatch:
    """``(label, candidate, score)`` of (label, score, candidate)."""
    return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["label", "candidate", "score"])


_FOUND = "label string, candidate string, score double"


def _ends(labels: DataFrame, most: int, name: str) -> DataFrame:
    """``(end, part_<name>, <name>)``: lists of labels with the same first or last four characters, each of about ``most`` at most."""
    four = F.length("label") >= 4
    ends = F.array(F.struct(F.lit("first").alias("side"), F.substring("label", 1, 4).alias("text")), F.struct(F.lit("last").alias("side"), F.expr("right(label, 4)").alias("text")))
    e = labels.where(four).select("label", F.explode(ends).alias("end"))
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("end")) / most)
    e = e.withColumn(f"part_{name}", F.pmod(F.xxhash64("label"), parts))
    return e.groupBy("end", f"part_{name}").agg(F.sort_array(F.collect_list("label")).alias(name))


def candidates(unknown: DataFrame, known: DataFrame, k: int = 3, least: float = 0.5) -> DataFrame:
    """``(label, candidate, place, score)``: of each unknown label the ``k`` known labels most alike, above ``least``. First those with the same ends; then
    the unknown labels that others may still reach go to the executors in lots of AT_ONCE. An action."""
    spark = unknown.sparkSession
    asked = written(unknown.select("label").where(F.col("label").isNotNull()).distinct(), "unknown")
    have = written(known.select("label").where(F.col("label").isNotNull()).distinct(), "known")
    order = Window.partitionBy("label").orderBy(F.col("score").desc(), F.col("candidate").desc())

    def by_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                labels = _Labels(batch.column(1)[r].as_py())
                yield _rows([(a, *x) for a in batch.column(0)[r].as_py() for x in labels.best(a, k, least, least)])

    met = _ends(asked, UNKNOWN_OF_END, "u").join(_ends(have, KNOWN_OF_END, "h"), "end").select("u", "h")
    near = met.repartition(2 * spark.sparkContext.defaultParallelism, F.xxhash64("u", "h")).mapInArrow(by_end, _FOUND).distinct()
    near = written(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place"), "near")

    # what a label without a common end must reach, and those it may come from
    edges = near.groupBy("label").agg(F.min("score").alias("edge"), F.count(F.lit(1)).alias("n")).select("label", F.when(F.col("n") >= k, F.col("edge")).otherwise(F.lit(least)).alias("edge"))
    open_ = asked.join(edges, "label", "left").withColumn("edge", F.coalesce("edge", F.lit(least)))
    n, m = F.length("label"), F.col("length")
    classes = have.select(F.length("label").alias("length"), _kind_column(F.col("label")).alias("kind")).distinct()
    # labels of less than four characters met none
    reach = 0.2 * (1 - F.abs(m - n) / F.greatest(n, F.lit(1))) + 0.2 * (F.col("kind") == F.col("own")).cast("double") + F.when(n < 4, 0.4).otherwise(0.0) + 0.2 * F.coalesce(F.try_divide(2 * F.least(m, n), m + n), F.lit(1.0)) + 2e-9
    met = open_.withColumn("own", _kind_column(F.col("label"))).crossJoin(F.broadcast(classes)).where((reach >= F.col("edge")) & (reach > least))
    open_ = written(met.groupBy("label", "edge").agg(F.sort_array(F.collect_set(F.struct("length", "kind"))).alias("classes")), "open")
    out, lots = near, -(-open_.count() // AT_ONCE)
    for lot in range(lots):
        held = [(r.label, r.edge, [tuple(c) for c in r.classes]) for r in open_.where(F.pmod(F.xxhash64("label"), F.lit(lots)) == lot).collect()]
        sent = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                by_class: dict[tuple[int, str], list[str]] = {}
                for b, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    by_class.setdefault((len(b), kind), []).append(b)
                ready = {c: _Labels(x) for c, x in by_class.items()}
                got = []
                for a, edge, wanted in sent.value:
                    mine = [x for c in wanted if c in ready for x in ready[c].best(a, k, least, edge)]
                    got += [(a, *x) for x in sorted(mine, reverse=True)[:k]]
                yield _rows(got)

        out = out.unionByName(have.select("label", _kind_column(F.col("label")).alias("kind")).mapInArrow(run, _FOUND))
    return out.distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("label", "candidate", "place", "score")


def stand_ins(unknown: DataFrame, entities: DataFrame, how: str = "similar", width: int | None = None) -> DataFrame:
    """``(label, v)`` of unknown labels, from the entities (label, v): ``zero``, ``mean`` of all, ``kind``: mean of those of the same kind, else of
    all, ``similar``: the candidates' mean with weights 1 to 0.7, else the mean of all. An action for ``similar``."""
    e = entities.select("label", doubles(F.col("v")).alias("v"))
    asked = unknown.select("label").where(F.col("label").isNotNull()).distinct()
    if how == "zero":
        n = F.lit(width) if width else e.agg(F.max(F.size("v"))).first()[0]
        return asked.select("label", F.array_repeat(F.lit(0.0), n).alias("v"))
    overall = mean_vectors(e.withColumn("k", F.lit(1)), "k", "v").select(F.col("v").alias("mean"))
    asked = asked.crossJoin(F.broadcast(overall))
    if how == "mean":
        return asked.select("label", F.col("mean").alias("v"))
    if how == "kind":
        own = mean_vectors(e.withColumn("kind", oov_kind(F.col("label"))), "kind", "v")
        return asked.withColumn("kind", oov_kind(F.col("label"))).join(own, "kind", "left").select("label", F.coalesce("v", "mean").alias("v"))
    near = candidates(unknown, e).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("label")))
    weight = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(1 - F.lit(0.3) * (F.col("place") - 1) / (F.col("n") - 1))
    parts = near.withColumn("w", weight).join(e.withColumnRenamed("label", "candidate"), "candidate").select("label", "w", F.posexplode("v").alias("i", "x"))
    one = parts.groupBy("label", "i").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    own = one.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    return asked.join(own, "label", "left").select("label", F.coalesce("v", "mean").alias("v"))


def squashed(score: Column) -> Column:
    """A score by the logistic function, from 0.1 to 0.9; null is 0.5."""
    return F.coalesce(0.8 / (1 + F.exp(-score)) + 0.1, F.lit(0.5))


def meta_features(h: Column, r: Column, t: Column, width: int = 0) -> Column:
    """Eleven numbers of the labels of a triple: hashes, lengths, common characters, digits, prefixes; with ``width`` hashes up to that many."""
    share = lambda c, n: (F.pmod(F.xxhash64(c), F.lit(n)) / n).cast("double")
    chars = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    own = F.array(
        share(h, 100), share(t, 100), share(r, 50), F.length(h) / 50.0, F.length(t) / 50.0, F.length(r) / 30.0,
        F.size(F.array_intersect(chars(h), chars(t))) / F.greatest(F.length(h), F.length(t), F.lit(1)).cast("double"),
        h.rlike("^[0-9]+$").cast("double"), t.rlike("^[0-9]+$").cast("double"), r.startswith("has").cast("double"), r.startswith("is").cast("double"),
    )
    if width <= 11:
        return own
    return F.concat(own, F.transform(F.sequence(F.lit(0), F.lit(width - 12)), lambda i: (F.pmod(F.xxhash64(h, r, t, i), F.lit(1000)) / 1000).cast("double")))
