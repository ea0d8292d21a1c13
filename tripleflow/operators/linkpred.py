"""Link prediction: every entity as the tail (or head) of a pair, exactly, by the distance of translated vectors.

The asked pairs and the entities are packed in blocks of bounded size; each block of pairs meets each block of entities in one task, with the
known facts of the pairs. In a block equal vectors are one, with all their ids, so that a distance is computed once for each two that differ. Of a
cell only counts, or the best ``k`` of each pair, come back, so what is shuffled doesn't grow with the product of pairs and entities. Without equal
vectors the time grows with that product.

Defined results: scores are -|v - e| rounded to DIGITS digits; equals rank by the smaller id; pairs and entities without a vector take
no part (a test fact with such a part has a null rank); repeated facts are ranked once each; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written

#: Different vectors of a block of entities and of one of pairs, digits of a score, and numbers in memory at a time.
ENTITIES, PAIRS, DIGITS, AT_ONCE = 8192, 512, 9, 500_000
#: Numbers of all vectors of a block of entities, and rows of one of pairs, at most about.
NUMBERS, ROWS = 8_000_000, 65_536


def _blocks(rows: DataFrame, key: str, distinct: int, most: int) -> tuple[DataFrame, int]:
    """``rows`` with their ``block``, and the number of blocks: equal vectors are in one block of about ``distinct`` different ones, but those that are more
    than ``most`` are parted by key."""
    sizes = rows.groupBy(F.xxhash64("v").alias("h")).count().agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most"), F.sum("count").alias("rows")).first()
    parts = max(1, math.ceil((sizes["most"] or 0) / most))
    n = max(1, math.ceil(min(sizes["n"] * parts, sizes["rows"] or 0) / distinct), math.ceil((sizes["rows"] or 0) / most))
    return rows.withColumn("block", F.pmod(F.xxhash64("v", F.pmod(F.xxhash64(key), F.lit(parts))), F.lit(n)).cast("int")), n


def _packed(rows: DataFrame, key: str, extra: bool) -> DataFrame:
    """``(block, ids, groups, vectors[, own, truth])``: rows ``(block, key, v[, own, truth])`` by block; ``groups`` is the place of a row's vector in ``vectors``."""
    schema = "block int, ids binary, groups binary, vectors binary" + (", own binary, truth binary" if extra else "")

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by(key).combine_chunks()
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1) + 0.0  # no negative zeros
        rows = np.ascontiguousarray(v).view(np.dtype((np.void, v.shape[1] * 8))).ravel() if v.shape[1] else np.zeros(len(v), np.int64)
        first, group = np.unique(rows, return_index=True, return_inverse=True)[1:]
        parts = [t.column(key).to_numpy(), group.astype(np.int64), v[first]]
        if extra:
            parts += [t.column("own").fill_null(-1).to_numpy(), t.column("truth").fill_null(0.0).to_numpy()]
        names = ["block", "ids", "groups", "vectors", *(["own", "truth"] if extra else [])]
        return pa.table([t.column("block").slice(0, 1), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], names=names)

    return rows.groupBy("block").applyInArrow(pack, schema)


class _Ids:
    """The ids of a block, in order, the column of scores that is of each, how many a column has, and their places by column."""

    def __init__(self, ids: np.ndarray, group: np.ndarray) -> None:
        self.ids, self.group, self.size = ids, group, np.bincount(group)
        self.order = np.lexsort((ids, group))
        self.start = np.cumsum(self.size) - self.size
        self.place = group[self.order] * (len(ids) + 1) + self.order

    def below(self, column: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many ids of each column are before the place ``at`` of all ids."""
        return np.searchsorted(self.place, column * (len(self.ids) + 1) + at) - self.start[column]


def _counted(score: np.ndarray, of: np.ndarray, truth: np.ndarray, own: np.ndarray, e: _Ids) -> np.ndarray:
    """Of each question how many ids score above its truth, or equal with a smaller id: ``score`` has a row per vector asked, ``of`` the row of a question."""
    ids, group, size = e.ids, e.group, e.size.astype(float)
    below, found = np.searchsorted(ids, own), np.zeros(len(of), np.int64)
    there = below < len(ids)
    there[there] = ids[below[there]] == own[there]
    step = max(1, AT_ONCE // max(1, len(size)))
    for lo in range(0, len(of), step):
        mine = score[of[lo : lo + step]]
        t = truth[lo : lo + step, None]
        found[lo : lo + step] = (mine > t).astype(float) @ size
        i, j = np.nonzero(mine == t)
        found[lo : lo + step] += np.bincount(i, e.below(j, below[lo + i]), len(mine)).astype(np.int64)
    k = np.nonzero(there)[0]
    found[k] -= score[of[k], group[below[k]]] > truth[k]  # a question's own answer is no other
    return found


def _best(score: np.ndarray, of: np.ndarray, k: int, hidden: dict[int, set[int]], e: _Ids) -> tuple[list[int], list[int], list[float]]:
    """Of each question the ``k`` best ids that aren't ``hidden`` for it, equals by id: (question, place of the id, score)."""
    ids, size, order, start = e.ids, e.size, e.order, e.start
    asked: list[list[int]] = [[] for _ in range(len(score))]
    for i, r in enumerate(of.tolist()):
        asked[r].append(i)
    out: tuple[list[int], list[int], list[float]] = ([], [], [])
    for row, questions in zip(score, asked):
        if not questions:
            continue
        need = min(len(ids), k + max(len(hidden.get(i, ())) for i in questions))
        # columns of the best scores that have enough ids, and all that are equal to the last
        m = min(len(row), need)
        near = np.argpartition(-row, m - 1)[:m]
        near = near[np.argsort(-row[near], kind="stable")]
        edge = row[near[min(m - 1, int(np.searchsorted(np.cumsum(size[near]), need)))]]
        near = np.nonzero(row >= edge)[0]
        near = near[np.argsort(-row[near], kind="stable")]
        listed: list[int] = []
        scores: list[float] = []
        at = 0
        while at < len(near) and len(listed) < need:
            s, end = row[near[at]], at
            while end < len(near) and row[near[end]] == s:
                end += 1
            got = [order[start[c] : start[c] + min(size[c], need)] for c in near[at:end]]
            same = got[0] if len(got) == 1 else np.sort(np.concatenate(got))
            listed += same[: need - len(listed)].tolist()
            scores += [float(s)] * (len(listed) - len(scores))
            at = end
        for i in questions:
            without, left = hidden.get(i, ()), k
            for c, s in zip(listed, scores):
                if c not in without:
                    out[0].append(i)
                    out[1].append(c)
                    out[2].append(s)
                    left -= 1
                    if not left:
                        break
    return out


def against_all(asked: DataFrame, entities: DataFrame, known: DataFrame | None = None, k: int = 0) -> DataFrame:
    """Each of ``asked`` (q, v, own, truth) against all ``entities`` (id, v), with ``k`` without those ``known`` (q, id).

    With ``k``: ``(q, id, score)``, at least the best ``k`` of every q. Else ``(q, better)``: how many others score above ``truth``, or equal with
    an id below ``own``. An action."""
    asked, entities = written(asked, "asked"), written(entities, "entities")
    width = entities.agg(F.max(F.size("v"))).first()[0] or 1
    (asked, n_q), (entities, n_e) = _blocks(asked, "q", PAIRS, ROWS), _blocks(entities, "id", ENTITIES, max(ENTITIES, NUMBERS // width))
    # written, so that the blocks are as many files and the pairs of blocks as many tasks as there are
    ents = written(_packed(entities, "id", False).repartition(n_e, "block"), "entity_blocks").drop("block").toDF("e_ids", "e_groups", "e_vectors")
    pairs = _packed(asked, "q", True)
    if k:
        lists = known.join(asked.select("q", "block"), "q").groupBy("block").agg(F.collect_set(F.struct("q", "id")).alias("facts"))
        pairs = pairs.join(lists, "block", "left").withColumns({"fq": F.col("facts.q"), "fe": F.col("facts.id")}).drop("facts")
    cells = written(pairs.repartition(n_q, "block"), "pair_blocks").drop("block").crossJoin(ents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {c: i for i, c in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                cell = lambda c: batch.column(at[c])[r].as_py()
                ints = lambda c: np.frombuffer(cell(c), np.int64)
                nums = lambda c: np.frombuffer(cell(c), np.float64)
                q, of, own, truth, e, group = ints("ids"), ints("groups"), ints("own"), nums("truth"), ints("e_ids"), ints("e_groups")
                v, w = nums("vectors").reshape(of.max() + 1, -1), nums("e_vectors").reshape(group.max() + 1, -1)
                by_column = _Ids(e, group)
                hidden: dict[int, set[int]] = {}
                if k:
                    hidden_q, hidden_e = (np.array(cell(c) or [], np.int64) for c in ("fq", "fe"))
                    at_q, at_e = np.searchsorted(q, hidden_q), np.searchsorted(e, hidden_e)
                    ok = (at_q < len(q)) & (at_e < len(e))
                    ok[ok] = (q[at_q[ok]] == hidden_q[ok]) & (e[at_e[ok]] == hidden_e[ok])
                    for i, c in zip(at_q[ok].tolist(), at_e[ok].tolist()):
                        hidden.setdefault(i, set()).add(c)
                turn = np.argsort(of, kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(of))])
                step = max(1, AT_ONCE // max(1, len(w)))
                for lo in range(0, len(v), step):
                    hi = min(len(v), lo + step)
                    square, gap = np.zeros((hi - lo, len(w))), np.empty((hi - lo, len(w)))
                    for d in range(v.shape[1]):  # number by number: the sums are those of the truth
                        np.subtract.outer(v[lo:hi, d], w[:, d], out=gap)
                        gap *= gap
                        square += gap
                    score = -np.round(np.sqrt(square), DIGITS)
                    i = turn[ends[lo] : ends[hi]]
                    if not k:
                        yield pa.RecordBatch.from_arrays([pa.array(q[i]), pa.array(_counted(score, of[i] - lo, truth[i], own[i], by_column))], ["q", "better"])
                        continue
                    near = {j: hidden[x] for j, x in enumerate(i.tolist()) if x in hidden}
                    found, place, value = _best(score, of[i] - lo, k, near, by_column)
                    yield pa.RecordBatch.from_arrays([pa.array(q[i][found], pa.int64()), pa.array(e[place], pa.int64()), pa.array(value, pa.float64())], ["q", "id", "score"])

    if k:
        return cells.mapInArrow(run, "q long, id long, score double")
    return cells.mapInArrow(run, "q long, better long").groupBy("q").agg(F.sum("better").alias("better"))


def _moved(rows: DataFrame, entities: DataFrame, relations: DataFrame, tail: bool) -> DataFrame:
    """``rows`` with ``v``, where the missing part should be: h + r, or t - r."""
    have = "s" if tail else "o"
    j = rows.join(relations.select(F.col("label").alias("p"), F.col("v").alias("__r")), "p").join(entities.select(F.col("label").alias(have), F.col("v").alias("__e")), have)
    move = (lambda e, r: e + r) if tail else (lambda e, r: e - r)
    return j.withColumn("v", F.zip_with("__e", "__r", move)).drop("__e", "__r")


def rank_filtered(test: DataFrame, known: DataFrame, entities: DataFrame, relations: DataFrame, filtered: bool = True) -> DataFrame:
    """``(s, p, o, rank)``: the rank of the true tail of each distinct test fact among all entities (id, label, v), other known tails left out if
    ``filtered``. An action."""
    entities, relations = written(entities, "entities"), written(relations, "relations")
    facts = written(test.select("s", "p", "o").distinct().withColumn("q", F.monotonically_increasing_id()), "facts")
    d = F.zip_with("v", "__t", lambda a, b: a - b)
    score = -F.round(F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x)), DIGITS)

    def scored(rows: DataFrame) -> DataFrame:
        truth = entities.select(F.col("label").alias("o"), F.col("id").alias("own"), F.col("v").alias("__t"))
        return _moved(rows, entities, relations, True).join(truth, "o").withColumn("truth", score)

    better = against_all(scored(facts).select("q", "v", "own", "truth"), entities.select("id", "v"))
    ranked = facts.join(better, "q", "left").withColumn("rank", F.col("better") + 1)
    if filtered:
        # the known tails of a pair that are better than one of them are those before it in their own order: sorted once per pair, not met one by one
        asked = facts.select("s", "p").distinct()
        tails = scored(known.select("s", "p", "o").join(asked, ["s", "p"], "left_semi").unionByName(facts.select("s", "p", "o")).distinct())
        order = Window.partitionBy("s", "p").orderBy(F.col("truth").desc(), "own")
        before = tails.withColumn("__before", F.row_number().over(order) - 1).select("s", "p", "o", "__before")
        ranked = ranked.join(before, ["s", "p", "o"], "left").withColumn("rank", F.col("rank") - F.col("__before"))
    return ranked.select("s", "p", "o", "rank")


def rank_metrics(ranked: DataFrame, ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """One row: how many facts have a rank, the mean of 1 / rank, the mean rank, and the shares within ``ks``; 0 where there are none."""
    r = F.col("rank")
    zero = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 9).alias(name)
    return ranked.agg(F.count(r).alias("n"), zero(F.avg(1 / r), "mrr"), zero(F.avg(r), "mean_rank"), *(zero(F.avg(F.when(r.isNotNull(), (r <= k).cast("double"))), f"hits_{k}") for k in ks))


def predict(pairs: DataFrame, known: DataFrame, entities: DataFrame, relations: DataFrame, k: int = 10, tail: bool = True) -> DataFrame:
    """The ``k`` best tails ``(s, p, o, place, score)`` of pairs (s, p), or heads of pairs (p, o), known facts left out. An action."""
    have, lack = ("s", "o") if tail else ("o", "s")
    entities, relations = written(entities, "entities"), written(relations, "relations")
    asked = written(pairs.select(have, "p").distinct().withColumn("q", F.monotonically_increasing_id()), "pairs")
    facts = known.select("s", "p", "o").distinct().join(entities.select(F.col("label").alias(lack), "id"), lack)
    hidden = asked.join(facts, [have, "p"]).select("q", "id")
    rows = _moved(asked, entities, relations, tail).select("q", "v", F.lit(None).cast("long").alias("own"), F.lit(None).cast("double").alias("truth"))
    best = against_all(rows, entities.select("id", "v"), hidden, k)
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))).where(F.col("place") <= k)
    named = placed.join(entities.select("id", F.col("label").alias(lack)), "id").join(asked, "q")
    return named.select("s", "p", "o", "place", "score")


def true_flags(scores: DataFrame, facts: DataFrame) -> DataFrame:
    """``scores`` (direction, rel, src, cand, ...) with ``is_true``: whether the facts (s, p, o) have it, by its direction, tail or head."""
    f = facts.select("s", "p", "o").distinct()
    tails = f.select(F.lit("tail").alias("direction"), F.col("p").alias("rel"), F.col("s").alias("src"), F.col("o").alias("cand"))
    heads = f.select(F.lit("head").alias("direction"), F.col("p").alias("rel"), F.col("o").alias("src"), F.col("s").alias("cand"))
    key = ["direction", "rel", "src", "cand"]
    return scores.join(tails.unionByName(heads).withColumn("__hit", F.lit(1)), key, "left").withColumn("is_true", F.coalesce("__hit", F.lit(0))).select(*scores.columns, "is_true")
