"""Queries of the metric, embedding and score operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import embed as e
from ..operators import graph as g
from ..operators import metrics as m
from ..operators import ml
from ..operators import triples as tr
from ..storage import ship, table
from .star import KNOWN, known

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return f(spark, d)

    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def _scores(s: SparkSession, d: str) -> DataFrame:
    """Scores with ties and a label that goes with them: line items, by discount and quantity."""
    li = table(s, d, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("q"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cand"), F.round(F.col("l_discount") * 5 + F.col("l_quantity") / 100, 6).alias("score"),
        ((F.col("l_discount") > 0.05) & (F.col("l_orderkey") % 3 != 0)).cast("int").alias("label"),
    )


_S = "with s as (select l_suppkey q, l_orderkey * 10 + l_linenumber cand, round(l_discount * 5 + l_quantity / 100, 6) score, (l_discount > 0.05 and l_orderkey % 3 <> 0)::int as label from lineitem)"
_C = _S + ", c0 as (select score, sum(label) pos, sum(1 - label) negs from s group by 1), c as (select *, sum(pos) over (order by score desc) tp, sum(negs) over (order by score desc) fp from c0)"
_MRR = """, r as (select *, row_number() over (partition by q order by score desc, cand) rank from s)
  select count(*) filter (label = 1) n_true, case when count(*) filter (label = 1) > 0 then count(distinct q) else count(*) end n_queries, coalesce(round(avg(1 / rank) filter (label = 1), 9), 0) mrr,
    coalesce(round(avg((rank <= 1)::int) filter (label = 1), 9), 0) hits_1, coalesce(round(avg((rank <= 3)::int) filter (label = 1), 9), 0) hits_3, coalesce(round(avg((rank <= 10)::int) filter (label = 1), 9), 0) hits_10 from r"""
_add("mrr_hits", lambda s, d: m.mrr_hits(_scores(s, d), ["q"], "score", "cand", "label"), _S + _MRR)
_add("mrr_hits_some", lambda s, d: m.mrr_hits(_scores(s, d).withColumn("label", F.when(F.col("q") % 3 == 0, F.col("label")).otherwise(0)), ["q"], "score", "cand", "label"), _S.replace("with s as", "with s0 as") + ", s as (select q, cand, score, case when q % 3 = 0 then label else 0 end as label from s0)" + _MRR)
_add("mrr_hits_none", lambda s, d: m.mrr_hits(_scores(s, d).withColumn("label", F.lit(0)), ["q"], "score", "cand", "label"), _S.replace("with s as", "with s0 as") + ", s as (select q, cand, score, 0 as label from s0)" + _MRR)
_add("single_query_mrr", lambda s, d: m.single_query(_scores(s, d), "score", "cand", "label"), _S + ", r as (select label, row_number() over (order by score desc, cand) rank from s) select round(1 / min(rank) filter (label = 1), 9) mrr, max(label) filter (rank <= 10)::double hits from r")
_add("roc_auc", lambda s, d: m.roc_auc(_scores(s, d), "score", "label"), _C + " select round(sum(negs * (tp - pos / 2)) / (sum(pos) * sum(negs)), 9) roc_auc from c")
_add("average_precision", lambda s, d: m.average_precision(_scores(s, d), "score", "label"), _C + " select round(sum(pos * tp / (tp + fp)) / sum(pos), 9) average_precision from c")
_J = _C + ", j as (select score threshold, tp / (tp + fp) \"precision\", tp / (select sum(pos) from c0) recall, fp / (select sum(negs) from c0) fpr from c)"
_add("best_threshold_f1", lambda s, d: m.best_threshold(_scores(s, d), "score", "label"), _J + ", v as (select threshold, round(2 * \"precision\" * recall / (\"precision\" + recall + 1e-8), 9) as value, round(\"precision\", 9) \"precision\", round(recall, 9) recall from j) select * from v order by value desc, threshold desc limit 1")
_add("best_threshold_balanced", lambda s, d: m.best_threshold(_scores(s, d), "score", "label", "balanced_accuracy", 0.3), _J + ", v as (select threshold, round((recall + 1 - fpr) / 2, 9) as value, round(\"precision\", 9) \"precision\", round(recall, 9) recall from j where \"precision\" >= 0.3) select * from v order by value desc, threshold desc limit 1")
_add("ndcg", lambda s, d: m.ndcg(_scores(s, d), ["q"], "score", "cand", "label"), _S + ", r as (select q, label, row_number() over (partition by q order by score desc, cand) a, row_number() over (partition by q order by label desc, cand) b from s), x as (select q, sum(case when a <= 10 then label / log2(a + 1) else 0 end) dcg, sum(case when b <= 10 then label / log2(b + 1) else 0 end) best from r group by 1) select count(*) n_queries, round(avg(dcg / best), 9) ndcg from x where best > 0")
_CONF = ", x as (select count(*) filter (score >= 0.5 and label = 1) tp, count(*) filter (score >= 0.5 and label = 0) fp, count(*) filter (score < 0.5 and label = 1) fn, count(*) filter (score < 0.5 and label = 0) tn from s)"
_add("confusion", lambda s, d: m.confusion(_scores(s, d), "score", "label", 0.5), _S + _CONF + " select *, round((tp + tn) / (tp + fp + fn + tn), 9) accuracy, round(tp / (tp + fp), 9) \"precision\", round(tp / (tp + fn), 9) recall, round(2 * tp / (2 * tp + fp + fn), 9) f1 from x")
_add("class_stats", lambda s, d: m.class_stats(_scores(s, d), "score", "label"), _S + " select label, count(*) n, round(avg(score), 9) mean, round(stddev_pop(score), 9) std, min(score) low, max(score) high, round(avg(((score >= 0.5)::int = label)::int), 9) accuracy from s group by 1")
_add("quartile_stats", lambda s, d: m.quartile_stats(_scores(s, d), "score", "label"), _S + ", e as (select quantile_cont(score, 0.25) a, quantile_cont(score, 0.5) b, quantile_cont(score, 0.75) c from s), sp as (select 1 quartile, 0.0::double lo, a hi from e union all select 2, a, b from e union all select 3, b, c from e union all select 4, c, 1.0 from e) select quartile, count(*) n, round(avg(label), 9) positive_share from s join sp on score between lo and hi group by 1")
_add("model_comparison", lambda s, d: m.improvement(table(s, d, "part").groupBy(F.col("p_brand").alias("name")).agg(F.avg("p_size").alias("value")).withColumn("value", F.round("value", 6)), "name", "value", "Brand#11"), "with r as (select p_brand as name, round(avg(p_size), 6) as value from part group by 1) select name, value, round((value - b) / b * 100, 9) percent, row_number() over (order by value desc, name)::int place from r, (select value b from r where name = 'Brand#11')")
_add("calibrate_platt", lambda s, d: m.platt(_scores(s, d), "score", "label", key="cand").select("cand", "calibrated"))
_add("calibrate_isotonic", lambda s, d: m.isotonic(_scores(s, d), "score", "label").select("cand", F.round("calibrated", 6).alias("calibrated")))


def _vec(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", e.doubles(F.col("embedding")).alias("v"), F.col("label").alias("cls"))


def _asked(s: SparkSession, d: str) -> DataFrame:
    """The vectors whose id is divisible by 100: a search is asked for these."""
    return _vec(s, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("v").alias("qv"))


_VEC = "with v as (select vec_id, embedding::double[64] e, label cls from embeddings), a as (select vec_id query, e qv from v where vec_id % 100 = 0)"
_NEAR = ", n as (select query, vec_id, {0} as value from a, v where query <> vec_id), r as (select query, vec_id, value, row_number() over (partition by query order by round(value, 9) {1}, vec_id)::int place from n) select query, vec_id, place, round(value, 8) as value from r where place <= 10"
_round = lambda df: df.withColumn("value", F.round("value", 8))
_add("cosine_knn", lambda s, d: _round(e.nearest(_vec(s, d), "vec_id", "v", _asked(s, d))), _VEC + _NEAR.format("array_cosine_similarity(qv, e)", "desc"))
_add("euclid_knn", lambda s, d: _round(e.nearest(_vec(s, d), "vec_id", "v", _asked(s, d), metric="euclid")), _VEC + _NEAR.format("array_distance(qv, e)", "asc"))
_add("mean_vectors", lambda s, d: e.mean_vectors(_vec(s, d), "cls", "v").select("cls", F.posexplode("v").alias("i", "x")).select("cls", "i", F.round("x", 9).alias("x")), "select cls, (i - 1)::int i, round(avg(x), 9) x from (select label cls, unnest(embedding::double[64]) x, generate_subscripts(embedding, 1) i from embeddings) group by 1, 2")
_add("normalized_vectors", lambda s, d: _vec(s, d).select("vec_id", F.round(e.norm(e.normalized(F.transform("v", lambda x: x * 3))), 6).alias("n")), "select vec_id, 1.0::double n from embeddings")


def _triples(s: SparkSession, d: str) -> DataFrame:
    """A chain over the vectors: each with the next two by id, the class of the first as relation."""
    v = _vec(s, d)
    a, b, c = (v.select(F.col("vec_id").alias(f"{n}_id"), F.col("v").alias(n)) for n in "hrt")
    return a.join(b, F.col("r_id") == F.col("h_id") + 1).join(c, F.col("t_id") == F.col("h_id") + 2)


_TRI = "with v as (select vec_id, embedding::double[64] e from embeddings), x as (select h.vec_id h_id, h.e h, r.e r, t.e t from v h join v r on r.vec_id = h.vec_id + 1 join v t on t.vec_id = h.vec_id + 2)"
_add("transe_score", lambda s, d: _triples(s, d).select("h_id", F.round(e.transe(F.col("h"), F.col("r"), F.col("t")), 8).alias("l2"), F.round(e.transe(F.col("h"), F.col("r"), F.col("t"), 1), 7).alias("l1")), _TRI + " select h_id, round(-sqrt(list_sum([(h[i] + r[i] - t[i]) ** 2 for i in range(1, 65)])), 8) l2, round(-list_sum([abs(h[i] + r[i] - t[i]) for i in range(1, 65)]), 7) l1 from x")
_add("triple_features", lambda s, d: _triples(s, d).select("h_id", e.triple_features(F.col("h"), F.col("r"), F.col("t")).alias("f")).select("h_id", F.size("f").cast("long").alias("n"), F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), 6).alias("total")), _TRI + " select h_id, 324::bigint n, round(list_sum(h) + list_sum(r) + list_sum(t) - sqrt(list_sum([(h[i] + r[i] - t[i]) ** 2 for i in range(1, 65)])) + list_sum([h[i] * t[i] for i in range(1, 65)]) + list_sum([abs(h[i] - t[i]) for i in range(1, 65)]) + sqrt(list_sum([z ** 2 for z in h])) + sqrt(list_sum([z ** 2 for z in r])) + sqrt(list_sum([z ** 2 for z in t])), 6) total from x")


def _batch(s: SparkSession, d: str) -> DataFrame:
    ent = table(s, d, "node_embeddings").where(F.size("entity_embeddings") == 128).groupBy(F.upper("entity").alias("label")).agg(F.min_by("entity_embeddings", "id").alias("v")).withColumn("v", e.doubles(F.col("v")))
    rel = table(s, d, "transe_relation_map").select("label", F.transform(F.sequence(F.lit(1), F.lit(128)), lambda i: (F.col("id") - i) / 1000.0).alias("v"))
    return e.score_triples(known(s, d).select("triple_id", "s", "p", "o"), ent, rel).select("triple_id", F.when(F.col("score") > float("-inf"), F.round("score", 4)).otherwise(F.lit(None)).alias("score"))


_add("batch_score", _batch, KNOWN + """, e as (select upper(entity) l, arg_min(entity_embeddings, id)::double[] v from node_embeddings where len(entity_embeddings) = 128 group by 1)
  select triple_id, round(-sqrt(list_sum(list_transform(generate_series(1, 128), lambda i: pow(h.v[i] + (r.id - i) / 1000.0::double - t.v[i], 2)))), 4) score from k left join transe_relation_map r on r.label = k.p left join e h on h.l = k.s left join e t on t.l = k.o""")
_KIND = "case when regexp_full_match(e, '[0-9A-Za-z]{32}') then 'uuid' when contains(e, 'T') and regexp_matches(e, '(Z|[+-][0-9]{2}:[0-9]{2})$') then 'date' when regexp_full_match(e, '[0-9]+') then 'number' when regexp_full_match(e, '[A-Z0-9_]+') then 'code' else 'text' end"
_add("oov_quality", lambda s, d: e.input_quality(known(s, d), table(s, d, "transe_entity_map").select(F.upper("label").alias("label"))), KNOWN + f" select {_KIND} kind, count(*) n, count(*) filter (e not in (select upper(label) from transe_entity_map)) n_unknown from (select s e from k union select o from k) group by 1")


def _parts(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_discount") * 8).alias("a"), F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity") / 50).alias("b"), F.col("l_tax").alias("penalty"))


_add("hybrid_score", lambda s, d: e.hybrid_score(_parts(s, d), ["a", "b"], "penalty").select("id", "score", "verdict"), "with x as (select l_orderkey * 10 + l_linenumber id, case when l_linenumber % 2 = 0 then l_discount * 8 end a, case when l_linenumber % 3 = 0 then l_quantity / 50 end b, l_tax t from lineitem), y as (select id, round(greatest(0, least(1, coalesce(case when a is null then b when b is null then a else (a + b) / 2 end, 0.5) - t)), 9) score from x) select id, score, case when score < 0.3 then 'reject' when score < 0.5 then 'review' else 'accept' end verdict from y")
_add("sample_weights", lambda s, d: e.sample_weights(table(s, d, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "weight"), "select p_partkey, round((1 + 0.5 * ln(1 + p_size)) / (select avg(1 + 0.5 * ln(1 + p_size)) from part), 9) weight from part")


def _trained(s: SparkSession, d: str) -> DataFrame:
    t = known(s, d)
    ents, rels = g.vocabulary(g.entity_labels(t)), g.vocabulary(t.select(F.col("p").alias("label")))
    return e.train_transe(g.index_triples(t, ents, rels), ents.count(), rels.count(), dim=16, epochs=3)


_add("transe_train", _trained)


def _features(s: SparkSession, d: str) -> DataFrame:
    """Features of customers, and whether they spend much."""
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    c = table(s, d, "customer").select(F.col("c_custkey").alias("c"), F.col("c_acctbal").alias("bal"), F.col("c_nationkey").cast("double").alias("nat"))
    return c.join(o, "c").select("c", F.col("n").cast("double").alias("n"), F.col("f").cast("double").alias("f"), "bal", "nat", (F.col("n") * F.col("mean") > 2e6).cast("double").alias("y"))


_F = ["n", "f", "bal", "nat"]
_add("gbt_scores", lambda s, d: ml.probability(ml.boosted(_F, "y", 5, 3).fit(_features(s, d)), _features(s, d)).select("c", F.round("p", 6).alias("p")))
_add("stacked_scores", lambda s, d: ml.stacked(_features(s, d), [["n", "f"], ["bal", "nat"]], "y", "c", 2).select("c", F.round("p", 6).alias("p")))
_add("tree_rules", lambda s, d: s.createDataFrame(ml.tree_rules(ml.boosted(_F, "y", 3, 3).fit(_features(s, d)), _F), "rule string, value double"))
_add("structure_features", lambda s, d: ml.structure_features(tr.json_to_triples(table(s, d, "events"), "event_id", "props")).select("doc_id", "n_leaves", "n_int", "max_depth"), "select event_id doc_id, 1::bigint n_leaves, 1::bigint n_int, 1::int max_depth from events where json_valid(props)")
