"""Queries of the rule operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as u
from ..operators.ordered import numbered
from ..storage import table
from .star import KNOWN, STAR, W, known, star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


#: The rules of the queries: constants and variables, one to three atoms, a wildcard, an existential head.
RULES = [
    ("urgent", "priority(A,'1-URGENT') <= status(A,'F')", 0.2),
    ("open", "priority(A,'5-LOW') <= status(A,'O')", 0.4),
    ("region", "in_region(C,R) <= in_nation(C,N), in_region(N,R)", 0.9),
    ("home", "in_nation(O,N) <= placed_by(O,C), in_nation(C,N)", 0.8),
    ("far", "in_region(O,R) <= placed_by(O,C), in_nation(C,N), in_region(N,R)", 0.7),
    ("same", "placed_by(O,C) <= placed_by(O,C)", 1.0),
    ("never", "status(A,'X') <= status(A,'no such status')", 0.5),
    ("any", "in_region(A,'region_0') <= *(A,'nation_0')", 0.3),
]
ONE, TWO, THREE = {"urgent", "open", "same", "never", "any"}, {"region", "home"}, {"far"}


def _rules(names: set[str] | None = None) -> list[u.Rule]:
    return u.parse_rules([r for r in RULES if names is None or r[0] in names], fixed=True)


def _texts(df: DataFrame) -> DataFrame:
    return df.select("rule_id", "confidence", F.array_join(F.transform(F.array_sort(F.map_entries("bindings")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("bindings"))


_ANTI = "not exists (select 1 from t h where h.s = {0} and h.p = '{1}' and h.o = {2})"
_V = {
    "urgent": "select 'urgent' rule_id, 0.2::double confidence, 'A=' || s bindings from t a where p = 'status' and o = 'F' and " + _ANTI.format("a.s", "priority", "'1-URGENT'"),
    "open": "select 'open', 0.4, 'A=' || s from t a where p = 'status' and o = 'O' and " + _ANTI.format("a.s", "priority", "'5-LOW'"),
    "any": "select 'any', 0.3, 'A=' || s from t a where o = 'nation_0' and " + _ANTI.format("a.s", "in_region", "'region_0'"),
    "region": "select 'region' rule_id, 0.9::double confidence, 'C=' || a.s || ',N=' || a.o || ',R=' || b.o bindings from t a join t b on a.p = 'in_nation' and b.p = 'in_region' and a.o = b.s where " + _ANTI.format("a.s", "in_region", "b.o"),
    "home": "select 'home', 0.8, 'C=' || a.o || ',N=' || b.o || ',O=' || a.s from t a join t b on a.p = 'placed_by' and b.p = 'in_nation' and a.o = b.s where " + _ANTI.format("a.s", "in_nation", "b.o"),
    "far": "select 'far' rule_id, 0.7::double confidence, 'C=' || a.o || ',N=' || b.o || ',O=' || a.s || ',R=' || c.o bindings from t a join t b on a.p = 'placed_by' and b.p = 'in_nation' and a.o = b.s join t c on c.p = 'in_region' and c.s = b.o where " + _ANTI.format("a.s", "in_region", "c.o"),
}
_union = lambda names: " union all ".join(_V[n] for n in names)
_all_v = ", v as (" + _union(["urgent", "open", "any"]) + " union all " + _union(["region", "home"]) + " union all " + _V["far"] + ")"
_named = ", r(rule_id, confidence) as (values " + ", ".join(f"('{i}', {c}::double)" for i, _, c in RULES) + ")"
_judged = _all_v + _named + ", j as (select r.rule_id, r.confidence, count(v.rule_id) n_violations, count(v.rule_id) = 0 satisfied from r left join v using (rule_id) group by 1, 2)"
_add("rule_violations_1", lambda s, d: _texts(u.violations(star(s, d), _rules(ONE))), STAR + " " + _union(["urgent", "open", "any"]))
_add("rule_violations_2", lambda s, d: _texts(u.violations(star(s, d), _rules(TWO))), STAR + " " + _union(["region", "home"]))
_add("rule_violations_3", lambda s, d: _texts(u.violations(star(s, d), _rules(THREE))), STAR + " " + _V["far"])
_add("rule_verdicts", lambda s, d: u.verdicts(star(s, d), _rules()), STAR + _judged + " select * from j")
_add("rule_confidence", lambda s, d: u.confidence_score(u.verdicts(star(s, d), _rules())).select(F.round("confidence_score", 9).alias("confidence_score")), STAR + _judged + " select round(coalesce(sum(confidence * confidence) / sum(confidence), 0), 9) confidence_score from j where satisfied")
_add("rule_violation_features", lambda s, d: u.violation_features(u.verdicts(star(s, d), _rules())).select("n_violations", "n_rules", F.round("mean_confidence", 9).alias("mean_confidence"), "n_violated", F.round("violation_rate", 6).alias("violation_rate"), "penalty"),
     STAR + _judged + " select sum(n_violations)::bigint n_violations, count(*) n_rules, round(sum(confidence * n_violations) / sum(n_violations), 9) mean_confidence, count(*) filter (not satisfied) n_violated, round(sum(n_violations) / count(*), 6) violation_rate, least(sum(n_violations) / count(*) * 10, 0.3)::double penalty from j")
_ORD = [r[0] for r in RULES]
_add("rule_group_features", lambda s, d: u.rule_features(u.verdicts(star(s, d), _rules()).join(s.createDataFrame([(n, i) for i, n in enumerate(_ORD)], "rule_id string, ord int"), "rule_id"), 3), STAR + _judged + ", o(rule_id, ord) as (values " + ", ".join(f"('{n}', {i})" for i, n in enumerate(_ORD)) + ") select (ord // 3)::bigint grp, avg((not satisfied)::int) mean, max((not satisfied)::int) as \"any\", sum((not satisfied)::int)::bigint n_violated from j join o using (rule_id) group by 1")


def _by_document(s: SparkSession, d: str) -> DataFrame:
    """A whole corpus at once: the orders of each customer are a document."""
    o = table(s, d, "orders")
    key = F.concat(F.lit("order_"), "o_orderkey")
    t = o.select(F.col("o_custkey").alias("doc"), key.alias("s"), F.lit("status").alias("p"), F.col("o_orderstatus").alias("o")).union(o.select("o_custkey", key, F.lit("priority"), "o_orderpriority"))
    return u.violations(t, u.parse_rules([("r", "priority(A,'1-URGENT') <= status(A,'F')", 0.5)], fixed=True), doc="doc").groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


_add("rule_documents", _by_document, "select o_custkey doc, count(*) n from orders where o_orderstatus = 'F' and o_orderpriority <> '1-URGENT' group by 1")


def _rule_rows(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "part")
    return n.select(F.col("p_partkey").alias("ord"), F.concat(F.lit("r"), "p_partkey").alias("id"), F.concat(F.lit("h("), "p_brand", F.lit(")")).alias("head"), F.col("p_type").alias("body"), (F.col("p_size") / 64).alias("confidence"))


_add("rule_dedup", lambda s, d: u.dedup_rules(_rule_rows(s, d)).withColumn("aggregated_confidence", F.round("aggregated_confidence", 6)), "select 'h(' || p_brand || ')' head, p_type body, 'r' || min(p_partkey) id, arg_min(p_size / 64, p_partkey) confidence, count(*) occurrences, round(sum(p_size / 64), 6) aggregated_confidence from part group by p_brand, p_type")


def _patterns(s: SparkSession) -> DataFrame:
    rows = [(0, None, "segment", None), (1, None, "in_nation", "nation_3"), (2, "order_1", None, None), (3, "nation_3", "in_region", "region_1"), (4, None, None, "nation_3"), (5, "nation_3", "in_region", "region_3")]
    return s.createDataFrame(rows, "pattern_id int, ps string, pp string, po string")


_add("pattern_batch", lambda s, d: u.match_batch(star(s, d), _patterns(s)), STAR + ", q(pattern_id, ps, pp, po) as (values (0, null, 'segment', null), (1, null, 'in_nation', 'nation_3'), (2, 'order_1', null, null), (3, 'nation_3', 'in_region', 'region_1'), (4, null, null, 'nation_3'), (5, 'nation_3', 'in_region', 'region_3')) select pattern_id, s, p, o from t join q on (ps is null or ps = s) and (pp is null or pp = p) and (po is null or po = o)")


def _ground(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation").select(F.concat(F.lit("in_region(nation_"), "n_nationkey", F.lit(",region_"), "n_regionkey", F.lit(")")).alias("a"), F.concat(F.lit("big(nation_"), "n_nationkey", F.lit(",yes)")).alias("b"), F.concat(F.lit("r"), "n_nationkey").alias("rule_id"), "n_nationkey")
    rules = n.select("rule_id", F.when(F.col("n_nationkey") % 2 == 0, F.col("a")).otherwise(F.col("b")).alias("head"), F.array("a").alias("body"))
    return u.ground_violated(star(s, d), rules)


_add("rule_ground_check", _ground, "select 'r' || n_nationkey rule_id from nation where n_nationkey % 2 <> 0")
_BOTH = KNOWN + ", e as (select distinct s, p, o from k), b as (select s x, p b, o y, true f from e union all select o, p, s, false from e)"
_TXT = "case when {0} then {1} || '({2},{3})' else {1} || '({3},{2})' end"
_LEARN = _BOTH + f"""
, h as (select s x, p h, o y from e),
one as (select h.h || '(X,Y) <= ' || {_TXT.format("w.f", "w.b", "X", "Y")} as rule, w.b, w.f, count(*) support from h join b w on h.x = w.x and h.y = w.y where h.h <> w.b or not w.f group by all),
oall as (select b, f, count(*) groundings from b group by all),
i as (select b b1, f f1, y z, count(*) n1 from b group by all), u as (select b b2, f f2, x z, count(*) n2 from b group by all),
tall as (select b1, f1, b2, f2, sum(n1 * n2 - case when b1 = b2 and f1 <> f2 then n1 else 0 end)::bigint groundings from i join u using (z) group by all),
two as (select h.h || '(X,Y) <= ' || {_TXT.format("p.f", "p.b", "X", "Z")} || ', ' || {_TXT.format("q.f", "q.b", "Z", "Y")} as rule, p.b b1, p.f f1, q.b b2, q.f f2, count(*) support
  from h join b p on p.x = h.x join b q on q.x = p.y and q.y = h.y where h.x <> h.y group by all),
r as (select rule, support, groundings from one join oall using (b, f) union all select rule, support, groundings from two join tall using (b1, f1, b2, f2))
select rule, support, groundings, round(support / groundings, 12) confidence from r where support >= 2 and groundings > 0
"""
_add("rule_learn_paths", lambda s, d: u.learn_paths(known(s, d)).withColumn("confidence", F.round("confidence", 12)), _LEARN)


def _evidence(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li, o = table(s, d, "lineitem"), table(s, d, "orders")
    ev = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("src"), F.lit("buys").alias("rel"), F.col("l_suppkey").alias("cand"), (F.lit(0.1) + F.col("l_discount")).alias("confidence"))
    return ev, ev.where("confidence >= 0.195").select("src", "rel", "cand").distinct()


_EV = "with ev as (select o_custkey src, 'buys' rel, l_suppkey cand, 0.1::double + l_discount confidence from lineitem join orders on l_orderkey = o_orderkey), kn as (select distinct src, rel, cand from ev where confidence >= 0.195), fr as (select * from ev anti join kn using (src, rel, cand)), "
_add("rank_noisy_or", lambda s, d: u.rank_candidates(*_evidence(s, d)).select("src", "rel", "cand", F.round("score", 6).alias("score")), _EV + "sc as (select src, rel, cand, round(1 - list_reduce(list_transform(list(confidence order by confidence), lambda c: 1 - c), lambda a, c: a * c, 1.0::double), 6) score from fr group by 1, 2, 3) select * from sc")
_add("rank_max_plus", lambda s, d: u.rank_candidates(*_evidence(s, d), "maxplus").select("src", "rel", "cand", F.round("score", 9).alias("score"), "rank"), _EV + "sc as (select src, rel, cand, list(confidence order by confidence desc) l from fr group by 1, 2, 3) select src, rel, cand, round(l[1], 9) score, row_number() over (partition by src, rel order by l desc, cand)::int rank from sc")
_add("rule_quality", lambda s, d: _rule_rows(s, d).select("id", u.quality(F.col("confidence"), F.col("ord")).alias("quality")), "select 'r' || p_partkey id, round(p_size / 64 * p_partkey / 100, 9) quality from part")
_add("rule_union_first", lambda s, d: _rule_rows(s, d).groupBy(F.trim("body").alias("rule")).agg(F.max_by("id", F.struct("confidence", -F.col("ord"))).alias("id"), F.max("confidence").alias("confidence")), "select p_type as rule, 'r' || arg_max(p_partkey, {'c': p_size, 'o': -p_partkey}) id, max(p_size / 64) confidence from part group by 1")
_add("rule_literals", lambda s, d: _rule_rows(s, d).select(F.explode(F.regexp_extract_all(F.concat(F.lit("h(A,'"), "body", F.lit("') <= b(A,\""), "head", F.lit('")')), F.lit(r"'([^']*)'|\"([^\"]*)\""), F.lit(0))).alias("q")).select(F.expr("substring(q, 2, length(q) - 2)").alias("literal")).distinct(), "select p_type literal from part union select 'h(' || p_brand || ')' from part")
_add("anchored_numbers", lambda s, d: numbered(_rule_rows(s, d).select("body").distinct(), ["body"], "id", 100), "select p_type body, 99 + row_number() over (order by p_type) id from (select distinct p_type from part)")
