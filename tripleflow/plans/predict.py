"""Queries of link prediction, of rules applied to pairs, of entities without vectors, and of preparing a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import linkpred as lp
from ..operators import metrics as m
from ..operators import oov
from ..operators import prepare as pr
from ..operators import rules as u
from ..storage import new_path, ship, table
from .star import KNOWN, STAR, known, star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return f(spark, d)

    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# ---- link prediction, with vectors that a formula gives from the ids
DIM = 8


def _vectors(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph's triples, its entities and its relations, with vectors."""
    t = known(s, d)
    i = F.sequence(F.lit(1), F.lit(DIM))
    e = g.vocabulary(g.entity_labels(t)).withColumn("v", F.transform(i, lambda k: F.pmod(F.col("id") * 7 + k * 13 + F.floor(F.col("id") / 29) * k, F.lit(101)) / F.lit(101.0)))
    r = g.vocabulary(t.select(F.col("p").alias("label"))).withColumn("v", F.transform(i, lambda k: F.pmod(F.col("id") * 5 + k * 11, F.lit(17)) / F.lit(17.0) - 0.5))
    return t, e, r


_VEC = KNOWN + f"""
, en as (select row_number() over (order by l) - 1 id, l from (select s l from k union select o from k)),
e as (select id, l, list_transform(generate_series(1, {DIM}), lambda i: ((id * 7 + i * 13 + (id // 29) * i) % 101) / 101.0::double)::double[{DIM}] v from en),
rn as (select row_number() over (order by l) - 1 id, l from (select distinct p l from k)),
r as (select l, list_transform(generate_series(1, {DIM}), lambda i: ((id * 5 + i * 11) % 17) / 17.0::double - 0.5)::double[{DIM}] v from rn),
f as (select distinct s, p, o from k)
"""
_MOVE = "list_transform(generate_series(1, {n}), lambda i: {a}[i] {sign} {b}[i])::double[{n}]"
_BETTER = _VEC + f"""
, q as (select f.s, f.p, f.o, t.id own, {_MOVE.format(n=DIM, a="h.v", b="r.v", sign="+")} v, t.v tv from (select distinct s, p, o from k where split = 'test') f join e h on h.l = f.s join r on r.l = f.p join e t on t.l = f.o),
x as (select q.s, q.p, q.o, q.own, -round(array_distance(q.v, q.tv), 9) truth, e.id, -round(array_distance(q.v, e.v), 9) score from q, e),
ranked as (select s, p, o, 1 + count(*) filter (id <> own and (score > truth or (score = truth and id < own))) rank from x group by s, p, o)
"""
_FILTERED = _VEC + f"""
, q as (select f.s, f.p, f.o, t.id own, {_MOVE.format(n=DIM, a="h.v", b="r.v", sign="+")} v, t.v tv from (select distinct s, p, o from k where split = 'test') f join e h on h.l = f.s join r on r.l = f.p join e t on t.l = f.o),
x as (select q.s, q.p, q.o, q.own, -round(array_distance(q.v, q.tv), 9) truth, e.id, -round(array_distance(q.v, e.v), 9) score, e.l from q, e),
b as (select x.* from x left join f on f.s = x.s and f.p = x.p and f.o = x.l where f.s is null or x.l = x.o),
ranked as (select s, p, o, 1 + count(*) filter (id <> own and (score > truth or (score = truth and id < own))) rank from b group by s, p, o)
"""


def _ranked(s: SparkSession, d: str, filtered: bool) -> DataFrame:
    t, e, r = _vectors(s, d)
    return lp.rank_filtered(t.where("split = 'test'"), t, e, r, filtered)


_add("rank_filtered", lambda s, d: _ranked(s, d, True), _FILTERED + "select s, p, o, rank from ranked")
_add("rank_raw", lambda s, d: _ranked(s, d, False), _BETTER + "select s, p, o, rank from ranked")
_METRICS = "select count(rank) n, round(avg(1 / rank), 9) mrr, round(avg(rank), 9) mean_rank, round(avg((rank <= 1)::int), 9) hits_1, round(avg((rank <= 3)::int), 9) hits_3, round(avg((rank <= 10)::int), 9) hits_10 from ranked"
_add("rank_metrics", lambda s, d: lp.rank_metrics(_ranked(s, d, True)), _FILTERED + _METRICS)


def _predicted(s: SparkSession, d: str, tail: bool) -> DataFrame:
    t, e, r = _vectors(s, d)
    asked = t.where("split = 'test'").select("s", "p", "o")
    return lp.predict(asked, t, e, r, 10, tail).withColumn("score", F.round(F.col("score") * 1e8) / 1e8)  # the rounding of SQL


def _predict_sql(have: str, lack: str, sign: str) -> str:
    return _VEC + f"""
, q as (select a.{have}, a.p, {_MOVE.format(n=DIM, a="h.v", b="r.v", sign=sign)} v from (select distinct {have}, p from k where split = 'test') a join e h on h.l = a.{have} join r on r.l = a.p),
x as (select q.{have}, q.p, e.id, e.l {lack}, -round(array_distance(q.v, e.v), 9) score from q, e),
b as (select x.* from x anti join f on f.{have} = x.{have} and f.p = x.p and f.{lack} = x.{lack}),
z as (select *, row_number() over (partition by {have}, p order by score desc, id)::int place from b)
select s, p, o, place, round(score, 8) score from z where place <= 10
"""


_add("topk_tails", lambda s, d: _predicted(s, d, True), _predict_sql("s", "o", "+"))
_add("topk_heads", lambda s, d: _predicted(s, d, False), _predict_sql("o", "s", "-"))


def _flags(s: SparkSession, d: str) -> DataFrame:
    t = known(s, d)
    tails = t.select(F.lit("tail").alias("direction"), F.col("p").alias("rel"), F.col("s").alias("src"), F.col("o").alias("cand"))
    heads = t.select(F.lit("head").alias("direction"), F.col("p").alias("rel"), F.col("o").alias("src"), F.col("s").alias("cand"))
    return lp.true_flags(tails.union(heads).distinct(), t.where("split = 'test'"))


_add("true_flags", _flags, KNOWN + """, c as (select distinct 'tail' direction, p rel, s src, o cand from k union all select distinct 'head', p, o, s from k),
  f as (select 'tail' direction, p rel, s src, o cand from k where split = 'test' union select 'head', p, o, s from k where split = 'test')
  select c.*, (f.cand is not null)::int is_true from c left join f using (direction, rel, src, cand)""")


# ---- rules applied to pairs
_PAIR_RULES = [
    ("r1", "usesService(X,Y) <= hasProduct(X,Z), usesService(Z,Y)", 0.6),
    ("r2", "usesService(X,Y) <= hasContract(X,Z), usesService(Z,Y)", 0.5),
    ("r3", "hasProduct(X,Y) <= hasContract(X,Z), hasProduct(Z,Y)", 0.7),
    ("r4", "hasProduct(X,Y) <= belongsTo(X,Z), hasProduct(Z,Y)", 0.4),
    ("r5", "livesInCity(X,Y) <= belongsTo(X,Z), livesInCity(Z,Y)", 0.8),
    ("r6", "livesInCity(X,Y) <= hasContract(Z,X), livesInCity(Z,Y)", 0.3),
    ("r7", "hasContract(X,Y) <= belongsTo(Y,X)", 0.9),
    ("r8", "belongsTo(X,Y) <= hasContract(Y,X)", 0.9),
]
_DERIVED_SQL = KNOWN + """, f as (select distinct s, p, o from k), a as (select distinct s, p from k where split = 'test'), d0 as (""" + " union all ".join(
    [
        f"select '{i}' rule_id, {c}::double confidence, a.s, a.p, y.o from a join f x on x.s = a.s and x.p = '{b1}' join f y on y.s = x.o and y.p = '{b2}' where a.p = '{h}'"
        for i, h, b1, b2, c in [("r1", "usesService", "hasProduct", "usesService", 0.6), ("r2", "usesService", "hasContract", "usesService", 0.5), ("r3", "hasProduct", "hasContract", "hasProduct", 0.7), ("r4", "hasProduct", "belongsTo", "hasProduct", 0.4), ("r5", "livesInCity", "belongsTo", "livesInCity", 0.8)]
    ]
    + ["select 'r6', 0.3, a.s, a.p, y.o from a join f x on x.o = a.s and x.p = 'hasContract' join f y on y.s = x.s and y.p = 'livesInCity' where a.p = 'livesInCity'"]
    + [f"select '{i}', 0.9, a.s, a.p, x.s from a join f x on x.o = a.s and x.p = '{b}' where a.p = '{h}'" for i, h, b in [("r7", "hasContract", "belongsTo"), ("r8", "belongsTo", "hasContract")]]
) + "), d as (select distinct * from d0)"


def _derived(s: SparkSession, d: str) -> DataFrame:
    t = known(s, d)
    return u.derived(t, u.parse_rules(_PAIR_RULES, fixed=True), t.where("split = 'test'").select("s", "p"))


_add("rule_candidates", _derived, _DERIVED_SQL + " select * from d")
_add("rule_explain", lambda s, d: u.explained(_derived(s, d)).withColumn("rules", F.array_join("rules", ",")), _DERIVED_SQL + " select s, p, o, count(*) n_rules, max(confidence) best, string_agg(rule_id, ',' order by confidence desc, rule_id) rules from d group by s, p, o")


def _rule_ranking(s: SparkSession, d: str) -> DataFrame:
    """Candidates of the test pairs by the rules, those of the other splits left out, best first."""
    evidence = _derived(s, d).select(F.col("s").alias("src"), F.col("p").alias("rel"), F.col("o").alias("cand"), "confidence")
    facts = known(s, d).where("split is distinct from 'test'").select(F.col("s").alias("src"), F.col("p").alias("rel"), F.col("o").alias("cand")).distinct()
    return u.rank_candidates(evidence, facts)


_RANKING_SQL = _DERIVED_SQL + """, g as (select distinct s, p, o from k where split is distinct from 'test'), fr as (select * from d anti join g using (s, p, o)),
  sc as (select s src, p rel, o cand, 1 - list_reduce(list_transform(list(confidence order by confidence), lambda c: 1 - c), lambda a, c: a * c, 1.0::double) score from fr group by 1, 2, 3),
  rk as (select src, rel, cand, score, row_number() over (partition by src, rel order by score desc, cand)::int rank from sc)"""
_add("rule_ranking", lambda s, d: _rule_ranking(s, d).withColumn("score", F.round("score", 9)), _RANKING_SQL + " select src, rel, cand, round(score, 9) score, rank from rk")
_add("rule_ranking_lines", lambda s, d: u.ranking_lines(_rule_ranking(s, d), 5), _RANKING_SQL + " select rel || chr(9) || src || chr(9) || string_agg(cand || ':' || format('{:.6f}', score), chr(9) order by rank) line from rk where rank <= 5 group by src, rel")


def _rule_metrics(s: SparkSession, d: str) -> DataFrame:
    """How well the rules rank the test facts."""
    ranked = _rule_ranking(s, d).withColumn("direction", F.lit("tail"))
    return m.mrr_hits(lp.true_flags(ranked, known(s, d).where("split = 'test'")), ["src", "rel", "direction"], "score", "cand", "is_true")


_add("rule_metrics", _rule_metrics, _RANKING_SQL + """, t as (select distinct s, p, o from k where split = 'test'), x as (select rk.*, (t.s is not null)::int label from rk left join t on t.s = rk.src and t.p = rk.rel and t.o = rk.cand)
  select count(*) filter (label = 1) n_true, case when count(*) filter (label = 1) > 0 then count(distinct (src, rel)) else count(*) end n_queries, coalesce(round(avg(1 / rank) filter (label = 1), 9), 0) mrr,
  coalesce(round(avg((rank <= 1)::int) filter (label = 1), 9), 0) hits_1, coalesce(round(avg((rank <= 3)::int) filter (label = 1), 9), 0) hits_3, coalesce(round(avg((rank <= 10)::int) filter (label = 1), 9), 0) hits_10 from x""")


# ---- rules in numbers
MANY = 10_000


def _many(s: SparkSession, d: str) -> DataFrame:
    """10,000 rules of one shape, which is one plan: the violations of each."""
    rules = [u.Rule(f"m{i}", ("in_nation", ("C", f"nation_{i % 25}")), (("placed_by", (f"order_{i}", "C")),), 1 / (1 + i % 9), True) for i in range(MANY)]
    return u.violations(star(s, d), rules).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


_add("rule_violations_many", _many, f"select 'm' || o_orderkey rule_id, count(*) n from orders left join customer on c_custkey = o_custkey where o_orderkey < {MANY} and c_nationkey is distinct from o_orderkey % 25 group by 1")


# ---- reports of documents
_DOC_RULES = [("late", "priority(A,'1-URGENT') <= status(A,'F')", 0.9), ("open", "priority(A,'5-LOW') <= status(A,'O')", 0.4), ("low", "status(A,'O') <= priority(A,'5-LOW')", 0.3)]


def _documents(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    key = F.concat(F.lit("order_"), "o_orderkey")
    return o.select(F.col("o_custkey").alias("doc"), key.alias("s"), F.lit("status").alias("p"), F.col("o_orderstatus").alias("o")).union(o.select("o_custkey", key, F.lit("priority"), "o_orderpriority"))


def _report(s: SparkSession, d: str) -> DataFrame:
    scores = table(s, d, "customer").select(F.col("c_custkey").alias("doc"), (F.col("c_custkey") % 10 / 10.0).alias("score"))
    got = u.validated(_documents(s, d), u.parse_rules(_DOC_RULES, fixed=True), "doc", scores)
    return got.select("doc", "n_violations", "confidence_score", "hybrid_score", "is_valid", "diagnostic", F.size("top_violations").alias("n_shown"))


_SAID = "'Conclusão esperada ''' || {0} || ''' não encontrada. A violação ocorreu porque as condições da regra foram satisfeitas com as variáveis: [A=''order_' || o_orderkey || ''']'"
_DOC_SQL = f"""with v as (
  select o_custkey doc, 'late' rule_id, 0.9::double confidence, {_SAID.format("'priority(order_' || o_orderkey || ', 1-URGENT)'")} description from orders where o_orderstatus = 'F' and o_orderpriority <> '1-URGENT'
  union all select o_custkey, 'open', 0.4, {_SAID.format("'priority(order_' || o_orderkey || ', 5-LOW)'")} from orders where o_orderstatus = 'O' and o_orderpriority <> '5-LOW'
  union all select o_custkey, 'low', 0.3, {_SAID.format("'status(order_' || o_orderkey || ', O)'")} from orders where o_orderpriority = '5-LOW' and o_orderstatus <> 'O'),
pr as (select doc, rule_id, any_value(confidence) c, count(*) n from v group by 1, 2), b as (select doc, sum(n)::bigint n, sum(c * c) c2, sum(c) c1 from pr group by 1),
dg as (select doc, arg_min(description, (-confidence, rule_id, encode(description))) diagnostic, least(count(*), 10)::int shown from v group by 1),
x as (select d.doc, coalesce(n, 0) n_violations, (1.06 - coalesce(c2, 0)) / nullif(round(1.6 - coalesce(c1, 0), 9), 0) cs, greatest(0, least(1, coalesce(c.c_custkey % 10 / 10.0, 0.5) - least(coalesce(n, 0) / 3 * 10, 0.3))) h, diagnostic, shown
  from (select distinct o_custkey doc from orders) d left join b using (doc) left join dg using (doc) left join customer c on c.c_custkey = d.doc)
select doc, n_violations, round(coalesce(cs, 0), 9) confidence_score, round(h, 9)::double hybrid_score, n_violations = 0 and round(h, 9) > 0.5 is_valid, coalesce(diagnostic, 'Nenhuma violação encontrada') diagnostic, coalesce(shown, 0) n_shown from x"""
_add("validation_report", _report, _DOC_SQL)


# ---- entities without vectors
_KIND = "case when regexp_full_match({0}, '[0-9A-Za-z]{{32}}') then 'uuid' when contains({0}, 'T') and regexp_matches({0}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$') then 'date' when regexp_full_match({0}, '[0-9]+') then 'number' when regexp_full_match({0}, '[A-Z0-9_]+') then 'code' else 'text' end"


def _mapped(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "transe_entity_map").select(F.upper("label").alias("label"))


def _oov(s: SparkSession, d: str) -> DataFrame:
    return oov.quality_by(known(s, d).where("source is not null"), _mapped(s, d), "source")


_OOV = KNOWN + f""", l as (select distinct source, e from (select source, s e from k union all select source, o from k) where source is not null),
  e as (select source, count(*) n_entities, count(distinct {_KIND.format('e')}) n_kinds, avg((e not in (select upper(label) from transe_entity_map))::int) oov_ratio from l group by 1),
  r as (select source, count(*) n_triples, count(distinct p) n_relations from k where source is not null group by 1),
  x as (select *, (least(n_relations / 20, 1) + least(n_triples / n_entities / 5, 1) + n_kinds / 5) / 3 complexity from r join e using (source)),
  y as (select *, case when oov_ratio > 0.8 then 'high_oov' when n_triples < 50 then 'few_rules' when complexity > 0.7 then 'balanced' else 'base' end strategy,
    case when oov_ratio < 0.2 and complexity > 0.5 then 'excellent' when oov_ratio < 0.5 and complexity > 0.3 then 'good' when oov_ratio < 0.8 then 'fair' else 'poor' end quality from x)"""
_round9 = lambda df: df.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
_add("oov_strategy", lambda s, d: _round9(_oov(s, d)).select("source", "n_triples", "n_relations", "n_entities", "n_kinds", "oov_ratio", "complexity", "strategy", "quality"),
     _OOV + " select source, n_triples, n_relations, n_entities, n_kinds, round(oov_ratio, 9) oov_ratio, round(complexity, 9) complexity, strategy, quality from y")


def _weights(s: SparkSession, d: str) -> DataFrame:
    """The weights of the experts and the confidence for each strategy, number of violations and coverage in the line items."""
    li = table(s, d, "lineitem").select("l_linenumber", "l_discount", (F.col("l_orderkey") % 4).alias("k")).distinct()
    names = F.element_at(F.array(*(F.lit(x) for x in oov.EXPERTS)), (F.col("k") + 1).cast("int"))
    quality = F.element_at(F.array(*(F.lit(x) for x in oov.QUALITY)), (F.col("k") + 1).cast("int"))
    rows = li.withColumns({"strategy": names, "quality": quality, "violations": 2 * (F.col("l_linenumber") - 1), "coverage": F.col("l_discount") * 6})
    w = oov.expert_weights(rows, "strategy", "violations", "coverage")
    c = oov.adjusted_confidence(F.lit(0.8), F.col("quality"), F.col("l_discount") * 10, F.col("coverage") * 2)
    return _round9(w.select("k", "l_linenumber", "l_discount", "w_symbolic", "w_hybrid", "w_neural", c.alias("confidence")))


_add("oov_weights", _weights, """with li as (select distinct l_linenumber, l_discount, l_orderkey % 4 k from lineitem),
  b as (select *, [0.4, 0.6, 0.2, 0.33][k + 1]::double * case when l_linenumber > 3 then 1.2 when l_linenumber = 1 then 0.8 else 1.0 end * case when l_discount * 6 < 0.3 then 0.8 else 1.0 end a,
    [0.35, 0.2, 0.5, 0.34][k + 1]::double * case when l_linenumber > 3 then 0.9 when l_linenumber = 1 then 1.1 else 1.0 end h, [0.25, 0.2, 0.3, 0.33][k + 1]::double * case when l_discount * 6 < 0.3 then 1.2 else 1.0 end n from li)
  select k, l_linenumber, l_discount, round(a / (a + h + n), 9) w_symbolic, round(h / (a + h + n), 9) w_hybrid, round(n / (a + h + n), 9) w_neural,
    round(least(greatest(0.8::double * [1.0, 0.95, 0.85, 0.7][k + 1]::double * case when l_discount * 10 > 0.6 then 1 - (l_discount * 10 - 0.6) else 1 end * case when l_discount * 6 * 2 < 0.5 then 0.8 when l_discount * 6 * 2 > 0.8 then 1.1 else 1.0 end, 0.1), 0.99), 9) confidence from b""")


def _unknown(s: SparkSession, d: str) -> DataFrame:
    return g.unmapped(known(s, d), _mapped(s, d)).select(F.col("entity").alias("label"))


_add("oov_candidates", lambda s, d: oov.candidates(_unknown(s, d), _mapped(s, d)))


def _stand_ins(how: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(s: SparkSession, d: str) -> DataFrame:
        e = table(s, d, "embeddings").select(F.concat(F.when(F.col("vec_id") % 3 == 0, "n").otherwise(""), F.col("vec_id").cast("string")).alias("label"), F.col("embedding").alias("v"))
        asked = s.createDataFrame([("77",), ("x y",)], "label string")
        return oov.stand_ins(asked, e, how).select("label", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 9))

    return query


_STAND = "with e as (select case when vec_id % 3 = 0 then 'n' else '' end || vec_id as label, unnest(embedding::double[]) x, generate_subscripts(embedding, 1) - 1 i from embeddings), q(label, kind) as (values ('77', 'number'), ('x y', 'text'))"
_add("oov_mean", _stand_ins("mean"), _STAND + " select q.label, i::int i, round(avg(x), 9) x from q, e group by 1, 2")
_add("oov_kind", _stand_ins("kind"), _STAND + f" select q.label, i::int i, round(avg(x), 9) x from q join e on q.kind = {_KIND.format('e.label')} group by 1, 2")
_add("oov_zero", _stand_ins("zero"), _STAND + " select distinct q.label, i::int i, 0.0::double x from q, e")
_add("oov_similar", _stand_ins("similar"))


# ---- preparing a graph
_TARGETS = pr.Targets(share=0.3, min_degree=3, min_support=200)
_add("kg_optimized", lambda s, d: pr.optimized(known(s, d), _TARGETS), KNOWN + """, f as (select distinct s, p, o from k), dg as (select e, count(*) n from (select s e from f union all select o from f where s <> o) group by 1),
  th as (select greatest(3, floor(quantile_cont(n, 0.3))) t from dg), a as (select f.* from f where s in (select e from dg, th where n >= t) and o in (select e from dg, th where n >= t))
  select s, p, o from a where p in (select p from a group by p having count(*) >= 200)""")
_add("kg_improvements", lambda s, d: _round9(pr.improvements(known(s, d).select("s", "p", "o").distinct(), pr.filtered(known(s, d).select("s", "p", "o").distinct(), 0.3, 3, 200))), SQL["kg_optimized"].replace("select s, p, o from a where", ", z as (select s, p, o from a where") + """)
  , qa as (select count(*) n, count(distinct p) r from f), qb as (select count(*) n, count(distinct p) r from z), ea as (select count(*) e, avg(n) m from (select count(*) n from (select s e from f union all select o from f) group by e)),
  eb as (select count(*) e, avg(n) m from (select count(*) n from (select s e from z union all select o from z) group by e))
  select round((qb.n / (eb.e::double * eb.e * qb.r)) / (qa.n / (ea.e::double * ea.e * qa.r)), 9) density_ratio, round(eb.m / ea.m, 9) degree_ratio, round(qb.n / qa.n, 9) size_ratio from qa, qb, ea, eb""")
_add("kg_touching", lambda s, d: pr.touching(known(s, d).select("triple_id", "s", "p", "o"), table(s, d, "transe_entity_map").where("entity_type = 'city'").select(F.upper("label").alias("entity"))), KNOWN + ", c as (select upper(label) l from transe_entity_map where entity_type = 'city') select triple_id, s, p, o from k where s in (from c) or o in (from c)")


def _relaxed(s: SparkSession, d: str) -> DataFrame:
    """One row: what is left of the graph when the first settings are too strict for the target, and what augmentation makes of it."""
    t = known(s, d).select("s", "p", "o").distinct()
    n = t.count()
    got = pr.optimized(t, pr.Targets(share=0.05, min_degree=2, min_support=n, triples=n // 4))
    return got.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s", "p", "o").alias("n_distinct")).select((F.col("n") >= n // 4).alias("reached"), (F.col("n") == F.col("n_distinct")).alias("is_set"))


_add("kg_relaxed", _relaxed, "select true reached, true is_set")


def _chain(s: SparkSession, d: str, steps: pr.Steps, least: int) -> None:
    """Split, vocabulary, index, degree filter and quality as a chain of steps."""
    from ..operators.relational import exact_split

    facts = steps.run("facts", lambda: known(s, d).select("s", "p", "o").distinct(), [f"{d}/triples.parquet"])
    kept = steps.run("kept", lambda: g.filter_sparse(facts, least), params={"least": least})
    split = steps.run("split", lambda: exact_split(kept, ["s", "p", "o"]))
    entities = steps.run("entities", lambda: g.vocabulary(g.entity_labels(split)))
    relations = steps.run("relations", lambda: g.vocabulary(split.select(F.col("p").alias("label"))))
    steps.run("indexed", lambda: g.index_triples(split, entities, relations))
    steps.run("rules", lambda: u.learn_paths(split.where("split = 'train'")))
    steps.run("quality", lambda: g.quality(split))


def _chained(s: SparkSession, d: str) -> DataFrame:
    """The chain three times: whole, unchanged, and with a parameter changed: the steps that were skipped, and the rows of all."""
    folder = new_path(s, "chain")
    out = None
    for turn, least in enumerate((3, 3, 2)):
        steps = pr.Steps(s, folder)
        _chain(s, d, steps, least)
        got = steps.report().withColumn("turn", F.lit(turn))
        out = got if out is None else out.unionByName(got)
    return out.where("step not in ('rules')").select("turn", "place", "step", "skipped", "n_rows")


_KEPT = "(select * from f where s in (select e from dg where n >= {0}) and o in (select e from dg where n >= {0}))"
_add("kg_chain", _chained, KNOWN + ", f as (select distinct s, p, o from k), dg as (select e, count(*) n from (select s e from f union all select o from f) group by 1), x3 as " + _KEPT.format(3) + ", x2 as " + _KEPT.format(2) + """,
  w as (select 0 turn, false sk, * from x3 union all select 1, true, * from x3 union all select 2, false, * from x2)
  select turn, 0 place, 'facts' step, turn > 0 skipped, (select count(*) from f) n_rows from w group by turn
  union all select turn, 1, 'kept', turn = 1, count(*) from w group by turn union all select turn, 2, 'split', turn = 1, count(*) from w group by turn
  union all select turn, 3, 'entities', turn = 1, count(distinct e) from (select turn, s e from w union all select turn, o from w) group by turn
  union all select turn, 4, 'relations', turn = 1, count(distinct p) from w group by turn union all select turn, 5, 'indexed', turn = 1, count(*) from w group by turn
  union all select turn, 7, 'quality', turn = 1, 1 from w group by turn""")


def _prepared(s: SparkSession, d: str) -> DataFrame:
    """Rows of the tables of a training, and of its splits."""
    got = pr.prepared(known(s, d), _TARGETS)
    sizes = [got[n].agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n") for n in ("entities", "relations")]
    return sizes[0].unionByName(sizes[1]).unionByName(got["triples"].groupBy(F.col("split").alias("name")).agg(F.count(F.lit(1)).alias("n")))


_add("kg_prepared", _prepared, SQL["kg_optimized"].replace("select s, p, o from a where", ", z as (select s, p, o from a where") + """), c as (select count(*) n from z)
  select 'entities' as name, count(*) n from (select s from z union select o from z) union all select 'relations', count(distinct p) from z
  union all select 'train', floor(n * 0.8)::bigint from c union all select 'valid', floor(n * 0.1)::bigint from c union all select 'test', n - floor(n * 0.8)::bigint - floor(n * 0.1)::bigint from c""")
