"""Queries of the graph operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..operators import relational as r
from ..storage import table
from .star import KNOWN, STAR, known, star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        SQL[name] = sql


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 12).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


_DEG = ", d as (select e entity, count(*) degree from (select s e from k union all select o from k) group by 1)"
_DEGR = ", d as (select e entity, count(*) degree from (select s e from k union all select o from k where s <> o) group by 1)"


def _quality_sql(deg: str, pairs: str) -> str:
    return KNOWN + deg + f""", q as (select count(*) n_entities, round(avg(degree), 12) mean_degree, round(quantile_cont(degree, 0.5), 12) median_degree, min(degree) min_degree, max(degree) max_degree,
      count(*) filter (degree < 3) n_low_degree from d), r as (select count(*) n_relations, sum(n)::bigint n_triples, count(*) filter (n < 50) n_rare_relations from (select count(*) n from k group by p))
    select q.*, r.*, round(n_triples / ({pairs} * n_relations), 12) density from q, r"""


_add("kg_quality", lambda s, d: _rounded(g.quality(known(s, d))), _quality_sql(_DEG, "(n_entities::double * n_entities)"))
_add("kg_quality_rows", lambda s, d: _rounded(g.quality(known(s, d), loops_apart=True)), _quality_sql(_DEGR, "(n_entities::double * (n_entities - 1))"))
_add("degree", lambda s, d: g.degree(known(s, d)), KNOWN + _DEG + " select * from d")
_add("degree_rows", lambda s, d: g.degree_rows(known(s, d)), KNOWN + _DEGR + " select * from d")
_add("relation_support", lambda s, d: g.relation_support(star(s, d), 50), STAR + " select p, count(*) support from t group by 1 having count(*) >= 50")
_add("top_relations", lambda s, d: g.relation_support(star(s, d)).orderBy(F.desc("support"), "p").limit(10), STAR + " select p, count(*) support from t group by 1 order by 2 desc, 1 limit 10")
_ROWS = ["triple_id", "s", "p", "o"]
_sel = "select triple_id, s, p, o from k where"
_add("filter_sparse", lambda s, d: g.filter_sparse(known(s, d)).select(*_ROWS), KNOWN + _DEG + f", e as (select entity from d where degree >= 3) {_sel} s in (from e) and o in (from e)")
_add("balance_relations", lambda s, d: g.balance_relations(known(s, d), 1000).select(*_ROWS), KNOWN + f" {_sel} p in (select p from k group by 1 having count(*) >= 1000)")
_add("percentile_filter", lambda s, d: g.percentile_filter(known(s, d), 0.6).select(*_ROWS), KNOWN + _DEGR + f", e as (select entity from d where degree >= (select greatest(2, floor(quantile_cont(degree, 0.6))) from d)) {_sel} s in (from e) and o in (from e)")
_add("homogenize", lambda s, d: g.homogenize(star(s, d), 0.1), STAR + """, n as (select p, count(*) support from t group by 1), h as (select greatest(1, floor(count(*) * 0.1)) th from t)
  select s, p, case when o like '1970-01-01%' or o like '9999-12-31%' then 'SPECIAL_DATE' when regexp_matches(o, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') then o[1:4] when support > th then p || '_CATEGORY' else o end o from t join n using (p), h""")
_add("vocab_entities", lambda s, d: g.vocabulary(g.entity_labels(known(s, d))), KNOWN + " select row_number() over (order by label) - 1 id, label from (select s as label from k union select o from k)")
_add("vocab_relations", lambda s, d: g.vocabulary(star(s, d).select(F.col("p").alias("label"))), STAR + " select row_number() over (order by label) - 1 id, label from (select distinct p as label from t)")


def _index(s: SparkSession, d: str) -> DataFrame:
    t = known(s, d)
    return g.index_triples(t, g.vocabulary(g.entity_labels(t)), g.vocabulary(t.select(F.col("p").alias("label"))))


_add("index_triples", _index, KNOWN + ", e as (select row_number() over (order by l) - 1 id, l from (select s l from k union select o from k)), r as (select row_number() over (order by l) - 1 id, l from (select distinct p l from k)) select a.id s_id, r.id p_id, b.id o_id from k join e a on a.l = s join e b on b.l = o join r on r.l = p")


def _merge(s: SparkSession, d: str) -> DataFrame:
    labels = lambda n: table(s, d, n).select(F.col(f"{n[0]}_name").alias("label"))
    return g.merge_vocabularies([labels("region"), labels("nation")])


_add("merge_vocab", _merge, "select row_number() over (order by label) - 1 id, label from (select r_name as label from region union select n_name from nation)")


def _extend(s: SparkSession, d: str) -> DataFrame:
    own = table(s, d, "transe_relation_map").select("id", F.col("label"))
    return g.extend_vocabulary(own, star(s, d).select(F.col("p").alias("label")))


_add("extend_vocab", _extend, STAR + " select id, label from transe_relation_map union all select (select max(id) from transe_relation_map) + row_number() over (order by p), p from (select distinct p from t where p not in (select label from transe_relation_map))")
_add("validate_map", lambda s, d: g.validate_map(table(s, d, "transe_entity_map")), "select *, min_id = 0 and max_id = n - 1 and n_ids = n is_dense, n_labels = n is_unique from (select count(*) n, min(id) min_id, max(id) max_id, count(distinct id) n_ids, count(distinct label) n_labels from transe_entity_map)")
_LOOP = ", g as (select distinct 'n' || c_nationkey s, 'trades' p, 'n' || s_nationkey o from customer, supplier where c_custkey % 7 = s_suppkey % 7 union select distinct 'n' || s_nationkey, 'trades', 'n' || c_nationkey from customer, supplier where c_custkey % 7 = s_suppkey % 7 and c_custkey % 3 = 0 union select distinct 'n' || n_nationkey, 'in', 'r' || n_regionkey from nation)"


def _trade(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("a"), (F.col("c_custkey") % 7).alias("k"), (F.col("c_custkey") % 3 == 0).alias("both")).distinct()
    x = table(s, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("b"), (F.col("s_suppkey") % 7).alias("k")).distinct()
    pairs = c.join(x, "k")
    there = pairs.select(F.col("a").alias("s"), F.lit("trades").alias("p"), F.col("b").alias("o"))
    back = pairs.where("both").select(F.col("b").alias("s"), F.lit("trades").alias("p"), F.col("a").alias("o"))
    nations = table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("s"), F.lit("in").alias("p"), F.concat(F.lit("r"), "n_regionkey").alias("o"))
    return there.union(back).union(nations).distinct()


_INV = ", i as (select a.p, count(*) n, count(b.p) n_inverse, round(count(b.p) / count(*), 12) share from g a left join g b on a.s = b.o and a.o = b.s and a.p = b.p group by 1)"
_add("symmetric_relations", lambda s, d: _rounded(g.inverse_share(_trade(s, d))), "with z as (select 1)" + _LOOP + _INV + " select * from i")
_add("inverse_augment", lambda s, d: g.augment_inverse(_trade(s, d), 0.5), "with z as (select 1)" + _LOOP + _INV + " select o s, p, s o from g where p in (select p from i where share > 0.5) and not exists (select 1 from g b where b.s = g.o and b.o = g.s and b.p = g.p)")
_TYPE = "upper(split_part({0}, '_', 1)[1:1]) || lower(split_part({0}, '_', 1)[2:])"
_PFX = "case when {0} like 'product\\_%' escape '\\' then 'Product' when {0} like 'char\\_%' escape '\\' then 'Characteristic' when {0} like 'offer\\_%' escape '\\' then 'Offer' when {0} like 'status\\_%' escape '\\' then 'Status' when {0} like 'date\\_%' escape '\\' then 'Date' when {0} like 'id\\_%' escape '\\' then 'Identifier' else " + _TYPE + " end"
_add("entity_types", lambda s, d: g.type_counts(star(s, d)), STAR + f" select {_PFX.format('e')} as type, count(*) n from (select s e from t union select o from t) group by 1")
_MODE = f", ty as (select p, {_PFX.format('s')} h, {_PFX.format('o')} tl from t), hm as (select p, h head_type from (select p, h, row_number() over (partition by p order by count(*) desc, h) rn from ty group by p, h) where rn = 1), tm as (select p, tl tail_type from (select p, tl, row_number() over (partition by p order by count(*) desc, tl) rn from ty group by p, tl) where rn = 1), rt as (select p, head_type, tail_type from hm join tm using (p))"
_add("relation_types", lambda s, d: g.relation_types(star(s, d)), STAR + _MODE + " select * from rt")
_add("meta_edges", lambda s, d: g.meta_edges(star(s, d).union(_trade(s, d))), STAR.replace("with t as (", "with z as (select 1)" + _LOOP + ", t as (select s, p, o from g union all ") + _MODE + ", e as (select distinct head_type as domain, p relation, tail_type as range from rt) select * from e union all select domain, relation || '_inv', range from e where domain = range")


def _paths_sql(hops: int) -> str:
    joins = "".join(f" join u t{i} on t{i}.s = t{i - 1}.o" for i in range(1, hops))
    text = " || ' ' || ".join([_PFX.format("t0.s")] + [f"t{i}.p || ' ' || {_PFX.format(f't{i}.o')}" for i in range(hops)])
    return STAR + f", u as (select distinct s, p, o from t) select {text} path, count(*)::bigint n from u t0{joins} group by 1"


_add("meta_paths_2", lambda s, d: g.meta_paths(star(s, d), 2), _paths_sql(2))
_add("meta_paths_3", lambda s, d: g.meta_paths(star(s, d), 3), _paths_sql(3))
_add("shortest_hops", lambda s, d: g.shortest_hops(star(s, d), table(s, d, "supplier").select(F.concat(F.lit("supplier_"), "s_suppkey").alias("entity"))), STAR + """
  , e as (select distinct s, o from t), h0 as (select 'supplier_' || s_suppkey as "start", 'supplier_' || s_suppkey entity from supplier),
  h1 as (select distinct "start", o entity from h0 join e on e.s = entity), h2 as (select distinct "start", o entity from h1 join e on e.s = entity), h3 as (select distinct "start", o entity from h2 join e on e.s = entity)
  select "start", entity, min(hop)::int hop from (select *, 0 hop from h0 union all select *, 1 from h1 union all select *, 2 from h2 union all select *, 3 from h3) group by all""")
_SPL = ", tr as (select * from k where split = 'train'), ot as (select * from k where split in ('valid', 'test')), te as (select s e from tr union select o from tr)"


def _sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = known(s, d)
    return k.where("split = 'train'"), k.where("split in ('valid', 'test')")


_add("orphan_filter", lambda s, d: g.orphan_filter(*_sides(s, d)).select(*_ROWS), KNOWN + _SPL + " select triple_id, s, p, o from ot where s in (from te) and o in (from te)")
_add("orphan_entities", lambda s, d: g.orphan_entities(*_sides(s, d)), KNOWN + _SPL + " select distinct e as label from (select s e from ot union select o from ot) where e not in (from te)")
_add("split_overlap", lambda s, d: g.split_overlap(known(s, d)), KNOWN + ", u as (select distinct s, p, o, split from k where split is not null) select a.split a, b.split b, count(*) n from u a join u b on a.s = b.s and a.p = b.p and a.o = b.o and a.split < b.split group by all")
_add("find_entity", lambda s, d: g.presence(known(s, d), table(s, d, "transe_entity_map").where("entity_type = 'offering'").select(F.upper("label").alias("label")).distinct()), KNOWN + ", l as (select distinct upper(label) as label from transe_entity_map where entity_type = 'offering'), u as (select split, s e, triple_id from k union select split, o, triple_id from k) select l.label, split, count(split) n from l left join u on e = l.label group by all")
_add("unmapped_entities", lambda s, d: g.unmapped(known(s, d), table(s, d, "transe_entity_map").select(F.upper("label").alias("label")).distinct()), KNOWN + " select e entity, count(*) n_rows from (select s e from k union all select o from k where s <> o) where e not in (select upper(label) from transe_entity_map) group by 1")
_H = "md5('42|' || o_orderkey::varchar)"
_keys = lambda s, d: table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"))
_add("split_exact", lambda s, d: r.exact_split(_keys(s, d), ["k"]), f"select k, case when rn < n8 then 'train' when rn < n8 + n1 then 'valid' else 'test' end split from (select o_orderkey::varchar k, row_number() over (order by {_H}, o_orderkey::varchar) - 1 rn from orders), (select floor(count(*) * 0.8) n8, floor(count(*) * 0.1) n1 from orders)")
_add("sample_exact", lambda s, d: r.exact_sample(_keys(s, d), ["k"], 100), f"select o_orderkey::varchar k from orders order by {_H}, 1 limit 100")
_add("chunks", lambda s, d: r.chunked(_keys(s, d), ["k"], 128).groupBy("chunk").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count(F.lit(1)).alias("n")), "select (rn // 128)::bigint chunk, min(k) as first, max(k) as last, count(*) n from (select o_orderkey::varchar k, row_number() over (order by o_orderkey::varchar) - 1 rn from orders) group by 1")


def _negatives(s: SparkSession, d: str) -> DataFrame:
    t = known(s, d)
    return g.corrupt(t, g.vocabulary(g.entity_labels(t)), 2)


_add("negative_samples", _negatives, KNOWN + """, f as (select distinct s, p, o from k), e as (select row_number() over (order by l) - 1 id, l from (select s l from k union select o from k)),
  h as (select f.*, md5(concat_ws('|', 42, s, p, o, i)) h from f, range(1, 3) x(i)), c as (select s, p, o, ('0x' || h[1:15])::bigint % (select count(*) from e) id, h[16] < '8' head from h),
  m as (select case when head then l else s end s, p, case when head then o else l end o from c join e using (id)) select s, p, o from m anti join f using (s, p, o)""")
