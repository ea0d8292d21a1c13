"""Queries of smaller operators: counts, maps, metrics of trials, files, finders, rules of several sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import literals_of
from ..operators import embed as e
from ..operators import finders as fi
from ..operators import maps
from ..operators import metrics as m
from ..operators import oov
from ..operators import relational as r
from ..operators import rules as u
from ..operators import triples as tr
from ..operators import tuning
from ..sources import files
from ..storage import new_path, ship, table
from .problems import _TREE
from .relational import _LEAVES, _LINES
from .scoring import _S, _scores
from .star import KNOWN, known
from .workflow import Workflow, orchestrate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return f(spark, d)

    QUERIES[name] = query
    if sql:
        SQL[name] = sql


# ---- counts and maps
_NAMES = ["hasProduct", "usesService", "nosuch", "livesInCity"]
_add("predicate_counts", lambda s, d: r.predicate_counts(known(s, d), "s", _NAMES), KNOWN + " select s, " + ", ".join(f"count(*) filter (p = '{n}') \"{n}\"" for n in _NAMES) + " from k group by s")
_add("source_counts", lambda s, d: r.counts_by(table(s, d, "triples"), "source"), "select coalesce(source, 'unknown') source, count(*) n from triples group by 1")


def _samples(s: SparkSession, d: str) -> DataFrame:
    t = known(s, d).where("p = 'livesInCity'").withColumn("sample", F.when(F.col("triple_id") % 2 == 0, F.col("s")))
    got = r.group_samples(t, "sample", "triple_id")
    return got.select("sample", F.size("triples").alias("n"), F.array_join(F.transform("triples", lambda x: F.concat_ws(" ", x["s"], x["p"], x["o"])), ";").alias("l"))


_add("group_samples", _samples, KNOWN + " select case when triple_id % 2 = 0 then s else 'row_' || triple_id end sample, count(*)::int n, string_agg(s || ' ' || p || ' ' || o, ';' order by triple_id) l from k where p = 'livesInCity' group by 1")
_add("lookup_strict", lambda s, d: r.lookup_strict(known(s, d).select("triple_id", "p"), "p", table(s, d, "transe_relation_map"), "p_id").select("triple_id", "p_id"), KNOWN + " select triple_id, m.id p_id from k join transe_relation_map m on m.label = k.p")
_add("coerced_map", lambda s, d: r.coerced_map(table(s, d, "transe_entity_map")), "select max(id) id, label from transe_entity_map group by 2")
_add("touched", lambda s, d: r.touched(table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(None).cast("timestamp").alias("updated_at")), table(s, d, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("F").alias("o_orderstatus")), "o_orderkey").select("o_orderkey", "o_orderstatus", F.col("updated_at").isNotNull().alias("moved")),
     "select o_orderkey, case when o_orderkey % 3 = 0 then 'F' else o_orderstatus end o_orderstatus, o_orderkey % 3 = 0 and o_orderstatus <> 'F' moved from orders")

# ---- metrics
_add("all_metrics", lambda s, d: m.all_metrics(_scores(s, d), "score", "cand", "label"), _S + """, r as (select score, label, row_number() over (order by score desc, cand) a, row_number() over (order by label desc, cand) b from s),
  c0 as (select score, sum(label) pos, sum(1 - label) negs from s group by 1), c as (select *, sum(pos) over (order by score desc) tp, sum(negs) over (order by score desc) fp from c0)
  select round(1 / min(a) filter (label = 1), 9) mrr, max(label) filter (a <= 1)::double hits_1, max(label) filter (a <= 3)::double hits_3, max(label) filter (a <= 10)::double hits_10,
    (select round(sum(negs * (tp - pos / 2)) / (sum(pos) * sum(negs)), 9) from c) roc_auc, (select round(sum(pos * tp / (tp + fp)) / sum(pos), 9) from c) average_precision,
    round(sum(label / log2(a + 1)) filter (a <= 10) / sum(label / log2(b + 1)) filter (b <= 10), 9) ndcg_10, round(avg(((score > 0.5)::int = label)::int), 9) accuracy from r""")
_runs = lambda s, d: table(s, d, "part").select("p_partkey", (F.col("p_size") / 10).alias("value"), F.when(F.col("p_partkey") % 7 == 0, "FAIL").otherwise("COMPLETE").alias("state"))
_add("trials", lambda s, d: m.trials(_runs(s, d), "value", "state"), "select count(*) n_trials, count(*) filter (p_partkey % 7 <> 0) n_complete, count(*) filter (p_partkey % 7 = 0) n_failed, max(p_size / 10) best, round(avg(p_size / 10), 9) mean, round(stddev_samp(p_size / 10), 9) std from part")
_add("patience", lambda s, d: m.patience(table(s, d, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 3), """with e as (select user_id, event_id, value, min(value) over w best, row_number() over w n, min(value) over (w rows between unbounded preceding and 1 preceding) b from events window w as (partition by user_id order by event_id)),
  f as (select *, (n - max(case when b is null or value < b then n end) over (partition by user_id order by event_id))::int waited from e)
  select user_id, event_id, value, best, waited, max((waited >= 3)::int) over (partition by user_id order by event_id) = 1 stopped from f""")
_add("raw_rank", lambda s, d: m.raw_rank(_scores(s, d), ["q"], "score", "label"), _S + ", t as (select q, max(score) t from s where label = 1 group by 1) select q, count(*) filter (score > t) + 1 rank from s join t using (q) group by 1")
_add("spread", lambda s, d: m.spread(table(s, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n")), ["l_suppkey"], "l_returnflag", ["A", "N", "R"], "n"), "select l_suppkey, nullif(count(*) filter (l_returnflag = 'A'), 0) \"A\", nullif(count(*) filter (l_returnflag = 'N'), 0) \"N\", nullif(count(*) filter (l_returnflag = 'R'), 0) \"R\" from lineitem group by 1")
_add("experiments", lambda s, d: m.experiments(table(s, d, "telecom_data").where("id <= 50").select("id", F.when(F.col("id") % 5 != 0, F.col("id") % 7).alias("mrr"), "created_at", "updated_at").withColumn("start", F.col("created_at")), "mrr", "id", "id").select("id", "mrr", "place"), "select id, id % 7 mrr, row_number() over (order by id % 7 desc, id)::int place from telecom_data where id <= 50 and id % 5 <> 0")
_add("balance", lambda s, d: m.balance(table(s, d, "region").select("r_regionkey", F.pow(F.lit(2.0), 3 - F.col("r_regionkey")).alias("v")), "r_regionkey", "v"), "select round(8 / sum(v), 9) hybrid, round(1 - 8 / sum(v), 9) symbolic, 'balanced' verdict from (select 2.0::double ** (3 - r_regionkey) v from region)")
_add("squashed", lambda s, d: table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.round(oov.squashed(F.when(F.col("l_linenumber") != 2, F.col("l_quantity") / 10 - 2)), 9).alias("p")), "select l_orderkey * 10 + l_linenumber id, case when l_linenumber = 2 then 0.5 else round(0.8 / (1 + exp(-(l_quantity / 10 - 2))) + 0.1, 9) end p from lineitem")


def _meta(s: SparkSession, d: str) -> DataFrame:
    t = known(s, d).select("triple_id", oov.meta_features(F.col("s"), F.col("p"), F.col("o"), 20).alias("f"))
    return t.select("triple_id", F.size("f").alias("n"), *(F.round(F.col("f")[k], 9).alias(f"f{k}") for k in range(3, 11)), F.forall("f", lambda x: (x >= 0) & (x <= 10)).alias("bounded"))


_add("hybrid_features", _meta, KNOWN + """ select triple_id, 20 n, round(length(s) / 50, 9) f3, round(length(o) / 50, 9) f4, round(length(p) / 30, 9) f5,
  round(len(list_intersect(list_distinct(string_split(s, '')), list_distinct(string_split(o, '')))) / greatest(length(s), length(o), 1), 9) f6, regexp_full_match(s, '[0-9]+')::int::double f7, regexp_full_match(o, '[0-9]+')::int::double f8, (p like 'has%')::int::double f9, (p like 'is%')::int::double f10, true bounded from k""")
_add("vectors_of", lambda s, d: e.vectors_of(table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("label")), table(s, d, "embeddings").where("vec_id >= 10").select(F.col("vec_id").cast("string").alias("label"), F.col("embedding").alias("v"))).select("label", F.size("v").alias("n")), "select n_nationkey::varchar as label, case when vec_id is not null then len(embedding)::int end n from nation left join embeddings on vec_id = n_nationkey and vec_id >= 10")
_add("vector_statistics", lambda s, d: e.statistics(table(s, d, "embeddings").select(F.when(F.col("vec_id") % 10 == 0, "relation").otherwise("entity").alias("kind"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))), "select count(*) filter (vec_id % 10 <> 0) n_entities, count(*) filter (vec_id % 10 = 0) n_relations, max(len(embedding))::int dim, sum(len(embedding))::bigint n_numbers from embeddings")

# ---- finders in nested enquiries
_add("find_contracts", lambda s, d: fi.find_contracts(table(s, d, "telecom_data"), "id", "data", {"paymentContext": "Pospago"}),
     _TREE + r"select e.id doc_id, regexp_extract(path, '[[](\d+)[]]', 1)::int place, value->>'$.id' contract_id, (select count(*) from e x where x.id = e.id and x.type = 'OBJECT' and regexp_matches(x.path, '[.]product([[]\d+[]])?$') and regexp_replace(x.path, '[.]product([[]\d+[]])?$', '') = e.path)::int n_products from e where type = 'OBJECT' and regexp_full_match(path, 'contract([[]\d+[]])?') and value->>'$.paymentContext' = 'Pospago'")
_PRODUCTS = _TREE + r"""
, p as (select id, path, value v, regexp_extract(path, 'contract[[](\d+)[]]', 1)::int contract, regexp_extract(path, 'product[[](\d+)[]]', 1)::int place from e where type = 'OBJECT' and regexp_full_match(path, 'contract[[]\d+[]][.]product[[]\d+[]]')),
st as (select id, regexp_replace(path, '[.]status([[]\d+[]])?$', '') owner, case when type = 'OBJECT' then value->>'$.status' else atom->>'$' end status from e where regexp_matches(path, '[.]status([[]\d+[]])?$') and (type = 'OBJECT' or type = 'VARCHAR' and path like '%.status'))
"""
_add("find_products", lambda s, d: fi.find_products(table(s, d, "telecom_data"), "id", "data", {"name": "Voz Local"}, "ItemOn").select("doc_id", "contract", "place", "product_id", "name"),
     _PRODUCTS + "select id doc_id, contract, place, v->>'$.id' product_id, v->>'$.name' as name from p where v->>'$.name' = 'Voz Local' and exists (select 1 from st where st.id = p.id and st.owner = p.path and st.status = 'ItemOn')")
_add("extract_products", lambda s, d: fi.find_products(table(s, d, "telecom_data"), "id", "data", None, "all").select("doc_id", "contract", "place", "product_id", "name"), _PRODUCTS + "select id doc_id, contract, place, v->>'$.id' product_id, v->>'$.name' as name from p")

# ---- rules of several sources
_mined = lambda s, d: table(s, d, "part").select(F.concat(F.lit(" big("), "p_brand", F.lit(", "), F.col("p_size").cast("string"), F.lit(") <= b(X,Y)")).alias("rule"), (F.col("p_size") / 64).alias("confidence"), F.lit("mined").alias("source"))
_manual = lambda s, d: table(s, d, "nation").select(F.concat(F.lit("big(Brand#1"), F.col("n_regionkey").cast("string"), F.lit(", "), F.col("n_nationkey").cast("string"), F.lit(") <= b(X,Y) ")).alias("rule"), F.lit(0.5).alias("confidence"), F.lit("manual").alias("source"))
_RULES = "with x as (select 'big(' || p_brand || ', ' || p_size || ') <= b(X,Y)' as rule, p_size / 64 confidence, 'mined' source, 0 i from part union all select 'big(Brand#1' || n_regionkey || ', ' || n_nationkey || ') <= b(X,Y)', 0.5, 'manual', -1 from nation)"
_add("rules_combined", lambda s, d: u.combined([_mined(s, d), _manual(s, d)]), _RULES + " select rule, max(confidence) confidence, arg_max(source, (confidence, i)) source, count(distinct source) n_sources from x group by 1")
_add("rule_head_triples", lambda s, d: u.head_triples(u.combined([_mined(s, d), _manual(s, d)])), _RULES + " select distinct regexp_extract(rule, '[(]([^,]+), ', 1) s, 'big' p, regexp_extract(rule, ', ([0-9]+)[)]', 1) o from x")
_add("rule_phase", lambda s, d: s.createDataFrame([(a, b, c, u.phase(bool(a), bool(b), bool(c))) for a in (0, 1) for b in (0, 1) for c in (0, 1)], "model int, mined int, combined int, phase string"), "select a::int model, b::int mined, c::int combined, case when a = 0 then 'bootstrap' when c = 1 then 'refinement' else 'hybrid' end phase from range(2) x(a), range(2) y(b), range(2) z(c)")

# ---- files


def _lines(s: SparkSession, d: str) -> DataFrame:
    """The rule lines with sentinel dates, by file and number."""
    path = new_path(s, "rules") + ".txt"
    table(s, d, "orders").orderBy("o_orderkey").limit(500).select(F.concat_ws("\t", F.lit("1"), F.lit("1"), F.lit("0.5"), F.concat(F.lit("at(A,"), F.when(F.col("o_orderkey") % 50 == 0, "1970-01-01").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit(")"))).alias("value")).coalesce(1).write.text(path)
    return files.lines_with(files.numbered_lines(s, path)).select("line", "text")


_add("sentinel_lines", _lines, "select rn::int line, '1' || chr(9) || '1' || chr(9) || '0.5' || chr(9) || 'at(A,1970-01-01)' as text from (select o_orderkey, row_number() over (order by o_orderkey) rn from orders) where rn <= 500 and o_orderkey % 50 = 0")


def _json_lines(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "lines") + ".txt"
    table(s, d, "nation").orderBy("n_nationkey").select(F.when(F.col("n_nationkey") % 5 == 0, F.lit("{cut off")).otherwise(F.to_json(F.struct("n_nationkey", "n_name"))).alias("value")).coalesce(1).write.text(path)
    return files.json_lines(files.numbered_lines(s, path), "n_nationkey long, n_name string").select("line", "v.n_nationkey", "v.n_name", F.col("error").isNotNull().alias("bad"))


_add("json_lines", _json_lines, "select (n_nationkey + 1)::int line, case when n_nationkey % 5 <> 0 then n_nationkey end n_nationkey, case when n_nationkey % 5 <> 0 then n_name end n_name, n_nationkey % 5 = 0 bad from nation")


def _logs(s: SparkSession, d: str) -> DataFrame:
    """Log lines of all shapes, made from the events."""
    k, t = F.col("event_id") % 4, F.col("event_type")
    record = F.to_json(F.struct(t.alias("text"), F.struct(F.struct(F.concat(F.lit("Thread-"), F.col("user_id")).alias("name")).alias("thread"), F.struct(F.col("user_id").cast("string").alias("msisdn")).alias("extra")).alias("record")))
    bars = F.concat(F.lit("10:00 | INFO | Thread-7 | ["), F.col("user_id"), F.lit("] "), t)
    lines = table(s, d, "events").select("event_id", F.when(k == 0, record).when(k == 1, bars).when(k == 2, F.lit("# header")).otherwise(t).alias("line"))
    return files.log_parts(lines, "line").select("event_id", "thread", "msisdn", "message")


_add("log_parts", _logs, """select event_id, case event_id % 4 when 0 then 'Thread-' || user_id when 1 then 'Thread-7' else '_meta' end thread, case when event_id % 4 < 2 then user_id::varchar end msisdn,
  case event_id % 4 when 1 then '10:00 | INFO | Thread-7 | [' || user_id || '] ' || event_type when 2 then '# header' else event_type end message from events""")


def _cached(s: SparkSession, d: str) -> DataFrame:
    folder = new_path(s, "cache")
    assert files.load_cached(s, folder, "nations") is None
    files.save_cached(table(s, d, "nation").select("n_nationkey", "n_name"), folder, "nations")
    return files.load_cached(s, folder, "nations")


_add("cached_frame", _cached, "select n_nationkey, n_name from nation")


def _documents(s: SparkSession, d: str) -> DataFrame:
    """A table as JSON documents, and read again."""
    path = new_path(s, "nations") + ".json"
    files.write(table(s, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("n_name")), path, files=1)
    return files.read(s, path).select(F.explode(F.from_json("data", "array<struct<n_nationkey:long,n_name:string>>")).alias("v")).select("v.*")


_add("file_json", _documents, "select n_nationkey::bigint n_nationkey, case when n_nationkey % 2 = 0 then n_name end n_name from nation")
_add("file_bytes", lambda s, d: files.read_bytes(s, b"k;name\n1;Ana\n2;\n", ".csv").unionByName(files.read_bytes(s, b'{"k": "3", "name": "Z"}\n', ".jsonl")), "select * from (values ('1', 'Ana'), ('2', ''), ('3', 'Z')) x(k, name)")


def _mixed(s: SparkSession, d: str) -> DataFrame:
    """A folder whose files are all below it: their texts with relative paths."""
    path = new_path(s, "mixed")
    nation = table(s, d, "nation").select(F.col("n_name").alias("value"), (F.col("n_regionkey") % 2).alias("part"))
    nation.where("part = 0").orderBy("value").select("value").coalesce(1).write.text(f"{path}/a")
    nation.where("part = 1").orderBy("value").select("value").coalesce(1).write.text(f"{path}/b")
    got = files.read_folder(s, path).where(F.col("path").endswith(".txt"))
    return got.select(F.substring_index("path", "/", 1).alias("folder"), F.explode(F.split(F.rtrim(F.regexp_replace("text", r"\n+$", "")), "\n")).alias("n_name"))


_add("file_folder", _mixed, "select case when n_regionkey % 2 = 0 then 'a' else 'b' end folder, n_name from nation")
_add("literals", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(literals_of(F.concat(F.lit("h(A,'"), "p_type", F.lit("') <= b(A,\""), "p_brand", F.lit('")'))), "|").alias("l")), "select p_partkey, p_type || '|' || p_brand l from part")


# ---- manifests
def _orchestrated(s: SparkSession, d: str) -> DataFrame:
    """The tasks of a manifest, one of which fails."""
    methods = {"orders": lambda status: table(s, d, "orders").where(F.col("o_orderstatus") == status), "fail": lambda: 1 // 0}
    flow = Workflow(s, {"count": [{"method": "orders", "args": {"status": "{{ status }}"}, "save_as": "result"}], "bad": [{"method": "fail"}]}, methods)
    tasks = [{"msisdn": 1, "sequence": "count", "payload": {"status": "F"}}, {"msisdn": "2", "sequence": "bad"}, {"msisdn": 3, "sequence": "count", "payload": {"status": "O"}}]
    return orchestrate(s, {"execution_id": "e", "tasks": tasks}, flow)


_add("orchestrated", _orchestrated, """select 'e' execution_id, '1' msisdn, 'count' as sequence, true ok, count(*)::varchar result from orders where o_orderstatus = 'F'
  union all select 'e', '2', 'bad', false, 'ZeroDivisionError: integer division or modulo by zero' union all select 'e', '3', 'count', true, count(*)::varchar from orders where o_orderstatus = 'O'""")


# ---- building, searching, ingesting
_member = lambda s, d: table(s, d, "documents").select(F.concat(F.lit("m"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("member"), "text")
_MEMBER = "'m' || lpad(doc_id::varchar, 9, '0')"
_add("kg_build", lambda s, d: tr.build(_member(s, d), "member", "text"), _LINES.replace("'document_' || doc_id", _MEMBER).replace("select doc_id, line, s, p, o from said", f"select {_MEMBER} as member, line, s, p, o from said"))
_add("kg_build_first", lambda s, d: tr.build(_member(s, d), "member", "text", 20).groupBy("member").agg(F.count(F.lit(1)).alias("n")), _LINES.replace("select doc_id, line, s, p, o from said", f", q as (select doc_id from documents order by doc_id limit 20) select {_MEMBER} as member, count(*) n from said").replace("where ok\n", "where ok and doc_id in (from q) group by 1\n"))


def _searched(s: SparkSession, d: str) -> DataFrame:
    """A grid of two parameters over the orders; one setting fails."""
    o = table(s, d, "orders")
    objective = lambda least, divisor: o.where(F.col("o_totalprice") >= least * 1000).count() // divisor
    runs = tuning.search(s, objective, tuning.grid({"least": [100, 200], "divisor": [1, 0, 2]}))
    return runs.select("trial", "params", "value", "state")


_add("searched", _searched, """select (i * 3 + j)::int trial, '{"divisor": ' || v || ', "least": ' || l || '}' params, case when v > 0 then (select count(*) from orders where o_totalprice >= l * 1000) // v end::double as value, case when v > 0 then 'COMPLETE' else 'FAIL' end state
  from (values (0, 100), (1, 200)) a(i, l), (values (0, 1), (1, 0), (2, 2)) b(j, v)""")


def _compared(s: SparkSession, d: str) -> DataFrame:
    """Three scores as models, by their area under the curve; one can't be evaluated."""
    base = _scores(s, d)
    models = {"both": lambda: base, "noise": lambda: base.withColumn("score", F.pmod(F.col("cand") * 7919, F.lit(1000)) / 1000.0), "broken": lambda: base.drop("score")}
    return tuning.compared(s, models, lambda rows: m.roc_auc(rows, "score", "label"), "roc_auc").select("name", "roc_auc", F.col("error").isNotNull().alias("failed"))


_AUC = "(select round(sum(negs * (tp - pos / 2)) / (sum(pos) * sum(negs)), 9) from (select *, sum(pos) over (order by score desc) tp, sum(negs) over (order by score desc) fp from (select {0} score, sum(label) pos, sum(1 - label) negs from s group by 1)))"
_add("compared", _compared, _S + f" select 'both' as name, {_AUC.format('score')} roc_auc, false failed union all select 'noise', {_AUC.format('(cand * 7919) % 1000 / 1000.0')}, false union all select 'broken', null, true")


def _ingested(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "telecom_data")
    none = s.createDataFrame([], "s string, p string, o string, confidence double")
    return tuning.ingested(docs.where("id % 2 = 0"), none, docs.where("id % 2 = 1"), "msisdn", ["updated_at", "id"], "id", "data")[2]


_add("ingested", _ingested, _LEAVES + " select 'documents' tab, count(distinct coalesce(msisdn, 'null')) n from telecom_data union all select 'triples', count(distinct (doc_id, p, o)) from f where doc_id % 2 = 1 and o is not null")


# ---- functions of one's own
def _root(row: dict) -> float:
    if row["n_nationkey"] % 7 == 3:
        raise ValueError("no")
    return float(row["n_nationkey"]) ** 2


_add("mapped", lambda s, d: maps.mapped(table(s, d, "nation").select("n_nationkey", "n_name"), ["n_name"], _root, "double"), "select row_number() over (order by encode(n_name)) - 1 place, case when n_nationkey % 7 <> 3 then n_nationkey::double ** 2 end result, case when n_nationkey % 7 = 3 then 'ValueError: no' end error from nation")
_BEST = {"upper": lambda row: row["n_name"].upper() if row["n_nationkey"] % 2 else None, "short": lambda row: row["n_name"][: row["n_nationkey"]], "fails": lambda row: 1 // 0}
_add("best_of", lambda s, d: maps.best_of(table(s, d, "nation").select("n_nationkey", "n_name"), "n_nationkey", _BEST, len), """select n_nationkey, case when n_nationkey % 2 = 1 and length(n_name) >= length(n_name[:n_nationkey]) then 'upper' else 'short' end as name,
  case when n_nationkey % 2 = 1 then upper(n_name) else n_name[:n_nationkey] end result, case when n_nationkey % 2 = 1 then length(n_name) else length(n_name[:n_nationkey]) end::double rank from nation""")


def _registered(s: SparkSession, d: str) -> DataFrame:
    """Functions of rows, of groups and of tables, in SQL."""
    maps.register(s, "tf_twice", lambda x: 2 * x, "long")
    maps.register(s, "tf_span", lambda v: float(v.max() - v.min()), "double", aggregate=True)
    maps.register_rows(s, "tf_upto", lambda n: ((k,) for k in range(n)), "k int")
    table(s, d, "nation").createOrReplaceTempView("tf_nations")
    return s.sql("select n_regionkey, k, tf_span(cast(tf_twice(n_nationkey) as double)) span from tf_nations, tf_upto(2) group by 1, 2")


_add("registered", _registered, "select n_regionkey, k::int k, 2 * (max(n_nationkey) - min(n_nationkey))::double span from nation, range(2) x(k) group by 1, 2")


def _ensured(s: SparkSession, d: str) -> DataFrame:
    """The flattened documents, made once and read twice."""
    folder, docs = new_path(s, "flat"), table(s, d, "telecom_data")
    first = tr.ensured(docs, "id", "data", folder).agg(F.count(F.lit(1)).alias("first"))
    return first.crossJoin(tr.ensured(docs, "id", "data", folder).agg(F.count(F.lit(1)).alias("again")))


_add("ensured", _ensured, _LEAVES + " select count(*) as first, count(*) again from f")


def _splits(s: SparkSession, d: str) -> DataFrame:
    """The splits in a folder, one of them optimised."""
    folder, t = new_path(s, "splits"), known(s, d).select("s", "p", "o", "split")
    for name in ("train", "test"):
        t.where(F.col("split") == name).write.parquet(f"{folder}/{name}.parquet")
    t.where("split = 'train' and p = 'hasProduct'").write.parquet(f"{folder}/train_optimized.parquet")
    parts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in files.read_splits(s, folder).items()]
    return parts[0].unionByName(parts[1])


_add("read_splits", _splits, KNOWN + " select 'train' as name, count(*) n from k where split = 'train' and p = 'hasProduct' union all select 'test', count(*) from k where split = 'test'")
