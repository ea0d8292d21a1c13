"""Queries of the relational, triple and document operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import capitalized, is_upper, msisdn_of, normalized_url
from ..operators import relational as r
from ..operators import triples as tr
from ..storage import new_path, ship, table
from ..sources import files
from .star import KNOWN, STAR, W, key, known, star

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return f(spark, d)

    QUERIES[name] = query
    if sql:
        SQL[name] = sql


_CRIT = {"c_mktsegment": ["BUILDING", "MACHINERY"], "c.acctbal": {"gte": 0, "lt": 5000, "unknown": 1}, "c_name": {"contains": "[02468]$"}}
_add("criteria_filter", lambda s, d: r.search(table(s, d, "customer"), _CRIT).select("c_custkey", "c_mktsegment"), "select c_custkey, c_mktsegment from customer where c_mktsegment in ('BUILDING', 'MACHINERY') and c_acctbal >= 0 and c_acctbal < 5000 and regexp_matches(c_name, '[02468]$')")
_add("criteria_ops", lambda s, d: r.search(table(s, d, "part"), {"p_brand": {"startswith": "Brand#1", "ne": "Brand#11"}, "p_type": {"endswith": "S"}, "p_size": {"gt": 5, "lte": 30}}).select("p_partkey"), "select p_partkey from part where p_brand like 'Brand#1%' and p_brand <> 'Brand#11' and p_type like '%S' and p_size > 5 and p_size <= 30")
_add("search_limit", lambda s, d: r.search(table(s, d, "nation"), {}, 7).agg(F.count(F.lit(1)).alias("n")), "select 7::bigint n")
_add("pattern_match", lambda s, d: r.match_patterns(star(s, d), {"status": "F", "segment": "*", "*": "nation_3"}), STAR + " select * from t where p = 'status' and o = 'F' union all select * from t where p = 'segment' union all select * from t")
_LOOK = [("order_1", None, None), (None, "segment", None), (None, None, "nation_3"), ("customer_1", "segment", None), (None, "in_nation", "nation_3"), ("nation_3", None, "region_1"), ("nation_3", "in_region", "region_1")]


def _lookups(s: SparkSession, d: str) -> DataFrame:
    t, out = star(s, d), None
    for i, (a, b, c) in enumerate(_LOOK):
        one = r.lookup(t, a, b, c).withColumn("q", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


_add("triple_lookup", _lookups, STAR + " " + " union all ".join(f"select distinct s, p, o, {i} q from t where " + " and ".join(f"{n} = '{v}'" for n, v in zip("spo", x) if v) for i, x in enumerate(_LOOK)))
_add("union_diagonal", lambda s, d: r.union_diagonal([table(s, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("region"))]), "select r_regionkey k, r_name as name, null::int region from region union all select n_nationkey, null, n_regionkey from nation")
_add("union_distinct", lambda s, d: known(s, d).select("s", "p", "o").dropDuplicates(["s", "p", "o"]), KNOWN + " select distinct s, p, o from k")
_add("set_intersect", lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("n")).intersect(table(s, d, "supplier").select("s_nationkey")), "select c_nationkey n from customer intersect select s_nationkey from supplier")
_add("set_except", lambda s, d: table(s, d, "part").select(F.col("p_partkey").alias("k")).subtract(table(s, d, "lineitem").select("l_partkey")), "select p_partkey k from part except select l_partkey from lineitem")
_add("upsert_latest", lambda s, d: r.upsert_latest(table(s, d, "telecom_data").where("id % 2 = 0"), table(s, d, "telecom_data").where("id % 2 = 1"), "msisdn", ["updated_at", "id"]).select("msisdn", "id"), "select msisdn, id from (select msisdn, id, row_number() over (partition by msisdn order by id % 2 desc, updated_at desc nulls last, id desc) rn from telecom_data) where rn = 1")
_add("upsert_greatest", lambda s, d: r.upsert_greatest(known(s, d).where("split = 'train'"), known(s, d).where("split <> 'train'")), KNOWN + " select s, p, o, max(confidence) confidence from k where split is not null group by 1, 2, 3")
def _checks():
    return {"confidence": F.col("confidence").between(0, 1), "split": F.col("split").isin("train", "valid", "test"), "s": F.col("s").isNotNull(), "p": F.col("p").isNotNull(), "source": F.col("source").isin("crm", "billing", "inferred", "ingestion_zip", "manual"), "late": F.col("ingested_at") <= F.col("created_at") + F.expr("interval 7 days")}


_add("constraint_checks", lambda s, d: r.violations_of(table(s, d, "triples"), _checks()).select("triple_id", F.array_join("broken", ",").alias("broken")), """select triple_id, broken from (select triple_id, concat_ws(',', case when not (confidence between 0 and 1) then 'confidence' end, case when split not in ('train','valid','test') then 'split' end, case when s is null then 's' end, case when p is null then 'p' end,
  case when source not in ('crm','billing','inferred','ingestion_zip','manual') then 'source' end, case when not (ingested_at <= created_at + interval 7 day) then 'late' end) broken from triples) where broken <> ''""")
_add("msisdn_check", lambda s, d: r.violations_of(table(s, d, "telecom_data"), {"msisdn": F.col("msisdn").rlike("^[0-9]{10,15}$")}).select("id"), "select id from telecom_data where not regexp_full_match(msisdn, '[0-9]{10,15}')")
_add("duplicate_keys", lambda s, d: r.duplicates(table(s, d, "telecom_data"), ["msisdn"]), "select msisdn, count(*) n from telecom_data group by 1 having count(*) > 1")
_add("cascade_delete", lambda s, d: r.cascade(table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "customer").where("c_acctbal < 0"), "o_custkey", "c_custkey").select("o_orderkey"), "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)")
_add("rank_ordinal", lambda s, d: r.ranked(table(s, d, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey").select("o_orderkey", "rank"), "select o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int rank from orders")
_add("rolling_mean", lambda s, d: r.rolling_mean(table(s, d, "events"), ["user_id"], ["ts", "event_id"], "value", 5, "m").select("event_id", F.round("m", 6).alias("m")), "select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 4 preceding and current row), 6) m from events")
_add("best_so_far", lambda s, d: r.best_so_far(table(s, d, "events"), ["user_id"], ["event_id"], "value").select("event_id", "best", "best_at"), "select event_id, max(value) over w best, arg_max(event_id, {'v': value, 'e': -event_id}) over w best_at from events window w as (partition by user_id order by event_id rows unbounded preceding)")
_add("sse_changes", lambda s, d: r.changes(table(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id"), "select event_id from (select event_id, event_type, lag(event_type) over w p, row_number() over w rn from events window w as (partition by user_id order by ts, event_id)) where rn = 1 or event_type is distinct from p")
_add("cast_numeric", lambda s, d: r.numeric_columns(table(s, d, "events").select(F.get_json_object("props", "$.k").alias("k"), "event_type")).groupBy("k").agg(F.count(F.lit(1)).alias("n")), "select (props->>'$.k')::bigint k, count(*) n from events group by 1")
_add("sql_over_frame", lambda s, d: r.query(table(s, d, "lineitem"), "select l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 4) q from li group by all", "li"), "select l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 4) q from lineitem group by all")
_add("top_violations", lambda s, d: r.top_by(table(s, d, "triples"), "confidence", "triple_id").select("triple_id", "confidence"), "select triple_id, confidence from triples where confidence is not null order by confidence desc, triple_id limit 10")
_add("update_from", lambda s, d: r.update_from(table(s, d, "orders").select("o_orderkey", "o_custkey"), table(s, d, "customer"), "o_custkey", "c_custkey", "c_name", "?").select("o_orderkey", "c_name"), "select o_orderkey, coalesce(c_name, '?') c_name from orders left join customer on o_custkey = c_custkey")
_add("msisdn_of_text", lambda s, d: table(s, d, "telecom_data").select("id", msisdn_of(F.col("source_file")).alias("m")), r"select id, coalesce(regexp_extract(source_file, '_([^_/]+)\.txt$', 1), null) m from telecom_data")
_add("normalize_url", lambda s, d: table(s, d, "events").select(normalized_url(F.concat(F.lit("HTTP://Host/api/"), "event_type", F.lit("/"), "user_id", F.lit("/"), "event_id", F.lit("/?x=1"))).alias("url")).groupBy("url").agg(F.count(F.lit(1)).alias("n")), "select 'http://host/api/' || lower(event_type) || '/{id}/{id}' url, count(*) n from events group by 1")
_add("scalar_strings", lambda s, d: table(s, d, "part").select("p_partkey", capitalized(F.col("p_type")).alias("cap"), is_upper(F.col("p_type")).alias("up"), F.substring("p_name", 1, 4).alias("prefix"), F.concat_ws("|", "p_brand", "p_type").alias("joined")), "select p_partkey, upper(p_type[1:1]) || lower(p_type[2:]) cap, upper(p_type) = p_type and lower(p_type) <> p_type up, p_name[1:4] prefix, concat_ws('|', p_brand, p_type) joined from part")
_LEAVES = """
with d as (select id, data::json j from telecom_data where json_valid(data)),
n as (select d.id doc_id, x.id n, substr(x.fullkey, 3) p, x.type, x.atom from d, json_tree(d.j) x where json_type(d.j) = 'OBJECT' and x.type not in ('OBJECT', 'ARRAY')),
f as (select doc_id, (row_number() over (partition by doc_id order by n) - 1)::int seq, 'entity_0' s, p, case when type = 'NULL' then null else atom->>'$' end o,
  case type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'bool' when 'DOUBLE' then 'double' when 'NULL' then 'null' else 'int' end o_type from n)
"""
_flat = lambda s, d: tr.json_to_triples(table(s, d, "telecom_data"), "id", "data")
_add("json_leaves", lambda s, d: tr.json_to_triples(table(s, d, "events"), "event_id", "props").select("doc_id", "p", "o", "o_type"), "select event_id doc_id, 'k' p, props->>'$.k' o, 'int' o_type from events where json_valid(props)")
_add("json_triples", lambda s, d: _flat(s, d).withColumn("o", F.when(F.col("o_type") == "double", F.col("o").cast("double").cast("string")).otherwise(F.col("o"))), _LEAVES + " select doc_id, seq, s, p, case when o_type = 'double' then o::double::varchar else o end o, o_type from f")
_add("json_nodes", lambda s, d: tr.nodes(table(s, d, "telecom_data"), "id", "data").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_nodes")), "with d as (select id, data::json j from telecom_data where json_valid(data)) select d.id doc_id, count(*) n_nodes from d, json_tree(d.j) x where x.type = 'OBJECT' group by 1")
_add("json_depth", lambda s, d: tr.depth(_flat(s, d)), _LEAVES + " select doc_id, max(len(regexp_split_to_array(p, '[.[]')))::int depth from f group by 1")
_add("json_rebuilt", lambda s, d: tr.triples_to_json(tr.json_to_triples(table(s, d, "telecom_data"), "id", "data")))
_add("json_contains", lambda s, d: tr.search_documents(table(s, d, "telecom_data"), "id", "data", [{"status": [{"status": "ItemOn"}]}, {"paymentContext": "Pospago"}]), _LEAVES + r" select doc_id from f group by 1 having bool_or(regexp_matches(p, '(^|[.])status[[][0-9]+[]][.]status$') and o = 'ItemOn') and bool_or(regexp_matches(p, '(^|[.])paymentContext$') and o = 'Pospago')")
_add("json_path", lambda s, d: table(s, d, "telecom_data").select("id", F.get_json_object("data", "$.externalId").alias("x")).where("x is not null"), "select id, data->>'$.externalId' x from (select id, case when json_valid(data) then data end data from telecom_data) where data->>'$.externalId' is not null")
_add("value_sets", lambda s, d: tr.value_sets(_flat(s, d)), _LEAVES + " select regexp_replace(p, '[[][0-9]+[]]', '[]', 'g') path, count(distinct o) n_values, count(*) n from f where o_type = 'string' group by 1")
_add("enum_discovery", lambda s, d: tr.enums(_flat(s, d)).select("path", F.array_join("vals", "|").alias("vals")), _LEAVES + r""", x as (select distinct regexp_replace(p, '[[][0-9]+[]]', '[]', 'g') path, o v from f where o_type = 'string')
  select path, string_agg(v, '|' order by encode(v)) vals from x group by 1 having count(*) between 2 and 10 and not bool_and(regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}')) and not bool_and(regexp_full_match(v, '(?i)[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}'))""")
_add("tabularize", lambda s, d: tr.tabularize(table(s, d, "telecom_data"), "id", "data").select("doc_id", "row", "source_type", F.col("fields")["id"].alias("row_id")), """with d as (select id, data::json j from telecom_data where json_valid(data)),
  m as (select d.id, x.key, x.value, x.id n from d, json_each(d.j) x where json_type(d.j) = 'OBJECT' and x.type = 'ARRAY' and json_array_length(case when x.type = 'ARRAY' then x.value end) > 0 and len(list_filter(case when x.type = 'ARRAY' then x.value::json[] end, lambda y: coalesce(json_type(y), 'NULL') <> 'OBJECT')) = 0),
  b as (select id, key, value, row_number() over (partition by id order by case key when 'contract' then 0 when 'product' then 1 when 'customer' then 2 when 'party' then 3 when 'enquiry' then 4 else 5 end, n) r from m),
  u as (select id, key, unnest(value::json[]) v, generate_subscripts(value::json[], 1) - 1 i from b where r = 1) select id doc_id, i::int as row, key source_type, v->>'$.id' row_id from u""")
_add("rows_to_triples", lambda s, d: tr.rows_to_triples(table(s, d, "triples"), "s", "p", "o", True), r"""select * from (select trim(replace(s, chr(9), ' '), ' ') s, trim(replace(p, chr(9), ' '), ' ') p, trim(replace(o, chr(9), ' '), ' ') o from triples) where s <> '' and p <> '' and o <> ''
  and not contains(s || '|' || p || '|' || o, '1970-01-01') and not contains(s || '|' || p || '|' || o, '9999-12-31')""")
_LINES = rf"""
with raw as (select doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') a from documents where text is not null),
l as (select doc_id, line, trim(raw, {W}) t from (select doc_id, unnest(a) raw, generate_subscripts(a, 1) - 1 line from raw)),
f as (select * from l where t <> '' and t not in ('{{', '}}', '[', ']', '}},', '],', '{{}}', '[]') and trim(t, '",') not in ('{{', '}}', '[', ']', '}},', '],', '{{}}', '[]')),
k as (select *, regexp_matches(t, $k${tr.KEY_VALUE}$k$) is_pair, trim(regexp_extract(t, $k${tr.KEY_VALUE}$k$, 1), {W}) k, trim(regexp_extract(t, $k${tr.KEY_VALUE}$k$, 2), {W}) v from f),
c as (select *, case when is_pair or t[1] = '"' then null
    when regexp_matches(t, '^[^\t]*\t[^\t]*\t') then [regexp_extract(t, '(?s)^([^\t]*)\t([^\t]*)\t(.*)$', 1), regexp_extract(t, '(?s)^([^\t]*)\t([^\t]*)\t(.*)$', 2), regexp_extract(t, '(?s)^([^\t]*)\t([^\t]*)\t(.*)$', 3)]
    when regexp_matches(t, '^[^{_WS}]+[{_WS}]+[^{_WS}]+[{_WS}]+') then [regexp_extract(t, '^([^{_WS}]+)', 1), regexp_extract(t, '^[^{_WS}]+[{_WS}]+([^{_WS}]+)', 1), regexp_extract(t, '(?s)^[^{_WS}]+[{_WS}]+[^{_WS}]+[{_WS}]+(.*)$', 1)] end x0 from k),
e as (select *, list_transform(x0, lambda y: trim(replace(y, chr(9), ' '), ' ')) x1 from c),
g as (select *, is_pair and v <> '' and v not in ('{{', '[', '{{}}', '[]') and not regexp_matches(k || '|' || v, '1970-01-01|9999-12-31') has_kv,
  x1 is not null and not regexp_matches(x1[1] || '|' || x1[2] || '|' || x1[3], '1970-01-01|9999-12-31') has_x from e),
b as (select *, case when has_kv and lower(k) = 'id' then v when has_x then x1[1] end base from g),
w as (select *, trim(replace(coalesce(last_value(base ignore nulls) over (partition by doc_id order by line rows between unbounded preceding and 1 preceding), 'document_' || doc_id), chr(9), ' '), ' ') current from b),
said as (select doc_id, line::int line,
  case when has_kv and lower(k) = 'id' then trim(replace(v, chr(9), ' '), ' ') when has_kv then current when has_x then x1[1] when not is_pair and x1 is null then current end s,
  case when has_kv and lower(k) = 'id' then 'id' when has_kv then trim(replace(k, chr(9), ' '), ' ') when has_x then x1[2] when not is_pair and x1 is null then 'line_' || line end p,
  case when has_kv then trim(replace(v, chr(9), ' '), ' ') when has_x then x1[3] when not is_pair and x1 is null then trim(replace(t, chr(9), ' '), ' ') end o,
  has_kv or has_x or (not is_pair and x1 is null and not regexp_matches(t, '1970-01-01|9999-12-31')) ok from w)
select doc_id, line, s, p, o from said where ok
"""
_add("text_triples", lambda s, d: tr.text_to_triples(table(s, d, "documents"), "doc_id", "text"), _LINES)
_add("parse_tasks", lambda s, d: tr.parse_tasks(table(s, d, "orders").select(F.concat(F.lit("55"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" - "), F.lower("o_orderstatus"))).otherwise("")).alias("l")), "l", "default"), "select '55' || lpad(o_orderkey::varchar, 10, '0') msisdn, case when o_orderkey % 2 = 0 then lower(o_orderstatus) else 'default' end as sequence from orders")
_add("unnest_struct", lambda s, d: tr.unnest(table(s, d, "nation").select("n_nationkey", F.struct("n_name", F.struct("n_regionkey").alias("in")).alias("x"))), "select n_nationkey, n_name, n_regionkey from nation")
_add("sentinel_dates", lambda s, d: table(s, d, "triples").where(F.col("o").contains("1970-01-01") | F.col("o").contains("9999-12-31")).select("triple_id"), "select triple_id from triples where contains(o, '1970-01-01') or contains(o, '9999-12-31')")
def _round_trip(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    def f(s: SparkSession, d: str) -> DataFrame:
        path = new_path(s, "files") + kind
        files.write(table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), "n_name"), path)
        got = files.read_csv(s, path, sep="\t") if kind == ".tsv" else files.read(s, path)
        return got.select("k", "n_name")

    return f


for _kind in (".csv", ".tsv", ".parquet", ".ndjson", ".orc"):
    _add(f"file_{_kind[1:]}", _round_trip(_kind), "select n_nationkey::varchar k, n_name from nation")


def _rules_file(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "rules")
    table(s, d, "nation").select(F.concat_ws("\t", "n_nationkey", "n_regionkey", F.lit("0.5"), F.concat(F.lit("in(A,"), "n_name", F.lit(")"))).alias("value")).write.text(path)
    return files.read_rules_tsv(s, path)


_add("file_rules_tsv", _rules_file, "select n_nationkey::bigint predictions, n_regionkey::bigint support, 0.5::double confidence, 'in(A,' || n_name || ')' as rule from nation")


def _results(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.concat(F.lit("55"), "o_custkey").alias("MSISDN"), F.col("o_orderkey").alias("request"), F.create_map(F.lit("status"), F.array("o_orderstatus"), F.lit("none"), F.array().cast("array<string>")).alias("notes"))
    return files.results(o, "notes")


_add("result_rows", _results, "select '55' || o_custkey MSISDN, min(o_orderkey) request, 'none: nenhum | status: ' || arg_min(o_orderstatus, o_orderkey) notes from orders group by 1")
_add("log_reorder", lambda s, d: r.breaks(table(s, d, "events").withColumn("thread", F.col("user_id") % 7), ["thread"], "event_id", "user_id").select("thread", "event_id", "brk"),  "select user_id % 7 thread, event_id, user_id is distinct from lag(user_id) over (partition by user_id % 7 order by event_id) brk from events")
