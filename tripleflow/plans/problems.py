"""Queries of the general data operators: attribute rows, nested documents, heavy keys, references."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITE, entity_key, trimmed
from ..operators import eav, nested, references, skew
from ..storage import ship, table


def _wide(spark: SparkSession, d: str, values: bool) -> DataFrame:
    return eav.pivot_blocks(table(spark, d, "triples"), table(spark, d, "transe_relation_map"), values=values)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return eav.unfillable(_wide(spark, d, False))


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    return _wide(spark, d, True)


def p1_cells(spark: SparkSession, d: str) -> DataFrame:
    """The filled cells of the wide table, one a row, as text."""
    return eav.cell_texts(_wide(spark, d, True), eav.attributes(table(spark, d, "transe_relation_map")))


def p1_multi(spark: SparkSession, d: str) -> DataFrame:
    return eav.multi_values(table(spark, d, "triples"), table(spark, d, "transe_relation_map"))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    ship(spark)
    return nested.relational(table(spark, d, "telecom_data"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.undated(_nested(spark, d))


def p2_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of all tables, with their keys."""
    return _nested(spark, d).withColumn("fields", F.to_json("fields"))


def p2_tables(spark: SparkSession, d: str) -> DataFrame:
    """The columns of every table, with their types and how many rows have them."""
    rows = _nested(spark, d).select("tab", F.explode("fields").alias("member", "value")).where("value is not null")
    return rows.groupBy("tab", "member").agg(F.count(F.lit(1)).alias("n"))


def _flat(tab: str, columns: dict[str, tuple[str, str]]) -> Callable[[SparkSession, str], DataFrame]:
    """A query of one of the flat tables: its keys and the columns ``{name: (member path, type)}``."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        t = nested.flat_tables(_nested(spark, d))[tab]
        have = {c.lower(): c for c in t.columns}
        pick = lambda m: F.col(f"`{have.get(f'member.{m}'.lower()) or have[m.lower()]}`") if m.lower() in have else F.lit(None)
        return t.select("id", "path", "parent_path", *(pick(m).cast(kind).alias(name) for name, (m, kind) in columns.items()))

    return query


_TEXT = "string"
_FLAT = {
    "p2_customers": ("customer", {"customer_id": ("id", _TEXT), "external_id": ("externalId", _TEXT)}),
    "p2_accounts": ("account", {"account_id": ("id", _TEXT), "external_id": ("externalId", _TEXT), "billing_spec_id": ("billingAccountSpecId", _TEXT)}),
    "p2_contracts": ("contract", {"contract_id": ("id", _TEXT), "external_id": ("externalId", _TEXT), "payment_context": ("paymentContext", _TEXT), "specification_id": ("contractSpecification.id", _TEXT)}),
    "p2_products": ("product", {"product_id": ("id", _TEXT), "external_id": ("externalId", _TEXT), "offering_id": ("productOfferingId", _TEXT), "name": ("name", _TEXT)}),
    "p2_parts": ("comprisedOf", {"product_id": ("id", _TEXT), "external_id": ("externalId", _TEXT), "offering_id": ("productOfferingId", _TEXT), "name": ("name", _TEXT)}),
    "p2_resources": ("resource", {"resource_id": ("id", _TEXT), "resource_number": ("resourceNumber", _TEXT)}),
    "p2_prices": ("price", {"price_id": ("id", _TEXT), "amount": ("amount", "double")}),
    "p2_characteristics": ("characteristic", {"spec_id": ("charSpecId", _TEXT), "spec_external_id": ("charSpecExternalId", _TEXT), "start_written": ("validFor.startDateTime", _TEXT)}),
    "p2_contact_media": ("contactMediumAssociation", {"medium_id": ("contactMediumId", _TEXT), "role": ("contactRole", _TEXT), "enabled": ("enabled", "boolean"), "language": ("language", _TEXT)}),
    "p2_time_zones": ("homeTimeZone", {"time_zone": ("timeZone", _TEXT), "start_written": ("validFor.startDateTime", _TEXT)}),
}


def p2_statuses(spark: SparkSession, d: str) -> DataFrame:
    """The status entries with their start date, linked to the element that has them."""
    return nested.statuses(_nested(spark, d)).select("id", "path", "status", "start_written", "start_at")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_keys(table(spark, d, "triples"), trimmed("p"), 0.06).select(F.col("key").alias("p"))


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """Rows, subjects and objects of every p."""
    return skew.profile(table(spark, d, "triples"), trimmed("p"), {"subjects": entity_key("s"), "objects": trimmed("o")}).withColumnRenamed("key", "p")


def _changes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    triples, entities, relations = (table(spark, d, t) for t in ("triples", "transe_entity_map", "transe_relation_map"))
    linking = F.broadcast(relations.where("o_is_entity").select(trimmed("label").alias("label")).distinct())
    refs = (
        references.reference_rows(triples, "triples", "s", "triple_id", "s", "created_at")
        .unionByName(references.reference_rows(triples.join(linking, trimmed("p") == F.col("label"), "left_semi"), "triples", "o", "triple_id", "o", "created_at"))
        .unionByName(references.reference_rows(entities, "transe_entity_map", "head", "id", "head", "added_at"))
    )
    return references.life_deltas(entities, "label", "added_at", "deleted_at"), refs


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphans(*_changes(spark, d)).select("tab", "field", "row_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return references.report(references.orphans(*_changes(spark, d)))


def p7_current(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are referred to and have no living record after all changes; the state is kept and updated year by year."""
    return references.current_orphans(references.maintained(*_changes(spark, d), ["2023-01-01", "2024-01-01", "2025-01-01"]))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_wide, p1_cells, p1_multi, p2_found, p2_rows, p2_tables, p2_statuses, p5_found, p5_profile, p7_found, p7_report, p7_current)
} | {name: _flat(*of) for name, of in _FLAT.items()}

_W = "'" + WHITE + "'"
_NUM = "(e[+-]?[0-9]+)?"
READ_SQL = rf"""
with m as (select trim(label, {_W}) label, value_type vt, unit, multi_valued from transe_relation_map),
a as (
  select t.triple_id, t.split, upper(trim(t.s, {_W})) s, m.label p, m.vt, m.unit, m.multi_valued, t.o, trim(t.o, {_W}) x, lower(trim(t.o, {_W})) l
  from triples t join m on trim(t.p, {_W}) = m.label where t.s is not null
),
b as (
  select *,
    lower(regexp_replace(regexp_replace(x, '^([+-]?)\s*(R\$|US\$|BRL|USD|\$)\s*', '\1', 'i'), '\s*(R\$|BRL)$', '', 'i')) u,
    case when regexp_matches(x, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}[T ]') then x
      when regexp_matches(x, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}[T ]') then regexp_replace(x, '^([0-9]+)/([0-9]+)/([0-9]+)', '\3-\2-\1') end iso
  from a
),
c as (
  select *,
    case when regexp_full_match(u, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+){_NUM}') then try_cast(u as double)
      when regexp_full_match(u, '[+-]?[0-9]+,[0-9]+{_NUM}') then try_cast(replace(u, ',', '.') as double)
      when regexp_full_match(u, '[+-]?[0-9]{{1,3}}([.][0-9]{{3}})+(,[0-9]+)?') then try_cast(replace(replace(u, '.', ''), ',', '.') as double)
      when regexp_full_match(u, '[+-]?[0-9]{{1,3}}(,[0-9]{{3}})+([.][0-9]+)?') then try_cast(replace(u, ',', '') as double) end d,
    case when regexp_full_match(l, '[+-]?[0-9]+([.,]0+)?') then try_cast(regexp_replace(l, '[.,]0+$', '') as bigint) end w,
    case when unit = 'MB' and regexp_full_match(l, '[+-]?[0-9]+([.,][0-9]+)?\s*(mb|gb)')
      then try_cast(replace(regexp_extract(l, '^[+]?(-?[0-9]+([.,][0-9]+)?)', 1), ',', '.') as decimal(28,9)) * case when l like '%gb' then 1024 else 1 end end mb,
    case when l in ('true','1','yes','y','sim','s') then 'true' when l in ('false','0','no','n','não','nao') then 'false' end boo,
    case when regexp_full_match(x, '[+-]?[0-9]+') then floor(try_cast(x as double) / 1000)::bigint
      when regexp_full_match(iso, '[0-9]+-[0-9]+-[0-9]+[T ]+[0-9]+:[0-9]+(:[0-9]+([.,][0-9]+)?)?\s*(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?') then
        epoch(try_cast(regexp_extract(iso, '^([0-9]+-[0-9]+-[0-9]+)', 1) || ' ' || regexp_extract(iso, '[T ]+([0-9]+:[0-9]+(:[0-9]+)?)', 1) as timestamp))::bigint
        - case when iso like '%Z' then 0 when regexp_extract(iso, '([+-])[0-9]{{2}}:?[0-9]{{2}}$', 1) = '' then -10800
          when regexp_matches(iso, '[T ].*[+-][0-9]{{2}}:?[0-9]{{2}}$') then
            (case when regexp_extract(iso, '([+-])[0-9]{{2}}:?[0-9]{{2}}$', 1) = '-' then -1 else 1 end)
            * (regexp_extract(iso, '[+-]([0-9]{{2}}):?[0-9]{{2}}$', 1)::int * 3600 + regexp_extract(iso, '[+-][0-9]{{2}}:?([0-9]{{2}})$', 1)::int * 60)
          else -10800 end end sec,
    o is null or l in ('', 'none', 'n/a', '-', 'nenhum', 'null')
      or (vt = 'timestamp' and coalesce(regexp_extract(iso, '^[0-9]+-[0-9]+-[0-9]+', 0) in ('1970-01-01', '9999-12-31'), false)) missing
  from b
),
r as (
  select triple_id, split, s, p, vt, multi_valued, missing, x, case when not missing then
    case vt when 'double' then d::varchar when 'bigint' then coalesce(w, case when mb = floor(mb) then mb::bigint end)::varchar
      when 'boolean' then boo when 'timestamp' then sec::varchar else l end end canon
  from c
)
"""
_REFS = f"""
with lives as (select upper(trim(label, {_W})) k, added_at a, deleted_at d from transe_entity_map where label is not null),
refs as (
  select 'triples' tab, 's' field, triple_id row_id, upper(trim(s, {_W})) k, created_at t from triples where s is not null
  union all select 'triples', 'o', triple_id, upper(trim(o, {_W})), created_at from triples
    where o is not null and trim(p, {_W}) in (select trim(label, {_W}) from transe_relation_map where o_is_entity)
  union all select 'transe_entity_map', 'head', id, upper(trim(head, {_W})), added_at from transe_entity_map where head is not null
),
orphan as (select * from refs r where not exists (select 1 from lives l where l.k = r.k and l.a <= r.t and (l.d is null or r.t < l.d)))
"""

_CELLS = READ_SQL + """
, one as (select s, p, vt, min(case when vt in ('string', 'text') then x end) shown, min(canon) canon from r where not multi_valued and not missing
  group by s, p, vt having count(distinct canon) = 1 and count(*) filter (canon is null) = 0),
many as (select s, p, canon, min(x) shown from r where multi_valued and canon is not null group by s, p, canon)
select s, p, 1::bigint n_values, case vt when 'timestamp' then strftime(make_timestamp(canon::bigint * 1000000), '%Y-%m-%d %H:%M:%S') when 'double' then (canon::double)::varchar
  when 'bigint' then canon when 'boolean' then canon else shown end as value from one
union all select s, p, count(*), string_agg(shown, ' | ' order by encode(shown)) from many group by s, p
"""
_TREE = """
with d as (select id, case json_type(j) when 'VARCHAR' then (case when json_valid(j->>'$') then j->>'$' end) else j::varchar end j
  from (select id, case when json_valid(data) then data::json end j from telecom_data)),
e as (select d.id, substr(x.fullkey, 3) path, coalesce(substr(x.path, 3), '') up, x.type, x.value, x.atom from d, json_tree(d.j::json) x where d.j is not null)
"""
_UP = "regexp_replace(regexp_replace(path, '([[][0-9]+[]])+$', ''), '[.]?[^.]*$', '')"


def _flat_sql(name: str, where: str) -> str:
    cast = {"double": "::double", "boolean": "::boolean", _TEXT: ""}
    columns = ", ".join(f"(value->>'$.{m}'){cast[kind]} \"{n}\"" for n, (m, kind) in _FLAT[name][1].items())
    return _TREE + f"select id, path, {_UP} parent_path, {columns} from e where type = 'OBJECT' and regexp_full_match(path, '{where}')"


_STATUS_SQL = _TREE + rf"""
, w as (select id, path, case when type = 'OBJECT' then value->>'$.status' else atom->>'$' end status, case when type = 'OBJECT' then value->>'$.validFor.startDateTime' end written
  from e where type in ('OBJECT', 'VARCHAR') and regexp_full_match(path, '{nested.STATUS_PATH.strip("^$")}')),
x as (select *, trim(written, {_W}) t from w),
y as (select *, case when regexp_matches(t, '^[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}') then t
    when regexp_matches(t, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') then regexp_replace(t, '^([0-9]+)/([0-9]+)/([0-9]+)', '\3-\2-\1') end iso from x),
z as (select *, case when regexp_full_match(t, '[+-]?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?') then floor(try_cast(t as double) / 1000)::bigint
    when regexp_full_match(iso, '[0-9]+-[0-9]+-[0-9]+([T ]+[0-9]+:[0-9]+(:[0-9]+([.,][0-9]+)?)?\s*(Z|[+-][0-9]{{2}}:?[0-9]{{2}})?)?') then
      epoch(try_cast(regexp_extract(iso, '^([0-9]+-[0-9]+-[0-9]+)', 1) || ' ' || coalesce(nullif(regexp_extract(iso, '[T ]+([0-9]+:[0-9]+(:[0-9]+)?)', 1), ''), '00:00:00') as timestamp))::bigint
      - case when iso like '%Z' then 0 when not regexp_matches(iso, '[T ].*[+-][0-9]{{2}}:?[0-9]{{2}}$') then -10800
          else (case when regexp_extract(iso, '([+-])[0-9]{{2}}:?[0-9]{{2}}$', 1) = '-' then -1 else 1 end)
            * (regexp_extract(iso, '[+-]([0-9]{{2}}):?[0-9]{{2}}$', 1)::int * 3600 + regexp_extract(iso, '[+-][0-9]{{2}}:?([0-9]{{2}})$', 1)::int * 60) end end sec from y),
s as (select id, path, status, written start_written, case when sec >= -62135596800 and sec < 253402387200 and coalesce(regexp_extract(iso, '^[0-9]+-[0-9]+-[0-9]+', 0), '') not in ('1970-01-01', '9999-12-31')
    and strftime(make_timestamp(sec * 1000000), '%Y-%m-%d') not in ('1970-01-01', '9999-12-31') then timezone('UTC', make_timestamp(sec * 1000000)) end start_at from z)
"""

SQL: dict[str, str] = {
    "p1_cells": _CELLS,
    "p2_found": _STATUS_SQL + "select id, path from s where start_at is null",
    "p2_statuses": _STATUS_SQL + "select id, path, status, start_written, start_at from s",
    "p2_customers": _TREE + "select id, '' path, null::varchar parent_path, j->>'$.id' customer_id, j->>'$.externalId' external_id from d where json_type(j::json) = 'OBJECT'",
    **{
        name: _flat_sql(name, where)
        for name, where in {
            "p2_accounts": r"account([[]\d+[]])*", "p2_contracts": r"contract([[]\d+[]])*", "p2_products": r"contract([[]\d+[]])*[.]product([[]\d+[]])*",
            "p2_parts": r"contract([[]\d+[]])*[.]product([[]\d+[]])*([.]comprisedOf([[]\d+[]])*)+", "p2_resources": r"contract([[]\d+[]])*[.]resource([[]\d+[]])*",
            "p2_prices": r".*[.]price([[]\d+[]])*", "p2_characteristics": r"(.*[.])?characteristic([[]\d+[]])*", "p2_contact_media": r"contactMediumAssociation([[]\d+[]])*",
            "p2_time_zones": r"contract([[]\d+[]])*[.]homeTimeZone([[]\d+[]])*",
        }.items()
    },
    "p1_found": READ_SQL + "select s, p from r where not multi_valued and not missing group by s, p having count(distinct canon) > 1 or count(*) filter (canon is null) > 0",
    "p1_multi": READ_SQL + "select s, p, canon as value, count(*) n_rows from r where multi_valued and canon is not null group by all",
    "p5_found": f"select trim(p, {_W}) p from triples where p is not null group by 1 having count(*) >= 0.06 * (select count(*) from triples)",
    "p5_profile": f"select trim(p, {_W}) p, count(*) \"rows\", count(distinct upper(trim(s, {_W}))) subjects, count(distinct trim(o, {_W})) objects from triples where p is not null group by 1",
    "p7_found": _REFS + "select tab, field, row_id from orphan",
    "p7_report": _REFS + "select tab, field, strftime(timezone('UTC', t), '%Y-%m') as month, count(*) n_refs, count(distinct k) n_keys from orphan group by all",
    "p7_current": _REFS
    + "select r.k as key, count(*) refs from refs r where not exists (select 1 from lives l where l.k = r.k and l.d is null) group by 1",
}
