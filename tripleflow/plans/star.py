"""The triples that the queries of the graph, rule and scoring operators work on, in Spark and in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WHITE, entity_key, trimmed
from ..storage import table

W = "'" + WHITE + "'"


def key(kind: str, c: str) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.col(c).cast("string"))


def star(spark: SparkSession, d: str, lines: bool = True) -> DataFrame:
    """``(s, p, o)`` of orders, customers, nations, suppliers and parts; with ``lines`` also what orders contain, as often as they do."""
    read = lambda n: table(spark, d, n)
    part = lambda df, s, p, o: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    orders, customers = read("orders"), read("customer")
    order, customer = key("order", "o_orderkey"), key("customer", "c_custkey")
    parts = [
        part(orders, order, "placed_by", key("customer", "o_custkey")), part(orders, order, "status", F.col("o_orderstatus")), part(orders, order, "priority", F.col("o_orderpriority")),
        part(orders, order, "order_date", F.date_format("o_orderdate", "yyyy-MM-dd")),
        part(customers, customer, "in_nation", key("nation", "c_nationkey")), part(customers, customer, "segment", F.col("c_mktsegment")),
        part(read("nation"), key("nation", "n_nationkey"), "in_region", key("region", "n_regionkey")),
        part(read("supplier"), key("supplier", "s_suppkey"), "in_nation", key("nation", "s_nationkey")), part(read("part"), key("part", "p_partkey"), "brand", F.col("p_brand")),
    ]
    if lines:
        parts.append(part(read("lineitem"), key("order", "l_orderkey"), "contains", key("part", "l_partkey")))
    return reduce(DataFrame.unionAll, parts)


_STAR = """
  select 'order_' || o_orderkey s, 'placed_by' p, 'customer_' || o_custkey o from orders
  union all select 'order_' || o_orderkey, 'status', o_orderstatus from orders
  union all select 'order_' || o_orderkey, 'priority', o_orderpriority from orders
  union all select 'order_' || o_orderkey, 'order_date', strftime(o_orderdate, '%Y-%m-%d') from orders
  union all select 'customer_' || c_custkey, 'in_nation', 'nation_' || c_nationkey from customer
  union all select 'customer_' || c_custkey, 'segment', c_mktsegment from customer
  union all select 'nation_' || n_nationkey, 'in_region', 'region_' || n_regionkey from nation
  union all select 'supplier_' || s_suppkey, 'in_nation', 'nation_' || s_nationkey from supplier
  union all select 'part_' || p_partkey, 'brand', p_brand from part
"""
STAR_SMALL = f"with t as ({_STAR})"
STAR = f"with t as ({_STAR} union all select 'order_' || l_orderkey, 'contains', 'part_' || l_partkey from lineitem)"


def known(spark: SparkSession, d: str) -> DataFrame:
    """``(triple_id, s, p, o, split, confidence, created_at)``: the graph's triples without nulls, cleaned, of the attributes that link entities."""
    linking = F.broadcast(table(spark, d, "transe_relation_map").where("o_is_entity").select(trimmed("label").alias("p")))
    t = table(spark, d, "triples").select("triple_id", entity_key("s").alias("s"), trimmed("p").alias("p"), entity_key("o").alias("o"), "split", "source", "confidence", "created_at")
    return t.where("s is not null and o is not null").join(linking, "p", "left_semi")


KNOWN = f"""with k as (select triple_id, upper(trim(s, {W})) s, trim(p, {W}) p, upper(trim(o, {W})) o, split, source, confidence, created_at
  from triples where s is not null and o is not null and trim(p, {W}) in (select trim(label, {W}) from transe_relation_map where o_is_entity))"""
