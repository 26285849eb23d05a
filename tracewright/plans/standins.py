"""Stand-ins of the domain's tables over the star schema, and the SQL that says the same.

An entity is a customer, its city a nation; a trace is an order; an item is a line item named by its part; responses are
documents, turns conversations, attempts events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entities(t) -> DataFrame:
    """entity_id (customer key), name, city, region, cuisine, source, is_chain, split (null for a quarter)."""
    k = F.col("c_custkey") % 4
    split = F.when(k == 0, "sft").when(k == 1, "grpo").when(k == 2, "eval")
    c = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(
        F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("name"), F.col("n_name").alias("city"), F.col("n_regionkey").alias("region"),
        F.col("c_mktsegment").alias("cuisine"), F.lit("osm").alias("source"), (F.col("c_acctbal") > 7000).alias("is_chain"), split.alias("split"),
    )


ENTITIES = """entities AS (
  SELECT c_custkey AS entity_id, c_name AS name, n_name AS city, n_regionkey AS region, c_mktsegment AS cuisine, 'osm' AS source, c_acctbal > 7000 AS is_chain,
    CASE c_custkey % 4 WHEN 0 THEN 'sft' WHEN 1 THEN 'grpo' WHEN 2 THEN 'eval' END AS split
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def traces(t) -> DataFrame:
    """trace_id, entity_id, found, rejected, reviewed_at, reject_reason, trace_source, conditioned, grounding."""
    k = F.col("o_orderkey")
    return t("orders").select(
        k.alias("trace_id"), F.col("o_custkey").alias("entity_id"), (F.col("o_orderstatus") != "F").alias("found"),
        (F.col("o_orderpriority") == "1-URGENT").alias("rejected"), F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("reviewed_at"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").alias("reject_reason"),
        F.when(k % 5 == 0, "student").otherwise("teacher").alias("trace_source"), (k % 2 == 0).alias("conditioned"),
        F.when(k % 7 != 0, (k % 101) / F.lit(100.0)).alias("grounding"),
    )


TRACES = """traces AS (
  SELECT o_orderkey AS trace_id, o_custkey AS entity_id, o_orderstatus <> 'F' AS found, o_orderpriority = '1-URGENT' AS rejected,
    CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS reviewed_at, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END AS reject_reason,
    CASE WHEN o_orderkey % 5 = 0 THEN 'student' ELSE 'teacher' END AS trace_source, o_orderkey % 2 = 0 AS conditioned,
    CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 101) / CAST(100.0 AS DOUBLE) END AS grounding
  FROM orders)"""


def items(t) -> DataFrame:
    """trace_id, pos, section, name, price of each item; prices of tenth items are unknown."""
    li = t("lineitem").join(t("part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    price = F.when(F.col("l_orderkey") % 10 != 0, F.col("l_extendedprice"))
    return li.select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("pos"), F.col("l_returnflag").alias("section"), F.col("p_name").alias("name"), price.alias("price"), "l_quantity", "l_suppkey")


ITEMS = """items AS (
  SELECT l_orderkey AS trace_id, l_linenumber AS pos, l_returnflag AS section, p_name AS name, CASE WHEN l_orderkey % 10 <> 0 THEN l_extendedprice END AS price, l_quantity, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def menus(t) -> DataFrame:
    """trace_id and menu: one section per flag, items in order of line number, price and name."""
    item = F.struct("pos", "price", "name")
    s = items(t).groupBy("trace_id", "section").agg(F.sort_array(F.collect_list(item)).alias("i"))
    s = s.withColumn("items", F.transform("i", lambda x: F.struct(x["name"].alias("name"), F.lit(None).cast("string").alias("description"), x["price"].alias("price"))))
    return s.groupBy("trace_id").agg(F.sort_array(F.collect_list(F.struct("section", "items"))).alias("menu"))
