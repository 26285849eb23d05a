"""Queries of harvested entities, templates and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.prompts import BASE, GUIDANCE, RULES, system_prompt
from ..operators import harvest
from ..sources.files import report_label
from .corpus_queries import ENT_ID
from .registry import query
from .standins import entities


@query(f"SELECT c_custkey, {ENT_ID.replace('c_name', 'c_name').replace('n_name', 'city')} AS entity_id, city, c_custkey % 6 = 0 AS is_chain, CASE WHEN c_custkey % 2 = 0 THEN 'pizza|fast food' ELSE '' END AS cuisine FROM (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN 'Own City' ELSE n_name END AS city FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0")
def osm_entities(t):
    """PRJ4: elements of a map as entities."""
    k, name, city = F.col("entity_id"), F.col("name"), F.col("city")
    tags = F.map_filter(F.create_map(
        F.lit("name"), F.when(k % 5 != 0, F.concat(F.lit(" "), name)), F.lit("addr:city"), F.when(k % 3 == 0, "Own City"), F.lit("brand"), F.when(k % 6 == 0, "B"),
        F.lit("cuisine"), F.when(k % 2 == 0, " Pizza ;; FAST food"), F.lit("key"), k.cast("string"),
    ), lambda _, v: v.isNotNull())
    e = entities(t).select(F.when(k % 2 == 0, "node").otherwise("way").alias("type"), F.when((k % 2 == 0) & (k % 7 != 0), 1.0).alias("lat"), F.when((k % 2 == 0) & (k % 7 != 0), 2.0).alias("lon"), F.when((k % 2 == 1) & (k % 7 != 0), F.struct(F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))).alias("center"), tags.alias("tags"), city.alias("region_city"))
    out = harvest.osm_entities(e, F.col("region_city"))
    return out.select(F.substring("name", -9, 9).cast("long").alias("c_custkey"), "entity_id", "city", "is_chain", F.array_join("cuisine", "|").alias("cuisine"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Town' ELSE n_name END AS city, CASE c_custkey % 3 WHEN 0 THEN 'thai' WHEN 1 THEN 'cafe' ELSE '' END AS cuisine FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 3 AND c_custkey % 10 >= 2")
def places_entities(t):
    """PRJ5, SRC10: places as entities, each id once."""
    k = F.col("entity_id")
    comps = F.array(F.struct(F.lit("X").alias("text"), F.array(F.lit("route")).alias("types")), F.struct(F.when(k % 2 == 0, "Town").otherwise("").alias("text"), F.array(F.lit("locality")).alias("types")))
    kind = F.when(k % 3 == 0, "thai_restaurant").when(k % 3 == 1, "cafe").otherwise("store")
    p = entities(t).select(F.lit("r").alias("region"), k.cast("string").alias("id"), "name", F.when(k % 4 == 3, "CLOSED_PERMANENTLY").when(k % 4 == 2, "OPERATIONAL").alias("status"), (k % 10).alias("ratings"), kind.alias("kind"), comps.alias("components"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng"), F.col("city").alias("region_city"))
    out = harvest.places_entities(p.unionByName(p), F.col("region_city"), 2)
    return out.select(F.substring("name", -9, 9).cast("long").alias("c_custkey"), "city", F.array_join("cuisine", "|").alias("cuisine"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'best {name} {city} menu' ELSE '{name} menu of {city}' END AS template FROM customer")
def templatize(t):
    """FN22: queries back to their templates."""
    q = F.when(F.col("entity_id") % 2 == 0, F.concat_ws(" ", F.lit("Best"), F.col("name"), F.col("city"), F.lit("MENU"))).otherwise(F.concat_ws(" ", F.col("name"), F.lit("menu  of"), F.col("city")))
    return entities(t).select(F.col("entity_id").alias("c_custkey"), harvest.templatize(q, "name", "city").alias("template"))


@query(f"SELECT o_orderkey, '{BASE}' || chr(10) || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN 'List the whole menu.' ELSE 'List only items fit for: vegan; halal.' END || chr(10) || chr(10) || '{RULES}' || chr(10) || chr(10) || '{GUIDANCE.replace(chr(39), chr(39) * 2)}' AS prompt FROM orders")
def system_prompts(t):
    """FN26."""
    r = F.when(F.col("o_orderkey") % 2 == 1, F.array(F.lit("vegan"), F.lit("halal")))
    return t("orders").select("o_orderkey", system_prompt(r, "teacher").alias("prompt"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'run' || o_orderkey WHEN 1 THEN 'tuned' ELSE 'f' || o_orderkey END AS label FROM orders")
def report_labels(t):
    """PRJ22, SO6: a report's label by precedence."""
    k = F.col("o_orderkey")
    run, model = F.when(k % 3 == 0, F.concat(F.lit("run"), k)), F.when(k % 3 == 1, "a/b/tuned").otherwise("x/final")
    return t("orders").select("o_orderkey", report_label(run, model, F.concat(F.lit("f"), k, F.lit(".json"))).alias("label"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN n_name WHEN o_orderkey % 3 = 1 THEN 'b c' ELSE '' END AS city FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def city_resolution(t):
    """PRJ21, PRJ20: the city of the row, else of the input after its first comma, else none."""
    e = entities(t)
    o = t("orders").join(e.select("entity_id", "city"), F.col("o_custkey") == F.col("entity_id"))
    k = F.col("o_orderkey")
    given = F.when(k % 3 == 1, "a, b c").otherwise("a")
    after = F.when(F.contains(given, F.lit(", ")), F.regexp_replace(given, "^[^,]*, ", ""))
    return o.select("o_orderkey", F.coalesce(F.when(k % 3 == 0, F.col("city")), after, F.lit("")).alias("city"))
