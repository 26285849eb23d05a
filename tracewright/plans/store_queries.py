"""Keyed tables, tensor files and tiled harvests over what Spark derives from the given tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import cache, crawl
from ..session import scratch
from ..sources import keyed, tensors
from .cache_queries import _SLIM_IN, _slim_in
from .registry import query
from .text_queries import _slim_sql


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 AND doc_id >= 0 THEN 'new' ELSE lang END AS lang, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents UNION ALL SELECT doc_id + 1000000000, 'new', n_chars + 1 FROM documents WHERE doc_id % 7 = 0")
def keyed_upserts(t):
    """UPS1, SRC1: a keyed table made, then rows changed and added in two commits; all rows of its last version."""
    d = t("documents").select("doc_id", "lang", "n_chars")
    table = keyed.KeyedTable(d.sparkSession, scratch(d.sparkSession, "keyed"))
    table.create(d.schema, ["doc_id"], ranges=8)
    table.upsert(d.withColumn("_seq", F.lit(0)), "_seq")
    new = d.where("doc_id % 7 = 0").withColumns({"lang": F.lit("new"), "n_chars": F.col("n_chars") + 1, "_seq": F.lit(1)})
    old = new.withColumns({"lang": F.lit("old"), "_seq": F.lit(0)})
    table.upsert(new.union(old), "_seq")
    table.upsert(new.withColumn("doc_id", F.col("doc_id") + 1_000_000_000), "_seq")
    return table.read()


@query(f"SELECT doc_id, {_slim_sql('a')} AS response FROM (SELECT doc_id, {_SLIM_IN} AS a FROM documents)")
def slim_cache_table(t):
    """CA5: a stored cache slimmed in place: only rows that slimming changes are written back, a second time none."""
    d = t("documents").select("doc_id", _slim_in().alias("response"))
    table = keyed.KeyedTable(d.sparkSession, scratch(d.sparkSession, "cache"))
    table.create(d.schema, ["doc_id"], ranges=8)
    table.upsert(d.withColumn("_seq", F.lit(0)), "_seq")
    for _ in range(2):
        table.upsert(cache.slim_rows(table.read()).withColumn("_seq", F.lit(0)), "_seq")
    table.vacuum()
    return table.read()


@query("SELECT 'block.' || (vec_id // 100) || '.weight' AS name, count(*) AS rows, round(sqrt(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 5) AS norm FROM embeddings WHERE len(embedding) = 64 GROUP BY 1")
def tensor_norms(t):
    """SRC12: vectors written as tensor files of 100 rows at most, and the norms of what is read back from their byte ranges."""
    e = t("embeddings").where(F.size("embedding") == 64).select(F.floor(F.col("vec_id") / 100).alias("block"), "vec_id", "embedding")
    folder = scratch(e.sparkSession, "tensors")

    def write(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        tensors.write_tensor_file(f"{folder}/{key[0]}.safetensors", {f"block.{key[0]}.weight": np.stack(rows.embedding).astype(np.float32)})
        return pd.DataFrame({"n": [len(rows)]})

    e.groupBy("block").applyInPandas(write, "n long").agg(F.sum("n")).collect()
    norms = tensors.tensor_norms(tensors.read_tensors(e.sparkSession, folder, chunk=2560))
    return norms.select("name", F.get("shape", F.lit(0)).alias("rows"), F.round("norm", 5).alias("norm"))


#: Places of a nation in the unit square, by their keys alone, and in a tile of six digits.
_PLACES = """spots AS (SELECT c_custkey, c_nationkey, c_custkey * 7919 % 10007 / CAST(10007 AS DOUBLE) AS lat, c_custkey * 104729 % 10009 / CAST(10009 AS DOUBLE) AS lng FROM customer WHERE c_nationkey % 9 <> 4),
cells AS (SELECT *, CAST(floor(lat * 64) AS BIGINT) AS up, CAST(floor(lng * 64) AS BIGINT) AS rt FROM spots),
tiles AS (SELECT c_custkey, c_nationkey, string_agg(CAST(2 * ((up >> (5 - k)) & 1) + ((rt >> (5 - k)) & 1) AS VARCHAR), '' ORDER BY k) AS tile FROM cells, range(6) x(k) GROUP BY 1, 2),
ranks AS (SELECT c_custkey, c_nationkey, d, substr(tile, 1, d) AS tile, row_number() OVER (PARTITION BY c_nationkey, substr(tile, 1, d) ORDER BY c_custkey) AS rn FROM tiles, range(7) x(d))"""


def _recorded(t):
    """Responses to every tile of every nation: pages of 20 places, three at most; a quarter of the tiles is throttled once."""
    k = F.col("c_custkey")
    c = t("customer").select("c_custkey", "c_nationkey", (k * 7919 % 10007 / F.lit(10007.0)).alias("lat"), (k * 104729 % 10009 / F.lit(10009.0)).alias("lng"))
    tile = crawl.tile_at(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.col("lat"), F.col("lng"), 6)
    c = c.select("c_custkey", F.col("c_nationkey").alias("region"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.substring(tile, F.lit(1), d))).alias("tile"))
    # places of a tile on pages, by ranks that go no further than the last page allowed
    c = c.withColumn("rn", F.row_number().over(Window.partitionBy("region", "tile").orderBy("c_custkey"))).where(F.col("rn") <= 61)
    pages = c.groupBy("region", "tile", F.floor((F.col("rn") - 1) / 20).cast("int").alias("n")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "c_custkey"))), lambda x: F.struct(x["c_custkey"].cast("string").alias("id"))).alias("places"))
    last = c.groupBy(F.col("region").alias("_r"), F.col("tile").alias("_t")).agg(F.max("rn").alias("_last"))
    pages = pages.where("n < 3").join(last, (F.col("region") == F.col("_r")) & (F.col("tile") == F.col("_t")))
    token = lambda n: F.concat("tile", F.lit(":"), n.cast("string"))
    busy, lost = (F.length("tile") + F.col("region")) % 4 == 0, F.col("region") % 9 == 4
    tries = F.when(lost, F.transform(F.sequence(F.lit(1), F.lit(4)), lambda a: F.struct(a.alias("attempt"), F.lit(504).alias("status")))).when(busy, F.array(*[F.struct(F.lit(a).alias("attempt"), F.lit(s).alias("status")) for a, s in ((1, 429), (2, 200))])).otherwise(F.array(F.struct(F.lit(1).alias("attempt"), F.lit(200).alias("status"))))
    pages = pages.select("region", "tile", F.when(F.col("n") > 0, token(F.col("n"))).alias("token"), "places", F.when(F.col("_last") > (F.col("n") + 1) * 20, token(F.col("n") + 1)).alias("next_token"), F.explode(tries).alias("x"))
    fine = F.col("x.status") == 200
    return pages.select("region", "tile", "token", F.col("x.attempt").alias("attempt"), F.col("x.status").alias("status"), F.when(fine, F.col("places")).alias("places"), F.when(fine, F.col("next_token")).alias("next_token"))


@query(f"WITH {_PLACES} SELECT c_nationkey AS region, c_custkey AS place, arg_min(tile, d) AS tile FROM ranks WHERE rn <= 60 GROUP BY 1, 2")
def harvest_tiles(t):
    """SRC9, SRC10: places of every nation by tiles that split where three pages are full, with retries; nations that failed have none."""
    places, _ = crawl.crawl(t("nation").select(F.col("n_nationkey").alias("region")), _recorded(t), depth=6)
    return places.select("region", F.col("place.id").cast("long").alias("place"), "tile")


@query(f"WITH {_PLACES}, n AS (SELECT c_nationkey, count(DISTINCT c_custkey) AS n FROM ranks WHERE rn <= 60 GROUP BY 1) SELECT DISTINCT n_nationkey AS region, n_nationkey % 9 = 4 AS failed, n AS n_places FROM nation JOIN customer ON n_nationkey = c_nationkey LEFT JOIN n ON n_nationkey = n.c_nationkey")
def harvest_regions(t):
    """SRC10: nations with the number of their places, null where the harvest failed."""
    known = t("customer").select(F.col("c_nationkey").alias("region")).distinct()
    _, regions = crawl.crawl(known, _recorded(t), depth=6)
    return regions.select("region", "failed", "n_places")
