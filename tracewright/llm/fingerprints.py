"""Document fingerprints by SimHash, in DataFrame functions alone, and permuted block tables that search them."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, written

BITS = 64
#: Documents that one task puts in order.
ORDER_ROWS = 20_000
_LANES = 0x0000000100000001  # two counters of 32 bits to a long: bits j and j + 32


def terms(text: Column) -> Column:
    """Hashes of a text's terms: each word with the next one, the last alone."""
    words = F.array_remove(F.split(lower_ascii(text), r"[\x20\x09-\x0D]+"), "")
    after = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.zip_with(words, after, lambda a, b: F.xxhash64(a, b))  # words must not be a part of the lambda


def votes_to_print(n: Column, lanes: list[Column]) -> Column:
    """The bits whose votes, +1 or -1 of each term's weight, sum to more than 0."""
    out = F.lit(0).cast("long")
    for j, lane in enumerate(lanes):
        for bit, count in ((j, lane.bitwiseAND(F.lit(0xFFFFFFFF))), (j + 32, F.shiftrightunsigned(lane, 32))):
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            out = out.bitwiseOR(F.when(count * 2 > n, F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def simhash(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and fingerprint of each text; ``keys`` must tell rows apart (equal keys are one document).

    A term's weight is its number of occurrences. Texts without a word have fingerprint 0. The votes of a document are
    summed where its terms arise, and only sums are shuffled.
    """
    rows = df.select(*keys, F.explode_outer(terms(F.col(text))).alias("_h"))
    lanes = [F.sum(F.shiftrightunsigned(F.col("_h"), j).bitwiseAND(F.lit(_LANES))).alias(f"_v{j}") for j in range(32)]
    votes = rows.groupBy(*keys).agg(F.count("_h").alias("_n"), *lanes)
    bits = votes_to_print(F.col("_n"), [F.coalesce(F.col(f"_v{j}"), F.lit(0).cast("long")) for j in range(32)])
    return votes.select(*keys, bits.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def block_masks(radius: int) -> list[int]:
    """Of each permuted table for ``radius`` the bits that make its key: 64 bits fall into radius + 3 blocks, and a table
    brings three of them to the front. ``radius`` differing bits leave three whole blocks, hence a common key."""
    parts = radius + 3
    edges = [round(k * BITS / parts) for k in range(parts + 1)]
    masks = [sum(((1 << (edges[p + 1] - edges[p])) - 1) << edges[p] for p in chosen) for chosen in combinations(range(parts), 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def block_keys(fp: Column, radius: int) -> Column:
    """(table, key) of a fingerprint in every permuted table for ``radius``."""
    return F.array(*[F.struct(F.lit(t).alias("table"), fp.bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(block_masks(radius))])


def count_near(prints: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """(query, near): how many fingerprints lie within ``radius`` bits, itself included; both tables hold distinct longs.

    A pair that several tables bring together counts in the first of them, so pairs are summed where they meet and never
    shuffled, however dense a cluster is.
    """
    table = prints.select("fingerprint", F.explode(block_keys(F.col("fingerprint"), radius)).alias("k")).select("fingerprint", "k.*")
    asked = queries.select("query", F.explode(block_keys(F.col("query"), radius)).alias("k")).select("query", "k.*")
    differ = F.col("query").bitwiseXOR(F.col("fingerprint"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(block_masks(radius))])
    near = asked.join(table, ["table", "key"]).where((F.bit_count(differ) <= radius) & (F.col("table") == first))
    return near.groupBy("query").agg(F.count(F.lit(1)).alias("near"))


def successors(ids: DataFrame) -> DataFrame:
    """(id, node, cut, rows, next_id, next_node): each document's next by id and node, the first after the last; no nulls.

    Ranges of some ORDER_ROWS documents are ordered apart and joined at their ends, so no task sees them all.
    """
    parts = max(1, math.ceil(ids.count() / ORDER_ROWS))
    ranged = written(ids.repartitionByRange(parts, "id", "node").withColumn("_part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_part").orderBy("id", "node")
    ranged = ranged.withColumns({"_id": F.lead("id").over(own), "_node": F.lead("node").over(own)})
    heads = ranged.groupBy("_part").agg(F.min(F.struct("id", "node")).alias("first"))
    every = Window.orderBy("_part")
    after = F.coalesce(F.lead("first").over(every), F.first("first").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select(F.col("_part").alias("_p"), after.alias("_after"))
    out = ranged.join(heads, F.col("_part") == F.col("_p"))
    return out.select("id", "node", "cut", "rows", F.coalesce("_id", "_after.id").alias("next_id"), F.coalesce("_node", "_after.node").alias("next_node"))


def fingerprint_edits(docs: DataFrame, *, radius: int = 3, query_every: int = 50) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near they and the next document's are; a row per row.

    Null texts are empty. Rows equal in id and text are one document in the order and have equal results; null ids come
    first; a lone document is its own next. n_near: for ids divisible by ``query_every`` the number of other distinct
    fingerprints within ``radius`` bits, found through the block tables; null for the rest. Texts are shuffled once, by
    id and hash; heads and sums go by the same keys.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    # a null id is a pair of its own, before all others
    base = docs.select(F.struct(doc_id.isNotNull().alias("some"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("id")).alias("id"), F.xxhash64(text).alias("node"), text.alias("text"))
    cut = F.floor(F.length("text") / 4).cast("int")
    order = written(successors(base.groupBy("id", "node").agg(F.first(cut).alias("cut"), F.count(F.lit(1)).alias("rows"))), "order")
    ask = order.select(F.col("id").alias("h_id"), F.col("node").alias("h_node"), "cut", F.col("next_id").alias("id"), F.col("next_node").alias("node"))
    heads = base.join(ask, ["id", "node"])
    heads = heads.groupBy("h_id", "h_node").agg(F.min(F.substring(F.col("text"), F.lit(1), F.col("cut"))).alias("head"))
    rows = base.join(heads.withColumnsRenamed({"h_id": "id", "h_node": "node"}), ["id", "node"])
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - cut), F.col("head"))
    both = F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("t"), F.lit("").alias("sha")), F.struct(F.lit(1).alias("k"), edited.alias("t"), F.sha2(edited, 256).alias("sha")))
    rows = rows.select("id", "node", F.length("text").cast("long").alias("n_chars"), F.explode(both).alias("b")).select("id", "node", "n_chars", "b.k", "b.sha", F.col("b.t").alias("text"))
    prints = written(simhash(rows, ["id", "node", "n_chars", "k", "sha"]), "prints")
    own = prints.where("k = 0").select("id", "node", "n_chars", "fingerprint")
    edits = prints.where("k = 1").select("id", "node", F.col("sha").alias("edited_sha256"), F.col("fingerprint").alias("edited"))
    following = own.select(F.col("id").alias("next_id"), F.col("node").alias("next_node"), F.col("fingerprint").alias("next"))
    out = own.join(edits, ["id", "node"]).join(order.drop("cut"), ["id", "node"]).join(following, ["next_id", "next_node"])
    asks = F.col("id.some") & (F.col("id.id") % query_every == 0)
    asked = own.where(asks).select(F.col("fingerprint").alias("query")).distinct()
    found = count_near(own.select("fingerprint").distinct(), asked, radius)
    out = out.join(found, F.col("fingerprint") == F.col("query"), "left")
    out = out.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return out.select(
        F.when(F.col("id.some"), F.col("id.id")).alias("doc_id"), "n_chars", "edited_sha256", hexed("fingerprint").alias("fingerprint"), hexed("edited").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
        F.when(asks, F.col("near") - 1).alias("n_near"),
    )
