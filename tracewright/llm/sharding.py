"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Documents that one task numbers within a shard.
SLOT_ROWS = 20_000


@dataclass(frozen=True)
class HashTree:
    """Weights of the shards by region and rack; shards are numbered in order, racks as well."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @classmethod
    def even(cls, shards: int, rack: int = 4, region: int = 2) -> HashTree:
        """Shards of weight 1, ``rack`` to a rack and ``region`` racks to a region."""
        racks = [(1.0,) * min(rack, shards - k) for k in range(0, shards, rack)]
        return cls(tuple(tuple(racks[k : k + region]) for k in range(0, len(racks), region)))

    def with_region(self, *weights: float) -> HashTree:
        """The tree and one more region with one rack of these shards."""
        return HashTree((*self.regions, (weights,)))

    def levels(self) -> list[list[list[tuple[int, float]]]]:
        """For each level, by the number of the node above, its children: (number, weight of the subtree)."""
        regions, racks, shards = [], [], []
        for region in self.regions:
            own = []
            for rack in region:
                first = sum(map(len, shards))
                shards.append([(first + k, float(w)) for k, w in enumerate(rack)])
                own.append((len(shards) - 1, float(sum(rack))))
            racks.append(own)
            regions.append((len(racks) - 1, float(sum(w for _, w in own))))
        return [[regions], racks, shards]


def _draw(level: int, children: Column, key: Column) -> Column:
    """The child whose exponential arrival, at its weight as rate, is first; drawn from level, child and key alone."""

    def arrival(child):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(level), child["n"], key), 11).cast("double") + 0.5) * F.lit(2.0**-53)
        return F.struct((-F.log(u) / child["w"]).alias("t"), child["n"].alias("n"))

    return F.array_min(F.transform(children, arrival))["n"]


def descend(df: DataFrame, key: Column, tree: HashTree, prefix: str = "") -> DataFrame:
    """Add region, rack and shard of each row's key: at each node a weighted draw among its children, then on in that one.

    A node's draws know its children's weights alone. So a changed weight moves keys between the subtrees that it is in
    and their siblings, and none within other subtrees; a new region takes keys only into itself. Shards of weight 0 get
    nothing. A row costs as many hashes as the nodes on its way have children.
    """
    cols, name = df.columns, f"_{prefix}tree_"
    above: Column = F.lit(0)
    for level, nodes in enumerate(tree.levels()):
        live = F.lit([]) if not nodes else F.array(*[F.array(*[F.struct(F.lit(n).alias("n"), F.lit(w).alias("w")) for n, w in node if w > 0] or [F.struct(F.lit(-1).alias("n"), F.lit(1.0).alias("w"))]) for node in nodes])
        df = df.withColumn(f"{name}{level}", _draw(level, F.get(live, above), key))
        above = F.col(f"{name}{level}")
    return df.select(*cols, *[F.col(f"{name}{k}").alias(f"{prefix}{c}") for k, c in enumerate(("region", "rack", "shard"))])


def shard_documents(docs: DataFrame, *, shards: int = 24, tree: HashTree | None = None, grown: HashTree | None = None) -> DataFrame:
    """Place every document by its id alone (law ``key``) and number each shard's documents from 0.

    ``grown`` defaults to the tree with one more shard in a region of its own. A null text has no bytes and the crc of
    the empty text; null ids and repeated ids share a place, each row with its own slot. Slots follow a hash of id and
    text: buckets of some SLOT_ROWS rows are numbered apart and start where the counts of the buckets before them end.
    Buckets that many equal rows make larger are parted further by the row's place in the table, so no task sees them
    whole. Returns doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard.
    """
    tree = tree or HashTree.even(shards)
    grown = grown or tree.with_region(1.0)
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = descend(placed, key, tree)
    placed = descend(placed, key, grown, "grown_")
    order = F.shiftrightunsigned(F.xxhash64(F.lit("slot"), key, "text_crc32", "size"), 33)
    placed = written(placed.withColumn("_order", order).withColumn("_id", key).withColumn("_place", F.monotonically_increasing_id()), "shards")
    largest = placed.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, math.ceil(largest / SLOT_ROWS))
    placed = placed.withColumn("_bucket", F.floor(F.col("_order") * F.lit(buckets) / F.lit(2**31))).withColumn("_part", F.lit(0).cast("long"))
    sizes = placed.groupBy("shard", "_bucket").count()
    if (sizes.agg(F.max("count")).first()[0] or 0) > 4 * SLOT_ROWS:
        parts = sizes.select(F.col("shard").alias("_s"), F.col("_bucket").alias("_b"), F.ceil(F.col("count") / SLOT_ROWS).alias("_parts"))
        placed = placed.join(parts, (F.col("shard") == F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
        placed = placed.withColumn("_part", F.when(F.col("_parts") > 4, F.pmod(F.xxhash64("_place"), F.col("_parts"))).otherwise(F.lit(0).cast("long"))).drop("_parts")
    counts = placed.groupBy("shard", "_bucket", "_part").count()
    start = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("_bucket", "_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("shard").alias("_s"), F.col("_bucket").alias("_b"), F.col("_part").alias("_p"), start.alias("_start"))
    row = F.row_number().over(Window.partitionBy("shard", "_bucket", "_part").orderBy("_order", "_id", "text_crc32", "size", "_place"))
    out = placed.withColumn("_row", row).join(starts, (F.col("shard") == F.col("_s")) & (F.col("_bucket") == F.col("_b")) & (F.col("_part") == F.col("_p")))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", (F.col("_start") + F.col("_row") - 1).cast("long").alias("slot"), F.col("grown_shard")
    )
