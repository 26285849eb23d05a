"""Mixing sources to target weights: whole copies by rate, the fraction by a hash-seeded draw."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_count, written

#: Seeds that a source may choose from; each gives every document an own uniform draw.
SEEDS = 16


def _draws(doc_id: Column) -> Column:
    """SEEDS uniform draws in [0, 1): four from each md5 of seed block and id."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.array(*[
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{k // 4}:"), text)), 1 + 8 * (k % 4), 8), 16, 10).cast("double") / F.lit(2.0**32)
        for k in range(SEEDS)
    ])


def source_targets(sizes: DataFrame, *, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The target of each source: shares by weight, none above ``most`` times its size, the excess shared again.

    sizes: (source, size). Sources in code-point order, null last, take the weights in turn. Filling by weight with caps
    has a closed form: order the sources by cap over weight; the level is that of the first source whose cap exceeds it.
    One row per source is all that the ordered windows see. Returns source, source_size, target.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    src = src.select("source", "source_size", rank.alias("pos"))
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("pos") - 1) % len(weights) + 1).cast("int")))
    src = src.withColumn("cap", F.lit(float(most)) * F.col("source_size").cast("double")).withColumn("full_at", F.col("cap") / F.col("weight"))
    before = Window.orderBy("full_at", "pos").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("full_at", "pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(whole).cast("double")
    level = (total - F.lit(float(most)) * F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double")) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    src = src.withColumn("level", level)
    level = F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")), F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "pos"))).over(whole)
    src = src.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return src.select("source", "source_size", target.alias("target"))


def plan_copies(docs: DataFrame, *, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """How often the mix takes each document: floor(rate) times, and once more with probability rate - floor(rate).

    The draw is a hash of document id and seed, so reruns agree. All seeds are equally good draws; each source uses the
    one of SEEDS whose sum of words comes nearest its target, which one aggregation tells for all of them.
    Null texts have size 0; a null source is a source; null ids draw as one id; repeated rows draw alike; a source of
    size 0 has target 0 and gives no copies. Returns doc_id, source, size, source_size, target, copies; one row per row.
    """
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    src = written(source_targets(sizes, weights=weights, share=share, most=most), "mix-targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    floor = F.floor(rate)
    picks = F.transform(_draws(F.col("doc_id")), lambda u: (u < rate - floor).cast("long") + floor)
    rated = sizes.alias("d").join(src.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    rated = rated.select("d.doc_id", "d.source", "size", "source_size", "target", picks.alias("picks"))
    sums = rated.groupBy("source").agg(F.first("target").alias("target"), *[F.sum(F.col("size") * F.col("picks")[k]).alias(f"w{k}") for k in range(SEEDS)])
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"w{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(SEEDS)]))
    seeds = sums.select("source", best["k"].alias("seed"))
    out = rated.alias("r").join(seeds.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")))
    return out.select("r.doc_id", "r.source", "size", "source_size", "target", F.get("picks", F.col("seed")).alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents themselves: every column of ``docs``, each row as often as ``plan_copies`` says.

    ``how`` goes to ``plan_copies``. Rows are matched to their plan by id and source; repeated rows share one plan.
    """
    plan = plan_copies(docs.select("doc_id", "source", "text"), **how)
    plan = plan.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("of")).agg(F.max("copies").alias("n")).where("n > 0")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    out = rows.join(plan, F.col("row.doc_id").eqNullSafe(F.col("id")) & F.col("row.source").eqNullSafe(F.col("of")))
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("row.*")
