"""Global order without a global task: ranks, percentiles and order-dependent selections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which one task may order everything.
ONE_TASK_ROWS = 1_000_000


def hash_key(seed: int, key: Column) -> Column:
    """md5 of seed and key: the order of a seeded permutation."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_number(digest: Column) -> Column:
    """The leading 32 bits of a hex digest, ascending with it."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def with_rank(df: DataFrame, number: Column, order: list, name: str = "rank", rows: int = ONE_TASK_ROWS) -> DataFrame:
    """``df`` with its 1-based rank in ``order``; ``number`` must ascend with that order.

    Beyond ``rows`` rows, approximate quantiles of ``number`` part the rows into ranges that are ranked apart, and each
    range starts where the counts of those before it end: a list of some n / ``rows`` numbers on the driver.
    """
    n = df.count()
    if n <= rows:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    parts = math.ceil(n / rows) * 2
    cuts = sorted(set(df.select(F.percentile_approx(number, [k / parts for k in range(1, parts)], 10 * parts)).first()[0]))
    df = df.withColumn("_range", F.size(F.filter(F.lit(cuts), lambda c: c <= number)))
    counts = dict(df.groupBy("_range").count().collect())
    starts, total = [], 0
    for k in range(len(cuts) + 1):
        starts.append(total)
        total += counts.get(k, 0)
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return df.withColumn(name, own + F.element_at(F.lit(starts), F.col("_range") + 1).cast("long")).drop("_range")


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key; a null key is a key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def percentiles(df: DataFrame, value: str, places: dict[str, Column], by: list[str] | None = None, rows: int = ONE_TASK_ROWS) -> DataFrame:
    """Exact order statistics: for each name the value at the 1-based place that its expression of ``n`` gives.

    Equal values are counted first, so what is ranked is distinct values with running counts. Beyond ``rows`` of them,
    approximate quantiles part the values into ranges, of large groups too; each range is summed apart and begins with
    the sum of those before it.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    many, cuts = counts.count(), []
    if many > rows:
        parts = math.ceil(many / rows) * 2
        cuts = sorted(set(counts.select(F.percentile_approx(value, [k / parts for k in range(1, parts)], 10 * parts)).first()[0]))
    group = Window.partitionBy(*by)
    if not cuts:
        ranked = counts.withColumns({"_hi": F.sum("_c").over(group.orderBy(value)), "n": F.sum("_c").over(group)})
    else:
        counts = counts.withColumn("_range", F.size(F.filter(F.lit(cuts), lambda c: c <= F.col(value))))
        sums = counts.groupBy(*by, "_range").agg(F.sum("_c").alias("_s"))  # a row for each group and range
        before = F.coalesce(F.sum("_s").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumns({"_before": before, "n": F.sum("_s").over(group)}).drop("_s")
        sums = sums.withColumnsRenamed({c: f"_by_{c}" for c in by} | {"_range": "_at"})
        same = F.col("_range") == F.col("_at")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
        own = Window.partitionBy(*by, "_range").orderBy(value)
        ranked = counts.join(sums, same).withColumn("_hi", F.col("_before") + F.sum("_c").over(own))
    picks = [F.min(F.when(F.col("_hi") >= place, F.col(value))).alias(name) for name, place in places.items()]
    return ranked.groupBy(*by).agg(F.max("n").alias("n"), *picks) if by else ranked.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *picks)


def floor_place(q: float) -> Column:
    """Place of sorted[min(n - 1, int(q n))]."""
    return F.least(F.col("n"), F.floor(F.lit(q) * F.col("n")) + 1)


def nearest_place(p: float) -> Column:
    """Place of the nearest rank, half to even: round(p / 100 (n - 1))."""
    return F.bround(F.lit(p / 100.0) * (F.col("n") - 1), 0).cast("long") + 1


def stride_places(n: int, k: int) -> list[int]:
    """0-based places of a systematic sample; none if k is not between 1 and n - 1."""
    return [] if k <= 0 or k >= n else sorted({min(n - 1, int(i * n / k)) for i in range(k)})
