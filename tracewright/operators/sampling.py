"""Seeded splits, quotas, samples and episode plans; permutations are orders by hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import trace_id
from .corpus import SPLITS
from .ranking import hash_key, hash_number, stride_places, with_rank

#: The restrictions that conditioned episodes take in turn.
DIETARY_POOL = (
    "vegetarian", "vegan", "gluten-free", "dairy-free", "no peanuts", "no nuts (peanuts or tree nuts)", "no shellfish",
    "halal", "kosher", "pescatarian", "keto (low-carb)", "vegetarian, no peanuts", "gluten-free, dairy-free",
)


def permuted(df: DataFrame, key: str, seed: int = 42, name: str = "pos") -> DataFrame:
    """``df`` with the 1-based place of each row in the order of hashed keys."""
    digest = hash_key(seed, F.col(key))
    return with_rank(df, hash_number(digest), [digest, F.col(key)], name)


def check_fractions(fractions: dict[str, float]) -> None:
    unknown = set(fractions) - set(SPLITS)
    if unknown:
        raise ValueError(f"unknown splits {sorted(unknown)}")
    if abs(sum(fractions.values()) - 1) > 1e-6:
        raise ValueError(f"fractions sum to {sum(fractions.values())}, not 1")


def parse_fractions(text: str) -> dict[str, float]:
    """FN28, SET7: ``sft=0.5,grpo=0.3`` as a dict; unknown names and sums other than 1 raise."""
    out: dict[str, float] = {}
    for part in filter(None, (p.strip() for p in text.split(","))):
        name, eq, value = part.partition("=")
        if not eq:
            raise ValueError(f"{part!r} is not name=fraction")
        try:
            out[name.strip()] = float(value)
        except ValueError:
            raise ValueError(f"{value!r} is not a number") from None
    check_fractions(out)
    return out


def assign_splits(entities: DataFrame, fractions: dict[str, float], *, seed: int = 42, reassign: bool = False, traced: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Entities with a split: a seeded permutation of the pool cut at rounded (half-even) shares, the last takes the rest.

    The pool is the unmarked, or all with ``reassign``, which is refused for entities with traces unless forced.
    """
    check_fractions(fractions)
    pool = entities if reassign else entities.where(F.col("split").isNull())
    if reassign and not force and traced is not None and pool.join(traced, "entity_id", "left_semi").limit(1).count():
        raise ValueError("entities with traces would move between splits")
    ranked = permuted(pool, "entity_id", seed)
    n, order, cuts, at = pool.count(), [s for s in SPLITS if s in fractions], [], 0
    for s in order[:-1]:
        at += round(n * fractions[s])
        cuts.append((s, at))
    split = F.lit(order[-1])
    for s, cut in reversed(cuts):
        split = F.when(F.col("pos") <= cut, s).otherwise(split)
    out = ranked.withColumn("split", split).drop("pos").select(*entities.columns)
    return out if reassign else out.unionByName(entities.where(F.col("split").isNotNull()))


def allocate(counts: DataFrame, key: str, total: int) -> DataFrame:
    """(key, c, quota): largest-remainder shares of ``total`` by count, in exact integers; leftovers by remainder, count, key, all descending."""
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = counts.select(key, "c").withColumn("_pool", F.sum("c").over(every))
    total_c = F.least(F.lit(total).cast("long"), F.col("_pool"))
    df = df.withColumn("_floor", F.expr(f"(least({total}L, _pool) * c) div _pool"))
    df = df.withColumn("_rest", F.expr(f"(least({total}L, _pool) * c) % _pool")).withColumn("_left", total_c - F.sum("_floor").over(every))
    nth = F.row_number().over(Window.orderBy(F.col("_rest").desc(), F.col("c").desc(), F.col(key).desc()))
    return df.withColumn("_nth", nth).select(key, "c", (F.col("_floor") + (F.col("_nth") <= F.col("_left")).cast("long")).alias("quota"))


def stratified_sample(df: DataFrame, *, target: int, chain: str, stratum: Column, key: str, seed: int = 42, independents: float = 0.7) -> DataFrame:
    """About ``target`` rows, at least ``independents`` of them no chains (backfilled), by quotas within each stratum."""
    df = df.withColumn("stratum", stratum)
    sizes = {bool(r[chain]): r["count"] for r in df.groupBy(chain).count().collect()}  # two rows
    n_chain, n_indep = sizes.get(True, 0), sizes.get(False, 0)
    n = min(target, n_chain + n_indep)
    want_chain = min(n_chain, round(n * (1 - independents)))
    want_indep = min(n_indep, n - want_chain)
    want_chain = min(n_chain, n - want_indep)
    out = None
    for flag, want in ((True, want_chain), (False, want_indep)):
        part = df.where(F.col(chain) == flag)
        quotas = allocate(part.groupBy("stratum").agg(F.count(F.lit(1)).alias("c")), "stratum", want)
        digest = hash_key(seed, F.col(key))
        nth = F.row_number().over(Window.partitionBy("stratum").orderBy(digest, key))
        picked = part.withColumn("_nth", nth).join(quotas.select("stratum", "quota"), "stratum").where("_nth <= quota").drop("_nth", "quota")
        out = picked if out is None else out.unionByName(picked)
    return out


def plan_episodes(entities: DataFrame, n: int, conditioned: float = 0.0, *, seed: int = 42, pool=DIETARY_POOL) -> DataFrame:
    """(trace_id, entity_id, restriction, i): a free prefix of the permuted entities, then conditioned ones reusing it in turn."""
    if not 0 <= conditioned <= 1:
        raise ValueError("the conditioned share must be within 0 and 1")
    spark, size = entities.sparkSession, entities.count()
    n_cond = round(n * conditioned)
    n_free = n - n_cond
    ranked = permuted(entities, "entity_id", seed).select("entity_id", (F.col("pos") - 1).alias("pos"))
    free = ranked.where(F.col("pos") < n_free).select("entity_id", F.lit(None).cast("string").alias("restriction"), F.col("pos").alias("i"))
    if not size:
        return free.select(F.col("entity_id").alias("trace_id"), "entity_id", "restriction", "i")
    slots = spark.range(n_cond).select(F.col("id").alias("k"))
    restriction = F.element_at(F.array(*[F.lit(p) for p in pool]), (F.col("k") % len(pool) + 1).cast("int"))
    cond = slots.join(ranked, F.col("k") % size == F.col("pos")).select("entity_id", restriction.alias("restriction"), (F.col("k") + n_free).alias("i"))
    both = free.unionByName(cond)
    both = both.withColumn("trace_id", trace_id(F.col("entity_id"), F.when(F.col("restriction").isNotNull(), F.array("restriction"))))
    first = F.row_number().over(Window.partitionBy("trace_id").orderBy("i"))
    return both.withColumn("_n", first).where("_n = 1").select("trace_id", "entity_id", "restriction", "i")


def found_false_keep(n_true: int, n_false: int, most: float) -> int:
    """How many found=false rows may stay so that their share is at most ``most``."""
    if most >= 1 or n_false <= most * (n_true + n_false):
        return n_false
    return 0 if most <= 0 else min(n_false, int(n_true * most / (1 - most)))


def ratio_guard(df: DataFrame, found: str, key: str, *, most: float = 0.2, seed: int = 42) -> DataFrame:
    """All found rows, and a seeded sample of the others up to their share."""
    counts = {bool(r[found]): r["count"] for r in df.groupBy(found).count().collect()}  # two rows
    keep = found_false_keep(counts.get(True, 0), counts.get(False, 0), most)
    others = permuted(df.where(~F.col(found)), key, seed, "_pos").where(F.col("_pos") <= keep).drop("_pos")
    return df.where(F.col(found)).unionByName(others)


def stride_probe(df: DataFrame, number: Column, order: list, k: int) -> DataFrame:
    """``df`` with probe: whether its place in ``order`` is one of ``k`` evenly spaced ones."""
    ranked = with_rank(df, number, order, "_place")
    places = stride_places(df.count(), k)
    probe = F.array_contains(F.lit(places), (F.col("_place") - 1).cast("int")) if places else F.lit(False)
    return ranked.withColumn("probe", probe).drop("_place")


def effective_batch(per_device: int, accumulation: int, processes: int) -> int:
    """SP7: rows of an optimiser step."""
    return per_device * accumulation * max(1, processes)


def check_groups(batch: int, group: int) -> None:
    """SP7: a batch holds whole groups of rollouts."""
    if group < 2 or batch % group:
        raise ValueError(f"a batch of {batch} does not hold whole groups of {group}")
