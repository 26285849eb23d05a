"""The corpus store: scans, upserts, decisions, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPLITS = ("sft", "grpo", "eval")


def check_split(split: str | None) -> None:
    if split is not None and split not in SPLITS:
        raise ValueError(f"unknown split {split!r}; one of {', '.join(SPLITS)}")


def scan_entities(entities: DataFrame, *, split: str | None = None, unmarked: bool = False) -> DataFrame:
    """SO1: all entities, those of a split, or those of none, by id."""
    check_split(split)
    if unmarked:
        entities = entities.where(F.col("split").isNull())
    elif split is not None:
        entities = entities.where(F.col("split") == split)
    return entities.orderBy("entity_id")


def scan_traces(traces: DataFrame, entities: DataFrame, *, split: str | None = None, include_rejected: bool = False, source: str | None = None) -> DataFrame:
    """Traces with their entity's name, city and split; rejected ones only on demand."""
    check_split(split)
    if not include_rejected:
        traces = traces.where(~F.col("rejected"))
    if source is not None:
        traces = traces.where(F.col("trace_source") == source)
    if split is not None:
        entities = entities.where(F.col("split") == split)
    return traces.join(entities.select("entity_id", "name", "city", "split"), "entity_id")


def count_by_split(entities: DataFrame) -> DataFrame:
    """Rows by split, null as unmarked; all four are there even if empty."""
    domain = entities.sparkSession.createDataFrame([(s,) for s in (*SPLITS, "unmarked")], "split string")
    counts = entities.groupBy(F.coalesce("split", F.lit("unmarked")).alias("split")).agg(F.count(F.lit(1)).alias("n"))
    return domain.join(counts, "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n"))


def review_counts(traces: DataFrame) -> DataFrame:
    """Reviewed, unreviewed, kept and rejected; rejected counts the unreviewed too."""
    seen = F.col("reviewed_at").isNotNull()
    return traces.agg(
        F.count_if(seen).alias("reviewed"), F.count_if(~seen).alias("unreviewed"),
        F.count_if(seen & ~F.col("rejected")).alias("kept"), F.count_if(F.col("rejected")).alias("rejected"),
    )


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Base rows replaced by the last update of their key, new keys added. ``order`` ranks updates and is not kept."""
    cols = [c for c in base.columns]
    last = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    new = updates.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(*cols)
    return base.join(new, keys, "left_anti").select(*cols).unionByName(new)


def upsert_preserving(base: DataFrame, updates: DataFrame, keys: list[str], column: str, flag: str) -> DataFrame:
    """As ``upsert`` of unique keys, but ``column`` keeps its value where the update's ``flag`` says it was left out."""
    old = base.select(*keys, F.col(column).alias("_old"))
    new = updates.join(old, keys, "left").withColumn(column, F.when(F.col(flag), F.col(column)).otherwise(F.col("_old")))
    new = new.select(*base.columns)
    return base.join(new, keys, "left_anti").select(*base.columns).unionByName(new)


def apply_decisions(traces: DataFrame, decisions: DataFrame) -> DataFrame:
    """keep and reject stamp the review time; undecided clears decision, reason and time; traces without one stay."""
    d = decisions.select(F.col("trace_id").alias("_t"), F.col("decision").alias("_d"), F.col("reason").alias("_r"), F.col("at").alias("_at"))
    out = traces.join(d, F.col("trace_id") == F.col("_t"), "left")
    has = F.col("_d").isNotNull()
    return out.withColumns({
        "rejected": F.when(has, F.col("_d") == "reject").otherwise(F.col("rejected")),
        "reject_reason": F.when(has, F.when(F.col("_d") == "reject", F.col("_r"))).otherwise(F.col("reject_reason")),
        "reviewed_at": F.when(has, F.when(F.col("_d") != "undecided", F.col("_at"))).otherwise(F.col("reviewed_at")),
    }).select(*traces.columns)


def siblings(traces: DataFrame) -> DataFrame:
    """(trace_id, sibling_id): other traces of the same entity."""
    a = traces.select("entity_id", "trace_id")
    b = traces.select("entity_id", F.col("trace_id").alias("sibling_id"))
    return a.join(b, "entity_id").where("trace_id != sibling_id").select("trace_id", "sibling_id")


def violations(df: DataFrame, table: str, *, unique: list[str] = (), required: list[str] = (), domain: dict[str, tuple] | None = None, reference: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(table, rule, n) of broken constraints: repeated keys, nulls, values outside a domain, dangling references."""
    found = []
    if unique:
        found.append(df.groupBy(*unique).count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"unique({','.join(unique)})").alias("rule"), "n"))
    for c in required:
        found.append(df.agg(F.count_if(F.col(c).isNull()).alias("n")).select(F.lit(f"required({c})").alias("rule"), "n"))
    for c, values in (domain or {}).items():
        found.append(df.agg(F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*values)).alias("n")).select(F.lit(f"domain({c})").alias("rule"), "n"))
    for c, (other, key) in (reference or {}).items():
        dangling = df.where(F.col(c).isNotNull()).join(other.select(F.col(key).alias("_k")).distinct(), F.col(c) == F.col("_k"), "left_anti")
        found.append(dangling.agg(F.count(F.lit(1)).alias("n")).select(F.lit(f"reference({c})").alias("rule"), "n"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.lit(table).alias("table_name"), "rule", "n")


def chain_flag(df: DataFrame, norm_name: Column, tagged: Column, least: int = 3) -> DataFrame:
    """``df`` with is_chain: tagged, or a name that ``least`` or more rows have. Deduplicate by id first."""
    counts = df.groupBy(norm_name.alias("_name")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    out = df.withColumn("_own", norm_name).join(counts, F.col("_own") == F.col("_name"), "left")
    return out.withColumn("is_chain", tagged | F.col("_n").isNotNull()).drop("_own", "_name", "_n")


def top_bucket(df: DataFrame, column: str, n: int = 15, position: str | None = None) -> DataFrame:
    """``df`` with bucket: the value if among the ``n`` most frequent (ties by first place), else other; null is unspecified."""
    first = F.min(position) if position else F.min(column)
    top = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_top")).agg(F.count(F.lit(1)).alias("_n"), first.alias("_first"))
    top = top.orderBy(F.col("_n").desc(), "_first").limit(n).select("_top")
    out = df.join(F.broadcast(top), F.col(column) == F.col("_top"), "left")  # n rows
    return out.withColumn("bucket", F.when(F.col(column).isNull(), "unspecified").when(F.col("_top").isNull(), "other").otherwise(F.col("_top"))).drop("_top")
