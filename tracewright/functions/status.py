"""Classifiers of responses, reviews and outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How failed responses begin, what shows a broken browser, and the least of real content.
FAILURE_MARKERS = ("(scrape failed", "(page returned no content)", "(page not available)")
INFRA_MARKERS = (
    "Executable doesn't exist", "asyncio loop", "BrowserType.launch", "Target page, context or browser has been closed",
    "Connection closed while reading from the driver",
)
MIN_CONTENT_CHARS = 200
CANNED = {"search": "(no results)", "scrape": "(page not available)"}


def scrape_status(response: Column) -> Column:
    """ok, empty or error by the trimmed response."""
    t = F.regexp_replace(F.coalesce(response, F.lit("")), r"^\s+|\s+$", "")
    failed = F.lit(False)
    for m in FAILURE_MARKERS:
        failed = failed | F.startswith(t, F.lit(m))
    return F.when(t == "", "empty").when(failed, "error").when(F.length(t) < MIN_CONTENT_CHARS, "empty").otherwise("ok")


def default_status(response: Column) -> Column:
    return F.when(F.trim(F.coalesce(response, F.lit(""))) != "", "ok").otherwise("empty")


def is_infra_failure(response: Column) -> Column:
    r, out = F.coalesce(response, F.lit("")), F.lit(False)
    for m in INFRA_MARKERS:
        out = out | F.contains(r, F.lit(m))
    return out


def is_cacheable(response: Column) -> Column:
    return ~is_infra_failure(response)


def review_decision(reviewed_at: Column, rejected: Column) -> Column:
    """Null until reviewed, then reject or keep."""
    return F.when(reviewed_at.isNull(), F.lit(None).cast("string")).when(rejected, "reject").otherwise("keep")


def is_conditioned(has_key: Column, restrictions: Column, trace_id: Column) -> Column:
    """Whether restrictions apply: if the record has the key, that it is not empty; else that the id has a slug."""
    return F.when(has_key, F.coalesce(F.size(restrictions), F.lit(0)) > 0).otherwise(F.contains(trace_id, F.lit("__")))


def abstention(findable: Column, found: Column) -> Column:
    """One of four outcomes; a null or invalid candidate abstains."""
    found = F.coalesce(found, F.lit(False))
    return F.when(findable & found, "correct_find").when(findable, "false_abstain").when(found, "false_find").otherwise("correct_abstain")


def prices_equal(a: Column, b: Column, tolerance: float = 0.005) -> Column:
    """Both null, or both numbers within the tolerance."""
    return F.when(a.isNull() & b.isNull(), True).otherwise(F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)))


def miss_policy(policy: str, namespace: Column, stored_status: Column, response: Column) -> Column:
    """struct(action, response) of a lookup: live serves ok and empty, canned whatever is stored or a constant, error fails."""
    if policy == "canned":
        constant = F.create_map(*[F.lit(v) for pair in CANNED.items() for v in pair])
        return F.struct(F.when(stored_status.isNotNull(), "hit").otherwise("canned").alias("action"), F.coalesce(response, F.element_at(constant, namespace)).alias("response"))
    hit = F.coalesce(stored_status.isin("ok", "empty"), F.lit(False))
    other = {"live": "fetch", "error": "raise"}.get(policy)
    if other is None:
        raise ValueError(f"unknown miss policy {policy!r}")
    return F.struct(F.when(hit, "hit").otherwise(other).alias("action"), F.when(hit, response).alias("response"))


def reward_grounding(grounded: Column, fraction: Column, valid: Column, items: Column, tau: float = 20.0, slack: float = 0.15, penalty: float = 1.0) -> Column:
    """Saturating reward of grounded items less a penalty of the ungrounded share beyond the slack; 0 if invalid or empty."""
    value = (1 - F.exp(-grounded / tau)) * fraction - penalty * F.greatest(F.lit(0.0), (1 - fraction) - slack)
    return F.when(valid & (items > 0), value).otherwise(F.lit(0.0))


def reward_total(structure: Column, found: Column, grounding: Column, dietary: Column, weights=(0.2, 0.2, 0.6, 0.0)) -> Column:
    return sum((w * c for w, c in zip(weights, (structure, found, grounding, dietary))), F.lit(0.0))


def sync_decision(remote_md5: Column, remote_etag: Column, remote_size: Column, local_md5: Column, local_size: Column) -> Column:
    """struct(unchanged, reason): by recorded md5, else by a single-part etag, else by size; a missing remote is changed."""
    single = remote_etag.isNotNull() & ~F.contains(remote_etag, F.lit("-"))
    return (
        F.when(remote_size.isNull(), F.struct(F.lit(False).alias("unchanged"), F.lit("remote missing").alias("reason")))
        .when(remote_md5.isNotNull(), F.struct((remote_md5 == local_md5).alias("unchanged"), F.lit("md5 metadata").alias("reason")))
        .when(single, F.struct((remote_etag == local_md5).alias("unchanged"), F.lit("etag").alias("reason")))
        .otherwise(F.struct((remote_size == local_size).alias("unchanged"), F.lit("size").alias("reason")))
    )
