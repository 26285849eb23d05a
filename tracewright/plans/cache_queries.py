"""Cache, stream-like and analytic queries over attempts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys, status
from ..operators import cache, ranking
from .registry import query
from .text_queries import HOST, _RESP, _STATUS, _response, _slim_sql

OK = "event_type <> 'error'"


def _ok():
    return F.col("event_type") != "error"


@query(f"SELECT event_id, coalesce(max(CASE WHEN {OK} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, props ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS hit FROM events")
def cache_replay(t):
    """ST1, CA1: an attempt hits if an earlier one of its key was stored."""
    e = t("events").withColumn("key", F.concat_ws(":", "user_id", "props"))
    return cache.replay(e, "key", ["ts", "event_id"], _ok()).select("event_id", "hit")


@query(f"WITH r AS (SELECT user_id, coalesce(max(CASE WHEN {OK} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, props ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS hit FROM events) SELECT user_id, count(*) AS lookups, count(*) FILTER (hit) AS hits, count(*) FILTER (hit) / CAST(count(*) AS DOUBLE) AS hit_rate FROM r GROUP BY 1")
def cache_hit_rate(t):
    """AG24."""
    e = t("events").withColumn("key", F.concat_ws(":", "user_id", "props"))
    r = cache.replay(e, "key", ["ts", "event_id"], _ok())
    return r.groupBy("user_id").agg(F.count(F.lit(1)).alias("lookups"), F.count_if("hit").alias("hits")).withColumn("hit_rate", cache.hit_rate(F.col("hits"), F.col("lookups")))


_MISS = "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'error' WHEN l.quality = 1 THEN 'ok' ELSE 'empty' END AS st, CASE WHEN l.doc_id IS NOT NULL THEN d.text END AS resp FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@query(f"SELECT doc_id, CASE WHEN st IN ('ok', 'empty') THEN 'hit' ELSE 'fetch' END AS live, CASE WHEN st IN ('ok', 'empty') THEN 'hit' ELSE 'raise' END AS error, CASE WHEN st IS NULL THEN 'canned' ELSE 'hit' END AS canned, coalesce(resp, '(no results)') AS response FROM ({_MISS})")
def miss_policy(t):
    """JN15, CA2: one lookup join, three policies."""
    stored = t("labels").select(F.col("doc_id").alias("_d"), F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 1, "ok").otherwise("empty").alias("st"))
    d = t("documents").select("doc_id", F.col("text").alias("r")).join(stored, F.col("doc_id") == F.col("_d"), "left")
    resp = F.when(F.col("_d").isNotNull(), F.col("r"))
    p = {k: status.miss_policy(k, F.lit("search"), F.col("st"), resp) for k in ("live", "error", "canned")}
    return d.select("doc_id", *[p[k]["action"].alias(k) for k in p], p["canned"]["response"].alias("response"))


@query("SELECT count(*) FILTER (length(text) > 2000) AS rows_over, CAST(coalesce(sum(length(text) - 2000) FILTER (length(text) > 2000), 0) AS BIGINT) AS chars_over, CAST(coalesce(max(length(text)) FILTER (length(text) > 2000), 0) AS INT) AS longest FROM documents")
def clip_report(t):
    """CA4, AG26."""
    return cache.clip_report(t("documents"), "text", 2000)


@query(f"SELECT doc_id, {_STATUS} AS status, substr({_RESP}, 1, 500) AS response FROM (SELECT *, regexp_replace({_RESP}, '^\\s+|\\s+$', '', 'g') AS r FROM documents) WHERE doc_id % 7 <> 0")
def cache_store(t):
    """CA3, UX1: status by the whole response, then clipped; vetoed rows are not stored."""
    d = t("documents").withColumn("response", _response())
    return cache.store(d, most=500, veto=F.col("doc_id") % 7 == 0).select("doc_id", "status", "response")


_SLIM_IN = "CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 2 = 0 THEN text ELSE '![i](a.png)' || text || '[c](tel:1)' END"


def _slim_in():
    return F.when(F.col("doc_id") % 11 == 0, None).when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("![i](a.png)"), "text", F.lit("[c](tel:1)")))


@query(f"""WITH s AS (SELECT a, {_slim_sql("a")} AS b FROM (SELECT {_SLIM_IN} AS a FROM documents))
SELECT count(*) AS scanned, count(*) FILTER (a <> b) AS changed, CAST(coalesce(sum(length(a)), 0) AS BIGINT) AS chars_before, CAST(coalesce(sum(length(b)), 0) AS BIGINT) AS chars_after FROM s""")
def slim_report(t):
    """CA5, UX2: null responses are scanned and untouched."""
    return cache.slim_report(t("documents").select(_slim_in().alias("text")), "text")


@query(f"SELECT doc_id, b AS response FROM (SELECT doc_id, a, {_slim_sql('a')} AS b FROM (SELECT doc_id, {_SLIM_IN} AS a FROM documents)) WHERE a <> b")
def slim_rows(t):
    """CA5: only the rows that slimming changes are written anew."""
    return cache.slim_rows(t("documents").select("doc_id", _slim_in().alias("response")))


@query(f"""WITH s AS (SELECT old, status, new, {_STATUS.replace("length(r)", "length(r)")} AS now FROM (SELECT a AS old, CASE doc_id % 3 WHEN 0 THEN 'ok' ELSE 'empty' END AS status, b AS new, regexp_replace(coalesce(b, ''), '^\\s+|\\s+$', '', 'g') AS r FROM (SELECT doc_id, a, {_slim_sql("a")} AS b FROM (SELECT doc_id, {_SLIM_IN} AS a FROM documents))))
SELECT step, rows FROM (SELECT count(*) FILTER (old <> new) AS slim, count(*) FILTER (status <> now) AS reclassify, count(*) FILTER (length(new) > 3000) AS clip FROM s) UNPIVOT (rows FOR step IN (slim, reclassify, clip))""")
def clean_dry_run(t):
    """CA7: what a clean would change, step by step, without writing."""
    d = t("documents").select(_slim_in().alias("response"), F.when(F.col("doc_id") % 3 == 0, "ok").otherwise("empty").alias("status"))
    return cache.clean_changes(d, most=3000)


@query(f"SELECT old || '->' || new AS transition, count(*) AS n FROM (SELECT CASE doc_id % 2 WHEN 0 THEN 'ok' ELSE 'error' END AS old, {_STATUS} AS new FROM (SELECT doc_id, regexp_replace({_RESP}, '^\\s+|\\s+$', '', 'g') AS r FROM documents)) WHERE old <> new GROUP BY 1")
def reclassify(t):
    """CA6, AG25: status transitions."""
    d = t("documents").select(_response().alias("response"), F.when(F.col("doc_id") % 2 == 0, "ok").otherwise("error").alias("status"))
    return cache.reclassify(d, "response", "status")


@query(f"""SELECT doc_id, {_STATUS} AS status, length(stored) AS stored FROM (SELECT doc_id, {_slim_sql("substr(slim, 1, 3000)")} AS stored, regexp_replace(slim, '^\\s+|\\s+$', '', 'g') AS r FROM (SELECT doc_id, {_slim_sql(_RESP)} AS slim FROM documents))""")
def clean_cache(t):
    """CA7: slim, classify, clip."""
    d = t("documents").select("doc_id", _response().alias("response"))
    return cache.clean(d, most=3000).select("doc_id", "status", F.length("response").cast("long").alias("stored"))


@query("WITH a AS (SELECT event_id, user_id, epoch_us(ts) / CAST(1000000 AS DOUBLE) - 1704067200 AS arr FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY arr, event_id) * CAST(60.0 AS DOUBLE) AS n FROM a) SELECT event_id, round(n + max(arr - n) OVER (PARTITION BY user_id ORDER BY arr, event_id ROWS UNBOUNDED PRECEDING), 4) AS start FROM r")
def throttle_schedule(t):
    """ST2, WN13: starts of one host at least a minute apart, in order of arrival."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0) - 1704067200
    e = t("events").select("event_id", "user_id", at.alias("at"))
    return cache.throttle(e, "user_id", "at", "event_id", 60.0).select("event_id", F.round("start", 4).alias("start"))


@query(f"WITH g AS (SELECT *, sum(CASE WHEN {OK} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM events) SELECT event_id, CAST(sum(CASE WHEN {OK} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS BIGINT) AS streak FROM g")
def failure_streaks(t):
    """WN8, ST3: consecutive failures of a run."""
    return cache.streaks(t("events"), "user_id", ["ts", "event_id"], ~_ok()).select("event_id", "streak")


@query(f"WITH b AS (SELECT *, NOT ({OK}) AND value > 20 AS bad FROM events), g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS grp FROM b), s AS (SELECT user_id, event_id, ts, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id) AS streak FROM g) SELECT user_id, min(event_id) AS abort_at FROM s WHERE streak >= 2 GROUP BY 1")
def infra_breaker(t):
    """WN9: the first attempt at which a run of broken-machine failures is long enough to abort."""
    s = cache.streaks(t("events"), "user_id", ["ts", "event_id"], ~_ok(), F.col("value") > 20)
    return s.where("streak >= 2").groupBy("user_id").agg(F.min("event_id").alias("abort_at"))


@query(f"SELECT event_id, count(*) OVER w AS done, round(avg(CASE WHEN {OK} THEN CAST(1 AS DOUBLE) ELSE 0 END) OVER w, 6) AS ok_rate, round(sum(value) OVER w, 2) AS total_value FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_rates(t):
    """WN10, ST6: progress figures after each completion."""
    r = cache.running_rates(t("events"), "user_id", ["ts", "event_id"], _ok(), F.col("value"))
    return r.select("event_id", "done", F.round("ok_rate", 6).alias("ok_rate"), F.round(F.col("mean_value") * F.col("done"), 2).alias("total_value"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS seq, count(*) OVER () AS n FROM events) WHERE seq % 100 = 0 OR seq = n")
def checkpoint_points(t):
    """ST4: every hundredth completion and the last."""
    e = ranking.with_rank(t("events"), F.col("event_id"), ["event_id"], "seq")
    return cache.checkpoints(e, "seq", t("events").count(), 100).select("event_id")


@query("""WITH r AS (SELECT page_id // 10 AS q, page_id % 10 AS rank, url, page_id % 3 = 1 AS dead FROM pages), b AS (SELECT *, coalesce(sum(CASE WHEN dead THEN 0 ELSE 1 END) OVER (PARTITION BY q ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
SELECT q, rank, url, NOT dead AS kept FROM b WHERE before < 3""")
def topn_url_funnel(t):
    """WN5: three live results; dead ends take no place."""
    p = t("pages").select(F.floor(F.col("page_id") / 10).alias("q"), (F.col("page_id") % 10).alias("rank"), "url", (F.col("page_id") % 3 == 1).alias("dead"))
    return cache.url_funnel(p, "q", "rank", F.col("dead"), 3).select("q", "rank", "url", "kept")


@query(f"SELECT entity, domain FROM (SELECT page_id % 50 AS entity, {HOST} AS domain, row_number() OVER (PARTITION BY page_id % 50, {HOST} ORDER BY page_id) AS rn FROM pages) WHERE rn = 1")
def first_seen_urls(t):
    """WN6: the first time that an entity's templates meet a host."""
    p = t("pages").select("page_id", (F.col("page_id") % 50).alias("entity"), keys.host_of(F.col("url")).alias("domain"))
    return ranking.keep_first(p, ["entity", "domain"], ["page_id"]).select("entity", "domain")


@query("SELECT page_id, mode FROM (SELECT page_id, page_id % 9 = 0 AS dead, length(html) AS n, CASE WHEN page_id % 4 = 0 THEN 'error' ELSE 'ok' END AS st FROM pages), (VALUES ('direct'), ('browser')) m(mode) WHERE mode = 'direct' OR dead OR st = 'error' OR n < 2000")
def warm_plan(t):
    """CA9, CA10: direct for all, the browser where it may tell more."""
    p = t("pages").select("page_id", "url", (F.col("page_id") % 9 == 0).alias("dead"), F.length("html").alias("n"), F.when(F.col("page_id") % 4 == 0, "error").otherwise("ok").alias("st"))
    return cache.warm_plan(p, "url", F.col("dead"), F.col("n"), F.col("st")).select("page_id", "mode")


@query("SELECT CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS views, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, round(sum(value) / greatest(1, count(*)), 6) AS mean_value FROM events")
def warm_summary(t):
    """AG27."""
    is_ = lambda k: F.coalesce(F.sum((F.col("event_type") == k).cast("long")), F.lit(0))
    return t("events").agg(is_("view").alias("views"), is_("error").alias("errors"), F.round(F.sum("value") / F.greatest(F.lit(1), F.count(F.lit(1))), 6).alias("mean_value"))


# --- analytics ---


@query(f"SELECT domain, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 6) AS share, contains(domain, 'example') AS delivery FROM (SELECT {HOST} AS domain, count(*) AS n FROM pages GROUP BY 1)")
def domain_counts(t):
    """AG9, WN12: hosts with their share of all."""
    c = t("pages").groupBy(keys.host_of(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).select("domain", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), F.contains("domain", F.lit("example")).alias("delivery"))  # one row


@query("WITH c AS (SELECT p_name AS template, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1) SELECT template, n, row_number() OVER (ORDER BY n DESC, first) AS place FROM c")
def template_frequency(t):
    """AG8: by count, ties in first-seen order."""
    c = t("part").groupBy(F.col("p_name").alias("template")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))
    return ranking.with_rank(c, -F.col("n"), [F.col("n").desc(), "first"], "place").select("template", "n", "place")


@query("WITH c AS (SELECT p_name AS template, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, first) AS place FROM c) SELECT CASE WHEN place <= 10 THEN template ELSE '... more' END AS template, CAST(sum(n) AS BIGINT) AS n, count(*) AS templates FROM r GROUP BY 1")
def top_templates(t):
    """SO9: the ten most frequent, and the rest in one row."""
    r = template_frequency(t)
    return r.groupBy(F.when(F.col("place") <= 10, F.col("template")).otherwise("... more").alias("template")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("templates"))


_FETCHES = """f AS (SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'web.archive.org' ELSE regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') END AS domain,
  CASE page_id % 4 WHEN 0 THEN 'browser' WHEN 1 THEN 'unknown' ELSE 'direct' END AS mode, page_id % 7 = 0 AS failed FROM pages)"""


def _fetches(t):
    """Fetches of traces: url, mode, failed."""
    k = F.col("page_id")
    mode = F.when(k % 4 == 0, "browser").when(k % 4 == 1, "unknown").otherwise("direct")
    return t("pages").select("page_id", F.when(k % 9 == 0, "https://web.archive.org/web/x").otherwise(F.col("url")).alias("url"), mode.alias("mode"), (k % 7 == 0).alias("failed"))


@query(f"WITH {_FETCHES} SELECT mode, count(*) AS n, count(*) FILTER (failed) AS failures, count(*) FILTER (domain = 'web.archive.org') AS archived FROM f GROUP BY 1")
def mode_counts(t):
    """AG10: fetches, failures and archived pages by mode."""
    f = _fetches(t)
    archived = keys.host_of(F.col("url")) == "web.archive.org"
    return f.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_if("failed").alias("failures"), F.count_if(archived).alias("archived"))


@query(f"WITH {_FETCHES} SELECT domain, count(*) AS n FROM f WHERE failed GROUP BY 1")
def failure_domains(t):
    """AG10: hosts whose fetches failed."""
    return _fetches(t).where("failed").groupBy(keys.host_of(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT o_orderkey, o_orderstatus <> 'F' AS found, bool_or(l_suppkey % 10 = 0) AS delivery, count(*) AS calls FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT CASE WHEN grouping(delivery) = 1 THEN 'all' WHEN delivery THEN 'delivery' ELSE 'other' END AS slice, count(*) AS n, round(avg(CASE WHEN found THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS found_rate, round(avg(calls), 6) AS mean_calls FROM e GROUP BY GROUPING SETS ((), (delivery))""")
def outcome_split(t):
    """AG11: outcomes by whether a trace ever touched a delivery host, and of all."""
    li = t("lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_suppkey") % 10 == 0).alias("delivery"), F.count(F.lit(1)).alias("calls"))
    e = t("orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("found", (F.col("o_orderstatus") != "F").cast("double"))
    out = e.groupingSets([[], ["delivery"]], "delivery").agg(F.grouping("delivery").alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.avg("found"), 6).alias("found_rate"), F.round(F.avg("calls"), 6).alias("mean_calls"))
    return out.select(F.when(F.col("g") == 1, "all").when(F.col("delivery"), "delivery").otherwise("other").alias("slice"), "n", "found_rate", "mean_calls")


@query("SELECT n_turns, count(*) AS n FROM (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY 1) GROUP BY 1")
def tool_call_dist(t):
    """AG12, O-MSG13."""
    return t("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns")).groupBy("n_turns").agg(F.count(F.lit(1)).alias("n"))


_Q = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query("WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, max(n) AS n, min(n_chars) AS min, max(n_chars) AS max, round(avg(n_chars), 1) AS mean, " + ", ".join(f"max(n_chars) FILTER (rn = least(n, CAST(floor(CAST({q} AS DOUBLE) * n) AS BIGINT) + 1)) AS {k}" for k, q in _Q.items()) + " FROM r GROUP BY lang")
def length_distribution(t):
    """AG13: exact order statistics by language."""
    d = t("documents").select("lang", "n_chars")
    p = ranking.percentiles(d, "n_chars", {k: ranking.floor_place(q) for k, q in _Q.items()}, ["lang"])
    s = d.groupBy("lang").agg(F.min("n_chars").alias("min"), F.max("n_chars").alias("max"), F.round(F.avg("n_chars"), 1).alias("mean"))
    return p.join(s, "lang").select("lang", "n", "min", "max", "mean", *_Q)


@query("WITH r AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) AS rn, count(*) OVER () AS n FROM documents) SELECT max(n) AS n, " + ", ".join(f"max(n_chars) FILTER (rn = CAST(round_even(CAST({p} AS DOUBLE) * (n - 1), 0) AS BIGINT) + 1) AS p{int(p * 100)}" for p in (0.5, 0.9, 0.99)) + " FROM r")
def nearest_rank_percentiles(t):
    """AG14."""
    return ranking.percentiles(t("documents"), "n_chars", {f"p{p}": ranking.nearest_place(p) for p in (50, 90, 99)})


@query("WITH r AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) AS rn, count(*) OVER () AS n FROM documents) SELECT max(n) AS n, max(n_chars) FILTER (rn = n // 2 + 1) AS p50, max(n_chars) FILTER (rn = least(n, CAST(floor(CAST(0.95 AS DOUBLE) * n) AS BIGINT) + 1)) AS p95 FROM r")
def export_percentiles(t):
    """AG15."""
    return ranking.percentiles(t("documents"), "n_chars", {"p50": F.floor(F.col("n") / 2) + 1, "p95": ranking.floor_place(0.95)})


@query("SELECT doc_id, n_chars > 0 AND n_chars <= 3000 AS kept FROM documents")
def partition_by_length(t):
    """PRJ18: kept whole or not at all."""
    return t("documents").select("doc_id", ((F.col("n_chars") > 0) & (F.col("n_chars") <= 3000)).alias("kept"))


@query("SELECT doc_id FROM documents WHERE n_chars >= 24000")
def near_cap(t):
    """PRJ19."""
    return t("documents").where("n_chars >= 24000").select("doc_id")


@query("SELECT cap, round(avg(CASE WHEN n_chars <= cap THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS coverage, count(*) FILTER (n_chars > cap) AS cut FROM documents, (VALUES (1000), (2000), (5000), (10000), (20000), (75000)) c(cap) GROUP BY cap")
def cap_simulation(t):
    """JN12, AG17: six literal caps by all lengths."""
    caps = F.explode(F.array(*[F.lit(c) for c in (1000, 2000, 5000, 10000, 20000, 75000)]))
    d = t("documents").select("n_chars", caps.alias("cap"))
    return d.groupBy("cap").agg(F.round(F.avg((F.col("n_chars") <= F.col("cap")).cast("double")), 6).alias("coverage"), F.count_if(F.col("n_chars") > F.col("cap")).alias("cut"))


@query("WITH n AS (SELECT label, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS norm FROM embeddings) SELECT label, count(*) AS n, round(median(norm), 6) AS median, round(min(norm), 6) AS min, round(max(norm), 6) AS max, round(avg(CASE WHEN norm <= 1 THEN CAST(1 AS DOUBLE) ELSE 0 END), 6) AS small, count(*) FILTER (norm = 0) AS zeros FROM n GROUP BY label")
def vector_norm_stats(t):
    """AG28: norms by module."""
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b))
    n = t("embeddings").select("label", norm.alias("norm"))
    r = lambda c: F.round(c, 6)
    return n.groupBy("label").agg(F.count(F.lit(1)).alias("n"), r(F.percentile("norm", F.lit(0.5))).alias("median"), r(F.min("norm")).alias("min"), r(F.max("norm")).alias("max"), r(F.avg((F.col("norm") <= 1).cast("double"))).alias("small"), F.count_if(F.col("norm") == 0).alias("zeros"))


@query("SELECT a.vec_id AS module, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i]) * (CAST(a.embedding[i] AS DOUBLE) - b.embedding[i])))), 6) AS moved FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id ORDER BY moved DESC, module LIMIT 10")
def moved_modules(t):
    """JN17, SO10: paired tensors, the ten that moved most."""
    e = t("embeddings")
    b = e.select((F.col("vec_id") - 1).alias("_k"), F.col("embedding").alias("other"))
    moved = F.sqrt(F.aggregate(F.zip_with("embedding", "other", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    return e.join(b, F.col("vec_id") == F.col("_k")).select(F.col("vec_id").alias("module"), F.round(moved, 6).alias("moved")).orderBy(F.col("moved").desc(), "module").limit(10)


@query("SELECT coalesce(nullif(lang, 'en'), 'unknown') AS source, count(*) AS n, count(*) FILTER (n_chars > 1000) AS found FROM documents GROUP BY 1")
def export_counts(t):
    """AG21, AG22: counts of an export by source and reason; null sources are unknown."""
    return t("documents").groupBy(F.coalesce(F.nullif("lang", F.lit("en")), F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 1000).alias("found"))
