"""Key, text, URL and classifier queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import keys, status, text
from .registry import query

C = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
HOST = "regexp_replace(lower(regexp_extract(trim(url), '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\\.', '')"


@query(f"SELECT doc_id, {C.format('text')} AS q FROM documents")
def norm_query(t):
    """FN4, FN9."""
    return t("documents").select("doc_id", keys.norm_query(F.col("text")).alias("q"))


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM documents")
def normalize_name(t):
    """FN8, FN10: punctuation folded away."""
    return t("documents").select("doc_id", text.fold_words(F.col("text")).alias("n"))


@query(f"SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS c FROM documents")
def canon_token(t):
    """FN11."""
    return t("documents").select("doc_id", text.canon_token(F.col("text")).alias("c"))


@query("SELECT doc_id, CASE WHEN s = '' THEN 'diet' ELSE s END AS slug FROM (SELECT doc_id, substr(trim(regexp_replace(lower(text || '-' || lang), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS s FROM documents)")
def restriction_slug(t):
    """FN2."""
    return t("documents").select("doc_id", keys.restriction_slug(F.array("text", "lang")).alias("slug"))


@query(f"SELECT doc_id, sha256('search' || chr(0) || {C.format('text')} || chr(0) || '2') AS key_hash FROM documents")
def cache_key(t):
    """FN7, CA8: the version is a part of the key."""
    return t("documents").select("doc_id", keys.cache_key(F.lit("search"), keys.norm_query(F.col("text")), F.lit(2)).alias("key_hash"))


@query("""WITH p AS (SELECT doc_id, trim(x) AS x, i FROM (SELECT doc_id, unnest(string_split_regex(text || ', Of; of', '[,\\n;]')) AS x, generate_subscripts(string_split_regex(text || ', Of; of', '[,\\n;]'), 1) AS i FROM documents)),
k AS (SELECT doc_id, x, i, row_number() OVER (PARTITION BY doc_id, lower(x) ORDER BY i) AS rn FROM p WHERE x <> '')
SELECT doc_id, string_agg(x, '|' ORDER BY i) AS restrictions FROM k WHERE rn = 1 GROUP BY doc_id""")
def normalize_restrictions(t):
    """FN12."""
    raw = F.concat("text", F.lit(", Of; of"))
    return t("documents").select("doc_id", F.array_join(keys.normalize_restrictions(raw), "|").alias("restrictions"))


@query(f"SELECT page_id, {HOST} AS domain FROM pages")
def domain_of(t):
    """FN23."""
    return t("pages").select("page_id", keys.host_of(F.col("url")).alias("domain"))


_U = "^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?(?:#.*)?$"
_TRACK = ", ".join(f"'{p}'" for p in keys.TRACKING_PARAMS)
#: URLs that are no plain http ones, each with the page's number for ``#``, and what they must become, by hand.
_ODD_URLS = (
    ("foo.com/a#n", "foo.com/a"), ("www.Bar.org/#/", "www.Bar.org"), ("//CDN.x/y@/", "//cdn.x/y@"), ("HTTP://Ex@.com", "http://ex@.com/"), ("mailto:x@@y.z", "mailto:x@@y.z"),
    ("https://e.com/@?b=%zz+1&a=&utm_source=q#f", "https://e.com/@?a=&b=%25zz+1"), ("https://e.com/?q=%7Ea*&q=A%2fB&n=@", "https://e.com/?n=@&q=A%2FB&q=~a%2A"),
    ("/local/@/", "/local/@"), ("", "/"), ("localhost:8080/a@?x", "localhost:8080/a@?x="), ("https://e.com/?a=%C3%A9+%20&GCLID=@", "https://e.com/?a=%C3%A9++"),
)
_ODD = len(_ODD_URLS)
_NORM_URL = f"""n AS (SELECT page_id, lower(regexp_extract(url, '{_U}', 1)) || '://' || lower(regexp_extract(url, '{_U}', 2)) AS base, regexp_replace(regexp_extract(url, '{_U}', 3), '/+$', '') AS path,
  list_filter(string_split(coalesce(regexp_extract(url, '{_U}', 4), ''), '&'), lambda p: p <> '' AND NOT list_contains([{_TRACK}], lower(split_part(p, '=', 1)))) AS q FROM pages),
u AS (SELECT page_id, CASE page_id % {_ODD + 1} {" ".join(f"WHEN {k} THEN replace('{want}', '@', CAST(page_id AS VARCHAR))" for k, (_, want) in enumerate(_ODD_URLS))} ELSE
  base || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(list_sort(list_transform(q, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)), '&') END END AS norm FROM n)"""


def _any_url():
    """Every page's URL, or in eleven of twelve pages an odd one."""
    odd = F.element_at(F.array(*[F.lit(u) for u, _ in _ODD_URLS], F.lit("")), (F.col("page_id") % (_ODD + 1) + 1).cast("int"))
    return F.when(F.col("page_id") % (_ODD + 1) == _ODD, F.col("url")).otherwise(F.replace(odd, F.lit("@"), F.col("page_id").cast("string")))


@query(f"WITH {_NORM_URL} SELECT page_id, norm FROM u")
def norm_url(t):
    """FN5: with and without scheme and authority, bad escapes, blanks and tracking parameters; the odd ones' results are by hand."""
    return t("pages").select("page_id", keys.norm_url(_any_url()).alias("norm"))


@query(f"WITH {_NORM_URL} SELECT page_id, sha256('scrape' || chr(0) || norm || chr(0) || CASE WHEN page_id % 2 = 0 THEN 'browser' ELSE 'direct' END || chr(0) || '1') AS key_hash FROM u")
def scrape_key(t):
    """FN6, FN7: URL and mode make the key."""
    mode = F.when(F.col("page_id") % 2 == 0, "browser")
    return t("pages").select("page_id", keys.cache_key(F.lit("scrape"), keys.norm_scrape(_any_url(), mode), F.lit(1)).alias("key_hash"))


_SITES = ["https://www.doordash.com/store/1", "http://m.yelp.co.uk/biz", "https://example.com/menu.PDF", "https://example.com/menu?x=.pdf", "https://yelp.com:443/a", "https://notyelp.com/a", "https://shop.menu-world.com"]
_SITE_SQL = "list_extract([" + ", ".join(f"'{s}'" for s in _SITES) + f", url], CAST(page_id % {len(_SITES) + 1} + 1 AS BIGINT))"
_DOMAINS = ", ".join(f"'{d}'" for d in keys.SKIP_DOMAINS)


def _site():
    return F.element_at(F.array(*[F.lit(s) for s in _SITES], F.col("url")), (F.col("page_id") % (len(_SITES) + 1) + 1).cast("int"))


@query(f"""WITH s AS (SELECT page_id, {_SITE_SQL} AS url FROM pages), h AS (SELECT page_id, url, {HOST} AS host, lower(regexp_extract(url, '{_U}', 3)) AS path FROM s)
SELECT page_id, CASE WHEN len(list_filter([{_DOMAINS}], lambda d: host = d OR ends_with(host, '.' || d))) > 0 THEN '{keys.BLOCKED_SITE}' WHEN regexp_matches(path, '\\.(pdf|jpg|jpeg|png|gif|webp|svg)$') THEN '{keys.BINARY_URL}' END AS reason FROM h""")
def skip_reason(t):
    """PRJ7: dead ends by host and by file type."""
    return t("pages").select("page_id", keys.skip_reason(_site()).alias("reason"))


@query(f"""WITH s AS (SELECT page_id, {_SITE_SQL} AS url FROM pages), h AS (SELECT page_id, {HOST} AS host FROM s)
SELECT page_id, host, len(list_filter([{", ".join(f"'{m}'" for m in keys.DELIVERY_MARKERS)}], lambda m: contains(host, m))) > 0 AS delivery FROM h""")
def is_delivery(t):
    """PRJ8."""
    host = keys.host_of(_site())
    return t("pages").select("page_id", host.alias("host"), keys.is_delivery(host).alias("delivery"))


@query("SELECT page_id, CASE page_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN false ELSE true END AS readable FROM pages")
def readable_content_type(t):
    """PRJ9."""
    kind = F.element_at(F.array(F.lit(""), F.lit("text/plain"), F.lit("application/xhtml+xml"), F.lit("application/pdf"), F.lit("application/json")), (F.col("page_id") % 5 + 1).cast("int"))
    return t("pages").select("page_id", keys.readable_content_type(kind).alias("readable"))


_RESP = "CASE doc_id % 6 WHEN 0 THEN '(scrape failed: x) ' || text WHEN 1 THEN '  ' WHEN 2 THEN ' (page not available)' ELSE text END"
_STATUS = "CASE WHEN r = '' THEN 'empty' WHEN starts_with(r, '(scrape failed') OR starts_with(r, '(page returned no content)') OR starts_with(r, '(page not available)') THEN 'error' WHEN length(r) < 200 THEN 'empty' ELSE 'ok' END"


def _response():
    k = F.col("doc_id") % 6
    return F.when(k == 0, F.concat(F.lit("(scrape failed: x) "), "text")).when(k == 1, "  ").when(k == 2, " (page not available)").otherwise(F.col("text"))


@query(f"SELECT doc_id, {_STATUS} AS status FROM (SELECT doc_id, regexp_replace({_RESP}, '^\\s+|\\s+$', '', 'g') AS r FROM documents)")
def scrape_status(t):
    """PRJ10."""
    return t("documents").select("doc_id", status.scrape_status(_response()).alias("status"))


@query(f"SELECT doc_id, CASE WHEN trim({_RESP}) <> '' THEN 'ok' ELSE 'empty' END AS status FROM documents")
def default_status(t):
    """PRJ11."""
    return t("documents").select("doc_id", status.default_status(_response()).alias("status"))


@query("SELECT doc_id, doc_id % 3 <> 0 AS cacheable FROM documents")
def is_cacheable(t):
    """PRJ12: failures of this machine's browser are not stored."""
    r = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x BrowserType.launch: "), "text")).otherwise(F.col("text"))
    return t("documents").select("doc_id", status.is_cacheable(r).alias("cacheable"))


_MD = "'![i](a.png) ![j](data:image/svg+xml,%3Csvg) DATA:text/plain,x [[in](tel:2)](tel:3) [cut](data:abc' || chr(10) || '![k](b.png)' || chr(10) || '* ' || chr(10) || '[](x)' || text || '[call](tel:1) [pic](b.JPG?x=1) [keep](http://a.b/c)' || chr(10) || chr(10) || chr(10) || chr(10) || 'z'"


def _markdown():
    return F.concat(F.lit("![i](a.png) ![j](data:image/svg+xml,%3Csvg) DATA:text/plain,x [[in](tel:2)](tel:3) [cut](data:abc\n![k](b.png)\n* \n[](x)"), F.col("text"), F.lit("[call](tel:1) [pic](b.JPG?x=1) [keep](http://a.b/c)\n\n\n\nz"))


#: A pass of the slimmer in SQL, written for its own sake: what goes, and what takes its place.
_SLIM_STEPS = (
    (r"'\x00'", "''"), (r"'(?i)data:[^\s)]*'", "''"), (r"'!\[[^\]]*\]\([^)]*\)'", "''"), (r"'\[\s*\]\([^)]*\)'", "''"),
    (r"'(?i)\[([^\]]+)\]\(\s*(?:(?:tel|mailto|javascript):|#)[^)]*\)|\[([^\]]+)\]\([^)]*\.(?:png|jpg|jpeg|gif|webp|svg|ico)(?:\?[^)]*)?\s*\)'", r"'\1\2'"),
    (r"'(?m)^[\t ]*[*+-][\t ]*$\n?'", "''"), (r"'\n\n\n+'", "chr(10) || chr(10)"),
)


def _slim_sql(x: str, passes: int = 5) -> str:
    for _ in range(passes):
        for what, to in _SLIM_STEPS:
            x = f"regexp_replace({x}, {what}, {to}, 'g')"
    return x


def _cap_sql(x: str, most: int) -> str:
    return f"CASE WHEN length({x}) > {most} THEN substr({x}, 1, {most}) || chr(10) || '... [truncated ' || (length({x}) - {most}) || ' chars]' ELSE {x} END"


@query(f"SELECT doc_id, {_slim_sql(_MD)} AS slim FROM documents")
def slim_text(t):
    """FN15: the markdown slimmer to its fixed point."""
    return t("documents").select("doc_id", text.slim(_markdown()).alias("slim"))


@query("SELECT doc_id, CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || chr(10) || '... [truncated ' || (length(text) - 1000) || ' chars]' ELSE text END AS capped FROM documents")
def cap_text(t):
    """FN17."""
    return t("documents").select("doc_id", text.cap(F.col("text"), 1000).alias("capped"))


@query(f"SELECT doc_id, {_cap_sql('x', 24000)} AS result FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_slim_sql(_MD)} ELSE {_MD} END AS x FROM documents)")
def tool_result(t):
    """FN18: fetches are slimmed and capped, other results capped."""
    name = F.when(F.col("doc_id") % 2 == 0, "scrape_url").otherwise("web_search")
    return t("documents").select("doc_id", text.transform_tool_result(name, _markdown()).alias("result"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>|<svg[^>]*>.*?</svg>|<template[^>]*>.*?</template>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS body FROM pages")
def html_text(t):
    """FN16 in its SQL form: text without tags, scripts and styles."""
    return t("pages").select("page_id", text.html_text(F.col("html")).alias("body"))


_PAGE = '<html><head><title>t</title></head><body><script>x()</script><h2>Menu {0}</h2><p>See <a href="/m/{0}">the <b>menu</b></a> or <img alt="i" src="data:image/png;base64,AA">.</p><ul><li>One &amp; two</li><li>Three</li></ul></body></html>'


@query("SELECT page_id, 't' || chr(10) || chr(10) || 'Menu ' || page_id || chr(10) || repeat('-', length('Menu ' || page_id)) || chr(10) || chr(10) || 'See [the **menu**](/m/' || page_id || ') or ![i]().' || chr(10) || chr(10) || '* One & two' || chr(10) || '* Three' AS md FROM pages")
def html_markdown(t):
    """FN16: headings, links, emphasis, images without inline data and lists as Markdown; the SQL has the result by hand."""
    page = F.replace(F.lit(_PAGE), F.lit("{0}"), F.col("page_id").cast("string"))
    return t("pages").select("page_id", text.html_markdown(page).alias("md"))


@query()
def page_markdown(t):
    """FN16 over all pages as they are."""
    return t("pages").select("page_id", text.html_markdown(F.col("html")).alias("md"))


@query("""WITH r AS (SELECT page_id // 5 AS q, row_number() OVER (PARTITION BY page_id // 5 ORDER BY page_id) AS i, url, html AS snippet FROM pages)
SELECT q, string_agg('[' || i || '] ' || url || chr(10) || '    ' || url || chr(10) || '    ' || snippet, chr(10) ORDER BY i) AS results FROM r GROUP BY q""")
def format_results(t):
    """FN19: numbered result blocks of a search."""
    from pyspark.sql import Window

    q = F.floor(F.col("page_id") / 5)
    r = t("pages").select(q.alias("q"), F.row_number().over(Window.partitionBy(q).orderBy("page_id")).alias("i"), "url", F.col("html").alias("snippet"))
    line = F.format_string("[%d] %s\n    %s\n    %s", "i", "url", "url", "snippet")
    return r.groupBy("q").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", line.alias("l")))), lambda x: x["l"]), "\n").alias("results"))


@query("WITH r AS (SELECT page_id // 5 AS q, string_agg('[' || page_id || '] t' || chr(10) || '    ' || url || chr(10) || '    s', chr(10) ORDER BY page_id) AS body FROM pages GROUP BY 1) SELECT q, u AS url FROM (SELECT q, unnest(regexp_extract_all(body, '(?m)^\\[\\d+\\][^\\n]*\\n\\s+(\\S+)', 1)) AS u FROM r)")
def extract_urls(t):
    """FN20: URLs out of formatted results."""
    line = F.concat(F.lit("["), "page_id", F.lit("] t\n    "), "url", F.lit("\n    s"))
    r = t("pages").groupBy(F.floor(F.col("page_id") / 5).alias("q")).agg(F.sort_array(F.collect_list(F.struct("page_id", line.alias("l")))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x["l"]), "\n")
    return r.select("q", F.explode(F.regexp_extract_all(body, F.lit(r"(?m)^\[\d+\][^\n]*\n\s+(\S+)"), 1)).alias("url"))


@query("""WITH q AS (SELECT c_custkey, i, trim(regexp_replace(replace(replace(x, '{name}', c_name), '{city}', n_name), '\\s+', ' ', 'g')) AS q FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES (1, '{name} {city} menu'), (2, '{name}  {CITY} menu'), (3, '{name} {city} MENU'), (4, '  ')) v(i, x))
SELECT c_custkey, q FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey, lower(q) ORDER BY i) AS rn FROM q WHERE q <> '') WHERE rn = 1""")
def render_queries(t):
    """FN21, WN3: templates filled, blanks and repeats (in any case) dropped."""
    from ..operators.ranking import keep_first
    from .standins import entities

    templates = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(("{name} {city} menu", "{name}  {CITY} menu", "{name} {city} MENU", "  "), 1)])
    e = entities(t).select(F.col("entity_id").alias("c_custkey"), "name", "city", F.explode(templates).alias("v"))
    q = F.trim(F.regexp_replace(F.replace(F.replace(F.col("v.x"), F.lit("{name}"), F.col("name")), F.lit("{city}"), F.col("city")), r"\s+", " "))
    e = e.select("c_custkey", F.col("v.i").alias("i"), q.alias("q")).where("q != ''").withColumn("l", F.lower("q"))
    return keep_first(e, ["c_custkey", "l"], ["i"]).select("c_custkey", "q")


@query("SELECT conv_id, CAST(floor(sum(length(text)) / CAST(3 AS DOUBLE)) + 512 AS BIGINT) AS tokens FROM conversations GROUP BY conv_id")
def token_estimate(t):
    """O-MSG14."""
    return t("conversations").groupBy("conv_id").agg(text.prompt_tokens(F.sum(F.length("text"))).alias("tokens"))


@query("SELECT user_id, CASE WHEN s >= 3600 THEN printf('%dh%02dm', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN printf('%dm%02ds', s // 60, s % 60) ELSE printf('%ds', s) END AS took FROM (SELECT user_id, CAST(floor(sum(value)) AS BIGINT) AS s FROM events GROUP BY 1)")
def format_duration(t):
    """FN29: floats are added one by one in the order of events, as the SQL does; other orders floor whole sums otherwise."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    so_far = t("events").select("user_id", F.row_number().over(w).alias("nth"), F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"))
    return so_far.groupBy("user_id").agg(F.floor(F.max_by("sum", "nth")).alias("s")).select("user_id", text.duration(F.col("s")).alias("took"))





@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 8 = 0 ELSE o_orderkey % 3 = 0 END AS conditioned FROM orders")
def is_conditioned(t):
    """PRJ13: by the record's own key if it has one (null is none), else by its id."""
    k = F.col("o_orderkey")
    r = F.when(k % 8 == 0, F.array(F.lit("vegan")))
    tid = F.when(k % 3 == 0, F.concat(k, F.lit("__vegan"))).otherwise(k.cast("string"))
    return t("orders").select("o_orderkey", status.is_conditioned(k % 4 == 0, r, tid).alias("conditioned"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN a IS NULL AND b IS NULL THEN true ELSE coalesce(abs(a - b) <= CAST(0.005 AS DOUBLE), false) END AS equal FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 5 <> 0 THEN l_extendedprice END AS a, CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice + l_tax / 10 END AS b FROM lineitem)")
def prices_equal(t):
    """FN14."""
    a, b = F.when(F.col("l_orderkey") % 5 != 0, F.col("l_extendedprice")), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice") + F.col("l_tax") / 10)
    return t("lineitem").select("l_orderkey", "l_linenumber", status.prices_equal(a, b).alias("equal"))
