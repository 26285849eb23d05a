"""Identifiers, cache keys and URL rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, let

#: Query parameters that say nothing of the page.
TRACKING_PARAMS = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "gclsrc", "dclid",
    "msclkid", "mc_cid", "mc_eid", "ref_src", "igshid",
)
#: Hosts that answer no robot, and file types that are no page.
SKIP_DOMAINS = (
    "doordash.com", "ubereats.com", "grubhub.com", "seamless.com", "postmates.com", "yelp.com", "yelp.ca", "yelp.co.uk",
    "yelp.com.au", "opentable.com", "opentable.co.uk", "opentable.ca", "opentable.com.au", "facebook.com",
    "instagram.com", "restaurants-world.com", "restaurants-world.net", "menu-world.com", "menu-res.com", "res-menu.net",
)
SKIP_EXTENSIONS = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg")
#: Parts of delivery hosts' names.
DELIVERY_MARKERS = ("doordash", "ubereats", "grubhub", "yelp", "deliveroo", "skipthedishes", "menupix", "restaurantguru", "tripadvisor", "zomato")
#: Other names of country codes.
COUNTRY_ALIASES = {
    "GB": "UK", "UNITED KINGDOM": "UK", "USA": "US", "UNITED STATES": "US", "UNITED STATES OF AMERICA": "US", "CANADA": "CA", "AUSTRALIA": "AU",
}
#: The answers for dead ends.
BLOCKED_SITE = "(this site blocks automated access and returns no usable content -- try a different search result)"
BINARY_URL = "(this link is a file download, not a readable web page -- try a different search result)"
#: Schemes that are written with // even where there is no authority.
AUTHORITY_SCHEMES = (
    "", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms", "https", "shttp", "snews", "prospero",
    "rtsp", "rtsps", "rtspu", "rsync", "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services",
)
#: Scheme, authority, path and query of any text; all but the path may be missing.
_URL = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def entity_id(name: Column, city: Column) -> Column:
    """16 hex digits of the sha1 of collapsed name and city."""
    return F.substring(F.sha1(F.concat_ws("|", collapse(name), collapse(city))), 1, 16)


def restriction_slug(restrictions: Column) -> Column:
    """Restrictions joined, lower case, other characters to single hyphens, none at the ends, then cut at 60; ``diet`` if empty."""
    s = F.regexp_replace(F.lower(F.array_join(restrictions, "-")), "[^a-z0-9]+", "-")
    s = F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, 60)
    return F.when(s == "", F.lit("diet")).otherwise(s)


def trace_id(entity: Column, restrictions: Column) -> Column:
    """The entity's id, with the slug of restrictions if there are any."""
    return F.when(F.coalesce(F.size(restrictions), F.lit(0)) > 0, F.concat(entity.cast("string"), F.lit("__"), restriction_slug(restrictions))).otherwise(entity.cast("string"))


def norm_query(q: Column) -> Column:
    return collapse(q)


def host_of(url: Column) -> Column:
    """Lower-case network location without one leading www.; empty where the URL has none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), _URL, 2)), r"^www\.", "")


def _unquoted(part: Column) -> Column:
    """Plus signs as spaces and valid escapes decoded; a percent sign that begins no escape stays."""
    return F.url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def _quoted(part: Column) -> Column:
    """Encoded by one rule: ~ stays, * is escaped, spaces are plus signs."""
    return F.replace(F.replace(F.url_encode(part), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def norm_url(url: Column) -> Column:
    """Lower-case scheme and host, no trailing slashes, fragment or tracking parameters, parameters sorted and re-encoded.

    A URL without a scheme or an authority keeps what it has, so different ones stay different.
    """
    u = F.trim(url)
    scheme, host = F.lower(F.regexp_extract(u, _URL, 1)), F.lower(F.regexp_extract(u, _URL, 2))
    path = F.regexp_replace(F.regexp_extract(u, _URL, 3), "/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    pairs = F.filter(F.split(F.coalesce(F.regexp_extract(u, _URL, 4), F.lit("")), "&"), lambda p: p != "")
    pairs = F.transform(pairs, lambda p: F.struct(_unquoted(F.substring_index(p, "=", 1)).alias("k"), _unquoted(F.when(F.instr(p, "=") > 0, F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v")))
    pairs = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_PARAMS)))
    query = F.array_join(F.transform(pairs, lambda p: F.concat(_quoted(p["k"]), F.lit("="), _quoted(p["v"]))), "&")
    rooted = F.startswith(path, F.lit("/"))
    body = (
        F.when(host != "", F.concat(F.lit("//"), host, F.when(rooted, F.lit("")).otherwise("/"), path))
        .when(F.startswith(path, F.lit("//")), F.concat(F.lit("//"), path))
        .when((scheme != "") & scheme.isin(*AUTHORITY_SCHEMES) & rooted, F.concat(F.lit("//"), path))
        .otherwise(path)
    )
    base = F.when(scheme != "", F.concat(scheme, F.lit(":"), body)).otherwise(body)
    return F.when(query == "", base).otherwise(F.concat(base, F.lit("?"), query))


def norm_scrape(url: Column, mode: Column | None = None) -> Column:
    """Canonical URL and mode (``direct`` by default), parted by NUL."""
    return F.concat(norm_url(url), F.char(F.lit(0)), F.coalesce(mode, F.lit("direct")) if mode is not None else F.lit("direct"))


def cache_key(namespace: Column, key: Column, version: Column) -> Column:
    """sha256 of namespace, key and version, parted by NULs."""
    nul = F.char(F.lit(0))
    return F.sha2(F.concat(namespace, nul, key, nul, version.cast("string")), 256)


def norm_country(x: Column) -> Column:
    """Upper-case country code, aliases resolved."""
    key = F.upper(F.trim(x))
    aliases = F.create_map(*[F.lit(v) for pair in COUNTRY_ALIASES.items() for v in pair])
    return F.coalesce(F.try_element_at(aliases, key), key)


def normalize_restrictions(x: Column) -> Column:
    """Text split at commas, semicolons and line ends; trimmed, empty ones dropped, the first of equal ones (any case) kept."""
    parts = F.filter(F.transform(F.split(x, r"[,\n;]"), lambda p: F.trim(p)), lambda p: p != "")
    sorted_ = F.sort_array(F.transform(parts, lambda p, i: F.struct(F.lower(p).alias("low"), i.alias("i"), p.alias("p"))))  # equal ones lie together
    first = let(sorted_, lambda s: F.filter(s, lambda x, k: (k == 0) | (x["low"] != F.get(s, k - 1)["low"])))
    return F.transform(F.sort_array(F.transform(first, lambda x: F.struct(x["i"], x["p"]))), lambda x: x["p"])


def skip_reason(url: Column) -> Column:
    """The answer for a dead end, or null. The host keeps its port, so a port hides a blocked domain."""
    host = host_of(url)
    blocked = F.exists(F.array(*[F.lit(d) for d in SKIP_DOMAINS]), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))
    path = F.lower(F.regexp_extract(F.trim(url), _URL, 3))
    binary = F.exists(F.array(*[F.lit(e) for e in SKIP_EXTENSIONS]), lambda e: F.endswith(path, e))
    return F.when(blocked, F.lit(BLOCKED_SITE)).when(binary, F.lit(BINARY_URL))


def is_delivery(host: Column) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in DELIVERY_MARKERS]), lambda m: F.contains(host, m))


def readable_content_type(x: Column) -> Column:
    """Empty, text/*, or anything of html, xml or json."""
    x = F.coalesce(x, F.lit(""))
    return (x == "") | F.startswith(x, F.lit("text/")) | F.contains(x, F.lit("html")) | F.contains(x, F.lit("xml")) | F.contains(x, F.lit("json"))
