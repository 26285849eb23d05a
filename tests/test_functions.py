import os
import random
import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from tracewright.functions import keys, status, text


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], [*values] or ["_"])
    return df.select(column.alias("x")).first()["x"]


def test_entity_id_ignores_case_and_space(spark):
    a = one(spark, keys.entity_id(F.col("n"), F.col("c")), n="  ssamjang ", c="ATLANTA")
    assert a == one(spark, keys.entity_id(F.col("n"), F.col("c")), n="Ssamjang", c="Atlanta") and len(a) == 16


@pytest.mark.parametrize("url, want", [
    ("HTTPS://Example.COM/Menu/?b=2&utm_source=x&a=#top", "https://example.com/Menu?a=&b=2"), ("http://x.com", "http://x.com/"),
    ("http://x.com/a?q=a%20b*~", "http://x.com/a?q=a+b%2A~"), ("http://x.com/?ref=1&GCLID=2", "http://x.com/?ref=1"),
])
def test_norm_url(spark, url, want):
    assert one(spark, keys.norm_url(F.col("u")), u=url) == want
    assert one(spark, keys.norm_url(F.col("u")), u=want) == want


@pytest.mark.parametrize("url, want", [
    ("https://www.doordash.com/x", keys.BLOCKED_SITE), ("https://a.yelp.ca/x", keys.BLOCKED_SITE), ("https://yelp.com:443/", None),
    ("https://x.com/a.PDF", keys.BINARY_URL), ("https://x.com/a?f=.pdf", None), ("https://notyelp.com/", None),
])
def test_skip_reason(spark, url, want):
    assert one(spark, keys.skip_reason(F.col("u")), u=url) == want


def test_restrictions(spark):
    assert one(spark, keys.normalize_restrictions(F.col("t")), t="Vegan, no nuts;vegan\n halal,,") == ["Vegan", "no nuts", "halal"]
    assert one(spark, keys.restriction_slug(F.col("t")), t=["No Nuts (any)", "x"]) == "no-nuts-any-x"
    assert one(spark, keys.restriction_slug(F.col("t")), t=["--"]) == "diet"
    assert one(spark, keys.trace_id(F.col("e"), F.col("r")), e="ab", r=["vegan"]) == "ab__vegan"


@pytest.mark.parametrize("response, want", [
    (" \n", "empty"), ("(scrape failed: x)", "error"), ("short", "empty"), ("y" * 200, "ok"), ("  (page not available)", "error"),
])
def test_scrape_status(spark, response, want):
    assert one(spark, status.scrape_status(F.col("r")), r=response) == want


def test_slim_settles(spark):
    md = "a\x00b ![i](data:image/png;base64,AA==)\n* ![x](y.png)\n[](z)[call us](tel:1) [menu](http://x/m)\n\n\n\nend"
    once = one(spark, text.slim(F.col("m")), m=md)
    assert once == "ab \ncall us [menu](http://x/m)\n\nend"
    assert one(spark, text.slim(F.col("m")), m=once) == once


def test_cap(spark):
    assert one(spark, text.cap(F.col("t"), 3), t="abcde").startswith("abc\n") and one(spark, text.cap(F.col("t"), 5), t="abcde") == "abcde"


def test_words_are_unicode(spark):
    assert one(spark, text.fold_words(F.col("t")), t="Café  (Straße)!") == "café strasse"


@pytest.mark.parametrize("a, b, want", [(12.0, 12.0, True), (9.99, 9.9949, True), (12.0, 12.5, False), (None, None, True), (None, 1.0, False)])
def test_prices(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a double, b double")
    assert df.select(status.prices_equal(F.col("a"), F.col("b"))).first()[0] is want


def test_unknown_policy_is_refused():
    with pytest.raises(ValueError):
        status.miss_policy("maybe", F.lit("search"), F.lit(None), F.lit(None))


def test_reward_order(spark):
    r = lambda g, f, n: one(spark, status.reward_grounding(F.lit(float(g)), F.lit(float(f)), F.lit(True), F.lit(n)))
    assert r(6, 1, 6) > r(0, 0, 0) == 0 > r(0, 0, 5) and abs(r(0, 0, 5) + 0.85) < 1e-9


@pytest.mark.parametrize("url, want", [
    ("foo.com/a", "foo.com/a"), ("www.bar.org", "www.bar.org"), ("//cdn.x/y", "//cdn.x/y"), ("mailto:a@b.c", "mailto:a@b.c"), ("localhost:8080/x/", "localhost:8080/x"), ("/only/path", "/only/path"), ("", "/"),
    ("http://x.com/?a=%zz+1", "http://x.com/?a=%25zz+1"), ("http://x.com/?b=%&a=1+2", "http://x.com/?a=1+2&b=%25"), ("http://x.com/?a=%2B", "http://x.com/?a=%2B"),
])
def test_norm_url_keeps_what_is_not_there(spark, url, want):
    assert one(spark, keys.norm_url(F.col("u")), u=url) == want


@pytest.mark.parametrize("md, want", [
    ("a data:image/svg+xml,<svg) b", "a ) b"), ("x DATA:font/woff;base64,AAA y", "x  y"), ("![i](data:image/png;base64,cut off", "![i]( off"),
    ("[[[[[[in](tel:1)](tel:2)](tel:3)](tel:4)](tel:5)](tel:6)", "in"), ("* ![i](x.png)\n* b", "* b"),
])
def test_slim_is_a_fixed_point(spark, md, want):
    assert one(spark, text.slim(F.col("m")), m=md) == want == text.settled(md) == text.settled(want)


@pytest.mark.parametrize("html, want", [
    ("<h1>Menu</h1><p>Try <a href='/m'>our <em>menu</em></a>.</p>", "Menu\n====\n\nTry [our *menu*](/m)."), ("<h2>a_b</h2>", "a\\_b\n----"), ("<h3>x<br>y <img alt=z src=u></h3>", "### x y z"),
    ("<ol><li>a<ul><li>b<ul><li>c</li></ul></li></ul></li><li>d</li></ol>", "1. a\n   * b\n     + c\n2. d"), ("<ul><li>a<ul><li>b<ul><li>c<ul><li>d</li></ul></li></ul></li></ul></li></ul>", "* a\n  + b\n    - c\n      * d"),
    ("<ol start=7><li>a<li>b</ol>", "7. a- b"), ("<script>x</script>a<br>b &amp; c<svg><p>no</p></svg>", "a  \nb & c"), ("<title>T</title>\n<body>x", "T\nx"),
    ("<table><tr><th>x</th><th>y*</th></tr><tr><td colspan=2>1</td></tr></table>", "| x | y\\* |\n| --- | --- |\n| 1 | |"), ("<table><tr><td>1</td></tr></table>", "|  |\n| --- |\n| 1 |"),
    ("", ""), ("no tags", "no tags"), ("<img src='data:image/gif;base64,A' alt='z' title='a \"b\"'>", "![z]( \"a \\\"b\\\"\")"), ("<p>open <b>bold", "open **bold**"), ("a<b> b </b>c<i></i>", "a **b** c"),
    ("<a href='http://a_b.c'>http://a_b.c</a> <a href=x></a><a>t</a>", "<http://a_b.c> t"), ("<code>a_b*</code> 2*3", "`a_b*` 2\\*3"), ("<pre>\n a_b\n  *c</pre>d", "```\n a_b\n  *c\n```\n\nd"),
    ("<blockquote>q<p>r</p></blockquote>", "> q\n>\n> r"), ("<p>a</p></b></p><hr>b", "a\n\n---\n\nb"), ("<i>a<p>b</i>c", "*a\n\nb*c"), ("<del>x</del>", "~~x~~"), ("<div>" * 4000 + "deep", "deep"),
])
def test_html_becomes_markdown(html, want):
    assert text.markdown_of(html) == want


def test_pages_as_another_writer_gives_them():
    """Random pages of blocks, written as HTML with loose ends and as Markdown by plain rules of their own."""
    rng = random.Random(8)
    words = lambda n: " ".join(rng.choices(["soup", "of", "the", "day", "café", "12"], k=n))

    def line():
        kind, t = rng.randrange(6), words(2)
        return [(t, t), (f"<b>{t}</b>", f"**{t}**"), (f"<em>{t}", f"*{t}*") if False else (f"<em>{t}</em>", f"*{t}*"), (f'<a href="/x?y=1">{t}</a>', f"[{t}](/x?y=1)"), (f"<code>{t}</code>", f"`{t}`"), (f'<img src="/i.png" alt="{t}">', f"![{t}](/i.png)")][kind]

    def lines(n):
        parts = [line() for _ in range(n)]
        return " ".join(h for h, _ in parts), " ".join(m for _, m in parts)

    def items(depth, ordered):
        html, md = "", []
        for k in range(rng.randint(1, 3)):
            h, m = lines(1)
            bullet = f"{k + 1}." if ordered else "*+-"[depth % 3]
            md.append(f"{bullet} {m}")
            if depth < 2 and rng.random() < 0.4 and not ordered:
                h2, m2 = items(depth + 1, False)
                h += h2
                md += [" " * (len(bullet) + 1) + x for x in m2]
            html += f"<li>{h}</li>\n"
        tag = "ol" if ordered else "ul"
        return f"<{tag}>\n{html}</{tag}>", md

    def block():
        kind = rng.randrange(7)
        if kind == 0:
            n, t = rng.randint(1, 6), words(3)
            return f"<h{n}> {t}\n</h{n}>", f"{t}\n{'=-'[n - 1] * len(t)}" if n < 3 else f"{'#' * n} {t}"
        if kind == 1:
            h, m = lines(3)
            return f"<p>{h}</p>" if rng.random() < 0.5 else f"<div><p>\n{h} </p></div>", m
        if kind in (2, 3):
            h, m = items(0, kind == 3)
            return h, "\n".join(m)
        if kind == 4:
            return "<hr>", "---"
        if kind == 5:
            rows = [[words(1) for _ in range(2)] for _ in range(2)]
            h = "".join("<tr>" + "".join(f"<{'td' if k else 'th'}>{c}</{'td' if k else 'th'}>" for c in r) + "</tr>\n" for k, r in enumerate(rows))
            return f"<table>{h}</table>", f"| {rows[0][0]} | {rows[0][1]} |\n| --- | --- |\n| {rows[1][0]} | {rows[1][1]} |"
        t = words(2)
        return f"<pre>{t}\n  {t}</pre>", f"```\n{t}\n  {t}\n```"

    for _ in range(300):
        parts = [block() for _ in range(rng.randint(1, 6))]
        html = "<html><body>" + rng.choice(["", "\n", "<script>a<b</script>"]).join(h for h, _ in parts) + rng.choice(["", "</body></html>", "</div></p>"])
        assert text.markdown_of(html) == "\n\n".join(m for _, m in parts), html


def test_markdown_of_all_pages_keeps_their_words(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test tables")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.select("html", text.html_text(F.col("html")).alias("plain"), text.html_markdown(F.col("html")).alias("md")).collect()
    for r in rows:
        said = lambda t: re.findall(r"[^\W_]+", t)
        md = re.sub(r"\]\([^)]*\)", "]", r["md"].replace("\\", ""))
        shown = re.findall(r"[^\W_]+", re.sub(r"!\[[^\]]*\]", "", md))
        assert [w for w in said(unescape(r["plain"]))] == shown, r["html"][:300]
        assert not re.search(r"<(?!https?:)[a-z/]", re.sub(r"(?s)```.*?```|`[^`]*`", "", md)) and len(rows) > 200


@pytest.mark.parametrize("seed", range(3))
def test_slim_on_random_markdown_is_the_loop(spark, seed):
    rng = random.Random(seed)
    signs = ["a", " ", "\n", "\n\n\n", "[", "](", ")", "![", "]", "tel:", "x.png", "?q", "data:", "* ", "- ", "+", "\t", "\0", "#", "é", "\xa0", "\r", "mailto:z", "http://a.b/c"]
    rows = [(k, "".join(rng.choices(signs, k=rng.randint(0, 40)))) for k in range(1500)] + [(9999, "[x](tel:1)" * 500 + "[" * 300 + "in" + "](#)" * 300)]
    df = spark.createDataFrame(rows, "k long, m string").repartition(4)
    got = {r["k"]: r["s"] for r in df.select("k", text.slim(F.col("m")).alias("s")).collect()}
    assert all(got[k] == text.settled(m) for k, m in rows)


def test_previews_and_percents(spark):
    assert one(spark, text.preview(F.col("t"), 3), t="abcdef").asDict() == {"preview": "abc", "truncated": True, "full_len": 6}
    assert one(spark, text.percent(F.col("x")), x=0.1234) == "12.3%"
    assert one(spark, text.percent(F.lit(None).cast("double"))) == "--"


@pytest.mark.parametrize("findable, found, want", [(True, True, "correct_find"), (True, False, "false_abstain"), (True, None, "false_abstain"), (False, True, "false_find"), (False, None, "correct_abstain")])
def test_abstention_outcomes(spark, findable, found, want):
    df = spark.createDataFrame([(findable, found)], "a boolean, b boolean")
    assert df.select(status.abstention(F.col("a"), F.col("b"))).first()[0] == want
