"""Text normalisers and transforms as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stored texts, text fed to a model, and its smaller variant, in code points.
MAX_STORED_CHARS, MAX_TOOL_CHARS, SMALL_TOOL_CHARS = 400_000, 24_000, 16_000
#: What a page loses, in this order: inline data, images, links without text, links to nothing that can be
#: read (their text stays), bullets with nothing after them, and blank lines beyond one.
SLIM_PATTERNS = (
    (r"(?i)data:[^\s)]*", ""),
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"\[\s*\]\(\s*[^)]*\)", ""),
    (r"(?i)\[([^\]]+)\]\(\s*(?:tel:|mailto:|javascript:|#)[^)]*\)|\[([^\]]+)\]\(\s*[^)]*\.(?:png|jpe?g|gif|webp|svg|ico)(?:\?[^)]*)?\s*\)", "$1$2"),
    (r"(?m)^[ \t]*[-*+][ \t]*$\n?", ""),
    (r"\n{3,}", "\n\n"),
)
_SLIM_PYTHON = [(re.compile(p), to.replace("$", "\\")) for p, to in SLIM_PATTERNS]


def collapse(x: Column) -> Column:
    """Lower case, runs of white space to one space, none at the ends; punctuation stays."""
    return F.trim(F.regexp_replace(F.lower(x), r"(?U)\s+", " "))


def fold_words(x: Column) -> Column:
    """Case-folded (ß as ss), all but word characters and white space to spaces, collapsed."""
    folded = F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def name_words(x: Column) -> Column:
    """As ``fold_words`` but in plain lower case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def canon_token(x: Column) -> Column:
    """Lower case, a-z and 0-9 only."""
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def cap(x: Column, most: int = MAX_TOOL_CHARS) -> Column:
    """The first ``most`` code points, and a note of how many were left out."""
    over = F.length(x) - most
    note = F.concat(F.lit("\n... [truncated "), over.cast("string"), F.lit(" chars]"))
    return F.when(over > 0, F.concat(F.substring(x, 1, most), note)).otherwise(x)


#: What ``\s`` is in the patterns, which are Python's; only a line feed ends a line.
_SPACES = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SLIM_JAVA = [(p.replace(r"[^\s", "[^" + _SPACES).replace(r"\s*", f"[{_SPACES}]*").replace("(?m)", "(?md)"), to) for p, to in SLIM_PATTERNS]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def slim_once(x: Column) -> Column:
    """One pass of the slimmer: NULs, data URIs, images, empty links, dead links (their text stays), empty bullets, blank runs.

    Patterns are tried only where a text has the signs that they need.
    """
    links = lambda t: F.contains(t, F.lit("]("))
    needs = (lambda t: F.contains(F.lower(t), F.lit("data:")), links, links, links, lambda t: F.lit(True), lambda t: F.contains(t, F.lit("\n\n\n")))

    def apply(k: int, t: Column) -> Column:
        if k == len(_SLIM_JAVA):
            return t
        pattern, to = _SLIM_JAVA[k]
        return let(F.when(needs[k](t), F.regexp_replace(t, pattern, to)).otherwise(t), lambda new: apply(k + 1, new))

    return let(F.replace(x, F.char(F.lit(0)), F.lit("")), lambda t: apply(0, t))


def has_slack(x: Column) -> Column:
    """Whether a pass of the slimmer would change a text: each of its matches is taken out or made shorter."""
    data, image, empty, dead, bullet, _ = (p for p, _ in _SLIM_JAVA)
    linked = F.contains(x, F.lit("](")) & (x.rlike(image) | x.rlike(empty) | x.rlike(dead))
    return F.contains(x, F.char(F.lit(0))) | F.contains(F.lower(x), F.lit("data:")) | linked | F.contains(x, F.lit("\n\n\n")) | x.rlike(bullet)


def settled(md: str) -> str:
    """The slimmer's fixed point; every pass but the last makes the text shorter."""
    last = None
    while md != last:
        last, md = md, md.replace("\0", "")
        for pattern, to in _SLIM_PYTHON:
            md = pattern.sub(to, md)
    return md


def slim(x: Column) -> Column:
    """The slimmer's fixed point: passes until a text has nothing that one would change; most texts are only looked at.

    Every pass takes one of the characters counted here, so there are no more passes than those. Their number is a
    square, so that a text that is done early is left after its root's many steps.
    """

    def passes(text: Column) -> Column:
        side = F.ceil(F.sqrt(F.regexp_count(text, F.lit(r"[\x00\[\n*+:-]")) + 1)).cast("int")
        once = lambda at: let(slim_once(at["text"]), lambda y: F.struct(y.alias("text"), (~has_slack(y)).alias("done")))
        unless = lambda at, more: F.when(at["done"], at).otherwise(more)
        start = F.struct(text.alias("text"), F.lit(False).alias("done"))
        row = lambda at, n: F.aggregate(F.sequence(F.lit(1), n), at, lambda now, _: unless(now, once(now)))
        return let(side, lambda n: F.aggregate(F.sequence(F.lit(1), n), start, lambda at, _: unless(at, row(at, n)), lambda at: at["text"]))

    return let(x, lambda t: F.when(has_slack(t), passes(t)).otherwise(t))


def transform_tool_result(name: Column, text: Column, most: int = MAX_TOOL_CHARS) -> Column:
    """Results of a page fetch are slimmed and capped, others capped."""
    return F.when(name == "scrape_url", cap(slim(text), most)).otherwise(cap(text, most))


def preview(x: Column, most: int = 800) -> Column:
    """struct(preview, truncated, full_len)."""
    return F.struct(F.substring(x, 1, most).alias("preview"), (F.length(x) > most).alias("truncated"), F.length(x).alias("full_len"))


def html_text(x: Column) -> Column:
    """Text of an HTML page without scripts, styles, templates and tags, white space collapsed; entities stay."""
    x = F.regexp_replace(x, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<noscript[^>]*>.*?</noscript>|<svg[^>]*>.*?</svg>|<template[^>]*>.*?</template>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " "))


class _Node:
    """An element with its children, texts among them."""

    __slots__ = ("attrs", "children", "depth", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: _Node | None):
        self.tag, self.attrs, self.parent, self.children, self.depth = tag, attrs, parent, [], parent.depth + 1 if parent else 0

    def ancestors(self) -> Iterator[_Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class _Tree(HTMLParser):
    """A page's elements, whatever is unclosed or closed out of turn: an end closes all up to its start, or nothing.

    What is nested deeper than DEPTH elements lies beside them.
    """

    DEPTH = 150
    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in self.VOID and (node.depth < self.DEPTH or tag in _DROPPED):
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


#: Elements whose contents are no text, those that stand on lines of their own, and signs around others (fixed values).
_DROPPED = frozenset({"script", "style", "noscript", "svg", "template"})
_BLOCKS = frozenset("p div section article header footer main nav aside ul ol li table tr td th thead tbody tfoot caption blockquote pre form figure figcaption address dl dt dd h1 h2 h3 h4 h5 h6 hr".split())
_SIGNS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "kbd": "`", "samp": "`", "del": "~~", "s": "~~"}
_HEADINGS, _BULLETS = {f"h{n}": n for n in range(1, 7)}, "*+-"
_RAW = frozenset({"pre", "code", "kbd", "samp"})


def _around(text: str) -> tuple[str, str, str]:
    """A text's leading space, the text, its trailing space."""
    inner = text.strip()
    return (" " if text[0] == " " else "", inner, " " if text[-1] == " " else "") if inner else ("", "", "")


def _joined(parts: list[str]) -> str:
    """Parts one after the other; where line ends meet, the larger number of them stays, two at most."""
    both = lambda a, b: min(2, max(a, b)) if a and b else a + b
    out, ends = [], 0
    for p in parts:
        body = p.lstrip("\n")
        ends = both(ends, len(p) - len(body))
        if body:
            core = body.rstrip("\n")
            out += ["\n" * ends, core]
            ends = len(body) - len(core)
    return "".join(out) + "\n" * ends


class _Writer:
    """Markdown of a tree: headings of two levels underlined and others by signs, stars and underscores of texts escaped,
    bullets by depth, spaces before forced line ends, a link to its own text in angle brackets; in headings and cells all
    is on one line, and an image is its description."""

    def __init__(self):
        self.items: dict[int, int] = {}  # of each list, its items so far
        self.begun: set[int] = set()  # tables with a row

    def text(self, node: _Node, data: str, before, after) -> str:
        tags = {node.tag, *(x.tag for x in node.ancestors())}
        if "pre" in tags:
            return data
        data = re.sub(r"[\t \r\n]*[\r\n][\t \r\n]*", "\n", re.sub(r"[\t ]+", " ", data))
        block = lambda x: isinstance(x, _Node) and (x.tag in _BLOCKS or x.tag == "br")
        if before is None and node.tag in _BLOCKS or block(before) or before is None and not node.tag:
            data = data.lstrip(" \t\r\n")
        if after is None and node.tag in _BLOCKS or block(after) and after.tag != "br" or after is None and not node.tag:
            data = data.rstrip(" \t\r\n")
        return data if tags & _RAW else data.replace("*", "\\*").replace("_", "\\_")

    def inside(self, node: _Node, line: bool) -> str:
        parts, children = [], node.children
        for k, c in enumerate(children):
            if isinstance(c, str):
                parts.append(self.text(node, c, children[k - 1] if k else None, children[k + 1] if k + 1 < len(children) else None))
            elif c.tag not in _DROPPED:
                parts.append(self.element(c, line))
        return _joined([p for p in parts if p])

    def element(self, node: _Node, line: bool) -> str:
        tag, flat = node.tag, line or node.tag in _HEADINGS or node.tag in ("td", "th")
        text = self.inside(node, flat)
        if tag in _HEADINGS:
            n, text = _HEADINGS[tag], re.sub(r"\s+", " ", text.strip())
            if line or not text:
                return text
            return f"\n\n{text}\n{'=-'[n - 1] * len(text)}\n\n" if n <= 2 else f"\n\n{'#' * n} {text}\n\n"
        if tag in _SIGNS:
            if tag in _RAW and any(x.tag in ("pre", "code", "kbd", "samp") for x in node.ancestors()):
                return text
            a, inner, b = _around(text)
            return f"{a}{_SIGNS[tag]}{inner}{_SIGNS[tag]}{b}" if inner else ""
        made = getattr(self, f"_{tag}", None)
        if made:
            return made(node, text, line)
        if tag in ("ul", "ol"):
            return self._list(node, text)
        if tag in ("div", "section", "article", "dl", "figure", "header", "footer", "main", "nav", "aside", "form", "address"):
            inner = text.strip()
            return f" {inner} " if line and inner else f"\n\n{inner}\n\n" if inner else ""
        return text

    def _a(self, node, text, line):
        a, inner, b = _around(text)
        href, title = node.attrs.get("href"), node.attrs.get("title")
        if not inner:
            return ""
        if href and inner.replace("\\_", "_") == href and not title:
            return f"<{href}>"
        named = ' "' + title.replace('"', '\\"') + '"' if title else ""
        return f"{a}[{inner}]({href}{named}){b}" if href else text

    def _img(self, node, text, line):
        alt, src, title = (node.attrs.get(k) or "" for k in ("alt", "src", "title"))
        named = ' "' + title.replace('"', '\\"') + '"' if title else ""
        return alt if line else f"![{alt}]({src}{named})"

    def _br(self, node, text, line):
        return " " if line else "  \n"

    def _hr(self, node, text, line):
        return "\n\n---\n\n"

    def _p(self, node, text, line):
        inner = text.strip()
        return f" {inner} " if line and inner else f"\n\n{inner}\n\n" if inner else ""

    def _blockquote(self, node, text, line):
        inner = text.strip()
        if line:
            return f" {inner} "
        return "\n" + "\n".join(f"> {x}" if x else ">" for x in inner.split("\n")) + "\n\n" if inner else "\n"

    def _pre(self, node, text, line):
        return "\n\n```\n" + text.strip("\n") + "\n```\n\n" if text else ""

    def _list(self, node, text):
        nested = any(x.tag == "li" for x in node.ancestors())
        return "\n" + text.rstrip() if nested else f"\n\n{text}\n" if text.strip() else ""

    def _li(self, node, text, line):
        parent, text = node.parent, text.strip()
        if parent is not None and parent.tag == "ol":
            start = str(parent.attrs.get("start") or "1")
            nth = self.items[id(parent)] = self.items.get(id(parent), -1) + 1
            bullet = f"{(int(start) if start.isdigit() else 1) + nth}."
        else:
            depth = sum(x.tag == "ul" for x in node.ancestors())
            bullet = _BULLETS[(depth - 1) % len(_BULLETS)]
        if not text:
            return f"{bullet}\n"
        indent = " " * (len(bullet) + 1)
        return f"{bullet} " + "\n".join(indent + x if k and x else x for k, x in enumerate(text.split("\n"))) + "\n"

    def _td(self, node, text, line):
        span = str(node.attrs.get("colspan") or "1")
        return " " + re.sub(r"\s+", " ", text.strip()) + " |" * (min(1000, max(1, int(span))) if span.isdigit() else 1)

    _th = _td

    def _tr(self, node, text, line):
        cells = [c for c in node.children if isinstance(c, _Node) and c.tag in ("td", "th")]
        table = next((x for x in node.ancestors() if x.tag == "table"), None)
        first = table is not None and id(table) not in self.begun
        self.begun.add(id(table))
        width = sum(int(c.attrs["colspan"]) if str(c.attrs.get("colspan") or "").isdigit() else 1 for c in cells)
        rule = "| " + " | ".join(["---"] * width) + " |\n" if first and width else ""
        head = first and all(c.tag == "th" for c in cells)
        blank = "| " + " | ".join([""] * width) + " |\n" if rule and not head else ""
        return f"{blank}{rule}|{text}\n" if blank else f"|{text}\n{rule}"

    def _table(self, node, text, line):
        return f"\n\n{text.strip()}\n\n" if text.strip() else ""


def markdown_of(html: str) -> str:
    """A page as Markdown without scripts, styles, templates, drawings and inline data."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return _SLIM_PYTHON[0][0].sub("", _Writer().inside(tree.root, False).strip())


@F.pandas_udf(T.StringType())
def html_markdown(pages: pd.Series) -> pd.Series:
    """HTML pages as Markdown, as ``markdown_of`` gives them; null for null."""
    return pages.map(lambda h: None if h is None else markdown_of(h))


def percent(x: Column, places: int = 1) -> Column:
    """A share as percent text, ``--`` where it is null."""
    return F.when(x.isNotNull(), F.format_string(f"%.{places}f%%", x * 100.0)).otherwise("--")


def duration(seconds: Column) -> Column:
    """Seconds as h/m/s text."""
    s = F.floor(seconds)
    return (
        F.when(s >= 3600, F.format_string("%dh%02dm", F.floor(s / 3600), F.floor(s % 3600 / 60)))
        .when(s >= 60, F.format_string("%dm%02ds", F.floor(s / 60), s % 60))
        .otherwise(F.format_string("%ds", s))
    )


def prompt_tokens(chars: Column) -> Column:
    """Estimated prompt tokens of so many characters."""
    return F.floor(chars / 3) + 512
