"""Personal data in texts: labelers vote on spans, expectation-maximisation weighs them, a trained classifier decides.

All work on texts is DataFrame functions; the driver fits two small models on tables of counts whose size is fixed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
#: What a base span of each kind is (fixed values): leftmost matches that do not overlap.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches in linear time on any text: runs are taken whole, and a match begins where a run does or the last ended.
_FAST = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DOT, _AT = r"(?:\.|\x20?[\[(]\x20?(?:\.|(?i:dot))\x20?[\])]\x20?)", r"(?:@|\x20?[\[(]\x20?(?:@|(?i:at))\x20?[\])]\x20?)"
#: What may be a span: looser forms, each bounded in length; base spans come first where they meet.
LOOSE = {
    "email": rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]{{1,64}}+(?:{_AT}[\p{{L}}\p{{N}}-]{{1,63}}+(?:{_DOT}[\p{{L}}\p{{N}}-]{{1,63}}+){{0,8}}+|\x20(?i:at)\x20[\p{{L}}\p{{N}}-]{{1,63}}+(?:(?:\x20(?i:dot)\x20|\.)[\p{{L}}\p{{N}}-]{{1,63}}+){{1,8}}+)",
    "ip": r"(?<![\p{L}\p{N}.])[0-9]{1,5}+(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,5}+){3}(?![\p{L}\p{N}]|\.[0-9])",
    "card": r"(?<![\p{L}\p{N}])(?:[0-9]{13,19}+|[0-9]{4}([\x20./-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}+|[0-9]{4}([\x20./-])[0-9]{6}\2[0-9]{4,5}+)(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}.])(?:(?:\+|00)[0-9]{1,3}+[\x20./-]?)?+(?:\([0-9]{2,5}+\)[\x20./-]?|[0-9]{2,5}[\x20./-])[0-9]{2,4}+(?:[\x20./-][0-9]{2,5}+){0,3}(?![\p{L}\p{N}]|\.[0-9])",
}
#: Signs of which a text must have one before a loose form is sought in it.
_HINTS = {"email": ("@", "[at", "(at", "[AT", "(AT", "[At", "(At", "[ at", "( at", " dot ", " DOT ", " Dot ")}
#: Gazetteers (fixed values): top-level domains, endings of files, issuers' prefixes with the lengths of their numbers, and country calling codes.
DOMAINS = "com org net edu gov mil int info biz io co ai app dev me eu uk us ca au nz ie de at ch fr be nl lu es pt it mx ar cl br se no dk fi pl cz ru jp cn kr in za"
FILE_ENDINGS = "png jpg jpeg gif svg webp css js json html htm xml txt pdf md py java sh exe zip gz"
ISSUERS = r"^(?:4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2}|4[4-9][0-9])[0-9]{12,15}|3(?:0[0-5]|[68][0-9])[0-9]{11}|35[0-9]{14}|62[0-9]{14,17})$"
CALLING_CODES = r"^\+(?:1|7|2[07]|21[1-8]|2[2-69][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-3]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]|8[1246]|8[58][0-9]|9[0-58]|9[679][0-9])"
#: Context (fixed values): words before a span that speak for its kind, and words that speak against any.
FOR = {
    "email": r"e-?mail|correo|courriel|contact|kontakt|write\b|reach\b|schreib|escrib|mailto",
    "ip": r"\bip\b|ipv4|\bhost|server|serveur|servidor|client|gateway|ping\b|login from",
    "card": r"card|karte|carte|tarjeta|visa|mastercard|amex|credit|kredit|cr[eé]dit",
    "phone": r"\btel|phone|t[eé]l[eé]phone|telefon|tel[eé]fono|call\b|fax|mobil|m[oó]vil|handy|cell|whatsapp|ruf",
}
AGAINST = r"(?:order|invoice|rechnung|factura|facture|version|\bv|release|isbn|issn|doi|token|password|passwort|hash|sha|uuid|serial|page|chapter|section|http|www|figure|table)[^\p{L}\p{N}]{0,3}$"
VOTES = ("form", "structure", "gazetteer", "context", "edge", "variety")
#: Features of the final classifier with how many values each has.
FEATURES = {"length": 4, "separators": 4, "before": 3, "after": 3, "context": 3, "structure": 3}
_BLOCK = 256
_ITEM = "st int, en int, kind int, base boolean, votes int, features int"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, value: Callable[[Column], Column], combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """Of each item what all before it combine to; blocks are run apart, so long arrays take time in proportion."""
    start = F.struct(F.lit(zero).alias("now"), F.array().cast("array<int>").alias("seen"))

    def over(part: Column, of: Callable[[Column], Column]) -> Column:
        return F.aggregate(part, start, lambda acc, x: F.struct(combine(acc["now"], of(x)).cast("int").alias("now"), F.array_append(acc["seen"], acc["now"]).alias("seen")))

    def joined(blocks: Column) -> Column:
        return let(over(blocks, lambda b: b["now"])["seen"], lambda offs: F.flatten(F.transform(blocks, lambda b, i: F.transform(b["seen"], lambda v: combine(v, F.get(offs, i)).cast("int")))))

    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _BLOCK).cast("int")), lambda b: over(F.slice(all_, b * _BLOCK + 1, F.lit(_BLOCK)), value))
    return let(items, lambda all_: F.when(F.size(all_) > 0, let(cut(all_), joined)).otherwise(F.array().cast("array<int>")))


_MATCH = "array<struct<st:int,en:int,t:string,before:string,after:string>>"


def matches(text: Column, pattern: str, around: int = 40) -> Column:
    """All matches in order: struct(st, en, t, before, after); places are code points, texts around reach to the next match at most.

    A text is split at the matches: what lies between them tells where they are.
    """

    def place(found: Column) -> Column:
        def part(gaps: Column) -> Column:
            one = lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("n"), m.alias("t"), F.substring(F.get(gaps, i), F.lit(-around), F.lit(around)).alias("before"), F.substring(F.get(gaps, i + 1), 1, 2).alias("after"))
            return F.transform(found, one)

        def placed(parts: Column) -> Column:
            begins = running(parts, lambda p: p["gap"] + p["n"], lambda a, b: a + b, 0)
            return F.zip_with(parts, begins, lambda p, s: F.struct((s + p["gap"]).alias("st"), (s + p["gap"] + p["n"]).alias("en"), p["t"].alias("t"), p["before"].alias("before"), p["after"].alias("after")))

        return let(let(F.split(text, pattern, -1), part), placed)

    none = F.array().cast(_MATCH)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, place(found).cast(_MATCH)).otherwise(none))


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a number of digits passes Luhn's check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:[^0-9]+0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"


def passes(kind: str, t: Column) -> Column:
    """Whether a match of the base pattern is a base span."""
    if kind == "ip":
        return t.rlike(_OCTETS)
    if kind == "card":
        return let(_digits(t), lambda d: F.length(d).between(13, 19) & F.when(F.length(d) < 20, luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(t)).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """2 for, 0 against, 1 abstains; yes goes before no."""
    out = F.when(yes, 2)
    return (out.when(no, 0) if no is not None else out).otherwise(1)


def votes(kind: str, m: Column) -> dict[str, Column]:
    """The labelers' votes on a match: regex forms, structure or checksum, gazetteer, context, edges, variety of signs."""
    t, before, after = m["t"], m["before"], m["after"]
    d = _digits(t)
    near = before.rlike(rf"(?i)(?:{FOR[kind]})")
    out = {
        "context": _vote(near, before.rlike(rf"(?i){AGAINST}")),
        "edge": _vote(before.rlike(r"(?:^|[\s\[({<\"'«:;,.!?>])$") & after.rlike(r"^(?:$|[\s\])}>\"'»:;,!?<.])"), before.rlike(r"[=/\\_#@&%$+-]$") | after.rlike(r"^[=/\\_#@&%$+]")),
        "variety": _vote(F.size(F.array_distinct(F.split(F.when(F.lit(kind == "email"), t).otherwise(d), ""))) >= 4, F.lit(True)),
    }
    if kind == "email":
        ending = F.lower(F.regexp_extract(t, r"([\p{L}\p{N}-]+)$", 1))
        plain = t.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+$")
        out |= {
            "form": _vote(plain, ~t.rlike(r"[@\[(]|(?i:\x20at\x20)")),
            "structure": _vote(t.rlike(r"(?:\.|(?i:dot)[\])]?\x20?)[\p{L}]{2,24}$"), F.lit(True)),
            "gazetteer": _vote(ending.isin(*DOMAINS.split()), ending.isin(*FILE_ENDINGS.split())),
        }
    elif kind == "ip":
        first = F.regexp_extract(t, r"^0*([0-9]+)", 1)
        out |= {
            "form": _vote(t.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), t.rlike("[0-9]{4}")),
            "structure": _vote(t.rlike(_OCTETS), F.lit(True)),
            "gazetteer": _vote(t.rlike(_OCTETS) & F.coalesce(first.try_cast("int").between(1, 223), F.lit(False)), F.lit(True)),
            "variety": _vote(F.length(d) >= 7, F.length(d) == 4),
        }
    elif kind == "card":
        out |= {
            "form": _vote(t.rlike(r"^(?:[0-9]{15,16}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})$"), t.rlike("[./]")),
            "structure": _vote(F.when(F.length(d) < 20, luhn(d)).otherwise(False), F.lit(True)),
            "gazetteer": _vote(d.rlike(ISSUERS), F.lit(True)),
        }
    else:
        out |= {
            "form": _vote(t.rlike(r"^\+|\([0-9]+\)"), t.rlike(r"^(?:19|20)[0-9]{2}[./-][0-9]{2}[./-][0-9]{2}|^[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)?[0-9]{2}")),
            "structure": _vote(F.length(d).between(9, 15), F.length(d) < 7),
            "gazetteer": _vote(t.rlike(CALLING_CODES) | t.rlike(r"\([2-9][0-9]{2}\)\x20?[0-9]{3}[\x20.-]?[0-9]{4}$"), t.rlike(r"^\+")),
        }
    return {v: out[v] for v in VOTES}


def _features(m: Column, vote: dict[str, Column]) -> dict[str, Column]:
    n, t, before, after = F.length(m["t"]), m["t"], m["before"], m["after"]
    return {
        "length": F.when(n < 10, 0).when(n < 16, 1).when(n < 24, 2).otherwise(3),
        "separators": F.when(t.rlike(r"[()\[\]]"), 3).when(t.rlike(r"\s"), 2).when(t.rlike(r"[./-]"), 1).otherwise(0),
        "before": F.when(before.rlike(r"(?:^|\s)$"), 0).when(before.rlike(r"[\p{L}\p{N}_=/#\\]$"), 2).otherwise(1),
        "after": F.when(after.rlike(r"^(?:$|\s)"), 0).when(after.rlike(r"^[\p{L}\p{N}_=/#\\]"), 2).otherwise(1),
        "context": vote["context"], "structure": vote["structure"],
    }


def _coded(parts: list[tuple[Column, int]]) -> Column:
    """One number of several small ones."""
    out = F.lit(0)
    for value, size in parts:
        out = out * size + value
    return out.cast("int")


_ITEMS = f"array<struct<{_ITEM.replace(', ', ',').replace(' ', ':')}>>"


def _items(kind: str, base: bool) -> Column:
    """Base spans of a kind in the column ``text``, or its loose matches, with votes and features."""

    def item(m: Column) -> Column:
        vote = votes(kind, m)
        votes_code = _coded([(vote[v], 3) for v in VOTES])
        features_code = _coded([(f, FEATURES[c]) for c, f in _features(m, vote).items()])
        return F.struct(m["st"].alias("st"), m["en"].alias("en"), F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"), votes_code.alias("votes"), features_code.alias("features"))

    kept = lambda found: F.transform(F.filter(found, lambda m: passes(kind, m["t"])) if base else found, item)
    return let(matches(F.col("text"), (_FAST if base else LOOSE)[kind]), kept).cast(_ITEMS)


def apart_from(items: Column, against: Callable[[Column], Column]) -> Column:
    """The items but those for which ``against`` is false and that overlap one for which it is true."""
    far = (1 << 31) - 1

    def keep(all_: Column) -> Column:
        ends = running(all_, lambda x: F.when(against(x), x["en"]).otherwise(0), F.greatest, 0)
        begins = F.reverse(running(F.reverse(all_), lambda x: F.when(against(x), x["st"]).otherwise(far), F.least, far))
        marked = F.zip_with(F.zip_with(all_, ends, lambda x, e: F.struct(x.alias("x"), e.alias("e"))), begins, lambda y, b: F.struct(y["x"].alias("x"), y["e"].alias("e"), b.alias("b")))
        return F.transform(F.filter(marked, lambda y: against(y["x"]) | ((y["e"] <= y["x"]["st"]) & (y["b"] >= y["x"]["en"]))), lambda y: y["x"])

    return let(F.array_sort(items), keep)


def spans_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``items`` of each text: base spans and what else may be one, with their votes and features."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    none = F.array().cast(_ITEMS)
    needs = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+"))}
    parts = []
    for kind in KINDS:
        base, loose = _items(kind, True), _items(kind, False)
        hinted = [F.contains("text", F.lit(h)) for h in _HINTS.get(kind, ())]
        for found, when in ((base, needs.get(kind)), (loose, None if not hinted else _any(hinted))):
            parts.append(found if when is None else F.when(when, found).otherwise(none))
    every = let(F.flatten(F.array(*parts)), lambda all_: F.when(F.size(all_) > 0, apart_from(all_, lambda x: x["base"])).otherwise(none))
    return docs.select("doc_id", every.alias("items"))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


# --- models ---


def estimate_reliabilities(counts: dict[tuple[int, ...], int], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """The probability of each pattern of votes to be a span, by expectation-maximisation over two classes.

    counts: how often each pattern of votes (0 against, 1 none, 2 for) occurs. A labeler has a distribution of votes in
    either class, independent of the others given the class; it starts from the majority, and pseudo-counts say that
    labelers are better than chance.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    width, total = len(patterns[0]), sum(counts.values())
    q = [1 / (1 + math.exp(-(sum(p) - width))) for p in patterns]
    prior = {1: (0.5, 1.0, 2.0), 0: (2.0, 1.0, 0.5)}
    for _ in range(rounds):
        weight = {1: sum(counts[p] * x for p, x in zip(patterns, q)), 0: sum(counts[p] * (1 - x) for p, x in zip(patterns, q))}
        share = (weight[1] + 1) / (total + 2)
        told = {}
        for y in (0, 1):
            for j in range(width):
                seen = list(prior[y])
                for p, x in zip(patterns, q):
                    seen[p[j]] += counts[p] * (x if y else 1 - x)
                told[y, j] = [math.log(s / sum(seen)) for s in seen]
        new = []
        for p in patterns:
            odds = math.log(share / (1 - share)) + sum(told[1, j][v] - told[0, j][v] for j, v in enumerate(p))
            new.append(1 / (1 + math.exp(-max(-700.0, min(700.0, odds)))))
        moved, q = max(abs(a - b) for a, b in zip(q, new)), new
        if moved < 1e-9:
            break
    return dict(zip(patterns, q))


def train_classifier(rows: list[tuple[tuple[int, ...], float, float]], sizes: list[int], ridge: float = 1.0, rounds: int = 30) -> list[float]:
    """Weights of a logistic classifier, a constant and then one for each value of each feature, by Newton's method.

    rows: (feature values, weight of the span class, weight of the other).
    """
    width = 1 + sum(sizes)
    if not rows:
        return [0.0] * width
    offsets = np.cumsum([1, *sizes])[:-1]
    x = np.zeros((len(rows), width))
    x[:, 0] = 1
    for i, (values, _, _) in enumerate(rows):
        x[i, offsets + np.array(values)] = 1
    yes, no = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    w = np.zeros(width)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        n = yes + no
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + ridge * np.eye(width), x.T @ (yes - n * p) - ridge * w)
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def _digits_of(code: int, sizes: list[int]) -> tuple[int, ...]:
    out = []
    for size in reversed(sizes):
        out.append(code % size)
        code //= size
    return tuple(reversed(out))


def _constant(values: list[float]) -> Column:
    """An array of numbers as one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def fit(found: DataFrame) -> list[list[float]]:
    """The classifier's weights for each kind, trained on what the labelers say together about all candidates of ``found``.

    Of the candidates only counts reach the driver: of patterns of votes (3^6 a kind), then of features with the sum of
    their probabilities (1296 a kind).
    """
    spans = found.select(F.explode("items").alias("i")).select("i.kind", "i.votes", "i.features")
    every = 3 ** len(VOTES)
    counts: list[dict] = [{} for _ in KINDS]
    for r in spans.groupBy("kind", "votes").count().collect():
        counts[r["kind"]][_digits_of(r["votes"], [3] * len(VOTES))] = r["count"]
    likely = [0.0] * (every * len(KINDS))
    for k in range(len(KINDS)):
        for p, x in estimate_reliabilities(counts[k]).items():
            likely[k * every + int("".join(map(str, p)), 3)] = x
    parts = F.round(F.get(_constant(likely), F.col("kind") * every + F.col("votes")) * 1e9).cast("long")
    sizes = list(FEATURES.values())
    rows: list[list] = [[] for _ in KINDS]
    for r in spans.groupBy("kind", "features").agg(F.count(F.lit(1)).alias("n"), F.sum(parts.cast("decimal(38,0)")).alias("s")).collect():
        yes = int(r["s"]) / 1e9
        rows[r["kind"]].append((_digits_of(r["features"], sizes), yes, max(0.0, r["n"] - yes)))
    return [train_classifier(sorted(own), sizes) for own in rows]


def probability(item: Column, weights: list[list[float]]) -> Column:
    """The classifier's probability that an item is a span of its kind."""
    width = len(weights[0])
    flat = _constant([w for own in weights for w in own])
    code, at, logit = item["features"], 1 + sum(FEATURES.values()), F.get(flat, item["kind"] * width)
    for size in reversed(FEATURES.values()):
        at -= size
        logit = logit + F.get(flat, item["kind"] * width + at + code % size)
        code = F.floor(code / size).cast("int")
    return 1 / (1 + F.exp(-logit))


def _written_out(items: Column) -> Column:
    """``kind:start:end`` of items by kind, start and end, joined by commas."""
    ordered = F.array_sort(F.transform(items, lambda x: F.struct(x["kind"].alias("kind"), x["st"].alias("st"), x["en"].alias("en"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["st"].cast("string"), x["en"].cast("string"))), ",")


def personal_data(docs: DataFrame, *, least: float = 0.9) -> DataFrame:
    """doc_id, counts and digest of each text's base spans, and all spans with those the classifier adds; a row per row.

    Base spans: matches of BASE that pass their kind's check (parts up to 255; 13 to 19 digits and Luhn; 9 to 15 digits).
    n_email, n_ip, n_card and n_phone count them and base_sha256 digests them. Candidates are looser forms that overlap no
    base span; those with a probability of ``least`` or more are added (n_added), the first of two that overlap. Null
    texts are empty, null ids and repeated rows are rows like any other, an empty table gives an empty one.
    """
    found = written(spans_of(docs.select("doc_id", "text")), "spans")
    weights = fit(found)
    adds = F.filter("items", lambda x: x["base"] | (probability(x, weights) >= least))

    def first_of_overlapping(all_: Column) -> Column:
        ends = running(all_, lambda x: x["en"], F.greatest, 0)
        marked = F.zip_with(all_, ends, lambda x, e: F.struct(x.alias("x"), e.alias("e")))
        return F.transform(F.filter(marked, lambda y: y["x"]["base"] | (y["e"] <= y["x"]["st"])), lambda y: y["x"])

    none = F.slice("items", 1, 0)
    rows = found.select("doc_id", F.filter("items", lambda x: x["base"]).alias("base"), let(adds, lambda a: F.when(F.size(a) > 0, first_of_overlapping(F.array_sort(a))).otherwise(none)).alias("spans"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(_written_out(F.col("base")), 256).alias("base_sha256"),
        _written_out(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )
