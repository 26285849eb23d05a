"""Centroid clustering, personal data and phrases against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import bits, phrases, pii, queries, yinyang

VECTORS = "vec_id long, embedding array<float>, label int, cluster int, x string"


# op11


def plain_kmeans(rows, k, rounds, scale=1024):
    """(vec_id, cluster, distance) of each row and the centroids, in Python's integers."""
    kept = [(v, [math.floor(scale * float(np.float32(c))) for c in e]) for v, e in rows if e is not None and len(e) == 64 and all(c is not None and math.isfinite(c) for c in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda x: min((far(x, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, x in kept:
            own[nearest(x)[1]].append(x)
        centroids = [[sum(col) // len(own[j]) for col in zip(*own[j])] if own[j] else c for j, c in enumerate(centroids)]
    return [(v, *nearest(x)[::-1]) for v, x in kept], centroids


def odd_vectors():
    rng = np.random.default_rng(11)
    middles = rng.normal(size=(6, 64))
    rows = [(k, [float(c) for c in np.float32(middles[k % 6] * 0.4 + rng.normal(size=64) * 0.2)]) for k in range(150)]
    rows += [rows[3], rows[3], (150, rows[7][1]), (None, rows[9][1]), (151, None), (152, []), (153, [1.0] * 63), (154, [1.0] * 63 + [None]), (155, [1.0] * 63 + [float("nan")]), (156, [1.0] * 63 + [float("inf")]), (157, [0.0] * 64), (158, [-0.25] * 64)]
    return rows


@pytest.mark.parametrize("k, groups", [(8, None), (8, 1), (8, 8), (3, 2), (1, None)])
def test_op11_is_plain_kmeans(spark, k, groups):
    rows = odd_vectors()
    df = spark.createDataFrame([(v, e, 0, 1, "x") for v, e in rows], VECTORS).repartition(3)
    got = yinyang.yinyang_clusters(df, k=k, groups=groups).collect()
    want, centroids = plain_kmeans(rows, k, 10)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=key) == sorted(want, key=key)
    sums = Counter()
    for _, c, d in want:
        sums[c] += d
    for r in got:
        assert r["cluster_inertia"] == sums[r["cluster"]] and r["inertia"] == sum(sums.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()


def test_op11_ties_fewer_vectors_and_none(spark):
    grid = [(k, [float(k % 3)] * 64) for k in range(9)]  # three places, eight centroids: equal ones, and empty clusters
    df = lambda rows: spark.createDataFrame([(v, e, 0, 1, "x") for v, e in rows], VECTORS)
    for rows in (grid, grid[:2]):
        got = yinyang.yinyang_clusters(df(rows)).collect()
        assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == sorted(plain_kmeans(rows, 8, 10)[0])
    assert yinyang.yinyang_clusters(df([(1, None)])).collect() == []
    assert yinyang.yinyang_clusters(df([]).limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_op11_components_beyond_a_long_are_refused(spark):
    with pytest.raises(Exception, match="squared distances"):
        yinyang.yinyang_clusters(spark.createDataFrame([(1, [3e30] * 64, 0, 1, "x")], VECTORS)).collect()


def test_op11_bounds_spare_distances():
    """Later rounds compute few distances, and what they skip would have changed nothing."""
    rng = np.random.default_rng(2)
    middles = rng.integers(-900, 900, (16, 64))
    x = (middles[rng.integers(0, 16, 3000)] + rng.integers(-60, 60, (3000, 64))).astype(np.int64)
    centroids = x[:16].copy()
    group = yinyang.group_centroids(centroids, 4)
    a, upper, lower = np.zeros(3000, np.int64), np.full(3000, np.inf), np.full((3000, group.max() + 1), -1.0)
    asked = []
    for _ in range(8):
        asked.append(yinyang.reassign(x, a, upper, lower, centroids, group))
        d = np.stack([yinyang.squared(x, c) for c in centroids], 1)
        assert (a == d.argmin(axis=1)).all() and (upper**2 >= d.min(axis=1) * (1 - 1e-9)).all()
        new = np.array([x[a == c].sum(axis=0) // max(1, (a == c).sum()) if (a == c).any() else centroids[c] for c in range(16)])
        drift = np.sqrt(yinyang.squared(new, centroids)) * (1 + 1e-12)
        centroids = new
        upper, lower = upper + drift[a], lower - np.array([drift[group == g].max() for g in range(lower.shape[1])])
    assert asked[-1] < asked[0] / 4


# op12

SAID = [
    "mail me: ann.b+c@mail.example.com, or b_c@d-e.example.org.", "host 10.0.0.256 then 1.2.3.4.5.6.7.8 and 001.02.3.255", "card 4111 1111 1111 1111 or 4111111111111112",
    "call +1 (555) 010-9999 or +49 30 1234567; +1 23", "a@b.c@d.e x@y@z.uk .@-.-", "5500-0000-0000-0004 4111111111111111 12", "+1 (807) 555-6237 99.114.106.61 4080166431094600",
    "ü@b.de 漢字ann@example.com é+1 415 555 2671", "", " ", "contact ann at example dot com or bob [at] example [dot] org", "order 20240131 2024-01-31 10:22:33 v1.2.3.4 isbn 978-3-16-148410-0",
]


def base_spans(text):
    out = []
    for kind in pii.KINDS:
        for m in re.finditer(pii.BASE[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum((2 * int(d) - 9 * (d > "4") if i % 2 else int(d)) for i, d in enumerate(reversed(digits))) % 10 == 0 if digits else False
            fine = {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m.group().split(".")), "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return out


def check_base(rows, got):
    texts = defaultdict(list)
    for k, t in rows:
        texts[k].append(t or "")
    assert sorted((k is None, k) for k, _ in rows) == sorted((r["doc_id"] is None, r["doc_id"]) for r in got)
    for r in got:
        fits = []
        for text in texts[r["doc_id"]]:
            base = base_spans(text)
            told = [f"{k}:{a}:{b}" for k, a, b in base]
            every = [x.split(":") for x in r["spans"].split(",") if x]
            added = [x for x in every if ":".join(x) not in told]
            counts = [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
            fits.append(
                counts == [r[f"n_{k}"] for k in pii.KINDS] and hashlib.sha256(",".join(told).encode()).hexdigest() == r["base_sha256"]
                and {":".join(x) for x in every} >= set(told) and r["n_added"] == len(added) and every == sorted(every, key=lambda x: (pii.KINDS.index(x[0]), int(x[1])))
                and all(int(b) <= a2 or b2 <= int(a) for _, a, b in added for _, a2, b2 in base) and all(0 <= int(a) < int(b) <= len(text) for _, a, b in every)
            )
        assert any(fits), r


def test_op12_base_spans(spark):
    rng = random.Random(12)
    signs = ["a", "b.c", "@", "+", "-", " ", "1", "23", "4111111111111111", ".", "(", ")", "é", "%", "255", "x@y.zz", "+4930", "\n", "😀"]
    rows = [(k, t) for k, t in enumerate(SAID)] + [(100 + k, "".join(rng.choices(signs, k=rng.randint(1, 60)))) for k in range(400)]
    rows += [(None, SAID[0]), (3, SAID[3]), (700, None), (701, "+" * 5000 + "1." * 5000), (702, "a" * 50_000 + "@" + "b." * 20_000), (703, "1 " * 30_000), (704, "7" * 100_000), (705, " 1.2.3.4" * 3000 + " 4111111111111111 a@b.cc")]
    df = spark.createDataFrame([(k, t, "en", [1]) for k, t in rows], "doc_id long, text string, lang string, items array<int>").repartition(3)
    check_base(rows, pii.personal_data(df).collect())
    empty = pii.personal_data(df.limit(0))
    assert empty.count() == 0 and empty.columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def test_op12_adds_what_labelers_agree_on(spark):
    """A number that the labelers know by form, issuer, context and edge is a span though its check fails; a date is none."""
    rng = random.Random(1)
    number = lambda: "4" + "".join(rng.choices("0123456789", k=15))
    rows = [(k, f"pay by card {number()} today, or call +1 (2{rng.randint(10, 99)}) 555-{rng.randint(1000, 9999)} now") for k in range(300)]
    rows += [(500 + k, f"on 20{rng.randint(10, 24)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} the order {rng.randint(10**12, 10**13)} came, version 1.{k}.3") for k in range(300)]
    rows += [(900, "+1 (807) 555-6237 99.114.106.61 4080166431094600 here")]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    check_base(rows, list(got.values()))
    assert all(r["spans"].count("card:") == 1 and r["n_phone"] == 1 for k, r in got.items() if k < 300)
    assert all(r["n_added"] == 0 for k, r in got.items() if 500 <= k < 800)  # an order number that passes Luhn's check is a base span
    assert {"phone:0:17", "ip:18:31", "card:32:48"} == set(got[900]["spans"].split(","))


def test_op12_places_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pii, "_BLOCK", 4)
    df = spark.createDataFrame([([3, 1, 4, 1, 5, 9, 2, 6, 5, 3],), ([],), ([7],)], "x array<int>")
    got = [r["s"] for r in df.select(pii.running(F.col("x"), lambda v: v, lambda a, b: a + b, 0).alias("s")).collect()]
    assert got == [[0, 3, 4, 8, 9, 14, 23, 25, 31, 36], [], [0]]


def test_op12_reliabilities_are_found():
    """Labelers of known reliability over two hidden classes: the estimate ranks patterns as the truth does."""
    rng = random.Random(5)
    told, counts, truth = {1: [(0.1, 0.2, 0.7), (0.05, 0.15, 0.8), (0.2, 0.3, 0.5), (0.3, 0.1, 0.6)], 0: [(0.7, 0.2, 0.1), (0.8, 0.1, 0.1), (0.4, 0.4, 0.2), (0.5, 0.2, 0.3)]}, Counter(), Counter()
    for _ in range(6000):
        y = int(rng.random() < 0.3)
        p = tuple(rng.choices((0, 1, 2), w)[0] for w in told[y])
        counts[p] += 1
        truth[p] += y
    found = pii.estimate_reliabilities(dict(counts))
    wrong = sum(min(truth[p], counts[p] - truth[p]) for p in counts)
    assert sum(counts[p] - truth[p] if found[p] >= 0.5 else truth[p] for p in counts) <= wrong * 1.15 + 10
    assert pii.estimate_reliabilities({}) == {}


def test_op12_runs_no_python(spark):
    df = spark.createDataFrame([(1, SAID[0])], "doc_id long, text string")
    plan = pii.spans_of(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# op13


def plain_phrases(rows, max_n, least, most):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(fold)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, max_n + 1):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + size] for p, a in candidates.items() for size in range(2, len(p)) for i in range(len(p) - size + 1) if 100 * a >= 100 * candidates[p[i : i + size]]}
        kept = []
        for p, a in candidates.items():
            if p not in gone:
                s, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                kept.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(kept)[:most], 1)]
    return sorted(out)


def phrase_rows(seed=13):
    rng = random.Random(seed)
    words = "New york City big apple Über straße 漢 a b c A\x0bB x y of the".split(" ")
    rows = [(rng.choice(["en", "en", "en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "  "]) for _ in range(rng.randint(0, 60)))) for _ in range(250)]
    return rows + [("en", "New York city! " * 300), ("en", "one two three four five six " * 40), ("de", None), (None, ""), ("fr", "..."), ("en", rows[0][1]), ("en", rows[0][1]), ("xx", "m n o p q " * 2000)]


@pytest.mark.parametrize("gather, max_n, least, most", [(1 << 20, 5, 6, 40), (50, 5, 6, 2000), (7, 3, 4, 5), (200, 2, 10, 100)])
def test_op13_phrases(spark, gather, max_n, least, most):
    rows = phrase_rows()
    df = spark.createDataFrame([(k, t, lang, "s", 1, "w") for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, words int, c string").repartition(4)
    got = phrases.collocations(df, max_n=max_n, min_count=least, most=most, gather=gather).collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows, max_n, least, most)


def test_op13_words_in_chunks():
    rng = random.Random(2)
    text = "".join(rng.choice(["ab", "C", " ", " ", "\t", ".", "é", "\n", "漢"]) for _ in range(3000)).encode()
    whole = next(phrases.word_chunks(text, 1 << 20))
    for size in (1, 7, 100):
        assert [w for part in phrases.word_chunks(text, size) for w in part] == whole
    assert list(phrases.word_chunks(b"")) == []


def test_op13_filters_hold_all_that_is_frequent(spark, monkeypatch):
    monkeypatch.setattr(bits, "FILTER_BITS", 1 << 15)
    rows = [("en", " ".join(f"w{k % 700}" for k in range(9000))), ("de", "w1 w2 w3. " * 20)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(df, min_count=5).collect())) == plain_phrases(rows, 5, 5, 2000)
    words = phrases.frequent(phrases.gram_rows(df, 1, 1, reach=5), 5).where("phrase IS NOT NULL")
    held = bits.read_filter(phrases.phrase_filter(words))
    assert all(phrases._may_hold(held, r["lang"].encode(), [r["phrase"].encode()])[0] for r in words.collect())


def test_op13_large_products_and_thinned_ranks(spark):
    big = spark.createDataFrame([("en", "a b", 2, 10**12), ("en", "a", 1, 3 * 10**12), ("en", "b", 1, 10**12 + 7)], "lang string, phrase string, words int, c long")
    r = phrases.score_cuts(big, spark.createDataFrame([("en", 10**13 + 1)], "lang string, n long"), 100).first()
    assert (r["a"], r["l"], r["r"], r["score"]) == (10**12, 3 * 10**12, 10**12 + 7, 1000 * 10**12 * (10**13 + 1) // (3 * 10**12 * (10**12 + 7)))
    rows = [("en" if k % 4 else "de", (k * 7919) % 1000, f"p{k}") for k in range(3000)]
    df = spark.createDataFrame(rows, "lang string, score long, phrase string")
    got = phrases.best_of_each(df, "lang", [F.col("score").desc(), F.col("phrase")], 20, "phrase").collect()
    for lang in ("en", "de"):
        want = sorted((-s, p) for own, s, p in rows if own == lang)[:20]
        assert [(-r["score"], r["phrase"]) for r in sorted((x for x in got if x["lang"] == lang), key=lambda x: x["rank"])] == want
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).collect() == []


# SQL


@pytest.mark.parametrize("name", ["op11_centroids", "op13_collocations"])
def test_sql_agrees(spark, name, tmp_path):
    rows = [(k, t, lang) for k, (lang, t) in enumerate(phrase_rows() * 6)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(v, e) for v, e in odd_vectors() if v is not None], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got, want = queries.QUERIES[name](spark, str(tmp_path)), con.sql(queries.ORACLE_SQL[name])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.project(", ".join(f'"{c}"' for c in got.columns)).fetchall())) and got.count() > 0
