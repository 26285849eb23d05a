"""The training-data operators against brute force, on small fixtures with the hard cases in them."""

import itertools
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tracewright.llm import common, components, fingerprints, language, mixing, nearest, ngram, packing, sharding, simhash, spans, tokenfile, tokens
from tracewright.llm.tokens import public_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": "the of and house river green walking through yellow mountain people under water stone garden evening letter window market silver".split(),
    "de": "der und nicht straße schön grüße häuser wasser berg garten abend brief fenster markt silber über gegen zwischen durch ohne".split(),
}


def prose(rng, lang, n):
    words = [WORDS[lang][k] for k in rng.integers(0, 20, n)]
    for k in range(6, n, 7):
        words[k] += "."
    return " ".join(words)


@pytest.fixture(scope="module")
def rows():
    """Prose in two languages, copies, near copies, a shared passage, and nulls, empties, a long text, repeated rows."""
    rng = np.random.default_rng(5)
    out, passage = [], prose(rng, "en", 70)
    for k in range(160):
        lang = "de" if k % 3 == 0 else "en"
        text = prose(rng, lang, int(rng.integers(30, 120)))
        if k % 40 == 7:
            text = prose(rng, "en", 20) + ". " + passage + " " + prose(rng, "en", 20)
        out.append((k, text, lang, f"src{k % 4}", len(text)))
    out.append((160, out[10][1], "en", "src0", 1))  # an exact copy
    words = out[11][1].split()
    words[len(words) // 2] = "changed"
    out.append((161, " ".join(words), "en", "src0", 1))  # a near copy
    out += [(162, None, None, None, None), (163, "", "en", None, 0), (164, "... 12 !!", "de", "src1", 9), (165, " \t\n ", None, "src1", 4)]
    out.append((166, prose(rng, "de", 6000), "de", "src2", 1))
    out.append((167, "a", "en", "src3", 1))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Null ids, repeated rows and an extra column with a clashing name."""
    extra = [(None, "null id here", "en", "src0", 1), (None, None, None, None, None), rows[3], rows[3]]
    return spark.createDataFrame(rows[:20] + extra, DOCS).withColumn("size", F.lit("x")).withColumn("fp", F.lit(1)).withColumn("n_removed", F.lit("y"))


# 1


def plain_sentences(text):
    """(words, begin, end) of each sentence of a text whose sentences are short, without the operator's own cutter."""
    out, at = [], 0
    for m in re.finditer(r"[^.!?\n]*(?:[.!?]+(?=\s|$)|\n|$)|[^\s]+", text):
        body = m.group().strip()
        if body:
            begin = m.start() + m.group().index(body)
            out.append(([w.rstrip(".,;:!?") or w for w in body.lower().split()], begin, begin + len(body)))
    return out


def repeated(texts, run=3, words=18, together=40):
    """(sentences, removed) of each text in order of id."""
    seen, out = set(), []
    for text in texts:
        s = [w for w, _, _ in plain_sentences(text or "")]
        gone = [False] * len(s)
        for a in range(len(s)):
            b = a + run
            while b <= len(s) and sum(map(len, s[a:b])) < words:
                b += 1
            if b <= len(s):
                key = tuple(map(tuple, s[a:b]))
                if key in seen:
                    gone[a:b] = [True] * (b - a)
                seen.add(key)
        removed = 0
        for drop, group in itertools.groupby(range(len(s)), lambda k: gone[k]):
            group = list(group)
            removed += len(group) if drop and sum(len(s[k]) for k in group) >= together else 0
        out.append((len(s), removed))
    return out


def test_op1_spans(docs, rows, empty, odd):
    got = {r["doc_id"]: r for r in spans.remove_repeats(docs).collect()}
    assert [(got[r[0]]["n_sentences"], got[r[0]]["n_removed"]) for r in rows] == repeated([r[1] for r in rows])
    assert got[160]["text"] == "" and got[10]["text"] == rows[10][1] and got[162]["text"] is None
    assert got[47]["n_removed"] > 0 and got[7]["n_removed"] == 0
    assert spans.remove_repeats(empty).count() == 0
    out = spans.remove_repeats(odd)
    assert out.count() == odd.count() and dict(out.dtypes)["n_removed"] == "int"
    assert [r["n_removed"] for r in out.where("doc_id = 3").collect()] == [0, 0, 0]


def test_op1_one_id_with_two_texts_and_clashing_columns(spark, rows):
    """Texts of one id are documents of their own, the first by hash; columns of any name come through."""
    data = [(1, rows[7][1]), (1, rows[7][1] + " And more."), (2, "short"), (None, rows[7][1]), (None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").select("doc_id", "text", *[F.lit(k).alias(c) for k, c in enumerate(("_spans", "_text_node", "key", "node", "spans", "id", "row", "lo"))])
    out = spans.remove_repeats(docs)
    assert out.columns == [*docs.columns, "n_sentences", "n_removed"]
    got = sorted((r["doc_id"] or 0, r["n_removed"], r["spans"], r["lo"]) for r in out.collect())
    assert [(i, n > 0) for i, n, _, _ in got] == [(0, False), (0, False), (1, True), (1, True), (2, False)]
    assert {(a, b) for _, _, a, b in got} == {(4, 7)}


def test_op1_cuts_by_content_alone():
    """A passage set into other text keeps its inner cuts, in any script, whatever changes its length in lower case."""
    rng = np.random.default_rng(3)
    vocabulary = [f"word{k}" for k in range(500)]
    for n in range(40):
        passage = " ".join(rng.choice(vocabulary, 60))
        texts = [passage, " ".join(rng.choice(vocabulary, 17)) + " " + passage + " " + " ".join(rng.choice(vocabulary, 9)), "\u0130stanbul. " + passage.upper()]
        cuts = []
        for t in texts:
            at = t.lower().index("word", 0) if t is texts[2] else t.index(passage)
            cuts.append({(a - at, b - at) for a, b in spans.sentences(t)})
            cut = spans.cut_texts([t])
            assert (cut.words <= 12).all() and cut.words.sum() == len(t.split())
        inner = {c for c in cuts[0] if 110 < c[0] and c[1] < len(passage) - 110}
        assert inner and inner <= cuts[1]
        assert len(cuts[2]) == len(cuts[0]) + 1
    assert len(spans.sentences("\u4f60\u597d\u3002\u518d\u89c1\uff01Yes. No\nline")) == 5


# 2


def test_op2_monotone_round_trip():
    rng = np.random.default_rng(0)
    for values in ([], [5], [0, 0, 7], np.sort(rng.integers(0, 1 << 62, 70_000)), np.sort(rng.integers(0, 40, 9000)), np.arange(5000), [0, (1 << 64) - 1], np.cumsum(rng.integers(1, 1 << 20, 5000) ** 2)):
        v = np.array(values, np.uint64)
        data = b"".join(ngram.encode_monotone(v))
        m = ngram.Monotone(memoryview(data + b"more"))
        assert m.bytes == len(data) and len(data) % 8 == 0
        assert (m.get(np.arange(len(v))) == v).all()
        if len(v) and len(np.unique(v)) == len(v):
            u = np.unique(np.concatenate([v, v + np.uint64(1), v // np.uint64(2), np.array([0, (1 << 64) - 1], np.uint64)]))
            assert (m.find(v) == np.arange(len(v))).all()
            assert (m.successor(u) == np.searchsorted(v, u)).all()
            assert ((m.find(u) >= 0) == np.isin(u, v)).all()


def lm_model(train):
    """log10 p of a text's tokens: interpolated absolute discounting over every n-gram seen."""
    c1 = Counter(w for t in train for w in t)
    c2, c3 = (Counter(g for t in train for g in zip(*[t[k:] for k in range(n)])) for n in (2, 3))
    d1, d2, d3 = (ngram._discount(sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())) for c in (c1, c2, c3))
    total, k2, k3, x2, x3 = sum(c1.values()), Counter(g[:1] for g in c2), Counter(g[:2] for g in c3), Counter(), Counter()
    for g, n in c2.items():
        x2[g[:1]] += n
    for g, n in c3.items():
        x3[g[:2]] += n
    p1 = lambda w: (c1[w] - d1) / total if w in c1 else d1 * len(c1) / total
    mix = lambda c, x, k, d, g, low: low if g[:-1] not in x else max(c[g] - d, 0) / x[g[:-1]] + d * k[g[:-1]] / x[g[:-1]] * low
    p2 = lambda u, w: mix(c2, x2, k2, d2, (u, w), p1(w))
    p3 = lambda u, v, w: mix(c3, x3, k3, d3, (u, v, w), p2(v, w))
    for u, v in list(x3)[:20]:
        assert abs(sum(p3(u, v, w) for w in c1) + p3(u, v, None) - 1) < 1e-9
    return c1, lambda t: sum(math.log10(p1(w) if i == 0 else p2(t[0], w) if i == 1 else p3(t[i - 2], t[i - 1], w)) for i, w in enumerate(t))


@pytest.mark.parametrize("part_tokens", [1_000_000, 40])
def test_op2_scores(docs, rows, empty, odd, part_tokens):
    """With 40 tokens a part, every frequent context is cut into many parts."""
    got = {r["doc_id"]: r for r in ngram.learn_and_score(docs, part_tokens=part_tokens).collect()}
    toks = {r[0]: (r[1] or "").encode().translate(ngram._LOWER).split() + [b"\0"] for r in rows}
    c1, score = lm_model([t for k, t in toks.items() if zlib.crc32(str(k).encode()) % 10])
    total, vocabulary = sum(c1.values()), len(c1)
    for k, t in toks.items():
        base = sum(math.log10((c1[w] + 0.1) / (total + 0.1 * (vocabulary + 1))) for w in t)
        r = got[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in c1 for w in t), total)
        assert abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - score(t)) < 0.004 * len(t) + 0.02
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 10 == 0)
    assert ngram.learn_and_score(empty).count() == 0 and ngram.learn_and_score(odd).count() == odd.count()


def test_op2_large_vocabularies_do_not_pack():
    """Keys and merges give the same where three numbers do not fit 64 bits."""
    rng = np.random.default_rng(1)
    a, b, c = rng.integers(0, 9, (3, 500))
    for wide in (10, 40):
        keys, inverse, n = ngram._keys(a, b, c, wide)
        want = Counter(zip(a.tolist(), b.tolist(), c.tolist()))
        assert [tuple(k) for k in keys.T.tolist()] == sorted(want) and n.tolist() == [want[k] for k in sorted(want)]
        assert (keys[:, inverse] == np.stack([a, b, c])).all()


# 3


def test_op3_language(docs, rows, empty, odd):
    got = {r["doc_id"]: r for r in language.classify(docs).collect()}
    long = [r for r in rows if r[1] and len(r[1]) > 60]
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in long) >= 0.97 * len(long)
    for k in (162, 163, 164, 165):
        assert (got[k]["lang_pred"], got[k]["score"], got[k]["rejected"]) == ("und", 0.0, True)
    assert language.classify(empty).count() == 0
    unlabelled = language.classify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
    assert language.classify(odd).count() == odd.count()


def test_op3_sizes_ties_and_margins(spark, docs, rows):
    """Each text again, whole and with its repeats, by a coder of its own for every block."""
    known = docs.where("NOT crc32(string(doc_id)) % 4 = 2")
    words = language.learn(known)
    words["zz"] = words["de"]  # a second label of equal sizes never wins
    got = docs.select("doc_id", language.predictor(words)("text").alias("p")).select("doc_id", "p.*").collect()
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        text = texts[r["doc_id"]]
        if not text or not re.search("[^\\W\\d_]", text):
            assert (r["lang_pred"], r["score"], r["margin"]) == ("und", 0.0, 0.0)
            continue
        sizes = {}
        for lang, content in words.items():
            coder = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            raw = text.lower().encode()
            sizes[lang] = sum(len(coder.compress(raw[k : k + 1024])) for k in range(0, len(raw), 1024))
        (best, lang), (second, _) = sorted((n, x) for x, n in sizes.items())[:2]
        slack = 3 + len(text) // 300  # coders that share a table may part a block otherwise by some bytes
        assert sizes[r["lang_pred"]] - best <= slack and r["lang_pred"] != "zz"
        assert abs(r["margin"] - (second - best) / second) <= slack / second
    clash = language.classify(docs.select("doc_id", "text", "lang", F.lit(1).alias("_p"), F.lit(2).alias("row"), F.lit(3).alias("p"), F.lit(4).alias("score")))
    assert clash.columns == ["doc_id", "text", "lang", "_p", "row", "p", "held_out", "lang_pred", "score", "margin", "rejected"]
    assert {(r["_p"], r["row"], r["p"]) for r in clash.collect()} == {(1, 2, 3)}
    many = spark.createDataFrame([(k, "some words here", f"label{k:03d}") for k in range(40)], "doc_id long, text string, lang string")
    assert len(language.learn(many, labels=7)) == 7


# 4


def vectors(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, 8)) + rng.integers(0, 5, (n, 1)) * 3
    m[100:160] = m[100]  # one very common vector
    table = [(k, [float(np.float32(x)) for x in v]) for k, v in enumerate(m)]
    bad = [(600, None), (700, []), (800, [0.0] * 8), (900, [float("nan")] + [1.0] * 7), (1000, [float("inf")] + [1.0] * 7), (1100, [None] + [1.0] * 7)]
    return table, spark.createDataFrame(table + bad, "vec_id long, embedding array<float>")


def test_routes_go_out_in_small_batches_without_vectors():
    rng = np.random.default_rng(2)
    m = rng.normal(size=(400, 8))
    tree = nearest.Tree.fit(m, 100)
    asked = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(m.tolist(), pa.list_(pa.float64()))], names=["query_id", "embedding"])
    out = list(nearest._routes([asked], tree, 60, nearest.Nodes(""), rows=1000))
    assert all(b.schema.names == ["query_id", "leaf"] and b.num_rows <= 1000 for b in out)
    got = pa.Table.from_batches(out).to_pandas().groupby("query_id").leaf.agg(list)
    assert got.to_dict() == {k: tree.visit(q, 60) for k, q in enumerate(m)}


@pytest.mark.parametrize("index", [{}, {"fit_rows": 60, "leaf_rows": 8, "split_rows": 20, "split_fit": 40}])
def test_op4_neighbours(spark, index):
    """With a small sample, leaves are split again from their own rows; the very common vector cannot be split."""
    table, df = vectors(spark)
    got = nearest.neighbours(df, query_every=20, k=10, **index).toPandas()
    m, hits = np.array([v for _, v in table]), 0
    for q, g in got.groupby("query_id"):
        far = np.sqrt(((m - m[q]) ** 2).sum(1))
        far[q] = np.inf
        hits += len(set(np.lexsort((np.arange(len(m)), far))[:10]) & set(g.vec_id))
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and list(zip(g.score, g.vec_id)) == sorted(zip(g.score, g.vec_id))
        assert np.allclose(g.score, far[g.vec_id])
    assert got.query_id.nunique() == 30 and hits / (10 * 30) >= 0.9
    assert nearest.neighbours(df.limit(0)).count() == 0
    if index:
        made = nearest.Index(df, **index)
        assert made.nodes.files and made.leaves > made.tree.leaves and made.rows.count() == 600
        leaf = {r["vec_id"]: r["leaf"] for r in made.rows.collect()}
        for k, v in table[:50]:  # a search that visits one leaf comes to the row's own
            assert made.tree.visit(np.array(v), 1, made.nodes) == [leaf[k]]
    short = spark.createDataFrame([(2000, [1.0, 2.0]), (2020, [3.0] * 9), (None, [1.0] * 8)], "vec_id long, embedding array<float>")
    again = nearest.neighbours(df.union(short).withColumn("leaf", F.lit(1)).withColumn("query_id", F.lit(2)), query_every=20)
    assert set(again.toPandas().query_id) == set(got.query_id)
    few = df.where("vec_id < 4")
    assert nearest.neighbours(few, query_every=1).groupBy("query_id").count().toPandas()["count"].tolist() == [3] * 4


# 5


def test_op5_mixing(docs, rows, empty, odd):
    plan = mixing.plan_copies(docs).toPandas()
    by = plan.groupby(plan.source.fillna("~")).agg(size=("size", "sum"), target=("target", "first"))
    by["taken"] = (plan["size"] * plan.copies).groupby(plan.source.fillna("~")).sum()
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 and (by.target <= 2 * by["size"] + 1e-9).all() and plan.copies.max() <= 2
    assert (abs(by.taken - by.target) <= 0.1 * by.target.clip(lower=1)).all()
    free = by[by.target < 2 * by["size"]]
    weight = dict(zip(sorted(by.index), (3, 1, 2, 3, 1, 2)))
    levels = {round(t / weight[s], 6) for s, t in free.target.items() if t}
    assert len(levels) <= 1
    again = mixing.plan_copies(docs.repartition(5)).toPandas()
    assert dict(zip(plan.doc_id, plan.copies)) == dict(zip(again.doc_id, again.copies))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == plan.copies.sum()
    assert mixing.plan_copies(empty).count() == 0 and mixing.plan_copies(odd).count() == odd.count() and mixing.mix(odd).count() > 0
    assert mixing.mix(empty).count() == 0 and mixing.mix(empty).columns == empty.columns
    clash = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("row", "id", "of", "n", "_mix_k", "copies", "picks"))])
    assert mixing.mix(clash).columns == clash.columns and {r[-7:] for r in mixing.mix(clash).collect()} == {tuple(range(7))}


# 6


def test_op6_fingerprints(docs, rows, empty, odd):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs, query_every=10).collect()}
    texts = [r[1] or "" for r in rows]
    from hashlib import sha256

    for k, t in enumerate(texts):
        cut, after = len(t) // 4, texts[(k + 1) % len(texts)]
        edited = t[: len(t) - cut] + after[:cut]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == sha256(edited.encode()).hexdigest()
    f = {k: int(r["fingerprint"], 16) for k, r in got.items()}
    assert f[10] == f[160] and f[162] == f[163] == 0
    for k in range(len(texts)):
        assert got[k]["near_next"] == 1 - (f[k] ^ f[(k + 1) % len(texts)]).bit_count() / 64
        if k % 10 == 0:
            assert got[k]["n_near"] == sum((f[k] ^ x).bit_count() <= 3 for x in set(f.values())) - 1
    assert np.mean([r["near_edited"] for r in got.values()]) > np.mean([r["near_next"] for r in got.values()])
    assert fingerprints.fingerprint_edits(empty).count() == 0
    both = fingerprints.fingerprint_edits(odd.union(odd.where("doc_id = 5").withColumn("doc_id", F.lit(-(1 << 63))))).collect()
    assert len(both) == odd.count() + 1 and sum(r["doc_id"] is None for r in both) == 2 and sum(r["doc_id"] == -(1 << 63) for r in both) == 1
    assert len({tuple(r) for r in both if r["doc_id"] == 3}) == 1 and sum(r["doc_id"] == 3 for r in both) == 3


def test_op6_simhash_votes(spark):
    df = spark.createDataFrame([(1, "B a b"), (2, ""), (3, None)], "doc_id long, text string")
    h = df.where("doc_id = 1").select(F.xxhash64(F.lit("b"), F.lit("a")), F.xxhash64(F.lit("a"), F.lit("b")), F.xxhash64(F.lit("b"), F.lit(None).cast("string"))).first()
    want = sum(1 << j for j in range(64) if sum(x >> j & 1 for x in h) * 2 > 3)
    got = {r["doc_id"]: r["fingerprint"] & (1 << 64) - 1 for r in fingerprints.simhash(df, ["doc_id"]).collect()}
    assert got == {1: want, 2: 0, 3: 0}


# 7


def closest(fp, radius):
    parent = list(range(len(fp)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fp)):
        for j in range(i + 1, len(fp)):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fp))]


@pytest.mark.parametrize("radius", [1, 4, 6])
def test_op7_masks_cover(radius):
    masks = simhash.covering_masks(list(range(64)), radius)
    rng = np.random.default_rng(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(2000):
        bits = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
        assert any(not m & bits for m in masks)


def test_op7_components(docs, rows, empty, odd):
    got = {r["doc_id"]: r for r in simhash.near_components(docs).collect()}
    fp = []
    for r in rows:
        w = (r[1] or "").encode().translate(simhash._LOWER).split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        fp.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    assert [got[r[0]]["fp"] & (1 << 64) - 1 for r in rows] == fp
    assert [got[r[0]]["component_id"] for r in rows] == closest(fp, 4)
    assert simhash.near_components(empty).count() == 0 and simhash.near_components(odd).count() == odd.count()


def test_op7_large_buckets_are_split(spark):
    rng = np.random.default_rng(0)
    fp = sorted({0x123456789ABCDEF ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(0, 5), replace=False)) for _ in range(400)})
    df = spark.createDataFrame([(f, f) for f in fp], "fp long, node long")
    got = {r["node"]: r["root"] for r in components.components(simhash.covering_links(df, 4, limit=30)).collect()}
    assert [got.get(f, f) for f in fp] == [fp[k] for k in closest(fp, 4)]


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_near_dedup_stage(docs, rows, odd):
    kept = {r["doc_id"] for r in simhash.keep_one_of_each(docs).collect()}
    # 161 differs from 11 by one word of 34: five-word shingles have a Jaccard of 0.71, below 0.8
    assert {10, 11, 161, 166, 167} <= kept and 160 not in kept and len(kept & {162, 163}) == 1
    assert len(kept) >= len(rows) - 4
    assert simhash.keep_one_of_each(odd).where("doc_id = 3").count() == 1


# 8


def test_op8_sharding(docs, rows, empty, odd):
    got = sharding.shard_documents(docs, shards=24).toPandas()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert set(got.shard) <= set(range(24)) and ((got.grown_shard == got.shard) | (got.grown_shard == 24)).all()
    crc = {r[0]: zlib.crc32((r[1] or "").encode()) for r in rows}
    size = {r[0]: len((r[1] or "").encode()) + 8 for r in rows}
    assert all(crc[k] == c and size[k] == s for k, c, s in zip(got.doc_id, got.text_crc32, got["size"]))
    assert (got.rack == got.shard // 4).all() and (got.region == got.shard // 8).all()
    assert sharding.shard_documents(empty).count() == 0 and sharding.shard_documents(odd).count() == odd.count()


def drawn(key, tree):
    """(region, rack, shard) of a key, draw by draw, without the operator's tables."""

    def first(level, children):
        def arrival(child):
            h = xxhash.xxh64_intdigest(struct.pack("<i", level), 42)
            h = xxhash.xxh64_intdigest(struct.pack("<q", key), xxhash.xxh64_intdigest(struct.pack("<i", child[0]), h))
            return -math.log(((h >> 11) + 0.5) * 2.0**-53) / child[1], child[0]

        return min(arrival(c) for c in children if c[1] > 0)[1]

    weight = lambda x: x if isinstance(x, float) else sum(map(weight, x))
    region = first(0, [(k, weight(r)) for k, r in enumerate(tree.regions)])
    racks = sum(map(len, tree.regions[:region]))
    rack = first(1, [(racks + k, weight(r)) for k, r in enumerate(tree.regions[region])])
    shards = sum(len(r) for g in tree.regions for r in g) - sum(len(r) for g in tree.regions[region:] for r in g) + sum(map(len, tree.regions[region][: rack - racks]))
    return region, rack, first(2, [(shards + k, w) for k, w in enumerate(tree.regions[region][rack - racks])])


def test_op8_places_are_the_draws(docs, rows):
    got = sharding.shard_documents(docs, shards=24).toPandas()
    even = sharding.HashTree.even(24)
    for r in got.itertuples():
        assert (r.region, r.rack, r.shard) == drawn(r.doc_id, even)
        assert r.grown_shard == drawn(r.doc_id, even.with_region(1.0))[2]


def test_op8_weights(spark):
    """Shares follow weights, a shard of weight 0 gets nothing, and a changed weight moves keys in its own subtrees only."""
    ids = spark.range(20_000).select(F.col("id"))
    tree = sharding.HashTree((((1.0, 2.0), (1.0,)), ((0.0, 4.0), (2.0, 2.0))))
    a = sharding.descend(ids, F.col("id"), tree).toPandas().set_index("id")
    share = a.shard.value_counts(normalize=True)
    assert 3 not in share and all(abs(share[s] - w / 12) < 0.02 for s, w in ((0, 1), (1, 2), (2, 1), (4, 4), (5, 2), (6, 2)))
    b = sharding.descend(ids, F.col("id"), sharding.HashTree((((1.0, 3.0), (1.0,)), ((0.0, 4.0), (2.0, 2.0))))).toPandas().set_index("id")
    moved = a.shard != b.shard
    assert moved.any() and set(b.region[moved]) == {0}  # into the region whose weight grew, or within it
    assert (a.shard[(a.region == 1) & (b.region == 1)] == b.shard[(a.region == 1) & (b.region == 1)]).all()
    assert (b.shard[(a.rack == 0) & moved] == 1).all()  # within the rack, only to the shard that grew
    c = sharding.descend(ids, F.col("id"), tree.with_region(2.0)).toPandas().set_index("id")
    assert set(c.shard[c.shard != a.shard]) == {7}


def test_op8_hot_and_odd_ids(spark, monkeypatch):
    """Many rows of one id, alike or not, and null ids are numbered in parts."""
    monkeypatch.setattr(sharding, "SLOT_ROWS", 20)
    docs = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN null ELSE id END AS doc_id", "CASE WHEN id % 3 = 2 THEN string(id) ELSE 'same' END AS text", "1 AS shard", "2 AS _order", "3 AS _s")
    got = sharding.shard_documents(docs, shards=24).toPandas()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert len(got) == 900 and got.doc_id.isna().sum() == 300 and got.shard[got.doc_id == 7].nunique() == 1


# 9, 10


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_says_what_the_library_says(name):
    rng = np.random.default_rng(3)
    e = tokens.Encoder(public_path(name))
    library = Tokenizer.from_file(public_path(name))
    special = [t.content for t in library.get_added_tokens_decoder().values()]
    assert special
    texts = [x for t in special for x in (t, t + t, f"a{t}b", f" {t} {t}\n", t.upper(), f"x {t[:-1]}", f"<{t}>", f"it's {t.title()} 12")]
    texts += ["", " ", "a  b", "it's I'LL", "a \n b\tc", "Ünï ½ ² 日本", "<|endoftext|> x", "x\x1cy", "é́ x", "A" * 300]
    texts += ["".join(rng.choice(list(" \n\tab'sé1½. ,!"), rng.integers(0, 20))) for _ in range(500)]
    want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    assert e.rule and e.encode(texts) == want


def ids_of(name, text):
    return np.array(Tokenizer.from_file(public_path(name)).encode(text, add_special_tokens=False).ids, "<u4").tobytes() + bytes(4)


def test_op9_files(spark, docs, rows, empty, odd):
    path = public_path("byte_bpe_50k.json")
    folder, files = tokenfile.write_token_files(docs, path)
    got = {r["doc_id"]: r for r in tokenfile.read_token_files(spark, folder, files).collect()}
    at = 0
    for r in rows:
        raw = ids_of("byte_bpe_50k.json", r[1] or "")
        assert (got[r[0]]["start"], got[r[0]]["n_tokens"], got[r[0]]["ids_crc32"]) == (at, len(raw) // 4, zlib.crc32(raw))
        at += len(raw) // 4
    reader = tokenfile.FileReader(f"{folder}/{files[-1][0]}")
    assert reader.ids(len(reader.lengths) - 1).tobytes() == ids_of("byte_bpe_50k.json", rows[-1][1])
    reader = tokenfile.FileReader(f"{folder}/{files[0][0]}")
    whole = zstandard.ZstdDecompressor().stream_reader(reader._at(0, int(reader.frame_at[-1])), read_across_frames=True)
    assert len(whole.read(1 << 26)) == 4 * files[0][1]
    folder, files = tokenfile.write_token_files(empty, path)
    assert tokenfile.read_token_files(spark, folder, files).count() == 0
    folder, files = tokenfile.write_token_files(odd, path)
    assert tokenfile.read_token_files(spark, folder, files).where("doc_id is null").count() == 2


def test_op9_damage_is_seen(tmp_path):
    w = tokenfile.FileWriter()
    data = bytearray(b"".join(w.chunks((k, np.arange(k, 30_000, dtype="<u4").tobytes()) for k in range(8))))
    file = tmp_path / "x.zst"
    file.write_bytes(data)
    r = tokenfile.FileReader(f"file://{file}")
    assert len(r.packed) > 2 and (r.ids(3) == np.arange(3, 30_000)).all()
    data[40] ^= 1
    file.write_bytes(data)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokenfile.FileReader(f"file://{file}").ids(0)


def test_op10_packing(docs, rows, empty, odd):
    got = packing.pack(docs, public_path("word_bpe_49k.json"), capacity=512).toPandas()
    want = {}
    for r in rows:
        raw = ids_of("word_bpe_49k.json", r[1] or "")
        for k, at in enumerate(range(0, len(raw), 2048)):
            want[r[0], k] = (at // 4, len(raw[at : at + 2048]) // 4, zlib.crc32(raw[at : at + 2048]))
    assert {(a, b): (c, d, e) for a, b, c, d, e in zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)} == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 512
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 512) + 2
    assert packing.pack(empty, public_path("word_bpe_49k.json")).count() == 0
    assert packing.pack(odd, public_path("word_bpe_49k.json")).count() >= odd.count()


@pytest.mark.parametrize("seed", range(4))
def test_op10_plans_hold_all_and_waste_little(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(2048, rng.lognormal(6, 1, 20_000).astype(int) + 1)
    counts = np.bincount(lengths, minlength=2049)
    plan = packing.plan_sequences(counts, 2048)
    best = max(lengths.sum() / 2048, (lengths > 1024).sum())
    assert plan["sequences"][0] <= best * 1.01 + 2


# pipeline


def near_groups(rows, least=0.8):
    """Ids that stay of (id, text) rows: one of each group of equal texts or five-word Jaccard of 0.8 or more, by all pairs."""
    sets = {k: set(map(tuple, ([w[i : i + 5] for i in range(max(1, len(w) - 4))]))) for k, t in rows if (w := t.lower().split()) or True}
    group = {k: k for k, _ in rows}
    for a, b in itertools.combinations(sorted(group), 2):
        if group[a] != group[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            low, high = sorted((group[a], group[b]))
            group = {k: low if g == high else g for k, g in group.items()}
    return set(group.values())


def test_pipeline(spark, docs, rows, tmp_path_factory):
    """Each stage by brute force from what the one before it gave."""
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{folder}/documents.parquet")
    at, kept, texts = docs, [], []
    for name, stage in corpus_pipeline.STAGES:
        at = common.written(stage(spark, at, folder), name)
        kept.append({r["doc_id"] for r in at.select("doc_id").collect()})
        texts.append(sorted((r["doc_id"], r["text"]) for r in at.select("doc_id", "text").collect()) if "text" in at.columns else [])
        assert name == "pack" or at.columns == list(corpus_pipeline.COLUMNS)
    assert not kept[0] & {162, 163, 164, 165} and len(kept[0]) >= len(rows) - 6
    assert kept[1] == near_groups(texts[0]) and 160 not in kept[1]
    counts = repeated([t for _, t in texts[1]])
    assert [len(plain_sentences(t)) for _, t in texts[2]] == [n - gone for n, gone in counts if n > gone]
    assert kept[2] == {k for (k, _), (n, gone) in zip(texts[1], counts) if n > gone} and sum(gone for _, gone in counts) > 0
    copies = Counter(texts[3])
    assert set(copies) <= set(texts[2]) and max(copies.values()) <= 2
    size = lambda rows_: sum(len(t.split()) for _, t in rows_)
    assert abs(size(texts[3]) / size(texts[2]) - 1.5) < 0.05
    lengths = {k: len(ids_of("word_bpe_49k.json", t)) // 4 for k, t in texts[2]}
    assert at.count() == sum(-(-lengths[k] // 2048) * n for (k, _), n in copies.items())
    assert sum(r["length"] for r in at.collect()) == sum(lengths[k] * n for (k, _), n in copies.items())
    again = corpus_pipeline.run(spark, folder)
    assert sorted(map(tuple, again.select("doc_id", "piece", "length").collect())) == sorted(map(tuple, at.select("doc_id", "piece", "length").collect()))


def test_pipeline_of_none_and_of_odd_rows(spark, docs, odd, empty, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    for name, table in (("none", empty), ("odd", docs.union(odd.select(*docs.columns)).withColumn("fp", F.lit(1)).withColumn("row", F.lit("x")))):
        table.write.parquet(f"{folder}/{name}/documents.parquet")
        got = corpus_pipeline.run(spark, f"{folder}/{name}")
        assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        assert (got.count() == 0) == (name == "none")
