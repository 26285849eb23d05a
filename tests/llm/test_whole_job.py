"""Cases in which an operator did less than its whole job."""

import zlib
from collections import Counter

import numpy as np
import pytest

from tracewright.llm import ngram, queries, simhash, spans

# 1

UNCUT = [f"plain{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
PASSAGES = {
    "no cuts": " ".join(UNCUT),
    "tabs": "\t".join(UNCUT),
    "unspaced marks": "，".join(chr(0x4E00 + 7 * k) * 3 for k in range(30)) + "。",
    "unspaced": "".join(chr(0x4E00 + 11 * k) for k in range(60)),
}


@pytest.mark.parametrize("name", PASSAGES)
def test_op1_passages_with_few_cuts_are_found(spark, name):
    passage = PASSAGES[name]
    texts = [passage, f"one red {passage} two blue", f"three green {passage} four white", "a text of its own"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(9, passage)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in spans.remove_repeats(docs).collect()}
    assert got[0]["text"] == passage and got[3]["text"] == texts[3] and got[0]["n_removed"] == got[3]["n_removed"] == 0
    assert all(len(got[k]["text"]) < len(texts[k]) - len(passage) / 3 for k in (1, 2)) and len(got[9]["text"]) < len(passage) / 4


# 2


def test_op2_keeps_ngrams_seen_once(spark, tmp_path):
    """A trigram seen once in training outweighs the same words in an order never seen."""
    rng = np.random.default_rng(2)
    vocabulary = [f"w{k}" for k in range(200)]
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 10]
    out = [k for k in range(200) if not zlib.crc32(str(k).encode()) % 10][:2]
    rows = [(k, " ".join(rng.choice(vocabulary, 12))) for k in ids[:30]]
    toks = [t.split() for _, t in rows]
    grams = Counter(g for t in toks for g in zip(t, t[1:]))
    once = next(t for t in toks if all(grams[g] == 1 for g in zip(t[3:7], t[4:7])))
    seen = once[3:7]
    unseen = next(p for p in (list(rng.permutation(seen)) for _ in range(99)) if not any(g in grams for g in zip(p, p[1:])) and p[0] == seen[0])
    rows += [(out[0], " ".join(seen)), (out[1], " ".join(unseen))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op2_lm_scores(spark, str(tmp_path)).collect()}
    assert got[out[0]]["base_score"] == pytest.approx(got[out[1]]["base_score"])
    assert got[out[0]]["score"] > got[out[1]]["score"] + 1


# pipeline


def reordered(seed, texts=40, words=90):
    """Texts of one vocabulary in different order, and a near copy of each with its last word changed."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"word{k}" for k in range(words)]
    first = [[vocabulary[k] for k in rng.permutation(words)] for _ in range(texts)]
    return [(k, " ".join(w)) for k, w in enumerate(first)] + [(texts + k, " ".join([*w[:-1], "changed"])) for k, w in enumerate(first)]


def test_near_dedup_forest_leaves_no_pair_out(spark):
    docs = spark.createDataFrame(reordered(7), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs).select("doc_id").collect()) == list(range(40))


def kept_by_all_pairs(rows, least=0.8):
    """The smallest id of each group that pairs of five-word shingle sets with a Jaccard of 0.8 or more connect."""
    words = {k: t.split() for k, t in rows}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in words.items()}
    root = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    return sorted(set(root.values()))


def edited(seed, groups=6, copies=30, words=160):
    """Groups of texts with ever more words changed, so that similarities lie on both sides of 0.8, and texts with the same words shuffled."""
    rng, out = np.random.default_rng(seed), []
    for g in range(groups):
        base = [f"g{g}w{k}" for k in rng.integers(0, 90, words)]
        for n in range(copies):
            w = list(base)
            for k in rng.choice(words, n // 3, replace=False):
                w[k] = f"new{rng.integers(0, 9)}"
            out.append(w if n % 5 else list(rng.permutation(w)))
    return [(k, " ".join(w)) for k, w in enumerate(out)]


def changed(seed):
    """Pairs and chains of every kind of change, on texts of all lengths: words appended, set in, put before, repeated, taken out."""
    rng, out = np.random.default_rng(seed), []
    word = lambda: f"w{rng.integers(0, 5000)}"
    for g in range(150):
        n = int(rng.choice([5, 8, 12, 20, 40, 100, 300, 900]))
        base = [word() for _ in range(n)]
        out.append(base)
        kind, more = g % 6, max(1, int(n * rng.uniform(0, 0.25)))
        for _ in range(1 + g % 3):
            if kind == 0:
                base = base + [word()]
            elif kind == 1:
                base = base + [word() for _ in range(more)]
            elif kind == 2:
                at = int(rng.integers(0, n))
                base = base[:at] + [word() for _ in range(more)] + base[at:]
            elif kind == 3:
                base = base + [base[-1]] * 60
            elif kind == 4:
                base = base[: max(1, n - more)]
            else:
                base = [word()] + base
            out.append(base)
    shared = [word() for _ in range(60)]
    out += [shared + [word() for _ in range(int(rng.integers(0, 40)))] for _ in range(60)]  # a common passage with other words
    order = rng.permutation(len(out))
    return [(k, " ".join(out[i])) for k, i in enumerate(order)]


EDITS, DENSE, CHANGES = edited(11), edited(3, groups=2, copies=90, words=60), changed(5)


@pytest.mark.parametrize("rows, parts", [(EDITS, {}), (DENSE, {}), (CHANGES, {}), (DENSE, {"group_rows": 12, "fan": 1}), (CHANGES, {"radius": 1, "slack": -9.0, "fan": 2})], ids=["edits", "dense", "changes", "parts", "unlinked"])
def test_near_dedup_is_that_of_all_pairs(spark, rows, parts):
    """With the pipeline's own values; with groups and keys of many rounds; and with fingerprints that link next to nothing."""
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(r["doc_id"] for r in simhash.keep_one_of_each(docs, **parts).collect())
    assert got == kept_by_all_pairs(rows)


def test_prefixes_of_similar_sets_share_a_shingle():
    rng = np.random.default_rng(1)
    slots, counts = np.arange(0, 1 << 24, 3), rng.integers(1, 9, len(range(0, 1 << 24, 3)))
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.unique(np.concatenate([a[: n - int(n * rng.uniform(0, 0.2))], rng.integers(0, 1 << 63, int(n * rng.uniform(0, 0.2))).astype(np.uint64)]))
        a = np.unique(a)
        common = len(np.intersect1d(a, b))
        if common >= 0.8 * (len(a) + len(b) - common):
            assert set(simhash.prefix_of(a, 0.8, slots, counts).tolist()) & set(simhash.prefix_of(b, 0.8, slots, counts).tolist())


def test_slot_counts_do_not_pass_the_driver(spark, monkeypatch):
    """Tasks write them; only slots that a task saw often enough have a count, and the most frequent the highest."""
    docs = spark.createDataFrame([(f"a b c w{k}" if k % 2 else "a b c a b c",) for k in range(40)], "text string").coalesce(1)
    for gather in ("collect", "toLocalIterator", "toPandas"):
        monkeypatch.setattr(type(docs), gather, lambda *_, **__: pytest.fail("gathered"))
    levels = simhash._common(simhash.common_slots(docs, 3))
    of = lambda t: levels[simhash._slots_of(simhash.shingle_set(t, 3))].tolist()
    assert of("a b c") == [43] and of("b c a") == [35] and of("b c w1") == [0] and np.count_nonzero(levels) == 3


def test_near_dedup_of_clashing_columns_nulls_and_none(spark):
    data = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, None), (3, ""), (None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    docs = docs.selectExpr("doc_id", "text", *[f"{k} AS {c}" for k, c in enumerate(("node", "_node", "_row", "fp", "root", "s0", "id"))])
    out = simhash.keep_one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], r["root"]) for r in out.collect()) == [(1, 4), (2, 4)]
    assert simhash.keep_one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("length", [256, 512, 1024, 2048, 4096])
def test_words_that_polynomials_confuse_are_two(spark, length):
    """The Thue-Morse word and its complement: equal modulo 2^64 under any base."""
    one = "".join("ab"[bin(k).count("1") % 2] for k in range(length))
    two = one.translate(str.maketrans("ab", "ba"))
    h, _ = ngram.hash_words([one.encode(), two.encode(), one.encode()])
    assert h[0] == h[4] != h[2]
    values = np.frombuffer((one + two).encode(), np.uint8)
    a, b = spans._hashes(values, np.array([0, length]), np.array([length, 2 * length]))
    assert a != b
