"""Phrase collocations: n-grams as rows counted by language, scored against their parts in decimals, without swallowed parts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bits import may_hold, read_filter, write_filter
from .common import discard, remove, small_batches, written

#: Words that a task gathers before it counts them.
GATHER = 1 << 20
_CHUNK = 1 << 22
_DELIMITERS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _DELIMITERS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_DELIMITERS))
_ROWS = "lang string, phrase string, words int, c long"

def word_chunks(text: bytes, size: int = _CHUNK) -> Iterator[list[bytes]]:
    """The words of a folded text, a bounded number of bytes at a time, with a line end for each end of a piece."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            end = text.find(b" ", end) + 1 or len(text)
        yield [w for w in text[at:end].translate(_FOLD).replace(b"\n", b" \n ").split(b" ") if w]
        at = end


def _may_hold(bits: np.ndarray, lang: bytes, phrases: list[bytes]) -> np.ndarray:
    """Which phrases of a language may be in the filter; a phrase that is, always may."""
    head, digest = lang + b"\0", xxhash.xxh64_intdigest
    return may_hold(bits, np.fromiter((digest(head + p, 42) for p in phrases), np.uint64, len(phrases)))


def _grams(tokens: list[bytes], cut: int, low: int, high: int, lang: bytes, words_in: str | None, pairs_in: str | None) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """(words, phrases, counts) for each length from ``low`` to ``high``: n-grams that begin before ``cut`` and cross no line end.

    With filters, only those whose words, and whose pairs of neighbours, may be frequent.
    """
    vocabulary = {b"\n": 0}
    add = vocabulary.setdefault
    ids = np.fromiter((add(w, len(vocabulary)) for w in tokens), np.int64, len(tokens))
    names = list(vocabulary)
    if low == 1:
        counts = np.bincount(ids[:cut], minlength=len(names))
        counts[0] = 0
        found = np.nonzero(counts)[0]
        yield 1, [names[i] for i in found.tolist()], counts[found]
        if high == 1:
            return
    good = np.ones(len(names), bool) if words_in is None else _may_hold(read_filter(words_in), lang, names)
    good[0] = False
    size = len(names)
    alive = good[ids]
    alive = alive[:-1] & alive[1:]
    start = np.nonzero(alive)[0]
    codes, which = np.unique(ids[start] * size + ids[start + 1], return_inverse=True)
    phrases = [names[c // size] + b" " + names[c % size] for c in codes.tolist()]
    if pairs_in is not None and len(phrases):
        fine = _may_hold(read_filter(pairs_in), lang, phrases)
        keep = fine[which]
        start, which = start[keep], which[keep]
    pair = np.zeros(len(ids) + 1, bool)
    pair[start] = True
    rank = np.full(len(ids) + 1, -1, np.int64)
    rank[start] = which
    for n in range(2, high + 1):
        if n > 2:
            start = np.nonzero((rank[:-1] >= 0) & _shifted(pair, n - 2)[:-1])[0]
            codes, which = np.unique(rank[start] * size + ids[np.minimum(start + n - 1, len(ids) - 1)], return_inverse=True)
            phrases = [phrases[c // size] + b" " + names[c % size] for c in codes.tolist()]
            rank = np.full(len(ids) + 1, -1, np.int64)
            rank[start] = which
        if n >= low:
            counts = np.bincount(which[start < cut], minlength=len(phrases))
            found = np.nonzero(counts)[0]
            yield n, [phrases[i] for i in found.tolist()], counts[found]


def _shifted(x: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([x[by:], np.zeros(by, bool)])


def gram_rows(docs: DataFrame, low: int, high: int, *, reach: int, words_in: str | None = None, pairs_in: str | None = None, gather: int = GATHER) -> DataFrame:
    """(lang, phrase, words, c): n-grams of ``low`` to ``high`` words as rows, each with how often a task's stretch of text has it.

    With ``low`` of 1 a row without a phrase tells each stretch's number of words. ``reach`` is the longest n-gram asked
    of any pass: a stretch that ends within a piece hands its last words on to the next.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        held: dict[bytes, list[bytes]] = {}

        def settle(last: bool):
            for lang, tokens in list(held.items()):
                cut = len(tokens) if last else max(0, len(tokens) - reach + 1)
                for n, phrases, counts in _grams(tokens, cut, low, high, lang, words_in, pairs_in):
                    yield from batches_of(lang, n, phrases, counts)
                if low == 1 and cut:
                    yield from batches_of(lang, 0, [None], np.array([cut - tokens[:cut].count(b"\n")]))
                held[lang] = tokens[cut:]

        def batches_of(lang, n, phrases, counts, most=100_000):
            for i in range(0, len(phrases), most):
                part = pa.array(phrases[i : i + most], pa.binary()).cast(pa.string())
                langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(part), np.int32)), pa.array([lang], pa.binary()).cast(pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([langs, part, pa.array(np.full(len(part), n, np.int32)), pa.array(counts[i : i + most].astype(np.int64))], names=["lang", "phrase", "words", "c"])

        for b in batches:
            for lang, text in zip(b.column("lang").cast(pa.binary()).to_pylist(), b.column("text").cast(pa.binary())):
                for words in word_chunks(text.as_py()):
                    held.setdefault(lang, []).extend(words)
                    if sum(map(len, held.values())) >= gather + reach * len(held):
                        yield from settle(False)
                if lang in held:
                    held[lang].append(b"\n")
        yield from settle(True)

    return rows.mapInArrow(run, _ROWS)


def frequent(rows: DataFrame, min_count: int) -> DataFrame:
    """The phrases of gram rows with ``min_count`` occurrences or more, and rows without a phrase: lang, phrase, words, c."""
    return rows.groupBy("lang", "phrase").agg(F.max("words").alias("words"), F.sum("c").alias("c")).where(F.col("phrase").isNull() | (F.col("c") >= min_count))


def phrase_filter(grams: DataFrame) -> str:
    """A filter of the phrases of each language."""
    return write_filter(grams.where("phrase IS NOT NULL"), F.xxhash64(F.concat("lang", F.lit("\0"), "phrase")))


def frequent_grams(docs: DataFrame, *, max_n: int = 5, min_count: int = 100, gather: int = GATHER) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, c) of all n-grams up to ``max_n`` words with ``min_count`` occurrences, and (lang, n) with all words.

    An n-gram occurs no more often than any part of it. So words are counted first, then pairs of words that may be
    frequent, then all longer n-grams whose pairs may be: nothing is lost, and what cannot count is not made a row.
    """
    small_batches(docs.sparkSession)
    words = written(frequent(gram_rows(docs, 1, 1, reach=max_n, gather=gather), min_count), "words")
    words_in = phrase_filter(words)
    levels = [words.where("phrase IS NOT NULL")]
    used = [words_in]
    if max_n >= 2:
        levels.append(written(frequent(gram_rows(docs, 2, 2, reach=max_n, words_in=words_in, gather=gather), min_count), "pairs"))
    if max_n >= 3:
        used.append(phrase_filter(levels[-1]))
        levels.append(written(frequent(gram_rows(docs, 3, max_n, reach=max_n, words_in=words_in, pairs_in=used[-1], gather=gather), min_count), "longer"))
    for uri in used:
        remove(uri.rsplit("/", 1)[0])
    totals = words.where("phrase IS NULL").select("lang", F.col("c").alias("n"))
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    return every, totals


def score_cuts(grams: DataFrame, totals: DataFrame, min_count: int) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of every candidate by its lowest-scoring cut, ties to the earliest.

    Parts occur as often as the whole at least, so they are in ``grams``; products are decimals of 38 digits.
    """
    whole = grams.where((F.col("words") >= 2) & (F.col("c") >= min_count))
    cuts = whole.select("lang", "phrase", "words", F.col("c").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    first = F.array_join(F.slice(F.split("phrase", " "), F.lit(1), F.col("k")), " ")
    rest = F.array_join(F.slice(F.split("phrase", " "), F.col("k") + 1, F.col("words") - F.col("k")), " ")
    cuts = cuts.withColumns({"first": first, "rest": rest})
    part = lambda name, count: grams.select(F.col("lang").alias(f"_{name}_lang"), F.col("phrase").alias(f"_{name}"), F.col("c").alias(count))
    cuts = cuts.join(part("first", "l"), (F.col("lang") == F.col("_first_lang")) & (F.col("first") == F.col("_first")))
    cuts = cuts.join(part("rest", "r"), (F.col("lang") == F.col("_rest_lang")) & (F.col("rest") == F.col("_rest")))
    cuts = cuts.join(totals.withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang"))
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return cuts.groupBy("lang", "phrase", "words", "a", "n").agg(best).select("lang", "phrase", "words", "a", "best.l", "best.r", "n", "best.score")


def without_swallowed(scored: DataFrame) -> DataFrame:
    """The candidates that no longer candidate holds as often: those with a one-word extension of the same count go.

    A phrase inside a longer one occurs as often at least, so what a longer one by several words swallows, one by one
    word between them does too.
    """
    words = F.split("phrase", " ")
    ends = F.array(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1))
    longer = scored.where("words > 2").select(F.col("lang").alias("_lang"), F.explode(ends).alias("_end"), "a").groupBy("_lang", F.array_join("_end", " ").alias("_part")).agg(F.max("a").alias("_a"))
    return scored.join(longer, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_part")) & (F.col("_a") >= F.col("a")), "left_anti")


def best_of_each(rows: DataFrame, by: str, order: list, most: int, key: str) -> DataFrame:
    """The first ``most`` rows of each ``by`` with their rank from 1; large groups are thinned in parts by ``key`` first."""
    rows, made = written(rows, "ranked"), []
    n = rows.count()
    while n > 16 * most:
        parts = math.ceil(n / (8 * most))
        own = Window.partitionBy(by, F.pmod(F.xxhash64(key), F.lit(parts))).orderBy(*order)
        made.append(rows)
        rows = written(rows.withColumn("_rank", F.row_number().over(own)).where(F.col("_rank") <= most).drop("_rank"), "ranked")
        before, n = n, rows.count()
        if n > before // 2:  # many groups, each small
            break
    for table in made:
        discard(table)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, *, max_n: int = 5, min_count: int = 100, most: int = 2000, gather: int = GATHER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``most`` best phrases of 2 to ``max_n`` words.

    Texts are folded (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs; no phrase
    crosses a piece. a: occurrences, at least ``min_count``; l, r: those of the two parts at the cut with the lowest
    floor(1000 a n / (l r)); n: the language's words. Null texts are empty, null languages are ``und`` (and join a
    language of that name), repeated rows count again, an empty table gives an empty result. Order: score, a, phrase.
    """
    docs = docs.select("lang", "text")
    grams, totals = frequent_grams(docs, max_n=max_n, min_count=min_count, gather=gather)
    scored = written(score_cuts(grams, totals, min_count), "scored")
    kept = best_of_each(without_swallowed(scored), "lang", [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], most, "phrase")
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
