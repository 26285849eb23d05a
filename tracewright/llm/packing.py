"""Best-fit packing: few-document length patterns fitted to the histogram by non-negative least squares, then residuals.

Patterns are all those of one to three lengths that fill a sequence, and of four the ones that what is left asks for.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import encode_rows

#: Pieces of one length that one task ranks.
RANK_ROWS = 1000
#: Documents of a pattern at most; times that patterns of as many are sought by what the fit leaves; what a fitted repeat
#: may exceed a whole number by and still be rounded down, of which the best is taken.
MEMBERS, ROUNDS, ROUNDING = 4, 2, (1e-4, 0.01, 0.5)
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of every document: its ids with the end id, cut every ``capacity`` ids. Null texts are empty."""

    def cut(batches):
        rows: list[tuple] = []
        for doc_id, raw in encode_rows(batches, tokenizer, end_id):
            for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at : at + 4 * capacity]
                rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            if len(rows) >= 20_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _batch(rows):
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECES)


def length_patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of one, two and three lengths that fill a sequence; rows descend and are padded with 0."""
    has = np.zeros(capacity + 1, bool)
    has[present] = True
    a = np.arange(1, capacity // 2 + 1)
    out = [np.array([[capacity, 0, 0, 0]]), np.stack([capacity - a, a, 0 * a, 0 * a], 1)]
    for x in np.nonzero(has[: capacity // 3 + 1])[0].tolist():
        y = np.arange(max(x, 1), (capacity - x) // 2 + 1)
        y = y[has[y] & has[capacity - x - y]]
        out.append(np.stack([capacity - x - y, y, np.full(len(y), x), 0 * y], 1))
    every = np.concatenate(out)
    return every[(has[every] | (every == 0)).all(axis=1)]


def better_patterns(worth: np.ndarray, present: np.ndarray, members: int) -> np.ndarray:
    """For each length, the pattern of ``members`` documents with it that fills a sequence and whose lengths are worth most.

    ``worth`` is what the fit leaves at each length. The best completion comes from a table over sums, so every pattern
    of so many documents is considered, though only the best are listed.
    """
    capacity = len(worth) - 1
    own = np.full(capacity + 1, -np.inf)
    own[present] = worth[present]
    best, last = own, [np.arange(capacity + 1)]
    for _ in range(members - 2):
        now, arg = np.full(capacity + 1, -np.inf), np.zeros(capacity + 1, np.int64)
        for x in present.tolist():
            value = own[x] + best[: capacity + 1 - x]
            up = value > now[x:]
            now[x:][up] = value[up]
            arg[x:][up] = x
        best = now
        last.append(arg)
    lengths = present[own[present] + best[capacity - present] > 0]
    rows, rest = [lengths], capacity - lengths
    for arg in last[::-1]:
        rows.append(arg[rest])
        rest = rest - arg[rest]
    return np.unique(np.sort(np.stack(rows, 1), axis=1)[:, ::-1], axis=0)


def _filled(patterns: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return sum(np.bincount(patterns[:, j], weights=x * (patterns[:, j] > 0), minlength=n) for j in range(patterns.shape[1]))


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray | None = None, steps: int = 120) -> np.ndarray:
    """Non-negative repeats x that bring the patterns' lengths nearest to the histogram, by accelerated projected descent."""
    if not len(patterns):
        return np.zeros(0)
    n, used = len(counts), patterns > 0
    scale = 1.0 / np.sqrt(np.maximum(counts, 1.0))  # counts of rare lengths weigh as those of common ones

    def times(x):
        return _filled(patterns, x, n) * scale

    def back(r):
        r = r * scale
        return sum(r[patterns[:, j]] * used[:, j] for j in range(patterns.shape[1]))

    v = np.random.default_rng(0).random(len(patterns))
    for _ in range(15):
        v = back(times(v))
        v /= np.linalg.norm(v)
    step = 1.0 / (1.05 * np.linalg.norm(back(times(v))))
    x = y = np.zeros(len(patterns)) if start is None else start
    t, goal = 1.0, counts * scale
    for _ in range(steps):
        new = np.maximum(0.0, y - step * back(times(y) - goal))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def fitted_patterns(counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two fits, [(patterns, repeats), ...]: of all patterns of up to three documents, and with those of four that fill
    what the first fit leaves."""
    capacity, present = len(counts) - 1, np.nonzero(counts)[0]
    patterns = length_patterns(present, capacity)
    x = fit_repeats(patterns, counts)
    first = patterns, x
    code = lambda p: p @ (capacity + 1) ** np.arange(MEMBERS, dtype=np.int64)
    for _ in range(ROUNDS if len(present) else 0):
        left = (counts - _filled(patterns, x, len(counts))) / np.maximum(counts, 1)
        new = better_patterns(left, present, MEMBERS)
        new = new[~np.isin(code(new), code(patterns))]
        if not len(new):
            break
        patterns, x = np.concatenate([patterns, new]), np.concatenate([x, np.zeros(len(new))])
        x = fit_repeats(patterns, counts, x)
    return [first, (patterns, x)]


def rounded(patterns: np.ndarray, x: np.ndarray, counts: np.ndarray, slack: float) -> tuple[list, np.ndarray]:
    """[(pattern, how many), ...] by falling repeats, rounded up beyond ``slack`` where pieces are there; and the pieces left."""
    many = np.ceil(x - slack).astype(np.int64)
    order = np.argsort(-x, kind="stable")[: int((many > 0).sum())]
    left, chosen = counts.tolist(), []
    left[0] = 1 << 60  # what patterns are padded with is always there
    for pattern, n in zip(map(tuple, patterns[order].tolist()), many[order].tolist()):
        if not all(left[v] for v in pattern):
            continue
        need: dict[int, int] = {}
        for v in pattern:
            if v:
                need[v] = need.get(v, 0) + 1
        n = min(n, *(left[v] // c for v, c in need.items()))
        if n > 0:
            for v, c in need.items():
                left[v] -= n * c
            chosen.append((pattern, n))
    left[0] = 0
    return chosen, np.array(left, np.int64)


def pack_residuals(left: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over counts of lengths: [(length, how many), ...] and how many such sequences."""
    by_space: dict[int, list] = defaultdict(list)
    for length in np.nonzero(left)[0][::-1].tolist():
        n = int(left[length])
        for space in sorted(s for s in by_space if s >= length):
            groups, kept = by_space.pop(space), []
            while groups and n:
                pattern, many = groups.pop()
                fit = space // length
                full = min(many, n // fit)
                if full:
                    by_space[space - fit * length].append(([*pattern, (length, fit)], full))
                    many, n = many - full, n - full * fit
                if many and n:  # fewer are left than one sequence has room for
                    by_space[space - n * length].append(([*pattern, (length, n)], 1))
                    many, n = many - 1, 0
                if many:
                    kept.append((pattern, many))
            if groups or kept:
                by_space[space] = by_space.get(space, []) + groups + kept
            if not n:
                break
        fit = capacity // length
        if n // fit:
            by_space[capacity - fit * length].append(([(length, fit)], n // fit))
        if n % fit:
            by_space[capacity - n % fit * length].append(([(length, n % fit)], 1))
    return [g for groups in by_space.values() for g in groups]


def plan_sequences(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank within their length: runs of ranks, sorted by (length, rank).

    The plan depends on the histogram alone; its size is bounded by the number of patterns, not by the documents.
    """
    counts = counts.astype(np.int64)
    best: tuple = ()
    for patterns, x in fitted_patterns(counts.astype(float)):
        for slack in ROUNDING:
            chosen, left = rounded(patterns, x, counts, slack)
            rest = pack_residuals(left, capacity)
            rank = sum(n for _, n in chosen) + sum(n for _, n in rest), int(left.sum())
            if not best or rank < best[0]:  # the fewest sequences; of equal ones the plan that patterns fill most of
                best = rank, chosen, rest
    (_, left_over), chosen, rest = best
    by_patterns = int(counts.sum()) - left_over
    chosen = [([(v, pattern.count(v)) for v in dict.fromkeys(pattern) if v], n) for pattern, n in chosen] + rest
    used, sequence, runs = np.zeros(len(counts), np.int64), 0, []
    for pattern, many in chosen:
        offset = 0
        for length, copies in pattern:
            runs.append((length, used[length], sequence, copies, offset))
            used[length] += copies * many
            offset += copies * length
        sequence += many
    assert (used == counts).all(), "the plan must hold every piece once"
    runs = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return {"length": runs[:, 0], "rank": runs[:, 1], "sequence": runs[:, 2], "copies": runs[:, 3], "offset": runs[:, 4], "sequences": np.array([sequence]), "by_patterns": np.array([by_patterns])}


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; one row per piece.

    Null texts are empty (their end id alone), null ids are ids like any other, repeated rows are packed each. Pieces of
    a length are ranked by parts of some RANK_ROWS rows, so a hot length is no hot task. Ties are ranked by id and piece;
    rows equal in all are exchangeable. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    pieces = written(cut_pieces(docs, tokenizer, capacity=capacity, end_id=end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    plan = plan_sequences(counts, capacity)
    parts = F.element_at(F.lit([int(-(-c // RANK_ROWS)) or 1 for c in counts[1:]]), F.col("length").cast("int"))
    spread = F.xxhash64(F.col("doc_id"), F.col("piece"), F.col("ids_crc32"))
    pieces = pieces.withColumn("_part", F.pmod(spread, parts))
    starts = pieces.groupBy(F.col("length").alias("_l"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_l").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_l", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    row = F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = pieces.withColumn("_row", row).join(starts, (F.col("length") == F.col("_l")) & (F.col("_part") == F.col("_p")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_start") + F.col("_row") - 1).cast("long").alias("rank"))

    def place(batches):
        keys = plan["length"] * (1 << 48) + plan["rank"]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            nth = rank - plan["rank"][k]
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            cols += [pa.array(plan["sequence"][k] + nth // plan["copies"][k]), pa.array(plan["offset"][k] + nth % plan["copies"][k] * length)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, _PIECES + ", sequence_id long, offset long")
