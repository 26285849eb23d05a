"""Centroid clustering by Yinyang k-means over integer vectors: grouped lower bounds, exact distances, exact means."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_batches, written

#: Scaled components must be below this in magnitude, so that squared distances of 64 of them fit a long.
COMPONENT_LIMIT = 1 << 27
#: What bounds are widened by, relatively, so that rounding never makes them wrong.
_SLACK = 1e-12
_STATE = "sums boolean, vec_id long, x array<int>, cluster int, upper double, lower array<double>, delta array<long>, n long, distance long"


def integer_vectors(vectors: DataFrame, *, dims: int = 64, scale: int = 1024) -> DataFrame:
    """vec_id and x: floor(scale * component) of the vectors with exactly ``dims`` components, none null or non-finite."""
    e = F.col("embedding")
    fine = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    scaled = F.transform(e, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    fits = F.forall(F.col("x"), lambda c: F.abs(c) < COMPONENT_LIMIT)
    said = F.raise_error(F.lit(f"a component of {COMPONENT_LIMIT // scale} or more: squared distances may not fit a long"))
    kept = vectors.where((F.size(e) == dims) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("x"))
    return kept.select("vec_id", F.when(fits, F.col("x")).otherwise(said.cast("array<bigint>")).cast("array<int>").alias("x"))


def first_centroids(ints: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:vec_id``, in that order; ties go by components, null ids come last."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = ints.orderBy(mark.asc_nulls_last(), "x").limit(k).select("x").collect()
    return np.array([r["x"] for r in rows], np.int64)


def group_centroids(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """A group for each centroid, by a few rounds of k-means among the centroids themselves; done once."""
    middle = centroids[: max(1, groups)].astype(float)
    own = np.zeros(len(centroids), np.int64)
    for _ in range(rounds):
        own = np.array([int(((middle - c) ** 2).sum(axis=1).argmin()) for c in centroids], np.int64)
        middle = np.array([centroids[own == g].mean(axis=0) if (own == g).any() else middle[g] for g in range(len(middle))])
    return own


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to a centroid, or to one each."""
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def reassign(x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, group: np.ndarray) -> int:
    """Bring ``a``, ``upper`` and ``lower`` (a bound per group on all centroids but the row's own) up to date, in place.

    First filter: a row whose upper bound is below all its lower bounds keeps its centroid. Then by group: only groups
    whose bound is not above the row's distance are scanned, whole and exactly. A bound that equals the distance does not
    pass, as a tie may go to a smaller number. Returns how many distances were computed.
    """
    open_ = np.nonzero(upper >= lower.min(axis=1))[0]
    if not len(open_):
        return 0
    mine = squared(x[open_], centroids[a[open_]])
    asked = len(open_)
    upper[open_] = np.sqrt(mine) * (1 + _SLACK)
    still = upper[open_] >= lower[open_].min(axis=1)
    rows, mine = open_[still], mine[still]
    if not len(rows):
        return asked
    old, best, best_d = a[rows], a[rows].copy(), mine.copy()
    seen: dict[int, tuple] = {}
    for g in range(lower.shape[1]):
        members = np.nonzero(group == g)[0]
        at = np.nonzero(lower[rows, g] <= upper[rows])[0]
        if not len(at) or not len(members):
            continue
        d = np.stack([squared(x[rows[at]], centroids[c]) for c in members], 1)
        asked += d.size
        near = d.argmin(axis=1)  # the first of equals, so the smallest number
        least = d[np.arange(len(at)), near]
        better = (least < best_d[at]) | ((least == best_d[at]) & (members[near] < best[at]))
        best[at[better]], best_d[at[better]] = members[near[better]], least[better]
        d[np.arange(len(at)), near] = np.iinfo(np.int64).max
        second = d.min(axis=1) if len(members) > 1 else np.full(len(at), -1)
        seen[g] = (at, members[near], least, second)
    left = np.ones(len(rows), bool)  # rows whose old centroid's group was not scanned
    for g, (at, first, least, second) in seen.items():
        own = first == best[at]
        bound = np.where(own, second, least)
        lower[rows[at], g] = np.where(bound < 0, np.inf, np.sqrt(np.maximum(bound, 0)) * (1 - _SLACK))
        left[at[group[old[at]] == g]] = False
    moved = left & (best != old)
    lower[rows[moved], group[old[moved]]] = np.minimum(lower[rows[moved], group[old[moved]]], np.sqrt(mine[moved]) * (1 - _SLACK))
    a[rows], upper[rows] = best, np.sqrt(best_d) * (1 + _SLACK)
    return asked


def _round(centroids: np.ndarray, group: np.ndarray, groups: int, drift: np.ndarray, first: bool, last: bool):
    """The map of one round over state rows: each row's new state, and at a task's end what its moved rows change in the sums."""
    k, dims = centroids.shape
    farthest = np.array([drift[group == g].max() if (group == g).any() else 0.0 for g in range(groups)])
    names = [c.split()[0] for c in _STATE.split(", ")]
    types = [pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]

    def lists(flat: np.ndarray, width: int, kind: pa.DataType) -> pa.Array:
        n = len(flat) // width if width else 0
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(flat, kind))

    def batch(n: int, given: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, t) for c, t in zip(names, types)], schema=pa.schema(list(zip(names, types))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        delta, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            flat = b.column("x").flatten()
            x = flat.to_numpy().astype(np.int64).reshape(n, dims)
            if first:
                a, upper, lower = np.zeros(n, np.int64), np.full(n, np.inf), np.full((n, groups), -1.0)
                lower[:, [g for g in range(groups) if not (group == g).any()]] = np.inf
            else:
                a = b.column("cluster").to_numpy().astype(np.int64)
                upper = b.column("upper").to_numpy() + drift[a] * (1 + _SLACK)
                upper *= 1 + _SLACK
                lower = b.column("lower").flatten().to_numpy().reshape(n, groups)
                lower = lower - farthest * (1 + _SLACK) - _SLACK * np.where(np.isfinite(lower), np.abs(lower), 0.0)
            before = a.copy()
            reassign(x, a, upper, lower, centroids, group)
            new, gone = (np.arange(n) if first else np.nonzero(a != before)[0]), np.nonzero(a != before)[0]
            np.add.at(delta, a[new], x[new])
            np.add.at(count, a[new], 1)
            if not first:
                np.subtract.at(delta, before[gone], x[gone])
                np.subtract.at(count, before[gone], 1)
            given = {"sums": pa.array(np.zeros(n, bool)), "vec_id": b.column("vec_id"), "cluster": pa.array(a, pa.int32())}
            if last:
                given["distance"] = pa.array(squared(x, centroids[a]), pa.int64())
            else:
                given |= {"x": lists(flat.to_numpy(), dims, pa.int32()), "upper": pa.array(upper), "lower": lists(lower.ravel(), groups, pa.float64())}
            yield batch(n, given)
        changed = np.nonzero((count != 0) | (delta != 0).any(axis=1))[0]
        if len(changed) and not last:
            m = len(changed)
            yield batch(m, {"sums": pa.array(np.ones(m, bool)), "cluster": pa.array(changed, pa.int32()), "delta": lists(delta[changed].ravel(), dims, pa.int64()), "n": pa.array(count[changed], pa.int64())})

    return run


def yinyang_clusters(vectors: DataFrame, *, k: int = 8, rounds: int = 10, groups: int | None = None, dims: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector, a row per row.

    Kept are vectors of exactly ``dims`` components without null or non-finite ones; component c becomes
    floor(scale * c). Distances, sums and means are exact integers, so the result is that of plain k-means. Null ids are
    kept but begin no centroid before others do; repeated rows are vectors like any other; fewer vectors than ``k`` make
    fewer centroids; an empty table gives an empty one. A scaled component of 2^27 or more raises an error, as squared
    distances may then exceed a long. Centroids fall into ``groups`` once (a quarter as many unless given).

    Each round is one scan without a shuffle: state and vectors are a table in the shared folder, and of sums only what
    moved vectors change is gathered, a row per centroid and task. The driver holds centroids alone.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    ints = written(integer_vectors(vectors, dims=dims, scale=scale), "vectors")
    centroids = first_centroids(ints, k, seed)
    if not len(centroids):
        none = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], none)
    k = len(centroids)
    groups = max(1, min(groups or -(-k // 4), k))
    group, drift = group_centroids(centroids, groups), np.zeros(k)
    sums, sizes = [[0] * dims for _ in range(k)], [0] * k
    state = ints.select("vec_id", "x", F.lit(0).alias("cluster"), F.lit(0.0).alias("upper"), F.array().cast("array<double>").alias("lower"))
    earlier = ints
    for n in range(rounds + 1):
        last = n == rounds
        now = written(state.mapInArrow(_round(centroids, group, groups, drift, n == 0, last), _STATE), "state")
        discard(earlier)
        earlier, state = now, now.where("NOT sums").select("vec_id", "x", "cluster", "upper", "lower")
        if last:
            break
        total = now.where("sums").groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("delta", F.lit(i))).alias(f"d{i}") for i in range(dims)])
        for r in total.collect():
            sizes[r["cluster"]] += r["n"]
            sums[r["cluster"]] = [s + r[f"d{i}"] for i, s in enumerate(sums[r["cluster"]])]
        new = np.array([[s // sizes[c] for s in sums[c]] if sizes[c] else centroids[c] for c in range(k)], np.int64)
        drift = np.sqrt(squared(new, centroids)) * (1 + _SLACK)
        centroids = new
    rows = now.where("NOT sums").select("vec_id", "cluster", "distance")
    inertia = {r["cluster"]: int(r["s"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    told = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in range(k)]
    named = spark.createDataFrame(told, "_c int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), F.col("cluster") == F.col("_c")).drop("_c")  # k rows
