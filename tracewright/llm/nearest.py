"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first, to a calibrated number of leaves."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, put_bytes, scratch, written

#: Vectors that the tree is fitted on at most, and queries that calibrate the search at most.
FIT_ROWS, CALIBRATION_QUERIES = 20_000, 64
#: Vectors that one group holds, about: of leaves next to each other, or a part of a larger leaf.
BLOCK_ROWS = 2048


@dataclass
class Node:
    centres: np.ndarray
    children: list = field(default_factory=list)  # a Node, or the number of a leaf


@dataclass
class Tree:
    """Inner nodes hold the centres of their children; leaves are numbered from 0."""

    root: Node
    leaves: int

    @classmethod
    def fit(cls, sample: np.ndarray, leaves: int, branch: int = 8, seed: int = 0) -> Tree:
        rng, count = np.random.default_rng(seed), 0

        def grow(rows: np.ndarray, want: int):
            nonlocal count
            distinct = np.unique(rows, axis=0) if len(rows) <= 4096 else rows
            k = min(branch, want, len(distinct))
            if k < 2:
                count += 1
                return count - 1
            centres = _kmeans(rows, distinct, k, rng)
            own = _nearest_centre(rows, centres)
            node = Node(centres)
            for c in range(k):
                part = rows[own == c]
                node.children.append(grow(part, round(want * len(part) / len(rows))) if len(part) else grow(rows[:1], 1))
            return node

        root = grow(sample, leaves) if len(sample) else 0
        if not isinstance(root, Node):
            root, count = Node(sample[:1] if len(sample) else np.zeros((1, 1)), [0]), 1
        return cls(root, count)

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf that each row descends to."""
        out = np.zeros(len(rows), np.int64)
        stack = [(self.root, np.arange(len(rows)))]
        while stack:
            node, at = stack.pop()
            own = _nearest_centre(rows[at], node.centres)
            for c, child in enumerate(node.children):
                part = at[own == c]
                if not len(part):
                    continue
                if isinstance(child, Node):
                    stack.append((child, part))
                else:
                    out[part] = child
        return out

    def visit(self, query: np.ndarray, most: int, nodes: Nodes | None = None, until: frozenset = frozenset()) -> list[int]:
        """Leaves in the order of a best-bin-first search: a priority queue of branches by distance to their centre.

        ``nodes``: how leaves of this tree are split further. The search ends after ``most`` leaves, or with the last of ``until``.
        """
        queue, n, order, missing = [(0.0, 0, self.root)], 1, [], set(until)
        while queue and len(order) < most and (missing or not until):
            _, _, node = heapq.heappop(queue)
            while inner := (node.centres, node.children) if isinstance(node, Node) else nodes and nodes.get(node):
                centres, children = inner
                far = ((centres - query) ** 2).sum(axis=1)
                best = int(far.argmin())
                for c, child in enumerate(children):
                    if c != best:
                        heapq.heappush(queue, (float(far[c]), n, child))
                        n += 1
                node = children[best]
            order.append(node)
            missing.discard(node)
        return order


#: A leaf's number says how deep it is and by which children: depth << 56 | path, 8 bits a child below the first tree.
_DEPTH, _CHILDREN = 56, 256
_node_files: dict[str, tuple] = {}


@dataclass(frozen=True)
class Nodes:
    """Leaves of the first tree, and their children, that are split further, in files of the shared folder that workers map.

    files: for each depth the number of files; a split leaf is in the file of its number modulo that. A file has the
    leaves in order, where each one's centres begin, and the centres.
    """

    folder: str
    files: tuple[int, ...] = ()

    def _file(self, depth: int, k: int) -> tuple:
        uri = f"{self.folder}/{depth}-{k:06d}.nodes"
        if uri not in _node_files:
            if len(_node_files) > 4096:
                _node_files.clear()
            fs, path = filesystem(uri)
            if fs.get_file_info(path).type.name == "NotFound":
                _node_files[uri] = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros((0, 1))
            else:
                view = memoryview(fs.open_input_file(path).read() if fs.type_name != "local" else np.memmap(path, np.uint8, "r"))
                n, dims = np.frombuffer(view[:16], "<i8").tolist()
                leaves, starts = np.frombuffer(view[16 : 16 + 8 * n], "<i8"), np.frombuffer(view[16 + 8 * n : 24 + 16 * n], "<i8")
                _node_files[uri] = leaves, starts, np.frombuffer(view[24 + 16 * n :], "<f8").reshape(-1, dims)
        return _node_files[uri]

    def get(self, leaf: int) -> tuple[np.ndarray, list[int]] | None:
        """Centres and children of a split leaf; None if it is whole."""
        depth = leaf >> _DEPTH
        if depth >= len(self.files):
            return None
        leaves, starts, centres = self._file(depth, leaf % self.files[depth])
        k = int(np.searchsorted(leaves, leaf))
        if k == len(leaves) or leaves[k] != leaf:
            return None
        own, path = slice(int(starts[k]), int(starts[k + 1])), leaf & ((1 << _DEPTH) - 1)
        return centres[own], [(depth + 1) << _DEPTH | path << 8 | c for c in range(own.stop - own.start)]


def _pack_nodes(found: list[tuple[int, np.ndarray]]) -> list[bytes]:
    found.sort(key=lambda x: x[0])
    starts = np.cumsum([0, *(len(c) for _, c in found)])
    return [np.array([len(found), found[0][1].shape[1]], "<i8").tobytes(), np.array([x for x, _ in found], "<i8").tobytes(), starts.astype("<i8").tobytes(), np.concatenate([c for _, c in found]).astype("<f8").tobytes()]


def _nearest_centre(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


def _kmeans(rows: np.ndarray, distinct: np.ndarray, k: int, rng, steps: int = 8) -> np.ndarray:
    centres = distinct[rng.choice(len(distinct), k, replace=False)].copy()
    for _ in range(steps):
        own = _nearest_centre(rows, centres)
        for c in range(k):
            if (own == c).any():
                centres[c] = rows[own == c].mean(axis=0)
    return centres


def usable(vector: Column) -> Column:
    """Vectors that take part: not null, not empty, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64)


def _top(query_ids, queries, ids, rows, k):
    """The k nearest of ``rows`` for each query, by exact distance and then id; a query's own id is no candidate."""
    out = []
    for qid, q in zip(query_ids.tolist(), queries):
        far = np.sqrt(((rows - q) ** 2).sum(axis=1))
        other = ids != qid
        far, own = far[other], ids[other]
        if len(far) > k:
            least = np.partition(far, k - 1)[k - 1]
            far, own = far[far <= least], own[far <= least]
        order = np.lexsort((own, far))[:k]
        out.append(pd.DataFrame({"query_id": qid, "vec_id": own[order], "score": far[order]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


_FOUND = "query_id long, vec_id long, score double"


class Index:
    """Every usable vector under its leaf, leaves in blocks; and the tree.

    The first tree is fitted on a bounded sample (some ``fit_rows`` rows). Of its leaves those of more than ``split_rows``
    rows are split again, each by k-means on a bounded sample (``split_fit``) of its own rows, and so on, so leaves stay
    small however many rows there are. Leaves of the first tree are numbered along it, and some that lie together share
    a block (``bin``); those of a split leaf are a block of their own. What cannot be split, as equal vectors, has
    blocks of some BLOCK_ROWS rows, numbered from 1.
    """

    def __init__(self, vectors: DataFrame, *, leaf_rows: int = 64, seed: int = 0, fit_rows: int = FIT_ROWS, split_rows: int = 512, split_fit: int = 4096):
        spark = vectors.sparkSession
        rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
        length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
        rows = rows.where(F.size("embedding") == (length[0]["n"] if length else 0))
        self.length, self.size = (length[0]["n"], length[0]["count"]) if length else (0, 0)
        u = F.shiftrightunsigned(F.xxhash64("vec_id", F.lit(seed)), 11).cast("double") * F.lit(2.0**-53)
        sample = rows.where(u < F.lit(min(1.0, fit_rows / max(1, self.size)))).orderBy("vec_id").limit(2 * fit_rows).select("embedding").toPandas()
        sample = np.array(sample.embedding.tolist(), np.float64)
        leaves = max(1, min(self.size // leaf_rows, len(sample) // 4))
        self.tree = tree = Tree.fit(sample, leaves, seed=seed)
        self.nodes = Nodes(scratch(spark, "nodes"))
        placed = written(rows.mapInArrow(lambda batches: _with_leaf(batches, tree), "vec_id long, embedding array<double>, leaf long"), "vectors")
        counts = written(placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "leaves")
        while True:
            depth = len(self.nodes.files)
            large = counts.where((F.col("n") > split_rows) & (F.shiftright("leaf", _DEPTH) == depth))
            many = large.count() if depth < 5 else 0
            if not many:
                break
            self.nodes = self._split(placed, large, depth, max(1, -(-many // 1024)), leaf_rows, split_fit)
            nodes = self.nodes
            placed = written(placed.mapInArrow(lambda batches, nodes=nodes: _deeper(batches, nodes), "vec_id long, embedding array<double>, leaf long"), "vectors")
            counts = written(placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "leaves")
        self.leaves = counts.count()
        bins = max(1, -(-self.size // BLOCK_ROWS))
        parts = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
        depth, path = F.shiftright("leaf", _DEPTH), F.col("leaf").bitwiseAND(F.lit((1 << _DEPTH) - 1))
        above = F.lit(-1) - F.shiftleft(depth - 1, _DEPTH).bitwiseOR(F.shiftright(path, 8))
        block = F.when(depth == 0, F.floor(F.col("leaf") * bins / tree.leaves)).otherwise(above)
        self.blocks = counts.select(F.col("leaf").alias("_leaf"), block.cast("long").alias("bin"), F.when(parts > 1, parts).otherwise(0).alias("_parts"))
        part = F.when(F.col("_parts") > 0, F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col("_parts")) + 1).otherwise(0).cast("int")
        self.rows = placed.join(self.blocks, F.col("leaf") == F.col("_leaf")).select("vec_id", "embedding", "leaf", "bin", part.alias("block"))

    def _split(self, placed: DataFrame, large: DataFrame, depth: int, files: int, leaf_rows: int, split_fit: int) -> Nodes:
        """Fit the children of large leaves on samples of their rows, and write them; leaves of equal vectors stay whole."""
        folder = self.nodes.folder
        u = F.shiftrightunsigned(F.xxhash64("vec_id", F.lit(f"split {depth}")), 11).cast("double") * F.lit(2.0**-53)
        sample = placed.join(large.select(F.col("leaf").alias("_leaf"), "n"), F.col("leaf") == F.col("_leaf")).where(u < F.lit(float(split_fit)) / F.col("n"))

        def fit(group: pd.DataFrame) -> pd.DataFrame:
            rows = np.array(group.embedding.tolist(), np.float64)
            distinct = np.unique(rows, axis=0)
            k = min(_CHILDREN, max(2, int(group.n.iloc[0]) // leaf_rows), len(distinct))
            centres = np.unique(_kmeans(rows, distinct, k, np.random.default_rng(0)), axis=0)
            made = [int(group.leaf.iloc[0])] if len(centres) > 1 else []  # a leaf of equal vectors stays whole
            return pd.DataFrame({"leaf": pd.Series(made, dtype="int64"), "centres": pd.Series([centres.ravel() for _ in made], dtype=object)})

        fitted = sample.select("leaf", "n", "embedding").groupBy("leaf").applyInPandas(fit, "leaf long, centres array<double>")
        dims = self.length

        def write(batches):
            found: dict[int, list] = {}
            for b in batches:
                for leaf, centres in zip(b.column("leaf").to_pylist(), b.column("centres")):
                    found.setdefault(leaf % files, []).append((leaf, centres.values.to_numpy().reshape(-1, dims)))
            for k, own in found.items():
                put_bytes(f"{folder}/{depth}-{k:06d}.nodes", _pack_nodes(own))
                yield pa.RecordBatch.from_pydict({"file": pa.array([k], pa.int64())})

        fitted.repartitionById(files, F.pmod("leaf", F.lit(files)).cast("int")).mapInArrow(write, "file long").count()
        return Nodes(folder, (*self.nodes.files, files))

    def calibrate(self, k: int, recall: float, seed: int = 1) -> int:
        """How many leaves a search visits so that ``recall`` of the true neighbours of sampled queries lie in them.

        The sample's true neighbours come from a scan of every row; each one's leaf has a place in the query's order of
        leaves, so one pass tells the recall of every possible number of visits.
        """
        sample = self.rows.orderBy(F.xxhash64("vec_id", F.lit(f"calibrate {seed}")), "vec_id").limit(CALIBRATION_QUERIES).select("vec_id", "embedding").toPandas()
        if not len(sample):
            return 1
        ids, queries = sample.vec_id.to_numpy(), np.array(sample.embedding.tolist())

        def scan(batches):
            for b in batches:
                leaf = dict(zip(b.column("vec_id").to_pylist(), b.column("leaf").to_pylist()))
                top = _top(ids, queries, b.column("vec_id").to_numpy(), _matrix(b.column("embedding")), k)
                yield pa.RecordBatch.from_pandas(top.assign(leaf=top.vec_id.map(leaf).astype("int64")), preserve_index=False)

        truth = _best(self.rows.select("vec_id", "embedding", "leaf").mapInArrow(scan, _FOUND + ", leaf long"), k).select("query_id", "leaf").toPandas()
        wanted = truth.groupby("query_id").leaf.agg(frozenset).to_dict()
        at = {int(i): {leaf: n for n, leaf in enumerate(self.tree.visit(q, self.leaves, self.nodes, wanted.get(i, frozenset((-1,)))), 1)} for i, q in zip(ids, queries)}
        recall = min(1.0, recall + 2 * math.sqrt(recall * (1 - recall) / max(1, len(truth))))  # the sample's own error
        needed = np.sort([at[q][leaf] for q, leaf in zip(truth.query_id, truth.leaf)])
        return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) if len(needed) else 1

    def search(self, queries: DataFrame, *, k: int = 10, recall: float = 0.95, visits: int | None = None) -> DataFrame:
        """query_id, rank, vec_id, score: the k nearest found by exact distance on the vectors as given.

        queries: (query_id, embedding). Each query goes to the blocks of its leaves and meets its leaves' rows alone there; a
        block gives k per query, and those meet by query. A query that still lacks neighbours, as its leaves hold too few, visits all.
        """
        tree, nodes = self.tree, self.nodes
        most = max(visits or self.calibrate(k, recall), 1)

        def seek(asked: DataFrame, most: int) -> DataFrame:
            given = asked.groupBy("query_id").agg(F.first("embedding").alias("embedding"))
            routed = given.mapInArrow(lambda batches: _routes(batches, tree, most, nodes), "query_id long, leaf long")
            routed = routed.join(self.blocks, F.col("leaf") == F.col("_leaf"))
            whole = F.col("_parts") == 0
            routed = routed.withColumn("block", F.explode(F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("_parts"))))))
            routed = routed.groupBy(F.col("query_id").alias("_q"), "bin", "block").agg(F.collect_list("leaf").alias("leaves"))
            asked = routed.join(given, F.col("_q") == F.col("query_id")).select("query_id", "bin", "block", "embedding", "leaves")

            def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
                found = [_top(np.zeros(0), [], np.zeros(0), np.zeros((0, 1)), k)]
                if len(left) and len(right):
                    ids, leaf, rows = right.vec_id.to_numpy(), right.leaf.to_numpy(), np.array(right.embedding.tolist())
                    for qid, q, leaves in zip(left.query_id.to_numpy(), left.embedding, left.leaves):
                        own = np.isin(leaf, leaves)
                        found.append(_top(np.array([qid]), [np.asarray(q)], ids[own], rows[own], k))
                return pd.concat(found)

            return _best(asked.groupBy("bin", "block").cogroup(self.rows.groupBy("bin", "block")).applyInPandas(meet, _FOUND), k)

        queries = queries.select(F.col("query_id").cast("long"), F.col("embedding").cast("array<double>")).where(usable(F.col("embedding")) & (F.size("embedding") == self.length))
        found = written(seek(queries, most), "found")
        full = found.groupBy(F.col("query_id").alias("_q")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min(k, max(0, self.size - 1)))
        short = queries.join(full, F.col("query_id") == F.col("_q"), "left_anti")
        if short.limit(1).count():
            every = seek(short, self.leaves)
            found = found.join(full, F.col("query_id") == F.col("_q"), "left_semi").unionByName(every)
        return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _routes(batches, tree: Tree, most: int, nodes: Nodes, rows: int = 65_536):
    """(query_id, leaf) of the leaves that each query visits, some ``rows`` or one query's a batch; vectors stay behind."""
    ids, leaves, n = [], [], 0

    def batch():
        at = np.repeat(np.array(ids, np.int64), [len(x) for x in leaves])
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate(leaves))], names=["query_id", "leaf"])

    for b in batches:
        for query, q in zip(b.column("query_id").to_pylist(), _matrix(b.column("embedding")) if b.num_rows else ()):
            own = np.array(tree.visit(q, most, nodes), np.int64)
            if n and n + len(own) > rows:
                yield batch()
                ids, leaves, n = [], [], 0
            ids.append(query)
            leaves.append(own)
            n += len(own)
    if n:
        yield batch()


def _with_leaf(batches, tree):
    for b in batches:
        leaf = tree.leaf_of(_matrix(b.column("embedding"))) if b.num_rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(leaf, pa.int64())], names=["vec_id", "embedding", "leaf"])


def _deeper(batches, nodes: Nodes):
    """Rows of leaves that are split go to the nearest child."""
    for b in batches:
        leaf = b.column("leaf").to_numpy().copy()
        rows = _matrix(b.column("embedding")) if b.num_rows else np.zeros((0, 1))
        for x in np.unique(leaf).tolist():
            if found := nodes.get(x):
                own = np.nonzero(leaf == x)[0]
                leaf[own] = np.array(found[1])[_nearest_centre(rows[own], found[0])]
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(leaf, pa.int64())], names=["vec_id", "embedding", "leaf"])


def neighbours(vectors: DataFrame, *, query_every: int = 100, k: int = 10, recall: float = 0.95, **index) -> DataFrame:
    """The k nearest of every row whose vec_id is divisible by ``query_every``, among all other rows.

    Null, empty, zero and non-finite vectors and null ids take no part, nor do vectors of another length than the most
    frequent one (of equally frequent ones the shorter). Rows that repeat
    an id are each a candidate for others and none for their own id. Ties go to the smaller vec_id.
    ``index`` goes to ``Index``.
    """
    index = Index(vectors, **index)
    queries = index.rows.where(F.col("vec_id") % query_every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    return index.search(queries, k=k, recall=recall)
