"""SimHash near-dedup: fingerprints of shingles, and covering LSH that finds every pair within the radius."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bits import may_hold, read_filter, write_filter
from .common import discard, filesystem, put_bytes, release, remove, scratch, written
from .components import components

BITS = 64
#: Members up to which a bucket is linked by a scan of its own; larger ones are covered again on their free bits.
SCAN_LIMIT = 4096
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK = 65_536
_SECOND = 0x9E3779B97F4A7C15
#: Texts of a candidate group that one task compares at a time; larger groups pass through in such parts.
GROUP_ROWS = 4096


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_digests(words: list[bytes], k: int) -> list[bytes]:
    """XXH64 (seed 42, big-endian) of every run of k words, joined by spaces; of the whole sequence if there are fewer."""
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= k:
        return [digest(joined, 42)] if words else []
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]


def majority(digests: list[bytes], bits: int = BITS) -> bytes:
    """The bits set in over half of the digests; all zero if there are none."""
    votes = np.zeros(bits, np.int64)
    for i in range(0, len(digests), _BLOCK):
        part = digests[i : i + _BLOCK]
        votes += np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(len(part), bits // 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(digests)).tobytes()


def shingle_fingerprint(k: int) -> Callable[[str | None], tuple[bytes, ...]]:
    """A text's 64-bit fingerprint by its k-word shingles, repeats included."""
    return lambda text: (majority(shingle_digests(words_of(text), k)),)


def word_and_shingle_fingerprints(k: int) -> Callable[[str | None], tuple[bytes, ...]]:
    """Two independent 64-bit fingerprints by words weighed by the root of their count, and one of 256 bits by k-word shingles."""

    def fingerprints(text: str | None) -> tuple[bytes, ...]:
        words = words_of(text)
        if not words:
            return (bytes(8),) * 6
        counts = Counter(words)
        base = np.frombuffer(b"".join(xxhash.xxh64_digest(w, 42) for w in counts), ">u8").astype(np.uint64)
        weight = np.sqrt(np.fromiter(counts.values(), float, len(counts)))
        both = np.unpackbits(np.stack([base, _mix(base ^ np.uint64(_SECOND))], 1).astype(">u8").view(np.uint8).reshape(len(base), 16), axis=1)
        first = np.packbits(weight @ both > weight.sum() / 2).tobytes()
        base = np.frombuffer(b"".join(shingle_digests(words, k)), ">u8").astype(np.uint64)
        votes, total = np.zeros(256, np.int64), len(base)
        for i in range(0, total, _BLOCK):
            h = base[i : i + _BLOCK]
            wide = np.stack([_mix(h + np.uint64(j * _SECOND & 0xFFFFFFFFFFFFFFFF)) for j in range(4)], 1).astype(">u8")
            votes += np.unpackbits(wide.view(np.uint8).reshape(len(h), 32), axis=1).sum(axis=0, dtype=np.int64)
        second = np.packbits(2 * votes > total).tobytes()
        return (first[:8], first[8:], *(second[i : i + 8] for i in range(0, 32, 8)))

    return fingerprints


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text as ascending 64-bit hashes; of one with fewer words, that of the whole."""
    return np.unique(np.frombuffer(b"".join(shingle_digests(words_of(text), k)), ">u8").astype(np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint_table(docs: DataFrame, of: Callable[[str | None], tuple[bytes, ...]], names: tuple[str, ...]) -> DataFrame:
    """doc_id, node (XXH64 of the text; null is empty) and the fingerprints as longs, one row per row of docs."""

    def run(batches):
        for b in batches:
            prints = [[] for _ in names]
            for text in b.column("text"):
                for out, value in zip(prints, of(text.as_py())):
                    out.append(value)
            longs = [pa.array(np.frombuffer(b"".join(p), ">i8").astype(np.int64)) for p in prints]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("node"), *longs], names=["doc_id", "node", *names])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("node"))
    return rows.mapInArrow(run, "doc_id long, node long, " + ", ".join(f"{n} long" for n in names))


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """2^(radius+1) - 1 masks over ``bits``; any ``radius`` of the bits are all outside at least one of them.

    Each bit gets a non-zero vector of radius + 1 coordinates; the mask of a non-zero v holds the bits whose vector has
    an odd product with v. ``radius`` vectors leave some v orthogonal to them all, whose mask has none of their bits.
    """
    n = (1 << (radius + 1)) - 1
    if len(bits) <= 1 << radius:  # vectors with the top coordinate set: but for one, each mask holds half of the bits
        vector = {b: 1 << radius | k * 0x9E3779B1 % (1 << radius) for k, b in enumerate(bits)}
    else:
        vector = {b: k % n + 1 for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if bin(vector[b] & v).count("1") % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))  # of signed numbers it would count the absolute value's bits


def _near(rows: list[np.ndarray], a: np.ndarray, b: np.ndarray, radius: int, most: int | None) -> np.ndarray:
    """Which of the pairs (a, b) of rows (fp, node, s0, ...) pass: fp within ``radius``, and all s together within ``most``."""
    close = _differ(rows[0][a], rows[0][b]) <= radius
    if most is not None and close.any():
        at = np.nonzero(close)[0]
        a, b = np.broadcast_to(a, close.shape)[at], np.broadcast_to(b, close.shape)[at]
        close[at] = sum(_differ(s[a], s[b]).astype(np.int64) for s in rows[2:]) <= most
    return close


def _links_of_run(rows: list[np.ndarray], radius: int, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what close pairs connect within a bucket: of each tree, its smallest node with all others.

    So the same texts give the same links in most tables.
    """
    node, k = rows[1], len(rows[0])
    ends: tuple[list, list] = ([], [])
    at, left, tree = [], np.arange(k), []
    while len(left) or at:
        if not at:
            if len(tree) > 1:
                own = node[tree]
                ends[0].append(np.full(len(own), own.min()))
                ends[1].append(own)
            at, left = [int(left[0])], left[1:]
            tree = [at[0]]
            continue
        close = _near(rows, left, np.array([at.pop()]), radius, most)
        found = left[close].tolist()
        if found:
            at.extend(found)
            tree.extend(found)
            left = left[~close]
        if not len(left):
            break
    if len(tree) > 1:
        own = node[tree]
        ends[0].append(np.full(len(own), own.min()))
        ends[1].append(own)
    if not ends[0]:
        return node[:0], node[:0]
    return np.concatenate(ends[0]), np.concatenate(ends[1])


def _link_buckets(radius: int, most: int | None, limit: int | None, extra: tuple[str, ...]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows (bucket, sub, fp, node, extra) sorted by bucket and sub: the links of each bucket; rows of buckets over ``limit`` as hot."""
    names = ["a", "b", "hot", "bucket", *extra]

    def batch(a, b, hot, bucket, *more):
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (a, b, hot, bucket, *more)], names=names)

    def hot(cols, at):
        fp, node, *more = (c[at] for c in cols[2:])
        return batch(fp, node, np.ones(len(fp), np.int64), cols[0][at], *more)

    def finish(cols, bounds):
        """The runs between bounds; those of two members at once."""
        rows, node = cols[2:], cols[3]
        size = np.diff(bounds)
        two = bounds[:-1][size == 2]
        close = _near(rows, two, two + 1, radius, most) if len(two) else np.zeros(0, bool)
        a, b = [node[two[close]]], [node[two[close] + 1]]
        for s, e in zip(bounds[:-1][size > 2].tolist(), bounds[1:][size > 2].tolist()):
            x, y = _links_of_run([c[s:e] for c in rows], radius, most)
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        pairs = np.unique(np.stack([lo, hi], 1)[lo != hi], axis=0) if len(lo) else np.zeros((0, 2), np.int64)
        zero = np.zeros(len(pairs), np.int64)
        return batch(pairs[:, 0], pairs[:, 1], zero, zero, *[zero for _ in extra])

    def run(batches):
        held, hot_key = None, None
        for rb in batches:
            cols = [rb.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "sub", "fp", "node", *extra)]
            if hot_key is not None:  # the rest of a hot bucket streams through
                same = (cols[0] == hot_key[0]) & (cols[1] == hot_key[1])
                n = len(same) if same.all() else int(np.argmin(same))
                if n:
                    yield hot(cols, slice(n))
                    cols = [c[n:] for c in cols]
                if not len(cols[0]):
                    continue
                hot_key = None
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            change = np.nonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0))[0] + 1
            bounds = np.concatenate([[0], change])
            last = int(bounds[-1])
            if limit:  # hot buckets within this batch
                ends = np.append(bounds[1:], len(cols[0]))
                for s, e in zip(bounds.tolist(), ends.tolist()):
                    if e - s > limit:
                        yield hot(cols, slice(s, e))
                keep = np.repeat(ends - bounds <= limit, ends - bounds)
                if len(cols[0]) - last > limit:
                    hot_key = (cols[0][last], cols[1][last])
                    keep_last = None
                else:
                    keep_last = [c[last:] for c in cols]
                done = [c[:last][keep[:last]] for c in cols]
            else:
                keep_last, done = [c[last:] for c in cols], [c[:last] for c in cols]
            if len(done[0]):
                change = np.nonzero((np.diff(done[0]) != 0) | (np.diff(done[1]) != 0))[0] + 1
                yield finish(done, np.concatenate([[0], change, [len(done[0])]]))
            held = keep_last
        if held is not None and len(held[0]):
            yield finish(held, np.array([0, len(held[0])]))

    return run


def covering_links(prints: DataFrame, radius: int, *, limit: int = SCAN_LIMIT, extra: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """Links (a, b) between nodes: whatever is within ``radius`` is linked or connected through links.

    prints: (fp, node) longs, no two rows alike, and ``extra`` longs; with ``most``, a pair must also differ in at most so
    many bits of those, which is tested before a link is made. Every mask gives each row a bucket; a pair within the
    radius shares one. Buckets up to ``limit`` are scanned where they lie, without all pairs leaving the task. The few
    larger ones stream through as hot and are covered again on their mask's free bits, which leaves at most 2^16
    fingerprints a bucket.
    """
    masks = covering_masks(list(range(BITS)), radius)
    keyed = F.explode(F.array(*[F.struct(F.lit(v).cast("long").alias("bucket"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("sub")) for v, m in enumerate(masks)]))
    rows = prints.select("fp", "node", *extra, keyed.alias("k")).select("k.bucket", "k.sub", "fp", "node", *extra)
    rows = rows.repartition("bucket", "sub").sortWithinPartitions("bucket", "sub", "fp", "node")
    linked = ", ".join(f"{c} long" for c in ("a", "b", "hot", "bucket", *extra))
    found = written(rows.mapInArrow(_link_buckets(radius, most, limit, extra), linked), "links")
    links = found.where("hot = 0").select("a", "b")
    if found.where("hot = 1").limit(1).count():
        free = [covering_masks([b for b in range(BITS) if not m >> b & 1], radius) for m in masks]
        names = ["bucket", "sub", "fp", "node", *extra]

        def again(batches):
            for rb in batches:
                fp, node, v, *more = (rb.column(c).to_numpy() for c in ("a", "b", "bucket", *extra))
                for mask in np.unique(v).tolist():
                    own = v == mask
                    f, n, fixed, kept = fp[own], node[own], np.int64(_signed(masks[mask])), [c[own] for c in more]
                    for w, m in enumerate(free[mask]):
                        bucket = np.full(len(f), (mask << 20) + w)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, f & (fixed | np.int64(_signed(m))), f, n, *kept)], names=names)

        hot = found.where("hot = 1").select("a", "b", "bucket", *extra).mapInArrow(again, ", ".join(f"{c} long" for c in names))
        hot = hot.repartition("bucket", "sub").sortWithinPartitions("bucket", "sub", "fp", "node")
        links = links.union(written(hot.mapInArrow(_link_buckets(radius, most, None, extra), linked), "links").select("a", "b"))
    return links.distinct()


def near_components(docs: DataFrame, *, shingle: int = 4, radius: int = 4) -> DataFrame:
    """Every document's fingerprint and the smallest doc_id that links within ``radius`` reach.

    Null and empty texts have fingerprint 0, which links like any other. Null ids are in no minimum; a component of null
    ids alone has a null id. Repeated rows are one another's copies. Copies share a fingerprint, and only distinct
    fingerprints are compared. Returns doc_id, fp (long), component_id.
    """
    table = written(fingerprint_table(docs, shingle_fingerprint(shingle), ("fp",)).drop("node"), "prints")
    prints = table.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(covering_links(prints.select("fp", F.col("fp").alias("node")), radius))
    named = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = written(named, "classes")
    ids = named.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    classes = named.join(ids, F.col("root") == F.col("_root")).select(F.col("fp").alias("_fp"), "component_id")
    return table.join(classes, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def _cosine_bits(similarity: float, bits: int, slack: float) -> int:
    """Differing bits that a Jaccard of ``similarity`` gives at most, but for one pair in many.

    A Jaccard of s between sets of a size is a cosine of 2s/(1+s), an angle a, and on average a/pi of the bits; ``slack``
    deviations more are let pass.
    """
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def _rare_lists(sets: list[np.ndarray], similarity: float) -> tuple[list[np.ndarray], dict[int, list[int]]]:
    """Of each set the rarest elements, of which it shares one with any set of that Jaccard; and the sets by such element.

    Two sets share ``similarity`` of the larger one or more, so they cannot differ in all of the first
    n - ceil(similarity n) + 1 elements of an order that is common to both: here by how many sets have an element.
    """
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    every, which, counts = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.empty(len(every), np.int64)
    place[np.lexsort((every, counts))] = np.arange(len(every))
    place, ends = place[which], np.cumsum([len(x) for x in sets])
    rare, lists = [], {}
    for k, (end, own) in enumerate(zip(ends.tolist(), sets)):
        n = len(own)
        first = np.sort(place[end - n : end])[: n - math.ceil(similarity * n - 1e-9) + 1]
        rare.append(first)
        for v in first.tolist():
            lists.setdefault(v, []).append(k)
    return rare, lists


def exact_links(nodes: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], similarity: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A forest of the pairs of a group whose sets have a Jaccard of ``similarity`` or more, and each text's tree by number.

    prints: (n, words) fingerprints by shingles. A pair must share a rare element and differ in at most ``most`` bits
    before its sets are compared. Texts without a shingle are alike. What is in a tree is not compared again.
    """
    tree, open_, at = np.full(len(nodes), -1), np.ones(len(nodes), bool), []
    sizes = np.array([len(x) for x in sets])
    rare, lists = _rare_lists(sets, similarity)
    a, b, trees, shed = [], [], -1, len(nodes) // 2
    for start in range(len(nodes)):
        if not open_[start]:
            continue
        at, trees, open_[start] = [start], trees + 1, False
        tree[start] = trees
        while at:
            i = at.pop()
            if open_.sum() < shed:  # lists forget what is in a tree
                lists, shed = {v: [k for k in own if open_[k]] for v, own in lists.items()}, shed // 2
            near = {k for v in rare[i].tolist() for k in lists.get(v, ()) if open_[k]} if sizes[i] else set(np.nonzero(open_ & (sizes == 0))[0].tolist())
            others = np.array(sorted(near), np.int64)
            others = others[np.bitwise_count(prints[others] ^ prints[i]).sum(axis=1) <= most]
            others = others[np.minimum(sizes[others], sizes[i]) >= similarity * np.maximum(sizes[others], sizes[i])]
            if not len(others):
                continue
            common = np.zeros(len(others), np.int64)
            if sizes[i]:
                flat = np.concatenate([sets[j] for j in others])
                shared = sets[i][np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)] == flat
                common = np.add.reduceat(shared.astype(np.int64), np.cumsum(sizes[others]) - sizes[others])
            found = others[common >= similarity * (sizes[others] + sizes[i] - common)]
            if len(found):
                a.append(np.full(len(found), nodes[i]))
                b.append(nodes[found])
                tree[found], open_[found] = trees, False
                at.extend(found.tolist())
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b), tree) if a else (none, none, tree)


_MEMBER = "root long, node long, fp long, fq long, s0 long, s1 long, s2 long, s3 long, shingles binary"


def verified_links(members: DataFrame, *, similarity: float, most: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) between members of a group (``root``) whose shingle sets have a Jaccard of ``similarity`` or more.

    Groups stream through their task ``group_rows`` texts at a time, the similar next to each other. Of what came
    before, one text of each tree of links goes on to the next part; where those are over half of a part, they wait as a
    group of their own for another round, in another order. So a group of any size takes bounded memory.
    """
    names = [c.split()[0] for c in _MEMBER.split(", ")]

    def link(batches):
        held, now = [], None

        def settle(rows, last):
            """Links of the rows held, and what goes on: to the next part, or to another round."""
            cols = list(zip(*rows))
            nodes, prints = np.array(cols[1], np.int64), np.array(cols[4:8], np.int64).T.copy().view(np.uint64)
            sets = [np.frombuffer(x, "<u8") for x in cols[8]]
            a, b, tree = exact_links(nodes, prints, sets, similarity, most)
            one = [rows[k] for k in np.unique(tree, return_index=True)[1].tolist()]
            late = one if not last and len(one) > group_rows // 2 or last and wait else []
            return a, b, one, late

        def batch(a, b, late):
            n = len(a)
            cols = list(zip(*late)) if late else [[]] * len(names)
            out = [pa.array(np.concatenate([x, np.array(y, np.int64)]).astype(np.int64)) for x, y in ((a, cols[1]), (b, cols[0]))]
            out += [pa.array([None] * n + list(cols[k]), pa.binary() if names[k] == "shingles" else pa.int64()) for k in range(len(names))]
            return pa.RecordBatch.from_arrays(out, names=["a", "b", *names])

        wait = False
        for rb in batches:
            for row in zip(*[rb.column(c).to_pylist() for c in names]):
                if row[0] != now or len(held) >= group_rows:
                    if held:
                        a, b, one, late = settle(held, row[0] != now)
                        yield batch(a, b, late)
                        wait = row[0] == now and (wait or bool(late))
                        held = one if row[0] == now and not late else []
                    now = row[0]
                held.append(row)
        if held:
            a, b, one, late = settle(held, True)
            yield batch(a, b, late)

    links, order, rows = None, ("fp", "fq"), members
    while True:
        sorted_ = rows.repartition("root").sortWithinPartitions("root", order[0], "node")
        found = written(sorted_.mapInArrow(link, "a long, b long, " + _MEMBER), "verified")
        new = found.where("root IS NULL").select("a", "b")
        links = new if links is None else links.union(new)
        if not found.where("root IS NOT NULL").limit(1).count() or rows is not members and not new.limit(1).count():
            return links
        rows, order = found.where("root IS NOT NULL").select(*names), order[::-1]


def near_links(docs: DataFrame, nodes: DataFrame, *, shingle: int, similarity: float, radius: int, slack: float, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links between texts of ``docs`` that share ``similarity`` of their shingles: those that fingerprints bring together.

    nodes: node, first (flag, id), fingerprints. Candidates come from a covering LSH over word fingerprints; in a bucket,
    64 bits by shingles must agree as well. What they connect are groups; in a group, 256 bits and then the shingle sets
    themselves are compared. Every link is exact, but not every pair is found: ``prefix_links`` finds the rest.
    """
    most = _cosine_bits(similarity, 64, slack)
    links = written(covering_links(nodes.select("fp", "node", "s0"), radius, extra=("s0",), most=most), "candidates")
    release(docs.sparkSession)  # the buckets' shuffle
    groups = components(links)
    discard(links)
    groups = written(groups.union(groups.select(F.col("root").alias("node"), "root").distinct()), "groups")
    groups = nodes.join(groups.select(F.col("node").alias("_n"), "root"), F.col("node") == F.col("_n"))
    groups = groups.select(*[F.col(c).alias(f"_{c}") for c in ("root", "node", "fp", "fq", "s0", "s1", "s2", "s3")], F.col("first.id").alias("_id"))
    texts = texts_of(docs, groups).select(*[c for c in groups.columns if c != "_id"], "text")

    def sets(batches):
        for b in batches:
            own = [shingle_set(t.as_py(), shingle).astype("<u8").tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(8)], pa.array(own, pa.binary())], names=[c.split()[0] for c in _MEMBER.split(", ")])

    members = written(texts.mapInArrow(sets, _MEMBER), "members").dropDuplicates(["node"])
    release(docs.sparkSession)  # the texts' shuffle
    return verified_links(members, similarity=similarity, most=_cosine_bits(similarity, 256, slack), group_rows=group_rows)


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (with _node and _id) with their texts. One document has each text: joined by id as well, so that copies of
    one text are not one task's; rows equal in id and text come as often as they are. Texts that no filter of the nodes
    lets through are not shuffled."""
    bits = write_filter(wanted, F.col("_node"))

    def asked(batches):
        held = read_filter(bits)
        for b in batches:
            yield b.filter(pa.array(may_hold(held, b.column("node").to_numpy())))

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("node")).mapInArrow(asked, "id long, text string, node long")
    return texts.join(wanted, (F.col("node") == F.col("_node")) & F.col("id").eqNullSafe(F.col("_id"))).select(*wanted.columns, "text")


# --- all pairs of a similarity, by a prefix filter ---

#: Slots in which shingles are counted, slots of a file of counts, and how often a task must see one before it tells of it.
SLOT_BITS, FILE_BITS, TOLD = 24, 20, 4
_KEY = "key long, n int, pos int, node long, root long"
_OWN = "key long, n int, pos int, node long"
_counts: dict[str, np.ndarray] = {}


def common_slots(docs: DataFrame, shingle: int) -> str:
    """A folder of how many texts have the shingles of a slot, a byte a slot by their logarithm; 2^SLOT_BITS, whatever the corpus.

    The counts only order shingles, the same for all texts, so it does not matter that rare ones are not told of, and
    that near counts are one. Tasks write the files; the driver sees their numbers alone.
    """

    def run(batches):
        seen = np.zeros(1 << SLOT_BITS, np.uint16)
        for b in batches:
            for text in b.column("text"):
                slots = np.unique((shingle_set(text.as_py(), shingle) >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
                seen[slots] = np.minimum(seen[slots], 65_534) + 1
        slots = np.nonzero(seen >= TOLD)[0]
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(seen[slots].astype(np.int64))], names=["slot", "c"])

    uri = scratch(docs.sparkSession, "slots")

    def write(batches):
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            slots, c = b.column("slot").to_numpy(), b.column("c").to_numpy()
            level = np.minimum(255, np.rint(8 * np.log2(c))).astype(np.uint8)
            for part in np.unique(slots >> FILE_BITS).tolist():
                own = slots >> FILE_BITS == part
                parts.setdefault(part, np.zeros(1 << FILE_BITS, np.uint8))[slots[own] & ((1 << FILE_BITS) - 1)] = level[own]
        for part, levels in parts.items():
            put_bytes(f"{uri}/{part}", [levels.tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64())], names=["part"])

    told = docs.select("text").mapInArrow(run, "slot long, c long").groupBy("slot").agg(F.sum("c").alias("c"))
    files = 1 << SLOT_BITS - FILE_BITS
    told.repartitionById(files, F.shiftright("slot", FILE_BITS).cast("int")).mapInArrow(write, "part long").count()
    return uri


def _common(uri: str) -> np.ndarray:
    """The bytes of all slots of such a folder, read once a worker; slots that no task told of have 0."""
    if uri not in _counts:
        fs, path = filesystem(uri)
        table = np.zeros(1 << SLOT_BITS, np.uint8)
        for part in range(1 << SLOT_BITS - FILE_BITS):
            if fs.get_file_info(f"{path}/{part}").type.name != "NotFound":
                with fs.open_input_stream(f"{path}/{part}") as f:
                    table[part << FILE_BITS : part + 1 << FILE_BITS] = np.frombuffer(f.read(), np.uint8)
        _counts.clear()
        _counts[uri] = table
    return _counts[uri]


def _slots_of(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _rarest(shingles: np.ndarray, similarity: float, c: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set by counts ``c``, in an order common to all: two sets of that Jaccard share one of them.

    They share ``similarity`` of the larger or more, so they cannot differ in all of the first n - ceil(similarity n) + 1.
    """
    n = len(shingles)
    return shingles[np.lexsort((shingles, c))[: n - math.ceil(similarity * n - 1e-9) + 1]]


def prefix_of(shingles: np.ndarray, similarity: float, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, by counts of some slots (ascending); others have 0."""
    slot = _slots_of(shingles)
    at = np.minimum(np.searchsorted(slots, slot), max(0, len(slots) - 1))
    c = np.where(slots[at] == slot, counts[at], 0) if len(slots) else np.zeros(len(slot), np.int64)
    return _rarest(shingles, similarity, c)


def _pairs_of_run(n: np.ndarray, pos: np.ndarray, root: np.ndarray, similarity: float, fan: int) -> tuple[list, list, bool]:
    """Pairs (i, j) of a key's members, ascending by n, that different trees hold and that lengths and places allow.

    Each member gets the ``fan`` such that come nearest before it; whether some were left out is told.
    """
    a, b, more = [], [], False
    lo = np.searchsorted(n, np.ceil(similarity * n - 1e-9), "left")
    for j in range(1, len(n)):
        i = np.arange(lo[j], j)
        i = i[root[i] != root[j]]
        if len(i):
            need = np.ceil(similarity / (1 + similarity) * (n[i] + n[j]) - 1e-9)
            i = i[np.minimum(n[i] - pos[i], n[j] - pos[j]) >= need]  # what is left from the key on
            more |= len(i) > fan
            i = i[-fan:]
            a.extend(i.tolist())
            b.extend([j] * len(i))
    return a, b, more


def _key_pairs(similarity: float, fan: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over key rows sorted by key and n: pairs of nodes, and the rows of keys that have more pairs than ``fan`` let through."""
    names = [c.split()[0] for c in _KEY.split(", ")]

    def batch(a, b, rest):
        count = len(a)
        cols = [pa.array(np.concatenate([x, np.zeros(len(rest[0]), np.int64)])) for x in (a, b)]
        cols.append(pa.array(np.arange(count + len(rest[0])) >= count))
        cols += [pa.array(np.concatenate([np.zeros(count, np.int64), x]).astype(np.int32 if c in ("n", "pos") else np.int64)) for c, x in zip(names, rest)]
        return pa.RecordBatch.from_arrays(cols, names=["a", "b", "more", *names])

    def finish(cols):
        key, n, pos, node, root = cols
        fresh = np.ones(len(key), bool)
        fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])  # repeated rows of one text
        key, n, pos, node, root = (c[fresh] for c in cols)
        begin = np.concatenate([[0], np.nonzero(np.diff(key))[0] + 1])
        mixed = np.minimum.reduceat(root, begin) != np.maximum.reduceat(root, begin)
        end = np.append(begin[1:], len(key))
        a, b, left = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for s, e in zip(begin[mixed].tolist(), end[mixed].tolist()):
            i, j, more = _pairs_of_run(n[s:e], pos[s:e], root[s:e], similarity, fan)
            a.append(node[s:e][i])
            b.append(node[s:e][j])
            if more:
                left.append(np.arange(s, e))
        rest = np.concatenate(left) if left else np.zeros(0, np.int64)
        a, b = np.concatenate(a), np.concatenate(b)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return batch(pairs[:, 0], pairs[:, 1], [c[rest] for c in (key, n, pos, node, root)])

    def run(batches):
        held = None
        for rb in batches:
            cols = [rb.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            change = np.nonzero(np.diff(cols[0]))[0]
            last = int(change[-1]) + 1 if len(change) else 0
            if last:
                yield finish([c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held is not None and len(held[0]):
            yield finish(held)

    return run


def _alike(similarity: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over pairs with both sets: those of a Jaccard of ``similarity`` or more."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb")):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([b.column("ra"), b.column("rb")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _keys(common: str, shingle: int, similarity: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over texts with their node: a row for each key of each; of equal texts in a task the first counts."""

    def run(batches):
        levels = _common(common)
        seen: set[int] = set()
        for b in batches:
            nodes, sets = [], []
            for node, text in zip(b.column("node").to_pylist(), b.column("text")):
                if node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(shingle_set(text.as_py(), shingle))
            parts = [_rarest(h, similarity, levels[_slots_of(h)]) if len(h) else h for h in sets]
            sizes = np.array([len(p) for p in parts], np.int64)
            keys = np.concatenate(parts).view(np.int64) if len(parts) else np.zeros(0, np.int64)
            n = np.repeat(np.array([len(h) for h in sets], np.int32), sizes)
            pos = (np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, n, pos, np.repeat(np.array(nodes, np.int64), sizes))], names=[c.split()[0] for c in _OWN.split(", ")])

    return run


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over key rows sorted by key and node: those of keys that two texts or more have, each text once."""
    names = [c.split()[0] for c in _OWN.split(", ")]
    held, after = None, None  # the last row so far, unless it has gone out; the last key that went out
    for rb in batches:
        cols = [rb.column(c).to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        key, node = cols[0], cols[3]
        if not len(key):
            continue
        fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        cols = [c[fresh] for c in cols]
        key = cols[0]
        same = key[1:] == key[:-1]
        keep = np.append(False, same) | np.append(same, False)
        if after is not None:
            keep |= key == after
        keep[-1] = False  # it waits for what comes next
        out = [c[keep] for c in cols]
        if len(out[0]):
            after = out[0][-1]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)
        held = [c[-1:] for c in cols]
    if held is not None and after is not None and held[0][0] == after:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=names)


def prefix_links(docs: DataFrame, trees: DataFrame, *, shingle: int, similarity: float, fan: int = 64) -> DataFrame:
    """Links (a, b) between trees of which some texts share ``similarity`` of their shingles; none is lost.

    trees: node, id (of one document with that text), root. Every text is keyed by its rarest shingles, of which any two
    similar texts share one; texts of different trees that share a key, and whose lengths and places of the key allow
    the similarity, are compared whole. A text meets ``fan`` others a key; then trees are joined, and keys that had more
    pairs go into another round with eight times as many, until none has.
    """
    spark = docs.sparkSession
    common = common_slots(docs, shingle)
    texts = docs.select("text", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("node"))
    keys = texts.mapInArrow(_keys(common, shingle, similarity), _OWN).repartition("key").sortWithinPartitions("key", "node")
    keys = written(keys.mapInArrow(_shared, _OWN), "keys")
    release(spark)  # the keys' shuffle
    remove(common)
    own = [c.split()[0] for c in _OWN.split(", ")]
    rows = keys.join(trees.select(F.col("node").alias("_n"), "root"), F.col("node") == F.col("_n")).select(*own, "root")
    links, made = None, [keys]
    while True:
        sorted_ = rows.repartition("key").sortWithinPartitions("key", "n", "node")
        found = written(sorted_.mapInArrow(_key_pairs(similarity, fan), "a long, b long, more boolean, " + _KEY), "pairs")
        made.append(found)
        new = written(_verified(docs, trees, found.where("NOT more").select("a", "b").distinct(), shingle, similarity), "alike")
        release(spark)
        links = new if links is None else links.union(new)
        if not found.where("more").limit(1).count():
            for t in made:
                discard(t)
            return links
        merged = components(links).withColumnsRenamed({"node": "_n", "root": "_to"})
        left = found.where("more").select(*own, "root")
        rows = left.join(merged, F.col("root") == F.col("_n"), "left").withColumn("root", F.coalesce("_to", "root")).select(*own, "root")
        fan *= 8


def _verified(docs: DataFrame, trees: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The roots (a, b) of pairs whose sets have the similarity; sets are made of the texts that pairs name."""
    pairs = written(pairs, "candidates")
    ends = pairs.select(F.col("a").alias("_e")).union(pairs.select("b")).distinct()
    wanted = trees.join(ends, F.col("node") == F.col("_e")).select(F.col("node").alias("_node"), F.col("id").alias("_id"), F.col("root").alias("_root"))

    def sets(batches):
        for b in batches:
            own = [shingle_set(t.as_py(), shingle).astype("<u8").tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("_node"), b.column("_root"), pa.array(own, pa.binary())], names=["node", "root", "shingles"])

    own = written(texts_of(docs, wanted).mapInArrow(sets, "node long, root long, shingles binary"), "sets").dropDuplicates(["node"])
    side = lambda n: own.select(F.col("node").alias(f"n{n}"), F.col("root").alias(f"r{n}"), F.col("shingles").alias(f"s{n}"))
    both = pairs.join(side("a"), F.col("a") == F.col("na")).join(side("b"), F.col("b") == F.col("nb")).select("ra", "rb", "sa", "sb")
    return both.mapInArrow(_alike(similarity), "a long, b long").distinct()


def keep_one_of_each(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, radius: int = 4, slack: float = 3.0, group_rows: int = GROUP_ROWS, fan: int = 64) -> DataFrame:
    """The documents without near copies: of each group the one with the smallest id stays, in all its columns.

    Groups are what links connect; a link is any pair of texts whose sets of ``shingle``-word shingles have a Jaccard
    similarity of ``similarity`` or more. Fingerprints and a covering LSH of ``radius`` bits link most of them, so that a
    large group is one tree; then a prefix filter over all texts finds what links trees, exactly. Equal texts (null is
    empty) are one node, and texts without a word are alike; null ids come after all others, and of rows equal in id and
    text one stays. An empty table gives an empty one.
    """
    names = ("fp", "fq", "s0", "s1", "s2", "s3")
    table = written(fingerprint_table(docs, word_and_shingle_fingerprints(shingle), names), "prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    nodes = written(table.groupBy("node").agg(first.alias("first"), *[F.first(c).alias(c) for c in names]), "nodes")
    discard(table)
    roots = components(near_links(docs, nodes, shingle=shingle, similarity=similarity, radius=radius, slack=slack, group_rows=group_rows))
    trees = nodes.select("node", "first").join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    trees = written(trees.select("node", "first", F.col("first.id").alias("id"), F.coalesce("root", "node").alias("root")), "trees")
    release(docs.sparkSession)
    joined = components(prefix_links(docs, trees, shingle=shingle, similarity=similarity, fan=fan)).withColumnsRenamed({"node": "_tree", "root": "_to"})
    named = trees.join(joined, F.col("root") == F.col("_tree"), "left")
    keep = named.groupBy(F.coalesce("_to", "root").alias("root")).agg(F.min(F.struct("first", "node")).alias("k"))
    keep = keep.select(F.col("k.node").alias("_keep_node"), F.col("k.first.id").alias("_keep_id"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), docs["doc_id"].cast("long").alias("_row_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("_row_node"))
    kept = rows.join(keep, (F.col("_row_node") == F.col("_keep_node")) & F.col("_row_id").eqNullSafe(F.col("_keep_id")))
    return kept.dropDuplicates(["_row_node", "_row_id"]).select("_row.*")
