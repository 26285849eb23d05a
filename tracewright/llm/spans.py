"""Substring dedup: sliding spans of consecutive sentences, of which only the first in the corpus stays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blobs import PIECES, bucket, by_part, pieces, runs, unsqueeze
from .common import release, small_batches, written

#: A span has RUN sentences and WORDS words or more; what is taken away together has TOGETHER words or more.
RUN, WORDS, TOGETHER = 3, 18, 40
#: Words that a sentence has at most. Longer ones are cut after each word whose hash is the least of the _NEAR words on
#: either side, and what is longer still after every word. Cuts are made by content alone, so both copies of a passage
#: have the same ones but near its edges, wherever it begins and ends.
_LONGEST, _NEAR = 12, 3
#: Characters that a worker cuts at a time; characters of text for a bucket of spans.
STEP_CHARS, BUCKET_CHARS = 500_000, 16_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64

#: Fixed values. White space; marks that end a sentence; signs that do not count at a word's end; closing quotes and
#: brackets that may follow an end; marks set without spaces; scripts written so, of which each character is a word.
_SPACES = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0                　"
_ENDS = ".!?…。！？．｡।॥؟۔።"
_SIGNS = ",;:，、；：､،؛"
_CLOSERS = "\"')]}»”’」』）"
_WIDE = "。！？．｡，、；：､"
_UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
_SPACE, _LINE, _END, _SIGN, _CLOSER, _OWN = 1, 2, 4, 8, 16, 32


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower case where that is one character, and its kinds."""
    fold = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x1E944):  # no letter beyond has another case
        low = chr(c).lower()
        fold[c] = ord(low[0])
    kind = np.zeros(0x110000, np.uint8)
    for chars, bit in ((_SPACES, _SPACE), ("\n\r\x0b\x0c\x85  ", _LINE), (_ENDS, _END), (_SIGNS + _ENDS, _SIGN), (_CLOSERS, _CLOSER)):
        for c in chars:
            kind[ord(c)] |= bit
    for a, b in (*_UNSPACED, *((ord(c), ord(c)) for c in _WIDE)):
        kind[a : b + 1] |= _OWN
    return fold, kind


_made: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int, base: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), base, np.uint64), dtype=np.uint64)])[:n]


def _hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Mixed polynomial hashes of ranges of values, modulo 2^64; of over 255 values, where such collide by construction, XXH64."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + _U(1)) * _powers(n, _BASE), out=sums[1:])
    h = (sums[stop] - sums[start]) * _powers(n + 1, _INVERSE)[start]
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9) + (stop - start).astype(np.uint64)
    h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
    h ^= h >> _U(32)
    for i in np.nonzero(stop - start > 255)[0].tolist():
        h[i] = xxhash.xxh64_intdigest(values[start[i] : stop[i]].astype("<u8").tobytes(), 42)
    return h


@dataclass
class Cut:
    """The sentences of some texts, one after the other: where each begins and ends in its text, words, hash; and of each text how many."""

    begin: np.ndarray
    end: np.ndarray
    words: np.ndarray
    hash: np.ndarray
    counts: np.ndarray


def cut_texts(texts: list[str]) -> Cut:
    """The sentences of whole texts: up to a mark that ends one, or a line's end; longer ones cut further by content."""
    if not _made:
        _made.append(_tables())
    fold, kinds = _made[0]
    sizes = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = kinds[chars]
    gap, own = (kind & _SPACE) > 0, (kind & _OWN) > 0
    before = np.concatenate([[True], gap[:-1]])
    start = np.nonzero(~gap & (before | own | np.concatenate([[False], own[:-1]])))[0]
    last = np.nonzero(~gap & (np.concatenate([gap[1:], [True]]) | own | np.concatenate([own[1:], [False]])))[0]
    place = np.arange(len(chars))
    letter = np.maximum.accumulate(np.where((kind & (_SIGN | _CLOSER)) == 0, place, -1))[last]
    h = _hashes(fold[chars], start, np.where(letter >= start, letter, last) + 1)  # signs at its end do not count
    closing = np.maximum.accumulate(np.where((kind & _CLOSER) == 0, place, -1))[last]
    lines = np.cumsum((kind & _LINE) > 0)
    n = len(start)
    ends = (kind[np.where(closing >= start, closing, last)] & _END) > 0
    if n:
        ends[:-1] |= lines[start[1:]] > lines[last[:-1]]
        ends[-1] = True
    ends = _shorten(h, ends)
    tail = np.nonzero(ends)[0]
    head = np.concatenate([[0], tail[:-1] + 1]) if len(tail) else tail
    offset = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.searchsorted(offset, start[head], side="right") - 1
    return Cut(start[head] - offset[text], last[tail] + 1 - offset[text], tail + 1 - head, _hashes(h, head, tail + 1), np.bincount(text, minlength=len(texts)))


def _shorten(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of sentences with those that content gives to sentences of over _LONGEST words."""
    if not len(h):
        return ends
    which = np.cumsum(np.concatenate([[0], ends[:-1]])).astype(np.int64)
    long = (np.bincount(which) > _LONGEST)[which]
    least = long.copy()
    for k in range(1, _NEAR + 1):
        same = which[k:] == which[:-k]
        least[k:] &= ~same | (h[k:] < h[:-k])
        least[:-k] &= ~same | (h[:-k] <= h[k:])
    ends = ends | least
    which = np.cumsum(np.concatenate([[0], ends[:-1]])).astype(np.int64)
    return ends | (np.bincount(which) > _LONGEST)[which]


def sentences(text: str) -> list[tuple[int, int]]:
    """Where each sentence of a whole text begins and ends, without the white space between them."""
    cut = cut_texts([text])
    return list(zip(cut.begin.tolist(), cut.end.tolist()))


def spans_of(cut: Cut, run: int, words: int) -> tuple[np.ndarray, ...]:
    """(hash, text number, first sentence, end sentence) of every shortest run of ``run`` sentences and ``words`` words or more."""
    n = len(cut.hash)
    doc = np.repeat(np.arange(len(cut.counts)), cut.counts)
    begins = np.repeat(np.cumsum(cut.counts) - cut.counts, cut.counts)
    ends = begins + np.repeat(cut.counts, cut.counts)
    total = np.concatenate([[0], np.cumsum(cut.words)])
    first = np.arange(n)
    end = np.maximum(first + run, np.searchsorted(total, total[first] + words, side="left"))
    inside = end <= ends
    first, end, doc, begins = first[inside], end[inside], doc[inside], begins[inside]
    return _hashes(cut.hash, first, end), doc, first - begins, end - begins


def _steps(batches, *columns: str) -> Iterator[tuple[list, list[pa.Array]]]:
    """Texts of Arrow batches a bounded number of characters at a time, with other columns."""
    for b in batches:
        texts, at = b.column("text"), 0
        while at < b.num_rows:
            own, size, begin = [], 0, at
            while at < b.num_rows and (not own or size < STEP_CHARS):
                own.append(texts[at].as_py())
                size += len(own[-1] or "")
                at += 1
            yield own, [b.column(c).slice(begin, len(own)) for c in columns]


_FLIP = _U(1 << 63)
_MARKS = "doc_id long, node long, lo int, hi int"


@dataclass
class Keyed:
    """rows: doc_id, text and node, which tells texts of one id apart (0 where no id has two texts); chars: of all texts."""

    rows: DataFrame
    twice: bool
    chars: int


def keyed_texts(docs: DataFrame) -> Keyed:
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("h"), F.length(text).cast("long").alias("n"))
    ids = ids.groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.sum("n").alias("n"))
    twice, chars = ids.agg(F.count_if(F.col("a") != F.col("b")), F.sum("n")).first()
    node = F.xxhash64(text) if twice else F.lit(0).cast("long")
    return Keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", node.alias("node")), bool(twice), chars or 0)


def repeated_spans(keyed: Keyed, *, run: int = RUN, words: int = WORDS) -> DataFrame:
    """(doc_id, node, lo, hi): the sentence spans that are not the first of their kind in the corpus.

    First is the smallest (doc_id, node, position), null ids before all. Spans travel in pieces, by ranges of their
    hashes. What a step of documents already settles among its own spans is passed on under spread buckets, so a passage
    in a third of all documents sends one span a step to one task. Rows equal in id and text are one document.
    """
    docs = keyed.rows
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-keyed.chars // BUCKET_CHARS))

    def emit(batches):
        for texts, (ids, nodes) in _steps(batches, "doc_id", "node"):
            known = ids.fill_null(0).to_numpy().view(np.uint64) ^ _FLIP  # in the order of the ids
            some = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint64)
            node = nodes.to_numpy().view(np.uint64) ^ _FLIP
            h, doc, lo, hi = spans_of(cut_texts([t or "" for t in texts]), run, words)
            order = np.lexsort((lo, node[doc], known[doc], some[doc], h))
            h, doc, lo, hi = h[order], doc[order], lo[order], hi[order]
            again = np.concatenate([[False], h[1:] == h[:-1]]) if len(h) else np.zeros(0, bool)
            first = np.maximum.accumulate(np.where(again, 0, np.arange(len(h)))) if len(h) else doc
            same = (known[doc] == known[doc[first]]) & (some[doc] == some[doc[first]]) & (node[doc] == node[doc[first]]) & (lo == lo[first])
            new, settled = ~again, again & ~same
            spread = (h ^ ((known[doc] + lo.astype(np.uint64)) * _U(0x9E3779B97F4A7C15)))[settled]
            for rows, where, flag in ((new, bucket(h[new], buckets), 0), (settled, bucket(spread, buckets), 1)):
                own = np.nonzero(rows)[0]
                if len(own):
                    own = own[np.argsort(where, kind="stable")]
                    d = doc[own]
                    yield pieces(np.sort(where), h[own], some[d], known[d], node[d], lo[own].astype(np.uint64), (hi - lo)[own].astype(np.uint64), np.full(len(own), flag, np.uint64))

    def pick(batches):
        for _, held in by_part(batches):
            cols = [np.concatenate(x) for x in zip(*[unsqueeze(data, 7) for data in held])]
            held.clear()
            settled = cols[6] > 0
            order = np.lexsort((cols[4], cols[3], cols[2], cols[1], cols[0]))
            order = np.concatenate([order[~settled[order]], np.nonzero(settled)[0]])
            h, some, known, node, lo, size, settled = (c[order] for c in cols)
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (settled[1:] > 0)])
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            mark = (settled > 0) | (some != some[first]) | (known != known[first]) | (node != node[first]) | (lo != lo[first])
            some, known, node, lo, size = (c[mark] for c in (some, known, node, lo, size))
            ids = pa.array((known ^ _FLIP).view(np.int64), mask=some == 0)
            yield pa.RecordBatch.from_arrays([ids, pa.array((node ^ _FLIP).view(np.int64)), pa.array(lo.astype(np.int32)), pa.array((lo + size).astype(np.int32))], names=["doc_id", "node", "lo", "hi"])

    return docs.mapInArrow(emit, PIECES).repartitionById(buckets, "part").sortWithinPartitions("part").mapInArrow(pick, _MARKS)


def _gone(lo: np.ndarray, hi: np.ndarray, words: np.ndarray, together: int) -> np.ndarray:
    """Which sentences of a text its spans cover, in stretches of ``together`` words or more."""
    n = len(words)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, lo, 1)
    np.add.at(cover, hi, -1)
    cover = np.cumsum(cover)[:-1] > 0
    which = np.cumsum(np.concatenate([[0], np.diff(cover) != 0]))[:n]
    return cover & (np.bincount(which, words, minlength=1)[which] >= together)


def remove_repeats(docs: DataFrame, *, run: int = RUN, words: int = WORDS, together: int = TOGETHER) -> DataFrame:
    """``docs`` with the text cleaned, and n_sentences, n_removed: sentences in any non-first repeated span are gone.

    A span is the shortest run of consecutive sentences with ``run`` sentences and ``words`` words or more from each
    sentence on; texts with less have none and stay. Repeated spans that touch are one stretch, and one of fewer than
    ``together`` words stays. Sentences compare in lower case without signs at the ends of words. White space before a
    removed sentence goes with it. Null texts stay null with no sentences; repeated rows get equal results. All columns
    of ``docs`` are kept, whatever their names; those named n_sentences or n_removed are replaced.
    """
    small_batches(docs.sparkSession)
    keyed = keyed_texts(docs)
    marks = repeated_spans(keyed, run=run, words=words)
    marks = marks.groupBy("doc_id", "node").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    marks = written(marks, "marks").select(F.struct("doc_id", "node").alias("key"), "spans")
    release(docs.sparkSession)  # the spans' shuffle, before the texts' own
    cols = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    node = F.xxhash64(F.coalesce(docs["text"], F.lit(""))) if keyed.twice else F.lit(0).cast("long")
    rows = docs.select(F.struct(*[docs[c] for c in cols]).alias("row"), docs["doc_id"].cast("long").alias("id"), node.alias("node"))
    rows = rows.join(marks, rows["id"].eqNullSafe(marks["key.doc_id"]) & (rows["node"] == marks["key.node"]), "left")

    def clean(batches):
        for batch in batches:
            row, spans = batch.column("row"), batch.column("spans")
            row = pa.RecordBatch.from_arrays(row.flatten(), names=cols)
            out, total, removed, at = [], [], [], 0
            for texts, (own,) in _steps([pa.RecordBatch.from_arrays([row.column("text"), spans], names=["text", "spans"])], "spans"):
                cut = cut_texts([t or "" for t in texts])
                ends = np.cumsum(cut.counts)
                for k, text in enumerate(texts):
                    gone = 0
                    if own[k].is_valid:
                        s = slice(int(ends[k] - cut.counts[k]), int(ends[k]))
                        lo, hi = (own[k].values.field(c).to_numpy() for c in ("lo", "hi"))
                        drop = _gone(lo, hi, cut.words[s], together)
                        gone = int(drop.sum())
                        if gone:
                            text = _without(text, cut.end[s], drop)
                    out.append(text)
                    total.append(int(cut.counts[k]))
                    removed.append(gone)
            new = {"text": pa.array(out, pa.string()), "n_sentences": pa.array(total, pa.int32()), "n_removed": pa.array(removed, pa.int32())}
            names = [*cols, "n_sentences", "n_removed"]
            yield pa.RecordBatch.from_arrays([new[c] if c in new else row.column(c) for c in names], names=names)

    kinds = {f.name: f.dataType for f in docs.schema.fields}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in cols] + [T.StructField(c, T.IntegerType()) for c in ("n_sentences", "n_removed")])
    return rows.select("row", "spans").mapInArrow(clean, schema)


def _without(text: str, end: np.ndarray, drop: np.ndarray) -> str:
    """A text without some of its sentences and the white space before them."""
    kept, at = [], 0
    for gone, s, e in runs(drop):
        to = int(end[e - 1])
        if not gone:
            kept.append(text[at:to])
        at = to
    kept.append(text[at:])
    return "".join(kept).strip()
