"""LM scoring: an n-gram trie of Elias-Fano levels in memory-mapped files, with quantised smoothed probabilities.

Level 1 holds the words: the sorted hashes of their bytes and the running sums of their counts, in files by hash range. A
word's number is its place there, from 1; 0 is no word. Levels 2 and 3 are one trie of the trigrams, cut into part files
by ranges of keys (w1, w2, w3). In a part, ``heads`` are the first words, ``second`` and ``third`` the continuations,
each range made monotone by adding the last value of the range before; ``ptr1`` and ``ptr2`` are the monotone pointers to
the ranges. Probabilities are 8-bit codes with a codebook for each array of a part.

A key's place x in [0, training tokens) is that of arithmetic coding under unigrams; part = floor(x / part_tokens). So
any worker finds a key's part by arithmetic, a hot context is cut by its next words, and no directory of parts exists.
Contexts that a cut goes through are summed over their parts and kept, with their whole sums, in each of them.
"""

from __future__ import annotations

import mmap
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import PIECES, bucket, by_part, first_hash, pieces, runs, squeeze, unsqueeze
from .common import discard, filesystem, id_crc, put_bytes, release, remove, scratch, written

#: Bytes of text that a worker takes at a time; training tokens of a part file; rows that a merge holds before it sums.
STEP_BYTES, PART_TOKENS, HELD_ROWS = 4_000_000, 1_000_000, 3_000_000
#: Bytes beyond which a word is hashed on its own.
LONG_WORD = 255
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_END = np.uint64(0xE17A1465F0C0FFEE)
_U = np.uint64


# --- words ---

_power_cache: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """The first n powers of base modulo 2^64; the longest asked for so far is kept, up to a few steps' size."""
    found = _power_cache.get(base)
    if found is None or len(found) < n:
        found = np.ones(max(n, 1), np.uint64)
        np.cumprod(np.full(max(n - 1, 0), base, np.uint64), out=found[1:])
        if n <= 2 * STEP_BYTES:
            _power_cache[base] = found
    return found[:n]


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, each text's closed by the end token; and the tokens of each text.

    A word's hash is a polynomial in its bytes modulo 2^64, taken from prefix sums over the whole buffer, then mixed; words
    of over LONG_WORD bytes, where such polynomials collide by construction, have XXH64 instead.
    """
    raw = np.frombuffer((b"\n".join(texts) + b"\n").translate(_LOWER), np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[1], space.astype(np.int8), [1]]))
    start, stop = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + _U(1)) * _powers(len(raw), _ODD), out=sums[1:])
    h = (sums[stop] - sums[start]) * _powers(len(raw), _INVERSE)[start]
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9) + (stop - start).astype(np.uint64)
    h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
    h ^= h >> _U(32)
    for i in np.nonzero(stop - start > LONG_WORD)[0].tolist():
        h[i] = xxhash.xxh64_intdigest(raw[start[i] : stop[i]].tobytes(), 42)
    ends = np.cumsum([len(t) + 1 for t in texts])
    words = np.searchsorted(start, ends) if len(texts) else np.zeros(0, np.int64)
    return np.insert(h, words, _END), np.diff(np.concatenate([[0], words])) + 1


# --- Elias-Fano ---


def _pack_low(values: np.ndarray, low: int) -> bytes:
    """The low bits of each value, one after the other from the least bit on."""
    out = []
    for at in range(0, len(values), 1 << 16):  # a whole number of bytes each
        bits = np.unpackbits(values[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out.append(np.packbits(bits[:, :low].ravel(), bitorder="little").tobytes())
    return b"".join(out) + bytes(8)


def encode_monotone(values: np.ndarray) -> list[bytes]:
    """An ascending sequence: header (count, low bits, words of the high part), low parts bit by bit, high parts as unary
    gaps in a bit vector, and the ones before each word of 64 bits, by which places are selected."""
    v, n = values.astype(np.uint64), len(values)
    low = min(56, max(0, (int(v[-1]) // n).bit_length() - 1)) if n else 0
    high = (v >> _U(low)).astype(np.int64)
    bits = np.zeros(-(-((int(high[-1]) if n else 0) + n + 1) // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view("<u8")
    ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
    ranks = np.concatenate([[0], ones[:-1]]).astype("<u4")
    lows = _pack_low(v, low) if low else bytes(8)
    return [np.array([n, low, len(words), len(lows) + -len(lows) % 8], "<u8").tobytes(), lows, bytes(-len(lows) % 8), words.tobytes(), ranks.tobytes(), bytes(-len(ranks) * 4 % 8)]


_FIFTHS, _THIRDS, _NIBBLES, _BYTES, _TOPS = (_U(x * 0x0101010101010101) for x in (0x55, 0x33, 0x0F, 0x01, 0x80))
#: By 8 x byte + r: the place of the byte's r-th one.
_IN_BYTE = np.array([([k for k in range(8) if b >> k & 1] + [0] * 8)[r] for b in range(256) for r in range(8)], np.int64)


def _select_in_word(w: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th one of each word: the byte by running sums of ones, then by table."""
    x = w - ((w >> _U(1)) & _FIFTHS)
    x = (x & _THIRDS) + ((x >> _U(2)) & _THIRDS)
    sums = ((x + (x >> _U(4))) & _NIBBLES) * _BYTES  # byte k: ones in bytes 0 to k
    r = r.astype(np.uint64)
    shift = np.bitwise_count(((r * _BYTES) | _TOPS) - sums & _TOPS).astype(np.uint64) * _U(8)
    r = r - (((sums << _U(8)) >> shift) & _U(255))
    return shift.astype(np.int64) + _IN_BYTE[(((w >> shift) & _U(255)) * _U(8) + r).astype(np.int64)]


def _ones_below(w: np.ndarray) -> np.ndarray:
    """Place of each word's least one; 64 where there is none."""
    return np.bitwise_count(~w & (w - _U(1))).astype(np.int64)


class Monotone:
    """An ascending sequence in a mapped file. Nothing is decoded but what is asked for."""

    def __init__(self, view: memoryview):
        n, low, words, lows = np.frombuffer(view[:32], "<u8").astype(np.int64).tolist()
        self.size, self.low_bits = n, low
        self.lows = np.ndarray((max(1, lows - 7),), "<u8", view[32 : 32 + lows], strides=(1,))
        at = 32 + lows
        self.words = np.frombuffer(view[at : at + 8 * words], "<u8")
        at += 8 * words
        self.ranks = np.frombuffer(view[at : at + 4 * words], "<u4")
        self.bytes = at + 4 * words + -4 * words % 8
        self.highest = 64 * words - n - 1  # highs beyond this have no zero of their own

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        bit = i * self.low_bits
        return (self.lows[bit >> 3] >> (bit & 7).astype(np.uint64)) & _U((1 << self.low_bits) - 1)

    def _one(self, i: np.ndarray) -> np.ndarray:
        """Bit places of the i-th ones of the high part."""
        k = np.searchsorted(self.ranks, i.astype(np.uint32), side="right") - 1
        return 64 * k + _select_in_word(self.words[k], i - self.ranks[k])

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at places."""
        if not len(i):
            return np.zeros(0, np.uint64)
        return ((self._one(i) - i).astype(np.uint64) << _U(self.low_bits)) | self._low(i)

    def range(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at places and the next ones; the next one's bit is mostly in the same word."""
        if not len(i):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = self._one(i)
        step = _ones_below((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & ~_U(1))
        following = at + step
        far = np.nonzero(step == 64)[0]
        following[far] = self._one(i[far] + 1)
        lo = ((at - i).astype(np.uint64) << _U(self.low_bits)) | self._low(i)
        hi = ((following - i - 1).astype(np.uint64) << _U(self.low_bits)) | self._low(i + 1)
        return lo.astype(np.int64), hi.astype(np.int64)

    def _zero(self, j: np.ndarray) -> np.ndarray:
        """Bit places of the j-th zeros of the high part; -1 for j = -1."""
        zeros = 64 * np.arange(len(self.ranks)) - self.ranks
        k = np.maximum(np.searchsorted(zeros, j, side="right") - 1, 0)
        return np.where(j < 0, -1, 64 * k + _select_in_word(~self.words[k], np.maximum(j - zeros[k], 0)))

    def _run(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the successors of values, the end of the run of equal high parts, and the values' low parts."""
        high = np.minimum(values >> _U(self.low_bits), _U(self.highest)).astype(np.int64)
        first = self._zero(high - 1) + 1  # where the ones of this high part begin
        ones = _ones_below(~(self.words[first >> 6] >> (first & 63).astype(np.uint64)))
        far = np.nonzero(ones + (first & 63) >= 64)[0]
        ones[far] = self._zero(high[far]) - first[far]
        at = first - high
        end = at + ones
        low = values & _U((1 << self.low_bits) - 1) if self.low_bits else np.zeros(len(values), np.uint64)
        lo, hi = at, end.copy()
        rows = np.nonzero(lo < hi)[0]
        while len(rows):
            mid = (lo[rows] + hi[rows]) >> 1
            less = self._low(mid) < low[rows]
            lo[rows[less]] = mid[less] + 1
            hi[rows[~less]] = mid[~less]
            rows = rows[lo[rows] < hi[rows]]
        return lo, end, low

    def successor(self, values: np.ndarray) -> np.ndarray:
        """Places of the first entries not below values; size if there are none."""
        if not self.size or not len(values):
            return np.zeros(len(values), np.int64)
        beyond = (values >> _U(self.low_bits)) > _U(self.highest)
        return np.where(beyond, self.size, self._run(values)[0])

    def find(self, values: np.ndarray) -> np.ndarray:
        """Places of values; -1 for those that are not there. Entries must not repeat."""
        if not self.size or not len(values):
            return np.full(len(values), -1, np.int64)
        at, end, low = self._run(values)
        ok = (at < end) & ((values >> _U(self.low_bits)) <= _U(self.highest))
        ok[ok] = self._low(at[ok]) == low[ok]
        return np.where(ok, at, -1)


# --- files ---


def encode_codes(values: np.ndarray) -> list[bytes]:
    """Probabilities as 8-bit codes of equal steps of the logarithm; a code stands for the mean of what it holds."""
    code, book = np.zeros(len(values), np.uint8), np.zeros(256, "<f8")
    if len(values):
        log = np.log(np.maximum(values, 1e-30))
        low, width = log.min(), max(log.max() - log.min(), 1e-9)
        code = np.minimum((log - low) * (256 / width), 255).astype(np.uint8)
        n = np.bincount(code, minlength=256)
        book = np.bincount(code, values, minlength=256) / np.maximum(n, 1)
    return [np.array([len(values)], "<u8").tobytes(), book.astype("<f8").tobytes(), code.tobytes(), bytes(-len(code) % 8)]


class Codes:
    def __init__(self, view: memoryview):
        n = int(np.frombuffer(view[:8], "<u8")[0])
        self.book, self.code = np.frombuffer(view[8:2056], "<f8"), np.frombuffer(view[2056 : 2056 + n], np.uint8)
        self.bytes = 2056 + n + -n % 8

    def get(self, i: np.ndarray) -> np.ndarray:
        return self.book[self.code[i]]


class Mapped:
    """A mapped file of sequences and codes, in the order of ``kinds``. What this machine cannot map in place is fetched
    once, into a file that is unlinked while it is mapped; the shared one stays the only copy that counts."""

    def __init__(self, uri: str, kinds: dict[str, type]):
        fs, path = filesystem(uri)
        if fs.type_name == "local":
            with open(path, "rb") as f:
                self.map = mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ)
        else:
            with tempfile.TemporaryFile() as f, fs.open_input_stream(path) as source:
                while chunk := source.read(1 << 22):
                    f.write(chunk)
                f.flush()
                self.map = mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ)
        view, at = memoryview(self.map), 0
        for name, kind in kinds.items():
            setattr(self, name, found := kind(view[at:]))
            at += found.bytes


_WORDS = {"words": Monotone, "sums": Monotone}
_GRAMS = {"heads": Monotone, "ptr1": Monotone, "second": Monotone, "ptr2": Monotone, "third": Monotone, "back1": Codes, "prob2": Codes, "back2": Codes, "prob3": Codes}
_maps: dict[str, Mapped] = {}


def _mapped(uri: str, kinds: dict[str, type]) -> Mapped:
    """This worker's map of a file."""
    if uri not in _maps:
        if len(_maps) > 8192:
            _maps.clear()
        _maps[uri] = Mapped(uri, kinds)
    return _maps[uri]


# --- the first level ---


@dataclass(frozen=True)
class Words:
    """The word files: their folder, and for each the words and tokens before it."""

    folder: str
    bases: np.ndarray
    cums: np.ndarray
    tokens: int
    size: int
    discount: float

    def _file(self, k: int) -> Mapped:
        return _mapped(f"{self.folder}/words-{k:06d}.eft", _WORDS)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, tokens before, count) of ascending hashes; 0s for unknown words."""
        number, cum, n = (np.zeros(len(hashes), np.int64) for _ in range(3))
        files = len(self.bases)
        for k, s, e in runs(bucket(hashes, files)):
            f = self._file(k)
            at = f.words.find(hashes[s:e] - first_hash(k, files))
            rows, at = s + np.nonzero(at >= 0)[0], at[at >= 0]
            number[rows] = at + self.bases[k] + 1
            cum[rows], n[rows] = self._sums(f, k, at)
        return number, cum, n

    def _sums(self, f: Mapped, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before = f.sums.get(at).astype(np.int64)
        return before + self.cums[k], f.sums.get(at + 1).astype(np.int64) - before

    def sums(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens before, count) of words by number; 0 is no word."""
        cum, n = np.zeros(len(numbers), np.int64), np.zeros(len(numbers), np.int64)
        k = np.searchsorted(self.bases, numbers - 1, side="right") - 1
        for p in np.unique(k[numbers > 0]).tolist():
            rows = np.nonzero((k == p) & (numbers > 0))[0]
            cum[rows], n[rows] = self._sums(self._file(p), p, numbers[rows] - 1 - self.bases[p])
        return cum, n

    def place(self, first, second, third) -> np.ndarray:
        """Places x of keys; each argument is (tokens before, count) of a word. (0, 0) for none."""
        inner = third[0] / self.tokens
        inner = (second[0] + second[1] * inner) / self.tokens
        return first[0] + first[1] * inner


def _steps(batches, *columns: str):
    """Texts of Arrow batches a bounded number of bytes at a time, with other columns."""
    for b in batches:
        texts, at = b.column("text"), 0
        while at < b.num_rows:
            part_, size, begin = [], 0, at
            while at < b.num_rows and (not part_ or size < STEP_BYTES):
                t = (texts[at].as_py() or "").encode("utf-8", "surrogatepass")
                part_.append(t)
                size += len(t)
                at += 1
            yield hash_words(part_), *[b.column(c).slice(begin, len(part_)) for c in columns]


def _sum_by(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _merge_words(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    key, n, more, rows = np.zeros(0, np.uint64), np.zeros(0, np.uint64), [], 0
    for k, data in enumerate(held):
        more.append(unsqueeze(data, 2))
        held[k] = b""
        rows += len(more[-1][0])
        if rows > HELD_ROWS or k + 1 == len(held):
            key, n = _sum_by(np.concatenate([key, *[x[0] for x in more]]), np.concatenate([n, *[x[1] for x in more]]))
            more, rows = [], 0
    return key, n


def _discount(once: int, twice: int) -> float:
    """Absolute discount from the counts of n-grams seen once and twice."""
    return min(0.95, max(0.1, once / max(1, once + 2 * twice)))


def count_words(texts: DataFrame) -> Words:
    """Count the words of all texts into files by hash range; a worker sums some steps before it sends."""
    spark = texts.sparkSession
    files, folder = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), scratch(spark, "lm-words")

    def count(batches):
        key, n = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for ((h, _),) in _steps(batches):
            own, seen = np.unique(h, return_counts=True)
            key, n = _sum_by(np.concatenate([key, own]), np.concatenate([n, seen.astype(np.uint64)]))
            if len(key) > HELD_ROWS:
                yield pieces(bucket(key, files), key, n)
                key, n = key[:0], n[:0]
        if len(key):
            yield pieces(bucket(key, files), key, n)

    def build(batches):
        for p, held in by_part(batches):
            key, n = _merge_words(held)
            put_bytes(f"{folder}/words-{p:06d}.eft", encode_monotone(key - first_hash(p, files)) + encode_monotone(np.concatenate([[0], np.cumsum(n)])))
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int64()), "words": pa.array([len(key)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64()), "once": pa.array([int((n == 1).sum())], pa.int64()), "twice": pa.array([int((n == 2).sum())], pa.int64())})

    rows = texts.mapInArrow(count, PIECES).repartitionById(files, "part").sortWithinPartitions("part")
    # one row a file, as many as shuffle partitions
    found = rows.mapInArrow(build, "part long, words long, tokens long, once long, twice long").collect()
    words, tokens = np.zeros(files, np.int64), np.zeros(files, np.int64)
    for r in found:
        words[r["part"]], tokens[r["part"]] = r["words"], r["tokens"]
    for k in set(range(files)) - {r["part"] for r in found}:
        put_bytes(f"{folder}/words-{k:06d}.eft", encode_monotone(np.zeros(0, np.uint64)) + encode_monotone(np.zeros(1, np.uint64)))
    d = _discount(sum(r["once"] for r in found), sum(r["twice"] for r in found))
    return Words(folder, np.cumsum(words) - words, np.cumsum(tokens) - tokens, int(tokens.sum()), int(words.sum()), d)


# --- the other levels ---


@dataclass(frozen=True)
class Trie:
    words: Words
    folder: str
    parts: int
    part_tokens: int

    def part_of(self, x: np.ndarray) -> np.ndarray:
        return np.minimum(x // self.part_tokens, self.parts - 1).astype(np.int64)

    def find(self, keys: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        """Of (w1, w2, w3) numbers in ascending order, w1 known, at places x: prob2, back1, prob3 and back2; -1: none.

        Each level's range comes from the pointers; in it, the word is sought relative to the value before the range.
        """
        out = {name: np.full(keys.shape[1], -1.0) for name in ("back1", "prob2", "back2", "prob3")}
        for p, s, e in runs(self.part_of(x)):
            f = _mapped(f"{self.folder}/part-{p:08d}.eft", _GRAMS)
            a, b, c = keys[:, s:e]
            new1 = np.diff(a, prepend=-1) != 0
            new2 = new1 | (np.diff(b, prepend=-1) != 0)
            of1, of2 = np.cumsum(new1) - 1, np.cumsum(new2) - 1  # of each key, which distinct w1 and (w1, w2) it has
            head = f.heads.find(a[new1].astype(np.uint64))
            out["back1"][s:e] = _at(f.back1, head)[of1]
            pair = _inside(f.ptr1, f.second, head, of1[new2], b[new2])
            out["prob2"][s:e], out["back2"][s:e] = _at(f.prob2, pair)[of2], _at(f.back2, pair)[of2]
            ask = np.nonzero(c > 0)[0]
            out["prob3"][s + ask] = _at(f.prob3, _inside(f.ptr2, f.third, pair, of2[ask], c[ask]))
        return out


def _at(codes: Codes, places: np.ndarray) -> np.ndarray:
    """Values at places; -1 where the place is."""
    return np.where(places >= 0, codes.get(np.maximum(places, 0)), -1.0) if len(codes.code) else np.full(len(places), -1.0)


def _inside(pointers: Monotone, values: Monotone, entries: np.ndarray, which: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of words in the ranges of entries[which]; -1 where there is no such entry or word."""
    out = np.full(len(words), -1)
    need = np.zeros(len(entries), bool)
    need[which[words > 0]] = True
    need &= entries >= 0
    lo, hi, before = np.zeros(len(entries), np.int64), np.zeros(len(entries), np.int64), np.zeros(len(entries), np.uint64)
    lo[need], hi[need] = pointers.range(entries[need])
    inner = np.nonzero(need & (lo > 0) & (lo < hi))[0]
    before[inner] = values.get(lo[inner] - 1)
    ask = np.nonzero((words > 0) & (lo < hi)[which])[0]
    of = which[ask]
    found = values.find(before[of] + words[ask].astype(np.uint64))
    ok = (found >= lo[of]) & (found < hi[of])
    out[ask[ok]] = found[ok]
    return out


def _local(h: np.ndarray, counts: np.ndarray, words: Words):
    """Words of a step by a local number in ascending order, 0 for unknown ones: (local number of each token, the global
    number, tokens before and count by local number, token's place in its text, bits of a local number)."""
    own, inverse = np.unique(h, return_inverse=True)
    number, cum, n = words.find(own)
    known = number > 0
    local = np.where(known, np.cumsum(known), 0)[inverse]
    table = [np.concatenate([[0], c[known]]) for c in (number, cum, n)]
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    return local, table, place, max(1, int(known.sum()).bit_length())


def _keys(a: np.ndarray, b: np.ndarray, c: np.ndarray, bits: int):
    """Distinct (a, b, c) in ascending order, the row's own, and how often each is there."""
    if 3 * bits <= 63:
        key, inverse, n = np.unique((a << (2 * bits)) | (b << bits) | c, return_inverse=True, return_counts=True)
        low = (1 << bits) - 1
        return np.stack([key >> (2 * bits), (key >> bits) & low, key & low]), inverse, n
    order = np.lexsort((c, b, a))
    rows = np.stack([a, b, c])[:, order]
    new = np.concatenate([[True], (np.diff(rows) != 0).any(axis=0)]) if len(a) else np.zeros(0, bool)
    inverse = np.empty(len(a), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return rows[:, new], inverse, np.bincount(inverse, minlength=int(new.sum()))


def _places(words: Words, table: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    _, cum, n = table
    return words.place(*[(cum[k], n[k]) for k in keys])


def _merge_grams(held: list[bytes]) -> list[np.ndarray]:
    """The sum of pieces: (w1, w2, w3, n), ascending. Columns are ranked first, so that keys pack."""
    now, more, rows = [np.zeros(0, np.uint64)] * 4, [], 0
    for k, data in enumerate(held):
        more.append(unsqueeze(data, 4))
        held[k] = b""
        rows += len(more[-1][0])
        if rows > HELD_ROWS or k + 1 == len(held):
            cols = [np.concatenate([now[j], *[x[j] for x in more]]) for j in range(4)]
            own, ranks = zip(*[np.unique(c, return_inverse=True) for c in cols[:3]])
            bits = [len(o).bit_length() for o in own]
            if sum(bits) <= 63:
                key, n = _sum_by((ranks[0] << (bits[1] + bits[2])) | (ranks[1] << bits[2]) | ranks[2], cols[3])
                ranks = [key >> (bits[1] + bits[2]), (key >> bits[2]) & ((1 << bits[1]) - 1), key & ((1 << bits[2]) - 1)]
            else:
                order = np.lexsort(ranks[::-1])
                ranks = [r[order] for r in ranks]
                first = np.nonzero(np.concatenate([[True], np.any([np.diff(r) != 0 for r in ranks], axis=0)]))[0]
                n, ranks = np.add.reduceat(cols[3][order], first), [r[first] for r in ranks]
            now, more, rows = [*[o[r] for o, r in zip(own, ranks)], n], [], 0
    return now


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal rows begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.nonzero(np.concatenate([[True], np.any([np.diff(c.astype(np.int64)) != 0 for c in columns], axis=0)]))[0]


_CUTS = "part long, kind int, w1 long, w2 long, n long, distinct long, once2 long, twice2 long, once3 long, twice3 long, lo long, hi long"


def build_trie(docs: DataFrame, *, part_tokens: int = PART_TOKENS) -> Trie:
    """Count, smooth and pack the words, bigrams and trigrams of all ``docs``; every one seen is kept.

    Interpolated absolute discounting: p(w|c) = (n(cw) - D) / n(c) + D distinct(c) / n(c) p(w|shorter c). The trie holds
    the first term and the factor of the second; a walk adds them up, so each context's probabilities sum to 1 over the
    words and the unknown one, which has the mass that the words' own discounts leave. Every token but ends begins one
    trigram, filled up with no word after the end, so one count of trigrams gives all three levels.
    """
    spark, texts = docs.sparkSession, docs.select("text")
    words = count_words(texts)
    release(spark)
    trie = Trie(words, scratch(spark, "lm-trie"), max(1, -(-words.tokens // part_tokens)), part_tokens)
    folder, parts = scratch(spark, "lm-counts"), trie.parts

    def count(batches):
        for ((h, counts),) in _steps(batches):
            local, table, place, bits = _local(h, counts, words)
            after = np.repeat(counts, counts) - place  # tokens from here to the end
            at = np.nonzero(after > 1)[0]
            third = np.where(after[at] > 2, np.concatenate([local, [0]])[at + 2 if len(at) else at], 0)
            keys, _, n = _keys(local[at], local[at + 1], third, bits)
            x = _places(words, table, keys)
            yield pieces(trie.part_of(x), *[table[0][k].astype(np.uint64) for k in keys], n.astype(np.uint64))

    def merge(batches):
        for p, held in by_part(batches):
            w1, w2, w3, n = _merge_grams(held)
            put_bytes(f"{folder}/counts-{p:08d}.raw", [squeeze(w1, w2, w3, n)])
            yield _cuts_of(p, w1, w2, w3, n, trie)

    rows = texts.mapInArrow(count, PIECES).repartitionById(parts, "part").sortWithinPartitions("part")
    cuts = written(rows.mapInArrow(merge, _CUTS), "lm-cuts")
    release(spark)
    # contexts that a cut goes through, with their sums over all parts
    pairs = cuts.where("kind = 1").groupBy("w1", "w2").agg(F.sum("n").alias("n"), F.sum("distinct").alias("distinct"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    firsts = cuts.where("kind = 2").groupBy("w1").agg(F.sum("distinct").alias("inner"), F.first("n").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    firsts = firsts.join(pairs.groupBy("w1").agg(F.count(F.lit(1)).alias("cut")), "w1", "left")
    firsts = firsts.select("w1", F.lit(0).cast("long").alias("w2"), "n", (F.col("inner") + F.coalesce("cut", F.lit(0))).alias("distinct"), "lo", "hi")
    seen = cuts.where("kind = 0").agg(*[F.sum(c) for c in ("once2", "twice2", "once3", "twice3")]).first()
    cut2 = pairs.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    d2, d3 = _discount((seen[0] or 0) + cut2[0], (seen[1] or 0) + cut2[1]), _discount(seen[2] or 0, seen[3] or 0)
    whole = pairs.select("w1", "w2", "n", "distinct", "lo", "hi").union(firsts)
    whole = whole.select(F.explode(F.sequence("lo", "hi")).alias("part"), F.struct("w1", "w2", "n", "distinct").alias("c"))
    jobs = spark.range(parts).withColumnRenamed("id", "part").join(whole.groupBy("part").agg(F.collect_list("c").alias("cuts")), "part", "left")
    jobs = jobs.join(cuts.where("kind = 0").select(F.col("part").alias("part"), F.lit(True).alias("full")), "part", "left")

    def build(batches):
        for b in batches:
            for r in b.to_pylist():
                p = r["part"]
                cols = [np.zeros(0, np.uint64)] * 4
                if r["full"]:
                    fs, path = filesystem(f"{folder}/counts-{p:08d}.raw")
                    with fs.open_input_stream(path) as f:
                        cols = unsqueeze(f.read(), 4)
                put_bytes(f"{trie.folder}/part-{p:08d}.eft", _pack_part(cols, r["cuts"] or [], d2, d3))
                yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int64())})

    made = jobs.select("part", "cuts", "full").repartitionById(parts, F.col("part").cast("int")).mapInArrow(build, "part long").count()
    assert made == parts, "every part must be there"
    remove(folder)
    discard(cuts)
    return trie


def _cuts_of(p: int, w1, w2, w3, n, trie: Trie) -> pa.RecordBatch:
    """What a part tells of itself: how many n-grams it has seen once and twice, and the contexts at its two ends."""
    words, ends = trie.words, np.concatenate
    at = _heads(w1, w2)
    a, b, cnt = w1[at], w2[at], np.add.reduceat(n, at)
    kids = np.add.reduceat((w3 > 0).astype(np.int64), at)
    tri = n[w3 > 0]
    edge = np.unique([0, len(at) - 1])
    inner = np.ones(len(at), bool)
    inner[edge] = False
    zero = {c: 0 for c in ("w1", "w2", "n", "distinct", "once2", "twice2", "once3", "twice3", "lo", "hi")}
    rows = [zero | {"part": p, "kind": 0, "once2": int((cnt[inner] == 1).sum()), "twice2": int((cnt[inner] == 2).sum()), "once3": int((tri == 1).sum()), "twice3": int((tri == 2).sum())}]
    none = (np.zeros(1), np.zeros(1))
    last = (np.array([words.tokens * (1 + 1e-9)]), np.zeros(1))
    for k in edge.tolist():
        first, second = words.sums(a[k : k + 1].astype(np.int64)), words.sums(b[k : k + 1].astype(np.int64))
        lo, hi = (int(trie.part_of(words.place(first, second, x))[0]) for x in (none, last))
        rows.append(zero | {"part": p, "kind": 1, "w1": int(a[k]), "w2": int(b[k]), "n": int(cnt[k]), "distinct": int(kids[k]), "lo": lo, "hi": hi})
    for w in np.unique(a[edge]).tolist():
        first = words.sums(np.array([w], np.int64))
        lo, hi = (int(trie.part_of(words.place(first, x, none))[0]) for x in (none, last))
        rows.append(zero | {"part": p, "kind": 2, "w1": int(w), "n": int(first[1][0]), "distinct": int((inner & (a == w)).sum()), "lo": lo, "hi": hi})
    kinds = {"kind": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.int64())) for c in (x.split()[0] for x in _CUTS.split(", "))], names=[x.split()[0] for x in _CUTS.split(", ")])


def _monotone_ranges(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Values of consecutive ranges, each with the last of the range before added; empty ranges add nothing."""
    size = np.diff(starts)
    last = np.zeros(len(size), np.int64)
    last[size > 0] = values[starts[1:][size > 0] - 1]
    return values + np.repeat(np.cumsum(last) - last, size)


def _pack_part(cols: list[np.ndarray], cuts: list[dict], d2: float, d3: float) -> list[bytes]:
    """A part file from its counts, the contexts that are cut there or near there, and the discounts."""
    w1, w2, w3, n = (c.astype(np.int64) for c in cols)
    at = _heads(w1, w2)
    a, b = w1[at], w2[at]
    cnt = np.add.reduceat(n, at) if len(at) else n
    kids = np.add.reduceat((w3 > 0).astype(np.int64), at) if len(at) else n
    distinct = kids.copy()
    total: dict[int, tuple[int, int]] = {}
    for c in cuts:
        if not c["w2"]:
            total[c["w1"]] = c["n"], c["distinct"]
            continue
        k = np.nonzero((a == c["w1"]) & (b == c["w2"]))[0]
        if len(k):
            cnt[k], distinct[k] = c["n"], c["distinct"]
        else:
            a, b, cnt, distinct, kids = (np.append(x, v) for x, v in ((a, c["w1"]), (b, c["w2"]), (cnt, c["n"]), (distinct, c["distinct"]), (kids, 0)))
    own_rows = len(at)
    order = np.lexsort((b, a))
    if len(order) > own_rows:  # those put in have no rows of their own, so the order of the rows stays
        a, b, cnt, distinct, kids = (x[order] for x in (a, b, cnt, distinct, kids))
    heads, first = np.unique(a, return_index=True)
    more = np.array(sorted(set(total) - set(heads.tolist())), np.int64)
    sizes = np.diff(np.append(first, len(a)))
    seen, kinds2 = (np.add.reduceat(cnt, first), sizes.copy()) if len(first) else (cnt, sizes.copy())
    every = np.concatenate([heads, more])
    order = np.argsort(every, kind="stable")
    every, sizes, seen, kinds2 = every[order], *(np.concatenate([x, np.zeros(len(more), np.int64)])[order] for x in (sizes, seen, kinds2))
    for w, (c, d) in total.items():
        k = int(np.searchsorted(every, w))
        seen[k], kinds2[k] = c, d
    ptr1 = np.concatenate([[0], np.cumsum(sizes)])
    ptr2 = np.concatenate([[0], np.cumsum(kids)])
    tri = w3 > 0
    third = _monotone_ranges(w3[tri], ptr2)
    sequences = [every, ptr1, _monotone_ranges(b, ptr1), ptr2, third]
    codes = [
        d2 * kinds2 / np.maximum(seen, 1),
        (cnt - d2) / np.repeat(seen, sizes),
        d3 * np.maximum(distinct, 1) / cnt,  # what only an end follows is never a context
        (n[tri] - d3) / np.repeat(cnt, kids),
    ]
    return [x for s in sequences for x in encode_monotone(s)] + [x for c in codes for x in encode_codes(c)]


def score_texts(docs: DataFrame, trie: Trie, smoothing: float = 0.1) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every whole text; one row per row.

    score: log10 p of the text's tokens under the trie, trigrams interpolated with bigrams and those with words; a text's
    first tokens have shorter contexts. base_score: unigrams with ``smoothing`` added to each count.
    """
    words = trie.words
    whole = words.tokens + smoothing * (words.size + 1)
    unknown = words.discount * words.size / words.tokens if words.tokens else 1.0

    def run(batches):
        for (h, counts), ids in _steps(batches, "doc_id"):
            local, table, place, bits = _local(h, counts, words)
            n = table[2].astype(float)
            p = np.concatenate([[unknown], (n[1:] - words.discount) / max(words.tokens, 1)])[local]
            base = np.log10((n + smoothing) / whole)[local] if whole else np.zeros(len(local))
            known = local > 0
            shifted = [np.concatenate([np.zeros(k, np.int64), local])[: len(local)] for k in (0, 1, 2)]
            two = np.nonzero((place >= 1) & (shifted[1] > 0))[0]
            three = two[(place[two] >= 2) & (shifted[2][two] > 0)]
            a = np.concatenate([shifted[1][two], shifted[2][three]])
            b = np.concatenate([shifted[0][two], shifted[1][three]])
            c = np.concatenate([np.zeros(len(two), np.int64), shifted[0][three]])
            keys, inverse, _ = _keys(a, b, c, bits)
            found = trie.find(np.stack([table[0][k] for k in keys]), _places(words, table, keys))
            for at, prob, back, rows in ((two, "prob2", "back1", inverse[: len(two)]), (three, "prob3", "back2", inverse[len(two) :])):
                share = found[back][rows]
                p[at] = np.where(share >= 0, share * p[at] + np.maximum(found[prob][rows], 0), p[at])
            doc, docs_ = np.repeat(np.arange(len(counts)), counts), len(counts)
            sums = [np.bincount(doc, x, minlength=docs_) for x in (known, base, np.log10(p))]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts.astype(np.int64)), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id):
    """The documents that the model never sees: crc32 of the id as text, mod 10, is 0."""
    return id_crc(doc_id) % 10 == 0


def learn_and_score(docs: DataFrame, *, part_tokens: int = PART_TOKENS) -> DataFrame:
    """Scores of all documents by a trie of those that are not held out.

    Null and empty texts are one end token. Null ids count as the empty text's crc, so they are held out. Repeated rows
    are counted and scored each. Without any training text the unknown word has all mass: scores are 0.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    trie = build_trie(docs.where(~held_out(F.col("doc_id"))), part_tokens=part_tokens)
    out = score_texts(docs, trie)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(trie.words.tokens).cast("long").alias("train_tokens"), "base_score", "score")
