"""Rows packed into compressed pieces, so that a shuffle moves a few bytes a row and workers see whole arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

PIECES = "part int, data binary"
_U = np.uint64


def squeeze(*columns: np.ndarray) -> bytes:
    """Rows of unsigned columns, ascending by the first: that as gaps, all by byte planes, compressed."""
    n, out = len(columns[0]), []
    for k, c in enumerate(columns):
        c = np.diff(c, prepend=c.dtype.type(0)) if k == 0 and n else c
        width = max(1, -(-int(c.max()).bit_length() // 8)) if n else 1
        out.append(bytes([width]) + c.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width].T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array([n], "<u8").tobytes() + b"".join(out))


def unsqueeze(data: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, at, out = int(raw[:8].view("<u8")[0]), 8, []
    for k in range(columns):
        width = int(raw[at])
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = raw[at + 1 : at + 1 + n * width].reshape(width, n).T
        c = wide.view("<u8").reshape(n)
        out.append(np.cumsum(c, dtype=np.uint64) if k == 0 else c)
        at += 1 + n * width
    return out


def runs(k: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, begin, end) of the runs of equal values."""
    if len(k):
        cuts = np.concatenate([[0], np.nonzero(np.diff(k))[0] + 1, [len(k)]])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield int(k[s]), s, e


def pieces(parts: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A row for each run of parts: the part and its columns, squeezed."""
    rows = [(p, squeeze(*[c[s:e] for c in columns])) for p, s, e in runs(parts)]
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], names=["part", "data"])


def by_part(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """(part, its pieces, still squeezed) of batches that are sorted by part."""
    now, held = None, []
    for b in batches:
        for p, s, e in runs(b.column("part").to_numpy()):
            if now is not None and p != now:
                yield now, held
                held = []
            now = p
            held.extend(x.as_py() for x in b.column("data").slice(s, e - s))
    if now is not None:
        yield now, held


def bucket(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges each hash is in."""
    return (((hashes >> _U(32)) * _U(n)) >> _U(32)).astype(np.int64)


def first_hash(k: int, n: int) -> np.uint64:
    """The smallest hash of a range."""
    return _U((-(-(k << 32) // n)) << 32)
