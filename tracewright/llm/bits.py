"""Filters of hashes as files of bits in the shared folder: a fixed size, whatever they hold, and no member is ever refused."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filesystem, put_bytes, scratch

#: Bits of a filter: 16 MB, however many hashes there are; more of them only let more others through.
FILTER_BITS = 1 << 27

_filters: dict[str, np.ndarray] = {}


def write_filter(df: DataFrame, hashed: Column) -> str:
    """A file with a bit for each hash of the frame; at most FILTER_BITS are gathered."""
    at = hashed.bitwiseAND(F.lit(FILTER_BITS - 1))
    parts = df.select(F.shiftright(at, 15).alias("part"), at.bitwiseAND(F.lit(32767)).alias("bit"))
    bits = bytearray(FILTER_BITS // 8)
    for r in parts.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).toLocalIterator():
        bits[r["part"] * 4096 : (r["part"] + 1) * 4096] = r["bits"]
    uri = scratch(df.sparkSession, "filter") + "/bits"
    put_bytes(uri, [bytes(bits)])
    return uri


def read_filter(uri: str) -> np.ndarray:
    """A filter's bytes, read once a worker."""
    if uri not in _filters:
        fs, path = filesystem(uri)
        with fs.open_input_stream(path) as f:
            raw = f.read()
        if len(_filters) >= 2:
            _filters.clear()
        _filters[uri] = np.frombuffer(raw, np.uint8)
    return _filters[uri]


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (signed or unsigned 64 bits) may be in a filter; one that is, always may."""
    at = (hashes.astype(np.int64, copy=False) & np.int64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
