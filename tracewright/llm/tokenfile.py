"""Token ids in binary files: independent zstandard frames, a document index and a trailing seek table.

Layout of a file, following the public zstandard seekable format:

    frame*       up to FRAME_IDS ids each, little-endian unsigned 32-bit, compressed on their own
    index        a skippable frame (magic 184D2A50): zstandard frame, with its checksum, of document count, ids, null flags, lengths
    seek table   a skippable frame (magic 184D2A5E): per frame its compressed size, its size and a checksum (low 32 bits
                 of XXH64 of its content), then frame count, descriptor 80 and magic 8F92EAB1

Any zstandard decoder reads the frames in turn and skips the rest; a reader of some documents decompresses theirs only.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, put_bytes, scratch
from .tokens import encode_rows

#: Fixed values of the seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_IDS = 65_536
#: Bytes of text that a file holds, about, each document counting ROW_BYTES more; documents that a reader gives at a time.
FILE_BYTES, ROW_BYTES, READ_DOCS = 128_000_000, 64, 20_000
_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


class FileWriter:
    """Collects documents; ``chunks`` gives the bytes of the file as they become ready."""

    def __init__(self, level: int = 3):
        self.coder = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.index_coder = zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=True)
        self.ids, self.nulls, self.lengths = array("q"), bytearray(), array("q")
        self.table: list[tuple[int, int, int]] = []

    def _frame(self, raw: bytes) -> bytes:
        packed = self.coder.compress(raw)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        return packed

    def chunks(self, rows: Iterable[tuple[int | None, bytes]]) -> Iterator[bytes]:
        held, size = bytearray(), 4 * FRAME_IDS
        for doc_id, raw in rows:
            self.ids.append(0 if doc_id is None else doc_id)
            self.nulls.append(doc_id is None)
            self.lengths.append(len(raw) // 4)
            held += raw
            while len(held) >= size:
                yield self._frame(bytes(held[:size]))
                del held[:size]
        if held:
            yield self._frame(bytes(held))
        index = struct.pack("<Q", len(self.ids)) + np.array(self.ids, "<i8").tobytes() + bytes(self.nulls) + np.array(self.lengths, "<u8").tobytes()
        index = self.index_coder.compress(index)
        yield struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index
        entries = b"".join(struct.pack("<III", *x) for x in self.table)
        yield struct.pack("<II", SKIPPABLE_SEEK, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEK_MAGIC)


class FileReader:
    """Random access to one file: the table and the index are read first, frames as they are asked for."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        self.coder = zstandard.ZstdDecompressor()
        size = self.file.size()
        count, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError(f"{uri} has no seek table")
        table_at = size - 9 - 12 * count
        entries = np.frombuffer(self._at(table_at, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        self.packed, self.raw, self.sums = entries[:, 0], entries[:, 1], entries[:, 2]
        self.frame_at = np.concatenate([[0], np.cumsum(self.packed)])
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw)])
        index_at = int(self.frame_at[-1])
        magic, length = struct.unpack("<II", self._at(index_at, 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError(f"{uri} has no document index")
        index = self.coder.decompress(self._at(index_at + 8, length))
        n = struct.unpack_from("<Q", index)[0]
        self.doc_ids = np.frombuffer(index, "<i8", n, 8)
        self.nulls = np.frombuffer(index, "u1", n, 8 + 8 * n).astype(bool)
        self.lengths = np.frombuffer(index, "<u8", n, 8 + 9 * n).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.last: tuple[int, bytes] = (-1, b"")

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            raw = self.coder.decompress(self._at(int(self.frame_at[k]), int(self.packed[k])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k] or len(raw) != self.raw[k]:
                raise ValueError(f"frame {k} is damaged")
            self.last = (k, raw)
        return self.last[1]

    def pieces(self, nth: int) -> Iterator[bytes]:
        """The bytes of the nth document's ids, frame by frame."""
        begin, end = 4 * int(self.starts[nth]), 4 * int(self.starts[nth + 1])
        k = int(np.searchsorted(self.raw_at, begin, side="right")) - 1
        while begin < end:
            stop = min(end, int(self.raw_at[k + 1]))
            yield self.frame(k)[begin - int(self.raw_at[k]) : stop - int(self.raw_at[k])]
            begin, k = stop, k + 1

    def ids(self, nth: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.pieces(nth)), "<u4")


def write_token_files(docs: DataFrame, tokenizer: str, *, end_id: int = 0, path: str | None = None) -> tuple[str, list[tuple[str, int]]]:
    """Encode all documents into files under ``path`` (a folder of the shared one by default), ascending by doc_id.

    Returns the folder and (file name, ids) in order. Null texts are empty, null ids come first, equal ids are ordered by
    a hash of their texts; every document ends with ``end_id``. Each task streams one range of ids into one file under
    its partition's number, which appears whole or not at all.
    """
    folder = path or scratch(docs.sparkSession, "tokens")
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(ROW_BYTES))).first()[0] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(files, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def write(batches):
        name, first = f"part-{TaskContext.get().partitionId():06d}.zst", None
        source = encode_rows(batches, tokenizer, end_id)
        first = next(source, None)
        if first is None:
            return
        writer = FileWriter()

        def everything():
            yield first
            yield from source

        put_bytes(f"{folder}/{name}", writer.chunks(everything()))
        yield pa.RecordBatch.from_pydict({"name": [name], "n_ids": pa.array([int(sum(writer.lengths))], pa.int64())})

    files = sorted(map(tuple, rows.mapInArrow(write, "name string, n_ids long").collect()))
    return folder, files


def read_token_files(spark, folder: str, files: list[tuple[str, int]]) -> DataFrame:
    """Each document of the files: doc_id, start (ids of all documents before it), n_tokens, crc32 of its ids."""
    bases = [0]
    for _, n in files:
        bases.append(bases[-1] + n)
    if not files:
        return spark.createDataFrame([], _SCHEMA)

    def read(batches):
        for batch in batches:
            for k in batch.column("id").to_pylist():
                r = FileReader(f"{folder}/{files[k][0]}")
                for at in range(0, len(r.lengths), READ_DOCS):
                    own = slice(at, at + READ_DOCS)
                    sums = []
                    for nth in range(len(r.lengths))[own]:
                        crc = 0
                        for piece in r.pieces(nth):
                            crc = zlib.crc32(piece, crc)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(r.doc_ids[own], pa.int64(), mask=r.nulls[own]), pa.array(r.starts[:-1][own] + bases[k], pa.int64()), pa.array(r.lengths[own], pa.int64()), pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return spark.range(0, len(files), 1, len(files)).mapInArrow(read, _SCHEMA)
