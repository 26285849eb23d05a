"""A keyed table in Parquet: files by ranges of the key's hash, versions as manifests, changes that rewrite only what they touch."""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.corpus import upsert

#: Rows of a file above which its range is halved when it is written anew, and seconds after which a claim without a version is void.
FILE_ROWS, CLAIM_S = 1_000_000, 600
_LOW, _SPAN = -(1 << 63), 1 << 64


class CommitConflict(RuntimeError):
    """Another writer committed the version that this one wanted to."""


@dataclass
class Version:
    """A version: its number, the ranges (hash from, to, folder or none, rows) that make up all hashes, and what it has applied."""

    number: int
    schema: str
    keys: list[str]
    ranges: list[tuple[int, int, str | None, int]]
    applied: dict[str, int] = field(default_factory=dict)

    def dumps(self) -> str:
        return json.dumps({"number": self.number, "schema": json.loads(self.schema), "keys": self.keys, "ranges": self.ranges, "applied": self.applied})

    @staticmethod
    def loads(text: str) -> Version:
        v = json.loads(text)
        return Version(v["number"], json.dumps(v["schema"]), v["keys"], [tuple(r) for r in v["ranges"]], v["applied"])


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k).cast("string") for k in keys])


class KeyedTable:
    """A table with unique keys under ``path`` on any file system of the session's Hadoop configuration.

    ``path``/versions holds a manifest for each version, ``path``/data the folders they name. A version counts once its
    manifest is there, which is created whole and only if it is not there yet: of two writers that begin from the same
    version one fails with CommitConflict and leaves nothing that readers see. The file system must create files
    exclusively, as HDFS and local ones do.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- versions ---

    def _manifest(self, number: int) -> str:
        return f"{self.path}/versions/{number:012d}.json"

    def numbers(self) -> list[int]:
        folder = self._at(f"{self.path}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> Version:
        """The version of this number, else the last."""
        numbers = self.numbers()
        if not numbers or number is not None and number not in numbers:
            raise FileNotFoundError(f"{self.path}: no version {'at all' if number is None else number}")
        stream = self._fs.open(self._at(self._manifest(numbers[-1] if number is None else number)))
        try:
            return Version.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, v: Version) -> None:
        """The version's place is claimed by a file that only one writer can create; then its manifest is moved there whole.

        A claim whose writer was lost before it moved the manifest is void after CLAIM_S seconds.
        """
        target, own = self._manifest(v.number), f"{self.path}/versions/.{uuid.uuid4().hex}"
        self._fs.mkdirs(self._at(f"{self.path}/versions"))
        claim = self._at(f"{target}.claim")
        if self._fs.exists(claim) and not self._fs.exists(self._at(target)) and self._fs.getFileStatus(claim).getModificationTime() < (time.time() - CLAIM_S) * 1000:
            self._fs.delete(claim, False)
        try:
            self._fs.create(claim, False).close()  # exclusive: the second writer fails here
        except Py4JJavaError as e:
            raise CommitConflict(f"{self.path}: version {v.number} is being or has been committed") from e
        out = self._fs.create(self._at(own), False)
        try:
            out.write(bytearray(v.dumps().encode()))
        finally:
            out.close()
        if not self._fs.rename(self._at(own), self._at(target)):
            raise CommitConflict(f"{self.path}: version {v.number} could not be committed")

    # --- reading ---

    def create(self, schema: StructType, keys: list[str], ranges: int = 1) -> None:
        """SRC1: an empty table; CommitConflict if there is one."""
        cuts = [_LOW + _SPAN * k // ranges for k in range(ranges + 1)]
        self._commit(Version(0, schema.json(), keys, [(a, b - 1, None, 0) for a, b in zip(cuts, cuts[1:])]))

    def _folders(self, v: Version, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(v.schema))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def read(self, number: int | None = None) -> DataFrame:
        """All rows of a version, the last unless given; a version's files never change."""
        v = self.version(number)
        return self._folders(v, [f for _, _, f, _ in v.ranges if f])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """SRC4: the rows of these keys, from the files whose ranges have them."""
        v = self.version()
        at = self._range_of(v)
        touched = {r["r"] for r in keys.select(at.alias("r")).distinct().collect()}
        found = self._folders(v, [f for k, (_, _, f, _) in enumerate(v.ranges) if f and k in touched])
        return found.join(keys.select(*v.keys).distinct(), v.keys, "left_semi")

    @staticmethod
    def _range_of(v: Version) -> Column:
        """The number of the range that a row's key falls into; cuts are few, so they are a literal."""
        cuts = F.array(*[F.lit(a) for a, _, _, _ in v.ranges[1:]]).cast("array<bigint>")
        return F.size(F.filter(cuts, lambda c: c <= key_hash(v.keys)))

    # --- writing ---

    def upsert(self, updates: DataFrame, order: str, *, merge: Callable[[DataFrame, DataFrame, list[str], str], DataFrame] = upsert, source: tuple[str, int] | None = None, file_rows: int = FILE_ROWS) -> int:
        """UPS1-3: a new version in which ``updates`` are merged by key, the last by ``order`` winning; its number.

        Only files whose ranges have a key of ``updates`` are read and written anew; a file that would hold over
        ``file_rows`` rows is halved. ``merge``: (base, updates, keys, order) -> rows, as ``upsert`` or what keeps a
        column. ``source``: a stream and its batch number; a batch that was applied before changes nothing.
        """
        v = self.version()
        if source and v.applied.get(source[0], -1) >= source[1]:
            return v.number
        new = dict(r for r in updates.groupBy(self._range_of(v).alias("r")).count().collect())
        applied = v.applied | ({source[0]: source[1]} if source else {})
        if not new:
            if source:
                self._commit(Version(v.number + 1, v.schema, v.keys, v.ranges, applied))
            return v.number + bool(source)
        touched = [k for k in range(len(v.ranges)) if k in new]
        base = self._folders(v, [v.ranges[k][2] for k in touched if v.ranges[k][2]])
        ranges = []
        for k, (a, b, f, rows) in enumerate(v.ranges):
            parts = 1 if k not in new else 1 << max(0, math.ceil(math.log2(max(1, (rows + new[k]) / file_rows))))
            cuts = [a + (b + 1 - a) * i // parts for i in range(parts + 1)]
            ranges += [(x, y - 1, f if k not in new else "", rows if k not in new else 0) for x, y in zip(cuts, cuts[1:])]
        folder = f"data/{v.number + 1:012d}-{uuid.uuid4().hex[:12]}"
        after = Version(v.number + 1, v.schema, v.keys, ranges, applied)
        merged = merge(base, updates, v.keys, order).select(*base.columns).withColumn("_range", self._range_of(after))
        merged.repartition("_range").sortWithinPartitions("_range", *v.keys).write.partitionBy("_range").parquet(f"{self.path}/{folder}")
        counts = {}
        if self._fs.exists(self._at(f"{self.path}/{folder}")):
            there = self.spark.read.schema(StructType.fromJson(json.loads(v.schema)).add("_range", "integer")).parquet(f"{self.path}/{folder}")
            counts = dict(r for r in there.groupBy("_range").count().collect())  # from the files' footers
        after.ranges = [(a, b, (f"{folder}/_range={k}" if k in counts else None) if f == "" else f, counts.get(k, 0) if f == "" else rows) for k, (a, b, f, rows) in enumerate(ranges)]
        self._commit(after)
        return after.number

    def upsert_retrying(self, updates: DataFrame, order: str, tries: int = 5, **given) -> int:
        """``upsert`` that begins again from the version that came between, a few times."""
        for n in range(tries):
            try:
                return self.upsert(updates, order, **given)
            except CommitConflict:
                if n == tries - 1:
                    raise
                time.sleep(0.05 * 2**n)

    def vacuum(self, keep: int = 1) -> int:
        """CA7: delete all but the last ``keep`` versions and the files that none of those names; how many ranges' files went."""
        numbers = self.numbers()
        held = {f for n in numbers[-keep:] for _, _, f, _ in self.version(n).ranges if f}
        for n in numbers[:-keep]:
            for p in (self._manifest(n), f"{self._manifest(n)}.claim"):
                self._fs.delete(self._at(p), False)
        gone, data = 0, self._at(f"{self.path}/data")
        for folder in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = folder.getPath().getName()
            if int(name[:12]) > numbers[-1]:  # it may be about to be committed
                continue
            parts = [s.getPath() for s in self._fs.listStatus(folder.getPath()) if s.isDirectory()]
            dead = [p for p in parts if f"data/{name}/{p.getName()}" not in held]
            for p in [folder.getPath()] if len(dead) == len(parts) else dead:
                self._fs.delete(p, True)
            gone += len(dead)
        return gone
