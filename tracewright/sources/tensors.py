"""Tensor files as a data source: a JSON header tells names, kinds and byte ranges, and only the ranges asked for are read."""

from __future__ import annotations

import json
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

#: Kinds of numbers in the header, with how they lie in the file; BF16 is the upper half of a 32-bit float.
KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "BF16": "<u2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "u1"}
#: Values of a row: longer tensors are several rows and partitions, whole rows of a matrix each where one fits.
CHUNK = 1 << 18
_SCHEMA = "file string, name string, kind string, shape array<long>, at long, values array<double>"
#: How the two factors of an adapted module are named, and what its base weight's name lacks and has (fixed values).
FACTORS, OUTER, WEIGHT = (".lora_A", ".lora_B"), "base_model.model.", ".weight"


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def header_of(fs: pafs.FileSystem, path: str) -> tuple[dict, int]:
    """(header without metadata, place of the first byte of data) of a tensor file."""
    with fs.open_input_file(path) as f:
        (size,) = struct.unpack("<Q", f.read(8))
        found = json.loads(f.read(size))
    found.pop("__metadata__", None)
    return found, 8 + size


def write_tensor_file(path: str, tensors: dict[str, np.ndarray]) -> None:
    """A tensor file of 64, 32 or 16-bit floats, or of integers, as they are."""
    names = {np.dtype(v): k for k, v in KINDS.items() if k not in ("BF16", "BOOL")}
    header, at = {}, 0
    for name, t in tensors.items():
        header[name] = {"dtype": names[t.dtype], "shape": list(t.shape), "data_offsets": [at, at + t.nbytes]}
        at += t.nbytes
    head = json.dumps(header).encode()
    fs, where = _filesystem(path)
    fs.create_dir(where.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(where) as out:
        out.write(struct.pack("<Q", len(head)) + head)
        for t in tensors.values():
            out.write(np.ascontiguousarray(t).tobytes())


class TensorFiles(DataSource):
    """``path``: a file or a folder of ``.safetensors`` files on any file system of pyarrow; a row for each tensor or part of one."""

    @classmethod
    def name(cls) -> str:
        return "tensor_files"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema):
        return _TensorReader(self.options["path"], int(self.options.get("chunk", CHUNK)))


class _TensorReader(DataSourceReader):
    def __init__(self, path: str, chunk: int):
        self.path, self.chunk, self.wanted = path, chunk, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on names prune partitions; all others are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.wanted.append(("in", {f.value}))
            elif isinstance(f, In) and f.attribute == ("name",):
                self.wanted.append(("in", set(f.value)))
            elif isinstance(f, StringStartsWith) and f.attribute == ("name",):
                self.wanted.append(("begins", f.value))
            yield f

    def _asked(self, name: str) -> bool:
        return all(name in what if how == "in" else name.startswith(what) for how, what in self.wanted)

    def partitions(self):
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else ""
        fs, where = _filesystem(self.path)
        info = fs.get_file_info(where)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [where] if info.is_file else sorted(x.path for x in fs.get_file_info(pafs.FileSelector(where)) if x.path.endswith(".safetensors"))
        out = []
        for path in files:
            header, begin = header_of(fs, path)
            for name, t in sorted(header.items()):
                if self._asked(name):
                    count, width = math.prod(t["shape"]), t["shape"][-1] if len(t["shape"]) > 1 else 1
                    step = self.chunk if width > self.chunk else self.chunk // max(1, width) * max(1, width)
                    for at in range(0, max(1, count), max(1, step)):
                        out.append(InputPartition((scheme + path if scheme else path, name, t["dtype"], t["shape"], begin + t["data_offsets"][0], at, min(count, at + step))))
        return out or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        file, name, kind, shape, begin, at, end = partition.value
        dtype = np.dtype(KINDS[kind])
        fs, path = _filesystem(file)
        with fs.open_input_file(path) as f:
            raw = f.read_at((end - at) * dtype.itemsize, begin + at * dtype.itemsize)
        values = np.frombuffer(raw, dtype)
        if kind == "BF16":
            values = (values.astype(np.uint32) << 16).view(np.float32)
        cols = [pa.array([x], t) for x, t in ((file.rsplit("/", 1)[-1], pa.string()), (name, pa.string()), (kind, pa.string()), (shape, pa.list_(pa.int64())), (at, pa.int64()))]
        flat = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(np.float64)))
        yield pa.RecordBatch.from_arrays([*cols, flat], names=["file", "name", "kind", "shape", "at", "values"])


def read_tensors(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """SRC12: (file, name, kind, shape, at, values) of all tensors below a path; conditions on ``name`` prune what is read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TensorFiles)
    return spark.read.format("tensor_files").option("path", path).option("chunk", str(chunk)).load()


def tensor_norms(tensors: DataFrame) -> DataFrame:
    """(name, shape, norm): Frobenius norms, summed where parts lie."""
    squares = F.aggregate("values", F.lit(0.0), lambda a, x: a + x * x)
    return tensors.groupBy("name", "shape").agg(F.sqrt(F.sum(squares)).alias("norm"))


def _grams(tensors: DataFrame) -> DataFrame:
    """(module, cell, a, b): of each adapted module the elements of AA' and B'B.

    The product of the factors is never made: |BA| squared is the sum of the products of these elements. B, tall, goes
    by parts of whole rows; A, of few rows, is gathered whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for module, side, shape, values in zip(*[b.column(c).to_pylist() for c in ("module", "side", "shape")], b.column("values")):
                x = values.values.to_numpy().reshape(-1, shape[1])
                g = x.T @ x if side == "B" else x @ x.T
                yield pa.RecordBatch.from_arrays([pa.array([module]), pa.array([side]), pa.array([g.ravel()], pa.list_(pa.float64()))], names=["module", "side", "gram"])

    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "values"))), lambda p: p["values"]))
    wide = tensors.where("side = 'A'").groupBy("module", "side", "shape").agg(whole.alias("values"))
    parts = wide.union(tensors.where("side = 'B'").select(*wide.columns)).mapInArrow(run, "module string, side string, gram array<double>")
    cells = parts.select("module", "side", F.posexplode("gram").alias("cell", "g"))
    return cells.groupBy("module", "cell").agg(F.sum(F.when(F.col("side") == "A", F.col("g"))).alias("a"), F.sum(F.when(F.col("side") == "B", F.col("g"))).alias("b"))


def module_of(name: Column) -> Column:
    """What both factors of an adapted module are named before."""
    return F.regexp_replace(name, r"\.lora_[AB].*$", "")


def adapter_norms(tensors: DataFrame, scaling: float | None = None, base: DataFrame | None = None) -> DataFrame:
    """JN17: (module, a_norm, b_norm, moved, relative) of modules with both factors, the most moved first.

    moved: the norm of scaling x B x A; relative: that by the norm of the base weight that it changes, where ``base`` (a
    table of norms) has one above 0.
    """
    pairs = tensors.where(F.col("name").contains(FACTORS[0]) | F.col("name").contains(FACTORS[1]))
    pairs = pairs.withColumns({"module": module_of(F.col("name")), "side": F.when(F.col("name").contains(FACTORS[1]), "B").otherwise("A")})
    norms = tensor_norms(pairs).withColumns({"module": module_of(F.col("name")), "is_b": F.col("name").contains(FACTORS[1])})
    norms = norms.groupBy("module").agg(F.max(F.when(~F.col("is_b"), F.col("norm"))).alias("a_norm"), F.max(F.when(F.col("is_b"), F.col("norm"))).alias("b_norm")).where("a_norm IS NOT NULL AND b_norm IS NOT NULL")
    moved = _grams(pairs).groupBy(F.col("module").alias("_m")).agg((F.sqrt(F.greatest(F.sum(F.col("a") * F.col("b")), F.lit(0.0))) * (scaling or 1.0)).alias("moved"))
    out = norms.join(moved, F.col("module") == F.col("_m")).drop("_m")
    if base is None:
        return out.withColumn("relative", F.lit(None).cast("double"))
    weights = base.where(F.endswith("name", F.lit(WEIGHT)) & (F.col("norm") > 0)).select(F.col("name").alias("_w"), F.col("norm").alias("_norm"))
    named = F.concat(F.replace("module", F.lit(OUTER), F.lit("")), F.lit(WEIGHT))
    return out.join(weights, named == F.col("_w"), "left").withColumn("relative", F.col("moved") / F.col("_norm")).drop("_w", "_norm")


def movement(norms: DataFrame, least: float = 1e-4) -> DataFrame:
    """AG28: one row: modules, median, least and greatest b_norm, those of exactly 0 and those up to ``least``, median and greatest moved."""
    middle = lambda c: F.median(c)
    return norms.agg(F.count(F.lit(1)).alias("modules"), middle("b_norm").alias("b_median"), F.min("b_norm").alias("b_min"), F.max("b_norm").alias("b_max"), F.count_if(F.col("b_norm") == 0).alias("zero"), F.count_if(F.col("b_norm") <= least).alias("still"), middle("moved").alias("moved_median"), F.max("moved").alias("moved_max"))


def most_moved(norms: DataFrame, k: int = 10) -> DataFrame:
    """SO10: the ``k`` modules with the largest b_norm and their rank."""
    top = norms.orderBy(F.col("b_norm").desc(), "module").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("b_norm").desc(), "module")))
