"""What the operators of this package share: the shared folder, materialised tables and word rules."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space and the controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of this machine's where it is unset.

    Whatever asks for it is about to run Python workers, so their batches are made small.
    """
    small_batches(spark)
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.sparkContext.setCheckpointDir(_own_dirs[app])
    return _own_dirs[app]


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tracewright/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: its lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``written`` made and that nothing reads any more, lazily neither."""
    remove(df.written_at)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffles of finished steps now; without this they stay until the driver's heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The pyarrow file system of a URI of the shared folder, and the path there."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """From now on this session sends Python workers at most so many rows at a time; texts of a batch are in memory thrice."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def put_bytes(uri: str, chunks) -> int:
    """Write chunks to a file that appears whole or not at all; a task that runs again replaces it by the same bytes."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part, size = f"{path}.{uuid.uuid4().hex[:8]}.tmp", 0
    with fs.open_output_stream(part) as out:
        for c in chunks:
            out.write(c)
            size += len(c)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:  # some stores do not move onto a file
        fs.delete_file(path)
    fs.move(part, path)
    return size


def remove(uri: str) -> None:
    """Delete a folder of the shared one that no later step reads."""
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type == pafs.FileType.Directory:
        fs.delete_dir(path)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


def word_count(text: Column) -> Column:
    """Words of a text; 0 where it is null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def id_crc(doc_id: Column) -> Column:
    """crc32 of an id written as text; that of the empty text where it is null."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
