"""Files in and out: candidates, reports, JSON lines, sidecars, checksums, tables of a report."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def open_table(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """SRC1: a stored table under its schema; columns that older files lack are null. A missing path raises."""
    reader = spark.read.schema(schema)
    try:
        spark.read.parquet(path).limit(0)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from None
        raise
    return reader.parquet(path)


def load_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """SRC6: (trace_id, body, file) of a folder of JSON files: the id within, else the file's stem; of equal ids the last path.

    Files that are no JSON stay, with a null body.
    """
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"))
    parsed = F.try_parse_json("value")
    own = F.try_variant_get(parsed, "$.trace_id", "string")
    rows = raw.select(F.coalesce(own, F.regexp_replace("file", r"\.json$", "")).alias("trace_id"), F.when(parsed.isNotNull(), F.col("value")).alias("body"), "file", "path")
    last = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.col("path").desc()))
    return rows.withColumn("_n", last).where("_n = 1").select("trace_id", "body", "file")


def scan_reports(spark: SparkSession, folder: str) -> DataFrame:
    """SRC7: (file, body) of all reports below a folder: JSON files but meta.json that parse and have an aggregate."""
    raw = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True, pathGlobFilter="*.json")
    raw = raw.select(F.col("value").alias("body"), F.col("_metadata.file_name").alias("file")).where("file != 'meta.json'")
    return raw.where(F.try_variant_get(F.try_parse_json("body"), "$.aggregate", "variant").isNotNull()).select("file", "body")


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """SRC8: rows of a JSON-lines file; blank lines are skipped, only the schema's columns are parsed."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", schema).alias("r")).select("r.*")
    return rows.limit(limit) if limit else rows


def write_jsonl(df: DataFrame, path: str, order: list[Column | str]) -> None:
    """SNK1: rows as JSON lines in files whose order is theirs; nulls are written, text stays as it is."""
    body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    df.orderBy(*order).select(body.alias("value")).write.mode("overwrite").text(path)


def check_output(path: str, protected: str = "data") -> None:
    """SNK4: reports do not go into the data folder."""
    if protected in os.path.normpath(path).split(os.sep):
        raise ValueError(f"{path} lies in the {protected} folder")


def write_json(record: dict, path: str) -> None:
    """SNK3, SNK4: a small record as a file that appears whole or not at all."""
    check_output(path)
    part = f"{path}.tmp"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(record, f, ensure_ascii=False, indent=1)
    os.replace(part, path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """PV1: (file, size, md5) of files, each read in pieces by a task; md5 is null where a file cannot be read."""

    def digest(batches):
        for b in batches:
            sums = []
            for uri in b.column("path").to_pylist():
                total = hashlib.md5()
                try:
                    fs, at = pafs.FileSystem.from_uri(uri)
                    with fs.open_input_file(at) as f:
                        while piece := f.read(1 << 22):
                            total.update(piece)
                    sums.append(total.hexdigest())
                except (OSError, ValueError):
                    sums.append(None)
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("size"), pa.array(sums, pa.string())], names=["file", "size", "md5"])

    listed = spark.read.format("binaryFile").load(path).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("size"))
    return listed.mapInArrow(digest, "file string, size long, md5 string")


def snapshot(df: DataFrame, path: str, keys: list[str]) -> int:
    """SNK8: the rows as a Parquet snapshot that is checked before it counts: as many rows as given, no null and no repeated key.

    Returns the rows. A snapshot that fails stays beside ``path`` for a look and raises ValueError.
    """
    spark, part = df.sparkSession, f"{path}.part"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(part)
    back = spark.read.parquet(part)
    none = F.lit(False)
    for k in keys:
        none = none | F.col(k).isNull()
    found = back.agg(F.count(F.lit(1)).alias("rows"), F.count_if(none).alias("nulls")).first()
    repeated = back.groupBy(*keys).count().where("count > 1").limit(1).count()
    if found["rows"] != seen.get["rows"] or found["nulls"] or repeated:
        raise ValueError(f"{part}: {found['rows']} rows of {seen.get['rows']}, {found['nulls']} null keys, repeated keys: {bool(repeated)}")
    fs, at = pafs.FileSystem.from_uri(path if "://" in path else f"file://{os.path.abspath(path)}")
    if fs.get_file_info(at).type == pafs.FileType.Directory:
        fs.delete_dir(at)
    fs.move(f"{at}.part", at)
    return found["rows"]


def push(spark: SparkSession, source: str, target: str) -> dict[str, int]:
    """SNK7: files of a folder to another where they differ by size or checksum; what the target has alone stays there.

    A pull is a push the other way round. Tasks copy; the driver gets three counts: pushed, skipped, only in the target.
    """
    uri = lambda p: (p if "://" in p else f"file://{os.path.abspath(p)}").rstrip("/")
    source, target = uri(source), uri(target)
    fs, at = pafs.FileSystem.from_uri(target)
    fs.create_dir(at, recursive=True)
    there = checksums(spark, target) if fs.get_file_info(pafs.FileSelector(at)) else spark.createDataFrame([], "file string, size long, md5 string")
    pairs = checksums(spark, source).alias("s").join(there.alias("t"), "file", "full").select("file", F.col("s.size").alias("a"), F.col("t.size").alias("b"), F.col("s.md5").alias("x"), F.col("t.md5").alias("y"))
    state = F.when(F.col("a").isNull(), "remote_only").when((F.col("a") == F.col("b")) & (F.col("x") == F.col("y")), "skipped").otherwise("pushed")

    def copy(batches):
        for b in batches:
            for file, state in zip(b.column("file").to_pylist(), b.column("state").to_pylist()):
                if state == "pushed":
                    pafs.copy_files(f"{source}/{file}", f"{target}/{file}")
            yield b

    done = pairs.select("file", F.coalesce(state, F.lit("pushed")).alias("state")).mapInArrow(copy, "file string, state string").groupBy("state").count().collect()
    return {"pushed": 0, "skipped": 0, "remote_only": 0} | {r["state"]: r["count"] for r in done}


def git_sha(folder: str = ".") -> str | None:
    """PV2: the commit of a folder, if it has one."""
    found = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True)
    return found.stdout.strip() or None


def sidecar(df: DataFrame, found: str, source: str, **settings) -> dict:
    """SNK2, PV3: provenance of an export: its counts in one aggregate, and its settings."""
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(found)).alias("found"), F.count_distinct(source).alias("sources")).first()
    return {"rows": r["rows"], "found": r["found"], "found_false": r["rows"] - r["found"], "sources": r["sources"], "git_sha": git_sha(), **settings}


def checkpoint_meta(path: str) -> dict | None:
    """PV5: meta.json beside a checkpoint or one level up."""
    for folder in (path, os.path.dirname(os.path.normpath(path))):
        file = os.path.join(folder, "meta.json")
        if os.path.exists(file):
            with open(file, encoding="utf-8") as f:
                return json.load(f)
    return None


def export_candidates(traces: DataFrame, path: str) -> None:
    """SNK6: reference traces as candidate rows: messages give way to their number."""
    cols = [c for c in traces.columns if c != "messages"]
    traces.select(*cols, F.size("messages").alias("n_messages")).write.mode("overwrite").json(path)


def markdown_table(rows: Iterable[dict], columns: list[str]) -> str:
    """SNK5: a few rows of a report as a Markdown table; missing values are ``--``."""
    cell = lambda v: "--" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows])


def report_label(run_id: Column, model_id: Column, file: Column, generic=("model", "final", "checkpoint")) -> Column:
    """A report's name: its run, else the last part of its model unless that is generic, else its file's stem."""
    base = F.regexp_extract(F.coalesce(model_id, F.lit("")), r"([^/]*)/?$", 1)
    return F.coalesce(F.nullif(run_id, F.lit("")), F.when((base != "") & ~base.isin(*generic), base), F.regexp_replace(file, r"\.json$", ""))


class PlacesSource(DataSource):
    """SRC9, SRC10: a harvest source over files of pages of results, one JSON array each: the seam where a live connector would sit."""

    @classmethod
    def name(cls) -> str:
        return "places_pages"

    def schema(self) -> str:
        return "page string, body string"

    def reader(self, schema):
        return _PlacesReader(self.options["path"])


class _PlacesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return [InputPartition(f) for f in sorted(os.listdir(self.path)) if f.endswith(".json")]

    def read(self, partition):
        with open(os.path.join(self.path, partition.value), encoding="utf-8") as f:
            for place in json.load(f):
                yield partition.value, json.dumps(place)


#: SRC11, UX5: harvesters by name.
SOURCES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "osm": lambda spark, path: spark.read.json(path),
    "places": lambda spark, path: spark.read.format("places_pages").option("path", path).load(),
}


def harvest(spark: SparkSession, source: str, path: str) -> DataFrame:
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}; one of {', '.join(SOURCES)}")
    spark.dataSource.register(PlacesSource)
    return SOURCES[source](spark, path)
