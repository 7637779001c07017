"""Files of given names (SNK-4 shards, SRC-7 pages): many from one task, committed together.

A Spark data source writer.  Rows ``(name, value)`` come sorted by name; a task writes each name's values to a
file of its own attempt's folder and reports the names.  Only when all tasks have succeeded are the files of the
reported attempts moved to their names and listed in a manifest beside the folder, so a lost executor, a repeated
task or a failed job leaves no half file under a name.  The folder is one that all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

ATTEMPTS = "_attempts"


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a folder that all executors share."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """An attempt's folder and its files: (name, values, bytes)."""
    attempt: str
    files: list[tuple[str, int, int]]


class NamedWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.end = options["path"].rstrip("/"), b"\n" if options.get("lines", "true") == "true" else b""
        self.overwrite = overwrite

    def write(self, iterator: Iterator) -> Written:
        files, base = open_fs(self.path)
        attempt = f"{base}/{ATTEMPTS}/{uuid.uuid4().hex}"
        files.create_dir(attempt, recursive=True)
        done: list[tuple[str, int, int]] = []
        name, out, values, size = None, None, 0, 0

        def close() -> None:
            if out is not None:
                out.close()
                done.append((name, values, size))

        for row in iterator:
            if row[0] != name or out is None:
                close()
                name, values, size = row[0], 0, 0
                out = files.open_output_stream(f"{attempt}/{name}", compression=None)
            value = (row[1] or "").encode() + self.end
            out.write(value)
            values, size = values + 1, size + len(value)
        close()
        return Written(attempt, done)

    def commit(self, messages: list[Written | None]) -> None:
        files, base = open_fs(self.path)
        names = sorted((name, f"{m.attempt}/{name}", values, size) for m in messages if m is not None for name, values, size in m.files)
        if len({name for name, *_ in names}) != len(names):
            raise ValueError("rows of one name came to several tasks")
        files.create_dir(base, recursive=True)
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(base)):
                if old.is_file:
                    files.delete_file(old.path)
        for name, source, *_ in names:
            files.move(source, f"{base}/{name}")
        with files.open_output_stream(f"{base}.manifest.jsonl") as out:
            for name, _, values, size in names:
                out.write(json.dumps({"file": name, "num_requests": values, "bytes": size, "status": "pending"}).encode() + b"\n")
        files.delete_dir(f"{base}/{ATTEMPTS}")

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = open_fs(self.path)
        for m in messages:
            if m is not None:
                files.delete_dir(m.attempt)


class NamedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def writer(self, schema, overwrite: bool) -> NamedWriter:
        return NamedWriter(self.options, overwrite)


def write_named(rows: DataFrame, path: str, order: Sequence[str] = (), lines: bool = True, tasks: int | None = None) -> str:
    """Rows ``(name, value)`` and the ``order`` columns: a file per name with its values in order, as lines or as they are;
    ``tasks`` tasks write them all.  A null value is written as an empty one; a name is a file's name, without folders."""
    rows.sparkSession.dataSource.register(NamedSource)
    n = tasks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartition(n, "name").sortWithinPartitions("name", *order)
    (placed.select(F.col("name").cast("string").alias("name"), F.col("value").cast("string").alias("value"))
     .write.format("named_files").mode("overwrite").option("lines", str(lines).lower()).save(path))
    return path


def write_shards(rows: DataFrame, path: str, order: str, prefix: str = "batch", tasks: int | None = None) -> str:
    """Rows ``(shard, value, order)``: one file ``<prefix>_<number>.jsonl`` per shard, its lines in order."""
    named = rows.select(F.format_string(f"{prefix}_%04d.jsonl", F.col("shard").cast("bigint")).alias("name"), "value", order)
    return write_named(named, path, [order], tasks=tasks)


def shard_number(file: Column) -> Column:
    return F.regexp_extract(file, r"_([0-9]+)\.jsonl$", 1).cast("bigint")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(batch_num, file, num_requests, bytes, status) of the shards of a folder."""
    t = spark.read.schema("file string, num_requests bigint, bytes bigint, status string").json(f"{path.rstrip('/')}.manifest.jsonl")
    return t.select(shard_number(F.col("file")).alias("batch_num"), "*")


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, value): the lines of all shards, numbered by their files' names; files are split and packed by Spark."""
    t = spark.read.text(path, lineSep="\n", pathGlobFilter="*.jsonl")
    return t.select(shard_number(F.col("_metadata.file_name")).alias("shard"), "value")
