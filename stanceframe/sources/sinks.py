"""Sinks (SNK-1..5): JSON/JSONL/CSV writers, request shards, incremental result appends.

All writes go under the shared folder the session names in
``spark.checkpoint.dir`` unless the caller passes a path.  Writers never
collect to the driver; the JSON "array of records" layout of the reference is
presentation only -- we write JSON lines, which every reader here accepts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanceframe.operators.batch import assign_shards
from stanceframe.session import scratch_path, stored
from stanceframe.sources.shards import write_shards

ARRAY_RECORDS = 50_000  # records that one array file holds


def _target(df: DataFrame, path: str | None, name: str) -> str:
    return path or scratch_path(df.sparkSession, name)


def write_json(df: DataFrame, path: str | None = None, mode: str = "overwrite") -> str:
    """SNK-1: records as JSON (one object per line, part files)."""
    p = _target(df, path, "json")
    df.write.mode(mode).json(p)
    return p


def write_jsonl(df: DataFrame, path: str | None = None, mode: str = "overwrite",
                compression: str | None = None) -> str:
    """SNK-2: JSON lines via ``to_json(struct(*))`` + text (keeps key order and nulls out)."""
    p = _target(df, path, "jsonl")
    w = df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    w.text(p)
    return p


def write_json_array(df: DataFrame, path: str | None = None) -> str:
    """SNK-1 (array layout): files that each hold one JSON array of up to ``ARRAY_RECORDS`` records."""
    p = _target(df, path, "jsonarray")
    _write_arrays(df.select(F.to_json(F.struct(*df.columns)).alias("j")), p)
    return p


def write_string_arrays(df: DataFrame, col: str, path: str | None = None) -> str:
    """Files that each hold one JSON array of up to ``ARRAY_RECORDS`` plain strings."""
    p = _target(df, path, "strarray")
    one = F.to_json(F.array(F.col(col)))  # '["value"]'
    _write_arrays(df.select(F.substring(one, F.lit(2), F.length(one) - 2).alias("j")), p)
    return p


def _write_arrays(items: DataFrame, path: str) -> None:
    """One file per block of consecutive JSON items ``j``: a block, not a partition, is what a task joins to one text."""
    n = F.monotonically_increasing_id()
    placed = stored(items.withColumn("_i", n), "array-items")   # numbered once, so a block never changes
    block = F.concat_ws("-", F.shiftright("_i", 33), F.floor((F.col("_i") - F.shiftleft(F.shiftright("_i", 33), 33)) / ARRAY_RECORDS))
    arrays = (placed.withColumn("block", block).groupBy("block")
              .agg(F.array_sort(F.collect_list(F.struct("_i", "j"))).alias("x"))
              .select("block", F.concat(F.lit("["), F.array_join(F.col("x.j"), ","), F.lit("]")).alias("value")))
    arrays.write.mode("overwrite").partitionBy("block").text(path)


def write_json_object(df: DataFrame, key: str, value: str, path: str | None = None) -> str:
    """One top-level JSON object ``{key: value}`` (question catalogue layout; one file).

    Only for small catalogues: the object is built in one task by definition."""
    p = _target(df, path, "jsonobject")
    obj = df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))).alias("value"))
    obj.coalesce(1).write.mode("overwrite").text(p)
    return p


def write_csv(df: DataFrame, path: str | None = None, mode: str = "overwrite") -> str:
    """SNK-3: CSV with a header row."""
    p = _target(df, path, "csv")
    df.write.mode(mode).option("header", True).csv(p)
    return p


def write_request_shards(requests: DataFrame, size: int = 100, path: str | None = None,
                         order: str = "req_no") -> str:
    """SNK-4: fixed-size numbered JSONL shards, a named file each, many from one task; a manifest beside them."""
    p = _target(requests, path, "shards")
    sharded = assign_shards(requests, size, order)
    return write_shards(sharded.select("shard", order, F.to_json(F.struct(*requests.columns)).alias("value")), p, order)


def append_results(batch: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """SNK-5: append only rows whose key is not in the table yet; the table is the state.

    Returns the rows that were appended.  Safe to re-run (idempotent per key); one
    writer per table at a time.  Only a missing table counts as the first write: any
    other failure to read it is raised, so nothing is appended twice.
    """
    spark = batch.sparkSession
    try:
        existing = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        new = batch
    else:
        new = batch.join(existing.select(*keys), keys, "left_anti")
    # written first, so the returned rows do not re-read the table they are appended to
    new = stored(new, "appended")
    new.write.mode("append").parquet(path)
    return new
