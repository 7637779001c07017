"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stanceframe.session import stored  # noqa: F401  (shared by the operators)

#: A word of the shingle and mixing operators: a run without space or tab..carriage return.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fold kept from learning: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> list[tuple[str, int]]:
    """At most ``per_class`` training texts of each class, outside the held-out fold.

    The sample is the rows with the smallest md5 of their id among those that ``docs`` holds, so it is the
    same on every run and labels of other documents take no place in it.
    ``per_class`` bounds what reaches the driver, whatever the size of the tables.  Ids, languages and
    sources are used to join and split only; only the text is returned.  Rows without label or id
    are left out; an id that occurs twice in ``labels`` counts once, with its largest label."""
    there = docs.select("doc_id").distinct()  # ids only, no texts
    lab = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
           .join(there, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
           .withColumn("_h", F.md5(F.col("doc_id").cast("string").cast("binary"))))
    # each class: the smallest hashes, taken in the executors before anything reaches the driver
    picked = None
    for y in (0, 1):
        part = lab.where(F.col("_y") == y).orderBy("_h", "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    picked = picked.select(F.col("doc_id").alias("_id"), "_y", "_h")
    rows = (docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))
            .join(F.broadcast(picked), "_id")  # 2 * per_class narrow rows at most
            .groupBy("_id").agg(F.first("_y").alias("_y"), F.first("_h").alias("_h"), F.max("_t").alias("_t"))
            .collect())
    rows.sort(key=lambda r: (r["_h"], r["_id"]))
    return [(r["_t"], r["_y"]) for r in rows]


_CACHES: dict[str, list[dict]] = {}


def register_cache(owner: str, table: dict) -> dict:
    """A table that an operator keeps in a worker process between its tasks."""
    _CACHES.setdefault(owner, []).append(table)
    return table


def free_other_caches(owner: str) -> None:
    """At the start of a task: empty what other operators' tasks left in this worker process, and give the
    memory that they freed back to the system (allocators keep it otherwise, and workers outlive their tasks)."""
    for name, tables in _CACHES.items():
        if name != owner:
            for t in tables:
                t.clear()
    release_memory()


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def small_batches(batches, rows: int = 1000):
    """Arrow batches cut to at most ``rows`` rows, so that few rows stand in memory as Python objects."""
    for batch in batches:
        for lo in range(0, len(batch), rows):
            yield batch.slice(lo, rows)


def batches_of(texts: list[str], max_chars: int):
    """Consecutive slices (lo, hi) of texts of about ``max_chars`` characters, one text at least."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > max_chars:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)
