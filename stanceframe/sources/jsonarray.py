"""One JSON array per file, read by many tasks (SRC-1, SRC-2, SRC-4).

A JSON array has no lines to split at, so a file is first cut at every place where a separator stands (``},`` for
records, ``,`` for plain items); Spark's text reader does that for each block of a file by itself.  Which
of these places divide two items of the array is a matter of what stands before them: inside a string or not,
and how deep.  Both are prefix sums.  A fragment's quotes give its parity, its brackets its change of depth (one figure
for each parity it may begin with); sums within a block are a window over that block, sums over blocks one over
a few rows per block of a file.  Fragments between two dividing places make a segment, which Spark's JSON reader parses
by itself; a segment holds one item, or several where the writer put spaces between separator signs.

No row, no task and no window holds a file: at most a block, or one item.  A file that is not an array
is parsed whole, as Spark does; an invalid segment gives no item and leaves the others alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stanceframe.session import stored

RECORDS, ITEMS = "},", ","
_BUCKET = 4096  # segments whose places are counted in one window
_SPACE = " \t\r\n﻿"


def _net(text: Column) -> Column:
    """Opening less closing brackets."""
    return F.length(F.translate(text, "]}", "")) - F.length(F.translate(text, "[{", ""))


def _fragments(spark: SparkSession, path: str, separator: str, glob: str | None) -> DataFrame:
    """(file_path, block, at, value, q, d0, d1, opens): parity of quotes, change of depth if begun outside / inside a string,
    whether an array opens at its start.

    ``at`` is ascending in a block.  The table is stored, since what is numbered must be read back the same."""
    raw = spark.read.text(path, lineSep=separator, pathGlobFilter=glob).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    # an escaped sign is two signs, neither a quote nor a bracket; no backslash stands before a separator
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    x = raw.withColumn("parts", parts)
    nets = F.transform("parts", _net)

    def every_second(first: int) -> Column:
        return F.aggregate(F.filter("nets", lambda _, i: i % 2 == first), F.lit(0), lambda s, v: s + v)

    x = x.withColumn("nets", nets).select("file_path", "block", "at", "value", ((F.size("parts") - 1) % 2).alias("q"),
                                          every_second(0).alias("d0"), every_second(1).alias("d1"),
                                          F.ltrim("value", F.lit(_SPACE)).startswith("[").alias("opens"))
    return stored(x, "json-fragments")


def _before(x: Column | str, *by: str, order: Sequence[str]) -> Column:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(x).over(w), F.lit(0))


def segments(spark: SparkSession, path: str, separator: str = RECORDS, glob: str | None = None) -> DataFrame:
    """(file_path, seg, value): the items of each file's array as JSON text, without the array's own brackets."""
    frag = _fragments(spark, path, separator, glob)
    blk = ("file_path", "block")

    def in_block(x: Column | str) -> Column:
        return _before(x, *blk, order=["at"])

    # what the separator itself changes where it stands outside a string: } closes
    sep = sum(c in "[{" for c in separator) - sum(c in "]}" for c in separator)
    x = frag.withColumn("p", in_block("q") % 2)
    ends = (F.col("p") + F.col("q")) % 2  # parity behind the fragment, if the block begins outside a string
    x = x.withColumn("c0", F.when(F.col("p") == 0, F.col("d0")).otherwise(F.col("d1")) + F.when(ends == 0, sep).otherwise(0))
    x = x.withColumn("c1", F.when(F.col("p") == 0, F.col("d1")).otherwise(F.col("d0")) + F.when(ends == 1, sep).otherwise(0))
    x = x.withColumn("b0", in_block("c0")).withColumn("b1", in_block("c1"))
    blocks = x.groupBy(*blk).agg(F.sum("q").alias("q"), F.sum("c0").alias("t0"), F.sum("c1").alias("t1"), F.min_by("opens", "at").alias("opens"))
    blocks = blocks.withColumn("is_array", F.first("opens").over(Window.partitionBy("file_path").orderBy("block")))
    blocks = blocks.withColumn("odd", _before("q", "file_path", order=["block"]) % 2)
    blocks = blocks.withColumn("depth", _before(F.when(F.col("odd") == 0, F.col("t0")).otherwise(F.col("t1")), "file_path", order=["block"])).select(*blk, "odd", "depth", "is_array")
    x = x.join(blocks, list(blk))
    depth = F.col("depth") + F.when(F.col("odd") == 0, F.col("b0") + F.col("c0")).otherwise(F.col("b1") + F.col("c1"))
    outside = (F.col("odd") + F.col("p") + F.col("q")) % 2 == 0
    x = x.withColumn("cut", F.when(F.col("is_array") & outside & (depth == 1), 1).otherwise(0)).withColumn("seg", in_block("cut"))
    first = x.groupBy(*blk).agg(F.sum("cut").alias("cuts")).withColumn("before", _before("cuts", "file_path", order=["block"])).select(*blk, "before")
    x = x.join(first, list(blk)).withColumn("seg", F.col("seg") + F.col("before"))
    # a segment's fragments within a block first, then the few that reach over blocks
    here = x.groupBy(*blk, "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda f: f["value"]), separator).alias("v"),
                                      F.max("cut").alias("cut"), F.first("is_array").alias("is_array"))
    whole = here.groupBy("file_path", "seg").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "v"))), lambda f: f["v"]), separator).alias("v"),
                                                 F.max("cut").alias("cut"), F.first("is_array").alias("is_array"))
    # a dividing place stands behind the bracket that its separator begins with; the file's last segment has the array's end
    closed = F.when(F.col("cut") == 1, F.concat("v", F.lit(separator[:-1]))).otherwise(F.regexp_replace("v", r"\][ \t\r\n]*$", ""))
    begun = F.when(F.col("seg") == 0, F.regexp_replace("w", r"^[ \t\r\n\x{feff}]*\[", "")).otherwise(F.col("w"))
    return whole.withColumn("w", closed).select("file_path", F.col("seg").cast("bigint").alias("seg"), F.when(F.col("is_array"), begun).otherwise(F.col("v")).alias("value"))


def array_items(spark: SparkSession, path: str, item: T.DataType, separator: str = RECORDS, glob: str | None = None) -> DataFrame:
    """(file_path, pos, item): every item of every file's array, numbered from 0 in its file."""
    seg = segments(spark, path, separator, glob)
    parsed = stored(seg.select("file_path", "seg", F.from_json(F.concat(F.lit("["), "value", F.lit("]")), T.ArrayType(item)).alias("items")), "json-items")
    # items before a segment: within a bucket of segments, then over a file's buckets
    sizes = parsed.select("file_path", "seg", F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0)).alias("n"),
                          F.floor(F.col("seg") / _BUCKET).alias("bucket"))
    inner = sizes.withColumn("low", _before("n", "file_path", "bucket", order=["seg"]))
    high = sizes.groupBy("file_path", "bucket").agg(F.sum("n").alias("n")).withColumn("high", _before("n", "file_path", order=["bucket"])).select("file_path", "bucket", "high")
    start = inner.join(high, ["file_path", "bucket"]).select("file_path", "seg", (F.col("low") + F.col("high")).alias("start"))
    return (parsed.join(start, ["file_path", "seg"]).select("file_path", "start", F.posexplode("items").alias("k", "item"))
            .select("file_path", (F.col("start") + F.col("k")).cast("bigint").alias("pos"), "item"))
