"""Dense 0-based positions in a total order, computed without a single-task window.

``row_number() OVER (ORDER BY ...)`` with no partition moves every row into one task.  Instead the rows are
range-partitioned and sorted once and written, with their partition number and their place in it, to
the shared folder.  Partition counts, offsets and positions are all read from that one stored table, so
they cannot disagree: a range partitioning computed twice may sample different bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stanceframe.session import stored


def dense_index(df: DataFrame, order_cols: Sequence[str], out: str = "pos",
                num_partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: 0, 1, 2, ... in the order of ``order_cols``.

    Rows that tie in all order columns get neighbouring positions in the order in which they were written;
    add a tiebreaker where that order must not matter.  ``df`` is evaluated once."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    # monotonically_increasing_id = (partition id << 33) + index within the partition
    placed = (df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
              .withColumn("_mid", F.monotonically_increasing_id())
              .withColumn("_pid", F.shiftright("_mid", 33)))
    placed = stored(placed, "order")
    counts = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: at most num_partitions rows
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")
                                                     .rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    return (placed.join(F.broadcast(offsets), "_pid")
            .withColumn(out, (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_mid")
                              - F.shiftleft(F.col("_pid"), 33)).cast("bigint"))
            .drop("_pid", "_mid", "_off"))
