"""Question-pair statistics (JOIN-11, STAT-6, STAT-7, STAT-8, AGG-10, AGG-11).

Plan (per model):

1. Questions with fewer than ``min_n`` answers are pruned first (a pair can
   never have more co-answers than either question) -- a left-semi join on a
   tiny (model, question) count table that AQE broadcasts at run time.
2. The different (question, value) pairs of a model are its columns, numbered once in a
   stored table and cut into blocks of ``GRAM_COLUMNS``.  Cells become (respondent, column number).
3. A tile is a pair of column blocks.  Each task adds up the tile's part of the Gram matrix A'A
   of one-hot rows, respondents in dense blocks, one tile at a time: its memory is bounded by the
   block's width, however many questions and values there are.  With one block, the usual
   case, no cell travels twice.  What leaves a task are value-pair counts
   ``(model, q1, q2, v1, v2, c)``, summed over tasks.
   For continuous scores, whose pairs are nearly all different, the caller asks for the theta self join
   ``cells a JOIN cells b ON model, respondent AND a.q < b.q`` instead.
4. Pearson and Spearman come from weighted, centred moments of that count
   table.  Spearman ranks are *per pair* (midranks of the pair's co-answered
   rows), computed with RANGE windows over the pair's marginal counts -- exact
   for any data, and cheap because the pair partition is tiny.  All windows
   and the final aggregate share one partitioning by (model, q1, q2).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stanceframe.functions.pvalues import p_from_r
from stanceframe.session import materialize

PAIR_KEYS = ("model", "question_1", "question_2")
GRAM_BLOCK = 1024         # respondents per dense block
GRAM_COLUMNS = 1024       # columns of a block: a tile is a matrix of this width and height


def prune_questions(cells: DataFrame, min_n: int) -> DataFrame:
    """Keep cells whose question has at least ``min_n`` answers in its model."""
    if min_n <= 1:
        return cells
    qn = (cells.groupBy("model", "question").agg(F.count(F.lit(1)).alias("n"))
          .where(F.col("n") >= min_n).select("model", "question"))
    return cells.join(qn, ["model", "question"], "left_semi")


def pair_value_counts(cells: DataFrame, min_n: int = 30, method: str = "gram", width: int = GRAM_COLUMNS) -> DataFrame:
    """JOIN-11 as value-pair counts ``(model, q1, q2, v1, v2, c)`` over co-answering respondents.

    ``gram``, for answers on a scale: tiles of the Gram matrix of one-hot (question, value) columns, in numpy.
    No pair of answers is ever enumerated; a task holds one tile of ``width`` squared numbers.
    ``join``, for continuous scores (columns grow with the respondents): the theta self join
    on (model, respondent, q1 < q2), aggregated in the same stage.
    Both give the same counts; the caller says which one, whatever the size.
    """
    kept = prune_questions(cells.select("model", "respondent", "question", "score")
                           .where(F.col("score").isNotNull()), min_n)
    if method not in ("gram", "join"):
        raise ValueError(f"unknown method {method!r}")
    if method == "gram":
        return _gram_pair_counts(kept, width)
    a = kept.select("model", "respondent", F.col("question").alias("question_1"), F.col("score").alias("v1"))
    b = kept.select("model", "respondent", F.col("question").alias("question_2"), F.col("score").alias("v2"))
    joined = a.join(b, ["model", "respondent"]).where(F.col("question_1") < F.col("question_2"))
    return joined.groupBy(*PAIR_KEYS, "v1", "v2").agg(F.count(F.lit(1)).alias("c"))


def _columns(kept: DataFrame) -> DataFrame:
    """(model, question, v, col, cols): the model's columns numbered from 0, and how many there are."""
    from stanceframe.operators.ordering import dense_index
    placed = dense_index(kept.select("model", "question", F.col("score").cast("double").alias("v")).distinct(), ["model", "question", "v"], "_at")
    per = placed.groupBy("model").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    return placed.join(per, "model").select("model", "question", "v", (F.col("_at") - F.col("_first")).cast("int").alias("col"),
                                            (F.col("_last") - F.col("_first") + 1).cast("int").alias("cols"))


class _Tile:
    """Counts of one tile: columns of block ``i`` by columns of block ``j``."""

    def __init__(self, model: str, i: int, j: int, cols: int, width: int):
        self.model, self.i, self.j, self.cols, self.width = model, i, j, cols, width
        self.counts = np.zeros((self._width(i), self._width(j)))

    def _width(self, block: int) -> int:
        return min(self.width, self.cols - block * self.width)

    def add(self, respondent: np.ndarray, col: np.ndarray) -> None:
        """Cells sorted by respondent, of whole respondents."""
        row = np.cumsum(np.diff(respondent, prepend=respondent[0]) != 0)
        block, last = col // self.width, int(row[-1]) + 1
        for start in range(0, last, GRAM_BLOCK):
            lo, hi = np.searchsorted(row, [start, start + GRAM_BLOCK])

            def one_hot(of: int) -> np.ndarray:
                a = np.zeros((min(GRAM_BLOCK, last - start), self._width(of)), np.float32)
                here = np.flatnonzero(block[lo:hi] == of) + lo
                a[row[here] - start, col[here] - of * self.width] = 1.0
                return a

            left = one_hot(self.i)
            self.counts += left.T @ (left if self.i == self.j else one_hot(self.j))

    def rows(self) -> pa.RecordBatch:
        x, y = np.nonzero(self.counts)
        c = self.counts[x, y].astype(np.int64)
        x, y = x + self.i * self.width, y + self.j * self.width
        keep = x < y  # columns are in the order of questions
        return pa.RecordBatch.from_arrays([pa.array([self.model] * int(keep.sum()), pa.string()), pa.array(x[keep], pa.int32()), pa.array(y[keep], pa.int32()),
                                           pa.array(c[keep], pa.int64())], names=["model", "col_1", "col_2", "c"])


def _gram_pair_counts(kept: DataFrame, width: int) -> DataFrame:
    columns = _columns(kept)
    cells = kept.where(F.col("respondent").isNotNull()).select("model", F.xxhash64("respondent").alias("who"), F.col("respondent").cast("string").alias("respondent"), "question",
                        F.col("score").cast("double").alias("v")).join(columns, ["model", "question", "v"])
    block = F.floor(F.col("col") / width).cast("int")
    cells = cells.select("model", "who", "respondent", "col", block.alias("b"), F.explode(F.sequence(F.lit(0), F.floor((F.col("cols") - 1) / width).cast("int"))).alias("p"), "cols")
    cells = cells.select("model", F.least("b", "p").alias("i"), F.greatest("b", "p").alias("j"), "who", "respondent", "col", "cols")
    placed = cells.repartition("model", "i", "j", "who").sortWithinPartitions("model", "i", "j", "who", "respondent")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: _Tile | None = None
        carry: pa.Table | None = None  # cells of the last respondent, who may go on in the next batch

        def feed(t: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal tile
            names = t["model"].combine_chunks().dictionary_encode()
            model, i, j = names.indices.to_numpy(zero_copy_only=False), t["i"].to_numpy(), t["j"].to_numpy()
            cols = t["cols"].to_numpy()
            person = t["respondent"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
            col = t["col"].to_numpy()
            new = np.concatenate([[True], (model[1:] != model[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True]])
            cut = np.flatnonzero(new)
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                key = (names.dictionary[int(model[lo])].as_py(), int(i[lo]), int(j[lo]))
                if tile is None or (tile.model, tile.i, tile.j) != key:
                    if tile is not None:
                        yield tile.rows()
                    tile = _Tile(*key, int(cols[lo]), width)
                tile.add(person[lo:hi], col[lo:hi])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([carry, t]) if carry is not None else t
            if not len(t):
                continue
            last = t.slice(len(t) - 1)
            same = [pc.equal(t[c], last[c][0]) for c in ("model", "i", "j", "respondent")]
            tail = np.logical_and.reduce([np.asarray(x) for x in same])
            first = len(t) - int(np.argmin(tail[::-1])) if not tail.all() else 0
            carry = t.slice(first)
            if first:
                yield from feed(t.slice(0, first))
        if carry is not None and len(carry):
            yield from feed(carry)
        if tile is not None:
            yield tile.rows()

    counts = placed.mapInArrow(run, "model string, col_1 int, col_2 int, c bigint").groupBy("model", "col_1", "col_2").agg(F.sum("c").alias("c"))
    first = columns.select("model", F.col("col").alias("col_1"), F.col("question").alias("question_1"), F.col("v").alias("v1"))
    second = columns.select("model", F.col("col").alias("col_2"), F.col("question").alias("question_2"), F.col("v").alias("v2"))
    named = counts.join(first, ["model", "col_1"]).join(second, ["model", "col_2"])
    return named.where(F.col("question_1") != F.col("question_2")).select(*PAIR_KEYS, "v1", "v2", "c")


def pair_moments(pc: DataFrame) -> DataFrame:
    """n, Pearson r and Spearman r per pair from the value-pair count table."""
    wp = Window.partitionBy(*PAIR_KEYS)
    w1 = wp.orderBy("v1").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    w2 = wp.orderBy("v2").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    e1 = Window.partitionBy(*PAIR_KEYS, "v1")
    e2 = Window.partitionBy(*PAIR_KEYS, "v2")
    c = F.col("c")
    x = (pc.withColumn("n", F.sum(c).over(wp))
         .withColumn("m1", F.sum(c * F.col("v1")).over(wp) / F.col("n"))
         .withColumn("m2", F.sum(c * F.col("v2")).over(wp) / F.col("n"))
         .withColumn("eq1", F.sum(c).over(e1))
         .withColumn("eq2", F.sum(c).over(e2))
         .withColumn("r1", F.sum(c).over(w1) - F.col("eq1") + (F.col("eq1") + 1) / 2.0)
         .withColumn("r2", F.sum(c).over(w2) - F.col("eq2") + (F.col("eq2") + 1) / 2.0)
         .withColumn("mr", (F.col("n") + 1) / 2.0))
    d1, d2 = F.col("v1") - F.col("m1"), F.col("v2") - F.col("m2")
    g1, g2 = F.col("r1") - F.col("mr"), F.col("r2") - F.col("mr")
    agg = x.groupBy(*PAIR_KEYS).agg(
        F.first("n").alias("n"),
        F.sum(c * d1 * d1).alias("sxx"), F.sum(c * d2 * d2).alias("syy"), F.sum(c * d1 * d2).alias("sxy"),
        F.sum(c * g1 * g1).alias("rxx"), F.sum(c * g2 * g2).alias("ryy"), F.sum(c * g1 * g2).alias("rxy"))

    def corr(sxy, sxx, syy):
        r = F.try_divide(F.col(sxy), F.sqrt(F.col(sxx) * F.col(syy)))
        return F.when((F.col(sxx) > 0) & (F.col(syy) > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))

    return agg.select(*PAIR_KEYS, F.col("n").cast("bigint").alias("n_samples"),
                      corr("sxy", "sxx", "syy").alias("pearson_r"),
                      corr("rxy", "rxx", "ryy").alias("spearman_r"))


def pairwise_correlations(cells: DataFrame, min_n: int = 30) -> DataFrame:
    """STAT-6 + STAT-7: every pair with n >= min_n, Pearson and Spearman r with two-sided p."""
    m = pair_moments(pair_value_counts(cells, min_n)).where(F.col("n_samples") >= min_n)
    return m.select(*PAIR_KEYS, "n_samples",
                    "pearson_r", p_from_r("pearson_r", "n_samples").alias("pearson_p"),
                    "spearman_r", p_from_r("spearman_r", "n_samples").alias("spearman_p"),
                    F.abs("pearson_r").alias("abs_pearson_r"), F.abs("spearman_r").alias("abs_spearman_r"))


def pairwise_pearson(cells: DataFrame, min_n: int = 30) -> DataFrame:
    """STAT-6: Pearson r and p over each pair's co-answered respondents."""
    return pairwise_correlations(cells, min_n).select(
        *PAIR_KEYS, "n_samples", "pearson_r", "pearson_p", "abs_pearson_r")


def pairwise_spearman(cells: DataFrame, min_n: int = 30) -> DataFrame:
    """STAT-7: Spearman r (ranks re-taken per pair) and p."""
    return pairwise_correlations(cells, min_n).select(
        *PAIR_KEYS, "n_samples", "spearman_r", "spearman_p", "abs_spearman_r")


def diagonal(cells: DataFrame, min_n: int = 30, vc: DataFrame | None = None) -> DataFrame:
    """Diagonal of the correlation matrix: 1.0 for questions with n >= min_n and non-zero variance."""
    if vc is not None:
        q = vc.groupBy("model", "question").agg(F.sum("c").alias("n"), F.min("score").alias("lo"),
                                                 F.max("score").alias("hi"))
    else:
        q = (cells.where(F.col("score").isNotNull()).groupBy("model", "question")
             .agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")))
    return (q.where((F.col("n") >= min_n) & (F.col("hi") > F.col("lo")))
            .select("model", F.col("question").alias("question_1"), F.col("question").alias("question_2"),
                    F.col("n").cast("bigint").alias("n_samples"), F.lit(1.0).alias("r")))


def correlation_matrix(cells: DataFrame, min_n: int = 30, pairs: DataFrame | None = None,
                       vc: DataFrame | None = None) -> DataFrame:
    """STAT-8: sparse upper triangle incl. diagonal; an absent cell is missing (n < min_n or zero variance)."""
    p = pairs if pairs is not None else pair_moments(pair_value_counts(cells, min_n))
    off = (p.where((F.col("n_samples") >= min_n) & F.col("pearson_r").isNotNull())
           .select(*PAIR_KEYS, "n_samples", F.col("pearson_r").alias("r")))
    return off.unionByName(diagonal(cells, min_n, vc))


MEDIAN_BUCKETS = 1 << 16


def exact_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Exact median per group (mean of the two middle values), by counting, without a sort.

    Each group's range of values is cut into ``MEDIAN_BUCKETS`` even buckets, their rows are counted (at most
    that many counts a group leave the tasks), and the bucket that holds a middle place becomes the
    next range, until it holds one value.  Any spread of values ends: a range's ends never share a bucket.
    Nulls do not count; a group without values has no row."""
    rows = materialize(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")))
    names = [f"_k{i}" for i in range(len(keys))]
    rows = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), "_v")
    n = F.col("_n")
    middles = F.array_distinct(F.array(F.floor((n - 1) / 2), F.floor(n / 2)))
    goal = (rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
            .select(*names, F.posexplode(middles).alias("_m", "_at"), "_lo", "_hi"))
    goal = materialize(goal)
    while not goal.where("_lo < _hi").isEmpty():
        # halves, so that the range of any two numbers is a number
        share = F.try_divide(F.col("_v") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2)
        bucket = (F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), MEDIAN_BUCKETS - 1)
                  .otherwise(F.greatest(F.lit(0), F.least(F.lit(MEDIAN_BUCKETS - 1), F.floor(F.coalesce(share, F.lit(0.0)) * MEDIAN_BUCKETS)))))
        same = None
        for k in names:
            eq = F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}"))
            same = eq if same is None else same & eq
        inside = (rows.alias("r").join(goal.where("_lo < _hi").alias("g"), same if same is not None else F.lit(True))
                  .where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
                  .select(*(F.col(f"g.{k}").alias(k) for k in names), "_m", "_at", "_v", bucket.cast("int").alias("_b")))
        counts = inside.groupBy(*names, "_m", "_at", "_b").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.coalesce(F.sum("_c").over(Window.partitionBy(*names, "_m", "_at").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = (counts.withColumn("_before", before).where((F.col("_before") <= F.col("_at")) & (F.col("_at") < F.col("_before") + F.col("_c")))
                 .select(*names, "_m", (F.col("_at") - F.col("_before")).alias("_at"), "_lo", "_hi"))
        goal = materialize(goal.where("_lo >= _hi").unionByName(found))
    return goal.groupBy(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True))).agg(F.avg("_lo").alias(out))


def correlation_reliability(cells: DataFrame, min_n: int = 30, pairs: DataFrame | None = None,
                            models: DataFrame | None = None) -> DataFrame:
    """AGG-10: per model, over upper-triangle correlations (n >= min_n, r defined).

    mean/median |r|, population std of r, % r > .5, % r < -.5, % |r| > .5,
    signal-to-noise = mean|r| / std (0 when std is 0).  Models with no
    correlation keep a row of NULLs.
    """
    p = pairs if pairs is not None else pair_moments(pair_value_counts(cells, min_n))
    r = (p.where((F.col("n_samples") >= min_n) & F.col("pearson_r").isNotNull())
         .select("model", F.col("pearson_r").alias("r"), F.abs("pearson_r").alias("abs_r")))
    agg = r.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_correlations"),
        F.avg("abs_r").alias("mean_abs_r"),
        F.stddev_pop("r").alias("std_r"),
        F.count_if(F.col("r") > 0.5).alias("n_pos"),
        F.count_if(F.col("r") < -0.5).alias("n_neg"),
        F.count_if(F.col("abs_r") > 0.5).alias("n_ext"))
    med = exact_median(r, ["model"], "abs_r", "median_abs_r")
    pct = lambda c: F.lit(100.0) * F.col(c) / F.col("n_correlations")
    out = agg.join(med, "model", "left").select(
        "model", F.col("n_correlations").cast("bigint").alias("n_correlations"),
        "mean_abs_r", "median_abs_r", "std_r",
        pct("n_pos").alias("pct_strong_pos"), pct("n_neg").alias("pct_strong_neg"),
        pct("n_ext").alias("pct_extreme"),
        F.when(F.col("std_r") > 0, F.col("mean_abs_r") / F.col("std_r")).otherwise(F.lit(0.0)).alias("signal_to_noise"))
    ms = models if models is not None else cells.select("model").distinct()
    return ms.join(out, "model", "left")


def correlation_summary(cells: DataFrame, min_n: int = 30, corr: DataFrame | None = None) -> DataFrame:
    """AGG-11: per-model summary of the pairwise correlation table."""
    c = corr if corr is not None else pairwise_correlations(cells, min_n)
    agg = c.groupBy("model").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_correlations"),
        F.count("pearson_r").cast("bigint").alias("n_with_data"),
        F.avg("n_samples").alias("mean_sample_size"),
        F.avg("pearson_r").alias("mean_pearson_r"),
        F.stddev_samp("pearson_r").alias("std_pearson_r"),
        F.avg("abs_pearson_r").alias("mean_abs_pearson_r"),
        F.avg("spearman_r").alias("mean_spearman_r"),
        F.stddev_samp("spearman_r").alias("std_spearman_r"),
        F.count_if(F.col("pearson_p") < 0.001).cast("bigint").alias("sig_001"),
        F.count_if(F.col("pearson_p") < 0.01).cast("bigint").alias("sig_01"),
        F.count_if(F.col("pearson_p") < 0.05).cast("bigint").alias("sig_05"),
        F.count_if(F.col("pearson_r") > 0.5).cast("bigint").alias("strong_pos"),
        F.count_if(F.col("pearson_r") < -0.5).cast("bigint").alias("strong_neg"))
    med = exact_median(c, ["model"], "n_samples", "median_sample_size")
    return agg.join(med, "model", "left")
