"""Comparing each model's answer table with a reference table (CMP-1..8, WIN-6).

The reference ("human") is one fixed table joined to every other model by
equi-joins on question / question pair -- never a cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stanceframe.operators import pairs as PR
from stanceframe.operators.cells import common_questions, value_counts
from stanceframe.operators.ordering import dense_index
from stanceframe.operators.pairs import correlation_reliability
from stanceframe.operators.quality import model_quality
from stanceframe.session import materialize

EPS = 1e-10


def _models(cells: DataFrame, reference: str) -> DataFrame:
    return cells.select("model").distinct().where(F.col("model") != reference)


# --- CMP-1 -----------------------------------------------------------------------

def kl_js_by_question(cells: DataFrame, reference: str = "human", min_side: int = 10,
                      eps: float = EPS, vc: DataFrame | None = None) -> DataFrame:
    """KL(reference || model) and JS per common question with >= ``min_side`` answers each side.

    Support = union of values seen on either side (full outer via union + group);
    probabilities = (count + eps) renormalised; natural log.
    """
    # the value counts are tiny and read by four branches with different filters (no exchange
    # reuse), so write them once instead of re-aggregating the answers per branch
    vc = vc if vc is not None else materialize(value_counts(cells))
    ref = vc.where(F.col("model") == reference).select("question", "score", F.col("c").alias("ch"))
    oth = vc.where(F.col("model") != reference)
    mq = oth.select("model", "question").distinct()
    ref_m = mq.join(ref, "question").select("model", "question", "score", "ch", F.lit(0).cast("bigint").alias("cm"))
    mod = oth.join(ref.select("question").distinct(), "question", "left_semi") \
        .select("model", "question", "score", F.lit(0).cast("bigint").alias("ch"), F.col("c").alias("cm"))
    full = ref_m.unionByName(mod).groupBy("model", "question", "score") \
        .agg(F.sum("ch").alias("ch"), F.sum("cm").alias("cm"))
    w = Window.partitionBy("model", "question")
    x = (full.withColumn("nh", F.sum("ch").over(w))
         .withColumn("nm", F.sum("cm").over(w))
         .withColumn("k", F.count(F.lit(1)).over(w))
         .where((F.col("nh") >= min_side) & (F.col("nm") >= min_side)))
    ph = (F.col("ch") + eps) / (F.col("nh") + F.col("k") * eps)
    pm = (F.col("cm") + eps) / (F.col("nm") + F.col("k") * eps)
    x = x.withColumn("ph", ph).withColumn("pm", pm).withColumn("mid", (F.col("ph") + F.col("pm")) / 2)
    return x.groupBy("model", "question").agg(
        F.first("nh").cast("bigint").alias("n_reference"),
        F.first("nm").cast("bigint").alias("n_model"),
        F.count(F.lit(1)).cast("bigint").alias("support"),
        F.sum(F.col("ph") * F.log(F.col("ph") / F.col("pm"))).alias("kl_divergence"),
        (0.5 * F.sum(F.col("ph") * F.log(F.col("ph") / F.col("mid")))
         + 0.5 * F.sum(F.col("pm") * F.log(F.col("pm") / F.col("mid")))).alias("js_divergence"))


def kl_js_by_model(cells: DataFrame, reference: str = "human", min_side: int = 10,
                   per_question: DataFrame | None = None, vc: DataFrame | None = None) -> DataFrame:
    """Per model: n_common, n_compared, avg_kl_divergence, avg_js_divergence."""
    pq = per_question if per_question is not None else kl_js_by_question(cells, reference, min_side, vc=vc)
    cells = vc if vc is not None else cells
    common = common_questions(cells, reference).groupBy("model").agg(F.count(F.lit(1)).alias("n_common"))
    agg = pq.groupBy("model").agg(F.count(F.lit(1)).alias("n_compared"),
                                  F.avg("kl_divergence").alias("avg_kl_divergence"),
                                  F.avg("js_divergence").alias("avg_js_divergence"))
    return (_models(cells, reference).join(common, "model", "left").join(agg, "model", "left")
            .select("model",
                    F.coalesce("n_common", F.lit(0)).cast("bigint").alias("n_common"),
                    F.coalesce("n_compared", F.lit(0)).cast("bigint").alias("n_compared"),
                    "avg_kl_divergence", "avg_js_divergence"))


# --- CMP-2 / CMP-3 ----------------------------------------------------------------

def _restrict_to_common(mat: DataFrame, common: DataFrame) -> DataFrame:
    c1 = common.select("model", F.col("question").alias("question_1"))
    c2 = common.select("model", F.col("question").alias("question_2"))
    return mat.join(c1, ["model", "question_1"], "left_semi").join(c2, ["model", "question_2"], "left_semi")


def rv_coefficient(cells: DataFrame, reference: str = "human", min_n: int = 30,
                   matrix: DataFrame | None = None, vc: DataFrame | None = None) -> DataFrame:
    """RV = tr(AB)/sqrt(tr(AA) tr(BB)) over common questions, missing -> 0, diagonal included.

    The matrices are symmetric, so tr(XY) = sum(diag) + 2*sum(upper) over the
    sparse long form.  Fewer than 2 common questions or a zero denominator -> NULL.
    """
    mat = matrix if matrix is not None else materialize(PR.correlation_matrix(cells, min_n))
    cells = vc if vc is not None else cells
    common = common_questions(cells, reference)
    w = F.when(F.col("question_1") == F.col("question_2"), 1.0).otherwise(2.0)
    a = _restrict_to_common(mat.where(F.col("model") != reference), common) \
        .select("model", "question_1", "question_2", F.col("r").alias("a"), w.alias("w"))
    ref = mat.where(F.col("model") == reference).select("question_1", "question_2", F.col("r").alias("b"))
    b = _restrict_to_common(common.select("model", F.col("question").alias("question_1"))
                            .join(ref, "question_1"), common) \
        .select("model", "question_1", "question_2", "b", w.alias("w"))
    ab = a.join(b.drop("w"), ["model", "question_1", "question_2"]) \
        .groupBy("model").agg(F.sum(F.col("w") * F.col("a") * F.col("b")).alias("tr_ab"))
    aa = a.groupBy("model").agg(F.sum(F.col("w") * F.col("a") * F.col("a")).alias("tr_aa"))
    bb = b.groupBy("model").agg(F.sum(F.col("w") * F.col("b") * F.col("b")).alias("tr_bb"))
    nc = common.groupBy("model").agg(F.count(F.lit(1)).alias("n_common"))
    den = F.sqrt(F.coalesce("tr_aa", F.lit(0.0)) * F.coalesce("tr_bb", F.lit(0.0)))
    rv = F.when((F.coalesce("n_common", F.lit(0)) >= 2) & (den > 0),
                F.coalesce("tr_ab", F.lit(0.0)) / den)
    return (_models(cells, reference).join(nc, "model", "left").join(ab, "model", "left")
            .join(aa, "model", "left").join(bb, "model", "left")
            .select("model", rv.alias("rv_coefficient")))


def mantel_cells(cells: DataFrame, reference: str = "human", min_n: int = 30,
                 matrix: DataFrame | None = None) -> DataFrame:
    """Off-diagonal cells present in both matrices: (model, q1, q2, a, b)."""
    mat = matrix if matrix is not None else PR.correlation_matrix(cells, min_n)
    off = mat.where(F.col("question_1") < F.col("question_2"))
    a = off.where(F.col("model") != reference).select("model", "question_1", "question_2", F.col("r").alias("a"))
    b = off.where(F.col("model") == reference).select("question_1", "question_2", F.col("r").alias("b"))
    return a.join(b, ["question_1", "question_2"])


#: Rounds of the permutation, and the modulus of its keys (a prime, so that products of two keys fit 64 bits).
SHUFFLE_ROUNDS, KEY_MODULUS = 24, 2**31 - 1
#: Cells of a packed row and of the positions a task holds on either side (32 MB); repetitions of a task.
CHUNK, SUPER, REPS_A_TASK = 1 << 15, 1 << 22, 50


def permuted(pos: np.ndarray, n: int, rep: int, seed: int) -> np.ndarray:
    """Where positions of 0 .. n-1 go in repetition ``rep``: a keyed bijection for any n.

    Swap-or-not rounds: a key pairs each position x with key - x; both of a pair move or both stay, by a bit
    that depends on the larger of them.  No sort, and a repetition needs nothing but its number."""
    x, m = pos, KEY_MODULUS
    for r in range(SHUFFLE_ROUNDS):
        start = (rep * 48271 + seed * 69621 + r * 39373 + 1) % m
        k = (start * start + start * 16807 + r + 1) % m
        y = (k % n + n - x) % n
        t = ((np.maximum(x, y) + 1) % m * k + r + 1) % m
        x = np.where(t * t % m % 2 == 1, y, x)
    return x


def _permuted_sums(base: DataFrame, permutations: int, seed: int) -> DataFrame:
    """(model, rep, sab_perm): the sum of a_perm * b of every repetition, from cells (model, n, pos, ac, bc).

    Cells travel packed, a chunk of positions a row.  A task has a few repetitions of one model, a super block of
    positions to move and one of positions to meet: bounded memory for any n, and one number a repetition leaves it."""
    packed = (base.groupBy("model", "n", F.floor(F.col("pos") / CHUNK).alias("chunk"))
              .agg(F.array_sort(F.collect_list(F.struct("pos", "ac", "bc"))).alias("c"))
              .select("model", "n", "chunk", F.col("c.ac").alias("ac"), F.col("c.bc").alias("bc")))
    packed = materialize(packed)
    supers = F.floor((F.col("n") - 1) / SUPER).cast("int")
    own = F.floor(F.col("chunk") * CHUNK / SUPER).cast("int")
    parts = F.explode(F.sequence(F.lit(0), F.lit((permutations - 1) // REPS_A_TASK))).alias("reps")
    other = F.explode(F.sequence(F.lit(0), supers))
    moving = packed.select("model", "n", "chunk", F.lit(True).alias("moves"), F.col("ac").alias("v"), own.alias("i"), other.alias("j"))
    met = packed.select("model", "n", "chunk", F.lit(False).alias("moves"), F.col("bc").alias("v"), own.alias("j"), other.alias("i"))
    sides = moving.unionByName(met).select("*", parts)
    schema = pa.schema([("model", pa.string()), ("rep", pa.int64()), ("sab_perm", pa.float64())])

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        model, n, reps, _, j = (k.as_py() for k in key)
        table = table.sort_by("chunk")

        def side(moves: bool) -> tuple[np.ndarray, np.ndarray]:
            rows = table.filter(pc.equal(table["moves"], moves))
            values = [np.asarray(v.values) for v in rows["v"]]
            at = [c * CHUNK + np.arange(len(v)) for c, v in zip(rows["chunk"].to_pylist(), values, strict=True)]
            return np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0), *values])

        (pos, a), (_, b) = side(True), side(False)
        low = j * SUPER
        out = []
        numbers = range(reps * REPS_A_TASK, min((reps + 1) * REPS_A_TASK, permutations))
        for rep in numbers:
            to = permuted(pos, n, rep, seed) - low
            here = (to >= 0) & (to < len(b))
            out.append(float(a[here] @ b[to[here]]))
        return pa.table([pa.array([model] * len(out), pa.string()), pa.array(list(numbers), pa.int64()), pa.array(out, pa.float64())], schema=schema)

    sums = sides.groupBy("model", "n", "reps", "i", "j").applyInArrow(run, "model string, rep bigint, sab_perm double")
    return sums.groupBy("model", "rep").agg(F.sum("sab_perm").alias("sab_perm"))


def mantel_test(cells: DataFrame, reference: str = "human", min_n: int = 30, permutations: int = 1000,
                seed: int = 42, min_cells: int = 10, matrix: DataFrame | None = None) -> DataFrame:
    """CMP-3: Pearson r of the two upper triangles and its permutation p-value.

    The model's cell vector is permuted against the fixed reference vector
    (cells permuted freely, not matrix rows).  Repetition ``rep`` moves the cell at position i to
    ``permuted(i)``, so a retried task reproduces it.  Only sum(a_perm * b) per
    repetition is needed because sums and sums of squares are permutation-invariant.
    p = #(|r_perm| >= |r_obs|) / permutations.
    """
    mc = mantel_cells(cells, reference, min_n, matrix if matrix is not None
                      else materialize(PR.correlation_matrix(cells, min_n)))
    # positions over all models in one stored order, then within each model
    placed = dense_index(mc, ["model", "question_1", "question_2"], "at")
    per = placed.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.min("at").alias("first"))
    base = materialize(placed.join(per.where(F.col("n") >= min_cells), "model")
                       .select("model", "n", (F.col("at") - F.col("first")).alias("pos"), (F.col("a") - F.col("ma")).alias("ac"),
                               (F.col("b") - F.col("mb")).alias("bc")))
    stats = base.groupBy("model").agg(
        F.first("n").cast("bigint").alias("n_cells"),
        F.sum(F.col("ac") * F.col("bc")).alias("sab"),
        F.sum(F.col("ac") * F.col("ac")).alias("saa"),
        F.sum(F.col("bc") * F.col("bc")).alias("sbb"))
    stats = stats.withColumn("mantel_r", F.try_divide(F.col("sab"), F.sqrt(F.col("saa") * F.col("sbb"))))
    perm = _permuted_sums(base, permutations, seed)
    hits = (perm.join(stats.select("model", "saa", "sbb", "mantel_r"), "model")
            .withColumn("r_perm", F.try_divide(F.col("sab_perm"), F.sqrt(F.col("saa") * F.col("sbb"))))
            .groupBy("model")
            .agg(F.count_if(F.abs("r_perm") >= F.abs("mantel_r")).alias("hits")))
    out = stats.join(hits, "model", "left").select(
        "model", "n_cells", "mantel_r",
        F.when(F.col("mantel_r").isNotNull(), F.coalesce("hits", F.lit(0)) / F.lit(float(permutations)))
        .alias("mantel_p"))
    return _models(cells, reference).join(out, "model", "left")


def structural_similarity(cells: DataFrame, reference: str = "human", min_n: int = 30,
                          permutations: int = 1000, seed: int = 42,
                          matrix: DataFrame | None = None, vc: DataFrame | None = None) -> DataFrame:
    """CMP-4: RV coefficient and Mantel r / p per model."""
    mat = matrix if matrix is not None else materialize(PR.correlation_matrix(cells, min_n))
    rv = rv_coefficient(cells, reference, min_n, mat, vc=vc)
    mt = mantel_test(vc if vc is not None else cells, reference, min_n, permutations, seed, matrix=mat)
    return rv.join(mt.select("model", F.col("mantel_r").alias("mantel_corr"), "mantel_p"), "model", "left")


# --- CMP-5 -------------------------------------------------------------------------

def quality_metrics(cells: DataFrame, reference: str = "human", min_n: int = 30,
                    permutations: int = 1000, seed: int = 42) -> DataFrame:
    """CMP-5: one row per model: quality roll-up, correlation reliability, divergence and
    structure versus the reference (NULL for the reference itself)."""
    # two small aggregates feed every branch; the raw answers are read twice in total
    vc = materialize(value_counts(cells))
    pairs = materialize(PR.pair_moments(PR.pair_value_counts(cells, min_n)))
    mat = materialize(PR.correlation_matrix(cells, min_n, pairs, vc=vc))
    models = vc.select("model").distinct()
    mq = model_quality(cells, min_n, vc=vc)
    rel = correlation_reliability(cells, min_n, pairs, models=models)
    div = kl_js_by_model(cells, reference, vc=vc)
    st = structural_similarity(cells, reference, min_n, permutations, seed, mat, vc=vc)
    return (mq.join(rel, "model", "left").join(div, "model", "left").join(st, "model", "left"))


# --- CMP-6..8, WIN-6 -------------------------------------------------------------

# Compared metrics and whether lower is better.
COMPARE_METRICS = [
    ("pct_usable", False),
    ("avg_entropy", False),
    ("avg_effective_categories", False),
    ("avg_concentration", True),
    ("avg_kl_divergence", True),
    ("avg_js_divergence", True),
]


def find_model(models: DataFrame, target: str, keywords: Sequence[str] = ()) -> DataFrame:
    """CMP-7: first model containing ``target`` (case-insensitive), else the first containing
    each keyword in turn; "first" = model-name order.  One row (or none)."""
    low = F.lower(F.col("model"))
    prio = F.when(low.contains(target.lower()), F.lit(0))
    for i, k in enumerate(keywords):
        prio = prio.when(low.contains(k.lower()), F.lit(i + 1))
    cand = models.select("model", prio.alias("prio")).where(F.col("prio").isNotNull())
    return cand.agg(F.min_by("model", F.struct("prio", "model")).alias("model")).where(F.col("model").isNotNull())


def _unpivot(metrics: DataFrame, cols: Sequence[str]) -> DataFrame:
    return metrics.select("model", F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols])).alias("kv")) \
        .select("model", "kv.metric", "kv.value")


def compare_models(metrics: DataFrame, base: DataFrame, tuned: DataFrame,
                   reference: str = "human") -> DataFrame:
    """CMP-6: base vs tuned (vs reference) per metric: values, change, better flag.

    ``base``/``tuned`` are one-row DataFrames from ``find_model``.  ``better`` is
    NULL when either value is missing; an unchanged value counts as not better.
    """
    roles = (base.select(F.lit("base").alias("role"), "model")
             .unionByName(tuned.select(F.lit("tuned").alias("role"), "model"))
             .unionByName(metrics.select("model").where(F.col("model") == reference)
                          .select(F.lit("reference").alias("role"), "model")))
    long = _unpivot(metrics, [m for m, _ in COMPARE_METRICS]).join(roles, "model")
    wide = long.groupBy("metric").agg(
        F.max(F.when(F.col("role") == "base", F.col("value"))).alias("base_value"),
        F.max(F.when(F.col("role") == "tuned", F.col("value"))).alias("tuned_value"),
        F.max(F.when(F.col("role") == "reference", F.col("value"))).alias("reference_value"))
    dirs = metrics.sparkSession.createDataFrame(
        [(m, lb) for m, lb in COMPARE_METRICS], "metric string, lower_better boolean")
    change = F.col("tuned_value") - F.col("base_value")
    return (dirs.join(wide, "metric", "left")
            .select("metric", "lower_better", "base_value", "tuned_value", "reference_value",
                    change.alias("change"),
                    F.when(change.isNull(), F.lit(None).cast("boolean"))
                    .when(F.col("lower_better"), change < 0).otherwise(change > 0).alias("better")))


def compare_verdict(comparison: DataFrame) -> DataFrame:
    """CMP-6 summary: improved / regressed counts and verdict."""
    return comparison.agg(
        F.count_if(F.col("better")).cast("bigint").alias("n_improved"),
        F.count_if(~F.col("better")).cast("bigint").alias("n_regressed")).select(
        "n_improved", "n_regressed",
        F.when(F.col("n_improved") > F.col("n_regressed"), "improvement")
        .when(F.col("n_regressed") > F.col("n_improved"), "regression").otherwise("mixed").alias("verdict"))


ALL_MODELS_COLUMNS = ["model", "pct_usable", "avg_entropy", "avg_effective_categories",
                      "avg_concentration", "avg_kl_divergence", "avg_js_divergence"]


def all_models_table(metrics: DataFrame) -> DataFrame:
    """CMP-8: the all-model comparison columns that exist in the metrics table."""
    return metrics.select(*[c for c in ALL_MODELS_COLUMNS if c in metrics.columns])


RANKINGS = [("quality_score", False), ("pct_usable", False), ("avg_entropy", False), ("avg_kl_divergence", True)]


def model_rankings(metrics: DataFrame, reference: str = "human") -> DataFrame:
    """WIN-6: rank 1..n per ranking (quality, usable %, entropy desc; KL asc without the
    reference); missing values rank last, ties by model name."""
    long = _unpivot(metrics, [m for m, _ in RANKINGS])
    asc = F.col("metric").isin([m for m, a in RANKINGS if a])
    long = long.where(~(asc & ((F.col("model") == reference) | F.col("value").isNull())))
    key = F.when(asc, F.col("value")).otherwise(-F.col("value"))
    w = Window.partitionBy("metric").orderBy(key.asc_nulls_last(), F.col("model"))
    return long.select(F.col("metric").alias("ranking"), F.row_number().over(w).cast("bigint").alias("rank"),
                       "model", "value")
