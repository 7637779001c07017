"""Per-question and per-model answer quality (AGG-6, AGG-7, AGG-8, AGG-9).

Everything derives from one value-count table ``(model, question, score, c)``:
its partial aggregation runs map-side, so the shuffle carries at most
(#partitions x #questions x #distinct values) rows regardless of respondents,
and a question holding a third of all answers costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stanceframe.operators.cells import value_counts

ZERO_VAR_EPS = 1e-10


def _moments_from_counts(vc: DataFrame, keys=("model", "question")) -> DataFrame:
    """n, mean, centred second moment, entropy pieces from value counts (one window + agg)."""
    w = Window.partitionBy(*keys)
    x = (vc.withColumn("n", F.sum("c").over(w))
         .withColumn("mean", F.sum(F.col("c") * F.col("score")).over(w) / F.col("n")))
    p = F.col("c") / F.col("n")
    return (x.groupBy(*keys)
            .agg(F.first("n").alias("n"),
                 F.count(F.lit(1)).alias("unique_values"),
                 F.first("mean").alias("mean"),
                 F.sum(F.col("c") * (F.col("score") - F.col("mean")) ** 2).alias("m2"),
                 (-F.sum(p * F.log2(p))).alias("entropy_raw"),
                 F.max("c").alias("max_c")))


def question_quality(cells: DataFrame, min_n: int = 30, vc: DataFrame | None = None) -> DataFrame:
    """AGG-6/7/8: one row per (model, question) with at least ``min_n`` answers.

    Columns: n, unique_values, variance & std (ddof 1), mean, cv (0 when mean is 0),
    entropy (bits, 0 when n < 2), max_entropy, normalized_entropy,
    effective_categories = 2^entropy, concentration = top frequency / n,
    is_zero_var (variance < 1e-10), is_low_var (unique <= 2).
    """
    m = _moments_from_counts(vc if vc is not None else value_counts(cells)).where(F.col("n") >= min_n)
    var = F.try_divide(F.col("m2"), (F.col("n") - 1).cast("double"))
    ent = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.col("entropy_raw") + F.lit(0.0))
    max_ent = F.when(F.col("unique_values") > 1, F.log2(F.col("unique_values").cast("double"))).otherwise(F.lit(0.0))
    return (m.select(
        "model", "question",
        F.col("n").cast("bigint").alias("n"),
        F.col("unique_values").cast("bigint").alias("unique_values"),
        var.alias("variance"),
        F.sqrt(var).alias("std"),
        F.col("mean"),
        ent.alias("entropy"),
        max_ent.alias("max_entropy"),
        F.col("max_c"))
        .select(
            "model", "question", "n", "unique_values", "variance", "std", "mean",
            F.when(F.col("mean") != 0, F.col("std") / F.col("mean")).otherwise(F.lit(0.0)).alias("cv"),
            "entropy", "max_entropy",
            F.when(F.col("max_entropy") > 0, F.col("entropy") / F.col("max_entropy")).otherwise(F.lit(0.0))
            .alias("normalized_entropy"),
            F.pow(F.lit(2.0), F.col("entropy")).alias("effective_categories"),
            (F.col("max_c") / F.col("n")).alias("concentration"),
            (F.col("variance") < ZERO_VAR_EPS).alias("is_zero_var"),
            (F.col("unique_values") <= 2).alias("is_low_var")))


def question_entropy(cells: DataFrame, min_n: int = 2) -> DataFrame:
    """AGG-7/8 alone: entropy, effective categories, max and normalised entropy per question."""
    q = question_quality(cells, min_n=min_n)
    return q.select("model", "question", "n", "unique_values", "entropy",
                    "effective_categories", "max_entropy", "normalized_entropy")


def model_quality(cells: DataFrame, min_n: int = 30, question_metrics: DataFrame | None = None,
                  vc: DataFrame | None = None) -> DataFrame:
    """AGG-9: per-model roll-up of ``question_quality`` with the composite score.

    quality_score = 0.30*entropy_score + 0.25*variance_score + 0.20*diversity_score
    + 0.25*concentration_score, where entropy_score = 100*avg normalised entropy,
    variance_score = min(100, avg variance/0.25*100), diversity_score =
    min(100, (avg unique - 1)/4*100) and concentration_score = (1 - avg concentration)*100.
    A model without qualifying questions keeps a row with NULL metrics.
    """
    if vc is None and question_metrics is None:
        from stanceframe.session import materialize
        vc = materialize(value_counts(cells))   # read twice below: metrics and the model list
    qm = question_metrics if question_metrics is not None else question_quality(cells, min_n, vc)
    prob = F.col("is_zero_var") | F.col("is_low_var")
    agg = (qm.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.count_if(~prob).alias("n_usable"),
        F.count_if(F.col("is_zero_var")).alias("n_zero_var"),
        F.count_if(F.col("is_low_var")).alias("n_low_var"),
        F.count_if(prob).alias("n_problematic"),
        F.avg("entropy").alias("avg_entropy"),
        F.avg("normalized_entropy").alias("avg_normalized_entropy"),
        F.avg("effective_categories").alias("avg_effective_categories"),
        F.avg("variance").alias("avg_variance"),
        F.avg("std").alias("avg_std"),
        F.avg("cv").alias("avg_cv"),
        F.avg("unique_values").alias("avg_unique_values"),
        F.avg("concentration").alias("avg_concentration")))
    pct = lambda c: (F.lit(100.0) * F.col(c) / F.col("n_questions"))
    score = (F.lit(0.30) * (F.col("avg_normalized_entropy") * 100)
             + F.lit(0.25) * F.least(F.col("avg_variance") / 0.25 * 100, F.lit(100.0))
             + F.lit(0.20) * F.least((F.col("avg_unique_values") - 1) / 4 * 100, F.lit(100.0))
             + F.lit(0.25) * ((F.lit(1.0) - F.col("avg_concentration")) * 100))
    rolled = agg.select(
        "model",
        F.col("n_questions").cast("bigint").alias("n_questions"),
        F.col("n_usable").cast("bigint").alias("n_usable"),
        pct("n_usable").alias("pct_usable"),
        pct("n_zero_var").alias("pct_zero_var"),
        pct("n_low_var").alias("pct_low_var"),
        pct("n_problematic").alias("pct_problematic"),
        "avg_entropy", "avg_normalized_entropy", "avg_effective_categories", "avg_variance",
        "avg_std", "avg_cv", "avg_unique_values", "avg_concentration",
        score.alias("quality_score"))
    models = (vc if vc is not None else cells).select("model").distinct()
    return models.join(rolled, "model", "left")
