"""Long response cells: dedupe, value counts, matrix views (AGG-1..4, JOIN-9, SET-3).

The canonical shape is ``(model, respondent, question, score)`` with one row
per cell; an absent row means "missing".  Wide pivots are an export only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanceframe.functions import text as T

CELL_KEYS = ("model", "respondent", "question")


def first_valid_cells(answers: DataFrame, keys: Sequence[str] = CELL_KEYS,
                      value: str = "score", order: str = "ord") -> DataFrame:
    """AGG-3: first non-NULL value per cell key, "first" by the order column.

    ``min_by`` is a hash aggregate with map-side partial aggregation, so a hot
    key is collapsed before the shuffle.  ``order`` must be unique within a key
    (an input position) for the choice to be deterministic.
    """
    return (answers.where(F.col(value).isNotNull())
            .groupBy(*keys)
            .agg(F.min_by(F.col(value), F.col(order)).alias(value)))


def last_value_cells(answers: DataFrame, keys: Sequence[str] = CELL_KEYS,
                     value: str = "score", order: str = "ord") -> DataFrame:
    """Last value per key by order (dict-overwrite semantics)."""
    return answers.groupBy(*keys).agg(F.max_by(F.col(value), F.col(order)).alias(value))


def normalize_cells(answers: DataFrame, question: str = "question",
                    keys: Sequence[str] = ("model", "respondent"),
                    value: str = "score", order: str = "ord") -> DataFrame:
    """AGG-4: normalise question names (EXP-5); on collision the last value wins."""
    norm = answers.withColumn(question, T.normalize_question(F.col(question)))
    return last_value_cells(norm, (*keys, question), value, order)


def value_counts(cells: DataFrame, keys: Sequence[str] = ("model", "question"),
                 value: str = "score") -> DataFrame:
    """Counts per (keys, value); the shared input of entropy, concentration and KL/JS."""
    return (cells.where(F.col(value).isNotNull())
            .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c")))


def response_matrix(cells: DataFrame, model: str | None = None,
                    questions: Sequence[str] | None = None) -> DataFrame:
    """AGG-1: wide respondents x questions matrix (export only; analysis stays long).

    ``questions`` fixes the column list (sorted); passing it avoids the extra
    distinct job that ``pivot`` would otherwise run to discover the columns.
    """
    df = cells if model is None else cells.where(F.col("model") == model)
    keys = ["respondent"] if model is not None else ["model", "respondent"]
    piv = df.groupBy(*keys)
    piv = piv.pivot("question", sorted(questions)) if questions is not None else piv.pivot("question")
    return piv.agg(F.first("score"))


def missing_pct(cells: DataFrame) -> DataFrame:
    """AGG-2: percentage of the respondents x questions matrix that is missing, per model."""
    return (cells.groupBy("model")
            .agg(F.count(F.lit(1)).alias("n_cells"),
                 F.count_distinct("respondent").alias("n_respondents"),
                 F.count_distinct("question").alias("n_questions"))
            .select("model", "n_cells", "n_respondents", "n_questions",
                    (F.lit(100.0) * (F.lit(1.0) - F.col("n_cells")
                                     / (F.col("n_respondents") * F.col("n_questions")))).alias("missing_pct")))


def question_sets(cells: DataFrame) -> DataFrame:
    """Distinct (model, question) pairs (a question "exists" for a model if any cell does)."""
    return cells.select("model", "question").distinct()


def common_questions(cells: DataFrame, reference: str = "human") -> DataFrame:
    """JOIN-9 / SET-3: questions each model shares with the reference model."""
    from stanceframe.session import materialize
    qs = materialize(question_sets(cells))   # tiny, read by both sides of the semi join
    ref = qs.where(F.col("model") == reference).select("question")
    return (qs.where(F.col("model") != reference)
            .join(ref, "question", "left_semi")
            .select("model", "question"))


def distinct_features(features: DataFrame) -> DataFrame:
    """AGG-5: distinct feature values per feature type and how many respondents carry each."""
    return (features.select("respondent", "feature_type", "feature").distinct()
            .groupBy("feature_type", "feature")
            .agg(F.count(F.lit(1)).alias("n_respondents")))
