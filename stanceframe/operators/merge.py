"""Joining profiles, survey answers and model answers (JOIN-1..4, JOIN-3, SET-4, AGG-17, AGG-18).

Answers stay long ``(key, question, score)``; maps are built only at the edge
(one per respondent, bounded by the number of questions).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanceframe.functions import text as T


def dedupe_last(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """JOIN-3: keep the whole last record per key (dict-overwrite semantics).

    ``max_by(struct(*), order)`` is a hash aggregate with partial aggregation,
    so a key holding a third of the rows is reduced map-side.  ``order`` (an input
    position) must be unique within a key for the choice to be deterministic.
    """
    rest = [c for c in df.columns if c not in keys]
    agg = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def last_record_rows(df: DataFrame, key: str, record: str) -> DataFrame:
    """Rows of the last record per key (records span several long rows)."""
    last = df.groupBy(key).agg(F.max(record).alias(record))
    return df.join(last, [key, record], "left_semi")


def _response_summary(answers: DataFrame, key: str | list[str], question: str = "question") -> DataFrame:
    """Per record: answer count, score sum and the answer map (bounded by the question catalogue).

    Of repeated questions of a record the last one by ``ord`` counts, where the answers have that column;
    without it the largest score, so that a retried task agrees."""
    keys = [key] if isinstance(key, str) else key
    value = F.max_by("score", "ord") if "ord" in answers.columns else F.max("score")
    one = answers.groupBy(*keys, question).agg(value.alias("score"))
    return one.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_responses"),
        F.sum("score").alias("score_sum"),
        F.map_from_entries(F.collect_list(F.struct(question, "score"))).alias("responses"))


def _no_responses():
    return F.create_map().cast("map<string,double>")


def merge_profiles_survey(profiles: DataFrame, survey: DataFrame) -> DataFrame:
    """JOIN-1: every profile (duplicates kept) with all its columns and its answers by slug A (empty if
    none), plus survey-only slugs with empty profile columns and ``survey_response_count``.

    ``survey``: long ``(philosopher, rec_pos, question, score[, ord])``; the last record
    per slug wins.
    """
    s = last_record_rows(survey, "philosopher", "rec_pos")
    summ = _response_summary(s, "philosopher")
    p = profiles.withColumn("slug", T.slug_from_profile_url(F.col("url")))
    matched = (p.join(summ, p.slug == summ.philosopher, "left")
               .select(*profiles.columns, "slug", F.lit("profile").alias("source"),
                       F.coalesce("n_responses", F.lit(0)).cast("bigint").alias("n_responses"),
                       F.coalesce("score_sum", F.lit(0.0)).alias("score_sum"),
                       F.coalesce("responses", _no_responses()).alias("responses"),
                       F.lit(None).cast("bigint").alias("survey_response_count")))
    only = (summ.join(p.select("slug").where(F.col("slug").isNotNull()).distinct(),
                      summ.philosopher == F.col("slug"), "left_anti")
            .select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in profiles.schema],
                    F.col("philosopher").alias("slug"), F.lit("survey_only").alias("source"),
                    "n_responses", "score_sum", "responses", F.col("n_responses").alias("survey_response_count")))
    return matched.unionByName(only)


def unmatched_survey(profiles: DataFrame, survey: DataFrame) -> DataFrame:
    """SET-4: survey slugs with no profile (left anti join on slug A)."""
    slugs = profiles.select(T.slug_from_profile_url(F.col("url")).alias("philosopher")).where(
        F.col("philosopher").isNotNull())
    return survey.select("philosopher").distinct().join(slugs, "philosopher", "left_anti")


def merge_survey_profiles(survey: DataFrame, profiles: DataFrame, marker: str, order: str = "_order") -> DataFrame:
    """JOIN-2: each survey record (``philosopher``, ``rec_pos``) LEFT JOIN profiles on slug B
    (last profile per slug by input ``order``); every record stays its own row and
    unmatched records are flagged ``matched = false``."""
    p = profiles.withColumn("slug", T.slug_after_marker(F.col("url"), marker)).where(F.col("slug").isNotNull())
    cols = [c for c in profiles.columns if c != order]
    p = dedupe_last(p.select("slug", *cols, order), ["slug"], order).drop(order)
    summ = _response_summary(survey, ["philosopher", "rec_pos"])
    j = summ.join(p, summ.philosopher == p.slug, "left")
    return j.select("philosopher", "rec_pos", *cols, "n_responses", "score_sum", "responses",
                    F.col("slug").isNotNull().alias("matched"))


def merge_model_profiles(records: DataFrame, cells: DataFrame, profiles: DataFrame,
                         persona_cols: Sequence[str] = ("phd_country",)) -> DataFrame:
    """JOIN-4: per respondent name in the model answers, with the answer map, LEFT JOIN profiles (all their
    columns) on the normalised name (last profile per name wins).  Unmatched names rebuild
    ``persona_cols`` from their *first* model record, ``matched = false``, ``source = 'llm'``.

    ``cells``: ``(philosopher_name, cell_key, score)``; ``records`` carry ``ord``.
    """
    summ = _response_summary(cells, "philosopher_name", "cell_key")
    rest = [c for c in profiles.columns if c not in ("name", "_order", *persona_cols)]
    pn = profiles.withColumn("_norm", T.normalize_name(F.col("name"))).where(F.col("_norm").isNotNull())
    pn = dedupe_last(pn.select("_norm", "name", *persona_cols, *rest, "_order"), ["_norm"], "_order")
    first = records.groupBy("philosopher_name").agg(
        F.min_by(F.struct(*persona_cols), F.col("ord")).alias("_first"))
    s = summ.withColumn("_norm", T.normalize_name(F.col("philosopher_name")))
    j = s.join(pn, "_norm", "left").join(first, "philosopher_name", "left")
    matched = F.col("name").isNotNull()
    cols = [F.when(matched, F.col(c)).otherwise(F.col(f"_first.{c}")).alias(c) for c in persona_cols]
    return j.select(F.coalesce(F.col("name"), F.col("philosopher_name")).alias("name"),
                    "n_responses", "score_sum", "responses", matched.alias("matched"),
                    F.when(matched, F.lit(None).cast("string")).otherwise(F.lit("llm")).alias("source"), *cols, *rest)


def merge_counts(merged: DataFrame, matched: str = "matched") -> DataFrame:
    """AGG-18: total, matched and unmatched rows."""
    return merged.agg(F.count(F.lit(1)).cast("bigint").alias("total"),
                      F.count_if(F.col(matched)).cast("bigint").alias("matched"),
                      F.count_if(~F.col(matched)).cast("bigint").alias("unmatched"))


def profile_coverage(details: DataFrame) -> DataFrame:
    """AGG-17: number and share of profiles with each field and with an error."""
    n = F.count(F.lit(1))

    def share(cond):
        return F.lit(100.0) * F.count_if(cond) / n
    spec = F.coalesce(F.size("areas_of_specialization"), F.lit(0)) > 0
    intr = F.coalesce(F.size("areas_of_interest"), F.lit(0)) > 0
    phd = F.coalesce(F.col("phd_institution"), F.lit("")) != ""
    err = F.coalesce(F.col("error"), F.lit("")) != ""
    return details.agg(n.cast("bigint").alias("n_profiles"),
                       F.count_if(spec).cast("bigint").alias("with_specialization"),
                       share(spec).alias("pct_specialization"),
                       F.count_if(intr).cast("bigint").alias("with_interest"), share(intr).alias("pct_interest"),
                       F.count_if(phd).cast("bigint").alias("with_phd"), share(phd).alias("pct_phd"),
                       F.count_if(err).cast("bigint").alias("with_error"), share(err).alias("pct_error"))
