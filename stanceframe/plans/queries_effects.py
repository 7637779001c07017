"""Registered feature-effect queries (STAT-1..5, STAT-9, AGG-5, AGG-12..14, TOP-1/2).

The oracle SQL is deliberately brute force: it materialises, for every
(feature, question), each answering respondent with a has-feature flag and
computes both groups, midranks (window ``rank``) and ties directly.
"""

from __future__ import annotations

from stanceframe.operators import effects as EF
from stanceframe.operators.cells import distinct_features
from stanceframe.plans.queries_analytics import MIN_N, load_cells, pairs_cte
from stanceframe.plans.registry import register
from stanceframe.plans.sqlfun import sql_p_from_r, sql_p_from_z
from stanceframe.sources import fixtures as FX


def _bh(src: str, p: str, out: str, name: str) -> str:
    return f"""
, {name}_r AS (SELECT *, row_number() OVER (PARTITION BY model, feature_type ORDER BY coalesce({p}, 1.0)) AS _rk,
                      count(*) OVER (PARTITION BY model, feature_type) AS _m FROM {src}),
  {name} AS (SELECT * EXCLUDE (_rk, _m),
                    least(1.0, min(coalesce({p}, 1.0) * _m / _rk) OVER (PARTITION BY model, feature_type ORDER BY _rk
                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {out}
             FROM {name}_r)
"""


def effects_cte(members_sql: str, with_mw: bool, prefix: str, min_count: int = 5) -> str:
    mw_cols = ""
    if with_mw:
        mw_cols = (", u1 AS mannwhitney_u, CASE WHEN z IS NULL OR z <= 0 THEN 1.0 ELSE "
                   + sql_p_from_z("z") + " END AS mannwhitney_p")
    s = f"""
, {prefix}_feats AS ({members_sql}),
  {prefix}_uni AS (SELECT DISTINCT c.model, f.feature_type, f.feature FROM cells c JOIN {prefix}_feats f USING (respondent)),
  {prefix}_bf AS (SELECT u.model, u.feature_type, u.feature, c.question, c.score, f.respondent IS NOT NULL AS flag
         FROM {prefix}_uni u JOIN cells c ON c.model = u.model
         LEFT JOIN {prefix}_feats f ON f.respondent = c.respondent AND f.feature_type = u.feature_type
                                   AND f.feature = u.feature),
  {prefix}_bfr AS (SELECT *, rank() OVER (PARTITION BY model, feature_type, feature, question ORDER BY score)
                          + (count(*) OVER (PARTITION BY model, feature_type, feature, question, score) - 1) / 2.0 AS midrank
                   FROM {prefix}_bf),
  {prefix}_ties AS (SELECT model, feature_type, feature, question, sum(t * t * t - t) AS ties FROM (
                      SELECT model, feature_type, feature, question, score, count(*) AS t FROM {prefix}_bf GROUP BY ALL)
                    GROUP BY ALL),
  {prefix}_eg AS (SELECT model, feature_type, feature, question,
                         count(*) FILTER (WHERE flag) AS n1, count(*) FILTER (WHERE NOT flag) AS n0, count(*) AS n,
                         avg(score) FILTER (WHERE flag) AS mean1, avg(score) FILTER (WHERE NOT flag) AS mean0,
                         var_samp(score) FILTER (WHERE flag) AS var1, var_samp(score) FILTER (WHERE NOT flag) AS var0,
                         CASE WHEN var_pop(score) > 0 THEN corr(CASE WHEN flag THEN 1.0 ELSE 0.0 END, score) END AS r_raw,
                         sum(midrank) FILTER (WHERE flag) AS r1
                  FROM {prefix}_bfr GROUP BY ALL),
  {prefix}_ef AS (SELECT e.*, t.ties, mean1 - mean0 AS mean_diff,
                         sqrt(greatest(((n1 - 1) * var1 + (n0 - 1) * var0) / (n - 2), 0.0)) AS pooled,
                         greatest(-1.0, least(1.0, r_raw)) AS r, r1 - n1 * (n1 + 1) / 2.0 AS u1,
                         sqrt(n1 * n0 / 12.0 * ((n + 1) - t.ties / (n * (n - 1.0)))) AS sigma
                  FROM {prefix}_eg e JOIN {prefix}_ties t USING (model, feature_type, feature, question)
                  WHERE n1 >= {min_count} AND n0 >= {min_count}),
  {prefix}_ef2 AS (SELECT *, CASE WHEN sigma > 0 THEN (greatest(u1, n1 * n0 - u1) - n1 * n0 / 2.0 - 0.5) / sigma END AS z
                   FROM {prefix}_ef),
  {prefix}_eff AS (SELECT model, feature_type, feature, question, CAST(n1 AS BIGINT) AS n_with_feature,
                          CAST(n0 AS BIGINT) AS n_without_feature, mean1 AS mean_with_feature,
                          mean0 AS mean_without_feature, mean_diff, r AS point_biserial_corr,
                          {sql_p_from_r('r', 'n')} AS p_value,
                          CASE WHEN pooled > 0 THEN mean_diff / pooled ELSE 0.0 END AS cohens_d{mw_cols}
                   FROM {prefix}_ef2)
"""
    s += _bh(f"{prefix}_eff", "p_value", "p_value_fdr", f"{prefix}_bh1")
    if with_mw:
        s += _bh(f"{prefix}_bh1", "mannwhitney_p", "mw_p_value_fdr", f"{prefix}_bh2")
        s += f", {prefix}_out AS (SELECT * FROM {prefix}_bh2)\n"
    else:
        s += f", {prefix}_out AS (SELECT * FROM {prefix}_bh1)\n"
    return s


FEATS_SQL = "SELECT DISTINCT respondent, feature_type, feature FROM fx_features WHERE feature IS NOT NULL"
CAT_SQL = """
SELECT DISTINCT respondent, feature_type, feature FROM (
  SELECT respondent, 'phd_country' AS feature_type, phd_country AS feature FROM fx_profiles WHERE phd_country <> ''
  UNION ALL
  SELECT respondent, 'year_of_phd_degree',
         CAST(CAST(floor(year_of_phd_degree / 5) * 5 AS BIGINT) AS VARCHAR) || '-' ||
         CAST(CAST(floor(year_of_phd_degree / 5) * 5 AS BIGINT) + 4 AS VARCHAR)
  FROM fx_profiles WHERE year_of_phd_degree IS NOT NULL AND year_of_phd_degree <> 0) WHERE feature IS NOT NULL"""

MV_CTE = effects_cte(FEATS_SQL, True, "mv")
CT_CTE = effects_cte(CAT_SQL, False, "ct")
EFF_DOUBLES = ("mean_with_feature", "mean_without_feature", "mean_diff", "point_biserial_corr", "p_value",
               "cohens_d", "p_value_fdr")


def mv_effects(spark, sf_dir):
    return EF.feature_effect_table(load_cells(spark, sf_dir), FX.features(spark, sf_dir))


def cat_effects(spark, sf_dir):
    return EF.categorical_effect_table(load_cells(spark, sf_dir), FX.profiles(spark, sf_dir))


@register("feature_effect_table", MV_CTE + "SELECT * FROM mv_out",
          EFF_DOUBLES + ("mannwhitney_u", "mannwhitney_p", "mw_p_value_fdr"))
def q_feature_effect_table(spark, sf_dir):
    """STAT-1/3/4/5/9: point-biserial r, Cohen's d, Mann-Whitney and BH per (feature, question)."""
    return mv_effects(spark, sf_dir)


@register("categorical_effect_table", CT_CTE + "SELECT * FROM ct_out", EFF_DOUBLES)
def q_categorical_effect_table(spark, sf_dir):
    """STAT-2: effects of PhD country and 5-year PhD bins (NULL feature counts as without)."""
    return cat_effects(spark, sf_dir)


@register("mann_whitney", MV_CTE + """
SELECT model, feature_type, feature, question, n_with_feature, n_without_feature, mannwhitney_u, mannwhitney_p
FROM mv_out""", ("mannwhitney_u", "mannwhitney_p"))
def q_mann_whitney(spark, sf_dir):
    """STAT-5: Mann-Whitney U (group with feature) and tie/continuity-corrected two-sided p."""
    return mv_effects(spark, sf_dir).select("model", "feature_type", "feature", "question", "n_with_feature",
                                            "n_without_feature", "mannwhitney_u", "mannwhitney_p")


@register("fdr_bh", pairs_cte() + """
, fr AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY coalesce(pearson_p, 1.0)) AS _rk,
                count(*) OVER (PARTITION BY model) AS _m FROM corr)
SELECT model, question_1, question_2, pearson_p,
       least(1.0, min(coalesce(pearson_p, 1.0) * _m / _rk) OVER (PARTITION BY model ORDER BY _rk
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS pearson_p_fdr
FROM fr""", ("pearson_p", "pearson_p_fdr"))
def q_fdr_bh(spark, sf_dir):
    """STAT-9 standalone: BH-adjusted Pearson p-values, one family per model."""
    from stanceframe.operators.pairs import pairwise_pearson
    from stanceframe.session import materialize
    # BH reads its input several times (ordering, family sizes, block minima)
    pp = materialize(pairwise_pearson(load_cells(spark, sf_dir), MIN_N))
    return EF.fdr_bh(pp, "pearson_p", "pearson_p_fdr", ["model"]).select(
        "model", "question_1", "question_2", "pearson_p", "pearson_p_fdr")


@register("distinct_features", """
SELECT feature_type, feature, CAST(count(*) AS BIGINT) AS n_respondents FROM (
  SELECT DISTINCT respondent, feature_type, feature FROM fx_features) GROUP BY ALL""")
def q_distinct_features(spark, sf_dir):
    """AGG-5: distinct feature values and how many respondents carry each."""
    return distinct_features(FX.features(spark, sf_dir))


FE_SQL = """
SELECT model, feature_type, feature, avg(point_biserial_corr) AS mean_corr,
       stddev_samp(point_biserial_corr) AS std_corr, CAST(count(point_biserial_corr) AS BIGINT) AS n_questions,
       avg(cohens_d) AS mean_cohens_d, stddev_samp(cohens_d) AS std_cohens_d,
       CAST(count_if(p_value_fdr < 0.05) AS BIGINT) AS n_significant, avg(mean_diff) AS mean_response_diff,
       avg(n_with_feature) AS avg_n_with_feature,
       abs(avg(point_biserial_corr)) / (stddev_samp(point_biserial_corr) + 0.01) AS effect_consistency,
       count_if(p_value_fdr < 0.05) / nullif(count(point_biserial_corr), 0) AS significance_rate
FROM {src} GROUP BY model, feature_type, feature"""
FE_DOUBLES = ("mean_corr", "std_corr", "mean_cohens_d", "std_cohens_d", "mean_response_diff", "avg_n_with_feature",
              "effect_consistency", "significance_rate")
ALL_EFF = (", all_eff AS (SELECT model, feature_type, feature, question, n_with_feature, n_without_feature, "
           "mean_with_feature, mean_without_feature, mean_diff, point_biserial_corr, p_value, cohens_d, p_value_fdr "
           "FROM mv_out UNION ALL SELECT model, feature_type, feature, question, n_with_feature, n_without_feature, "
           "mean_with_feature, mean_without_feature, mean_diff, point_biserial_corr, p_value, cohens_d, p_value_fdr "
           "FROM ct_out)\n")


def _all_effects(spark, sf_dir):
    cols = ["model", "feature_type", "feature", "question", "n_with_feature", "n_without_feature",
            "mean_with_feature", "mean_without_feature", "mean_diff", "point_biserial_corr", "p_value",
            "cohens_d", "p_value_fdr"]
    return mv_effects(spark, sf_dir).select(*cols).unionByName(cat_effects(spark, sf_dir).select(*cols))


@register("feature_effects", MV_CTE + CT_CTE + ALL_EFF + FE_SQL.format(src="all_eff"), FE_DOUBLES)
def q_feature_effects(spark, sf_dir):
    """AGG-12: per-feature roll-up over all four feature families."""
    return EF.feature_effects(_all_effects(spark, sf_dir))


QE_SQL = """
SELECT model, question, avg(point_biserial_corr) AS mean_corr, stddev_samp(point_biserial_corr) AS std_corr,
       CAST(count(point_biserial_corr) AS BIGINT) AS n_features, max(abs(point_biserial_corr)) AS max_abs_corr,
       avg(cohens_d) AS mean_cohens_d, max(abs(cohens_d)) AS max_abs_cohens_d,
       CAST(count_if(p_value_fdr < 0.05) AS BIGINT) AS n_significant,
       count_if(p_value_fdr < 0.05) / nullif(count(point_biserial_corr), 0) AS significance_rate
FROM mv_out GROUP BY model, question"""
QE_DOUBLES = ("mean_corr", "std_corr", "max_abs_corr", "mean_cohens_d", "max_abs_cohens_d", "significance_rate")


@register("question_effects", MV_CTE + QE_SQL, QE_DOUBLES)
def q_question_effects(spark, sf_dir):
    """AGG-13: per-question roll-up over the union of the two multi-valued families."""
    return EF.question_effects(mv_effects(spark, sf_dir))


@register("effect_summary", MV_CTE + """
SELECT model, feature_type, CAST(count(*) AS BIGINT) AS n_pairs, CAST(count_if(p_value_fdr < 0.05) AS BIGINT) AS n_significant,
       avg(CASE WHEN p_value_fdr < 0.05 THEN 1.0 ELSE 0.0 END) AS pct_significant,
       avg(abs(point_biserial_corr)) AS mean_abs_corr, max(abs(point_biserial_corr)) AS max_abs_corr,
       avg(abs(cohens_d)) AS mean_abs_cohens_d,
       CAST(count_if(abs(point_biserial_corr) > 0.2) AS BIGINT) AS n_abs_corr_gt_0_2,
       CAST(count_if(abs(cohens_d) > 0.5) AS BIGINT) AS n_abs_d_gt_0_5,
       median(abs(point_biserial_corr)) AS median_abs_corr
FROM mv_out GROUP BY GROUPING SETS ((model, feature_type), (model))""",
          ("pct_significant", "mean_abs_corr", "max_abs_corr", "mean_abs_cohens_d", "median_abs_corr"))
def q_effect_summary(spark, sf_dir):
    """AGG-14: overall and per-feature-type effect summary."""
    return EF.effect_summary(mv_effects(spark, sf_dir))


@register("top_effects", MV_CTE + """
SELECT model, feature_type, CAST(rk AS BIGINT) AS rank, feature, question, point_biserial_corr, cohens_d, p_value_fdr FROM (
  SELECT *, row_number() OVER (PARTITION BY model, feature_type
                               ORDER BY abs(point_biserial_corr) DESC, feature, question) AS rk
  FROM mv_out WHERE p_value_fdr < 0.05 AND point_biserial_corr IS NOT NULL) WHERE rk <= 20""",
          ("point_biserial_corr", "cohens_d", "p_value_fdr"))
def q_top_effects(spark, sf_dir):
    """TOP-1: 20 strongest significant effects per family by |r|."""
    return EF.top_effects(mv_effects(spark, sf_dir), 20)


@register("top_features", MV_CTE + CT_CTE + ALL_EFF + ", fe AS (" + FE_SQL.format(src="all_eff") + """)
SELECT model, feature_type, CAST(rk AS BIGINT) AS rank, feature, n_significant, mean_corr, n_questions,
       significance_rate, mean_cohens_d FROM (
  SELECT *, row_number() OVER (PARTITION BY model, feature_type
                               ORDER BY CASE WHEN feature_type = 'year_of_phd_degree' THEN 0 ELSE -n_significant END,
                                        feature) AS rk
  FROM fe WHERE feature_type <> 'year_of_phd_degree' OR n_significant > 0)
WHERE feature_type = 'year_of_phd_degree' OR rk <= CASE WHEN feature_type = 'phd_country' THEN 10 ELSE 15 END""",
          ("mean_corr", "significance_rate", "mean_cohens_d"))
def q_top_features(spark, sf_dir):
    """TOP-2: per family the features with most significant effects (15; 10 countries; year
    bins with any significant effect in label order)."""
    return EF.top_features(EF.feature_effects(_all_effects(spark, sf_dir)), 15)


@register("top_questions", MV_CTE + ", qe AS (" + QE_SQL + """)
SELECT model, CAST(rk AS BIGINT) AS rank, question, n_significant, max_abs_corr, max_abs_cohens_d, significance_rate FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY n_significant DESC, question) AS rk FROM qe) WHERE rk <= 20""",
          ("max_abs_corr", "max_abs_cohens_d", "significance_rate"))
def q_top_questions(spark, sf_dir):
    """TOP-2: 20 questions with most significant feature effects per model."""
    return EF.top_questions(EF.question_effects(mv_effects(spark, sf_dir)), 20)
