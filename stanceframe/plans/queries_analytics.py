"""Registered analytics queries over the answer cells (quality, pairs, comparison, effects)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stanceframe.operators import cells as C
from stanceframe.operators import quality as QL
from stanceframe.plans.registry import register
from stanceframe.session import materialize
from stanceframe.sources import fixtures as FX

MIN_N = 30


def load_cells(spark: SparkSession, sf_dir: str, materialized: bool = True) -> DataFrame:
    """Answer records -> first-answer-wins cells (AGG-3), written once to the shared
    checkpoint folder: every plan below reads the cells in several branches (value
    counts, pruning counts, both sides of the pair join), and re-deriving them from
    the raw answers per branch would repeat the full shuffle each time."""
    cells = C.first_valid_cells(FX.answers(spark, sf_dir))
    return materialize(cells) if materialized else cells


# --- AGG-6/7/8 ---------------------------------------------------------------

QQ_SQL = """
, vc AS (SELECT model, question, score, count(*) AS c FROM cells GROUP BY ALL),
  w AS (SELECT *, sum(c) OVER (PARTITION BY model, question) AS n,
               sum(c * score) OVER (PARTITION BY model, question) / sum(c) OVER (PARTITION BY model, question) AS mean
        FROM vc),
  m AS (SELECT model, question, any_value(n) AS n, count(*) AS unique_values, any_value(mean) AS mean,
               sum(c * (score - mean) * (score - mean)) AS m2,
               -sum((c / n) * log2(c / n)) AS entropy_raw, max(c) AS max_c
        FROM w GROUP BY model, question),
  q AS (SELECT model, question, CAST(n AS BIGINT) AS n, CAST(unique_values AS BIGINT) AS unique_values,
               m2 / (n - 1) AS variance, sqrt(m2 / (n - 1)) AS std, mean,
               CASE WHEN n < 2 THEN 0.0 ELSE entropy_raw + 0.0 END AS entropy,
               CASE WHEN unique_values > 1 THEN log2(unique_values) ELSE 0.0 END AS max_entropy, max_c
        FROM m WHERE n >= {min_n}),
  qq AS (
SELECT model, question, n, unique_values, variance, std, mean,
       CASE WHEN mean <> 0 THEN std / mean ELSE 0.0 END AS cv,
       entropy, max_entropy,
       CASE WHEN max_entropy > 0 THEN entropy / max_entropy ELSE 0.0 END AS normalized_entropy,
       pow(2.0, entropy) AS effective_categories,
       max_c / n AS concentration,
       variance < 1e-10 AS is_zero_var,
       unique_values <= 2 AS is_low_var
FROM q)
"""
QQ_DOUBLES = ("variance", "std", "mean", "cv", "entropy", "max_entropy", "normalized_entropy",
              "effective_categories", "concentration")


@register("question_quality", QQ_SQL.format(min_n=MIN_N) + "SELECT * FROM qq", QQ_DOUBLES)
def q_question_quality(spark, sf_dir):
    """AGG-6/7/8 per (model, question) with n >= 30."""
    return QL.question_quality(load_cells(spark, sf_dir, materialized=False), min_n=MIN_N)


@register("question_entropy",
          QQ_SQL.format(min_n=2) + "SELECT model, question, n, unique_values, entropy, effective_categories, "
          "max_entropy, normalized_entropy FROM qq",
          ("entropy", "effective_categories", "max_entropy", "normalized_entropy"))
def q_question_entropy(spark, sf_dir):
    """AGG-7/8: entropy and effective categories for every question with n >= 2."""
    return QL.question_entropy(load_cells(spark, sf_dir, materialized=False), min_n=2)


# --- question pairs: STAT-6/7/8, AGG-10/11 ----------------------------------------

from stanceframe.operators import pairs as PR  # noqa: E402
from stanceframe.plans.sqlfun import sql_p_from_r  # noqa: E402


def pairs_cte(min_n: int = MIN_N) -> str:
    return f"""
, qn AS (SELECT model, question FROM cells GROUP BY model, question HAVING count(*) >= {min_n}),
  kept AS (SELECT c.* FROM cells c SEMI JOIN qn ON c.model = qn.model AND c.question = qn.question),
  pc AS (SELECT a.model, a.question AS question_1, b.question AS question_2, a.score AS v1, b.score AS v2, count(*) AS c
         FROM kept a JOIN kept b ON a.model = b.model AND a.respondent = b.respondent AND a.question < b.question
         GROUP BY ALL),
  pw AS (SELECT *, sum(c) OVER wp AS n,
                sum(c * v1) OVER wp / sum(c) OVER wp AS m1, sum(c * v2) OVER wp / sum(c) OVER wp AS m2,
                sum(c) OVER (PARTITION BY model, question_1, question_2, v1) AS eq1,
                sum(c) OVER (PARTITION BY model, question_1, question_2, v2) AS eq2,
                sum(c) OVER (PARTITION BY model, question_1, question_2 ORDER BY v1
                             RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS le1,
                sum(c) OVER (PARTITION BY model, question_1, question_2 ORDER BY v2
                             RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS le2
         FROM pc WINDOW wp AS (PARTITION BY model, question_1, question_2)),
  pr AS (SELECT *, le1 - eq1 + (eq1 + 1) / 2.0 AS r1, le2 - eq2 + (eq2 + 1) / 2.0 AS r2, (n + 1) / 2.0 AS mr FROM pw),
  pm AS (SELECT model, question_1, question_2, any_value(n) AS n,
                sum(c * (v1 - m1) * (v1 - m1)) AS sxx, sum(c * (v2 - m2) * (v2 - m2)) AS syy,
                sum(c * (v1 - m1) * (v2 - m2)) AS sxy,
                sum(c * (r1 - mr) * (r1 - mr)) AS rxx, sum(c * (r2 - mr) * (r2 - mr)) AS ryy,
                sum(c * (r1 - mr) * (r2 - mr)) AS rxy
         FROM pr GROUP BY model, question_1, question_2),
  pco AS (SELECT model, question_1, question_2, CAST(n AS BIGINT) AS n_samples,
                 CASE WHEN sxx > 0 AND syy > 0 THEN greatest(-1.0, least(1.0, sxy / sqrt(sxx * syy))) END AS pearson_r,
                 CASE WHEN rxx > 0 AND ryy > 0 THEN greatest(-1.0, least(1.0, rxy / sqrt(rxx * ryy))) END AS spearman_r
          FROM pm),
  corr AS (SELECT *, {sql_p_from_r('pearson_r', 'n_samples')} AS pearson_p,
                  {sql_p_from_r('spearman_r', 'n_samples')} AS spearman_p,
                  abs(pearson_r) AS abs_pearson_r, abs(spearman_r) AS abs_spearman_r
           FROM pco WHERE n_samples >= {min_n}),
  diag AS (SELECT model, question AS question_1, question AS question_2, CAST(count(*) AS BIGINT) AS n_samples, 1.0 AS r
           FROM cells GROUP BY model, question HAVING count(*) >= {min_n} AND max(score) > min(score)),
  cmat AS (SELECT model, question_1, question_2, n_samples, pearson_r AS r FROM pco
           WHERE n_samples >= {min_n} AND pearson_r IS NOT NULL
           UNION ALL SELECT * FROM diag)
"""


def pair_stats(spark, sf_dir, min_n=MIN_N):
    return PR.pairwise_correlations(load_cells(spark, sf_dir), min_n)


@register("pairwise_pearson",
          pairs_cte() + "SELECT model, question_1, question_2, n_samples, pearson_r, pearson_p, abs_pearson_r FROM corr",
          ("pearson_r", "pearson_p", "abs_pearson_r"))
def q_pairwise_pearson(spark, sf_dir):
    """STAT-6: Pearson r and p for every question pair co-answered by >= 30 respondents."""
    return PR.pairwise_pearson(load_cells(spark, sf_dir), MIN_N)


@register("pairwise_spearman",
          pairs_cte() + "SELECT model, question_1, question_2, n_samples, spearman_r, spearman_p, abs_spearman_r FROM corr",
          ("spearman_r", "spearman_p", "abs_spearman_r"))
def q_pairwise_spearman(spark, sf_dir):
    """STAT-7: Spearman r (midranks within each pair's co-answered rows) and p."""
    return PR.pairwise_spearman(load_cells(spark, sf_dir), MIN_N)


@register("correlation_matrix", pairs_cte() + "SELECT * FROM cmat", ("r",))
def q_correlation_matrix(spark, sf_dir):
    """STAT-8: sparse correlation matrix (upper triangle + diagonal), n >= 30."""
    return PR.correlation_matrix(load_cells(spark, sf_dir), MIN_N)


RELIABILITY_CTE = """
, rr AS (SELECT model, pearson_r AS r, abs(pearson_r) AS abs_r FROM pco
         WHERE n_samples >= {min_n} AND pearson_r IS NOT NULL),
  rel AS (SELECT model, CAST(count(*) AS BIGINT) AS n_correlations, avg(abs_r) AS mean_abs_r,
                 median(abs_r) AS median_abs_r, stddev_pop(r) AS std_r,
                 100.0 * count_if(r > 0.5) / count(*) AS pct_strong_pos,
                 100.0 * count_if(r < -0.5) / count(*) AS pct_strong_neg,
                 100.0 * count_if(abs_r > 0.5) / count(*) AS pct_extreme
          FROM rr GROUP BY model),
  reliability AS (SELECT m.model, n_correlations, mean_abs_r, median_abs_r, std_r, pct_strong_pos, pct_strong_neg,
                         pct_extreme, CASE WHEN std_r > 0 THEN mean_abs_r / std_r ELSE 0.0 END AS signal_to_noise
                  FROM (SELECT DISTINCT model FROM cells) m LEFT JOIN rel USING (model))
"""
REL_DOUBLES = ("mean_abs_r", "median_abs_r", "std_r", "pct_strong_pos", "pct_strong_neg", "pct_extreme",
               "signal_to_noise")


@register("correlation_reliability", pairs_cte() + RELIABILITY_CTE.format(min_n=MIN_N) + "SELECT * FROM reliability",
          REL_DOUBLES)
def q_correlation_reliability(spark, sf_dir):
    """AGG-10: reliability of each model's correlation structure."""
    return PR.correlation_reliability(load_cells(spark, sf_dir), MIN_N)


@register("correlation_summary", pairs_cte() + """
SELECT model, CAST(count(*) AS BIGINT) AS n_correlations, CAST(count(pearson_r) AS BIGINT) AS n_with_data,
       avg(n_samples) AS mean_sample_size, median(n_samples) AS median_sample_size,
       avg(pearson_r) AS mean_pearson_r, stddev_samp(pearson_r) AS std_pearson_r,
       avg(abs_pearson_r) AS mean_abs_pearson_r, avg(spearman_r) AS mean_spearman_r,
       stddev_samp(spearman_r) AS std_spearman_r,
       CAST(count_if(pearson_p < 0.001) AS BIGINT) AS sig_001, CAST(count_if(pearson_p < 0.01) AS BIGINT) AS sig_01,
       CAST(count_if(pearson_p < 0.05) AS BIGINT) AS sig_05,
       CAST(count_if(pearson_r > 0.5) AS BIGINT) AS strong_pos, CAST(count_if(pearson_r < -0.5) AS BIGINT) AS strong_neg
FROM corr GROUP BY model""", ("mean_sample_size", "median_sample_size", "mean_pearson_r", "std_pearson_r",
                              "mean_abs_pearson_r", "mean_spearman_r", "std_spearman_r"))
def q_correlation_summary(spark, sf_dir):
    """AGG-11: per-model summary of the pairwise correlation table."""
    return PR.correlation_summary(load_cells(spark, sf_dir), MIN_N)


# --- model roll-up, matrix views: AGG-1, AGG-2, AGG-9, JOIN-9 ---------------------

from stanceframe.operators import compare as CP  # noqa: E402

MQ_CTE = """
, mqa AS (SELECT model, CAST(count(*) AS BIGINT) AS n_questions,
                 CAST(count_if(NOT (is_zero_var OR is_low_var)) AS BIGINT) AS n_usable,
                 100.0 * count_if(NOT (is_zero_var OR is_low_var)) / count(*) AS pct_usable,
                 100.0 * count_if(is_zero_var) / count(*) AS pct_zero_var,
                 100.0 * count_if(is_low_var) / count(*) AS pct_low_var,
                 100.0 * count_if(is_zero_var OR is_low_var) / count(*) AS pct_problematic,
                 avg(entropy) AS avg_entropy, avg(normalized_entropy) AS avg_normalized_entropy,
                 avg(effective_categories) AS avg_effective_categories, avg(variance) AS avg_variance,
                 avg(std) AS avg_std, avg(cv) AS avg_cv, avg(unique_values) AS avg_unique_values,
                 avg(concentration) AS avg_concentration
          FROM qq GROUP BY model),
  mq AS (SELECT m.model, n_questions, n_usable, pct_usable, pct_zero_var, pct_low_var, pct_problematic,
                avg_entropy, avg_normalized_entropy, avg_effective_categories, avg_variance, avg_std, avg_cv,
                avg_unique_values, avg_concentration,
                0.30 * (avg_normalized_entropy * 100) + 0.25 * least(avg_variance / 0.25 * 100, 100.0)
                + 0.20 * least((avg_unique_values - 1) / 4 * 100, 100.0) + 0.25 * ((1 - avg_concentration) * 100)
                  AS quality_score
         FROM (SELECT DISTINCT model FROM cells) m LEFT JOIN mqa USING (model))
"""
MQ_DOUBLES = ("pct_usable", "pct_zero_var", "pct_low_var", "pct_problematic", "avg_entropy",
              "avg_normalized_entropy", "avg_effective_categories", "avg_variance", "avg_std", "avg_cv",
              "avg_unique_values", "avg_concentration", "quality_score")


@register("model_quality", QQ_SQL.format(min_n=MIN_N) + MQ_CTE + "SELECT * FROM mq", MQ_DOUBLES)
def q_model_quality(spark, sf_dir):
    """AGG-9: per-model quality roll-up and composite score."""
    vc = materialize(C.value_counts(load_cells(spark, sf_dir, materialized=False)))
    return QL.model_quality(None, MIN_N, vc=vc)


@register("missing_pct", """
SELECT model, CAST(count(*) AS BIGINT) AS n_cells, CAST(count(DISTINCT respondent) AS BIGINT) AS n_respondents,
       CAST(count(DISTINCT question) AS BIGINT) AS n_questions,
       100.0 * (1.0 - count(*) / (count(DISTINCT respondent) * count(DISTINCT question))) AS missing_pct
FROM cells GROUP BY model""", ("missing_pct",))
def q_missing_pct(spark, sf_dir):
    """AGG-2: share of the respondents x questions matrix that is missing."""
    return C.missing_pct(load_cells(spark, sf_dir, materialized=False))


@register("common_questions", """
SELECT DISTINCT model, question FROM cells
WHERE model <> 'human' AND question IN (SELECT question FROM cells WHERE model = 'human')""")
def q_common_questions(spark, sf_dir):
    """JOIN-9 / SET-3: questions present for both a model and the human reference."""
    return C.common_questions(load_cells(spark, sf_dir, materialized=False))


@register("response_matrix", """
SELECT respondent, question, score FROM cells WHERE model = 'human'""", ("score",))
def q_response_matrix(spark, sf_dir):
    """AGG-1: wide human matrix (respondent x sorted questions), unpivoted back to check every cell."""
    cells = load_cells(spark, sf_dir)
    wide = C.response_matrix(cells, model="human", questions=_catalogue(cells))
    qcols = [c for c in wide.columns if c != "respondent"]
    return wide.unpivot("respondent", qcols, "question", "score").where("score IS NOT NULL")


@register("response_matrix_models", "SELECT model, respondent, question, score FROM cells", ("score",))
def q_response_matrix_models(spark, sf_dir):
    """AGG-1: wide matrix of every model ((model, respondent) x sorted questions), unpivoted back to check every cell."""
    cells = load_cells(spark, sf_dir)
    wide = C.response_matrix(cells, questions=_catalogue(cells))
    qcols = [c for c in wide.columns if c not in ("model", "respondent")]
    return wide.unpivot(["model", "respondent"], qcols, "question", "score").where("score IS NOT NULL")


def _catalogue(cells):
    """The questions of all models: the matrix's columns, which have to be known before it is planned."""
    return [r.question for r in cells.select("question").distinct().collect()]


# --- comparison with the reference: CMP-1..8, WIN-6 ------------------------------

KL_CTE = """
, kvc AS (SELECT model, question, score, count(*) AS c FROM cells GROUP BY ALL),
  kref AS (SELECT question, score, c AS ch FROM kvc WHERE model = 'human'),
  koth AS (SELECT * FROM kvc WHERE model <> 'human'),
  kmq AS (SELECT DISTINCT model, question FROM koth),
  kfull AS (SELECT model, question, score, sum(ch) AS ch, sum(cm) AS cm FROM (
              SELECT q.model, q.question, r.score, r.ch, 0 AS cm FROM kmq q JOIN kref r ON q.question = r.question
              UNION ALL
              SELECT o.model, o.question, o.score, 0 AS ch, o.c AS cm FROM koth o
              WHERE o.question IN (SELECT question FROM kref)) GROUP BY ALL),
  kw AS (SELECT *, sum(ch) OVER w AS nh, sum(cm) OVER w AS nm, count(*) OVER w AS k
         FROM kfull WINDOW w AS (PARTITION BY model, question)),
  kp AS (SELECT *, (ch + 1e-10) / (nh + k * 1e-10) AS ph, (cm + 1e-10) / (nm + k * 1e-10) AS pm
         FROM kw WHERE nh >= 10 AND nm >= 10),
  klq AS (SELECT model, question, CAST(any_value(nh) AS BIGINT) AS n_reference, CAST(any_value(nm) AS BIGINT) AS n_model,
                 CAST(count(*) AS BIGINT) AS support, sum(ph * ln(ph / pm)) AS kl_divergence,
                 0.5 * sum(ph * ln(ph / ((ph + pm) / 2))) + 0.5 * sum(pm * ln(pm / ((ph + pm) / 2))) AS js_divergence
          FROM kp GROUP BY model, question),
  common AS (SELECT DISTINCT model, question FROM cells
             WHERE model <> 'human' AND question IN (SELECT question FROM cells WHERE model = 'human')),
  others AS (SELECT DISTINCT model FROM cells WHERE model <> 'human'),
  klm AS (SELECT o.model, CAST(coalesce(nc.n_common, 0) AS BIGINT) AS n_common,
                 CAST(coalesce(a.n_compared, 0) AS BIGINT) AS n_compared, a.avg_kl_divergence, a.avg_js_divergence
          FROM others o
          LEFT JOIN (SELECT model, count(*) AS n_common FROM common GROUP BY model) nc USING (model)
          LEFT JOIN (SELECT model, count(*) AS n_compared, avg(kl_divergence) AS avg_kl_divergence,
                            avg(js_divergence) AS avg_js_divergence FROM klq GROUP BY model) a USING (model))
"""

RV_CTE = """
, ra AS (SELECT c.model, c.question_1, c.question_2, c.r AS a,
                CASE WHEN c.question_1 = c.question_2 THEN 1.0 ELSE 2.0 END AS w
         FROM cmat c
         WHERE c.model <> 'human'
           AND EXISTS (SELECT 1 FROM common x WHERE x.model = c.model AND x.question = c.question_1)
           AND EXISTS (SELECT 1 FROM common x WHERE x.model = c.model AND x.question = c.question_2)),
  rb AS (SELECT x.model, h.question_1, h.question_2, h.r AS b,
                CASE WHEN h.question_1 = h.question_2 THEN 1.0 ELSE 2.0 END AS w
         FROM cmat h JOIN common x ON x.question = h.question_1
         WHERE h.model = 'human'
           AND EXISTS (SELECT 1 FROM common y WHERE y.model = x.model AND y.question = h.question_2)),
  rab AS (SELECT ra.model, sum(ra.w * a * b) AS tr_ab FROM ra JOIN rb USING (model, question_1, question_2)
          GROUP BY ra.model),
  raa AS (SELECT model, sum(w * a * a) AS tr_aa FROM ra GROUP BY model),
  rbb AS (SELECT model, sum(w * b * b) AS tr_bb FROM rb GROUP BY model),
  rnc AS (SELECT model, count(*) AS n_common FROM common GROUP BY model),
  rv AS (SELECT o.model,
                CASE WHEN coalesce(n_common, 0) >= 2 AND sqrt(coalesce(tr_aa, 0) * coalesce(tr_bb, 0)) > 0
                     THEN coalesce(tr_ab, 0) / sqrt(coalesce(tr_aa, 0) * coalesce(tr_bb, 0)) END AS rv_coefficient
         FROM others o LEFT JOIN rnc USING (model) LEFT JOIN rab USING (model)
         LEFT JOIN raa USING (model) LEFT JOIN rbb USING (model))
"""

def _moved_sql(source: str, seed: int) -> str:
    """Positions after the permutation of each repetition, as ``CP.permuted`` has them: the keys of a repetition as a list, a round as two nested SELECTs."""
    m = CP.KEY_MODULUS
    start = f"((rep * 48271 + {seed * 69621 + 1} + r * 39373) % {m})"
    keys = f"(SELECT rep, list(({start} * {start} + {start} * 16807 + r + 1) % {m} ORDER BY r) AS ks FROM (SELECT DISTINCT rep FROM {source}) a, (SELECT unnest(range(0, {CP.SHUFFLE_ROUNDS})) AS r) b GROUP BY rep)"
    q = f"SELECT s.model, s.n, s.rep, s.ac, s.pos AS x, ks FROM {source} s JOIN {keys} k ON k.rep = s.rep"
    for r in range(CP.SHUFFLE_ROUNDS):
        q = f"SELECT model, n, rep, ac, ks, x, (ks[{r + 1}] % n + n - x) % n AS y FROM ({q})"
        q = f"SELECT model, n, rep, ac, ks, x, y, ((greatest(x, y) + 1) % {m} * ks[{r + 1}] + {r + 1}) % {m} AS t FROM ({q})"
        q = f"SELECT model, n, rep, ac, ks, CASE WHEN (t * t) % {m} % 2 = 1 THEN y ELSE x END AS x FROM ({q})"
    return f"(SELECT model, rep, ac, x AS pos FROM ({q}))"


MANTEL_CTE = """
, moff AS (SELECT * FROM cmat WHERE question_1 < question_2),
  mc AS (SELECT a.model, a.question_1, a.question_2, a.r AS a, b.r AS b
         FROM moff a JOIN moff b ON a.question_1 = b.question_1 AND a.question_2 = b.question_2 AND b.model = 'human'
         WHERE a.model <> 'human'),
  mb AS (SELECT *, count(*) OVER (PARTITION BY model) AS n,
                a - avg(a) OVER (PARTITION BY model) AS ac, b - avg(b) OVER (PARTITION BY model) AS bc FROM mc),
  mbase AS (SELECT * FROM mb WHERE n >= 10),
  mstat AS (SELECT model, CAST(any_value(n) AS BIGINT) AS n_cells, sum(ac * bc) AS sab, sum(ac * ac) AS saa,
                   sum(bc * bc) AS sbb, sum(ac * bc) / sqrt(sum(ac * ac) * sum(bc * bc)) AS mantel_r
            FROM mbase GROUP BY model),
  bpos AS (SELECT model, n, ac, bc, row_number() OVER (PARTITION BY model ORDER BY question_1, question_2) - 1 AS pos FROM mbase),
  reps AS (SELECT model, n, pos, ac, unnest(range(0, {perms})) AS rep FROM bpos),
  aperm AS {moved},
  perm AS (SELECT a.model, a.rep, sum(a.ac * b.bc) AS sab_perm FROM aperm a JOIN bpos b ON a.model = b.model AND a.pos = b.pos
           GROUP BY a.model, a.rep),
  mhits AS (SELECT p.model, count_if(abs(p.sab_perm / sqrt(s.saa * s.sbb)) >= abs(s.mantel_r)) AS hits
            FROM perm p JOIN mstat s USING (model) GROUP BY p.model),
  mantel AS (SELECT o.model, n_cells, mantel_r,
                    CASE WHEN mantel_r IS NOT NULL THEN coalesce(hits, 0) / {perms}.0 END AS mantel_p
             FROM others o LEFT JOIN mstat USING (model) LEFT JOIN mhits USING (model)),
  struct_sim AS (SELECT rv.model, rv.rv_coefficient, mantel.mantel_r AS mantel_corr, mantel.mantel_p
                 FROM rv LEFT JOIN mantel USING (model))
""".replace("{moved}", _moved_sql("reps", 42)).replace("{perms}", "1000")

QM_SELECT = """
SELECT mq.*, reliability.* EXCLUDE (model), klm.* EXCLUDE (model), struct_sim.* EXCLUDE (model)
FROM mq LEFT JOIN reliability USING (model) LEFT JOIN klm USING (model) LEFT JOIN struct_sim USING (model)"""

ALL_CTE = (QQ_SQL.format(min_n=MIN_N) + MQ_CTE + pairs_cte() + RELIABILITY_CTE.format(min_n=MIN_N)
           + KL_CTE + RV_CTE + MANTEL_CTE + ", qm AS (" + QM_SELECT + ")\n")
QM_DOUBLES = MQ_DOUBLES + REL_DOUBLES + ("avg_kl_divergence", "avg_js_divergence", "rv_coefficient",
                                         "mantel_corr", "mantel_p")


@register("kl_js_by_question", KL_CTE + "SELECT * FROM klq", ("kl_divergence", "js_divergence"))
def q_kl_js_by_question(spark, sf_dir):
    """CMP-1: KL(human||model) and JS per common question with >= 10 answers each side."""
    return CP.kl_js_by_question(load_cells(spark, sf_dir, materialized=False))


@register("kl_js_by_model", KL_CTE + "SELECT * FROM klm", ("avg_kl_divergence", "avg_js_divergence"))
def q_kl_js_by_model(spark, sf_dir):
    """CMP-1: per-model averages of KL/JS with n_common and n_compared."""
    vc = materialize(C.value_counts(load_cells(spark, sf_dir, materialized=False)))
    return CP.kl_js_by_model(None, vc=vc)


@register("rv_coefficient", pairs_cte() + KL_CTE + RV_CTE + "SELECT * FROM rv", ("rv_coefficient",))
def q_rv_coefficient(spark, sf_dir):
    """CMP-2: RV coefficient between each model's and the human correlation matrix."""
    return CP.rv_coefficient(load_cells(spark, sf_dir))


@register("mantel_test", pairs_cte() + KL_CTE + RV_CTE + MANTEL_CTE + "SELECT * FROM mantel",
          ("mantel_r", "mantel_p"))
def q_mantel_test(spark, sf_dir):
    """CMP-3: Mantel r and 1000-permutation p (keyed permutations, seed 42)."""
    return CP.mantel_test(load_cells(spark, sf_dir))


@register("structural_similarity", pairs_cte() + KL_CTE + RV_CTE + MANTEL_CTE + "SELECT * FROM struct_sim",
          ("rv_coefficient", "mantel_corr", "mantel_p"))
def q_structural_similarity(spark, sf_dir):
    """CMP-4: RV, Mantel r and Mantel p per model."""
    return CP.structural_similarity(load_cells(spark, sf_dir))


@register("quality_metrics", ALL_CTE + "SELECT * FROM qm", QM_DOUBLES)
def q_quality_metrics(spark, sf_dir):
    """CMP-5: the per-model metrics table (quality, reliability, divergence, structure)."""
    return CP.quality_metrics(load_cells(spark, sf_dir))


def _metrics(spark, sf_dir):
    return CP.quality_metrics(load_cells(spark, sf_dir))


@register("all_models_table", ALL_CTE + """
SELECT model, pct_usable, avg_entropy, avg_effective_categories, avg_concentration, avg_kl_divergence,
       avg_js_divergence FROM qm""", ("pct_usable", "avg_entropy", "avg_effective_categories", "avg_concentration",
                                     "avg_kl_divergence", "avg_js_divergence"))
def q_all_models_table(spark, sf_dir):
    """CMP-8: selected columns of the metrics table for every model."""
    return CP.all_models_table(_metrics(spark, sf_dir))


@register("model_rankings", ALL_CTE + """
, lng AS (SELECT model, 'quality_score' AS metric, quality_score AS value FROM qm
          UNION ALL SELECT model, 'pct_usable', pct_usable FROM qm
          UNION ALL SELECT model, 'avg_entropy', avg_entropy FROM qm
          UNION ALL SELECT model, 'avg_kl_divergence', avg_kl_divergence FROM qm
                    WHERE model <> 'human' AND avg_kl_divergence IS NOT NULL)
SELECT metric AS ranking,
       CAST(row_number() OVER (PARTITION BY metric ORDER BY
            CASE WHEN metric = 'avg_kl_divergence' THEN value ELSE -value END ASC NULLS LAST, model) AS BIGINT) AS rank,
       model, value FROM lng""", ("value",))
def q_model_rankings(spark, sf_dir):
    """WIN-6: model rankings by quality, usable %, entropy (desc) and KL (asc)."""
    return CP.model_rankings(_metrics(spark, sf_dir))


def _find_sql(target, keywords):
    kw = " ".join(f"WHEN contains(lower(model), '{k.lower()}') THEN {i + 1}" for i, k in enumerate(keywords))
    return f"""
SELECT model FROM (
  SELECT model, row_number() OVER (ORDER BY prio, model) AS rn FROM (
    SELECT model, CASE WHEN contains(lower(model), '{target.lower()}') THEN 0 {kw} END AS prio
    FROM (SELECT DISTINCT model FROM cells)) WHERE prio IS NOT NULL) WHERE rn = 1"""


BASE_FIND = ("base-model", ["m1", "m"])
TUNED_FIND = ("finetuned", ["ft", "dpo", "m2"])


@register("find_model", _find_sql(*TUNED_FIND))
def q_find_model(spark, sf_dir):
    """CMP-7: pick the tuned model by name target, then keywords in order."""
    models = load_cells(spark, sf_dir).select("model").distinct()
    return CP.find_model(models, *TUNED_FIND)


def _roles_sql():
    b = _find_sql(*BASE_FIND)
    t = _find_sql(*TUNED_FIND)
    return f""", base_m AS ({b}), tuned_m AS ({t}),
  lng2 AS (SELECT model, 'pct_usable' AS metric, pct_usable AS value FROM qm
           UNION ALL SELECT model, 'avg_entropy', avg_entropy FROM qm
           UNION ALL SELECT model, 'avg_effective_categories', avg_effective_categories FROM qm
           UNION ALL SELECT model, 'avg_concentration', avg_concentration FROM qm
           UNION ALL SELECT model, 'avg_kl_divergence', avg_kl_divergence FROM qm
           UNION ALL SELECT model, 'avg_js_divergence', avg_js_divergence FROM qm),
  dirs AS (SELECT * FROM (VALUES ('pct_usable', false), ('avg_entropy', false), ('avg_effective_categories', false),
                                 ('avg_concentration', true), ('avg_kl_divergence', true), ('avg_js_divergence', true))
           t(metric, lower_better)),
  wide AS (SELECT metric,
                  max(CASE WHEN model = (SELECT model FROM base_m) THEN value END) AS base_value,
                  max(CASE WHEN model = (SELECT model FROM tuned_m) THEN value END) AS tuned_value,
                  max(CASE WHEN model = 'human' THEN value END) AS reference_value
           FROM lng2 GROUP BY metric),
  cmp AS (SELECT d.metric, d.lower_better, base_value, tuned_value, reference_value,
                 tuned_value - base_value AS change,
                 CASE WHEN tuned_value - base_value IS NULL THEN NULL
                      WHEN d.lower_better THEN tuned_value - base_value < 0 ELSE tuned_value - base_value > 0 END AS better
          FROM dirs d LEFT JOIN wide USING (metric))
"""


def _comparison(spark, sf_dir):
    cells = load_cells(spark, sf_dir)
    metrics = CP.quality_metrics(cells)
    models = metrics.select("model")
    return CP.compare_models(metrics, CP.find_model(models, *BASE_FIND), CP.find_model(models, *TUNED_FIND))


@register("compare_models", ALL_CTE + _roles_sql() + "SELECT * FROM cmp",
          ("base_value", "tuned_value", "reference_value", "change"))
def q_compare_models(spark, sf_dir):
    """CMP-6: base vs tuned model on six metrics (with the human value alongside)."""
    return _comparison(spark, sf_dir)


@register("compare_verdict", ALL_CTE + _roles_sql() + """
SELECT CAST(count_if(better) AS BIGINT) AS n_improved, CAST(count_if(NOT better) AS BIGINT) AS n_regressed,
       CASE WHEN count_if(better) > count_if(NOT better) THEN 'improvement'
            WHEN count_if(NOT better) > count_if(better) THEN 'regression' ELSE 'mixed' END AS verdict
FROM cmp""")
def q_compare_verdict(spark, sf_dir):
    """CMP-6 summary: improved/regressed counts and overall verdict."""
    return CP.compare_verdict(_comparison(spark, sf_dir))
