"""Group effects of respondent features on answers (STAT-1..5, STAT-9, AGG-12..14, TOP-1/2).

For a feature value f and question q, group 1 = respondents with f who
answered q, group 0 = every *other* respondent who answered q.  Instead of
the F x Q x P loop, everything comes from two value-count tables:

* question totals   ``(model, question, score) -> c``   (+ midranks, tie term)
* feature group     ``(model, feature_type, feature, question, score) -> c1``
  from ``cells JOIN features ON respondent`` with map-side partial aggregation,

and group 0 = totals - group 1.  Only sums, counts and rank sums are needed,
so the work is one join and two hash aggregates; the shuffle carries value
counts, never per-respondent rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stanceframe.functions.pvalues import p_from_r, p_from_z
from stanceframe.functions.text import year_bin
from stanceframe.operators.cells import value_counts

FAMILY = ("model", "feature_type")
EFFECT_KEYS = ("model", "feature_type", "feature", "question")


def question_totals(cells: DataFrame) -> DataFrame:
    """Per (model, question, score): count c, midrank of the value, and per-question n, sums, tie term."""
    vc = value_counts(cells)
    wq = Window.partitionBy("model", "question")
    cum = wq.orderBy("score").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    c = F.col("c")
    return (vc.withColumn("midrank", F.sum(c).over(cum) - c + (c + 1) / 2.0)
            .withColumn("n", F.sum(c).over(wq))
            .withColumn("mean", F.sum(c * F.col("score")).over(wq) / F.col("n"))
            # moments about the question's mean: no cancellation where the mean is large
            .withColumn("dev", F.col("score") - F.col("mean"))
            .withColumn("s", F.sum(c * F.col("dev")).over(wq))
            .withColumn("q", F.sum(c * F.col("dev") * F.col("dev")).over(wq))
            .withColumn("ties", F.sum(c * c * c - c).over(wq)))


def _group_counts(cells: DataFrame, members: DataFrame) -> DataFrame:
    """Value counts of group 1: cells joined to (respondent, feature_type, feature) memberships."""
    m = members.select("respondent", "feature_type", "feature").where(F.col("feature").isNotNull()).distinct()
    return (cells.select("model", "respondent", "question", "score").where(F.col("score").isNotNull())
            .join(m, "respondent")
            .groupBy("model", "feature_type", "feature", "question", "score")
            .agg(F.count(F.lit(1)).alias("c1")))


def _effects(cells: DataFrame, members: DataFrame, min_count: int, with_mw: bool) -> DataFrame:
    tot = question_totals(cells)
    g = _group_counts(cells, members).join(
        tot.select("model", "question", "score", "midrank", "dev"), ["model", "question", "score"])
    c1 = F.col("c1")
    g1 = g.groupBy(*EFFECT_KEYS).agg(
        F.sum(c1).alias("n1"), F.sum(c1 * F.col("dev")).alias("s1"),
        F.sum(c1 * F.col("dev") * F.col("dev")).alias("q1"),
        F.sum(c1 * F.col("midrank")).alias("r1"))
    qt = tot.groupBy("model", "question").agg(
        F.first("n").alias("n"), F.first("s").alias("s"), F.first("q").alias("q"), F.first("ties").alias("ties"),
        F.first("mean").alias("mean"))
    x = g1.join(qt, ["model", "question"]).withColumn("n0", F.col("n") - F.col("n1")) \
        .where((F.col("n1") >= min_count) & (F.col("n0") >= min_count))
    n, n1, n0 = F.col("n").cast("double"), F.col("n1").cast("double"), F.col("n0").cast("double")
    s0 = F.col("s") - F.col("s1")
    q0 = F.col("q") - F.col("q1")
    mean1, mean0 = F.col("s1") / n1, s0 / n0
    var1 = F.when(n1 > 1, (F.col("q1") - F.col("s1") * F.col("s1") / n1) / (n1 - 1)).otherwise(0.0)
    var0 = F.when(n0 > 1, (q0 - s0 * s0 / n0) / (n0 - 1)).otherwise(0.0)
    pooled = F.sqrt(F.greatest(((n1 - 1) * var1 + (n0 - 1) * var0) / (n - 2), F.lit(0.0)))
    var_pop = F.greatest(F.col("q") / n - (F.col("s") / n) * (F.col("s") / n), F.lit(0.0))
    y = (x.withColumn("mean_with_feature", mean1 + F.col("mean")).withColumn("mean_without_feature", mean0 + F.col("mean"))
         .withColumn("mean_diff", F.col("mean_with_feature") - F.col("mean_without_feature"))
         .withColumn("pooled", pooled).withColumn("sd_pop", F.sqrt(var_pop)))
    r = F.when(F.col("sd_pop") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0),
               F.col("mean_diff") * F.sqrt(n1 * n0) / (n * F.col("sd_pop")))))
    d = F.when(F.col("pooled") > 0, F.col("mean_diff") / F.col("pooled")).otherwise(F.lit(0.0))
    y = y.withColumn("point_biserial_corr", r).withColumn("cohens_d", d)
    cols = [*EFFECT_KEYS, F.col("n1").cast("bigint").alias("n_with_feature"),
            F.col("n0").cast("bigint").alias("n_without_feature"),
            "mean_with_feature", "mean_without_feature", "mean_diff", "point_biserial_corr",
            p_from_r("point_biserial_corr", F.col("n")).alias("p_value"), "cohens_d"]
    if with_mw:
        y = y.withColumn("mw_z", mann_whitney_z(F.col("r1"), n1, n0, n, F.col("ties")))
        cols += [F.col("mw_u").alias("mannwhitney_u"), mw_p(F.col("mw_z")).alias("mannwhitney_p")]
        y = y.withColumn("mw_u", F.col("r1") - n1 * (n1 + 1) / 2)
    return y.select(*cols)


def mann_whitney_z(r1, n1, n0, n, ties):
    """Tie-corrected, continuity-corrected z of U = max(U1, U2) (NULL when sigma is 0)."""
    u1 = r1 - n1 * (n1 + 1) / 2
    u = F.greatest(u1, n1 * n0 - u1)
    sigma = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - ties / (n * (n - 1))))
    return F.when(sigma > 0, (u - n1 * n0 / 2.0 - 0.5) / sigma)


def mw_p(z):
    """Two-sided p = min(1, 2*SF(z)); sigma 0 (all values equal) -> 1."""
    return F.when(z.isNull() | (z <= 0), F.lit(1.0)).otherwise(p_from_z(z))


def fdr_bh(df: DataFrame, p_col: str, out: str, family: tuple[str, ...] | list[str] = FAMILY,
           block: int = 1 << 16) -> DataFrame:
    """STAT-9: Benjamini-Hochberg adjusted p per family; missing p counts as 1.

    p_adj(i) = min(1, min_{j >= i} p(j) * m / j) over p sorted ascending.  The
    ordering is a distributed dense index (no family in one task); the suffix
    minimum runs inside fixed-size blocks of ``block`` positions, and each block
    takes the minimum of all later blocks of its family from a small carry table.
    Tied p-values get equal adjusted values whatever their order.  The input is
    evaluated once, into the stored order table.
    """
    from stanceframe.operators.ordering import dense_index
    fam = list(family)
    pf = F.coalesce(F.col(p_col), F.lit(1.0))
    x = df.withColumn("_pf", pf).withColumn("_tb", F.xxhash64(*[F.col(c) for c in df.columns]))
    x = dense_index(x, [*fam, "_pf", "_tb"], "_g")
    st = x.groupBy(*fam).agg(F.min("_g").alias("_start"), F.count(F.lit(1)).alias("_m"))
    x = (x.join(st, fam)
         .withColumn("_rank", F.col("_g") - F.col("_start") + 1)
         .withColumn("_adj", F.col("_pf") * F.col("_m") / F.col("_rank"))
         .withColumn("_blk", F.floor((F.col("_rank") - 1) / block)))
    # from the last place backwards: a frame that runs to the end is computed anew for every row
    inblock = Window.partitionBy(*fam, "_blk").orderBy(F.desc("_g")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("_sfx", F.min("_adj").over(inblock))
    bmin = x.groupBy(*fam, "_blk").agg(F.min("_adj").alias("_bmin"))
    later = Window.partitionBy(*fam).orderBy(F.desc("_blk")).rowsBetween(Window.unboundedPreceding, -1)
    carry = bmin.withColumn("_carry", F.min("_bmin").over(later)).drop("_bmin")
    x = x.join(carry, [*fam, "_blk"])
    adj = F.least(F.lit(1.0), F.least(F.col("_sfx"), F.coalesce(F.col("_carry"), F.col("_sfx"))))
    return x.withColumn(out, adj).drop("_pf", "_tb", "_g", "_start", "_m", "_rank", "_adj", "_blk", "_sfx", "_carry")


def feature_effect_table(cells: DataFrame, features: DataFrame, min_count: int = 5) -> DataFrame:
    """STAT-1/3/4/5 + STAT-9 for multi-valued features (one BH family per (model, feature_type))."""
    # each BH pass evaluates its input once, into its stored order table
    e = fdr_bh(_effects(cells, features, min_count, with_mw=True), "p_value", "p_value_fdr")
    return fdr_bh(e, "mannwhitney_p", "mw_p_value_fdr")


def categorical_members(profiles: DataFrame, feature_key: str) -> DataFrame:
    """(respondent, feature_type, feature) for a scalar profile field; year is binned first."""
    col = F.col(feature_key)
    if feature_key == "year_of_phd_degree":
        val = F.when(col.isNotNull() & (col != 0), year_bin(col))
    else:
        val = F.when(col != "", col)
    return profiles.select("respondent", F.lit(feature_key).alias("feature_type"), val.alias("feature"))


def categorical_effect_table(cells: DataFrame, profiles: DataFrame,
                             feature_keys=("phd_country", "year_of_phd_degree"), min_count: int = 5) -> DataFrame:
    """STAT-2 (+3/4/9): one scalar feature per respondent; NULL feature counts as "without"."""
    members = None
    for k in feature_keys:
        m = categorical_members(profiles, k)
        members = m if members is None else members.unionByName(m)
    return fdr_bh(_effects(cells, members, min_count, with_mw=False), "p_value", "p_value_fdr")


# --- roll-ups -----------------------------------------------------------------

def _median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    from stanceframe.operators.pairs import exact_median
    return exact_median(df, keys, value, out)


def feature_effects(effects: DataFrame, p_threshold: float = 0.05) -> DataFrame:
    """AGG-12: per (model, feature_type, feature): mean/std/count of r, mean/std of d,
    significant count, mean diff, mean group size, consistency and rate."""
    sig = F.count_if(F.col("p_value_fdr") < p_threshold)
    agg = effects.groupBy("model", "feature_type", "feature").agg(
        F.avg("point_biserial_corr").alias("mean_corr"),
        F.stddev_samp("point_biserial_corr").alias("std_corr"),
        F.count("point_biserial_corr").cast("bigint").alias("n_questions"),
        F.avg("cohens_d").alias("mean_cohens_d"),
        F.stddev_samp("cohens_d").alias("std_cohens_d"),
        sig.cast("bigint").alias("n_significant"),
        F.avg("mean_diff").alias("mean_response_diff"),
        F.avg("n_with_feature").alias("avg_n_with_feature"))
    return agg.select("*",
                      (F.abs("mean_corr") / (F.col("std_corr") + 0.01)).alias("effect_consistency"),
                      F.try_divide(F.col("n_significant").cast("double"), F.col("n_questions").cast("double"))
                      .alias("significance_rate"))


def question_effects(effects: DataFrame, p_threshold: float = 0.05) -> DataFrame:
    """AGG-13: per (model, question) over the given effect rows, with max |r| and max |d|."""
    agg = effects.groupBy("model", "question").agg(
        F.avg("point_biserial_corr").alias("mean_corr"),
        F.stddev_samp("point_biserial_corr").alias("std_corr"),
        F.count("point_biserial_corr").cast("bigint").alias("n_features"),
        F.max(F.abs("point_biserial_corr")).alias("max_abs_corr"),
        F.avg("cohens_d").alias("mean_cohens_d"),
        F.max(F.abs("cohens_d")).alias("max_abs_cohens_d"),
        F.count_if(F.col("p_value_fdr") < p_threshold).cast("bigint").alias("n_significant"))
    return agg.select("*", F.try_divide(F.col("n_significant").cast("double"), F.col("n_features").cast("double"))
                      .alias("significance_rate"))


def effect_summary(effects: DataFrame, p_threshold: float = 0.05) -> DataFrame:
    """AGG-14: overall and per-feature-type summary (grouping sets (model, feature_type), (model))."""
    x = effects.select("model", "feature_type", F.abs("point_biserial_corr").alias("abs_r"),
                       F.abs("cohens_d").alias("abs_d"), (F.col("p_value_fdr") < p_threshold).alias("sig"))
    aggs = [F.count(F.lit(1)).cast("bigint").alias("n_pairs"),
            F.count_if("sig").cast("bigint").alias("n_significant"),
            F.avg(F.col("sig").cast("double")).alias("pct_significant"),
            F.avg("abs_r").alias("mean_abs_corr"),
            F.max("abs_r").alias("max_abs_corr"),
            F.avg("abs_d").alias("mean_abs_cohens_d"),
            F.count_if(F.col("abs_r") > 0.2).cast("bigint").alias("n_abs_corr_gt_0_2"),
            F.count_if(F.col("abs_d") > 0.5).cast("bigint").alias("n_abs_d_gt_0_5")]
    by_type = x.groupBy("model", "feature_type").agg(*aggs).join(
        _median(x, ["model", "feature_type"], "abs_r", "median_abs_corr"), ["model", "feature_type"], "left")
    overall = x.groupBy("model").agg(*aggs).join(
        _median(x, ["model"], "abs_r", "median_abs_corr"), ["model"], "left") \
        .withColumn("feature_type", F.lit(None).cast("string"))
    return by_type.unionByName(overall)


def top_effects(effects: DataFrame, k: int = 20, p_threshold: float = 0.05) -> DataFrame:
    """TOP-1: per family, the k strongest significant effects by |r| (ties: feature, question)."""
    w = Window.partitionBy(*FAMILY).orderBy(F.abs("point_biserial_corr").desc(), "feature", "question")
    return (effects.where((F.col("p_value_fdr") < p_threshold) & F.col("point_biserial_corr").isNotNull())
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(*FAMILY, F.col("rank").cast("bigint").alias("rank"), "feature", "question",
                    "point_biserial_corr", "cohens_d", "p_value_fdr"))


def top_features(feature_stats: DataFrame, k: int = 15, k_by_type: dict | None = None,
                 label_order_types: tuple[str, ...] = ("year_of_phd_degree",)) -> DataFrame:
    """TOP-2: per (model, feature_type), the features with most significant effects:
    ``k`` per family (``k_by_type`` overrides, e.g. 10 countries), ties by feature name;
    families in ``label_order_types`` (year bins) list every feature with at least one
    significant effect, in label order."""
    k_by_type = k_by_type if k_by_type is not None else {"phd_country": 10}
    labelled = F.col("feature_type").isin(list(label_order_types)) if label_order_types else F.lit(False)
    order_key = F.when(labelled, F.lit(0)).otherwise(-F.col("n_significant"))
    w = Window.partitionBy("model", "feature_type").orderBy(order_key, "feature")
    limit = F.lit(k)
    for t, kt in k_by_type.items():
        limit = F.when(F.col("feature_type") == t, F.lit(kt)).otherwise(limit)
    ranked = feature_stats.where(~labelled | (F.col("n_significant") > 0)).withColumn("rank", F.row_number().over(w))
    return (ranked.where(labelled | (F.col("rank") <= limit))
            .select("model", "feature_type", F.col("rank").cast("bigint").alias("rank"), "feature",
                    "n_significant", "mean_corr", "n_questions", "significance_rate", "mean_cohens_d"))


def top_questions(question_stats: DataFrame, k: int = 20) -> DataFrame:
    """TOP-2: per model, the k questions with most significant feature effects."""
    w = Window.partitionBy("model").orderBy(F.col("n_significant").desc(), "question")
    return (question_stats.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("model", F.col("rank").cast("bigint").alias("rank"), "question", "n_significant",
                    "max_abs_corr", "max_abs_cohens_d", "significance_rate"))
