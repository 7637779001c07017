"""Statistics: p-value engines, BH, property checks and brute-force comparisons."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from stanceframe.functions.pvalues import normal_two_sided, t_two_sided_from_r
from stanceframe.operators import compare as CP
from stanceframe.operators import effects as EF
from stanceframe.operators import pairs as PR
from stanceframe.operators import quality as QL
from stanceframe.operators.cells import first_valid_cells
from stanceframe.sources import fixtures as FX

from .conftest import SF001, SF01


def series_p(r, n):
    """Independent finite series for integer df (A&S 26.7.3/26.7.4)."""
    df = n - 2
    ar = abs(r)
    c = 1 - r * r
    if df % 2 == 0:
        s, t = 0.0, 1.0
        for k in range(df // 2):
            s += t
            t *= (2 * k + 1) / (2 * k + 2) * c
        a = ar * s
    else:
        s, t = 0.0, 1.0
        for k in range((df - 1) // 2):
            s += t
            t *= (2 * k + 2) / (2 * k + 3) * c
        a = 2 / math.pi * (math.asin(ar) + ar * math.sqrt(c) * s)
    return 1 - a


@pytest.mark.parametrize("n", [3, 4, 5, 10, 31, 150, 1001])
@pytest.mark.parametrize("r", [0.0, 0.05, 0.3, 0.77, 0.999])
def test_t_pvalue_matches_series(r, n):
    got = t_two_sided_from_r(np.array([r]), np.array([n]))[0]
    assert abs(got - series_p(r, n)) < 1e-10


def test_normal_pvalue():
    assert abs(normal_two_sided(np.array([1.959963984540054]))[0] - 0.05) < 1e-12
    assert normal_two_sided(np.array([0.0]))[0] == 1.0


def test_fdr_bh_example(spark):
    df = spark.createDataFrame([("m", "t", p) for p in (0.01, 0.03, 0.04, 0.5)], "model string, feature_type string, p double")
    out = sorted(r["q"] for r in EF.fdr_bh(df, "p", "q").collect())
    assert [round(x, 5) for x in out] == [0.04, 0.05333, 0.05333, 0.5]


def test_fdr_monotone_and_ge_p(spark):
    rng = np.random.default_rng(1)
    ps = rng.uniform(size=200).tolist()
    df = spark.createDataFrame([("m", "t", p) for p in ps], "model string, feature_type string, p double")
    rows = sorted((r["p"], r["q"]) for r in EF.fdr_bh(df, "p", "q").collect())
    qs = [q for _, q in rows]
    assert all(q >= p - 1e-15 for p, q in rows)
    assert all(a <= b + 1e-15 for a, b in zip(qs, qs[1:]))


def _cells(spark, sf=SF01):
    return first_valid_cells(FX.answers(spark, sf)).cache()


def test_quality_properties(spark):
    q = QL.question_quality(_cells(spark), min_n=30).collect()
    assert q
    for r in q:
        assert r["entropy"] <= r["max_entropy"] + 1e-12
        assert 0 <= r["concentration"] <= 1


def test_constant_question_is_zero_variance(spark):
    rows = [("m", i, "q", 0.5) for i in range(30)]
    df = spark.createDataFrame(rows, "model string, respondent int, question string, score double")
    r = QL.question_quality(df, 30).first()
    assert r["is_zero_var"] and r["entropy"] == 0 and r["concentration"] == 1 and r["normalized_entropy"] == 0


def test_pearson_null_on_constant_and_min_n(spark):
    rows = [("m", i, "a", 0.5) for i in range(40)] + [("m", i, "b", float(i % 5) / 4) for i in range(40)]
    rows += [("m", i, "c", float(i % 3) / 2) for i in range(29)]
    df = spark.createDataFrame(rows, "model string, respondent int, question string, score double")
    out = {(r["question_1"], r["question_2"]): r for r in PR.pairwise_pearson(df, 30).collect()}
    assert out[("a", "b")]["pearson_r"] is None
    assert ("a", "c") not in out and ("b", "c") not in out


def test_pairwise_against_numpy(spark):
    cells = _cells(spark, SF01)
    got = {(r["model"], r["question_1"], r["question_2"]): r for r in PR.pairwise_correlations(cells, 30).collect()}
    pdf = cells.where("model = 'm1'").toPandas().pivot(index="respondent", columns="question", values="score")
    qs = sorted(pdf.columns)
    checked = 0
    for i, a in enumerate(qs):
        for b in qs[i + 1:]:
            m = pdf[a].notna() & pdf[b].notna()
            if m.sum() < 30:
                continue
            x, y = pdf.loc[m, a].to_numpy(), pdf.loc[m, b].to_numpy()
            r = np.corrcoef(x, y)[0, 1]
            rx = _midranks(x)
            ry = _midranks(y)
            rs = np.corrcoef(rx, ry)[0, 1]
            g = got[("m1", a, b)]
            assert abs(g["pearson_r"] - r) < 1e-12 and abs(g["spearman_r"] - rs) < 1e-12
            checked += 1
    assert checked > 100


def _midranks(x):
    order = np.argsort(x, kind="mergesort")
    ranks = np.empty(len(x))
    xs = x[order]
    i = 0
    while i < len(x):
        j = i
        while j + 1 < len(x) and xs[j + 1] == xs[i]:
            j += 1
        ranks[order[i:j + 1]] = (i + j) / 2 + 1
        i = j + 1
    return ranks


def test_mann_whitney_against_bruteforce(spark):
    cells = _cells(spark, SF01)
    feats = FX.features(spark, SF01)
    eff = EF.feature_effect_table(cells, feats).where("model = 'human' AND feature_type = 'status'").collect()
    c = cells.where("model = 'human'").toPandas()
    f = feats.where("feature_type = 'status'").toPandas()
    for r in eff[:10]:
        members = set(f.loc[f.feature == r["feature"], "respondent"])
        sub = c[c.question == r["question"]]
        g1 = sub[sub.respondent.isin(members)].score.to_numpy()
        g0 = sub[~sub.respondent.isin(members)].score.to_numpy()
        allv = np.concatenate([g1, g0])
        ranks = _midranks(allv)
        n1, n0, n = len(g1), len(g0), len(allv)
        u1 = ranks[:n1].sum() - n1 * (n1 + 1) / 2
        _, counts = np.unique(allv, return_counts=True)
        sigma = math.sqrt(n1 * n0 / 12 * ((n + 1) - (counts ** 3 - counts).sum() / (n * (n - 1))))
        z = (max(u1, n1 * n0 - u1) - n1 * n0 / 2 - 0.5) / sigma
        p = min(1.0, math.erfc(z / math.sqrt(2))) if z > 0 else 1.0
        assert abs(r["mannwhitney_u"] - u1) < 1e-9
        assert abs(r["mannwhitney_p"] - p) < 1e-12
        d = (g1.mean() - g0.mean()) / math.sqrt(((n1 - 1) * g1.var(ddof=1) + (n0 - 1) * g0.var(ddof=1)) / (n - 2))
        assert abs(r["cohens_d"] - d) < 1e-9
        assert abs(r["point_biserial_corr"] - np.corrcoef(np.r_[np.ones(n1), np.zeros(n0)], allv)[0, 1]) < 1e-9


def test_identical_tables_compare_perfectly(spark):
    cells = _cells(spark, SF01).where("model = 'human'")
    both = cells.unionByName(cells.withColumn("model", F.lit("copy")))
    kl = CP.kl_js_by_question(both).collect()
    assert kl and all(abs(r["kl_divergence"]) < 1e-9 and abs(r["js_divergence"]) < 1e-9 for r in kl)
    rv = CP.rv_coefficient(both).first()["rv_coefficient"]
    assert abs(rv - 1) < 1e-12
    mt = CP.mantel_test(both, permutations=50).first()
    assert abs(mt["mantel_r"] - 1) < 1e-12 and mt["mantel_p"] == 0.0


def test_js_bounds(spark):
    rows = [("human", i, "q", 0.0) for i in range(20)] + [("m", i, "q", 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "model string, respondent int, question string, score double")
    r = CP.kl_js_by_question(df).first()
    assert r["kl_divergence"] > 0 and abs(r["js_divergence"] - math.log(2)) < 1e-6


def test_mantel_null_spread(spark):
    """Permutation p-values are proportions in [0, 1]."""
    cells = _cells(spark, SF01)
    mt = CP.mantel_test(cells, permutations=200).collect()
    for r in mt:
        assert 0.0 <= r["mantel_p"] <= 1.0


def test_result_independent_of_partitions(spark):
    cells = _cells(spark, SF001)
    def rounded(df):
        return sorted(tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert rounded(QL.question_quality(cells.repartition(7), 2)) == rounded(QL.question_quality(cells.repartition(1), 2))


def test_fdr_blocks_match_single_window(spark):
    rng = np.random.default_rng(7)
    rows = [("m", "t" if i % 3 else "u", float(p)) for i, p in enumerate(rng.uniform(size=300))]
    rows += [("m", "t", 0.2)] * 5 + [("m", "u", None)] * 3
    df = spark.createDataFrame(rows, "model string, feature_type string, p double")
    a = sorted((r["feature_type"], r["p"] or 2.0, round(r["q"], 12)) for r in EF.fdr_bh(df, "p", "q", block=7).collect())
    b = sorted((r["feature_type"], r["p"] or 2.0, round(r["q"], 12)) for r in EF.fdr_bh(df, "p", "q").collect())
    assert a == b
    # reference computation
    for ft in ("t", "u"):
        ps = np.array([p if p is not None else 1.0 for _, f, p in rows if f == ft])
        o = np.sort(ps)
        m = len(o)
        adj = np.minimum.accumulate((o * m / np.arange(1, m + 1))[::-1])[::-1]
        want = sorted(np.round(np.minimum(adj, 1.0), 12))
        got = sorted(q for f, _, q in b if f == ft)
        assert np.allclose(got, want, atol=1e-12)


def test_exact_median(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [5, 1, 3, 2, 4, 4]] + [("b", 7.0)], "k string, v double")
    got = {r["k"]: r["med"] for r in PR.exact_median(df, ["k"], "v", "med").collect()}
    assert got == {"a": 3.5, "b": 7.0}


def test_gram_tiles_equal_the_join(spark):
    """Blocks of four columns, so that most pairs lie in tiles off the diagonal; a batch may end inside a respondent."""
    rng = random.Random(11)
    rows = [(m, r, f"q{q}", float(rng.choice([0, 0.25, 0.5, 1]))) for m in ("a", "b") for r in range(60) for q in range(9 if m == "a" else 3) if rng.random() < 0.7]
    cells = spark.createDataFrame(rows + [("a", None, "q1", 0.5), ("c", 1, "q1", 1.0)], "model string, respondent bigint, question string, score double")
    want = sorted(map(tuple, PR.pair_value_counts(cells, 2, "join").collect()))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for width in (4, 1024):
            assert sorted(map(tuple, PR.pair_value_counts(cells, 2, "gram", width).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_exact_median_of_any_spread(spark):
    rng = random.Random(2)
    groups = {"wide": [1e308, -1e308, 5e-324, 0.0, 1.0, 1.0 + 2**-52, 1e300], "ties": [2.5] * 9 + [7.0], "one": [3.0], "two": [1.0, 4.0],
              "many": [rng.lognormvariate(0, 9) for _ in range(3001)], "even": [rng.gauss(0, 1) for _ in range(1000)], None: [5.0, 6.0, 8.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("nulls", None), ("one", None)], "k string, v double")
    med = PR.exact_median(df, ["k"], "v", "med")
    assert {r["k"]: r["med"] for r in med.collect()} == {k: statistics.median(vs) for k, vs in groups.items()}
    assert "rangepartitioning" not in med._jdf.queryExecution().executedPlan().toString()
    assert PR.exact_median(df.limit(0), ["k"], "v", "med").count() == 0
