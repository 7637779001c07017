"""Positions, corrected p-values, medians and ids at sizes beyond Spark's range sample, on collected rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stanceframe.operators.effects import fdr_bh
from stanceframe.operators.ordering import dense_index
from stanceframe.operators.pairs import exact_median
from stanceframe.operators.prefs import eligible_respondents


def _table(spark, n, parts, wide):
    df = spark.range(0, n, 1, parts).select(
        F.concat(F.lit("k"), F.sha2(F.col("id").cast("string"), 256)).alias("k"),
        ((F.xxhash64("id") % 1_000_003 + 1_000_003) % 1_000_003 / 1_000_003.0).alias("p"), F.lit("m").alias("model"),
        F.lit("t").alias("feature_type"), F.col("id"))
    return df.withColumn("text", F.repeat(F.col("k"), 5)) if wide else df


@pytest.mark.parametrize("n,parts,wide,out_parts", [(5000, 1, False, 4), (20_000, 7, True, 3), (200_000, 5, False, 16)])
def test_dense_index_is_dense_and_ordered(spark, n, parts, wide, out_parts):
    df = dense_index(_table(spark, n, parts, wide), ["k"], "pos", num_partitions=out_parts)
    rows = sorted((r["k"], r["pos"]) for r in df.collect())
    assert [p for _, p in rows] == list(range(n))
    # reading other columns must not change a position
    again = df.select("pos", "id").toPandas()
    assert sorted(again["pos"]) == list(range(n)) and again["id"].nunique() == n


@pytest.mark.parametrize("n", [5000, 20_000, 200_000])
def test_bh_and_median_match_numpy(spark, n):
    df = _table(spark, n, 5, False)
    got = sorted((r["p"], r["adj"]) for r in fdr_bh(df, "p", "adj").collect())
    p = np.array([x for x, _ in got])
    want = np.minimum(1, np.minimum.accumulate((p * n / np.arange(1, n + 1))[::-1])[::-1])
    for v in np.unique(p[np.concatenate([[False], p[1:] == p[:-1]])]):
        want[p == v] = want[p == v].min()
    assert len(got) == n and np.allclose([a for _, a in got], want)
    med = exact_median(df.withColumnRenamed("p", "v"), ["model"], "v", "med").collect()
    assert len(med) == 1 and med[0]["med"] == pytest.approx(float(np.median(p)))


def test_anonymous_ids_are_unique(spark):
    recs = spark.range(0, 30_000, 1, 6).select(F.col("id").alias("rec_pos"), F.concat(F.lit("https://h.org/profile/"), F.col("id").cast("string")).alias("profile_url"),
                                               (F.col("id") % 3 != 0).alias("has_survey_responses"))
    details = recs.select("profile_url", F.array(F.lit("Logic")).alias("areas_of_specialization"), F.array(F.lit("Ethics")).alias("areas_of_interest"),
                          F.lit("P").alias("phd_institution"), F.lit("C").alias("current_institution"))
    rows = eligible_respondents(recs, details).collect()
    assert len(rows) == 20_000 and len({r["anon_id"] for r in rows}) == 20_000
