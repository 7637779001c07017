"""Merges, dedupe rules and ordering helpers."""

import duckdb
import pytest
from pyspark.sql import functions as F

from stanceframe.operators import batch as B
from stanceframe.operators import merge as M
from stanceframe.operators.cells import normalize_cells
from stanceframe.operators.ordering import dense_index
from stanceframe.plans import registry
from stanceframe.sources.fixtures import TABLES

from .conftest import SF001


def test_merge_profiles_survey(spark):
    profiles = spark.createDataFrame([("A", "https://x.org/profiles/a"), ("A2", "https://x.org/profiles/a"),
                                      ("B", "https://x.org/profiles/b")], "name string, url string")
    survey = spark.createDataFrame([("a", 0, "q1", 1.0), ("a", 1, "q1", 0.5), ("a", 1, "q2", 0.0),
                                    ("c", 0, "q1", 0.25)], "philosopher string, rec_pos int, question string, score double")
    out = {(r["name"], r["slug"]): r for r in M.merge_profiles_survey(profiles, survey).collect()}
    assert out[("A", "a")]["n_responses"] == 2 and out[("A2", "a")]["n_responses"] == 2   # last record, dup kept
    assert out[("B", "b")]["n_responses"] == 0
    assert out[(None, "c")]["survey_response_count"] == 1 and out[(None, "c")]["source"] == "survey_only"


def test_normalize_collision_last_wins(spark):
    df = spark.createDataFrame([("m", "r", "A: x", 0.25, 1), ("m", "r", "a:x", 0.75, 2)],
                               "model string, respondent string, question string, score double, ord int")
    r = normalize_cells(df).collect()
    assert len(r) == 1 and r[0]["question"] == "a: x" and r[0]["score"] == 0.75


def test_merge_model_profiles_fallback(spark):
    records = spark.createDataFrame([("Ann Lee", 1, "US"), ("Ann Lee", 2, "FR"), ("Zed", 3, "DE")],
                                    "philosopher_name string, ord int, phd_country string")
    cells = spark.createDataFrame([("Ann Lee", "q:x", 1.0), ("Zed", "q:y", 0.5)],
                                  "philosopher_name string, cell_key string, score double")
    profiles = spark.createDataFrame([("ann  LEE", "UK", 0), ("Ann Lee", "IE", 1)],
                                     "name string, phd_country string, _order int")
    out = {r["name"]: r for r in M.merge_model_profiles(records, cells, profiles).collect()}
    assert out["Ann Lee"]["matched"] and out["Ann Lee"]["phd_country"] == "IE"        # last profile wins
    assert not out["Zed"]["matched"] and out["Zed"]["source"] == "llm" and out["Zed"]["phd_country"] == "DE"


def test_first_valid_model_cells(spark):
    recs = spark.createDataFrame([
        ("P", "Q", True, ["Accept: yes", "Reject: no"], 1), ("P", "Q", True, ["Lean towards: yes"], 2),
        ("P", "Q", True, ["Neutral", "Agnostic/undecided"], 3), ("P", "", True, ["Accept: z"], 4),
        ("P", "Q", False, ["Reject: yes"], 5)],
        "philosopher_name string, question string, success boolean, parsed array<string>, ord int")
    got = {r["cell_key"]: r["score"] for r in B.first_valid_model_cells(recs).collect()}
    assert got == {"Q:yes": 1.0, "Q:no": 0.0, "Q:agnostic/undecided": 0.5}


def test_dense_index(spark):
    df = spark.range(0, 1000).withColumn("k", (F.col("id") * 7919) % 1000)
    out = dense_index(df.repartition(13), ["k"], "pos").collect()
    assert sorted((r["k"], r["pos"]) for r in out) == [(i, i) for i in range(1000)]


def test_compare_models_direction_and_ties(spark):
    from stanceframe.operators import compare as CP
    cols = [m for m, _ in CP.COMPARE_METRICS]
    base = {c: 1.0 for c in cols}
    tuned = dict(base, avg_concentration=0.5, pct_usable=2.0)        # lower-better down, higher-better up
    human = {c: 0.0 for c in cols}
    rows = [(m, *[v[c] for c in cols]) for m, v in (("base", base), ("tuned", tuned), ("human", human))]
    metrics = spark.createDataFrame(rows, "model string, " + ", ".join(f"{c} double" for c in cols))
    b = spark.createDataFrame([("base",)], "model string")
    t = spark.createDataFrame([("tuned",)], "model string")
    out = {r["metric"]: r for r in CP.compare_models(metrics, b, t).collect()}
    assert out["avg_concentration"]["better"] and out["pct_usable"]["better"]
    assert out["avg_entropy"]["better"] is False                       # unchanged counts as regression
    v = CP.compare_verdict(CP.compare_models(metrics, b, t)).first()
    assert (v["n_improved"], v["n_regressed"], v["verdict"]) == (2, 4, "regression")


def test_pending_tasks_two_column_key(spark):
    tasks = spark.createDataFrame([("a||b", "c", 0), ("a", "b||c", 1), ("x", "q", 2)],
                                  "philosopher_name string, question string, req_no int")
    done = spark.createDataFrame([("a||b", "c")], "philosopher_name string, question string")
    got = [r["req_no"] for r in B.pending_tasks(tasks, done, limit=5).collect()]
    assert got == [1, 2]


def test_merge_queries_keep_all_profiles(spark):
    from stanceframe.plans import queries_text as Q
    from stanceframe.sources import fixtures as FX
    p = Q._merge_profiles(spark, SF001)
    assert p.count() == FX.profiles(spark, SF001).count()
    assert {r["name"] for r in p.where("respondent % 20 = 0").collect()} == {
        f"guest {r['respondent']}" for r in p.where("respondent % 20 = 0").collect()} != set()


@pytest.mark.parametrize("name", ["merge_model_profiles", "merge_counts"])
def test_merge_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = registry.queries()[name](spark, SF001)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
