"""Driver contract: entry(), queries()/oracle_sql() coverage, a fast oracle pass at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from stanceframe.plans import registry
from stanceframe.sources.fixtures import TABLES

from .conftest import SF001

ROWS_ONLY = set()


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "entropy" in df.columns


def test_every_query_has_oracle_or_is_rows_only():
    q, s = registry.queries(), registry.oracle_sql()
    assert set(q) <= set(E.queries()) and set(s) <= set(E.oracle_sql())
    assert set(q) - set(s) == ROWS_ONLY
    assert set(s) <= set(q)
    assert len(q) >= 100


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def _norm(rows):
    out = []
    for r in rows:
        out.append(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", ["question_quality", "pairwise_spearman", "feature_effect_table", "survey_table_answers", "page_qa_rows", "profile_details",
                                  "extraction_report", "resolve_link", "page_links", "validate_response", "normalize_cells", "request_shards",
                                   "kl_js_by_question",
                                  "parse_response_list", "merge_profiles_survey", "page_title_text",
                                  "preference_pairs", "build_requests", "stream_run_outcomes"])
def test_against_oracle_sf0001(spark, duck, name):
    df = E.queries()[name](spark, SF001)
    cols = df.columns
    got = _norm([tuple(r) for r in df.collect()])
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    idx = [ocols.index(c) for c in cols]
    want = _norm([tuple(r[i] for i in idx) for r in cur.fetchall()])
    assert sorted(ocols) == sorted(cols)
    assert got == want


def test_response_matrix_holds_every_model(spark, duck):
    got = _norm([tuple(r) for r in E.queries()["response_matrix_models"](spark, SF001)
                 .select("model", "respondent", "question", "score").collect()])
    assert {r[0] for r in got} == {"human", "m1", "m2"}
    assert got == _norm(duck.execute("SELECT model, respondent, question, score FROM ("
                                     + E.oracle_sql()["response_matrix_models"] + ")").fetchall())
