"""Property checks: split disjointness, unique cells, order independence,
and Catalyst text functions against plain-Python restatements of the same rules."""

import json
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stanceframe.functions import text as T
from stanceframe.operators import prefs as PF
from stanceframe.operators.cells import first_valid_cells
from stanceframe.sources import fixtures as FX

from .conftest import SF01


def test_split_disjoint_and_exact(spark):
    kept = PF.eligible_respondents(FX.survey_records(spark, SF01), FX.profile_details(spark, SF01))
    sp = PF.respondent_split(kept.select("anon_id"), "anon_id", 42, 0.85).collect()
    train = {r["anon_id"] for r in sp if r["split"] == "train"}
    val = {r["anon_id"] for r in sp if r["split"] == "val"}
    assert not (train & val) and len(train) == int(len(sp) * 0.85)
    pairs = PF.preference_pairs(FX.survey_records(spark, SF01), FX.profile_details(spark, SF01))
    by = pairs.groupBy("anon_id").agg(F.count_distinct("split").alias("k")).where("k > 1").count()
    assert by == 0


def test_cells_unique_and_order_independent(spark):
    ans = FX.answers(spark, SF01)
    a = first_valid_cells(ans)
    assert a.groupBy("model", "respondent", "question").count().where("count > 1").count() == 0
    b = first_valid_cells(ans.orderBy(F.rand(3)).repartition(5))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


TOKENS = list('ab :;.,!?"[]\'\n\t\xa0') + ["Accept", "Reject", "```", "json", "null", "0", "true", "{}"]
TEXT = st.lists(st.sampled_from(TOKENS), max_size=15).map("".join)


def _spark_map(spark, fn, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {dtype}")
    return [r["y"] for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


@settings(max_examples=1, deadline=None)
@given(st.lists(TEXT, min_size=150, max_size=150))
def test_normalize_option_matches_python(spark, values):
    got = _spark_map(spark, T.normalize_option, values)
    assert got == [norm_option(v) for v in values]


def norm_option(s):
    """Independent statement of the option rule (word-split, tail punctuation, colons)."""
    if not s:
        return ""
    words = " ".join(s.lower().split()).rstrip(".,!?;")
    while "::" in words:
        words = words.replace("::", ":")
    return " ".join(words.replace(" :", ":").replace(":", ": ").split())


def _py_parse_strict(text):
    """Independent statement of the list rule, JSON items rendered as JSON text."""
    body = text.strip()
    if body.startswith("```"):
        rows = body.split("\n")[1:]
        if rows and rows[-1].strip() == "```":
            rows = rows[:-1]
        body = "\n".join(rows).strip()
    run = re.search(r"\[.*?\]", body, re.S)
    if run is not None:
        try:
            items = json.loads(run.group(0))
        except ValueError:
            items = None
        if isinstance(items, list):
            return [(x if isinstance(x, str) else json.dumps(x)).strip() for x in items if x]
    for quote in ('"', "'"):
        found = re.findall(quote + "([^" + quote + "]+)" + quote, body)
        if found:
            return found
    return [body]


@settings(max_examples=1, deadline=None)
@given(st.lists(TEXT, min_size=150, max_size=150))
def test_parse_response_list_matches_python(spark, values):
    got = _spark_map(spark, T.parse_response_list, values)
    assert got == [_py_parse_strict(v) for v in values]


@settings(max_examples=1, deadline=None)
@given(st.lists(TEXT, min_size=150, max_size=150))
def test_strip_matches_python(spark, values):
    assert _spark_map(spark, T.py_strip, values) == [v.strip() for v in values]
