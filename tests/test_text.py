"""Hand-worked goldens for the scalar text functions (FIXTURES.md part 3)."""

from pyspark.sql import functions as F

from stanceframe.functions import prompts as P
from stanceframe.functions import text as T
from stanceframe.operators import prefs as PF


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(expr(F.col("x")).alias("y")).first()["y"]


def test_slug_rules(spark):
    assert one(spark, T.slug_from_profile_url, "https://x.org/profiles/a-b/") == "a-b"
    assert one(spark, T.slug_from_profile_url, "https://x.org/a/profiles/c?x=1") == "c"
    assert one(spark, T.slug_from_profile_url, "https://x.org/about/c") is None
    assert one(spark, T.slug_from_profile_url, "") is None
    m = lambda c: T.slug_after_marker(c, "people.example.org/profiles/")
    assert one(spark, m, "https://people.example.org/profiles/a/") == "a/"
    assert one(spark, m, "https://other.org/profiles/a") is None
    assert one(spark, lambda c: T.slug_second_last(c, "unknown"), "https://x.org/p/slug/views") == "slug"
    assert one(spark, lambda c: T.slug_second_last(c, "unknown"), "noslash") == "unknown"


def test_normalisers(spark):
    assert one(spark, T.normalize_question, "A priori:yes") == "a priori: yes"
    assert one(spark, T.normalize_question, " Free will: x ") == "free will: x"
    assert one(spark, T.normalize_question, "q::x") == "q: :x"
    assert one(spark, T.normalize_option, "Accept::  Yes.") == "accept: yes"
    assert one(spark, T.normalize_name, "  John \t  DOE ") == "john doe"
    assert one(spark, T.normalize_name, "   ") is None
    assert one(spark, T.py_strip, "　 a b\xa0\n") == "a b"


def test_stance_prefix(spark):
    def ps(s):
        r = one(spark, T.parse_stance_prefix, s)
        return (r["stance"], r["answer"])
    assert ps("ACCEPT: x") == ("Accept", "x")
    assert ps("Accept:") == ("Accept", "")
    assert ps("Lean toward: x") == ("Lean toward", "x")
    assert ps("Neutral") == (None, "Neutral")
    assert ps("agnostic/undecided") == ("Agnostic/undecided", "agnostic/undecided")


def test_canonicalize(spark):
    assert one(spark, T.canonicalize_stance, "Accept:") == "Accept:"
    assert one(spark, T.canonicalize_stance, "Lean toward: x") == "Lean towards: x"
    assert one(spark, T.canonicalize_stance, "Neutral towards: x") == "Neutral: x"
    assert one(spark, T.canonicalize_stance, "agnostic/undecided") == "Agnostic/undecided: agnostic/undecided"


def test_scores(spark):
    got = [one(spark, T.score_stance, s) for s in
           ["Accept", "Lean towards", "Neutral", "Lean against", "Reject", "Agnostic/undecided", "Other"]]
    assert got == [1.0, 0.75, 0.5, 0.25, 0.0, 0.5, None]


def test_parse_response_list(spark):
    f = T.parse_response_list
    assert one(spark, f, "[]") == []
    assert one(spark, f, "[a") == ["[a"]
    assert one(spark, f, '["a", null, ""]') == ["a"]
    assert one(spark, f, 'x "a" y "b"') == ["a", "b"]
    assert one(spark, f, "```json\n[\"A\", \"B\"]\n```") == ["A", "B"]
    assert one(spark, f, "['x']") == ["x"]
    assert one(spark, f, "plain") == ["plain"]


def test_extract_json_list(spark):
    f = T.extract_json_list
    assert one(spark, f, "```json\n[\"a\"]\n```") == ["a"]
    assert one(spark, f, '["a", "b"]') == ["a", "b"]
    assert one(spark, f, 'see ["x"] here') == ["x"]
    assert one(spark, f, "nothing") == ["nothing"]


def test_validate(spark):
    df = spark.createDataFrame([(["accept : yes", "ACCEPT YES"],), (["Accept: no"],), ([],)], "items array<string>")
    out = df.select(T.validate_response(F.col("items"), F.array(F.lit("Accept: yes")))).collect()
    assert [r[0]["valid"] for r in out] == [True, False, False]
    assert out[1][0]["message"] == "Invalid options: ['Accept: no']"
    assert out[2][0]["message"] == "Empty response"


def test_year_bin(spark):
    assert one(spark, T.year_bin, 2015, "int") == "2015-2019"
    assert one(spark, T.year_bin, 2014, "int") == "2010-2014"
    assert one(spark, T.year_bin, None, "int") is None


def test_misc(spark):
    assert one(spark, T.safe_filename, "Jöhn O'Neil (ed.)") == "Jöhn_ONeil_ed"
    base = "https://h.org/a/b.html?x=1#top"
    for href, want in [("x.html", "https://h.org/a/x.html"), ("/p", "https://h.org/p"), ("//cdn.z/x.e", "https://cdn.z/x.e"),
                       ("?a=1.e", "https://h.org/a/b.html?a=1.e"), ("#f", "https://h.org/a/b.html?x=1#f"),
                       ("../c/./d.html?q=..", "https://h.org/c/d.html?q=.."), ("..", "https://h.org/"), ("../../..", "https://h.org/"),
                       ("http://o.net/y", "http://o.net/y"), ("mailto:a@b.c", "mailto:a@b.c"), ("", "https://h.org/a/b.html?x=1")]:
        assert one(spark, lambda c: T.resolve_link(c, F.lit(base)), href) == want
    assert one(spark, lambda c: T.resolve_link(c, F.lit("https://h.org")), "x") == "https://h.org/x"
    assert one(spark, T.anonymized_id, 7, "int") == "Philosopher_0007"
    assert one(spark, T.is_blocked_page, "<p>Cloudflare Ray ID: 1</p>") is True
    assert one(spark, T.coerce_score, "NaN") is None
    assert one(spark, T.coerce_score, "0.25") == 0.25


def test_negatives(spark):
    df = spark.createDataFrame([("Accept: X", 0), ("Accept: X", 1), ("Skipped", 0), ("neutral", 0)], "t string, d int")
    out = [r[0] for r in df.select(PF.negative_stances(F.col("t"), F.col("d"))).collect()]
    assert out[0] == ["reject: x", "lean against: x"]
    assert out[1] == ["reject: x"]          # draw equals the opposite -> one negative
    assert out[2] == ["reject", "neutral"]
    assert out[3] == ["reject", "accept"]


def test_match_topic_ties_first(spark):
    topics = [("a", ["x"], "QA"), ("b", ["y"], "QB")]
    df = spark.createDataFrame([("x y",), ("y",), ("z",)], "t string")
    out = [r[0] for r in df.select(PF.match_topic(F.col("t"), topics)).collect()]
    assert out[0]["topic"] == "a" and out[1]["topic"] == "b" and out[2] is None


def test_persona_prompt(spark):
    df = spark.createDataFrame([(["A", "B"], ["C"], "Uni", "US", 2010, "MIT", "US")],
                               "areas_of_specialization array<string>, areas_of_interest array<string>, "
                               "phd_institution string, phd_country string, year_of_phd_degree int, "
                               "current_institution string, current_institution_country string")
    txt = df.select(P.persona_prompt()).first()[0]
    assert txt == ("You are a professional philosopher at MIT (US).\n\nYour Educational Background:\n"
                   "- PhD from Uni (US) in 2010\n\nYour Areas of Specialization:\n- A\n- B\n\n"
                   "Your Areas of Interest:\n- C\n\n")


def test_list_items_keep_strings_that_look_falsy(spark):
    parse = lambda s: one(spark, T.parse_response_list, s)
    assert parse('["false","0","Accept: x"]') == ["false", "0", "Accept: x"]
    assert parse('[false, 0, 0.0, null, "", "{}", " a "]') == ["{}", "a"]
    assert parse('[true, 1, {"a": 1}, {}]') == ["true", "1", '{"a":1}']


def test_invalid_items_are_printed_like_a_list(spark):
    df = spark.createDataFrame([(["it's", 'say "x"', "both ' and \""], ["Accept"])], "items array<string>, options array<string>")
    got = df.select(T.validate_response("items", "options")["message"]).first()[0]
    assert got == "Invalid options: " + repr(["it's", 'say "x"', "both ' and \""])


def test_validation_and_parsing_run_each_step_once(spark):
    """An option is normalised once a row, not once an item and use; a list is parsed once."""
    df = spark.createDataFrame([(["a"], ["b"], "x")], "items array<string>, options array<string>, raw string")

    def plan(c):
        return df.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()

    assert plan(T.validate_response("items", "options")).count("regexp_replace(") <= 8   # four for the options, four for an item
    p = plan(T.parse_response_list("raw"))
    assert p.count("from_json") + p.count("jsontostructs") <= 2 and p.count("regexp_extract(") <= 1


def test_validation_of_odd_items_and_options(spark):
    rows = [(["Accept:  x."], ["accept: x"]), (["accept x"], ["Accept:: x"]), (["n"], None), ([None, "n"], ["a"]), (["n"], ["a", None]),
            ([], ["a"]), (None, ["a"]), ([""], [""]), (["a", "p", "q", "r", "s"], ["a"])]
    df = spark.createDataFrame(rows, "items array<string>, options array<string>").coalesce(1)
    got = [tuple(r["v"]) for r in df.select(T.validate_response("items", "options").alias("v")).collect()]
    assert got == [(True, "Valid"), (True, "Valid"), (True, "Valid"), (False, "Invalid options: ['n']"), (True, "Valid"),
                   (False, "Empty response"), (False, "Empty response"), (True, "Valid"), (False, "Invalid options: ['p', 'q', 'r']")]
