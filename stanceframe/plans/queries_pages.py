"""Registered page queries over ``pages`` (HTM-1..6, AGG-17, AGG-20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stanceframe.operators import merge as M
from stanceframe.operators import pages as PG
from stanceframe.plans import sqltext as S
from stanceframe.plans.registry import register
from stanceframe.sources import fixtures as FX

# Named entities decoded by the SQL twin; the test pages hold no others (``&amp;`` last).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")]


def _decode(x: str) -> str:
    for ent, ch in ENTITIES:
        x = f"replace({x}, {S.q(ent)}, {S.q(ch)})"
    return x


def _frag_sql(inner: str, sep: str) -> str:
    s = (f"regexp_replace(regexp_replace({inner}, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', "
         f"chr(1), 'g'), '<[^>]*>', chr(1), 'g')")
    parts = f"list_transform(string_split({s}, chr(1)), lambda p: {S.strip(_decode('p'))})"
    return f"array_to_string(list_filter({parts}, lambda p: p <> ''), {sep})"


@register("page_title_text", f"""
SELECT page_id,
       CASE WHEN regexp_matches(html, '(?is)<h1\\b[^>]*>.*?</h1>')
            THEN {_frag_sql("regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)", "''")} END AS title,
       {_frag_sql("regexp_extract(html, '(?is)<body\\b[^>]*>(.*?)(?:</body>|$)', 1)", "chr(10)")} AS text
FROM pages""")
def q_page_title_text(spark, sf_dir):
    """HTM-6: page title (first h1) and body text, entities decoded."""
    return PG.page_title_text(FX.table(spark, sf_dir, "pages"))


# the pages quote every href twice; the engine's own pattern also takes single quotes and none
_A = r"""(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>"""


@register("page_links", f"""
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS BIGINT) AS link_pos, href, name,
       CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN starts_with(href, '/') THEN host || href
            ELSE regexp_replace(url, '[^/]*$', '') || href END AS url
FROM (SELECT page_id, url, host, href, i, {_frag_sql('itext', "''")} AS name FROM (
        SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host,
               unnest(hs) AS href, unnest(ts) AS itext, unnest(generate_series(1, len(hs))) AS i
        FROM (SELECT page_id, url, regexp_extract_all(html, {S.q(_A)}, 1) AS hs,
                     regexp_extract_all(html, {S.q(_A)}, 2) AS ts FROM pages)))
WHERE ends_with(href, 'e') AND lower(name) NOT IN ('here', 'click here', 'view')""")
def q_page_links(spark, sf_dir):
    """HTM-1: links whose href ends with ``e`` (generic texts dropped), resolved per page."""
    return PG.page_links(FX.table(spark, sf_dir, "pages"), suffix="e", rule="endswith")


# what the saved pages say, stated on the customers they are made of
_SURVEY_SQL = """
SELECT CAST(c_custkey AS VARCHAR) AS page_key, lower('Seg ' || c_mktsegment) AS question, 0 AS pos,
       CASE WHEN c_custkey % 8 = 0 THEN 'Skipped it' ELSE 'Accept:' || c_mktsegment || ' view' END AS answer
FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'combined ' || c_nationkey, 0, 'lean toward: view ' || c_custkey FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'combined ' || c_nationkey, 1, 'reject' FROM customer WHERE c_custkey % 4 = 0"""


@register("survey_table_answers", f"SELECT * FROM ({_SURVEY_SQL})")
def q_survey_table_answers(spark, sf_dir):
    """HTM-2/3: survey-table answers of every saved page (last duplicate question wins)."""
    return PG.survey_table_answers(FX.saved_pages(spark, sf_dir))


@register("page_qa_rows", """
SELECT CAST(c_custkey AS VARCHAR) AS page_key, 0 AS pos, 'Question ' || c_custkey AS question, c_mktsegment AS answer FROM customer WHERE c_custkey % 4 = 2
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 1, 'Second ' || c_nationkey, 'maybe' FROM customer WHERE c_custkey % 4 = 2
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 0, 'Seg ' || c_mktsegment, 'Accept:' || c_mktsegment || ' view' FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 1, 'Combined ' || c_nationkey, 'Accept a combination of answers:Lean   Towardview ' || c_custkey || 'Reject'
  FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 2, 'SEG ' || c_mktsegment, 'Skipped' || chr(10) || '  it' FROM customer WHERE c_custkey % 8 = 0""")
def q_page_qa_rows(spark, sf_dir):
    """HTM-4: generic question/answer rows from tables and definition lists of every saved page."""
    return PG.page_qa_rows(FX.saved_pages(spark, sf_dir))


@register("profile_details", """
SELECT CAST(c_custkey AS VARCHAR) AS page_key,
       CASE WHEN c_custkey % 4 = 1 THEN 'Ethics' || chr(31) || 'Logic ' || c_custkey ELSE '' END AS areas_of_specialization,
       CASE WHEN c_custkey % 8 = 1 THEN 'Law & Order' ELSE '' END AS areas_of_interest, CAST(NULL AS VARCHAR) AS location,
       CASE WHEN c_custkey % 4 = 1 THEN 'Old ' || c_mktsegment || CASE WHEN c_custkey % 8 = 5 THEN ', Dept' ELSE '' END
            || ', PhD, ' || (1990 + c_custkey % 20) END AS phd_institution,
       CASE WHEN c_custkey % 4 = 1 THEN 'University ' || c_nationkey END AS current_institution, CAST(NULL AS VARCHAR) AS error
FROM customer""")
def q_profile_details(spark, sf_dir):
    """HTM-5: profile details parsed from every saved page; the two area lists are joined with the
    unit separator for comparison."""
    d = PG.profile_details(FX.saved_pages(spark, sf_dir))
    return d.select("page_key", *[F.array_join(c, "\x1f").alias(c) for c in ("areas_of_specialization",
                                                                             "areas_of_interest")],
                    "location", "phd_institution", "current_institution", "error")


@register("extraction_report", """
SELECT CAST(c_custkey AS VARCHAR) AS page_key, CAST(CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 0 END AS BIGINT) AS n_questions,
       CAST(CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE 0 END AS BIGINT) AS n_answers, c_custkey % 4 <> 0 AS no_answers FROM customer""")
def q_extraction_report(spark, sf_dir):
    """AGG-20: answers extracted per saved page, and the pages that yielded none."""
    p = FX.saved_pages(spark, sf_dir)
    return PG.extraction_report(p, PG.survey_table_answers(p))


@register("profile_coverage", """
SELECT CAST(count(*) AS BIGINT) AS n_profiles,
       CAST(count_if(len(areas_of_specialization) > 0) AS BIGINT) AS with_specialization,
       100.0 * count_if(len(areas_of_specialization) > 0) / count(*) AS pct_specialization,
       CAST(count_if(len(areas_of_interest) > 0) AS BIGINT) AS with_interest,
       100.0 * count_if(len(areas_of_interest) > 0) / count(*) AS pct_interest,
       CAST(count_if(coalesce(phd_institution, '') <> '') AS BIGINT) AS with_phd,
       100.0 * count_if(coalesce(phd_institution, '') <> '') / count(*) AS pct_phd,
       CAST(0 AS BIGINT) AS with_error, CAST(0.0 AS DOUBLE) AS pct_error
FROM fx_details""", ("pct_specialization", "pct_interest", "pct_phd", "pct_error"))
def q_profile_coverage(spark, sf_dir):
    """AGG-17: share of scraped profile records with each field and with an error."""
    return M.profile_coverage(FX.profile_details(spark, sf_dir).withColumn("error", F.lit(None).cast("string")))
