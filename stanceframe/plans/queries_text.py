"""Registered text, model-output and merge queries (EXP-*, FLT-2, JOIN-1..8, AGG-3/4/15/16/18/19, SNK-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stanceframe.functions import prompts as P
from stanceframe.functions import text as T
from stanceframe.operators import batch as B
from stanceframe.operators import merge as M
from stanceframe.operators.cells import first_valid_cells, normalize_cells
from stanceframe.operators.ordering import dense_index
from stanceframe.plans import sqltext as S
from stanceframe.plans.registry import register
from stanceframe.sources import fixtures as FX

SEP = "\x1f"  # list items joined with the unit separator for comparison
MARKER = "people.example.org/profiles/"
HOST = "https://people.example.org"


def _sep_join(col):
    return F.array_join(col, SEP)


# --- identity keys ---------------------------------------------------------------

@register("slug_from_profile_url", f"""
SELECT respondent, url,
  CASE WHEN len(p) >= 2 AND p[-2] = 'profiles' THEN p[-1] END AS slug FROM (
  SELECT respondent, url, string_split(regexp_replace(
      regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '/') AS p
  FROM fx_profiles)""")
def q_slug_from_profile_url(spark, sf_dir):
    """EXP-1: slug from the profile URL path (second-last segment must be ``profiles``)."""
    return FX.profiles(spark, sf_dir).select("respondent", "url", T.slug_from_profile_url("url").alias("slug"))


@register("slug_after_marker", f"""
SELECT respondent, url, CASE WHEN contains(url, {S.q(MARKER)}) THEN string_split(url, {S.q(MARKER)})[-1] END AS slug
FROM fx_profiles""")
def q_slug_after_marker(spark, sf_dir):
    """EXP-2: everything after the last profile marker."""
    return FX.profiles(spark, sf_dir).select("respondent", "url", T.slug_after_marker("url", MARKER).alias("slug"))


@register("slug_second_last", """
SELECT page_id, url, CASE WHEN contains(url, '/') THEN coalesce(string_split(url, '/')[-2], 'unknown')
                          ELSE 'unknown' END AS slug FROM pages""")
def q_slug_second_last(spark, sf_dir):
    """EXP-3: second-last ``/`` segment of each page URL (``unknown`` when absent)."""
    return FX.table(spark, sf_dir, "pages").select("page_id", "url",
                                                   T.slug_second_last("url", "unknown").alias("slug"))


@register("normalize_name", f"SELECT respondent, name, {S.normalize_name('name')} AS normalized FROM fx_profiles")
def q_normalize_name(spark, sf_dir):
    """EXP-4: normalised respondent names."""
    return FX.profiles(spark, sf_dir).select("respondent", "name", T.normalize_name("name").alias("normalized"))


@register("normalize_question", f"""
SELECT p_partkey, raw, {S.normalize_question('raw')} AS normalized FROM (
  SELECT p_partkey, '  ' || p_brand || ':' || p_type || ' ' AS raw FROM part)""")
def q_normalize_question(spark, sf_dir):
    """EXP-5: question-name normalisation on ``brand:type`` strings."""
    p = FX.table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit("  "), F.col("p_brand"), F.lit(":"), F.col("p_type"), F.lit(" ")).alias("raw"))
    return p.select("p_partkey", "raw", T.normalize_question("raw").alias("normalized"))


@register("normalize_option", f"""
SELECT p_partkey, raw, {S.normalize_option('raw')} AS normalized FROM (
  SELECT p_partkey, p_type || ' ::  ' || p_name || '.!' AS raw FROM part)""")
def q_normalize_option(spark, sf_dir):
    """EXP-6: option normalisation (case, spaces, trailing punctuation, colons)."""
    p = FX.table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.col("p_type"), F.lit(" ::  "), F.col("p_name"), F.lit(".!")).alias("raw"))
    return p.select("p_partkey", "raw", T.normalize_option("raw").alias("normalized"))


# --- stance parsing ----------------------------------------------------------------

_ST, _AN = S.stance_prefix("text")


@register("parse_stance_prefix", f"SELECT ord, text, {_ST} AS stance, {_AN} AS answer FROM fx_stance")
def q_parse_stance_prefix(spark, sf_dir):
    """EXP-7: (stance, answer) by ordered case-insensitive prefixes."""
    s = FX.stance_texts(spark, sf_dir)
    ps = T.parse_stance_prefix("text")
    return s.select("ord", "text", ps["stance"].alias("stance"), ps["answer"].alias("answer"))


@register("canonicalize_stance", f"SELECT ord, text, {S.canonicalize('text')} AS canonical FROM fx_stance")
def q_canonicalize_stance(spark, sf_dir):
    """EXP-8: canonical ``Stance: answer`` by anchored patterns (needs an answer)."""
    return FX.stance_texts(spark, sf_dir).select("ord", "text", T.canonicalize_stance("text").alias("canonical"))


@register("score_stance", f"""
SELECT ord, stance, {S.score('stance')} AS score FROM (SELECT ord, {_ST} AS stance FROM fx_stance)""", ("score",))
def q_score_stance(spark, sf_dir):
    """EXP-9: stance -> score (unknown stance -> NULL)."""
    ps = T.parse_stance_prefix("text")
    return FX.stance_texts(spark, sf_dir).select("ord", ps["stance"].alias("stance")) \
        .select("ord", "stance", T.score_stance("stance").alias("score"))


@register("cell_key", f"""
SELECT ord, CASE WHEN stance = 'Agnostic/undecided' THEN question || ':agnostic/undecided'
                 ELSE question || ':' || answer END AS cell_key
FROM (SELECT ord, question, {_ST} AS stance, {_AN} AS answer FROM fx_stance) WHERE stance IS NOT NULL""")
def q_cell_key(spark, sf_dir):
    """EXP-27: ``question:answer`` cell keys of parsed stances."""
    ps = T.parse_stance_prefix("text")
    s = FX.stance_texts(spark, sf_dir).select("ord", "question", ps.alias("ps")).where("ps.stance IS NOT NULL")
    return s.select("ord", T.cell_key(F.col("question"), F.col("ps.stance"), F.col("ps.answer")).alias("cell_key"))


@register("coerce_score", """
SELECT ord, raw, CASE WHEN isnan(TRY_CAST(raw AS DOUBLE)) THEN NULL ELSE TRY_CAST(raw AS DOUBLE) END AS score FROM (
  SELECT event_id AS ord, CASE event_id % 3 WHEN 0 THEN regexp_extract(props, '([0-9]+)', 1)
                                            WHEN 1 THEN event_type ELSE 'NaN' END AS raw FROM events)""", ("score",))
def q_coerce_score(spark, sf_dir):
    """EXP-20: numeric coercion of text values (non-numeric and NaN -> NULL)."""
    ev = FX.table(spark, sf_dir, "events")
    raw = (F.when(F.col("event_id") % 3 == 0, F.regexp_extract("props", "([0-9]+)", 1))
           .when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.lit("NaN")))
    return ev.select(F.col("event_id").alias("ord"), raw.alias("raw")).select(
        "ord", "raw", T.coerce_score("raw").alias("score"))


# --- model output lists ------------------------------------------------------------

def _explode_items(df, arr, key="ord"):
    return df.select(key, F.posexplode(arr).alias("item_pos", "item")).select(
        key, F.col("item_pos").cast("bigint").alias("item_pos"), "item")


def _sql_explode(expr: str, src: str, key: str = "ord") -> str:
    return f"""
SELECT {key}, CAST(unnest(generate_series(0, len(items) - 1)) AS BIGINT) AS item_pos, unnest(items) AS item
FROM (SELECT {key}, {expr} AS items FROM {src})"""


@register("parse_response_list", _sql_explode(S.parse_response_list("raw"), "fx_llm_raw"))
def q_parse_response_list(spark, sf_dir):
    """EXP-10: answer lists parsed from raw model text, one row per item."""
    r = FX.llm_raw(spark, sf_dir)
    return _explode_items(r, T.parse_response_list("raw"))


@register("extract_json_list", _sql_explode(S.extract_json_list("raw"), "fx_llm_raw"))
def q_extract_json_list(spark, sf_dir):
    """EXP-11: JSON list extraction (fenced, whole text, bracketed run, else the text)."""
    r = FX.llm_raw(spark, sf_dir)
    return _explode_items(r, T.extract_json_list("raw"))


def validate_items_sql(items: str, options: str) -> str:
    no = f"list_transform({options}, lambda o: {S.normalize_option('o')})"
    nnc = f"list_transform({options}, lambda o: replace({S.normalize_option('o')}, ':', ''))"
    inv = (f"list_filter({items}, lambda i: NOT (list_contains({options}, i) OR list_contains({no}, "
           f"{S.normalize_option('i')}) OR list_contains({nnc}, replace({S.normalize_option('i')}, ':', ''))))")
    return inv


_ESC = (r"replace(replace(replace(replace(x, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), "
        r"chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')")


def invalid_message_sql(inv: str) -> str:
    """The message on invalid items: the first three as a list prints them."""
    return (f"""'Invalid options: [' ||
                 array_to_string(list_transform({inv}[1:3], lambda x: CASE
                   WHEN contains(x, '''') AND NOT contains(x, '"') THEN '"' || {_ESC} || '"'
                   ELSE '''' || replace({_ESC}, '''', chr(92) || '''') || '''' END), ', ') || ']'""")


@register("validate_response", f"""
SELECT ord, CASE WHEN len(items) = 0 THEN false ELSE len(inv) = 0 END AS valid,
       CASE WHEN len(items) = 0 THEN 'Empty response'
            WHEN len(inv) > 0 THEN {invalid_message_sql('inv')}
            ELSE 'Valid' END AS message
FROM (SELECT ord, items, {validate_items_sql('items', 'options')} AS inv FROM (
  SELECT r.ord, {S.parse_response_list('r.raw')} AS items, o.options FROM fx_llm_raw r JOIN fx_options o USING (question)))""")
def q_validate_response(spark, sf_dir):
    """EXP-12: parsed answers validated against the question's options."""
    r = FX.llm_raw(spark, sf_dir).join(FX.question_options(spark, sf_dir), "question")
    # one step a column, so that neither runs again for a use of its result
    v = r.withColumn("items", T.parse_response_list("raw")).withColumn("v", T.validate_response("items", "options"))
    return v.select("ord", F.col("v.valid").alias("valid"), F.col("v.message").alias("message"))


# --- misc scalar functions ---------------------------------------------------------

@register("year_bin", f"SELECT respondent, year_of_phd_degree, {S.year_bin('year_of_phd_degree')} AS year_bin FROM fx_profiles")
def q_year_bin(spark, sf_dir):
    """EXP-19: 5-year bins of the PhD year."""
    return FX.profiles(spark, sf_dir).select("respondent", "year_of_phd_degree",
                                             T.year_bin("year_of_phd_degree").alias("year_bin"))


_BLOCK_SQL = " OR ".join(f"contains(lower(html), {S.q(p)})" for p in T.BLOCKED_PHRASES)


@register("is_blocked_page", f"""
SELECT page_id, coalesce({_BLOCK_SQL}, false) AS blocked,
       coalesce(contains(lower(html), 'cloudflare') AND contains(lower(html), 'blocked'), false) AS blocked_simple
FROM pages""")
def q_is_blocked_page(spark, sf_dir):
    """EXP-21: blocked-page predicates on every page."""
    return FX.table(spark, sf_dir, "pages").select(
        "page_id", T.is_blocked_page("html").alias("blocked"), T.is_blocked_page_simple("html").alias("blocked_simple"))


@register("safe_filename", """
SELECT page_id, title, replace(regexp_replace(regexp_replace(title, '[^\\pL\\pN_\\s-]', '', 'g'), '^\\s+|\\s+$', '', 'g'),
                               ' ', '_') AS file_name,
       left(replace(regexp_replace(regexp_replace(title, '[^\\pL\\pN_\\s-]', '', 'g'), '^\\s+|\\s+$', '', 'g'),
                    ' ', '_'), 50) AS file_name_50
FROM (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages)""")
def q_safe_filename(spark, sf_dir):
    """EXP-22: safe file names from page titles (full and cut to 50)."""
    p = FX.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1)
                                                .alias("title"))
    return p.select("page_id", "title", T.safe_filename("title").alias("file_name"),
                    T.safe_filename("title", 50).alias("file_name_50"))


@register("name_from_file", """
SELECT respondent, replace(lower(replace(name, '#', '-')) || '_views.html', '_views.html', '') AS respondent_key
FROM fx_profiles""")
def q_name_from_file(spark, sf_dir):
    """EXP-23: respondent key from ``<slug>_views.html`` file names."""
    p = FX.profiles(spark, sf_dir).select(
        "respondent", F.concat(F.lower(F.replace("name", F.lit("#"), F.lit("-"))), F.lit("_views.html")).alias("f"))
    return p.select("respondent", T.name_from_file("f").alias("respondent_key"))


_HREF = '<a [^>]*href="([^"]*)"'


# every kind of link next to the page's own: other host, query, fragment, dot segments, nothing
_LINK_KINDS = ("'//other.example/a.html'", "'?q=' || page_id", "'#s' || page_id", "'sub/../x' || page_id || '.html'", "'./y.html'", "''",
               "'mailto:a@b.example'")


@register("resolve_link", f"""
SELECT page_id, link_pos, href, CASE
         WHEN regexp_matches(href, '^[a-z]+:') THEN href
         WHEN starts_with(href, '//') THEN split_part(url, '//', 1) || href
         WHEN starts_with(href, '/') THEN site || href
         WHEN href = '' OR starts_with(href, '#') THEN split_part(url, '#', 1) || href
         WHEN starts_with(href, '?') THEN page || href
         ELSE regexp_extract(page || CASE WHEN page = site THEN '/' ELSE '' END, '^(.*/)', 1) || replace(replace(href, 'sub/../', ''), './', '') END AS resolved
FROM (SELECT page_id, url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS site, split_part(split_part(url, '#', 1), '?', 1) AS page,
             CAST(unnest(generate_series(0, len(h) - 1)) AS BIGINT) AS link_pos, unnest(h) AS href
      FROM (SELECT page_id, url, list_concat(regexp_extract_all(html, {S.q(_HREF)}, 1), [{', '.join(_LINK_KINDS)}]) AS h FROM pages))""")
def q_resolve_link(spark, sf_dir):
    """EXP-24: every anchor href of a page, and one of each other kind, resolved against its URL."""
    kinds = F.array(*[F.expr(k) for k in _LINK_KINDS])
    p = FX.table(spark, sf_dir, "pages").select(
        "page_id", "url", F.concat(F.regexp_extract_all("html", F.lit(_HREF), 1), kinds).alias("h"))
    x = p.select("page_id", "url", F.posexplode("h").alias("link_pos", "href"))
    return x.select("page_id", F.col("link_pos").cast("bigint").alias("link_pos"), "href",
                    T.resolve_link("href", "url").alias("resolved"))


@register("anonymized_id", """
SELECT doc_id, printf('Philosopher_%04d', row_number() OVER (ORDER BY doc_id) - 1) AS anon_id FROM documents""")
def q_anonymized_id(spark, sf_dir):
    """EXP-16: ``Philosopher_%04d`` of each record's input position (by doc id)."""
    d = dense_index(FX.table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], "pos")
    return d.select("doc_id", T.anonymized_id("pos").alias("anon_id"))


@register("profile_completeness", """
SELECT profile_url, CAST((CASE WHEN len(areas_of_specialization) > 0 THEN 1 ELSE 0 END)
     + (CASE WHEN len(areas_of_interest) > 0 THEN 1 ELSE 0 END)
     + (CASE WHEN coalesce(phd_institution, '') <> '' THEN 1 ELSE 0 END)
     + (CASE WHEN coalesce(current_institution, '') <> '' THEN 1 ELSE 0 END) AS INT) AS completeness
FROM fx_details""")
def q_profile_completeness(spark, sf_dir):
    """EXP-25: number of non-empty profile fields."""
    d = FX.profile_details(spark, sf_dir)
    return d.select("profile_url", T.profile_completeness("areas_of_specialization", "areas_of_interest",
                                                          "phd_institution", "current_institution")
                    .cast("int").alias("completeness"))


# --- prompts -------------------------------------------------------------------------

@register("persona_prompt", f"SELECT respondent, {S.persona_prompt()} AS prompt FROM fx_profile_records")
def q_persona_prompt(spark, sf_dir):
    """EXP-13: persona prompt per profile."""
    return FX.profile_records(spark, sf_dir).select("respondent", P.persona_prompt().alias("prompt"))


@register("question_prompt", f"SELECT question, {S.question_prompt('question', 'options')} AS prompt FROM fx_options")
def q_question_prompt(spark, sf_dir):
    """EXP-14: question prompt with option bullets."""
    return FX.question_options(spark, sf_dir).select("question", P.question_prompt("question", "options")
                                                     .alias("prompt"))


@register("anon_persona_prompt", f"SELECT profile_url, {S.anon_persona_prompt()} AS prompt FROM fx_details")
def q_anon_persona_prompt(spark, sf_dir):
    """EXP-15: anonymised persona prompt per profile detail record."""
    return FX.profile_details(spark, sf_dir).select("profile_url", P.anon_persona_prompt().alias("prompt"))


# --- requests (JOIN-5, WIN-1, SNK-4, JOIN-8) ---------------------------------------------

REQ_SQL = f"""
, resp AS (SELECT *, row_number() OVER (ORDER BY respondent) - 1 AS resp_pos FROM fx_profile_records),
  qs AS (SELECT *, row_number() OVER (ORDER BY question) - 1 AS q_pos FROM fx_options),
  nq AS (SELECT count(*) AS n FROM qs),
  reqs AS (SELECT 'req_' || CAST(resp_pos * n + q_pos AS VARCHAR) AS custom_id, CAST(resp_pos * n + q_pos AS BIGINT) AS req_no,
                  coalesce(name, 'Unknown') AS philosopher_name, question,
                  {S.persona_prompt()} || {S.question_prompt('question', 'options')} AS prompt
           FROM resp, qs, nq)
"""


def _requests(spark, sf_dir):
    return B.build_requests(FX.profile_records(spark, sf_dir), FX.question_options(spark, sf_dir))


@register("build_requests", REQ_SQL + "SELECT * FROM reqs")
def q_build_requests(spark, sf_dir):
    """JOIN-5/WIN-1: every respondent x question request with ``req_{n}`` id and full prompt."""
    return _requests(spark, sf_dir)


@register("request_shards", REQ_SQL + """
SELECT CAST(floor(req_no / 100) AS BIGINT) AS shard, CAST(count(*) AS BIGINT) AS num_requests,
       min(req_no) AS first_req, max(req_no) AS last_req FROM reqs GROUP BY ALL""")
def q_request_shards(spark, sf_dir):
    """SNK-4: requests written as 100-request JSONL shards with numbered names, read back with their manifest."""
    from stanceframe.sources import shards as SH
    from stanceframe.sources.sinks import write_request_shards
    path = write_request_shards(_requests(spark, sf_dir), size=100)
    lines = SH.read_shards(spark, path).withColumn("req_no", F.get_json_object("value", "$.req_no").cast("bigint"))
    got = lines.groupBy("shard").agg(F.min("req_no").alias("first_req"), F.max("req_no").alias("last_req"))
    return SH.read_manifest(spark, path).select(F.col("batch_num").alias("shard"), "num_requests").join(got, "shard")


# --- batch outputs (JOIN-6/7, FLT-2, AGG-3/4/15/16/19) --------------------------------------

JBR_SQL = f"""
, jbr AS (SELECT o.custom_id, o.ord, coalesce(m.philosopher_name, '') AS philosopher_name,
                 coalesce(m.question, 'Unknown') AS question, o.status_code = 200 AS success,
                 CASE WHEN o.status_code = 200 THEN {S.parse_response_list('o.raw')} ELSE []::VARCHAR[] END AS parsed,
                 CASE WHEN o.status_code = 200 THEN NULL ELSE 'HTTP ' || CAST(o.status_code AS VARCHAR) END AS error,
                 CAST(CASE WHEN o.status_code = 200 THEN o.prompt_tokens ELSE 0 END AS BIGINT) AS input_tokens,
                 CAST(CASE WHEN o.status_code = 200 THEN o.completion_tokens ELSE 0 END AS BIGINT) AS output_tokens,
                 o.attempts
          FROM fx_outputs o LEFT JOIN fx_mapping m USING (custom_id))
"""


def _jbr(spark, sf_dir):
    return B.join_batch_results(FX.batch_outputs(spark, sf_dir), FX.request_mapping(spark, sf_dir))


@register("join_batch_results", JBR_SQL + """
SELECT custom_id, philosopher_name, question, success, error, input_tokens, output_tokens,
       CAST(len(parsed) AS INT) AS n_parsed, array_to_string(parsed, chr(31)) AS parsed_text FROM jbr""")
def q_join_batch_results(spark, sf_dir):
    """JOIN-6: batch outputs joined to the request mapping; success and error records."""
    j = _jbr(spark, sf_dir)
    return j.select("custom_id", "philosopher_name", "question", "success", "error", "input_tokens",
                    "output_tokens", F.size("parsed").alias("n_parsed"), _sep_join(F.col("parsed")).alias("parsed_text"))


@register("usable_responses", JBR_SQL + """
SELECT custom_id, philosopher_name, question FROM jbr
WHERE coalesce(philosopher_name, '') <> '' AND coalesce(question, '') <> '' AND success""")
def q_usable_responses(spark, sf_dir):
    """FLT-2: records with a name, a question and success."""
    return B.usable_responses(_jbr(spark, sf_dir)).select("custom_id", "philosopher_name", "question")


_IST, _IAN = S.stance_prefix("item")
ITEMS_SQL = JBR_SQL + f"""
, usable AS (SELECT * FROM jbr WHERE coalesce(philosopher_name, '') <> '' AND coalesce(question, '') <> '' AND success),
  items AS (SELECT philosopher_name, question, ord, unnest(generate_series(0, len(parsed) - 1)) AS item_pos,
                   unnest(parsed) AS item FROM usable),
  items2 AS (SELECT *, {_IST} AS stance, {_IAN} AS answer FROM items),
  items3 AS (SELECT *, CASE WHEN stance = 'Agnostic/undecided' THEN question || ':agnostic/undecided'
                            ELSE question || ':' || answer END AS cell_key,
                    coalesce({S.score('stance')}, CASE WHEN stance = 'Agnostic/undecided' THEN CAST(0.5 AS DOUBLE) END) AS score
             FROM items2 WHERE stance IS NOT NULL),
  mcells AS (SELECT philosopher_name, cell_key, arg_min(score, row(ord, item_pos)) AS score,
                    min(row(ord, item_pos)) AS first_at
             FROM items3 WHERE score IS NOT NULL GROUP BY ALL)
"""


def _model_cells(spark, sf_dir):
    return B.first_valid_model_cells(_jbr(spark, sf_dir))


@register("first_valid_cells", ITEMS_SQL + "SELECT philosopher_name, cell_key, score FROM mcells", ("score",))
def q_first_valid_cells(spark, sf_dir):
    """AGG-3: first valid score per (respondent, question:answer) from model answers."""
    return _model_cells(spark, sf_dir).select("philosopher_name", "cell_key", "score")


@register("normalize_cells", ITEMS_SQL + f"""
SELECT philosopher_name, question, arg_max(score, first_at) AS score FROM (
  SELECT philosopher_name, {S.normalize_question('cell_key')} AS question, score, first_at FROM mcells) GROUP BY ALL""",
          ("score",))
def q_normalize_cells(spark, sf_dir):
    """AGG-4: question keys normalised; on collision the later key's value wins."""
    c = _model_cells(spark, sf_dir)
    c = c.select(F.lit("model").alias("model"), F.col("philosopher_name").alias("respondent"),
                 F.col("cell_key").alias("question"), "score",
                 F.col("first_at").alias("ord"))
    return normalize_cells(c).select(F.col("respondent").alias("philosopher_name"), "question", "score")


CLS_SQL = f"""
, cls AS (SELECT o.custom_id, o.ord, m.philosopher_name, m.question, o.prompt_tokens, o.completion_tokens,
                 CASE WHEN m.custom_id IS NULL THEN 'no mapping' WHEN o.status_code <> 200 THEN 'non-200 status'
                      WHEN o.raw IS NULL THEN 'no choices' WHEN o.raw = '' THEN 'empty content'
                      WHEN coalesce(len({S.extract_json_list('o.raw')}), 0) <= 0 THEN 'unparsable' END AS reject_reason,
                 list_transform({S.extract_json_list('o.raw')}, lambda x: {S.canonicalize('x')}) AS parsed
          FROM fx_outputs o LEFT JOIN fx_mapping m USING (custom_id))
"""


def _outputs_mapping(spark, sf_dir):
    return FX.batch_outputs(spark, sf_dir), FX.request_mapping(spark, sf_dir)


@register("batch_results_clean", CLS_SQL + """
SELECT custom_id, philosopher_name, question, array_to_string(parsed, chr(31)) AS parsed_text FROM cls
WHERE reject_reason IS NULL""")
def q_batch_results_clean(spark, sf_dir):
    """JOIN-7: accepted batch rows with canonical ``Stance: answer`` items."""
    c = B.batch_results_clean(*_outputs_mapping(spark, sf_dir))
    return c.select("custom_id", "philosopher_name", "question", _sep_join(F.col("parsed")).alias("parsed_text"))


@register("batch_reject_counts", CLS_SQL + """
SELECT reject_reason, CAST(count(*) AS BIGINT) AS n FROM cls WHERE reject_reason IS NOT NULL GROUP BY ALL""")
def q_batch_reject_counts(spark, sf_dir):
    """JOIN-7: rejected batch rows counted by reason."""
    return B.batch_reject_counts(*_outputs_mapping(spark, sf_dir))


PRICE_IN, PRICE_OUT = 1.25, 2.50  # family-1 prices per million tokens (parameters)


@register("token_cost", JBR_SQL + f"""
SELECT CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       CAST(count(*) AS BIGINT) AS n_requests, CAST(count_if(success) AS BIGINT) AS n_success,
       sum(input_tokens) / 1e6 * {PRICE_IN} AS input_cost, sum(output_tokens) / 1e6 * {PRICE_OUT} AS output_cost,
       sum(input_tokens) / 1e6 * {PRICE_IN} + sum(output_tokens) / 1e6 * {PRICE_OUT} AS total_cost FROM jbr""",
          ("input_cost", "output_cost", "total_cost"))
def q_token_cost(spark, sf_dir):
    """AGG-15: token totals and cost at the given per-million prices."""
    return B.token_cost(_jbr(spark, sf_dir), PRICE_IN, PRICE_OUT)


# prices per million tokens by model family; the last family has none
PRICES = (("family-a", 2.5, 10.0), ("family-b", 0.15, 0.6))
_FAMILY = "CASE ord % 3 WHEN 0 THEN 'family-a' WHEN 1 THEN 'family-b' ELSE 'family-c' END"


@register("token_cost_by_family", JBR_SQL + f"""
, g AS (SELECT {_FAMILY} AS family, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
               CAST(count(*) AS BIGINT) AS n_requests, CAST(count_if(success) AS BIGINT) AS n_success FROM jbr GROUP BY 1),
  pr(family, pi, po) AS (VALUES {', '.join(f"('{f}', CAST({i} AS DOUBLE), CAST({o} AS DOUBLE))" for f, i, o in PRICES)})
SELECT family, input_tokens, output_tokens, n_requests, n_success, input_tokens / 1e6 * pi AS input_cost,
       output_tokens / 1e6 * po AS output_cost, input_tokens / 1e6 * pi + output_tokens / 1e6 * po AS total_cost
FROM g LEFT JOIN pr USING (family)""", ("input_cost", "output_cost", "total_cost"))
def q_token_cost_by_family(spark, sf_dir):
    """AGG-15: token totals and cost per model family, each at its own prices (NULL where a family has none)."""
    results = _jbr(spark, sf_dir).withColumn("family", F.expr(_FAMILY))
    prices = spark.createDataFrame(list(PRICES), "family string, price_in double, price_out double")
    return B.token_cost_by_family(results, prices)


@register("run_outcomes", JBR_SQL + f"""
, rec AS (SELECT j.*, j.success AND len(v.inv) = 0 AND len(j.parsed) > 0 AS ok FROM jbr j JOIN (
            SELECT custom_id, {validate_items_sql(S.parse_response_list('r.raw'), 'o.options')} AS inv
            FROM fx_outputs r JOIN fx_mapping m USING (custom_id) JOIN fx_options o ON o.question = m.question) v
          USING (custom_id))
SELECT CAST(count(*) AS BIGINT) AS processed, CAST(count_if(ok) AS BIGINT) AS n_success,
       CAST(count_if(NOT ok) AS BIGINT) AS n_failed, CAST(count_if(ok AND attempts > 1) AS BIGINT) AS n_retried,
       avg(output_tokens / 10.0 + attempts) AS avg_time,
       100.0 * count_if(ok) / count(*) AS pct_success, 100.0 * count_if(ok AND attempts > 1) / count(*) AS pct_retried,
       100.0 * count_if(NOT ok) / count(*) AS pct_failed FROM rec""",
          ("avg_time", "pct_success", "pct_retried", "pct_failed"))
def q_run_outcomes(spark, sf_dir):
    """AGG-16: run outcome counts; success = HTTP 200 and the parsed answer validates."""
    j = _jbr(spark, sf_dir).join(FX.question_options(spark, sf_dir), "question")
    v = T.validate_response(F.col("parsed"), F.col("options"))
    rec = (j.join(FX.batch_outputs(spark, sf_dir).select("custom_id", "attempts"), "custom_id")
           .select((F.col("success") & v["valid"]).alias("success"), "attempts",
                   (F.col("output_tokens") / 10.0 + F.col("attempts")).alias("generation_time")))
    return B.run_outcomes(rec)


@register("shard_status", """
SELECT status, CAST(count(*) AS BIGINT) AS n_shards FROM (
  SELECT shard, CASE WHEN shard % 5 = 0 THEN 'pending' WHEN shard % 5 = 1 THEN 'active'
                     WHEN bool_and(status_code = 200 OR shard % 5 = 2) THEN 'completed' ELSE 'failed' END AS status
  FROM (SELECT CAST(floor(ord / 100) AS BIGINT) AS shard, status_code FROM fx_outputs) GROUP BY shard) GROUP BY status""")
def q_shard_status(spark, sf_dir):
    """AGG-19: shards of 100 requests by status; of five shards one has no output yet, one half of them,
    one only good ones."""
    k, ok = F.floor(F.col("ord") / 100) % 5, F.col("status_code") == 200
    seen = F.when((k == 0) | (k == 1) & (F.col("ord") % 2 == 0), F.lit(None).cast("boolean")).when(k == 2, F.lit(True)).otherwise(ok)
    o = FX.batch_outputs(spark, sf_dir).withColumn("ok", seen)
    return B.shard_status(B.shard_manifest(B.assign_shards(o, 100, "ord"), "ok"))


@register("pending_tasks", REQ_SQL + JBR_SQL + """
SELECT custom_id, req_no, philosopher_name, question FROM reqs r
WHERE NOT EXISTS (SELECT 1 FROM jbr j WHERE j.success AND j.philosopher_name = r.philosopher_name
                                          AND j.question = r.question)
ORDER BY req_no LIMIT 1000""")
def q_pending_tasks(spark, sf_dir):
    """JOIN-8: requests whose (name, question) has no successful result yet; first 1000 by order."""
    done = B.usable_responses(_jbr(spark, sf_dir))
    return B.pending_tasks(_requests(spark, sf_dir), done, limit=1000).select(
        "custom_id", "req_no", "philosopher_name", "question")


# --- merges (JOIN-1..4, SET-4, AGG-18) ----------------------------------------------------

# survey answers: some of respondents without a profile, some in two records, some with repeated questions
SURVEY_SQL = """
, cell AS (SELECT respondent, question, min_by(score, ord) AS score FROM fx_answers WHERE model = 'human' GROUP BY ALL),
  raw_survey AS (
    SELECT CASE WHEN c.c_custkey % 50 = 0 THEN 'guest-' || c.c_custkey ELSE lower(replace(c.c_name, '#', '-')) END AS philosopher,
           CASE WHEN c.c_custkey % 7 = 0 THEN CAST(length(a.question) % 2 AS INTEGER) ELSE 0 END AS rec_pos, a.question,
           CASE WHEN o.ord = 1 THEN 1.0 - a.score ELSE a.score END AS score, o.ord
    FROM cell a JOIN customer c ON c.c_custkey = a.respondent JOIN (VALUES (0), (1)) o(ord) ON o.ord = 0 OR c.c_custkey % 11 = 0),
  survey AS (SELECT philosopher, rec_pos, question, arg_max(score, ord) AS score FROM raw_survey GROUP BY ALL),
  prof AS (SELECT *, CASE WHEN len(p) >= 2 AND p[-2] = 'profiles' THEN p[-1] END AS slug FROM (
             SELECT *, string_split(regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1),
                                                   '^/+|/+$', '', 'g'), '/') AS p FROM fx_profiles)),
  recs AS (SELECT philosopher, rec_pos, CAST(count(*) AS BIGINT) AS n_responses, sum(score) AS score_sum,
                  string_agg(question || '=' || CAST(score AS VARCHAR), chr(31) ORDER BY question) AS responses FROM survey GROUP BY ALL),
  summ AS (SELECT * FROM recs QUALIFY rec_pos = max(rec_pos) OVER (PARTITION BY philosopher))
"""
_PROFILE_COLS = ("phd_country", "current_institution_country", "year_of_phd_degree")


def survey_long(spark, sf_dir):
    """Human answers as survey rows ``(philosopher, rec_pos, question, score, ord)``: some respondents have no
    profile under their slug, some two records, some a question twice in a record."""
    a = FX.answers(spark, sf_dir).where("model = 'human'")
    cells = first_valid_cells(a, keys=("respondent", "question"))
    c = FX.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    twice = F.when(k % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return cells.join(c, cells.respondent == c.c_custkey).select(
        F.when(k % 50 == 0, F.concat(F.lit("guest-"), k.cast("string")))
        .otherwise(F.lower(F.replace("c_name", F.lit("#"), F.lit("-")))).alias("philosopher"),
        F.when(k % 7 == 0, F.length("question") % 2).otherwise(0).alias("rec_pos"), "question", "score", F.explode(twice).alias("ord")) \
        .withColumn("score", F.when(F.col("ord") == 1, 1.0 - F.col("score")).otherwise(F.col("score")))


def _shown(df):
    """The answer map as text, in the order of its keys."""
    entries = F.transform(F.array_sort(F.map_entries("responses")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return df.withColumn("responses", F.array_join(entries, "\x1f"))


@register("merge_profiles_survey", SURVEY_SQL + f"""
SELECT name, url, {', '.join(_PROFILE_COLS)}, slug, 'profile' AS source, CAST(coalesce(n_responses, 0) AS BIGINT) AS n_responses,
       coalesce(score_sum, 0.0) AS score_sum, coalesce(responses, '') AS responses, CAST(NULL AS BIGINT) AS survey_response_count
FROM prof LEFT JOIN summ ON prof.slug = summ.philosopher
UNION ALL
SELECT NULL, NULL, {', '.join('NULL' for _ in _PROFILE_COLS)}, philosopher, 'survey_only', n_responses, score_sum, responses, n_responses FROM summ
WHERE philosopher NOT IN (SELECT slug FROM prof WHERE slug IS NOT NULL)""", ("score_sum",))
def q_merge_profiles_survey(spark, sf_dir):
    """JOIN-1: all profiles with their columns and survey answers by slug, plus survey-only rows."""
    m = _shown(M.merge_profiles_survey(FX.profiles(spark, sf_dir), survey_long(spark, sf_dir)))
    return m.select("name", "url", *_PROFILE_COLS, "slug", "source", "n_responses", "score_sum", "responses", "survey_response_count")


@register("unmatched_survey", SURVEY_SQL + """
SELECT DISTINCT philosopher FROM survey WHERE philosopher NOT IN (SELECT slug FROM prof WHERE slug IS NOT NULL)""")
def q_unmatched_survey(spark, sf_dir):
    """SET-4: survey slugs without a profile."""
    return M.unmatched_survey(FX.profiles(spark, sf_dir), survey_long(spark, sf_dir))


@register("merge_survey_profiles", SURVEY_SQL + f"""
, pb AS (SELECT CASE WHEN contains(url, {S.q(MARKER)}) THEN string_split(url, {S.q(MARKER)})[-1] END AS slug,
                arg_max(name, respondent) AS name, arg_max(url, respondent) AS url,
                {', '.join(f'arg_max_null({c}, respondent) AS {c}' for c in _PROFILE_COLS)}
         FROM fx_profiles WHERE contains(url, {S.q(MARKER)}) GROUP BY 1)
SELECT s.philosopher, s.rec_pos, pb.name, pb.url, {', '.join(f'pb.{c}' for c in _PROFILE_COLS)}, s.n_responses, s.score_sum, s.responses,
       pb.slug IS NOT NULL AS matched
FROM recs s LEFT JOIN pb ON pb.slug = s.philosopher""", ("score_sum",))
def q_merge_survey_profiles(spark, sf_dir):
    """JOIN-2: every survey record joined to profiles on slug B; unmatched flagged."""
    p = FX.profiles(spark, sf_dir).withColumn("_order", F.col("respondent"))
    m = _shown(M.merge_survey_profiles(survey_long(spark, sf_dir), p, MARKER))
    return m.select("philosopher", "rec_pos", "name", "url", *_PROFILE_COLS, "n_responses", "score_sum", "responses", "matched")


@register("dedupe_last", """
SELECT slug, arg_max(respondent, respondent) AS respondent, arg_max(name, respondent) AS name FROM (
  SELECT respondent, name, lower(regexp_extract(name, '#0*([0-9]?[0-9])$', 1)) AS slug FROM fx_profiles) GROUP BY slug""")
def q_dedupe_last(spark, sf_dir):
    """JOIN-3: last record per key wins (key = last two digits of the name; many collisions)."""
    p = FX.profiles(spark, sf_dir).select(
        "respondent", "name", F.lower(F.regexp_extract("name", "#0*([0-9]?[0-9])$", 1)).alias("slug"))
    return M.dedupe_last(p.select("slug", "respondent", "name"), ["slug"], "respondent")


def _merge_model(spark, sf_dir):
    records = _jbr(spark, sf_dir)
    ev = FX.table(spark, sf_dir, "events").select(F.concat(F.lit("req_"), F.col("event_id").cast("string"))
                                                  .alias("custom_id"), "user_id")
    nat = FX.table(spark, sf_dir, "customer").join(FX.table(spark, sf_dir, "nation"),
                                                   F.col("c_nationkey") == F.col("n_nationkey"))
    records = records.join(ev, "custom_id").join(nat.select(F.col("c_custkey").alias("user_id"),
                                                            F.col("n_name").alias("phd_country")), "user_id", "left")
    cells = B.first_valid_model_cells(records)
    return M.merge_model_profiles(records, cells, _merge_profiles(spark, sf_dir))


def _merge_profiles(spark, sf_dir):
    """All profiles; every twentieth has a guest's name, so its respondent is unmatched and falls back to the first record."""
    guest = F.concat(F.lit("guest "), F.col("respondent").cast("string"))
    return (FX.profiles(spark, sf_dir).withColumn("name", F.when(F.col("respondent") % 20 == 0, guest).otherwise(F.col("name")))
            .withColumn("_order", F.col("respondent")))


@register("merge_model_profiles", ITEMS_SQL + f"""
, pn AS (SELECT {S.normalize_name('name')} AS norm, arg_max(name, respondent) AS name, arg_max_null(url, respondent) AS url,
                {', '.join(f'arg_max_null({c}, respondent) AS {c}' for c in _PROFILE_COLS)} FROM fx_profiles
         WHERE {S.normalize_name('name')} IS NOT NULL AND respondent % 20 <> 0 GROUP BY 1),
  ms AS (SELECT philosopher_name, CAST(count(*) AS BIGINT) AS n_responses, sum(score) AS score_sum,
                string_agg(cell_key || '=' || CAST(score AS VARCHAR), chr(31) ORDER BY cell_key) AS responses FROM mcells GROUP BY philosopher_name),
  fr AS (SELECT j.philosopher_name, arg_min(n.n_name, j.ord) AS phd_country
         FROM jbr j JOIN events e ON j.custom_id = 'req_' || CAST(e.event_id AS VARCHAR)
              LEFT JOIN customer c ON c.c_custkey = e.user_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1)
SELECT coalesce(pn.name, ms.philosopher_name) AS name, n_responses, score_sum, responses, pn.name IS NOT NULL AS matched,
       CASE WHEN pn.name IS NOT NULL THEN NULL ELSE 'llm' END AS source,
       CASE WHEN pn.name IS NOT NULL THEN pn.phd_country ELSE fr.phd_country END AS phd_country, pn.url,
       pn.current_institution_country, pn.year_of_phd_degree
FROM ms LEFT JOIN pn ON pn.norm = {S.normalize_name('ms.philosopher_name')} LEFT JOIN fr USING (philosopher_name)""", ("score_sum",))
def q_merge_model_profiles(spark, sf_dir):
    """JOIN-4: model answers merged with profiles by normalised name (first-record fallback)."""
    return _shown(_merge_model(spark, sf_dir)).select("name", "n_responses", "score_sum", "responses", "matched", "source", "phd_country",
                                                      "url", "current_institution_country", "year_of_phd_degree")


@register("merge_counts", ITEMS_SQL + f"""
, pn AS (SELECT DISTINCT {S.normalize_name('name')} AS norm FROM fx_profiles WHERE respondent % 20 <> 0),
  ms AS (SELECT DISTINCT philosopher_name FROM mcells)
SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(pn.norm) AS BIGINT) AS matched,
       CAST(count(*) - count(pn.norm) AS BIGINT) AS unmatched
FROM ms LEFT JOIN pn ON pn.norm = {S.normalize_name('ms.philosopher_name')}""")
def q_merge_counts(spark, sf_dir):
    """AGG-18: total / matched / unmatched of the model-profile merge."""
    return M.merge_counts(_merge_model(spark, sf_dir))
