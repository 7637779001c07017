"""Stand-in inputs over the driver's test tables.

Each function only *shapes* rows of the given parquet tables into the schema a
job expects (answers, profiles, features, raw model outputs, survey records).
No job work happens here: dedupe, parsing, scoring, joins by slug/name, and
all statistics run in the operators.  The SQL twins in ``FIXTURE_SQL`` are
the same projections for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer records ``(model, respondent, question, score, ord)``; one event = one answer.

    Several events may hit the same cell; the job keeps the first (AGG-3).
    """
    ev = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    v = F.col("value")
    return ev.select(
        F.when(F.col("event_id") % 3 == 0, "human")
        .when(F.col("event_id") % 3 == 1, "m1").otherwise("m2").alias("model"),
        F.col("user_id").alias("respondent"),
        F.concat(F.col("event_type"), F.lit(": "),
                 F.floor(k / 20).cast("int").cast("string")).alias("question"),
        F.when(v < 15, 0.0).when(v < 30, 0.25).when(v < 50, 0.5)
        .when(v < 80, 0.75).otherwise(1.0).cast("double").alias("score"),
        F.col("event_id").alias("ord"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Respondent profiles (D1 minus the list fields)."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    o = (table(spark, sf_dir, "orders")
         .groupBy("o_custkey")
         .agg(F.min(F.year("o_orderdate")).cast("int").alias("y")))
    return (c.join(n, c.c_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey)
            .join(o, o.o_custkey == c.c_custkey, "left")
            .select(
                F.col("c_custkey").alias("respondent"),
                F.col("c_name").alias("name"),
                F.concat(F.lit("https://people.example.org/profiles/"),
                         F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit("-")))).alias("url"),
                F.col("n_name").alias("phd_country"),
                F.col("r_name").alias("current_institution_country"),
                F.when(F.col("c_acctbal") < 0, F.lit(None).cast("string"))
                .otherwise(F.col("c_mktsegment")).alias("current_institution"),
                F.col("y").alias("year_of_phd_degree"),
            ))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-valued respondent features ``(respondent, feature_type, feature)``."""
    o = table(spark, sf_dir, "orders")
    pri = o.select(F.col("o_custkey").alias("respondent"), F.lit("priority").alias("feature_type"),
                   F.col("o_orderpriority").alias("feature")).distinct()
    sta = o.select(F.col("o_custkey").alias("respondent"), F.lit("status").alias("feature_type"),
                   F.col("o_orderstatus").alias("feature")).distinct()
    return pri.unionByName(sta)


def profile_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full D1 profile rows: profiles plus the two list fields (sorted lists)."""
    f = features(spark, sf_dir)
    lists = (f.groupBy("respondent")
             .agg(F.array_sort(F.collect_list(F.when(F.col("feature_type") == "priority", F.col("feature"))))
                  .alias("areas_of_specialization"),
                  F.array_sort(F.collect_list(F.when(F.col("feature_type") == "status", F.col("feature"))))
                  .alias("areas_of_interest")))
    p = profiles(spark, sf_dir)
    return (p.join(lists, "respondent", "left")
            .select("respondent", "name", "url",
                    F.coalesce("areas_of_specialization", F.array().cast("array<string>")).alias("areas_of_specialization"),
                    F.coalesce("areas_of_interest", F.array().cast("array<string>")).alias("areas_of_interest"),
                    F.col("current_institution").alias("phd_institution"),
                    "phd_country", "current_institution", "current_institution_country",
                    "year_of_phd_degree"))


def llm_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw batch outputs with every answer layout, statuses, tokens, attempts."""
    ev = table(spark, sf_dir, "events")
    eid, et = F.col("event_id"), F.col("event_type")
    nl = F.lit("\n")
    raw = (F.when(eid % 7 == 0, F.concat(F.lit('["Accept: '), et, F.lit('"]')))
           .when(eid % 7 == 1, F.concat(F.lit("```json"), nl, F.lit('["Lean towards: '), et,
                                        F.lit('", "Reject: other"]'), nl, F.lit("```")))
           .when(eid % 7 == 2, F.concat(F.lit('I choose "Lean against: '), et, F.lit('"')))
           .when(eid % 7 == 3, F.concat(F.lit("['Neutral: "), et, F.lit("']")))
           .when(eid % 7 == 4, F.lit("Agnostic/undecided"))
           .when(eid % 7 == 5, F.lit("Neutral"))
           .otherwise(F.lit("")))
    return ev.select(
        eid.alias("ord"),
        F.concat(F.lit("req_"), eid.cast("string")).alias("custom_id"),
        F.col("user_id").alias("respondent"),
        et.alias("question"),
        F.when(eid % 17 == 0, 500).otherwise(200).cast("int").alias("status_code"),
        (F.lit(100) + eid % 50).cast("bigint").alias("prompt_tokens"),
        (F.lit(5) + eid % 11).cast("bigint").alias("completion_tokens"),
        (F.lit(1) + eid % 5).cast("bigint").alias("attempts"),
        raw.alias("raw"),
    )


# Same projections in DuckDB SQL, as CTE bodies for the oracle.
FIXTURE_SQL = {
    "fx_answers": """
SELECT CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'human' WHEN 1 THEN 'm1' ELSE 'm2' END AS model,
       user_id AS respondent,
       event_type || ': ' || CAST(CAST(FLOOR(CAST(regexp_extract(props,'([0-9]+)',1) AS INT) / 20) AS INT) AS VARCHAR) AS question,
       CASE WHEN value < 15 THEN CAST(0.0 AS DOUBLE) WHEN value < 30 THEN CAST(0.25 AS DOUBLE)
            WHEN value < 50 THEN CAST(0.5 AS DOUBLE) WHEN value < 80 THEN CAST(0.75 AS DOUBLE)
            ELSE CAST(1.0 AS DOUBLE) END AS score,
       event_id AS ord
FROM events""",
    "fx_profiles": """
SELECT c.c_custkey AS respondent, c.c_name AS name,
       'https://people.example.org/profiles/' || lower(replace(c.c_name,'#','-')) AS url,
       n.n_name AS phd_country, r.r_name AS current_institution_country,
       CASE WHEN c.c_acctbal < 0 THEN NULL ELSE c.c_mktsegment END AS current_institution,
       o.y AS year_of_phd_degree
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN (SELECT o_custkey, CAST(min(EXTRACT(YEAR FROM o_orderdate)) AS INT) AS y FROM orders GROUP BY o_custkey) o
  ON o.o_custkey = c.c_custkey""",
    "fx_features": """
SELECT DISTINCT o_custkey AS respondent, 'priority' AS feature_type, o_orderpriority AS feature FROM orders
UNION ALL
SELECT DISTINCT o_custkey, 'status', o_orderstatus FROM orders""",
    "fx_profile_records": """
SELECT p.respondent, p.name, p.url,
       coalesce(l.aos, []::VARCHAR[]) AS areas_of_specialization,
       coalesce(l.aoi, []::VARCHAR[]) AS areas_of_interest,
       p.current_institution AS phd_institution, p.phd_country, p.current_institution,
       p.current_institution_country, p.year_of_phd_degree
FROM fx_profiles p LEFT JOIN (
  SELECT respondent,
         list_sort(coalesce(list(feature) FILTER (WHERE feature_type = 'priority'), []::VARCHAR[])) AS aos,
         list_sort(coalesce(list(feature) FILTER (WHERE feature_type = 'status'), []::VARCHAR[])) AS aoi
  FROM fx_features GROUP BY respondent) l ON l.respondent = p.respondent""",
    "fx_llm_raw": """
SELECT event_id AS ord, 'req_' || CAST(event_id AS VARCHAR) AS custom_id, user_id AS respondent, event_type AS question,
       CAST(CASE WHEN event_id % 17 = 0 THEN 500 ELSE 200 END AS INT) AS status_code,
       CAST(100 + event_id % 50 AS BIGINT) AS prompt_tokens, CAST(5 + event_id % 11 AS BIGINT) AS completion_tokens,
       CAST(1 + event_id % 5 AS BIGINT) AS attempts,
       CASE event_id % 7
         WHEN 0 THEN '["Accept: ' || event_type || '"]'
         WHEN 1 THEN '```json' || chr(10) || '["Lean towards: ' || event_type || '", "Reject: other"]' || chr(10) || '```'
         WHEN 2 THEN 'I choose "Lean against: ' || event_type || '"'
         WHEN 3 THEN '[''Neutral: ' || event_type || ''']'
         WHEN 4 THEN 'Agnostic/undecided'
         WHEN 5 THEN 'Neutral'
         ELSE '' END AS raw
FROM events""",
}


def fixture_cte() -> str:
    """``WITH`` prefix that defines every fixture view for the DuckDB oracle."""
    parts = [f"{name} AS ({body.strip()})" for name, body in FIXTURE_SQL.items()]
    return "WITH " + ",\n".join(parts)


# --- further stand-ins (batch outputs, request mapping, options, survey records) ---

def batch_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch output rows as returned by a batch API (no mapping columns)."""
    return llm_raw(spark, sf_dir).select("ord", "custom_id", "status_code", "prompt_tokens",
                                         "completion_tokens", "attempts", "raw")


def request_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """custom_id -> (respondent name, question), as written when the requests were built."""
    ev = table(spark, sf_dir, "events")
    c = table(spark, sf_dir, "customer")
    return (ev.join(c, ev.user_id == c.c_custkey)
            .select(F.concat(F.lit("req_"), F.col("event_id").cast("string")).alias("custom_id"),
                    F.col("c_name").alias("philosopher_name"), F.col("event_type").alias("question")))


def question_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per question with its answer options (stance x the question's thesis)."""
    q = table(spark, sf_dir, "events").select(F.col("event_type").alias("question")).distinct()
    opts = F.array(*[F.concat(F.lit(s + ": "), F.col("question"))
                     for s in ("Accept", "Lean towards", "Neutral", "Lean against", "Reject")],
                   F.lit("Agnostic/undecided"))
    return q.select("question", opts.alias("options"))


def survey_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D14 raw survey records: one per document, each line of the text one raw answer."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return (d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("rec_pos"),
        F.concat(F.lit("https://people.example.org/profiles/doc-"), F.col("doc_id").cast("string")).alias("profile_url"),
        (F.coalesce(F.col("toxic"), F.lit(0)) == 0).alias("has_survey_responses"),
        F.transform(F.split(F.col("text"), "\n"), lambda x: F.struct(x.alias("raw_text"))).alias("survey_responses")))


def profile_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D13 scraped profile details keyed by profile URL (one per document)."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("https://people.example.org/profiles/doc-"), F.col("doc_id").cast("string")).alias("profile_url"),
        F.when(F.col("n_chars") > 1000, F.array(F.col("lang"))).otherwise(F.array().cast("array<string>"))
        .alias("areas_of_specialization"),
        F.array(F.col("source")).alias("areas_of_interest"),
        F.when(F.col("n_chars") % 2 == 0, F.col("source")).alias("phd_institution"),
        F.when(F.col("n_chars") > 500, F.col("lang")).alias("current_institution"))


FIXTURE_SQL.update({
    "fx_outputs": """SELECT ord, custom_id, status_code, prompt_tokens, completion_tokens, attempts, raw FROM fx_llm_raw""",
    "fx_mapping": """
SELECT 'req_' || CAST(e.event_id AS VARCHAR) AS custom_id, c.c_name AS philosopher_name, e.event_type AS question
FROM events e JOIN customer c ON e.user_id = c.c_custkey""",
    "fx_options": """
SELECT question, ['Accept: ' || question, 'Lean towards: ' || question, 'Neutral: ' || question,
                  'Lean against: ' || question, 'Reject: ' || question, 'Agnostic/undecided'] AS options
FROM (SELECT DISTINCT event_type AS question FROM events)""",
    "fx_survey": """
SELECT d.doc_id AS rec_pos, 'https://people.example.org/profiles/doc-' || CAST(d.doc_id AS VARCHAR) AS profile_url,
       coalesce(l.toxic, 0) = 0 AS has_survey_responses, string_split(d.text, chr(10)) AS lines
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "fx_details": """
SELECT 'https://people.example.org/profiles/doc-' || CAST(doc_id AS VARCHAR) AS profile_url,
       CASE WHEN n_chars > 1000 THEN [lang] ELSE []::VARCHAR[] END AS areas_of_specialization,
       [source] AS areas_of_interest,
       CASE WHEN n_chars % 2 = 0 THEN source END AS phd_institution,
       CASE WHEN n_chars > 500 THEN lang END AS current_institution
FROM documents""",
})


# Stance answer texts in every layout the parsers must handle (one per event).
_STANCE_LAYOUTS = [
    "ACCEPT: {q}", "Accept:", "Lean toward: {q}", "Neutral", "agnostic/undecided", "Lean against:   {q}  ",
    "Reject: {q}", "Accept an alternative view: {q}", "Neutral towards: {q}", "lean towards:{q}",
    "Skipped", "Neutral: {q}",
]


def stance_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(ord, question, text)``: answer texts cycling through the layouts above."""
    ev = table(spark, sf_dir, "events")
    k = F.col("event_id") % len(_STANCE_LAYOUTS)
    text = None
    for i, lay in enumerate(_STANCE_LAYOUTS):
        head, _, tail = lay.partition("{q}")
        val = F.concat(F.lit(head), F.col("event_type"), F.lit(tail)) if "{q}" in lay else F.lit(lay)
        text = F.when(k == i, val) if text is None else text.when(k == i, val)
    return ev.select(F.col("event_id").alias("ord"), F.col("event_type").alias("question"), text.alias("text"))


def _stance_sql() -> str:
    arms = []
    for i, lay in enumerate(_STANCE_LAYOUTS):
        head, _, tail = lay.partition("{q}")
        esc = lambda s: s.replace("'", "''")
        val = f"'{esc(head)}' || event_type || '{esc(tail)}'" if "{q}" in lay else f"'{esc(lay)}'"
        arms.append(f"WHEN {i} THEN {val}")
    return (f"SELECT event_id AS ord, event_type AS question, CASE event_id % {len(_STANCE_LAYOUTS)} "
            + " ".join(arms) + " END AS text FROM events")


FIXTURE_SQL["fx_stance"] = _stance_sql()


def saved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved pages ``(page_key, html)``, one per customer, of four kinds by the key: survey answers (single,
    combined, a repeated question, a row of one cell), profile, question/answer lists, no such markup."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    key, seg, nat = k.cast("string"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")

    def html(*parts):
        return F.concat(F.lit("<html><body>"), *(p if not isinstance(p, str) else F.lit(p) for p in parts), F.lit("</body></html>"))

    repeated = F.when(k % 8 == 0, F.concat(
        F.lit("<tr><td><a class='survey-question-title x' href=#>SEG "), seg, F.lit("</a></td><td>  Skipped\n  it <!-- n --></td></tr>"))).otherwise("")
    survey = html(
        "<h2>My Survey Responses</h2><p>x</p><table><thead><tr><th>Q</th><th>A</th></tr></thead><tbody>",
        "<tr><td><a class='survey-question-title' href='#'>Seg ", seg, "</a></td><td><span>Accept:</span> <strong class='thesis-title'>", seg,
        " view</strong></td></tr><tr><td><a class='survey-question-title' href='#'>Combined ", nat,
        "</a></td><td>Accept a combination of answers:<ul><li>Lean   Toward <strong class='thesis-title'>view ", key,
        "</strong></li><li>Reject</li></ul></td></tr>", repeated, "<tr><td>one cell</td></tr></tbody></table>")
    interest = F.when(k % 8 == 1, F.lit("<div class='about__topics'><div class='about__content'><span class='about-title'>Areas of Interest</span>"
                                        "<table><tr><td><a class='category'>Law &amp; Order</a></td></tr></table></div></div>")).otherwise("")
    second = F.when(k % 8 == 5, "<div class='about-second'>Dept</div>").otherwise("")
    profile = html(
        "<div class='affil'> University ", nat, " </div><div class='about__topics'><div class='about__content'>"
        "<span class='about-title'>Areas of Specialization</span><table><tr><td><a class='category'>Ethics</a><a class='category'>Logic ", key,
        "</a></td></tr></table></div></div>", interest, "<div class='row about'><div class='about__content'><span class='about-title'>"
        "<a class='affil'>Old ", seg, "</a></span>", second, "<div class='text-muted about-extra'>PhD, ", (1990 + k % 20).cast("string"), "</div></div></div>")
    qa = html("<table><tr><th>Question ", key, "</th><td>", seg, "</td></tr><tr><td>abc</td><td>no</td></tr></table>"
              "<dl><dt>Second ", nat, "</dt><dd>maybe</dd><dt>q</dt><dd>short</dd><dt>Third</dt></dl>")
    page = F.when(k % 4 == 0, survey).when(k % 4 == 1, profile).when(k % 4 == 2, qa).otherwise(html("<p>", seg, "</p>"))
    return c.select(key.alias("page_key"), page.alias("html"))
