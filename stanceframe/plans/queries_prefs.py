"""Registered preference-pair queries over ``documents`` (+ ``labels``): EXP-17/18, SMP-1/2, PREF-1/2."""

from __future__ import annotations

from pyspark.sql import functions as F

from stanceframe.functions import prompts as P
from stanceframe.operators import prefs as PF
from stanceframe.plans import sqltext as S
from stanceframe.plans.registry import register
from stanceframe.sources import fixtures as FX

# Topic table used over the test documents (a parameter of the job): language marker words.
DOC_TOPICS = [
    ("english", ["the ", " and ", " of "], "Which language: English?"),
    ("french", [" le ", " la ", " les ", " des "], "Which language: French?"),
    ("german", [" der ", " die ", " und "], "Which language: German?"),
    ("spanish", [" el ", " los ", " las "], "Which language: Spanish?"),
]
SEED = 42
FRAC = 0.85


def _topic_sql(text: str, topics=DOC_TOPICS) -> tuple[str, str]:
    scores = [" + ".join(f"(CASE WHEN contains(lower({text}), {S.q(k.lower())}) THEN 1 ELSE 0 END)" for k in kws)
              for _, kws, _ in topics]
    best = "greatest(" + ", ".join(scores) + ")"
    topic = "CASE WHEN " + best + " = 0 THEN NULL " + " ".join(
        f"WHEN ({s}) = {best} THEN {S.q(t)}" for s, (t, _, _) in zip(scores, topics)) + " END"
    question = "CASE WHEN " + best + " = 0 THEN NULL " + " ".join(
        f"WHEN ({s}) = {best} THEN {S.q(qq)}" for s, (_, _, qq) in zip(scores, topics)) + " END"
    return topic, question


def _neg_sql(text: str, draw: str) -> str:
    low = f"lower({S.strip(text)})"
    stance = "CASE " + " ".join(f"WHEN starts_with({low}, {S.q(k)}) THEN {S.q(k)}" for k in PF.OPPOSITE) + " END"
    opp = "CASE st " + " ".join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in PF.OPPOSITE.items()) + " END"
    alt = "CASE st " + " ".join(f"WHEN {S.q(k)} THEN (CASE WHEN {draw} % 2 = 0 THEN {S.q(v[0])} ELSE {S.q(v[1])} END)"
                                for k, v in PF.ALTERNATIVES.items()) + " END"
    ans = S.strip(f"regexp_extract({low}, '(?s)^[^:]*:(.*)$', 1)")

    def fmt(s):
        return f"(CASE WHEN contains({low}, ':') THEN {s} || ': ' || {ans} ELSE {s} END)"
    return (f"(SELECT CASE WHEN st IS NULL THEN ['reject', 'neutral'] ELSE list_filter([{fmt('opp')}, "
            f"CASE WHEN alt <> opp THEN {fmt('alt')} END], lambda x: x IS NOT NULL) END "
            f"FROM (SELECT st, {opp} AS opp, {alt} AS alt FROM (SELECT {stance} AS st)))")


_TOPIC, _TQ = _topic_sql("chosen")
HEAD, TAIL = P.PREF_QUESTION_TEMPLATE.split("{question}")

PREF_CTE = f"""
, recs AS (SELECT *, row_number() OVER (ORDER BY rec_pos) - 1 AS idx FROM fx_survey),
  kept AS (SELECT r.rec_pos, r.idx, r.lines, d.areas_of_specialization, d.areas_of_interest, d.phd_institution,
                  d.current_institution
           FROM recs r LEFT JOIN fx_details d USING (profile_url) WHERE r.has_survey_responses),
  comp AS (SELECT * FROM kept WHERE (CASE WHEN len(areas_of_specialization) > 0 THEN 1 ELSE 0 END)
             + (CASE WHEN len(areas_of_interest) > 0 THEN 1 ELSE 0 END)
             + (CASE WHEN coalesce(phd_institution, '') <> '' THEN 1 ELSE 0 END)
             + (CASE WHEN coalesce(current_institution, '') <> '' THEN 1 ELSE 0 END) >= 1),
  anon AS (SELECT *, printf('Philosopher_%04d', idx) AS anon_id FROM comp),
  spl AS (SELECT *, row_number() OVER (ORDER BY md5('{SEED}:' || anon_id), anon_id) - 1 AS spos,
                 count(*) OVER () AS n FROM anon),
  spl2 AS (SELECT *, CASE WHEN spos < CAST(floor(n * {FRAC}) AS BIGINT) THEN 'train' ELSE 'val' END AS split,
                  {S.anon_persona_prompt()} AS persona FROM spl),
  ans AS (SELECT rec_pos, anon_id, split, persona, unnest(generate_series(0, len(lines) - 1)) AS resp_pos,
                 unnest(lines) AS chosen FROM spl2),
  ans2 AS (SELECT * FROM ans WHERE length(coalesce(chosen, '')) >= 5),
  tp AS (SELECT *, {_TOPIC} AS topic, {_TQ} AS topic_q FROM ans2),
  ng AS (SELECT *, {_neg_sql('chosen', '(rec_pos + resp_pos)')} AS negs FROM tp WHERE topic IS NOT NULL),
  pairs AS (SELECT anon_id, split, CAST(resp_pos AS BIGINT) AS resp_pos,
                   'System: ' || persona || chr(10) || chr(10) || 'User: ' || {S.q(HEAD)} || topic_q || {S.q(TAIL)} AS prompt,
                   chosen, CAST(unnest(generate_series(0, len(negs) - 1)) AS BIGINT) AS neg_pos, unnest(negs) AS rejected
            FROM ng)
"""


def _pairs(spark, sf_dir):
    draw = (F.col("rec_pos") + F.col("resp_pos")) % 2
    return PF.preference_pairs(FX.survey_records(spark, sf_dir), FX.profile_details(spark, sf_dir),
                               topics=DOC_TOPICS, seed=SEED, train_frac=FRAC, draw=draw)


@register("preference_pairs", PREF_CTE + "SELECT * FROM pairs")
def q_preference_pairs(spark, sf_dir):
    """PREF-1: (prompt, chosen, rejected) rows from every document line, split by respondent."""
    return _pairs(spark, sf_dir)


@register("preference_counts", PREF_CTE + "SELECT split, CAST(count(*) AS BIGINT) AS n_examples FROM pairs GROUP BY ALL")
def q_preference_counts(spark, sf_dir):
    """PREF-2: examples per split."""
    return PF.preference_counts(_pairs(spark, sf_dir))


@register("respondent_split", PREF_CTE + "SELECT anon_id, split FROM spl2")
def q_respondent_split(spark, sf_dir):
    """SMP-1: seeded respondent-level 85/15 split (exact count, hash order)."""
    kept = PF.eligible_respondents(FX.survey_records(spark, sf_dir), FX.profile_details(spark, sf_dir))
    return PF.respondent_split(kept.select("anon_id"), "anon_id", SEED, FRAC)


@register("training_subset", PREF_CTE + """
SELECT * FROM (SELECT * FROM pairs WHERE split = 'train' ORDER BY anon_id, resp_pos, neg_pos LIMIT 50)
UNION ALL
SELECT * FROM (SELECT * FROM pairs WHERE split = 'val' ORDER BY anon_id, resp_pos, neg_pos LIMIT 10)""")
def q_training_subset(spark, sf_dir):
    """SMP-2: first 50 train and first 10 validation examples in order."""
    return PF.training_subset(_pairs(spark, sf_dir), 50, 10)


@register("match_topic", f"""
SELECT doc_id, topic FROM (SELECT doc_id, {_topic_sql('text')[0]} AS topic FROM documents) WHERE topic IS NOT NULL""")
def q_match_topic(spark, sf_dir):
    """EXP-17: keyword topic of every whole document (ties -> first topic)."""
    d = FX.table(spark, sf_dir, "documents")
    return d.select("doc_id", PF.match_topic(F.col("text"), DOC_TOPICS)["topic"].alias("topic")).where(
        "topic IS NOT NULL")


@register("negative_stances", f"""
SELECT ord, CAST(unnest(generate_series(0, len(negs) - 1)) AS BIGINT) AS neg_pos, unnest(negs) AS negative FROM (
  SELECT ord, {_neg_sql('text', 'ord')} AS negs FROM fx_stance)""")
def q_negative_stances(spark, sf_dir):
    """EXP-18: opposite-stance negatives for every stance text (draw = ord % 2)."""
    s = FX.stance_texts(spark, sf_dir)
    x = s.select("ord", F.posexplode(PF.negative_stances(F.col("text"), F.col("ord"))).alias("neg_pos", "negative"))
    return x.select("ord", F.col("neg_pos").cast("bigint").alias("neg_pos"), "negative")
