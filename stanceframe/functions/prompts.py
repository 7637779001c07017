"""Prompt text builders as Catalyst string expressions (EXP-13, EXP-14, EXP-15).

Conditional sections follow Python truthiness: an empty string, an empty list
or a zero year counts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Prompt templates.  The survey site name is a parameter.
# ---------------------------------------------------------------------------
DEFAULT_SITE = "the survey website"

QUESTION_TEMPLATE_HEAD = (
    "You are answering a survey by the reputable website {site}, which collects\n"
    "responses across various philosophical domains based on your background. You may select one or multiple "
    "options if you deem it appropriate to accurately represent your position.\n"
    "\n"
    "Please respond with your chosen option(s) as a JSON list. If selecting multiple options, ensure they are "
    "logically consistent.\n"
    "\n"
    "Examples of valid responses:\n"
    '- ["Accept: physicalism"]\n'
    '- ["Accept: physicalism", "Reject: non-physicalism"]\n'
    '- ["Lean towards: physicalism", "Lean against: non-physicalism"]\n'
    "\n"
    "Given your philosophical profile above, please express your stance on the following question.\n"
    "\n"
    "Question: "
)
QUESTION_TEMPLATE_OPTIONS = "\n\nAvailable response options:\n"
QUESTION_TEMPLATE_TAIL = "\nRespond ONLY with the JSON list, no other text or explanation.\n"

PERSONA_OPEN = "You are a professional philosopher"
ANON_INSTITUTION = " at a research university"
ANON_PHD = "Educational Background:\n- PhD from a leading institution\n\n"

PREF_QUESTION_TEMPLATE = (
    "You are answering a philosophical survey. Based on your background, express your stance on:\n"
    "\n"
    "Question: {question}\n"
    "\n"
    'Respond with your position (e.g., "Accept: X", "Lean towards: Y", "Reject: Z", or "Neutral").\n'
)
# ---------------------------------------------------------------------------


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _present(s: Column) -> Column:
    return s.isNotNull() & (s.cast("string") != "")


def _has_items(a: Column) -> Column:
    return F.coalesce(F.size(a), F.lit(0)) > 0


def bullet_list(a: Column, k: int) -> Column:
    """``- item\\n`` for the first ``k`` items."""
    return F.array_join(F.transform(F.slice(a, 1, k), lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), "")


def persona_prompt(specs="areas_of_specialization", interests="areas_of_interest", phd="phd_institution",
                   phd_country="phd_country", phd_year="year_of_phd_degree", institution="current_institution",
                   institution_country="current_institution_country") -> Column:
    """EXP-13: persona text with institution, education, up to 5 specialisations and 8 interests."""
    specs, interests, phd, phd_country = _c(specs), _c(interests), _c(phd), _c(phd_country)
    phd_year, inst, inst_c = _c(phd_year), _c(institution), _c(institution_country)
    year_ok = phd_year.isNotNull() & (phd_year != 0)
    head = F.concat(
        F.lit(PERSONA_OPEN),
        F.when(_present(inst), F.concat(F.lit(" at "), inst,
                                        F.when(_present(inst_c), F.concat(F.lit(" ("), inst_c, F.lit(")")))
                                        .otherwise(F.lit("")))).otherwise(F.lit("")),
        F.lit(".\n\n"))
    phd_line = F.when(_present(phd), F.concat(
        F.lit("- PhD from "), phd,
        F.when(_present(phd_country), F.concat(F.lit(" ("), phd_country, F.lit(")"))).otherwise(F.lit("")),
        F.when(year_ok, F.concat(F.lit(" in "), phd_year.cast("string"))).otherwise(F.lit("")),
        F.lit("\n"))).otherwise(F.lit(""))
    edu = F.when(_present(phd) | _present(phd_country) | year_ok,
                 F.concat(F.lit("Your Educational Background:\n"), phd_line, F.lit("\n"))).otherwise(F.lit(""))
    sp = F.when(_has_items(specs), F.concat(F.lit("Your Areas of Specialization:\n"), bullet_list(specs, 5),
                                            F.lit("\n"))).otherwise(F.lit(""))
    it = F.when(_has_items(interests), F.concat(F.lit("Your Areas of Interest:\n"), bullet_list(interests, 8),
                                                F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(head, edu, sp, it)


def question_prompt(question: Column | str, options: Column | str, site: str = DEFAULT_SITE) -> Column:
    """EXP-14: fixed instructions, the question, and one bullet per option."""
    opts = F.array_join(F.transform(_c(options), lambda o: F.concat(F.lit("- "), o, F.lit("\n"))), "")
    return F.concat(F.lit(QUESTION_TEMPLATE_HEAD.format(site=site)), _c(question),
                    F.lit(QUESTION_TEMPLATE_OPTIONS), opts, F.lit(QUESTION_TEMPLATE_TAIL))


def anon_persona_prompt(specs="areas_of_specialization", interests="areas_of_interest",
                        phd="phd_institution", institution="current_institution") -> Column:
    """EXP-15: anonymised persona (generic institutions, 5 + 5 items, interests only if
    they differ from the specialisations)."""
    specs, interests, phd, inst = _c(specs), _c(interests), _c(phd), _c(institution)
    head = F.concat(F.lit(PERSONA_OPEN), F.when(_present(inst), F.lit(ANON_INSTITUTION)).otherwise(F.lit("")),
                    F.lit(".\n\n"))
    edu = F.when(_present(phd), F.lit(ANON_PHD)).otherwise(F.lit(""))
    sp = F.when(_has_items(specs), F.concat(F.lit("Areas of Specialization:\n"), bullet_list(specs, 5),
                                            F.lit("\n"))).otherwise(F.lit(""))
    differs = ~F.coalesce(interests == specs, F.lit(False))
    it = F.when(_has_items(interests) & differs,
                F.concat(F.lit("Areas of Interest:\n"), bullet_list(interests, 5), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(head, edu, sp, it)


def preference_prompt(persona: Column, question_text: Column) -> Column:
    """Full preference prompt: ``System: <persona>\\n\\nUser: <question prompt>``."""
    head, tail = PREF_QUESTION_TEMPLATE.split("{question}")
    return F.concat(F.lit("System: "), persona, F.lit("\n\nUser: "), F.lit(head), question_text, F.lit(tail))
