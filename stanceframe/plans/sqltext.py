"""DuckDB twins of the text functions, for the oracle only (RE2 regex dialect)."""

from __future__ import annotations

from stanceframe.functions import prompts as P
from stanceframe.functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    chars = "".join(f"' || chr({ord(c)}) || '" for c in T.PY_WHITESPACE)
    return f"trim({x}, '{chars}')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\s+', ' ', 'g')")


def normalize_question(x: str) -> str:
    s = f"regexp_replace({strip(x)}, ':([^ ])', ': \\1', 'g')"
    return f"(lower(left({s}, 1)) || substr({s}, 2))"


def normalize_option(x: str) -> str:
    s = collapse(f"lower({x})")
    s = f"regexp_replace({s}, '[.,!?;]+$', '')"
    s = f"regexp_replace({s}, ':+', ':', 'g')"
    s = f"replace(replace(replace({s}, ' :', ':'), ':', ': '), ':  ', ': ')"
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN '' ELSE {collapse(s)} END)"


def normalize_name(x: str) -> str:
    return f"nullif(regexp_replace(lower({strip(x)}), '\\s+', ' ', 'g'), '')"


def stance_prefix(x: str) -> tuple[str, str]:
    """(stance, answer) expressions of the ordered prefix parser."""
    s = strip(x)
    low = f"lower({s})"
    st = [f"WHEN {low} = {q(T.AGNOSTIC.lower())} THEN {q(T.AGNOSTIC)}"]
    an = [f"WHEN {low} = {q(T.AGNOSTIC.lower())} THEN {q(T.AGNOSTIC.lower())}"]
    for prefix, name in T.STANCE_PREFIXES:
        cond = f"starts_with({low}, {q(prefix.lower())})"
        st.append(f"WHEN {cond} THEN {q(name)}")
        an.append(f"WHEN {cond} THEN {strip(f'substr({s}, {len(prefix) + 1})')}")
    return ("(CASE " + " ".join(st) + " END)", "(CASE " + " ".join(an) + f" ELSE {s} END)")


def canonicalize(x: str) -> str:
    s = strip(x)
    arms = [f"WHEN lower({s}) = {q(T.AGNOSTIC.lower())} THEN {q(T.AGNOSTIC + ': ' + T.AGNOSTIC.lower())}"]
    for label, name in T.STANCE_PATTERNS:
        pat = "(?i)^" + label + ":\\s*([^\\n]+)$"
        arms.append(f"WHEN regexp_matches({s}, {q(pat)}) THEN {q(name + ': ')} || "
                    f"{strip(f'regexp_extract({s}, {q(pat)}, 1)')}")
    return "(CASE " + " ".join(arms) + f" ELSE {s} END)"


def score(stance: str) -> str:
    arms = " ".join(f"WHEN {q(k)} THEN CAST({v} AS DOUBLE)" for k, v in T.STANCE_SCORES.items())
    return f"(CASE {stance} {arms} END)"


def strip_fence(x: str) -> str:
    s = strip(x)
    lines = f"string_split({s}, chr(10))"
    body = (f"(CASE WHEN {strip(f'{lines}[len({lines})]')} = '```' THEN {lines}[2:len({lines}) - 1] "
            f"ELSE {lines}[2:len({lines})] END)")
    return f"(CASE WHEN starts_with({s}, '```') THEN {strip(f'array_to_string({body}, chr(10))')} ELSE {s} END)"


def _json_list(m: str) -> str:
    return (f"(CASE WHEN {m} <> '' AND json_valid({m}) AND json_type({m}) = 'ARRAY' "
            f"THEN from_json({m}, '[\"VARCHAR\"]') END)")


def parse_response_list(x: str) -> str:
    s = strip_fence(x)
    m = f"regexp_extract({s}, '(?s)\\[.*?\\]', 0)"
    parsed = _json_list(m)
    falsy = "['0', '0.0', 'false', '[]', '{}']"
    raw = f"from_json({m}, '[\"JSON\"]')"   # the items as JSON text: strings keep their quotes
    items = (f"list_transform(list_filter(list_zip({parsed}, (CASE WHEN {parsed} IS NOT NULL THEN {raw} END)), "
             f"lambda p: p[1] IS NOT NULL AND p[1] <> '' AND NOT (json_type(p[2]) <> 'VARCHAR' AND list_contains({falsy}, p[1]))), "
             f"lambda p: {strip('p[1]')})")
    dq = f"regexp_extract_all({s}, '\"([^\"]+)\"', 1)"
    sq = f"regexp_extract_all({s}, '''([^'']+)''', 1)"
    return (f"(CASE WHEN {parsed} IS NOT NULL THEN {items} WHEN len({dq}) > 0 THEN {dq} "
            f"WHEN len({sq}) > 0 THEN {sq} ELSE [{s}] END)")


def extract_json_list(x: str) -> str:
    s = strip(x)
    fenced = f"regexp_extract({s}, '(?s)```(?:json)?\\s*(\\[.*?\\])\\s*```', 1)"
    run = f"regexp_extract({s}, '(?s)\\[.*?\\]', 0)"
    inner = f"(CASE WHEN starts_with({s}, '\"') AND json_valid({s}) THEN json_extract_string({s}, '$') END)"
    return (f"coalesce({_json_list(fenced)}, {_json_list(s)}, {_json_list(f'coalesce({inner}, chr(0))')}, "
            f"{_json_list(run)}, [{s}])")


def year_bin(y: str) -> str:
    start = f"CAST(floor({y} / 5) * 5 AS BIGINT)"
    return f"(CASE WHEN {y} IS NULL THEN NULL ELSE CAST({start} AS VARCHAR) || '-' || CAST({start} + 4 AS VARCHAR) END)"


def bullets(a: str, k: int) -> str:
    return f"coalesce(array_to_string(list_transform({a}[1:{k}], lambda x: '- ' || x || chr(10)), ''), '')"


def present(x: str) -> str:
    return f"({x} IS NOT NULL AND CAST({x} AS VARCHAR) <> '')"


def persona_prompt() -> str:
    nl = "chr(10)"
    head = (f"{q(P.PERSONA_OPEN)} || (CASE WHEN {present('current_institution')} THEN ' at ' || current_institution"
            f" || (CASE WHEN {present('current_institution_country')} THEN ' (' || current_institution_country || ')'"
            f" ELSE '' END) ELSE '' END) || '.' || {nl} || {nl}")
    year_ok = "(year_of_phd_degree IS NOT NULL AND year_of_phd_degree <> 0)"
    phd_line = (f"(CASE WHEN {present('phd_institution')} THEN '- PhD from ' || phd_institution || "
                f"(CASE WHEN {present('phd_country')} THEN ' (' || phd_country || ')' ELSE '' END) || "
                f"(CASE WHEN {year_ok} THEN ' in ' || CAST(year_of_phd_degree AS VARCHAR) ELSE '' END) || {nl} "
                f"ELSE '' END)")
    edu = (f"(CASE WHEN {present('phd_institution')} OR {present('phd_country')} OR {year_ok} THEN "
           f"'Your Educational Background:' || {nl} || {phd_line} || {nl} ELSE '' END)")
    sp = (f"(CASE WHEN len(areas_of_specialization) > 0 THEN 'Your Areas of Specialization:' || {nl} || "
          f"{bullets('areas_of_specialization', 5)} || {nl} ELSE '' END)")
    it = (f"(CASE WHEN len(areas_of_interest) > 0 THEN 'Your Areas of Interest:' || {nl} || "
          f"{bullets('areas_of_interest', 8)} || {nl} ELSE '' END)")
    return f"({head} || {edu} || {sp} || {it})"


def question_prompt(question: str, options: str, site: str = P.DEFAULT_SITE) -> str:
    opts = f"array_to_string(list_transform({options}, lambda o: '- ' || o || chr(10)), '')"
    return (f"({q(P.QUESTION_TEMPLATE_HEAD.format(site=site))} || {question} || {q(P.QUESTION_TEMPLATE_OPTIONS)} "
            f"|| {opts} || {q(P.QUESTION_TEMPLATE_TAIL)})")


def anon_persona_prompt() -> str:
    nl = "chr(10)"
    head = (f"{q(P.PERSONA_OPEN)} || (CASE WHEN {present('current_institution')} THEN {q(P.ANON_INSTITUTION)} "
            f"ELSE '' END) || '.' || {nl} || {nl}")
    edu = f"(CASE WHEN {present('phd_institution')} THEN {q(P.ANON_PHD)} ELSE '' END)"
    sp = (f"(CASE WHEN len(areas_of_specialization) > 0 THEN 'Areas of Specialization:' || {nl} || "
          f"{bullets('areas_of_specialization', 5)} || {nl} ELSE '' END)")
    it = (f"(CASE WHEN len(areas_of_interest) > 0 AND NOT coalesce(areas_of_interest = areas_of_specialization, false) "
          f"THEN 'Areas of Interest:' || {nl} || {bullets('areas_of_interest', 5)} || {nl} ELSE '' END)")
    return f"({head} || {edu} || {sp} || {it})"
