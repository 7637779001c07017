"""Scalar string/JSON/array functions as Catalyst expressions (EXP-1..12, 16..27).

Every function maps Column -> Column and stays inside whole-stage codegen or
Spark's higher-order functions; nothing here calls Python per row.

Regex notes: Java ``\\s``/``\\w`` are ASCII by default while Python's are
Unicode, so patterns that mirror Python text rules carry ``(?U)``.  SQL
``trim`` strips spaces only, so Python ``str.strip()`` is ``py_strip``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------

# Stance -> score (0..1 scale).
STANCE_SCORES = {
    "Accept": 1.0,
    "Lean towards": 0.75,
    "Lean toward": 0.75,
    "Neutral towards": 0.5,
    "Neutral toward": 0.5,
    "Neutral": 0.5,
    "Lean against": 0.25,
    "Reject": 0.0,
    "Agnostic/undecided": 0.5,
}

# Prefix parser (merge step): ordered (prefix, stance) pairs, case-insensitive startswith.
STANCE_PREFIXES = [
    ("Accept:", "Accept"),
    ("Accept an alternative view:", "Accept"),
    ("Accept an alternative:", "Accept"),
    ("Lean towards:", "Lean towards"),
    ("Lean toward:", "Lean toward"),
    ("Neutral towards:", "Neutral"),
    ("Neutral toward:", "Neutral"),
    ("Neutral:", "Neutral"),
    ("Lean against:", "Lean against"),
    ("Reject:", "Reject"),
    ("Agnostic/undecided", "Agnostic/undecided"),
]

# Anchored-pattern parser (batch step): ordered (label, stance); each label must be
# followed by a colon, optional whitespace and at least one answer character.
STANCE_PATTERNS = [
    ("Accept", "Accept"),
    ("Accept an alternative view", "Accept"),
    ("Accept an alternative", "Accept"),
    ("Lean towards", "Lean towards"),
    ("Lean toward", "Lean towards"),
    ("Neutral towards", "Neutral"),
    ("Neutral toward", "Neutral"),
    ("Neutral", "Neutral"),
    ("Lean against", "Lean against"),
    ("Reject", "Reject"),
]

AGNOSTIC = "Agnostic/undecided"

# Phrases that mark a blocked page.
BLOCKED_PHRASES = [
    "you have been blocked",
    "cloudflare ray id",
    "please enable cookies",
    "security service to protect itself",
]

# Characters stripped from the end of an option before comparison.
OPTION_TRAILING = ".,!?;"

# ---------------------------------------------------------------------------


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(x: Column, make) -> Column:
    """``make(x)`` with x evaluated once: an expression that stands several times in a lambda runs several times."""
    return F.transform(F.array(x), lambda e: make(e))[0]


# Characters Python's str.isspace() accepts (the set str.strip() removes).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
                 "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def py_strip(x: Column | str) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace (``btrim``, no regex)."""
    return F.btrim(_c(x), F.lit(PY_WHITESPACE))


def collapse_ws(x: Column | str) -> Column:
    """``' '.join(s.split())``: single spaces, no leading/trailing whitespace."""
    return py_strip(F.regexp_replace(_c(x), r"(?U)\s+", " "))


def nullif_empty(x: Column | str) -> Column:
    x = _c(x)
    return F.when(x == "", F.lit(None).cast("string")).otherwise(x)


# --- identity keys -----------------------------------------------------------

def slug_from_profile_url(url: Column | str) -> Column:
    """EXP-1: last path segment when the second-last one is ``profiles``; else NULL."""
    url = _c(url)
    path = F.try_parse_url(url, F.lit("PATH"))
    parts = F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/")
    ok = (F.size(parts) >= 2) & (F.try_element_at(parts, F.lit(-2)) == "profiles")
    return F.when(url.isNull() | (url == ""), F.lit(None).cast("string")) \
        .when(ok, F.try_element_at(parts, F.lit(-1))) \
        .otherwise(F.lit(None).cast("string"))


def slug_after_marker(url: Column | str, marker: str = "/profiles/") -> Column:
    """EXP-2: everything after the last occurrence of ``marker`` (query string kept)."""
    url = _c(url)
    return F.when(url.contains(marker), F.substring_index(url, marker, -1)) \
        .otherwise(F.lit(None).cast("string"))


def slug_second_last(url: Column | str, default: str | None = None) -> Column:
    """EXP-3: second-last ``/`` segment; ``default`` when there is none."""
    url = _c(url)
    seg = F.try_element_at(F.split(url, "/"), F.lit(-2))
    if default is None:
        return seg
    return F.when(url.contains("/"), F.coalesce(seg, F.lit(default))).otherwise(F.lit(default))


def normalize_name(name: Column | str) -> Column:
    """EXP-4: strip, lower-case, collapse whitespace; empty -> NULL."""
    s = F.regexp_replace(F.lower(py_strip(name)), r"(?U)\s+", " ")
    return nullif_empty(s)


def normalize_question(q: Column | str) -> Column:
    """EXP-5: strip; a space after any colon not followed by one; lower-case the first char."""
    s = F.regexp_replace(py_strip(q), ":([^ ])", ": $1")
    return F.concat(F.lower(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))


def normalize_option(x: Column | str) -> Column:
    """EXP-6: option text as compared by the validator."""
    s = collapse_ws(F.lower(_c(x)))
    s = F.regexp_replace(s, "[" + "".join("\\" + ch for ch in OPTION_TRAILING) + "]+$", "")
    s = F.regexp_replace(s, ":+", ":")
    s = F.replace(s, F.lit(" :"), F.lit(":"))
    s = F.replace(s, F.lit(":"), F.lit(": "))
    s = F.replace(s, F.lit(":  "), F.lit(": "))
    s = collapse_ws(s)
    return F.when(_c(x).isNull() | (_c(x) == ""), F.lit("")).otherwise(s)


# --- stance parsing ----------------------------------------------------------

def parse_stance_prefix(text: Column | str, stripped: Column | None = None,
                        lowered: Column | None = None) -> Column:
    """EXP-7: ``struct(stance, answer)`` by ordered case-insensitive prefixes.

    Agnostic text first; otherwise the first matching prefix, answer = rest
    stripped (may be empty); no match -> stance NULL, answer = stripped text.
    ``stripped``/``lowered`` may be columns computed in an earlier projection, so the
    strip and lower-case run once per row rather than once per prefix branch.
    """
    s = stripped if stripped is not None else py_strip(text)
    low = lowered if lowered is not None else F.lower(s)
    stance = F.when(low == AGNOSTIC.lower(), F.lit(AGNOSTIC))
    answer = F.when(low == AGNOSTIC.lower(), F.lit(AGNOSTIC.lower()))
    for prefix, name in STANCE_PREFIXES:
        hit = low.startswith(prefix.lower())
        stance = stance.when(hit, F.lit(name))
        answer = answer.when(hit, py_strip(F.substring(s, len(prefix) + 1, 1 << 30)))
    stance = stance.otherwise(F.lit(None).cast("string"))
    answer = answer.otherwise(s)
    return F.struct(stance.alias("stance"), answer.alias("answer"))


def _pattern(label: str) -> str:
    return r"(?iU)^" + label.replace("/", "\\/") + r":\s*([^\n]+)$"


def canonicalize_stance(text: Column | str) -> Column:
    """EXP-8: rewrite to canonical ``Stance: answer``; unparsed text kept (stripped)."""
    s = py_strip(text)
    out = F.when(F.lower(s) == AGNOSTIC.lower(), F.lit(f"{AGNOSTIC}: {AGNOSTIC.lower()}"))
    for label, name in STANCE_PATTERNS:
        pat = _pattern(label)
        out = out.when(s.rlike(pat),
                       F.concat(F.lit(name + ": "), py_strip(F.regexp_extract(s, pat, 1))))
    return out.otherwise(s)


def canonical_stance_name(text: Column | str) -> Column:
    """Stance name found by the anchored patterns of EXP-8 (NULL when unparsed)."""
    s = py_strip(text)
    out = F.when(F.lower(s) == AGNOSTIC.lower(), F.lit(AGNOSTIC))
    for label, name in STANCE_PATTERNS:
        out = out.when(s.rlike(_pattern(label)), F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def score_stance(stance: Column | str) -> Column:
    """EXP-9: stance name -> score; unknown -> NULL."""
    m = F.create_map(*[x for k, v in STANCE_SCORES.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(m, _c(stance))


def cell_key(question: Column | str, stance: Column | str, answer: Column | str) -> Column:
    """EXP-27: ``question:answer``; agnostic answers use ``question:agnostic/undecided``."""
    q, st, a = _c(question), _c(stance), _c(answer)
    return F.when(st == AGNOSTIC, F.concat(q, F.lit(":" + AGNOSTIC.lower()))) \
        .otherwise(F.concat(q, F.lit(":"), a))


def coerce_score(x: Column | str) -> Column:
    """EXP-20: numeric coercion; anything non-numeric (or NaN) becomes NULL."""
    d = _c(x).try_cast("double")
    return F.when(F.isnan(d), F.lit(None).cast("double")).otherwise(d)


# --- model-output list parsing -------------------------------------------------

def strip_code_fence(text: Column | str) -> Column:
    """Drop a leading fence line and a closing fence line, as the list parser does."""
    s = py_strip(text)
    lines = F.split(s, "\n")
    n = F.size(lines)
    last_is_fence = py_strip(F.element_at(lines, -1)) == "```"
    body = F.when(last_is_fence, F.slice(lines, 2, F.greatest(n - 2, F.lit(0)))) \
        .otherwise(F.slice(lines, 2, F.greatest(n - 1, F.lit(0))))
    return F.when(s.startswith("```"), py_strip(F.array_join(body, "\n"))).otherwise(s)


_JSON_OPTS = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}
_FALSY_JSON = ("0", "0.0", "false", "[]", "{}")   # as bare JSON values; the same as strings are kept


def _json_list(text: Column) -> Column:
    return F.from_json(text, "array<string>", _JSON_OPTS)


def parse_response_list(text: Column | str) -> Column:
    """EXP-10: parse a model answer into an ``array<string>``.

    First bracketed run as a JSON list (empty strings and the bare values null, 0, false,
    [] and {} dropped, items stripped; the *strings* "0" or "false" stay); else all double-quoted runs; else all single-quoted runs; else the text.
    Non-string JSON items come back as their JSON text (``true``, ``{...}``).
    """
    falsy = F.array(*[F.lit(v) for v in _FALSY_JSON])

    def listed(m: Column, parsed: Column) -> Column:
        # the same list as variants tells a string from a bare value of the same spelling
        kinds = F.from_json(m, "array<variant>", _JSON_OPTS)
        pairs = F.zip_with(parsed, kinds, lambda i, v: F.struct(i.alias("i"), (F.schema_of_variant(v) == "STRING").alias("is_text")))
        kept = F.filter(pairs, lambda p: p["i"].isNotNull() & (p["i"] != "")
                        & (F.coalesce(p["is_text"], F.lit(True)) | ~F.array_contains(falsy, p["i"])))
        return F.transform(kept, lambda p: py_strip(p["i"]))

    def quoted(s: Column) -> Column:
        dq = F.regexp_extract_all(s, F.lit('"([^"]+)"'), 1)
        sq = F.regexp_extract_all(s, F.lit("'([^']+)'"), 1)
        return once(dq, lambda d: F.when(F.size(d) > 0, d).otherwise(
            once(sq, lambda q: F.when(F.size(q) > 0, q).otherwise(F.array(s)))))

    def items(s: Column) -> Column:
        return once(F.regexp_extract(s, r"(?s)\[.*?\]", 0), lambda m: once(F.when(m != "", _json_list(m)), lambda parsed: F.when(
            parsed.isNotNull(), listed(m, parsed)).otherwise(quoted(s))))

    return once(strip_code_fence(text), items)


def extract_json_list(text: Column | str) -> Column:
    """EXP-11: fenced JSON list, else the text as a JSON list, else a JSON string
    holding a list, else the first bracketed run, else ``[text]``."""
    s = py_strip(text)
    fenced = F.regexp_extract(s, r"(?s)```(?:json)?\s*(\[.*?\])\s*```", 1)
    a1 = F.when(fenced != "", _json_list(fenced))
    a2 = _json_list(s)
    inner = F.when(s.startswith('"'), F.get_json_object(s, "$"))
    a3 = F.when(inner.isNotNull(), _json_list(inner))
    run = F.regexp_extract(s, r"(?s)\[.*?\]", 0)
    a4 = F.when(run != "", _json_list(run))
    return F.coalesce(a1, a2, a3, a4, F.array(s))


def quoted_item(x: Column) -> Column:
    """A string as a list prints it: single quotes, double ones where it holds just single ones,
    with backslashes and line breaks escaped."""
    s = F.replace(x, F.lit("\\"), F.lit("\\\\"))
    for ch, esc in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = F.replace(s, F.lit(ch), F.lit(esc))
    single, double = x.contains("'"), x.contains('"')
    return (F.when(single & ~double, F.concat(F.lit('"'), s, F.lit('"')))
            .otherwise(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'"))))


def validate_response(items: Column | str, options: Column | str) -> Column:
    """EXP-12: ``struct(valid, message)``: every item must match an option raw, after
    normalisation, or after normalisation with colons removed.

    The options are normalised once a row, and only where an item matches none of them raw."""
    items, options = _c(items), _c(options)

    def no_colons(x: Column) -> Column:
        return F.replace(x, F.lit(":"), F.lit(""))

    def unknown(items: Column, norm: Column) -> Column:
        def other(i: Column, norm_nc: Column) -> Column:
            return once(normalize_option(i), lambda n: ~(F.array_contains(norm, n) | F.array_contains(norm_nc, no_colons(n))))
        return once(F.transform(norm, no_colons), lambda norm_nc: F.filter(items, lambda i: other(i, norm_nc)))

    def judged(invalid: Column) -> Column:
        msg_list = F.concat(F.lit("["), F.array_join(F.transform(F.slice(invalid, 1, 3), quoted_item), ", "), F.lit("]"))
        message = F.when(F.size(invalid) > 0, F.concat(F.lit("Invalid options: "), msg_list)).otherwise(F.lit("Valid"))
        return F.struct((F.size(invalid) == 0).alias("valid"), message.alias("message"))

    empty = F.struct(F.lit(False).alias("valid"), F.lit("Empty response").alias("message"))
    not_raw = F.filter(items, lambda i: ~F.array_contains(options, i))
    invalid = once(not_raw, lambda x: F.when(F.size(x) == 0, x).otherwise(
        once(F.transform(options, normalize_option), lambda norm: unknown(x, norm))))
    return F.when(items.isNull() | (F.size(items) == 0), empty).otherwise(once(invalid, judged))


# --- misc text predicates and keys -------------------------------------------

def year_bin(year: Column | str, size: int = 5) -> Column:
    """EXP-19: ``start-end`` label of a ``size``-year bin (floor division)."""
    y = _c(year)
    start = (F.floor(y / F.lit(size)) * F.lit(size)).cast("bigint")
    return F.when(y.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(start.cast("string"), F.lit("-"), (start + size - 1).cast("string")))


def is_blocked_page(html: Column | str, phrases: Sequence[str] = tuple(BLOCKED_PHRASES)) -> Column:
    """EXP-21: any blocked-page phrase appears (case-insensitive)."""
    low = F.lower(_c(html))
    hit = F.lit(False)
    for p in phrases:
        hit = hit | low.contains(p)
    return F.coalesce(hit, F.lit(False))


def is_blocked_page_simple(html: Column | str) -> Column:
    """EXP-21, second rule: contains both ``cloudflare`` and ``blocked``."""
    low = F.lower(_c(html))
    return F.coalesce(low.contains("cloudflare") & low.contains("blocked"), F.lit(False))


def safe_filename(name: Column | str, max_len: int | None = None) -> Column:
    """EXP-22: keep word/space/hyphen chars, strip, spaces -> ``_``, optional cut."""
    s = F.replace(py_strip(F.regexp_replace(_c(name), r"(?U)[^\w\s-]", "")), F.lit(" "), F.lit("_"))
    return F.substring(s, 1, max_len) if max_len else s


def name_from_file(file_name: Column | str, suffix: str = "_views.html") -> Column:
    """EXP-23: respondent key from a page file name."""
    return F.replace(_c(file_name), F.lit(suffix), F.lit(""))


def resolve_link(href: Column | str, base: Column | str) -> Column:
    """EXP-24: a link resolved against the URL of its page, by the rules of URL joining.

    A link with a scheme is kept; ``//host/x`` takes the page's scheme, ``/x`` its host, ``?q`` its path,
    ``#f`` (or nothing) its path and query; other links replace what follows the last slash of the
    path.  ``.`` and ``..`` segments of the joined path are resolved."""
    h, b = _c(href), _c(base)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    site = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    no_fragment = F.regexp_replace(b, "#.*$", "")
    no_query = F.regexp_replace(b, "[?#].*$", "")
    folder = F.regexp_replace(F.substr(no_query, F.length(site) + 1), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)

    def clean(path: Column) -> Column:
        """``path`` (may end in ?query or #fragment) with its dot segments resolved."""
        tail = F.regexp_extract(path, "([?#].*)$", 1)
        parts = F.split(F.regexp_replace(path, "[?#].*$", ""), "/")
        last = F.element_at(parts, -1)
        # the first part is the empty text before the leading slash and is never removed
        done = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(
            x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
        done = F.when(last.isin(".", ".."), F.concat(done, F.array(F.lit("")))).otherwise(done)
        return F.concat(F.array_join(done, "/"), tail)

    return (F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, h))
            .when(h.startswith("/"), F.concat(site, clean(h)))
            .when(h == "", no_fragment)
            .when(h.startswith("#"), F.concat(no_fragment, h))
            .when(h.startswith("?"), F.concat(no_query, h))
            .otherwise(F.concat(site, clean(F.concat(folder, h)))))


def anonymized_id(pos: Column | str, prefix: str = "Philosopher") -> Column:
    """EXP-16: ``<prefix>_%04d`` of the record's input position."""
    return F.format_string(prefix + "_%04d", _c(pos))


def profile_completeness(specs: Column | str, interests: Column | str,
                         phd: Column | str, institution: Column | str) -> Column:
    """EXP-25: number of non-empty fields among the four profile fields."""
    def nz_arr(a):
        return F.when(F.coalesce(F.size(_c(a)), F.lit(0)) > 0, 1).otherwise(0)

    def nz_str(s):
        return F.when(F.coalesce(_c(s), F.lit("")) != "", 1).otherwise(0)
    return nz_arr(specs) + nz_arr(interests) + nz_str(phd) + nz_str(institution)
