"""License scan by ordered signature rules.

A text is read as lower-case words.  A cheap gate finds texts that can hold a license mention at all; in
those, every rule whose keyword occurs looks for its pattern, and each match is an interval of words.  Of
overlapping detections the better ones stay: a match that lies inside another one of the same or a better
priority is dropped (of equal matches the earlier rule's stays).  DataFrame functions only, row by row,
without a shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels (fixed values).
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: License families: label, the words of its name, a word that every mention holds, its versions, the words
#: of its short identifier ('' if none).  Names and identifiers are those the licenses themselves use.
FAMILIES = (
    ("gpl", "(?:gnu )?(?:general public licen[sc]e|gpl)", "g", ("1", "2", "3"), "gpl"),
    ("lgpl", "(?:gnu )?(?:(?:lesser|library) general public licen[sc]e|lgpl)", "l", ("2", "2 1", "3"), "lgpl"),
    ("agpl", "(?:gnu )?(?:affero general public licen[sc]e|agpl)", "a", ("1", "3"), "agpl"),
    ("fdl", "(?:gnu )?free documentation licen[sc]e", "documentation", ("1 1", "1 2", "1 3"), "gfdl"),
    ("apache", "apache(?: software)?(?: licen[sc]e)?", "apache", ("1", "1 1", "2", "2 0"), "apache"),
    ("mit", "mit(?: x11)?(?: licen[sc]e)?", "mit", (), "mit"),
    ("bsd", "(?:new |modified |simplified |revised |2 clause |3 clause |4 clause )?bsd(?: licen[sc]e)?", "bsd", (), "bsd"),
    ("mpl", "mozilla public licen[sc]e", "mozilla", ("1 0", "1 1", "2 0"), "mpl"),
    ("epl", "eclipse public licen[sc]e", "eclipse", ("1 0", "2 0"), "epl"),
    ("cddl", "common development and distribution licen[sc]e", "distribution", ("1 0", "1 1"), "cddl"),
    ("cpl", "common public licen[sc]e", "common", ("1 0",), "cpl"),
    ("artistic", "artistic licen[sc]e", "artistic", ("1 0", "2 0"), "artistic"),
    ("isc", "isc licen[sc]e", "isc", (), "isc"),
    ("zlib", "zlib(?: libpng)? licen[sc]e", "zlib", (), "zlib"),
    ("boost", "boost software licen[sc]e", "boost", ("1 0",), "bsl"),
    ("unlicense", "unlicense", "unlicense", (), "unlicense"),
    ("wtfpl", "do what the fuck you want to public licen[sc]e", "want", ("2",), "wtfpl"),
    ("openssl", "openssl licen[sc]e", "openssl", (), "openssl"),
    ("python", "python(?: software foundation)? licen[sc]e", "python", ("2", "2 0"), "psf"),
    ("php", "php licen[sc]e", "php", ("3 0", "3 01"), "php"),
    ("ruby", "ruby licen[sc]e", "ruby", (), "ruby"),
    ("postgresql", "postgresql licen[sc]e", "postgresql", (), "postgresql"),
    ("ofl", "(?:sil )?open font licen[sc]e", "font", ("1 0", "1 1"), "ofl"),
    ("eupl", "european union public licen[sc]e", "european", ("1 0", "1 1", "1 2"), "eupl"),
    ("osl", "open software licen[sc]e", "open", ("1 0", "2 0", "2 1", "3 0"), "osl"),
    ("afl", "academic free licen[sc]e", "academic", ("1 1", "2 0", "2 1", "3 0"), "afl"),
    ("ms-pl", "microsoft public licen[sc]e", "microsoft", (), "ms pl"),
    ("ms-rl", "microsoft reciprocal licen[sc]e", "reciprocal", (), "ms rl"),
    ("cecill", "cecill(?: free software)?(?: licen[sc]e)?", "cecill", ("1 0", "2 0", "2 1"), "cecill"),
    ("odbl", "open database licen[sc]e", "database", ("1 0",), "odbl"),
    ("odc-by", "open data commons attribution licen[sc]e", "commons", ("1 0",), "odc by"),
    ("pddl", "public domain dedication and licen[sc]e", "dedication", ("1 0",), "pddl"),
    ("cc0", "(?:cc0|cc zero)", "c", ("1 0",), "cc0"),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution noncommercial noderivatives)", "by", ("2 0", "3 0", "4 0"), "cc by nc nd"),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution noncommercial sharealike)", "by", ("2 0", "3 0", "4 0"), "cc by nc sa"),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution noncommercial)", "by", ("2 0", "3 0", "4 0"), "cc by nc"),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution noderivatives)", "by", ("2 0", "3 0", "4 0"), "cc by nd"),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution sharealike)", "by", ("2 0", "3 0", "4 0"), "cc by sa"),
    ("cc-by", "(?:cc by|creative commons attribution)", "by", ("2 0", "2 5", "3 0", "4 0"), "cc by"),
    ("public-domain", "public domain", "domain", (), ""),
    ("proprietary", "all rights reserved", "reserved", (), ""),
)

#: Ways to mention a license, best first: pattern of words around the name, priority, confidence.
FORMS = (
    ("spdx license identifier {id}", 0, 1.0),
    ("(?:licensed|released|distributed|published|provided) under (?:the )?(?:terms of )?(?:the )?{name}", 1, 0.95),
    ("{name}(?: licen[sc]e)? (?:version |v )?{version}", 1, 0.9),
    ("(?:subject to|available under|use of this (?:file|work|software) is governed by) (?:the )?(?:terms of )?(?:the )?{name}", 1, 0.9),
    ("(?:see|read) (?:the )?(?:file )?(?:licen[sc]e|copying)? ?(?:for )?(?:the )?{name}", 2, 0.8),
    ("under (?:a |an |the )?{name}", 2, 0.8),
    ("{name}", 3, 0.7),
)

BASE_SCORE = 0.6  # a base phrase without any kept rule

#: What the gate looks for in the lower-case text; every rule and base phrase but 'cc by' needs one of them.
GATE = ("licen", "gpl", "gfdl", "apache", "spdx", "creative", "domain", "rights", "bsd", "cecill", "cc0", "zero", "mit")
#: And in its words; patterns without any of these do not exist.
GATE_WORDS = ("licen[sc]e", "licensed", "[al]?gpl", "gfdl", "apache", "spdx", "creative", "domain", "rights", "bsd", "cecill",
              "cc0", "cc", "unlicense", "under", "subject", "governed", "mit x11")
_WORD_CHARS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _indexed(pattern: str) -> str:
    """A pattern over words as one over words that carry their number: ' mit#3 license#4'."""
    return " " + pattern.replace("? ?", "?#SP#?").replace(" ", r"#\d+ ").replace("?#SP#?", "?(?:#\\d+ )?") + r"#\d+"


def rules() -> list[dict]:
    """The ordered rules, made from the families and the forms."""
    out = []
    for form, priority, confidence in FORMS:
        if "copying" in form:  # written out: its optional words sit between spaces
            form = "(?:see|read) (?:the )?(?:file )?(?:licen[sc]e |copying )?(?:for )?(?:the )?{name}"
        for label, name, keyword, versions, short in FAMILIES:
            keep = {"label": label, "keyword": keyword if len(keyword) > 2 else "", "priority": priority, "confidence": confidence}
            if "{id}" in form:
                if short:
                    out.append(keep | {"pattern": form.replace("{id}", short), "keyword": "spdx"})
            elif "{version}" in form:
                out += [keep | {"pattern": form.replace("{name}", name).replace("{version}", v)} for v in versions]
            else:
                out.append(keep | {"pattern": form.replace("{name}", name)})
    bare = {"mit", "apache", "bsd", "cecill", "python", "ruby"}
    for r in out:
        if r["priority"] >= 2 and r["label"] in bare:  # the bare name is a common word: the license must follow
            r["pattern"] = r["pattern"].replace("(?: licen[sc]e)?", " licen[sc]e")
    return [r | {"rule": k, "regex": _indexed(r["pattern"])} for k, r in enumerate(out)]


def _rules_column(table: list[dict]) -> Column:
    fields = "rule int, keyword string, label string, priority int, confidence double, regex string"
    names = [x.split()[0] for x in fields.split(", ")]
    return F.from_json(F.lit(json.dumps([{k: r[k] for k in names} for r in table])), f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections per row.

    Null and empty texts have no words, no labels ('') and score 0; rows come out as they come in, repeated
    ones and null ids too; extra columns are ignored.  The score is the best confidence of a kept match."""
    text = F.coalesce(F.col("text"), F.lit(""))
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("_t"))
    src = src.withColumn("n_words", F.regexp_count("_t", F.lit(_WORD_CHARS)).cast("bigint")).withColumn("_low", F.lower("_t"))
    gate = F.col("_low").rlike(r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by")
    for g in GATE:
        gate = gate | F.col("_low").contains(g)
    norm = F.trim(F.regexp_replace(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _NOT_WORD, " "))
    src = src.select("doc_id", "n_words", F.when(gate, norm).alias("_norm"))
    numbered = F.concat(F.lit(" "), F.array_join(F.transform(F.split("_norm", " "), lambda w, i: F.concat(w, F.lit("#"), i.cast("string"))), " "))
    # of the gated texts, number the words only where a rule or phrase can match
    words = F.concat(F.lit(" "), F.col("_norm"), F.lit(" "))
    src = src.withColumn("_n", F.when(words.rlike(f" (?:{'|'.join(GATE_WORDS)}) "), numbered))
    src = src.select("doc_id", "n_words", F.coalesce("_n", F.lit("")).alias("_n"))
    number = lambda m, rx: F.regexp_extract(m, rx, 1).cast("bigint")

    def places(phrase: str, label: str) -> Column:
        return F.transform(F.regexp_extract_all("_n", F.lit(_indexed(phrase)), F.lit(0)),
                           lambda m: F.struct(number(m, r"#(\d+)").alias("s"), F.lit(label).alias("l")))

    base = [places(p, lab) for p, lab in BASE]
    src = src.withColumn("_base", F.concat(*base))
    holds = lambda r: (F.length(r["keyword"]) == 0) | F.contains(F.col("_n"), F.concat(F.lit(" "), r["keyword"], F.lit("#")))
    found = F.flatten(F.transform(
        F.filter(_rules_column(rules()), lambda r: (F.length("_n") > 0) & holds(r)),
        lambda r: F.transform(F.regexp_extract_all(F.col("_n"), r["regex"], F.lit(0)), lambda m: F.struct(
            number(m, r"#(\d+)").alias("s"), (-number(m, r"#(\d+)$")).alias("e"), r["priority"].alias("p"), r["rule"].alias("r"),
            r["label"].alias("l"), r["confidence"].alias("c")))))
    src = src.withColumn("_found", F.array_sort(found))  # by start, end downwards, priority, rule
    none = F.lit(-1).cast("bigint")
    zero = F.struct(*(none.alias(f"m{p}") for p in range(4)), F.array().cast("array<string>").alias("l"),
                    F.lit(0.0).alias("c"), F.lit(0).cast("bigint").alias("n"))

    def fold(a: Column, m: Column) -> Column:
        end = -m["e"]
        inside = F.lit(False)
        for p in range(4):  # something before it reaches as far and is as good
            inside = inside | ((m["p"] >= p) & (a[f"m{p}"] >= end))
        return F.struct(*(F.when(m["p"] == p, F.greatest(a[f"m{p}"], end)).otherwise(a[f"m{p}"]).alias(f"m{p}") for p in range(4)),
                        F.when(inside, a["l"]).otherwise(F.array_union(a["l"], F.array(m["l"]))).alias("l"),
                        F.when(inside, a["c"]).otherwise(F.greatest(a["c"], m["c"])).alias("c"),
                        F.when(inside, a["n"]).otherwise(a["n"] + 1).alias("n"))

    src = src.withColumn("_kept", F.aggregate("_found", zero, fold))
    base_labels = F.array_sort(F.array_distinct(F.transform("_base", lambda b: b["l"])))
    return src.select(
        "doc_id", "n_words", F.size("_base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("_base", lambda b: b["s"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda b: b["s"])).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("_kept.l"))), ",").alias("labels"),
        F.greatest(F.col("_kept.c"), F.when(F.size("_base") > 0, BASE_SCORE).otherwise(0.0)).alias("score"),
        F.col("_kept.n").alias("detections"))


def scan_sql() -> str:
    """The scan in SQL over ``documents`` (suppression stated as a condition on pairs of matches)."""
    def q(s: str) -> str:
        return s.replace("'", "''")
    values = ", ".join(f"({r['rule']}, '{r['keyword']}', '{r['label']}', {r['priority']}, {r['confidence']}, '{q(r['regex'])}')" for r in rules())
    phrases = ", ".join(f"('{q(_indexed(p))}', '{lab}')" for p, lab in BASE)
    return f"""WITH rules(rule, keyword, label, priority, confidence, regex) AS (VALUES {values}),
phrases(regex, label) AS (VALUES {phrases}),
w AS (SELECT row_number() OVER () AS k, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
t AS (SELECT k, doc_id, CAST(len(words) AS BIGINT) AS n_words,
  ' ' || array_to_string(list_transform(range(1, len(words) + 1), lambda i: words[i] || '#' || CAST(i - 1 AS VARCHAR)), ' ') AS n FROM w),
b AS (SELECT k, label, CAST(regexp_extract(m, '#([0-9]+)', 1) AS BIGINT) AS s
  FROM (SELECT k, label, unnest(regexp_extract_all(n, regex)) AS m FROM t JOIN phrases ON contains(n, 'licen') OR contains(n, ' cc#'))),
f AS (SELECT k, rule, label, priority, confidence, CAST(regexp_extract(m, '#([0-9]+)', 1) AS BIGINT) AS s, CAST(regexp_extract(m, '#([0-9]+)$', 1) AS BIGINT) AS e
  FROM (SELECT k, rule, label, priority, confidence, unnest(regexp_extract_all(n, regex)) AS m FROM t JOIN rules ON keyword = '' OR contains(n, ' ' || keyword || '#'))),
kept AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.k = f.k AND g.rule <> f.rule AND g.s <= f.s AND g.e >= f.e
  AND (g.priority < f.priority OR g.priority = f.priority AND (g.e - g.s > f.e - f.s OR g.rule < f.rule)))
  AND NOT EXISTS (SELECT 1 FROM f g WHERE g.k = f.k AND g.rule = f.rule AND g.s <= f.s AND g.e >= f.e AND g.e - g.s > f.e - f.s)),
bs AS (SELECT k, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY k),
ls AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM b UNION SELECT k, label FROM kept) GROUP BY k),
ks AS (SELECT k, max(confidence) AS c, count(*) AS detections FROM kept GROUP BY k)
SELECT t.doc_id, t.n_words, CAST(coalesce(bs.n_base, 0) AS BIGINT) AS n_base, bs.first_word, bs.last_word, coalesce(bs.base_labels, '') AS base_labels,
  coalesce(ls.labels, '') AS labels, CAST(greatest(coalesce(ks.c, 0), CASE WHEN bs.n_base > 0 THEN {BASE_SCORE} ELSE 0 END) AS DOUBLE) AS score,
  CAST(coalesce(ks.detections, 0) AS BIGINT) AS detections
FROM t LEFT JOIN bs USING (k) LEFT JOIN ls USING (k) LEFT JOIN ks USING (k)"""
