"""Preference pairs for fine-tuning (PREF-1/2, SMP-1/2, EXP-17, EXP-18).

Respondents are split *before* answers are exploded, so no respondent lands
in both train and validation.  Randomness is replaced by hashes of stable
keys (md5 of seed + id), so a retried task reproduces every draw.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stanceframe.functions import prompts as P
from stanceframe.functions import text as T
from stanceframe.operators.merge import dedupe_last
from stanceframe.operators.ordering import dense_index
from stanceframe.session import materialize

# ---------------------------------------------------------------------------
# Topic keyword table (topic, keywords, question), in table order.
# ---------------------------------------------------------------------------
DEFAULT_TOPICS = [
    ("free will", ["free will", "compatibilism", "libertarianism", "determinism"],
     "Free will: compatibilism, libertarianism, or no free will?"),
    ("god", ["god", "theism", "atheism", "agnosticism"], "God: theism or atheism?"),
    ("mind", ["physicalism", "dualism", "mind-body", "non-physicalism"], "Mind: physicalism or non-physicalism?"),
    ("trolley", ["trolley", "footbridge", "switch"], "Trolley problem: switch or don't switch?"),
    ("meta-ethics", ["moral realism", "moral anti-realism", "meta-ethics"],
     "Meta-ethics: moral realism or moral anti-realism?"),
    ("abstract objects", ["platonism", "nominalism", "abstract objects"], "Abstract objects: Platonism or nominalism?"),
    ("a priori", ["a priori", "apriori", "a-priori"], "A priori knowledge: yes or no?"),
    ("normative ethics", ["deontology", "consequentialism", "virtue ethics"],
     "Normative ethics: deontology, consequentialism, or virtue ethics?"),
    ("personal identity", ["personal identity", "biological view", "psychological view"],
     "Personal identity: biological, psychological, or further-fact view?"),
    ("external world", ["external world", "skepticism", "non-skeptical realism", "idealism"],
     "External world: non-skeptical realism, skepticism, or idealism?"),
]

# Stance -> opposite, and the two alternatives one is drawn from.
OPPOSITE = {"accept": "reject", "reject": "accept", "lean towards": "lean against",
            "lean against": "lean towards", "neutral": "reject"}
ALTERNATIVES = {"accept": ["lean against", "reject"], "reject": ["lean towards", "accept"],
                "lean towards": ["lean against", "reject"], "lean against": ["lean towards", "accept"],
                "neutral": ["accept", "reject"]}
NO_STANCE_NEGATIVES = ["reject", "neutral"]
# ---------------------------------------------------------------------------


def match_topic(text: Column, topics: Sequence[tuple[str, Sequence[str], str]] = DEFAULT_TOPICS) -> Column:
    """EXP-17: ``struct(topic, question)`` with the most keyword hits (substring, case-
    insensitive); ties -> first topic in table order; no hit -> NULL.

    One Catalyst expression over a literal topic table (its size is fixed by the
    caller), so matching whole texts stays in the JVM with no join.
    """
    low = F.lower(text)
    cands = []
    for i, (topic, kws, question) in enumerate(topics):
        hits = sum((F.when(low.contains(k.lower()), 1).otherwise(0) for k in kws), F.lit(0))
        cands.append(F.struct(hits.alias("score"), F.lit(-i).alias("neg_pos"), F.lit(topic).alias("topic"),
                              F.lit(question).alias("question")))
    best = F.array_max(F.array(*cands))
    return F.when(best["score"] > 0, F.struct(best["topic"].alias("topic"), best["question"].alias("question")))


def negative_stances(text: Column, draw: Column) -> Column:
    """EXP-18: ``array<string>`` of lower-case negatives for an answer text.

    First = the opposite stance (answer part kept); second = the alternative
    picked by ``draw`` (0/1) unless it equals the opposite.  No stance ->
    ``['reject', 'neutral']``.
    """
    low = F.lower(T.py_strip(text))
    stance = None
    for k in OPPOSITE:
        stance = F.when(low.startswith(k), F.lit(k)) if stance is None else stance.when(low.startswith(k), F.lit(k))
    opp = F.create_map(*[x for k, v in OPPOSITE.items() for x in (F.lit(k), F.lit(v))])[stance]
    alts = F.create_map(*[x for k, v in ALTERNATIVES.items()
                          for x in (F.lit(k), F.array(*[F.lit(a) for a in v]))])[stance]
    alt = F.element_at(alts, (draw % 2 + 1).cast("int"))
    has_colon = low.contains(":")
    answer = T.py_strip(F.regexp_extract(low, r"(?s)^[^:]*:(.*)$", 1))

    def fmt(s):
        return F.when(has_colon, F.concat(s, F.lit(": "), answer)).otherwise(s)
    second = F.when(alt != opp, fmt(alt))
    return F.when(stance.isNull(), F.array(*[F.lit(x) for x in NO_STANCE_NEGATIVES])) \
        .otherwise(F.array_compact(F.array(fmt(opp), second)))


def split_key(seed: int, key: Column) -> Column:
    """Deterministic shuffle key: md5 of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def respondent_split(respondents: DataFrame, key: str, seed: int = 42, train_frac: float = 0.85,
                     method: str = "exact") -> DataFrame:
    """SMP-1: split by respondent.  ``exact``: shuffle by hash, first floor(frac*n) train
    (a distributed dense index, no single-task window); ``hash``: train when the hash
    falls below ``frac`` (no global count; for very large n)."""
    k = split_key(seed, F.col(key))
    if method == "hash":
        u = F.conv(F.substring(k, 1, 8), 16, 10).cast("double") / 4294967296.0
        return respondents.withColumn("split", F.when(u < train_frac, "train").otherwise("val"))
    n = respondents.count()
    cut = int(n * train_frac)
    x = dense_index(respondents.withColumn("_k", k), ["_k", key], "_spos")
    return x.withColumn("split", F.when(F.col("_spos") < cut, "train").otherwise("val")).drop("_k", "_spos")


def eligible_respondents(records: DataFrame, details: DataFrame, min_fields: int = 1,
                         anon_prefix: str = "Philosopher") -> DataFrame:
    """Records flagged as having answers, joined to their details (JOIN-12, last detail per
    URL wins), with at least ``min_fields`` profile fields, and an anonymous id taken from
    the record's input position (before any filter)."""
    # positions and eligibility on the narrow key columns only (no answer texts)
    idx = dense_index(records.select("rec_pos", "profile_url", "has_survey_responses"), ["rec_pos"], "_idx")
    kept = idx.where(F.coalesce(F.col("has_survey_responses"), F.lit(False)))
    order = "_order" if "_order" in details.columns else None
    det = details if order is None else dedupe_last(details, ["profile_url"], order).drop(order)
    if order is None:
        # no input order given: pick deterministically by content, so a retried task agrees
        det = dedupe_last(details.withColumn("_dpos", F.xxhash64(*[F.col(c) for c in details.columns])),
                          ["profile_url"], "_dpos").drop("_dpos")
    j = kept.join(det, "profile_url", "left")
    comp = T.profile_completeness("areas_of_specialization", "areas_of_interest", "phd_institution",
                                  "current_institution")
    return j.where(comp >= min_fields).withColumn("anon_id", T.anonymized_id(F.col("_idx"), anon_prefix))


def preference_pairs(records: DataFrame, details: DataFrame, topics=DEFAULT_TOPICS, seed: int = 42,
                     train_frac: float = 0.85, min_fields: int = 1, min_chars: int = 5,
                     draw: Column | None = None, anon_prefix: str = "Philosopher") -> DataFrame:
    """PREF-1: survey records -> (prompt, chosen, rejected) rows with a respondent split.

    records: ``(rec_pos, profile_url, has_survey_responses, survey_responses array<struct<raw_text>>)``;
    details: D13 rows keyed by ``profile_url`` (last one wins).  ``draw`` is a 0/1
    column over (rec_pos, resp_pos); default = md5 hash of seed and keys.
    """
    j = eligible_respondents(records, details, min_fields, anon_prefix)
    # one narrow row per kept respondent (id, split, persona), written once: it is read by the
    # split's count and ordering and by the join below, while the answer texts are read once
    j = materialize(respondent_split(j, "anon_id", seed, train_frac)
                    .select("rec_pos", "anon_id", "split", P.anon_persona_prompt().alias("persona")))
    j = records.select("rec_pos", "survey_responses").join(j, "rec_pos")
    a = j.select("rec_pos", "anon_id", "split", "persona",
                 F.posexplode("survey_responses").alias("resp_pos", "resp"))
    a = a.select("rec_pos", "anon_id", "split", "persona", "resp_pos",
                 F.coalesce(F.col("resp.raw_text"), F.lit("")).alias("chosen"))
    a = a.where(F.length("chosen") >= min_chars)
    a = a.withColumn("topic", match_topic(F.col("chosen"), topics)).where(F.col("topic").isNotNull())
    if draw is None:
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("anon_id"),
                                                    F.col("resp_pos").cast("string"))), 1, 8), 16, 10).cast("bigint")
    a = a.withColumn("_draw", draw)
    a = a.withColumn("negs", negative_stances(F.col("chosen"), F.col("_draw")))
    out = a.select("anon_id", "split", F.col("resp_pos").cast("bigint").alias("resp_pos"),
                   P.preference_prompt(F.col("persona"), F.col("topic.question")).alias("prompt"), "chosen",
                   F.posexplode("negs").alias("neg_pos", "rejected"))
    return out.withColumn("neg_pos", F.col("neg_pos").cast("bigint"))


def preference_counts(pairs: DataFrame) -> DataFrame:
    """PREF-2: examples per split."""
    return pairs.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n_examples"))


def training_subset(pairs: DataFrame, n_train: int = 50, n_val: int = 10, carve_val: int = 20,
                    order: Sequence[str] = ("anon_id", "resp_pos", "neg_pos")) -> DataFrame:
    """SMP-2: first ``n_train`` train and ``n_val`` validation rows in order; when there
    is no validation split, the first ``carve_val`` train rows become validation."""
    train = pairs.where(F.col("split") == "train")
    val = pairs.where(F.col("split") == "val")
    if val.limit(1).count() == 0:
        first = train.orderBy(*order).limit(carve_val)
        val = first.withColumn("split", F.lit("val"))
        train = train.join(first.select(*order), list(order), "left_anti")
    t = train.orderBy(*order).limit(n_train)
    v = val.orderBy(*order).limit(n_val)
    return t.unionByName(v)
