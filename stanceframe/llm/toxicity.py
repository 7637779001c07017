"""Toxicity by weak supervision: many weak voters, a generative label model, a linear classifier.

Voters: lexicon voters fire on one entry each, a word or a word beginning that is typical of toxic training
rows; pattern voters fire on several entries together, on entries spelled with look-alike marks, on shouted
entries, and against toxicity where no entry occurs.  The label model sees only the votes: it fits every
voter's accuracy by expectation maximisation, estimates which voters still fire together inside the
classes, and lets such voters share one vote.  Its posterior labels then train a logistic regression over
all entries, which scores whole texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanceframe.llm.common import free_other_caches, is_held_out, labelled_sample, small_batches

PER_CLASS = 3000  # labelled rows of each class that may reach the driver
MAX_ENTRIES = 4000  # entries of the lexicon, also the inputs of the classifier
MAX_VOTERS = 96
STEMS = (4, 5, 6)  # lengths of word beginnings

# look-alike marks and the letters they stand for (fixed values)
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_WORD = re.compile(r"[^\W\d_]{2,}")
_MIXED = re.compile(r"[^\W\d_]+(?:[0134579@$!*._-]+[^\W\d_]+)+|[0-9@$]+[^\W\d_]+(?:[0134579@$!]+[^\W\d_]*)*")
_SHOUT = re.compile(r"[^\W\d_]{3,}")


def entries_of(word: str) -> list[str]:
    """The entries a lower-case word can match: itself, and its beginnings (marked by a star)."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


def plain_words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def disguised_words(text: str) -> set[str]:
    """Words written with look-alike marks or marks between their letters, spelled out."""
    out = set()
    for m in _MIXED.findall(text.lower()):
        w = m.translate(LOOKALIKE)
        out.add(re.sub(r"[^\W\d_]*[^\w]|[\W\d_]", lambda x: re.sub(r"[\W\d_]", "", x.group()), w))
    return out


@dataclass
class Votes:
    """What the voters and the classifier see of a text."""

    entries: set[int]
    disguised: bool
    shouted: bool


@dataclass
class Lexicon:
    index: dict[str, int]
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def look(self, text: str) -> Votes:
        cache, index = self.cache, self.index
        hits: set[int] = set()
        for w in plain_words(text):
            got = cache.get(w)
            if got is None:
                if len(cache) > 150_000:
                    cache.clear()
                got = cache[w] = tuple(index[e] for e in entries_of(w) if e in index)
            if got:
                hits.update(got)
        hidden = {index[w] for w in disguised_words(text) if w in index}
        shouted = bool(hits) and any(w.isupper() and w.lower() in index for w in _SHOUT.findall(text))
        return Votes(hits | hidden, bool(hidden), shouted)


def build_lexicon(sample: list[tuple[str, int]], least: float = 30.0) -> list[tuple[str, float]]:
    """Entries that are far commoner in toxic training rows, strongest first, with their evidence.

    Evidence is the log-likelihood ratio of the document frequencies; ``least`` leaves next to none of the
    millions of candidates to chance, and the share among toxic rows must be ten times the other."""
    n = [max(1, sum(1 for _, y in sample if y == k)) for k in (0, 1)]
    # counted as numbers first: the millions of candidates never stand in memory as texts
    held: tuple[list, list] = ([], [])
    for t, y in sample:
        held[y].append(np.fromiter({hash(e) for w in plain_words(t) for e in entries_of(w)}, np.int64))
    (k0, c0), (k1, c1) = (np.unique(np.concatenate([np.zeros(0, np.int64), *x]), return_counts=True) for x in held)
    del held
    other = np.zeros(len(k1), np.int64)
    if len(k0):
        at = np.minimum(np.searchsorted(k0, k1), len(k0) - 1)
        other = np.where(k0[at] == k1, c0[at], 0)
    share = n[1] / (n[0] + n[1])
    both = other + c1
    g = 2 * (c1 * np.log(c1 / (both * share)) + other * np.log(np.maximum(other, 1) / (both * (1 - share))))
    # small samples cannot give much evidence
    need = np.where((c1 >= 3) & (other == 0), least * min(1.0, len(sample) / 1000), least)
    ok = (c1 / n[1] >= 10 * other / n[0]) & (g >= need)
    evidence = dict(zip(k1[ok].tolist(), g[ok].tolist(), strict=True))
    found = {e: evidence[h] for t, y in sample if y for w in plain_words(t) for e in entries_of(w) if (h := hash(e)) in evidence}
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))[:MAX_ENTRIES]


class LabelModel:
    """Generative model of voters that vote toxic (1), clean (-1) or abstain (0).

    A voter is right with its own accuracy whenever it votes; abstaining says nothing, so the class share
    among voted texts is even and it is the clean voter that speaks for the many texts without any
    entry.  Expectation maximisation fits the accuracies; ``trust`` is the weight of the starting accuracy
    against a voter's own votes, without which the labels can drift.  The correlation of the voters'
    firing that the classes leave unexplained makes dependent voters share one vote."""

    def __init__(self, prior: float = 0.5, start: float = 0.9, trust: float = 0.5):
        self.prior, self.start, self.trust = prior, start, trust

    def fit(self, votes: np.ndarray, rounds: int = 60) -> LabelModel:
        """``votes``: rows x voters of 1, 0, -1; no labels."""
        n, m = votes.shape
        cast = np.maximum(np.abs(votes).sum(axis=0), 1)
        self.accuracy = np.full(m, self.start)
        self.weight = np.ones(m)
        self.correlation = np.zeros((m, m))
        up, down = (votes > 0).astype(np.float64), (votes < 0).astype(np.float64)
        p = self.posterior(votes)
        for k in range(rounds):
            right = up.T @ p + down.T @ (1 - p)
            self.accuracy = np.clip((right / cast + self.trust * self.start) / (1 + self.trust), 0.55, 0.995)  # above chance
            if k % 5 == 0:
                self._correlate(np.abs(votes).astype(np.float64), p)
            old, p = p, self.posterior(votes)
            if k > 10 and np.abs(p - old).max() < 1e-4:
                break
        return self

    def _correlate(self, fired: np.ndarray, p: np.ndarray) -> None:
        """Correlations of firing beyond the classes; k fully dependent voters count 1/k each."""
        rate = np.stack([(1 - p) @ fired / max((1 - p).sum(), 1.0), p @ fired / max(p.sum(), 1.0)])
        left = fired - np.outer(1 - p, rate[0]) - np.outer(p, rate[1])
        cov = left.T @ left / len(left)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        rho = np.clip(cov / sd[:, None] / sd[None, :], 0.0, 1.0)
        np.fill_diagonal(rho, 0.0)
        self.correlation = rho
        self.weight = 1.0 / (1.0 + np.where(rho > 0.5, rho, 0.0).sum(axis=1))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        z = math.log(self.prior / (1 - self.prior)) + votes @ (self.weight * np.log(self.accuracy / (1 - self.accuracy)))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(rows: list[np.ndarray], target: np.ndarray, width: int, ridge: float = 0.3, rounds: int = 300) -> np.ndarray:
    """Weights and bias (last) of a logistic regression on soft targets, by accelerated gradient steps."""
    at = np.concatenate([np.full(len(r), i) for i, r in enumerate(rows)]) if rows else np.zeros(0, np.int64)
    col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    at, col = at.astype(np.int64), col.astype(np.int64)
    n = len(rows)
    w, v = np.zeros(width + 1), np.zeros(width + 1)
    # step from a bound of the curvature: a quarter of the largest squared row norm times the column load
    step = 4.0 / (max((len(r) for r in rows), default=1) + 1.0)
    scale = np.bincount(col, minlength=width + 1)[:width + 1] / max(n, 1)
    scale[-1] = 1.0
    step = step / np.sqrt(np.maximum(scale, 1.0 / max(n, 1)))
    for k in range(rounds):
        z = np.bincount(at, weights=v[col], minlength=n) + v[-1]
        e = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        g = np.append(np.bincount(col, weights=e[at], minlength=width)[:width], e.sum()) / max(n, 1)
        g[:-1] += ridge / max(n, 1) * v[:-1]
        new = v - step * g
        v = new + (k / (k + 3)) * (new - w)
        w = new
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        hits = self.lexicon.look(text).entries
        z = self.bias + (float(self.weights[list(hits)].sum()) if hits else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def vote_matrix(looks: list[Votes], voters: list[int]) -> np.ndarray:
    """Lexicon voters, then toxic votes for two entries, a disguised and a shouted one, a clean vote for none."""
    place = {e: k for k, e in enumerate(voters)}
    out = np.zeros((len(looks), len(voters) + 4), np.int8)
    for i, v in enumerate(looks):
        on = [place[e] for e in v.entries if e in place]
        out[i, on] = 1
        out[i, len(voters):] = len(on) >= 2, v.disguised, v.shouted, -1 if not on else 0
    return out


def fit(sample: list[tuple[str, int]]) -> tuple[Model, LabelModel | None]:
    """The classifier and its label model from training (text, label) pairs.

    The labels choose the lexicon's entries; what the voters are worth, and the labels the classifier
    learns, come from the label model.  Without rows of both classes every score is the class share."""
    ys = [y for _, y in sample]
    if len(set(ys)) < 2:
        share = (sum(ys) + 0.5) / (len(ys) + 2)
        return Model(Lexicon({}), np.zeros(0), math.log(share / (1 - share))), None
    ranked = build_lexicon(sample)
    lexicon = Lexicon({e: k for k, (e, _) in enumerate(ranked)})
    looks = [lexicon.look(t) for t, _ in sample]
    where: dict[int, set[int]] = {}
    for i, v in enumerate(looks):
        for e in v.entries:
            where.setdefault(e, set()).add(i)
    voters: list[int] = []
    for e in range(len(ranked)):  # an entry that fires where a stronger one does is no voter of its own
        if len(voters) == MAX_VOTERS:
            break
        own = where.get(e, set())
        if own and not any(len(own & where[v]) > 0.95 * len(own | where[v]) for v in voters):
            voters.append(e)
    fired = vote_matrix(looks, voters)
    labeller = LabelModel().fit(fired)
    target = labeller.posterior(fired)
    rows = [np.array(sorted(v.entries), np.int64) for v in looks]
    w = _logistic(rows, target, len(ranked))
    lexicon.cache.clear()  # the words looked up here do not travel with the model
    return Model(lexicon, w[:-1], float(w[-1])), labeller


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return fit(labelled_sample(docs, labels, "toxic", per_class))[0]


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Every row with its score: doc_id, held_out, score, predicted, and the columns named in ``keep``.

    Null texts count as empty and get a score too; equal texts get equal scores; null ids stay null and
    are not held out; columns that clash with the result's are passed on only when kept.  No shuffle."""
    keep = keep or []
    at = keep.index("text") + 1 if "text" in keep else None  # a kept text travels once
    src = docs.select(F.col("doc_id").cast("bigint").alias("_id"), *(F.col(c).alias(f"k_{c}") for c in keep),
                      *([] if at else [F.col("text").alias("_t")]))
    fields = [f"`k_{c}` {src.schema[f'k_{c}'].dataType.simpleString()}" for c in keep]
    schema = ", ".join(["doc_id bigint", "held_out boolean", "score double", "predicted int", *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_other_caches("scores")
        for batch in small_batches(batches):
            score = [model.score(t or "") for t in batch.column(at or len(keep) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([is_held_out(i) for i in batch.column(0).to_pylist()], pa.bool_()),
                 pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()),
                 *(batch.column(1 + k) for k in range(len(keep)))],
                names=["doc_id", "held_out", "score", "predicted", *(f"k_{c}" for c in keep)])

    return src.mapInArrow(run, schema)
