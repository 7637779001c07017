"""Quality classifier: Naive Bayes support vectors over n-gram indicators.

Indicators of a text: the 1- to 3-grams of its token shapes (letter case, digits and marks with runs
collapsed, and whether a token repeats the one before), each the 1- and 2-grams with every power of two of the
share of the text they make up, and its word 1- and 2-grams.  Every indicator is scaled by its class log-count ratio;
a linear model with hinge loss is then fitted by dual coordinate descent, blended with its mean
magnitude as Naive Bayes support vectors prescribe, and its margin is turned into a probability on
training rows that the fit has not seen.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stanceframe.llm.common import free_other_caches, is_held_out, labelled_sample, small_batches

PER_CLASS = 2000  # labelled rows of each class that may reach the driver
MAX_FEATURES = 60_000
MIN_DOCS = 8  # an indicator needs this many training texts


class _Shape(dict):
    """Character -> its class, filled as characters come."""

    def __missing__(self, c: int) -> str:
        ch = chr(c)
        if ch.isspace():
            v = " "
        elif ch.isalpha():
            v = "X" if ch.isupper() else "x"
        elif ch.isdigit():
            v = "9"
        else:
            v = ch
        self[c] = v
        return v


_SHAPE = _Shape()
_RUN = re.compile(r"([^ ])\1+")


def indicators(text: str) -> set:
    """The indicators of a text; an empty text has the single indicator of emptiness."""
    words = text.split()
    n = len(words)
    if not n:
        return {("empty",)}  # no word is a tuple
    shapes = _RUN.sub(r"\1", text.translate(_SHAPE)).split()
    if len(shapes) != n:  # a character that splits words in one form only
        shapes = [_RUN.sub(r"\1", w.translate(_SHAPE)).strip() for w in words]
    same = [w if w != v else "=" for w, v in zip(shapes, [None, *words[:-1]], strict=True)]
    repeated = ["=" if a == b else s for a, b, s in zip(words[1:], words, same[1:], strict=False)]
    shapes = [same[0], *repeated]
    out = {("n", min(int(math.log2(n)), 14))}
    for size, grams in ((1, shapes), (2, list(zip(shapes, shapes[1:], strict=False))),
                        (3, list(zip(shapes, shapes[1:], shapes[2:], strict=False)))):
        for g, c in Counter(grams).items():
            out.add((size, g))
            # the share of the text: at least 1/2, 1/4 ... 1/64
            if size < 3 and c * 64 >= len(grams):
                out.update((size, g, k) for k in range(int(-math.log2(c / len(grams))), 6))
    low = [w.strip(".,;:!?") for w in text.lower().split()]
    out.update(low)
    out.update(map(" ".join, zip(low, low[1:], strict=False)))
    return out


@dataclass
class Model:
    weights: dict  # indicator -> weight, already scaled by its log-count ratio
    bias: float
    slope: float
    offset: float

    def score(self, text: str) -> float:
        get = self.weights.get
        margin = self.bias + sum(get(f, 0.0) for f in indicators(text))
        z = max(-30.0, min(30.0, self.slope * margin + self.offset))
        return 1.0 / (1.0 + math.exp(-z))


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, sweeps: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the linear hinge-loss model over the scaled indicators, with bias."""
    w, bias = np.zeros(len(ratio)), 0.0
    alpha = np.zeros(len(rows))
    # rarer classes weigh more, so that both add up to the same
    upper = cost * np.where(y > 0, 0.5 / max((y > 0).mean(), 1e-9), 0.5 / max((y < 0).mean(), 1e-9))
    scaled = [ratio[r] for r in rows]
    q = np.array([v @ v + 1.0 for v in scaled])
    rng = np.random.default_rng(7)
    for _ in range(sweeps):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], scaled[i]
            g = y[i] * (w[r] @ v + bias) - 1.0
            a = alpha[i]
            step = min(max(a - g / q[i], 0.0), upper[i]) - a
            if step:
                alpha[i] = a + step
                w[r] += step * y[i] * v
                bias += step * y[i]
                worst = max(worst, abs(step) * q[i])
        if worst < 1e-3:
            break
    return w, bias


def _smallest_digests(sample: list[tuple[str, int]], hashes: np.ndarray, n: int) -> np.ndarray:
    """The n of these sorted hashes whose indicators have the smallest digests: Python's hash differs between
    processes, the digest does not."""
    digest = np.zeros(len(hashes), np.uint64)
    known = np.zeros(len(hashes), bool)
    for t, _ in sample:
        own = list(indicators(t))
        h = np.fromiter(map(hash, own), np.int64, len(own))
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        for i in np.flatnonzero((hashes[at] == h) & ~known[at]).tolist():
            digest[at[i]] = int.from_bytes(hashlib.blake2b(repr(own[i]).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
            known[at[i]] = True
    return hashes[np.argsort(digest, kind="stable")[:n]]


def fit(sample: list[tuple[str, int]], cost: float = 0.02, sweeps: int = 12, blend: float = 0.9) -> Model:
    """Fit on (text, label) pairs.  Without rows of both classes the score is the class share."""
    ys = [y for _, y in sample]
    if len(set(ys)) < 2:
        share = (sum(ys) + 1) / (len(ys) + 2)
        return Model({}, 0.0, 0.0, math.log(share / (1 - share)))
    # counted as numbers first: the indicators of all texts never stand in memory at once
    seen, count = np.unique(np.concatenate([np.fromiter(map(hash, indicators(t)), np.int64) for t, _ in sample]), return_counts=True)
    common = count >= min(MIN_DOCS, max(1, len(sample) // 8))
    seen, count = seen[common], count[common]
    if len(seen) > MAX_FEATURES:
        least = np.partition(count, len(count) - MAX_FEATURES)[len(count) - MAX_FEATURES]
        tied = seen[count == least]
        seen = seen[count > least]
        seen = np.concatenate([seen, _smallest_digests(sample, tied, MAX_FEATURES - len(seen))])
    picked = seen.tolist()
    del seen, count
    names = dict.fromkeys(picked)
    hashed = []
    for t, _ in sample:
        own = {hash(f): f for f in indicators(t)}
        own = {h: f for h, f in own.items() if h in names}
        names.update(own)
        hashed.append(np.fromiter(own, np.int64))
    vocab = {f: k for k, f in enumerate(sorted(names.values(), key=repr))}  # the same order on every run
    number = {h: vocab[f] for h, f in names.items()}
    rows = [np.array(sorted(number[h] for h in r.tolist()), np.int64) for r in hashed]
    y = np.array([1.0 if v else -1.0 for v in ys])
    count = {s: np.full(len(vocab), 1.0) for s in (1.0, -1.0)}
    for r, v in zip(rows, y, strict=True):
        count[v][r] += 1.0
    ratio = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
    order = np.arange(len(rows))
    checks = order % 5 == 4  # rows for the probability only
    if len(set(y[checks])) < 2 or len(set(y[~checks])) < 2:
        checks = np.zeros(len(rows), bool)
    train = order[~checks]
    w, bias = _descend([rows[i] for i in train], y[train], ratio, cost, sweeps)
    w = blend * w + (1 - blend) * np.abs(w).mean()
    final = w * ratio
    on = order[checks] if checks.any() else order
    margin = np.array([final[rows[i]].sum() + bias for i in on])
    slope, offset = _sigmoid_fit(margin, y[on] > 0)
    return Model({f: float(final[k]) for f, k in vocab.items() if abs(final[k]) > 1e-9}, float(bias), slope, offset)


def _sigmoid_fit(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of a margin, by Newton steps on smoothed targets."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(np.abs(margin).mean(), 1e-9)
    x = np.stack([margin / scale, np.ones_like(margin)], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * b)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 1e-6) / scale), float(b[1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return fit(labelled_sample(docs, labels, "quality", per_class))


def score_documents(docs: DataFrame, model: Model, threshold: float, keep: list[str] | None = None) -> DataFrame:
    """Every row with its score: doc_id, held_out, score, predicted, and the columns named in ``keep``.

    Null texts count as empty and get a score too; rows with equal texts get equal scores; null ids stay
    null and are not held out; columns that clash with the result's are read but not passed on unless
    kept.  No shuffle: the model is a bounded dictionary that travels with the tasks."""
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
