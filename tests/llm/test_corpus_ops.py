"""Whitening, collocations and Merkle fingerprints against brute force on small tables."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from stanceframe.llm import collocations, merkle, whitening

# --- op11: whitening -------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>, label int, x string, d double, copies int"


def _vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "x", 0.5, 3) for i, v in rows], VECTORS).repartition(parts)


def _brute(rows, weights):
    """Exact sums and covariance by fractions, for vectors of one length."""
    x = [tuple(math.floor(64 * c) + 1000000 for c in v) for _, v in rows]
    fit_list = x if weights == "counts" else sorted(set(x))
    n, d = len(fit_list), len(x[0])
    sums = [sum(r[j] for r in fit_list) for j in range(d)]
    cov = np.array([[float(Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in fit_list), n**3)) for j in range(d)] for i in range(d)])
    return x, n, sums, cov


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening_equals_exact_covariance(spark, weights):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 6)) * [1, 2, 3, 4, 5, 6]
    rows = [(i, base[i % 150].tolist()) for i in range(180)] + [(1000 + i, base[0].tolist()) for i in range(300)]  # one hot vector
    rows += [(7, base[3].tolist()), (None, base[4].tolist())]
    bad = [(900, None), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5), (904, [])]
    x, n, sums, cov = _brute(rows, weights)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    got = whitening.whiten(_vectors(spark, rows + bad), components=4, weights=weights).collect()
    assert len(got) == 4 * len(rows) and got[0].__fields__ == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert {r["n"] for r in got} == {n} and len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    deviation = Counter((i, sum((n * a - s) ** 2 for a, s in zip(v, sums))) for (i, _), v in zip(rows, x))
    assert Counter((r["vec_id"], r["deviation"]) for r in got if r["component"] == 2) == deviation
    for k in range(4):
        of = [r for r in got if r["component"] == k + 1]
        assert abs(of[0]["explained"] - values[k] / np.trace(cov)) < 1e-12 and len({r["explained"] for r in of}) == 1
        centred = {i: np.array([float(Fraction(n * a - s, n)) for a, s in zip(v, sums)]) for (i, _), v in zip(rows, x)}
        _, vectors = np.linalg.eigh(cov)
        want = {i: float(c @ vectors[:, 5 - k]) / math.sqrt(values[k]) for i, c in centred.items()}
        sign = 1 if sum(want[r["vec_id"]] * r["whitened"] for r in of) > 0 else -1
        assert max(abs(sign * want[r["vec_id"]] - r["whitened"]) for r in of if r["vec_id"] != 7) < 1e-9


def test_whitening_of_odd_tables(spark):
    assert whitening.whiten(_vectors(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(_vectors(spark, [(1, [1.0])]).limit(0)).collect() == []
    same = whitening.whiten(_vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.001, 2.0])])).collect()  # equal x
    assert len(same) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(3, 0, None, 0.0, None)}
    # a constant entry: one component without variance; lengths fit by themselves; entries as large as a long takes
    mixed = whitening.whiten(_vectors(spark, [(1, [1.0, 5.0]), (2, [2.0, 5.0]), (3, [1.0]), (4, [3.0]), (5, [5.0]), (6, [1e300]), (7, [2.0**54, 0.0, 0.0]), (8, [-(2.0**54), 0.0, 0.0])])).collect()
    rows = {(r["vec_id"], r["component"]): r for r in mixed}
    assert set(rows) == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1), (5, 1), *((i, k) for i in (7, 8) for k in (1, 2, 3))}
    assert rows[1, 2]["whitened"] is None and abs(abs(rows[1, 1]["whitened"]) - 1) < 1e-12 and rows[3, 1]["n"] == 3
    assert rows[7, 1]["deviation"] is None and abs(abs(rows[7, 1]["whitened"]) - 1) < 1e-12
    assert rows[3, 1]["deviation"] == (3 * 64 - 576) ** 2
    with pytest.raises(ValueError):
        whitening.whiten(_vectors(spark, [(1, [1.0])]), weights="rows")


# --- op12: collocations ----------------------------------------------------------

def _mined(rows, plan):
    """Plain counting: what ``mine`` must give, by Python's whole numbers."""
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = [w for w in re.split("[ \t]", piece) if w]
            total[lang] += len(ws)
            for n in range(1, plan.words + 1):
                counts.update((lang, tuple(ws[i:i + n])) for i in range(len(ws) - n + 1))
    cands = {k: a for k, a in counts.items() if len(k[1]) >= 2 and a >= plan.least}
    out = []
    for (lang, ws), a in cands.items():
        inside = any(lg == lang and len(o) > len(ws) and any(o[i:i + len(ws)] == ws for i in range(len(o))) and 100 * b >= plan.absorb * a
                     for (lg, o), b in cands.items())
        if not inside:
            cuts = [(1000 * a * total[lang] // (counts[lang, ws[:k]] * counts[lang, ws[k:]]), k) for k in range(1, len(ws))]
            s, k = min(cuts)
            out.append((lang, s, a, " ".join(ws), counts[lang, ws[:k]], counts[lang, ws[k:]], total[lang]))
    best = []
    for lang in {o[0] for o in out}:
        ranked = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[1], -o[2], o[3].encode()))
        best += [(lang, r + 1, o[3], o[2], o[4], o[5], o[6], o[1]) for r, o in enumerate(ranked[:plan.top])]
    return sorted(best)


def _texts(seed, n=400):
    rng = random.Random(seed)
    vocab = ["a", "b", "c", "É", "Ab", "x-y", "日本", "the", "of"]
    rows = [(" ".join(rng.choice(vocab) + rng.choice(["", "", "", ",", "\t", "\n", ". "]) for _ in range(rng.randint(0, 30))), rng.choice(["en", "en", "en", "de", None]))
            for _ in range(n)]
    return rows + [("in spite of the", "en")] * 30 + [(None, "en"), ("", "fr"), (" ,.\n", "fr"), ("once only", "fr"), ("A a " * 5000, "en")]


@pytest.mark.parametrize("plan", [collocations.Plan(least=5, top=60), collocations.Plan(least=3, words=3, top=10, absorb=70), collocations.Plan(least=1, words=5, top=5000)])
def test_collocations_equal_plain_counting(docs, plan, monkeypatch):
    rows = _texts(3, 400 if plan.least > 1 else 60)
    d = docs([(i % 50, t, lg, "s") for i, (t, lg) in enumerate(rows)], 5)
    got = sorted(tuple(r) for r in collocations.mine(d, plan).collect())
    assert got == _mined(rows, plan)
    con = duckdb.connect()
    con.register("documents", d.select("text", "lang").toPandas())
    assert sorted(con.execute(collocations.mine_sql(plan)).fetchall()) == got


def test_collocations_of_nothing(docs):
    assert collocations.mine(docs([(1, "a b")]).limit(0)).count() == 0
    assert collocations.mine(docs([(1, None), (2, "")])).count() == 0


def test_summary_keeps_what_is_frequent_beyond_its_capacity():
    rng = np.random.default_rng(1)
    stream = np.concatenate([rng.integers(1000, 10**6, 60_000), np.repeat(np.arange(40), 130)]).astype(np.uint64)
    rng.shuffle(stream)
    least = 100
    s = collocations.Summary(len(stream) // least + 1)
    for part in np.array_split(stream, 37):
        s.merge(*np.unique(part, return_counts=True))
        s.settle()
    assert len(s.hashes) <= s.capacity and 0 < s.off < least
    assert set(range(40)) <= set(s.survivors(least).tolist())


def test_shares_of_a_task_are_sent_whole_however_small_the_buffer(docs, monkeypatch):
    rows = _texts(9, 200)
    batch = docs([(i, t, lg, "s") for i, (t, lg) in enumerate(rows)], 1).select("text", "lang").toArrow().to_batches()

    def sums(flush, block, row):
        monkeypatch.setattr(collocations, "FLUSH", flush)
        monkeypatch.setattr(collocations, "BLOCK_CHARS", block)
        monkeypatch.setattr(collocations, "ROW", row)
        total = Counter()
        for out in collocations._send(0, [], 6, 5)(iter(batch)):
            for p, mass, h, c in zip(*(col.to_pylist() for col in out.columns)):
                h, c = np.frombuffer(h, "<u8"), np.frombuffer(c, "<u4")
                assert mass == c.sum() and set((h >> np.uint64(58)).tolist()) == {p} and len(h) <= row
                total.update(dict(zip(h.tolist(), c.tolist())))
        return total
    assert sums(1 << 21, 4_000_000, 2048) == sums(50, 300, 7)


# --- op13: Merkle fingerprints ---------------------------------------------------

TEXTS = ["", "x", "ab\ncd", "One sentence. Another one, longer than the first. " * 9, "para\n" * 30, "\n\n\n", "日本語 text 😀 " * 20, "a" * 700,
         "Section one. First line of it.\n\nSection two. It has lines.\nMore lines.\n\nThree."]


def _edited(rows):
    def key(r):
        return (r[0] is None, -(r[0] or 0), hashlib.sha256((r[1] or "").encode()).hexdigest())
    ordered = sorted(rows, key=key)
    out = []
    for k, (i, t) in enumerate(ordered):
        t, nxt = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(t) // 3
        out.append((i, len(t), hashlib.sha256((t[:len(t) - cut] + nxt[:cut]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_fingerprints_of_documents_and_edited_texts(docs):
    rng = random.Random(4)
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(40)] + [(100 + i, " ".join(rng.choice(["ab", "cde.", "f\n"]) for _ in range(rng.randint(0, 200)))) for i in range(40)]
    rows += [(3, "same id, other text"), (3, "x"), (3, "x"), (3, "x"), (None, "no id"), (None, None), (200, None), (5000, "long words and lines.\n" * 4000)]
    d = docs(rows)
    got = merkle.edited_likeness(d)
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got.collect()), key=repr) == _edited(rows)
    con = duckdb.connect()
    con.register("documents", d.select("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("string")).toPandas())
    sql = merkle.edited_likeness_sql().replace("SELECT doc_id, coalesce(text", "SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text", 1)
    want = sorted((tuple(r) for r in con.execute(sql).fetchall()), key=repr)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()), key=repr) == want
    assert all(0 <= r[5] <= 1 and 0 <= r[6] <= 1 for r in want)
    # an edit of the last third leaves the first two thirds' branches alone
    assert all(r[5] >= 0.3 for r in want if r[1] >= 12)


def test_equal_texts_have_equal_fingerprints_and_others_not(docs):
    rows = [(i, t) for i, t in enumerate(TEXTS + TEXTS)] + [(50 + i, t + " ") for i, t in enumerate(TEXTS)] + [(90, None)]
    got = {r["doc_id"]: r["fingerprint"] for r in merkle.fingerprints(docs(rows)).collect()}
    text = {i: t or "" for i, t in rows}
    for a in got:
        for b in got:
            assert (got[a] == got[b]) == (text[a] == text[b])


def test_one_document_and_no_document(docs):
    one = merkle.edited_likeness(docs([(1, "abcdef")])).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest() and one[0]["near_next"] == 1.0
    assert merkle.edited_likeness(docs([(1, "x")]).limit(0)).count() == 0


def test_differing_branches_locate_edits(spark):
    lines = [f"Line {i} stands here as a paragraph of its own." for i in range(60)]
    other = lines[:20] + ["An inserted line."] + lines[20:40] + ["Line 40 reads otherwise."] + lines[41:]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other)), ("same", "same"), (None, "")], "a string, b string")
    got = [[(e["paragraph"], e["side"]) for e in r["e"]] for r in df.select(merkle.edits(F.col("a"), F.col("b")).alias("e")).collect()]
    assert got == [[(40, "before"), (20, "after"), (41, "after")], [], []]
