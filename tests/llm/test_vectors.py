"""Lattice near-dedup and one-bit search against brute force."""

import inspect

import numpy as np
from pyspark.sql import functions as F

from stanceframe.llm import lattice_dedup as L
from stanceframe.llm import onebit_search as O

SCHEMA = "vec_id bigint, embedding array<float>, label int, v int, node bigint, cell bigint"


def _rows(seed=0, n=260, dim=32):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(60, 140):  # near copies of a few, up to scale
        x[i] = (x[i % 7] + 0.25 * rng.standard_normal(dim) * (0.2 + i % 5)) * (1 + i % 3)
    x[140:180] = x[3]  # one vector on many rows
    ids = rng.permutation(10_000)[:n]
    vecs = [[float(v) for v in np.float32(r)] for r in x]
    for k, bad in ((5, None), (6, [0.0] * dim), (8, [float("nan")] * dim), (9, [float("inf")] + [1.0] * (dim - 1)), (10, []), (11, [1.0] * 5)):
        vecs[200 + k] = bad
    vecs[220] = [None] + [1.0] * (dim - 1)
    return [(int(i), v, 1, 2, 3, 4) for i, v in zip(ids, vecs, strict=True)]


def _usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_e8_decoding_is_nearest():
    x = np.random.default_rng(0).standard_normal((500, 8)) * 1.3
    p = L.nearest_e8(x)
    roots = L.minimal_vectors()
    assert len(roots) == 240 and np.allclose((roots**2).sum(axis=1), 2)
    assert ((((x - p) ** 2).sum(axis=1) - ((x[:, None] - p[:, None] - roots) ** 2).sum(axis=2).min(axis=1)) < 1e-9).all()


def test_near_duplicates_equal_brute_force(spark):
    rows = _rows()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in
           L.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), 0.9).collect()}
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v, *_ in rows if _usable(v)}
    links = {i: {j for j in ok if j != i and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= 0.9} if i in ok else set() for i, *_ in rows}
    comp = {i: i for i in links}
    for _ in links:
        comp = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in links}
    found, want = sum(g[0] for g in got.values()), sum(map(len, links.values()))
    assert want > 1000 and found >= 0.99 * want and all(got[i][0] <= len(links[i]) for i in links)
    assert sum(got[i][1] == comp[i] for i in links) >= 0.99 * len(links)
    assert all(g[2] == (i == g[1]) for i, g in got.items()) and len(got) == len(rows)
    assert L.near_duplicates(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_search_recall_and_ties(spark):
    rows = _rows(1)
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {}
    for r in O.search(table, F.col("vec_id") % 4 == 0, k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ok = {i: np.array(v) for i, v, *_ in rows if _usable(v)}
    hits = total = 0
    for q in (i for i in ok if i % 4 == 0):
        want = sorted(((-float((ok[q] * ok[j]).sum()), j) for j in ok if j != q and len(ok[j]) == len(ok[q])))[:20]
        assert len(got.get(q, [])) == len(want) and [s for _, s in got.get(q, [])] == sorted((s for _, s in got.get(q, [])), reverse=True)
        hits += len({j for _, j in want} & {j for j, _ in got.get(q, [])})
        total += len(want)
        assert all(abs(s - (ok[q] * ok[j]).sum()) < 1e-9 for j, s in got.get(q, []))
    assert total > 500 and hits >= 0.98 * total and set(got) <= {i for i in ok if i % 4 == 0}
    few = O.search(table.where("embedding is not null").limit(6), F.lit(True), k=20)
    assert few.count() >= 0 and O.search(table.limit(0), F.lit(True)).count() == 0


def test_bits_leave_most_vectors_uncompared():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 64))
    bits, length, cos = O.codes(x, np.zeros(64))
    out = list(O.best_of_block(np.arange(40), x[:40], np.arange(4000), x, bits, length, cos, np.zeros(64), 20, O.BOUND))
    exact = [set(np.argsort(-np.where(np.arange(4000) == q, -np.inf, x @ x[q]))[:20]) for q in range(40)]
    assert np.mean([len(exact[q] & set(ids)) for q, ids, _, _ in out]) >= 19.8
    assert np.mean([c for *_, c in out]) < 2400  # of 4000 vectors without any structure


def test_search_bound_misses_no_neighbour_where_a_narrow_one_does():
    n, x = 4000, np.random.default_rng(3).standard_normal((4000, 64))
    bits, length, cos = O.codes(x, np.zeros(64))
    exact = [set(np.argsort(-np.where(np.arange(n) == q, -np.inf, x @ x[q]))[:20]) for q in range(400)]

    def missed(bound):
        return sum(len(exact[q] - set(ids)) for q, ids, _, _ in O.best_of_block(
            np.arange(400), x[:400], np.arange(n), x, bits, length, cos, np.zeros(64), 20, bound))
    assert missed(1.9) > 0 == missed(inspect.signature(O.search).parameters["bound"].default)
