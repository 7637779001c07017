"""N-gram Jaccard join and connected components against brute force."""

import random
import re

import numpy as np
import pytest

from stanceframe.llm import ngram_join as J
from stanceframe.llm import shingles as H
from stanceframe.llm.components import connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(t):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets, up = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def test_sets_and_digests_match_python():
    rng = random.Random(3)
    texts = ["", " \n", "K k"] + [" ".join(rng.choice(["a", "B", "b", "é", "x\xa0y", "日"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    d, h = H.shingle_sets(texts)
    sets = [shingle_set(t) for t in texts]
    size, digest = H.set_digests(d, h, len(texts))
    assert size.tolist() == [len(s) for s in sets]
    own = [set(h[d == i].tolist()) for i in range(len(texts))]
    for i in range(len(texts)):
        for j in range(i):
            assert len(own[i] & own[j]) == len(sets[i] & sets[j])
            assert not sets[i] or not sets[j] or (digest[i] == digest[j]) == (sets[i] == sets[j])


def test_combinations_meet_whenever_sets_are_similar():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(4, 300))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        drop = int(rng.integers(0, max(1, n // 9) + 1))
        b = np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 9))), dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 80 * (len(a) + len(b) - both):
            x, y = (set(J.combination_keys(np.sort(s), len(s), 0, 80)) for s in (a, b))
            assert x & y, (n, len(b), both)


@pytest.mark.parametrize("seed", [0, 1])
def test_components_equal_brute_force(docs, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 6, 12, 40, 80, 200]))] for _ in range(20)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = [(5000, ""), (5001, None), (5002, " \n"), (5003, "a b"), (5004, "A  b"), (5005, "a b c d"), (5006, "a b c d e"), (5007, "A B c d e"),
            (5008, "long " * 30_000)]
    for i in range(260):
        b = list(base[0] if rng.random() < 0.5 else rng.choice(base[:3] if seed else base))
        for _ in range(rng.randint(0, 4)):
            b[rng.randrange(len(b))] = rng.choice(vocab)
        b += passage if rng.random() < 0.3 else []
        rows.append((i * 3 + 1, " ".join(b)))
    assert sorted(map(tuple, J.jaccard_components(docs(rows)).collect())) == brute(rows)


def _inside(n, m, tag):
    """A text of n shingles, all held by a second one of m."""
    words = [f"{tag}{k}" for k in range(m + 4)]
    return " ".join(words[:n + 4]), " ".join(words)


@pytest.mark.parametrize("range_bytes", [J.RANGE_BYTES, 200_000])
def test_very_long_texts_link_at_exactly_the_limit(docs, monkeypatch, range_bytes):
    """400,000 shingles inside 500,000: the index knows tokens by 32 bits and their range, of which some agree."""
    monkeypatch.setattr(J, "RANGE_BYTES", range_bytes)  # one range of tokens, and several dozen
    a, b = _inside(400_000, 500_000, "x")
    c, d = _inside(399_999, 500_000, "y")
    rows = [(1, a), (2, b), (3, c), (4, d), (5, a), (6, "short text of its own here")]
    got = sorted(map(tuple, J.jaccard_components(docs(rows, 2)).collect()))
    assert got == [(1, 400_000, 1), (2, 500_000, 1), (3, 399_999, 3), (4, 500_000, 4), (5, 400_000, 1), (6, 2, 6)]


def test_words_that_agree_in_a_polynomial_hash_are_told_apart(docs):
    """A Thue-Morse word of 1024 letters and its complement agree in any polynomial hash modulo a power of two."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{word} one two three four"), (2, f"{other} one two three four"), (3, f"{word} one two three FOUR")]
    assert sorted(map(tuple, J.jaccard_components(docs(rows)).collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_odd_rows_and_filter(docs):
    t = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [(7, t), (7, t), (3, t + " more"), (None, t), (9, None), (9, ""), (11, "alone")]
    got = sorted(map(tuple, J.jaccard_components(docs(rows)).collect()), key=repr)
    assert got == sorted([(7, 16, 3), (7, 16, 3), (3, 17, 3), (None, 16, 3), (9, 0, 9), (9, 0, 9), (11, 1, 11)], key=repr)
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in J.drop_near_duplicates(docs(rows)).collect())
    assert kept == [(-1, t), (3, t + " more"), (9, ""), (9, ""), (11, "alone")]
    assert J.jaccard_components(docs(rows).limit(0)).count() == 0


def test_filter_decides_per_row_of_a_repeated_id(docs):
    t, u, w = (" ".join(f"{c}{i}" for i in range(20)) for c in "tuw")
    rows = [(3, t), (7, t + " more"), (7, u), (7, u), (9, u), (5, w), (5, t), (None, u)]
    kept = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"]) for r in J.drop_near_duplicates(docs(rows)).collect())
    assert kept == [(-1, u), (3, t), (5, w), (7, u)]


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(50)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(150)] + [(7, 7)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in up}


def test_packed_numbers_come_back():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 7, 1000):
        x = np.sort(rng.integers(0, 2**32, n, dtype=np.uint32))
        x[n // 2:] = x[n // 2] if n > 2 else x[n // 2:]  # equal ones stay
        assert J.unpack_ascending(*J.pack_ascending(x), n).tolist() == x.tolist()
        for width in (1, 5, 11):
            y = rng.integers(0, 1 << width, n, dtype=np.uint32)
            raw = J.pack_fixed(y, width)
            assert len(raw) == -(-n * width // 8) and J.unpack_fixed(raw, width, n).tolist() == y.tolist()
    edge = np.array([0, 0, 2**32 - 1, 2**32 - 1], np.uint32)
    assert J.unpack_ascending(*J.pack_ascending(edge), 4).tolist() == edge.tolist()


def test_token_rows_are_small_and_hold_each_size_once(docs):
    """500 texts of some 300 shingles in 64 ranges: 8 bytes of tokens and sets a token before they were packed."""
    rng = random.Random(8)
    rows = [(i, " ".join(str(rng.randrange(10**9)) for _ in range(304))) for i in range(500)]
    got = J._token_rows(docs(rows, 1), 6).collect()
    tokens = sum(r["count"] for r in got)
    assert tokens == 500 * 300
    assert sum(len(r["low"]) + len(r["high"]) + len(r["entry"]) for r in got) < 5 * tokens
    sizes = [x for r in got for x in np.frombuffer(r["sizes"], "<u4").tolist() if x]
    assert sizes == [300] * 500
