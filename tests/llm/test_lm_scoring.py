import math
import zlib
from collections import Counter

import numpy as np
import pytest

from terravane.llm import lm_scoring as lm

ROWS = [(i, t) for i, t in enumerate(["the cat sat on the mat", "The CAT sat", None, "", "  \n\t ", "a b c d e f g " * 50, "the cat sat on the mat", "é É ünï", "x" * 5000, "the the the the"] * 3)]


def brute(rows, mu):
    toks = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    uni, bi, starts = Counter(), Counter(), 0
    for i, t in rows:
        if not held(i):
            w = toks(t)
            starts += 1
            uni.update(w)
            bi.update(zip([0, *w], w))
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, t in rows:
        w = toks(t)
        p1 = [(uni[x] + 1) / (n + v + 1) for x in w]
        context = [starts, *(uni[x] for x in w[:-1])]
        score = sum(math.log10((bi[a, b] + mu * p) / (c + mu)) for a, b, p, c in zip([0, *w], w, p1, context))
        out.append((i, held(i), len(w), sum(uni[x] > 0 for x in w), n, sum(map(math.log10, p1)), score))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[6]))


@pytest.mark.parametrize("rows", [ROWS, [*ROWS, (None, "the cat"), (4, "the cat"), (4, "the cat")], [(i, "all held") for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2][:3]])
def test_against_brute_force(spark, rows):
    got = order(map(tuple, lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    want = order(brute(rows, lm.MU))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-9 and abs(g[6] - w[6]) < 1e-9


def test_weights_of_a_state_sum_to_one():
    texts = ["a b a c", "a b b"]
    b = lm.Block(texts, np.array([True, True]), lm.WordHash())
    total, types = 9, 4
    for state in ("a", "b", "c"):
        mass = 0.0
        for w in ("a", "b", "c", None, "unseen"):
            uni = {"a": 3, "b": 3, "c": 1, None: 2, "unseen": 0}
            pairs = Counter(zip(["a", "b", "a", "c", "a", "b", "b"], ["b", "a", "c", None, "b", "b", None]))
            mass += (pairs[state, w] + lm.MU * (uni[w] + 1) / (total + types + 1)) / (uni[state] + lm.MU)
        assert abs(mass - 1) < 1e-12
    assert b.counts().sum() == 2 * 9 + 2


def test_keys_round_trip():
    k = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (lm.unpack_keys(lm.pack_keys(k)) == k).all() and len(lm.unpack_keys(b"")) == 0


def test_empty_table_and_clashing_columns(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert lm.score_documents(spark.createDataFrame([(1, "a", 3)], "doc_id long, text string, score int")).count() == 1


def automaton(texts):
    b = lm.Block(texts, np.ones(len(texts), dtype=bool), lm.WordHash())
    tokens = [x for t in texts for x in [*t.split(), None]]
    return b, lm.BackoffAutomaton(b, b.counts(), len(tokens), len(set(tokens)))


def test_arcs_and_failure_of_every_state_have_mass_one():
    texts = ["a b a c", "a b b", "c", ""]
    b, m = automaton(texts)
    n, v = 12, 4
    symbols = range(len(m.root_weight))
    start = m.start - 1
    for state in range(len(m.fail_weight)):
        mass = sum(10 ** m.step(state, s)[1] for s in symbols if s != start) + 10 ** (m.fail_weight[state]) / (n + v + 1)
        has_arcs = m.arcs_from[state + 1] > m.arcs_from[state] if state else True
        assert not has_arcs or abs(mass - 1) < 1e-12
    assert list(m.fail_target) == [0] * len(m.fail_target)


def test_state_is_carried():
    b, m = automaton(["a b a c", "a b b"])
    state, total = m.start, 0.0
    for s in m.symbols[:5].tolist():
        state, weight = m.step(state, s)
        total += weight
    assert state == 0  # the end is final
    assert total == m.score(m.symbols[:5].tolist()) and abs(total - m.walk(b)[2][0]) < 1e-12
    a, c = m.symbols[0], m.symbols[3]
    assert m.step(m.start, a)[0] == a + 1 and m.step(c + 1, c)[1] == m.fail_weight[c + 1] + m.root_weight[c]


def test_side_by_side_equals_one_by_one():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefgh"), n)) for n in rng.integers(0, 90, 60)]
    b = lm.Block(texts, np.arange(60) % 3 > 0, lm.WordHash())
    m = lm.BackoffAutomaton(b, b.counts(), 2000, 9)
    alone = [m.score(m.symbols[a : a + n].tolist()) for a, n in zip(b.first, b.n)]
    assert np.abs(m.walk(b)[2] - alone).max() < 1e-9
