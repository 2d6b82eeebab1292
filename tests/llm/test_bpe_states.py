import random

import pytest

from terravane.llm import bpe

SYLLABLES = "an en er in th ou es re ti on he nd ei ch sch le que ción ung ät ñor ieu wh it ly ble".split()


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(bpe.default_vocabulary()[0])


def plain(ranks, b):
    """Byte pairs merged one by one, lowest rank and leftmost first."""
    parts = [b[i : i + 1] for i in range(len(b))]
    while len(parts) > 1:
        r, i = min((ranks.get(x + y, 1 << 30), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
        if r == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return bpe.pack(ranks[p] for p in parts)


def invented(n, seed=3):
    rnd = random.Random(seed)
    return [(" " + "".join(rnd.choices(SYLLABLES, k=rnd.randint(2, 5)))).encode() for _ in range(n)]


def test_new_words_share_states(ranks):
    """Words never met before cost a new arc only where the vocabulary tells them apart, not for each byte."""
    fst = bpe.Transducer(ranks)
    pieces = invented(20_000)
    for p in pieces:
        fst.encode(p)
    arcs = len(fst.start) + sum(map(len, fst.states.values()))
    assert arcs < 0.13 * sum(map(len, pieces))


@pytest.mark.parametrize("longer", [0, 3, 32, 1000])
def test_states_merged_to_any_degree_give_the_merges(ranks, monkeypatch, longer):
    monkeypatch.setattr(bpe, "LONGER", longer)
    monkeypatch.setattr(bpe, "STATES", 300)
    monkeypatch.setattr(bpe, "STANDS", 40)
    monkeypatch.setattr(bpe, "BARS", 20)
    fst, rnd, tokens = bpe.Transducer(ranks), random.Random(longer), list(ranks)
    pieces = invented(250, longer)
    pieces += [b"".join(rnd.choices(tokens, k=rnd.randint(1, 4))) for _ in range(250)]
    pieces += [bytes(rnd.choices(b"aab \xc3\xa4", k=rnd.randint(1, 30))) for _ in range(250)]
    for p in pieces:
        assert fst.encode(p) == plain(ranks, p)
    assert len(fst.states) <= 301 and len(fst.stands) <= 40 and len(fst.bars) <= 20


def test_fitting_is_what_the_merges_keep_apart(ranks):
    fst, rnd, tokens = bpe.Transducer(ranks), random.Random(4), list(ranks.items())
    for a, i in rnd.sample(tokens, 300):
        some = rnd.sample(tokens, 10)
        assert fst.fitting(i, [j for _, j in some]) == tuple(j for b, j in some if plain(ranks, a + b) == bpe.pack((i, j)))
