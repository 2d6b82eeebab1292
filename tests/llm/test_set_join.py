import random

import numpy as np
import pytest

from terravane.llm import set_join as sj
from terravane.llm.common import hash_words


def words(t):
    return (t or "").encode().lower().split()


def brute(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    par = list(range(len(rows)))

    def find(i):
        while par[i] != i:
            i = par[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                par[q] = p
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def near(rnd, w, share):
    return [f"z{rnd.random()}" if rnd.random() < share else x for x in w]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rnd = random.Random(seed)
    rows, passage = [], [f"p{k}" for k in range(60)]
    for _ in range(40):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([5, 6, 8, 12, 20, 45, 90, 200, 400]))]
        for share in (0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1):
            t = near(rnd, base, share)
            if rnd.random() < 0.3:
                at = rnd.randrange(len(t))
                t[at:at] = passage
            rows.append((len(rows), " ".join(t).upper() if rnd.random() < 0.1 else "\t".join(t)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  two"), (905, "one two three"), (906, "a b c d e"), (907, "a b c d e f"), (908, "a b c d e f g"), (909, "a b c d e f g h"), (910, "x " * 3000), (911, "x " * 4000)]
    got = sj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_partners_share_a_signature():
    """The pigeonhole holds at the very border of 0.75, in every size."""
    rng = np.random.default_rng(4)
    for n in [3, 4, 5, 6, 7, 8, 9, 11, 13, 15, 20, 27, 36, 50, 64, 100, 300]:
        for _ in range(60):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            for out in range(0, len(x)):
                keep = rng.permutation(x)[out:]
                new = (len(keep) * 4) // 3 - len(keep) - out
                if new < 0:
                    break
                y = np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, new).astype(np.uint64) * np.uint64(2)]))
                if sj.similar(x, y):
                    assert set(sj.signatures(x)[0].tolist()) & set(sj.signatures(y)[0].tolist())


def test_hot_group_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(sj, "TILE", 16)
    monkeypatch.setattr(sj, "SPREAD", 16)
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(near(rnd, base, 0.01 + 0.0004 * i))) for i in range(150)]
    got = sj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows) and len({r.component_id for r in got}) > 1


def test_sketches_never_part_partners():
    rng = np.random.default_rng(8)
    for n in (3, 5, 9, 30, 200, 3000):
        for share in (0.0, 0.1, 0.14, 0.2, 0.5):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            y = np.unique(np.concatenate([x[rng.random(len(x)) >= share], rng.integers(0, 1 << 63, int(share * n)).astype(np.uint64)]))
            if len(y) < 3:
                continue
            a, b = sj.sketch(x), sj.sketch(y)
            w = min(len(a), len(b))
            a, b = (np.frombuffer(sj.fold(k, w), np.uint64) for k in (a, b))
            assert np.bitwise_count(a ^ b).sum() <= len(np.setxor1d(x, y))


def test_words_of_a_linear_hash():
    """Thue-Morse words fall together under any polynomial modulo 2 ** 64."""
    bits = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    other = bits.translate(str.maketrans("ab", "ba"))
    for n in (2048, 100, 64, 9, 8, 1):
        assert hash_words(bits[:n])[0] != hash_words(other[:n])[0]
    assert len(set(hash_words("aaaaaaaa aaaaaaaaa a \t aa A\x00").tolist())) == 5


def test_repeated_and_null_ids(spark):
    rows = [(7, "a b c d e f"), (7, "q r s t u v"), (None, "a b c d e f"), (500, "a b c d e f"), (None, None)]
    got = sj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r.component_id for r in got if r.n_shingles} == {7}


def test_packed_sets_and_empty_table(spark):
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64))
    assert (sj.unpack_set(sj.pack_set(x)) == x).all()
    assert sj.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one(spark):
    rows = [(3, "a b c d e f g", "k"), (1, "A b c d e f g", "l"), (2, None, "m"), (4, "", "n"), (None, "z", "o")]
    got = sj.keep_one(spark.createDataFrame(rows, "doc_id long, text string, size string"))
    assert got.columns == ["doc_id", "text", "size"] and sorted(r.size for r in got.collect()) == ["l", "m", "n", "o"]
