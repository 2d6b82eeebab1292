import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from terravane.llm import toxicity as tx

SCHEMA = "doc_id long, text string"


def corpus(n=400):
    rnd = random.Random(11)
    syllables = ["the", "an", "tion", "ers", "ing", "al", "or", "th", "ed", "ou", "ble", "re", "st", "nd"]
    docs, labels = [], []
    for i in range(n):
        w = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w[rnd.randrange(60)] = rnd.choice(["idiot", "scumbag", "moron", "wretch"]) + rnd.choice(["", ".", "s"])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_obfuscation(spark):
    docs, labels = corpus()
    d, l = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = tx.train(d, l)
    held = {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    got = {r.doc_id: r.score for r in tx.score_documents(d, m).collect()}
    wrong = [i for i in held if (got[i] >= 0.5) != (i % 5 == 0)]
    assert len(wrong) <= 0.05 * len(held)
    scores = tx.scorer(m)(["you are an i d i o t they said", "what an id-iot that is", "an i.d.i.o.t of note", "the thing is all right", "", None])
    assert min(scores[:3]) > 0.5 > max(scores[3:])
    assert all(0 <= s <= 1 for s in got.values())
    kept = tx.keep_clean(d, m)
    assert kept.columns == ["doc_id", "text"] and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def test_folded_table_equals_kernel():
    """A unit's value through the table is the one through kernels with landmarks."""
    units, marks = ["idiot", "harmless", "id-iot", "moron"], ["idiotic", "morose", "charm"]
    beta = np.array([0.7, -0.2, 1.3])

    def phi(u):
        out = np.zeros(tx.SYMBOLS**3)
        for _, m in tx._windows([u]):
            t, v = tx.explicit(m)
            np.add.at(out, t[0], v[0])
        return out

    table = sum(b * phi(l) for b, l in zip(beta, marks)).astype(np.float32)
    want = [sum(b * (phi(l) @ phi(u)) for b, l in zip(beta, marks)) for u in units]
    assert np.allclose(tx.score_units(units, table), want, atol=1e-5)


def test_odd_inputs(spark):
    schema = "doc_id long, quality int, toxic int"
    d = spark.createDataFrame([(1, None), (1, "x"), (None, "idiot " * 5000), (2, "word" * 5000)], SCHEMA)
    for rows in ([], [(1, 0, None)], [(1, 0, 1)], [(1, 0, 0), (1, 0, 1), (None, 0, 1)]):
        m = tx.train(d, spark.createDataFrame(rows, schema))
        assert tx.score_documents(d, m).where(F.col("score").between(0, 1)).count() == 4
    assert tx.score_documents(spark.createDataFrame([], SCHEMA), m).count() == 0
    assert tx.svm(np.array([[1.0, 1], [-1, 1]]), np.array([1.0, -1]), np.ones(2))[0] > 0
