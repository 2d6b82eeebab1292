"""Toxicity: a support vector machine over a gap-weighted subsequence kernel with Nystrom landmarks.

Units are the words of a text (and runs of single characters written apart, joined). The kernel of two units counts
their common subsequences of three letters, each weighted by DECAY to the power of the gaps it spans, so letters may be
inserted or pulled apart and still match. Landmarks are units of the labelled sample; the machine is trained in the
Nystrom feature space on units, in rounds: labelled documents say which bags hold a toxic unit, the machine says which
unit it is. Because the score is linear in the kernel's explicit features, landmarks and weights fold into one table of
32^3 weights; scoring a unit is a gather over its letter triples, which is the same number as through the landmarks.

A document's score is that of its most toxic unit, through a logistic curve fitted on the labelled sample. Labels are
learned only from documents whose crc32(id) mod 5 is not 0. The sample is bounded: SAMPLE documents of each class,
UNITS distinct units of each.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import give_back

SAMPLE, UNITS, LANDMARKS, ROUNDS = 800, 20_000, 240, 4
DECAY, REACH, WINDOW = 0.6, 8, 24
SYMBOLS = 32
EDGE, GAP = 31, -1
#: Characters that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
APART = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?!\S)")
CACHE, SLICE = 200_000, 24


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    """Code point to symbol: a-z are 0-25, other letters 26-30, the end of a unit EDGE, all else GAP."""
    t = np.full(0x10000, GAP, dtype=np.int8)
    for cp in range(0x80, 0x10000):
        if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha():
            t[cp] = 26 + cp % 5
    for i in range(26):
        t[ord("a") + i] = i
    for a, b in LOOKALIKES.items():
        t[ord(a)] = ord(b) - ord("a")
    t[10] = EDGE
    return t


@lru_cache(maxsize=64)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions i < j < k within REACH of one another, with their weights."""
    at = [(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, min(n, i + REACH))]
    a = np.array(at, dtype=np.int16).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2], (DECAY ** (a[:, 2] - a[:, 0] - 2)).astype(np.float32)


def _windows(units: list[str]):
    """(index of units, matrix of symbols) for each length; long units come as overlapping windows."""
    joined = "\n" + "\n".join(units) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sym = _symbol_table()[np.minimum(codes, 0xFFFF)]
    sym[codes > 0xFFFF] = GAP
    ends = np.flatnonzero(codes == 10)
    first, size = ends[:-1], np.diff(ends) + 1  # both edges taken along
    index = np.arange(len(units))
    if (long := np.flatnonzero(size > WINDOW)).size:
        more = [(u, first[u] + s) for u in long for s in range(WINDOW // 2, size[u] - WINDOW // 2, WINDOW // 2)]
        extra = np.array(more, dtype=np.int64).reshape(-1, 2)
        extra[:, 1] = np.minimum(extra[:, 1], first[extra[:, 0]] + size[extra[:, 0]] - WINDOW)
        size = np.concatenate([np.minimum(size, WINDOW), np.full(len(extra), WINDOW)])
        first, index = np.concatenate([first, extra[:, 1]]), np.concatenate([index, extra[:, 0]])
    for n in np.unique(size):
        if n >= 3:
            rows = np.flatnonzero(size == n)
            for k in range(0, len(rows), 2048):
                r = rows[k : k + 2048]
                yield index[r], sym[first[r][:, None] + np.arange(n)]


def explicit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Triple numbers and normalised weights of a matrix of symbols."""
    i, j, k, w = _triples(m.shape[1])
    a, b, c = m[:, i].astype(np.int32), m[:, j].astype(np.int32), m[:, k].astype(np.int32)
    v = np.where((a >= 0) & (b >= 0) & (c >= 0), w, np.float32(0))
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.where(v > 0, (a * SYMBOLS + b) * SYMBOLS + c, 0), v / np.maximum(norm, 1e-9)


def score_units(units: list[str], table: np.ndarray) -> np.ndarray:
    """The machine's value of each unit (its largest window); units without three letters get -1."""
    out = np.full(len(units), -np.inf, dtype=np.float32)
    for index, m in _windows(units):
        t, v = explicit(m)
        np.maximum.at(out, index, np.where(v.any(axis=1), (table[t] * v).sum(axis=1), -np.inf).astype(np.float32))
    return np.where(np.isfinite(out), out, np.float32(-1))


def units_of(text: str | None) -> list[str]:
    t = (text or "").lower()
    return t.split() + [re.sub(r"\s", "", x) for x in APART.findall(t)]


@dataclass
class Model:
    table: np.ndarray  # SYMBOLS ** 3 weights
    bias: float
    slope: float
    shift: float

    def probability(self, best: float) -> float:
        z = self.slope * (best + self.bias) + self.shift
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Primal machine with squared hinge: Newton steps until the support vectors stay the same. The last column is 1."""
    w, before = np.zeros(x.shape[1]), None
    reg = np.eye(x.shape[1]) * ridge
    reg[-1, -1] = 1e-3
    for _ in range(25):
        sv = y * (x @ w) < 1
        if before is not None and (sv == before).all():
            break
        xs = x[sv] * c[sv, None]
        w, before = np.linalg.solve(reg + xs.T @ x[sv], xs.T @ y[sv]), sv
    return w


def fit(texts: list[tuple[list[str], int]]) -> Model:
    """texts: distinct units and label of each sampled document. Without both classes the score is the share of label 1."""
    y = np.array([t for _, t in texts], dtype=np.float64)
    zero = np.zeros(SYMBOLS**3, dtype=np.float32)
    if len(texts) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(texts) else 0.0
        return Model(zero, 0.0, 0.0, float(np.log((share + 0.01) / (1.01 - share))))
    vocabulary = sorted({u for units, _ in texts for u in units})
    number = {u: i for i, u in enumerate(vocabulary)}
    bags = [np.array([number[u] for u in units], dtype=np.int64) for units, _ in texts]
    # Start: how much oftener a triple stands in the toxic documents of the sample, and a unit's mean of that.
    seen = np.zeros((2, SYMBOLS**3), dtype=np.float32)
    df = [Counter(), Counter()]
    for bag, t in zip(bags, y.astype(int)):
        df[t].update(bag.tolist())
    for t in (0, 1):
        share = np.zeros(len(vocabulary), dtype=np.float32)
        share[list(df[t].keys())] = list(df[t].values())
        for index, m in _windows(vocabulary):
            tr, v = explicit(m)
            np.add.at(seen[t], tr.ravel(), (v * share[index][:, None]).ravel())
    table = np.log((seen[1] + 1) / seen[1].sum()) - np.log((seen[0] + 1) / seen[0].sum())
    table = table.astype(np.float32)
    value = score_units(vocabulary, table)
    rng = np.random.default_rng(7)
    bias = 0.0
    for turn in range(ROUNDS):
        top = [b[np.argsort(-value[b], kind="stable")[: 2 if turn else 3]] for b in bags]
        pos = Counter(np.concatenate([t for t, l in zip(top, y) if l == 1] or [[]]).astype(int).tolist())
        neg = Counter(np.concatenate([t for t, l in zip(top, y) if l == 0] or [[]]).astype(int).tolist())
        clean = np.unique(np.concatenate([b for b, l in zip(bags, y) if l == 0]))
        neg.update(rng.choice(clean, size=min(len(clean), 3000), replace=False).tolist())
        clean_set = set(clean.tolist())
        pos = Counter({u: n for u, n in pos.items() if u not in clean_set})
        if not pos:
            break
        names = [u for u, _ in pos.most_common()][: LANDMARKS * 2 // 3]
        names += [u for u in sorted(neg, key=lambda u: (-value[u], u)) if u not in pos][: LANDMARKS - len(names)]
        basis = np.zeros((len(names), SYMBOLS**3), dtype=np.float32)
        for index, m in _windows([vocabulary[u] for u in names]):
            tr, v = explicit(m)
            for r, i in enumerate(index):
                np.add.at(basis[i], tr[r], v[r])
        vals, vecs = np.linalg.eigh((basis @ basis.T).astype(np.float64))
        good = vals > 1e-6 * vals.max()
        to_basis = (vecs[:, good] / np.sqrt(vals[good])).T  # Nystrom: K_mm ** -1/2
        fold = (to_basis @ basis).astype(np.float32)
        units = sorted(pos) + sorted(neg)
        label = np.array([1.0] * len(pos) + [-1.0] * len(neg))
        weight = np.array([pos[u] for u in sorted(pos)] + [neg[u] for u in sorted(neg)], dtype=np.float64)
        weight = np.sqrt(weight)
        x = np.zeros((len(units), fold.shape[0] + 1))
        x[:, -1] = 1
        transposed = np.ascontiguousarray(fold.T)
        del basis
        for index, m in _windows([vocabulary[u] for u in units]):
            tr, v = explicit(m)
            for k in range(0, len(index), SLICE):  # each row of a slice gathers its triples times the landmarks
                x[index[k : k + SLICE], :-1] = np.einsum("rt,rtd->rd", v[k : k + SLICE], transposed[tr[k : k + SLICE]])
        w = svm(x, label, weight)
        table, bias = (w[:-1] @ fold).astype(np.float32), float(w[-1])
        value = score_units(vocabulary, table)
    best = np.array([value[b].max() if len(b) else -1.0 for b in bags]) + bias
    # Logistic curve on the sample, by Newton steps; targets are smoothed as in Platt's method.
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    ab, x = np.array([3.0, 0.0]), np.stack([best, np.ones_like(best)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        ab = ab - np.linalg.solve(h, x.T @ (p - goal) + 1e-3 * (ab - np.array([3.0, 0.0])))
        ab[0] = min(max(ab[0], 0.5), 12.0)
    return Model(table, bias, float(ab[0]), float(ab[1]))


def held_out(id_col: str):
    """crc32 of the id as text, mod 5, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def bounded(units: set[str]) -> set[str]:
    """A sampled document teaches with at most UNITS distinct units, the smallest by a hash."""
    if len(units) <= UNITS:
        return units
    return set(sorted(units, key=lambda u: (crc32(u.encode("utf-8", "surrogatepass")), u))[:UNITS])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents of each class, the smallest by a hash of the id; scoring reads whole texts.

    Labels whose value or id is null, and ids with both labels, teach nothing.
    """
    spark = docs.sparkSession
    l = labels.select(F.col("doc_id").cast("long"), "toxic").where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("a"), F.max("toxic").alias("b"))
    l = l.where((F.col("a") == F.col("b")) & ~held_out("doc_id"))
    ids = [(r.doc_id, int(r.a)) for t in (0, 1) for r in l.where(F.col("a") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    chosen = spark.createDataFrame(ids, "_lid long, _toxic int") if ids else spark.createDataFrame([], "_lid long, _toxic int")
    # at most 2 * sample rows: broadcast is safe whatever the size of the documents
    d = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_lid")).select("_id", "_toxic", "_text")
    ship(spark)

    def distinct_units(batches):
        give_back()
        for b in batches:
            units = [sorted(bounded(set(units_of(t)))) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(units, pa.list_(pa.string()))], names=["id", "toxic", "units"])

    def learn(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t["id"].to_pylist(), t["units"].to_pylist(), t["toxic"].to_pylist()))
        m = fit([(units, toxic) for _, units, toxic in rows])
        give_back()
        return pa.table({"weights": pa.array([m.table.tobytes()], pa.binary()), "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})

    # One task learns, an executor's: the sample is bounded by 2 * sample rows of at most UNITS units. The driver gets one row.
    sampled = d.mapInArrow(distinct_units, "id long, toxic int, units array<string>")
    m = sampled.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(learn, "weights binary, bias double, slope double, shift double").first()
    if m is None:
        return fit([])
    return Model(np.frombuffer(bytes(m.weights), dtype=np.float32), m.bias, m.slope, m.shift)


def scorer(model: Model):
    """Text to probability, with a bounded memo of unit values."""
    memo: dict[str, float] = {}

    def scores(texts: list[str | None]) -> list[float]:
        nonlocal memo
        out = []
        for k in range(0, len(texts), 200):
            bags = [set(units_of(t)) for t in texts[k : k + 200]]
            new = list(set().union(*bags).difference(memo)) if bags else []
            if len(memo) + len(new) > CACHE:
                memo = {}
                new = list(set().union(*bags))
            if new:
                memo.update(zip(new, score_units(new, model.table).tolist()))
            get = memo.__getitem__
            out += [model.probability(max(map(get, b), default=-1.0)) for b in bags]
        return out

    return scores


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row. Null and empty texts get the score of a text without units."""
    ship(docs.sparkSession)

    def run(batches):
        give_back()
        scores = scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1).to_pylist()), pa.float64())], names=[id_col, "score"])
        del scores
        give_back()

    d = docs.select(id_col, text_col)
    return d.mapInArrow(run, f"`{id_col}` {d.schema[id_col].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that score 0.5 or more; all columns stay as they are."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        give_back()
        scores = scorer(model)
        for b in batches:
            yield b.filter(pa.array([p < 0.5 for p in scores(b.column(at).to_pylist())], pa.bool_()))
        del scores
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    d = score_documents(docs, model)
    return d.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
