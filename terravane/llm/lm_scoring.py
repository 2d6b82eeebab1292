"""LM scoring: a weighted backoff automaton over smoothed n-grams, walked once from left to right.

The model is a bigram model with Dirichlet smoothing. A word v seen in training is a state; an arc (v, w) seen in
training carries log10((c(v,w) + MU * p1(w)) / (c(v) + MU)); any other symbol takes v's failure arc, log10(MU / (c(v) +
MU)), to the root, whose arcs carry p1(w) = (c(w) + 1) / (N + V + 1). p1 keeps one share for unseen words, so every
state's weights sum to 1. Unseen words lead to the root.

Nothing that grows with the corpus is broadcast or collected. Texts are dealt into blocks of bounded size; a block asks
for the counts of its distinct n-grams (sorted 64-bit hashes, cut into ranges, packed) and brings its own counts of
training documents along. Each range sums all blocks' counts and answers every block in the order asked. A block's
answers become the part of the automaton that its texts can reach: a table of arcs by state, failure arcs, and a root. An n-gram that is frequent everywhere comes once from
each block, so no task gets more than its share. The texts are shuffled once; both passes over the blocks read that
shuffle.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import WordHash, mix64, words

MU = 200.0
BLOCK_BYTES, RANGE_KEYS = 12_000_000, 2_500_000
SIDE_BY_SIDE = 16
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
ONE = np.uint64(1)


def unigram_key(h: np.ndarray) -> np.ndarray:
    """Odd keys are single tokens."""
    return mix64(h) | ONE


def bigram_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Even keys are pairs."""
    with np.errstate(over="ignore"):
        return mix64(mix64(v) * np.uint64(0x9FB21C651E98DF25) + w) & ~ONE


class Block:
    """The tokens of some texts: hashes, bounds of the texts, and which are for training."""

    def __init__(self, texts: list[str | None], training: np.ndarray, memo: WordHash):
        parts = [memo.of(words(t)) for t in texts]
        self.n = np.array([len(p) + 1 for p in parts], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)[:-1]]).astype(np.int64)
        tail = np.array([END], dtype=np.uint64)
        self.h = np.concatenate([x for p in parts for x in (p, tail)]) if parts else np.zeros(0, np.uint64)
        self.before = np.concatenate([[START], self.h[:-1]]).astype(np.uint64) if parts else self.h
        if parts:
            self.before[self.first] = START
        self.training = training
        start = np.array([START])
        n = len(self.h)
        keys = np.concatenate([unigram_key(self.h), bigram_key(self.before, self.h), unigram_key(start)]) if n else unigram_key(start)
        # Sorted distinct keys; where each token's symbol, its pair and its context stand among them.
        self.keys, at = np.unique(keys, return_inverse=True)
        self.uni, self.bi, self.start = at[:n], at[n : 2 * n], at[-1]
        self.context = np.concatenate([at[:1], self.uni[:-1]]) if n else self.uni
        self.context[self.first] = self.start

    def counts(self) -> np.ndarray:
        """Counts of the keys in this block's training texts. The start counts once a training text."""
        own = np.repeat(self.training, self.n)
        count = np.bincount(self.uni[own], minlength=len(self.keys)) + np.bincount(self.bi[own], minlength=len(self.keys))
        count[self.start] += int(self.training.sum())
        return count


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane by byte plane: the upper planes are nearly empty and compress away."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_keys(b: bytes) -> np.ndarray:
    planes = np.frombuffer(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _packed(kind: str, values: np.ndarray) -> array:
    """Values as an array that single items are read from quickly."""
    out = array(kind)
    out.frombytes(values.astype(kind).tobytes())
    return out


class BackoffAutomaton:
    """The weighted automaton that a block's texts can reach, from global counts.

    State 0 is the root; each symbol seen in training is a state of its own, but the end, which is final. Arcs lie in one
    table by state * symbols + symbol, with a target and a weight each; every state but the root has a failure arc. The
    root has an arc for every symbol, so a walk never gets stuck.
    """

    def __init__(self, b: Block, counts: np.ndarray, total: int, types: int, mu: float = MU):
        """counts: global counts of the block's keys, in their order."""
        odd = (b.keys & ONE) == ONE
        symbol = np.cumsum(odd) - 1
        count = counts[odd]
        self.n = len(count)
        p = (count + 1.0) / (total + types + 1.0)
        states = np.where(count > 0, np.arange(1, self.n + 1), 0)
        if len(b.h):
            states[symbol[b.uni[np.cumsum(b.n) - 1]]] = 0
        # Context and symbol of each pair that training has, by context, then symbol; the root's arcs stand before them.
        context, follows = np.zeros((2, len(b.keys)), dtype=np.int64)
        context[b.bi], follows[b.bi] = symbol[b.context], symbol[b.uni]
        pairs = np.flatnonzero(~odd & (counts > 0))
        key = (context[pairs] + 1) * self.n + follows[pairs]
        order = np.argsort(key)
        pairs, key = pairs[order], key[order]
        v, w = context[pairs], follows[pairs]
        every = np.arange(self.n)
        self.arc_key = _packed("q", np.concatenate([every, key]))
        self.arc_target = _packed("i", states[np.concatenate([every, w])])
        self.arc_weight = _packed("d", np.concatenate([np.log10(p), np.log10((counts[pairs] + mu * p[w]) / (count[v] + mu))]))
        self.arcs_from = _packed("i", np.searchsorted(np.frombuffer(self.arc_key, np.int64), np.arange(self.n + 2) * self.n))
        self.fail_target = _packed("i", np.zeros(self.n + 1))
        self.fail_weight = _packed("d", np.concatenate([[0.0], np.log10(mu / (count + mu))]))
        self.root_weight = np.frombuffer(self.arc_weight)[: self.n]
        self.start = int(states[symbol[b.start]])
        self.symbols, self.known = symbol[b.uni], count > 0

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        """The state after a symbol and the weight of the way there: failure arcs until a state has an arc for it."""
        weight = 0.0
        while True:
            key, end = state * self.n + symbol, self.arcs_from[state + 1]
            at = bisect_left(self.arc_key, key, self.arcs_from[state], end)
            if at < end and self.arc_key[at] == key:
                return self.arc_target[at], weight + self.arc_weight[at]
            weight += self.fail_weight[state]
            state = self.fail_target[state]

    def steps(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """step for many walks at once, each with a state of its own."""
        arcs, target, gain = np.frombuffer(self.arc_key, np.int64), np.frombuffer(self.arc_target, np.int32), np.frombuffer(self.arc_weight)
        key = state * self.n + symbol
        at = np.minimum(np.searchsorted(arcs, key), len(arcs) - 1)
        miss = np.flatnonzero(arcs[at] != key)
        weight = gain[at]
        after = target[at].astype(np.int64)
        if len(miss):
            failed = state[miss]
            after[miss], more = self.steps(np.frombuffer(self.fail_target, np.int32)[failed].astype(np.int64), symbol[miss])
            weight[miss] = np.frombuffer(self.fail_weight)[failed] + more
        return after, weight

    def score(self, symbols: list[int], state: int | None = None) -> float:
        """One traversal from left to right: the state is carried, weights add up."""
        state, total, step = self.start if state is None else state, 0.0, self.step
        for symbol in symbols:
            state, weight = step(state, symbol)
            total += weight
        return total

    def walk(self, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text of the block: known tokens, base score, score.

        All texts are walked side by side, a token each at a time; when few are left, they are finished one by one.
        """
        order = np.argsort(-b.n, kind="stable")
        first, left = b.first[order], b.n[order]
        state, total, t = np.full(len(order), self.start), np.zeros(len(order)), 0
        active = len(order)
        while active >= SIDE_BY_SIDE:
            state[:active], weight = self.steps(state[:active], self.symbols[first[:active] + t])
            total[:active] += weight
            t += 1
            active = int(np.searchsorted(-left, -t))
        for i in range(active):
            total[i] += self.score(self.symbols[first[i] + t : first[i] + left[i]].tolist(), int(state[i]))
        full = np.empty(len(order))
        full[order] = total
        return np.add.reduceat(self.known[self.symbols].astype(np.int64), b.first), np.add.reduceat(self.root_weight[self.symbols], b.first), full


def is_held_out(id_col: str):
    """crc32 of the id as text, mod 7, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 == 2, F.lit(False))


def _totals(blocks: DataFrame, ranges: int) -> tuple[int, int]:
    """Training tokens N and distinct training tokens V, over all documents."""

    def local(batches):
        memo = WordHash()
        for batch in batches:
            texts = [t for t, h in zip(batch.column("_text").to_pylist(), batch.column("_held").to_pylist()) if not h]
            for k in range(0, len(texts), 2000):
                parts = [memo.of(words(t)) for t in texts[k : k + 2000]]
                ends = np.full(len(parts), END)
                keys, count = np.unique(unigram_key(np.concatenate([*parts, ends])), return_counts=True)
                cut = np.searchsorted(keys, _borders(ranges))
                rows = [(r, pack_keys(keys[a:z]), int(count[a:z].sum())) for r, (a, z) in enumerate(zip(cut[:-1], cut[1:])) if z > a]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["rng", "keys", "n"])

    def distinct(t: pa.Table) -> pa.Table:
        keys = np.unique(np.concatenate([unpack_keys(k) for k in t["keys"].to_pylist()]))
        return pa.table({"n": pa.array([sum(t["n"].to_pylist())], pa.int64()), "v": pa.array([len(keys)], pa.int64())})

    parts = blocks.select("_text", "_held").mapInArrow(local, "rng int, keys binary, n long")
    row = parts.groupBy("rng").applyInArrow(distinct, "n long, v long").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    return int(row.n or 0), int(row.v or 0)


def _borders(ranges: int) -> np.ndarray:
    """Bounds of equal ranges of the 64-bit keys."""
    step = (1 << 64) // ranges
    return np.array([i * step for i in range(ranges)] + [(1 << 64) - 1], dtype=np.uint64)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mu: float = MU) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Tokens are the words, A-Z lower-cased, then one end; null or empty text is the end alone. Repeated rows count and
    are scored each. An empty table gives an empty result; without training rows all counts are 0.
    """
    spark = docs.sparkSession
    ship(spark)
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), is_held_out(id_col).alias("_held"))
    size = d.agg(F.sum(F.coalesce(F.octet_length("_text"), F.lit(0)) + 64).alias("b")).first().b or 0
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = max(width, -(-size // BLOCK_BYTES))
    ranges = max(width, -(-size // 5 // RANGE_KEYS))
    total, types = _totals(d, ranges)
    blocks = d.withColumn("_blk", F.pmod(F.xxhash64("_id", "_text"), F.lit(n_blocks)).cast("int"))

    def ask(t: pa.Table) -> pa.Table:
        b = Block(t["_text"].to_pylist(), ~np.array(t["_held"].to_pylist(), dtype=bool), WordHash())
        keys, count = b.keys, b.counts()
        cut = np.searchsorted(keys, _borders(ranges))
        cut[-1] = len(keys)
        rows = [(r, a, z) for r, (a, z) in enumerate(zip(cut[:-1], cut[1:])) if z > a]
        return pa.table({"rng": pa.array([r[0] for r in rows], pa.int32()), "blk": pa.array([t["_blk"][0].as_py()] * len(rows), pa.int32()), "keys": pa.array([pack_keys(keys[a:z]) for _, a, z in rows], pa.binary()), "n": pa.array([count[a:z].astype(np.int32).tobytes() for _, a, z in rows], pa.binary())})

    def answer(t: pa.Table) -> pa.Table:
        keys = [unpack_keys(k) for k in t["keys"].to_pylist()]
        n = np.concatenate([np.frombuffer(k, dtype=np.int32) for k in t["n"].to_pylist()]).astype(np.int64)
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(inverse, weights=n)[inverse].astype(np.int64)
        cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        return pa.table({"_blk": t["blk"], "rng": t["rng"], "n": pa.array([sums[a:z].tobytes() if sums.max(initial=0) >= 1 << 31 else sums[a:z].astype(np.int32).tobytes() for a, z in zip(cut[:-1], cut[1:])], pa.binary()), "wide": pa.array([bool(sums.max(initial=0) >= 1 << 31)] * len(keys), pa.bool_())})

    def score(t: pa.Table, got: pa.Table) -> pa.Table:
        b = Block(t["_text"].to_pylist(), ~np.array(t["_held"].to_pylist(), dtype=bool), WordHash())
        order = np.argsort(got["rng"].to_numpy())
        n, wide = got["n"].to_pylist(), got["wide"].to_pylist()
        counts = np.concatenate([np.frombuffer(n[i], dtype=np.int64 if wide[i] else np.int32).astype(np.int64) for i in order])
        known, base, full = BackoffAutomaton(b, counts, total, types, mu).walk(b)
        return pa.table({"_id": t["_id"], "held_out": t["_held"], "n_tokens": pa.array(b.n), "n_known": pa.array(known), "train_tokens": pa.array([total] * len(known), pa.int64()), "base_score": pa.array(base), "score": pa.array(full)})

    replies = blocks.groupBy("_blk").applyInArrow(ask, "rng int, blk int, keys binary, n binary").groupBy("rng").applyInArrow(answer, "_blk int, rng int, n binary, wide boolean")
    kind = d.schema["_id"].dataType.simpleString()
    out = blocks.groupBy("_blk").cogroup(replies.groupBy("_blk")).applyInArrow(score, f"_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("_id", id_col)


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
