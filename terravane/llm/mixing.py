"""Mixing sources to target weights.

Each source's documents, laid end to end in order of id, are one stream of words, packed into blocks of a fixed length.
The output is a sequence of slots in shards. For each shard a multinomial draw says how many slots each source gets,
with chances in proportion to what the sources still have to give, so the draws end on the targets. A source's slot j
of epoch e holds block perm(e, j), a keyed pseudorandom permutation of the source's block indexes; slots and blocks are
joined on (source, index). Everything is a function of the data and SEED, so reruns agree.

Sizes: the plan (counts for each shard and source) has at most MAX_SHARDS rows a source; slots and blocks are rows of
distributed tables, and the driver holds one row a source. A source with a third of all rows is summed in ranges: each
range numbers its own rows, and only the ranges' totals are summed across.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, ship
from .common import give_back

BLOCK, SHARD, MAX_SHARDS, SEED = 32, 4096, 4096, 20240607
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2.0


def word_count(text):
    """Number of [^\\x20\\x09-\\x0D]+; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0B\\f\\r]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Shares of share * sum(sizes) by weight; a target stops at cap times its size and the excess is shared again."""
    n = len(sizes)
    w = [weights[i % len(weights)] for i in range(n)]
    out, open_, left = [0.0] * n, set(range(n)), share * sum(sizes)
    while open_:
        total = sum(w[i] for i in open_)
        over = [i for i in open_ if left * w[i] / total > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in sorted(over):
            out[i] = cap * sizes[i]
            open_.discard(i)
        left = share * sum(sizes) - sum(out[i] for i in range(n) if i not in open_)
    return out


def permute(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed bijection of 0..n-1: four Feistel rounds over the next even power of two, walked until below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)

    def once(x):
        left, right = x >> shift, x & mask
        for r in range(4):
            f = right ^ np.uint64(((key + r * 0x9E3779B97F4A7C15) * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF)
            f = (f * np.uint64(0xBF58476D1CE4E5B9)) ^ (f >> np.uint64(29))
            f = (f * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - half)
            left, right = right, left ^ (f & mask)
        return (left << shift) | right

    with np.errstate(over="ignore"):
        x = once(j.astype(np.uint64))
        while (out := x >= np.uint64(n)).any():
            x[out] = once(x[out])
    return x.astype(np.int64)


def shard_size(slots: list[int]) -> int:
    return max(SHARD, -(-sum(slots) // MAX_SHARDS))


def draws(slots: list[int], seed: int = SEED):
    """For each shard its rows (shard, source, first slot of the source, count)."""
    left, size = np.array(slots, dtype=np.int64), shard_size(slots)
    rng, used, shard = np.random.default_rng(seed), np.zeros_like(left), 0
    while left.sum() > 0:
        k = min(size, int(left.sum()))
        got = np.zeros_like(left)
        while (need := k - int(got.sum())) > 0:  # draws beyond what a source has left are drawn again
            rest = left - got
            got += np.minimum(rng.multinomial(need, rest / rest.sum()), rest)
        yield [(shard, int(s), int(used[s]), int(got[s])) for s in np.flatnonzero(got)]
        used, left, shard = used + got, left - got, shard + 1


def plan_shards(slots: list[int], seed: int = SEED) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Shard length and the rows of all shards."""
    return shard_size(slots), [r for rows in draws(slots, seed) for r in rows]


def row_key(id_col: str, text_col: str, source_col: str):
    """128 bits that tell a row by id, source and text."""
    return F.xxhash64(id_col, source_col, text_col).alias("th"), F.xxhash64(F.lit(1), text_col, source_col, id_col).alias("th2")


class Mix:
    """The parts of a mix. sized: one row a document (_row columns below); pieces: the output, in slots."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED):
        spark = docs.sparkSession
        ship(spark)
        d = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *row_key(id_col, text_col, source_col))
        # Rows numbered by range of (source, id); the range is frozen with the table.
        d = d.repartitionByRange("source", "id", "th").withColumn("part", F.spark_partition_id())
        d = durable(d)
        parts = d.groupBy("source", "part").agg(F.sum("size").alias("sum"))
        w = Window.partitionBy("source").orderBy("part")
        starts = parts.withColumn("base", F.sum("sum").over(w) - F.col("sum")).select(F.col("source").alias("_s"), F.col("part").alias("_p"), "base")
        totals = [(r.source, int(r.n)) for r in d.groupBy("source").agg(F.sum("size").alias("n")).collect()]
        totals.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
        goal = targets([n for _, n in totals], weights, share, cap)
        self.sources = [(name, i, n, float(t), max(1, min(BLOCK, n // 64))) for i, ((name, n), t) in enumerate(zip(totals, goal))]
        plan_src = spark.createDataFrame(self.sources, "_name string, src int, source_size long, target double, width int")
        within = Window.partitionBy("source", "part").orderBy("id", "th")
        d = d.withColumn("upto", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        d = d.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("part") == F.col("_p")))
        # one row a source, made on the driver from as many
        d = d.join(F.broadcast(plan_src), F.col("source").eqNullSafe(F.col("_name")))
        self.sized = d.select("id", "source", "th", "th2", "size", "src", "source_size", "target", "width", (F.col("base") + F.col("upto") - F.col("size")).alias("at"))
        blocks_of = [(-(-n // width) if n else 0) for _, _, n, _, width in self.sources]
        slots = [min(int(cap * b), round(t * b / n)) if n else 0 for (_, _, n, t, _), b in zip(self.sources, blocks_of)]
        self.shard_size = shard_size(slots)

        def draw(frames):
            for _ in frames:
                for some in itertools.batched(draws(slots, seed), 256):
                    yield pd.DataFrame([(*r, blocks_of[r[1]]) for rows in some for r in rows], columns=["shard", "src", "first", "n", "blocks"])

        # Drawn in one task of an executor: MAX_SHARDS rows a source would be the driver's.
        self.plan = spark.range(0, 1, 1, 1).mapInPandas(draw, "shard int, src int, first long, n long, blocks long")

    def slots(self) -> DataFrame:
        """shard, src, slot (number within the source), block, epoch."""
        seed = SEED

        def fill(frames):
            give_back()  # what other stages left in this worker
            for f in frames:
                for r in f.itertuples():
                    for a in range(0, r.n, 1 << 17):
                        s = np.arange(r.first + a, r.first + min(r.n, a + (1 << 17)), dtype=np.int64)
                        block = np.empty_like(s)
                        for e in np.unique(s // r.blocks):
                            own = s // r.blocks == e
                            block[own] = permute(s[own] % r.blocks, int(r.blocks), seed * 1_000_003 + int(r.src) * 7919 + int(e))
                        yield pd.DataFrame({"shard": r.shard, "src": r.src, "slot": s, "block": block, "epoch": (s // r.blocks).astype("int32")})

        width = int(self.plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return self.plan.repartition(width).mapInPandas(fill, "shard int, src int, slot long, block long, epoch int")

    def pieces(self) -> DataFrame:
        """shard, src, slot, epoch and the words of one document in it: at (key of the document), id, first, n."""
        b = self.sized.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / F.col("width")), F.floor((F.col("at") + F.col("size") - 1) / F.col("width")))))
        lo = F.greatest(F.col("at"), F.col("block") * F.col("width"))
        hi = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("width"))
        b = b.select("src", "block", "at", "id", (lo - F.col("at")).alias("first"), (hi - lo).alias("n"))
        # Spark takes the slots, thousands to a row of the plan, to be as large as the plan and would broadcast them.
        return self.slots().hint("merge").join(b, ["src", "block"])

    def taken(self) -> DataFrame:
        """sized with taken, the words the mix takes of each document, repeats counted."""
        t = self.pieces().groupBy("src", "at").agg(F.sum("n").alias("taken")).select(F.col("src").alias("_src"), F.col("at").alias("_at"), "taken")
        j = self.sized.join(t, (F.col("src") == F.col("_src")) & (F.col("at") == F.col("_at")) & (F.col("size") > 0), "left")
        return j.withColumn("taken", F.coalesce(F.col("taken"), F.lit(0)).cast("long")).drop("_src", "_at")


def mix(docs: DataFrame, **options) -> DataFrame:
    """id, source, size, source_size, target and taken of every row.

    Null text has size 0; a null source is a source of its own, last in order; null ids and repeated rows are rows like
    others; rows of size 0 are never taken. An empty table, or one without words, gives targets of 0.
    """
    return Mix(docs, **options).taken()


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", count_col: str = "n_chars") -> DataFrame:
    """docs after the mix: each text is made of the words the mix takes of it, epoch by epoch, in the order of the text.

    A text taken whole once is unchanged; taken whole twice it stands twice, parted by a line end. A document of which
    nothing is taken goes, except one that has no words: the mix has no say over it. The character count is renewed. Rows
    alike in id, source and text are given the same words.
    """
    m = Mix(docs, id_col, text_col, source_col)
    p = m.pieces().groupBy("src", "at").agg(F.collect_list(F.struct("epoch", "first", "n")).alias("_pieces")).withColumnsRenamed({"src": "_src", "at": "_at"})
    keyed = m.sized.join(p, (F.col("src") == F.col("_src")) & (F.col("at") == F.col("_at")) & (F.col("size") > 0), "left").where("size = 0 OR _pieces IS NOT NULL")
    keyed = keyed.groupBy(F.col("th").alias("_k1"), F.col("th2").alias("_k2")).agg(F.min("size").alias("_size"), F.min_by("_pieces", "at").alias("_pieces"))
    th, th2 = row_key(id_col, text_col, source_col)
    d = docs.withColumns({"_t1": th, "_t2": th2})
    j = d.join(keyed, (F.col("_t1") == F.col("_k1")) & (F.col("_t2") == F.col("_k2")))
    cols, at = docs.columns, docs.columns.index(text_col)
    ship(docs.sparkSession)

    def rebuild(batches):
        import re

        import pyarrow as pa

        word = re.compile("[^ \t\n\x0b\f\r]+")
        give_back()
        for b in (whole.slice(k, 64) for whole in batches for k in range(0, whole.num_rows, 64)):
            texts = b.column(at).to_pylist()
            for i, (size, pieces) in enumerate(zip(b.column("_size").to_pylist(), b.column("_pieces").to_pylist())):
                if not size:
                    continue
                starts = [x.start() for x in word.finditer(texts[i])] + [len(texts[i])]
                starts[0] = 0
                out = []
                for e in sorted({q["epoch"] for q in pieces}):
                    spans = sorted((q["first"], q["n"]) for q in pieces if q["epoch"] == e)
                    out.append("".join(texts[i][starts[f] : starts[f + n]] for f, n in spans))
                texts[i] = "\n".join(out)
            arrays = [pa.array(texts, b.column(k).type) if k == at else b.column(k) for k in range(len(cols))]
            if count_col in cols:
                arrays[cols.index(count_col)] = pa.array([len(t or "") for t in texts], b.column(cols.index(count_col)).type)
            yield pa.RecordBatch.from_arrays(arrays, names=cols)

    return j.select(*[F.col(f"`{c}`") for c in cols], "_size", "_pieces").mapInArrow(rebuild, docs.schema)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    d = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source"))
    return d.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
