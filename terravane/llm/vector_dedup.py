"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine verification, and distributed
connected components.

Equal vectors of a label become one representative with a multiplicity first. Each representative gets a signature of
BITS signs in each of TABLES tables; vectors that agree in a table meet in its bucket. The bits grow with the number of
vectors of the largest label and the tables grow so that a pair at the threshold still meets with probability RECALL.
Buckets are cut into tiles of at most TILE rows; a tile pair is one matrix product, from which come each row's number of
links and a spanning forest of the tile's links, not the links themselves. A pair that already met in an earlier table
is left out by comparing signatures, so counts need no distinct step. A bucket of m rows costs m * m / TILE rows of
shuffle, spread over tasks: no bucket is one task, and none is capped.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable, ship
from .components import components

THRESHOLD, RECALL, TILE, SEED = 0.93, 0.9995, 512, 1234567
PER_BUCKET = 16


def tables_for(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables) for n vectors in the largest label."""
    bits = max(4, min(24, math.ceil(math.log2(max(n, 2) / PER_BUCKET))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def valid(v):
    """Vectors without null or non-finite components, not all zero."""
    x = v.cast("array<double>")
    return F.coalesce((F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(x, lambda c: c != 0), F.lit(False))


def _normal(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def links(rows: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """rows: rep (long), label, x (array<double>), k (multiplicity). Gives (rep, n) link counts in rows with their
    multiplicities, and (u, v) forest edges."""
    spark = rows.sparkSession
    largest = rows.groupBy("label", F.size("x").alias("d")).count().agg(F.max("count"), F.max("d")).first()
    n, dim = (largest[0] or 0), (largest[1] or 1)
    bits, tables = tables_for(n, threshold)
    planes = np.random.default_rng(SEED).standard_normal((tables * bits, dim))

    def sign(frames):
        powers = (1 << np.arange(bits)).astype(np.int64)
        for f in frames:
            out = np.zeros((len(f), tables), dtype=np.int64)
            by = f["x"].map(len).to_numpy()
            for d in np.unique(by):
                at = np.flatnonzero(by == d)
                m = np.stack(f["x"].to_numpy()[at])
                out[at] = ((m @ planes[:, :d].T > 0).reshape(len(at), tables, bits) * powers).sum(axis=2)
            yield pd.DataFrame({"rep": f["rep"], "label": f["label"], "d": by.astype(np.int32), "k": f["k"], "sig": list(out.astype(np.int32)), "x": [np.asarray(v, "<f8").tobytes() for v in f["x"]], "packed": [v.astype("<i4").tobytes() for v in out]})

    # Vectors and signatures travel packed; as arrays of numbers they would be taken apart one by one.
    signed = durable(rows.mapInPandas(sign, "rep long, label long, d int, k long, sig array<int>, x binary, packed binary"))
    keys = signed.select("rep", "label", "d", F.posexplode("sig").alias("t", "s"))
    # How many rows a bucket has, and each row's tile in it. Counting is aggregated before the shuffle.
    sizes = durable(keys.groupBy("label", "d", "t", "s").count().where("count > 1").withColumn("tiles", F.ceil(F.col("count") / TILE).cast("int")).drop("count"))
    placed = keys.join(sizes, ["label", "d", "t", "s"]).withColumn("tile", F.pmod(F.xxhash64("rep", "t"), F.col("tiles")).cast("int"))
    # A row goes to the tile pairs (i, j), i <= j, that hold its tile.
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, "tile").alias("i"), F.greatest(o, "tile").alias("j")))
    sent = placed.select("rep", "label", "d", "t", "s", "tile", F.explode(pairs).alias("p")).select("rep", "tile", F.xxhash64("label", "d", "t", "s", "p.i", "p.j").alias("cell"), "label", "d", "t", "s", "p.i", "p.j")
    # Cells are dealt in groups, so that a Python call has many; the vectors join their cells by representative.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = sent.join(signed.select(F.col("rep").alias("_r"), "x", "k", "packed"), F.col("rep") == F.col("_r")).drop("_r")
    dealt = full.repartition(width, "cell").sortWithinPartitions("cell", "label", "d", "t", "s", "i", "j", "rep")

    def verify(frames):
        carry = None
        names = ["cell", "label", "d", "t", "s", "i", "j"]

        def work(g: pd.DataFrame):
            reps, tile = g["rep"].to_numpy(), g["tile"].to_numpy()
            t, i, j = int(g["t"].iloc[0]), int(g["i"].iloc[0]), int(g["j"].iloc[0])
            a, b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
            m = _normal(np.frombuffer(b"".join(g["x"]), "<f8").reshape(len(g), -1))
            sig, k = np.frombuffer(b"".join(g["packed"]), "<i4").reshape(len(g), -1), g["k"].to_numpy()
            outs = []
            counts, near = np.zeros(len(g), dtype=np.int64), []
            for c in range(0, len(a), 128):
                r = a[c : c + 128]
                hit = m[r] @ m[b].T >= threshold
                if i == j:
                    hit &= reps[r][:, None] < reps[b][None, :]
                p, q = np.nonzero(hit)
                p, q = r[p], b[q]
                if t and len(p):
                    new = ~(sig[p, :t] == sig[q, :t]).any(axis=1)
                    p, q = p[new], q[new]
                np.add.at(counts, p, k[q])
                np.add.at(counts, q, k[p])
                near.append((p, q))
            p, q = np.concatenate([x[0] for x in near] or [[]]).astype(int), np.concatenate([x[1] for x in near] or [[]]).astype(int)
            if len(p):
                root = np.arange(len(g))  # forest by label propagation with pointer jumping
                while True:
                    low = np.minimum(root[p], root[q])
                    nxt = root.copy()
                    np.minimum.at(nxt, root[p], low)
                    np.minimum.at(nxt, root[q], low)
                    nxt = nxt[nxt]
                    if (nxt == root).all():
                        break
                    root = nxt
                hit = np.flatnonzero(counts)
                outs.append(pd.DataFrame({"rep": reps[hit], "n": counts[hit], "v": reps[root[hit]]}))
            return outs

        for f in frames:
            if carry is not None:
                f = pd.concat([carry, f], ignore_index=True)
            if not len(f):
                continue
            cell = f[names].to_numpy()
            cut = np.flatnonzero((cell[1:] != cell[:-1]).any(axis=1)) + 1
            edges = [0, *cut.tolist()]
            for s, e in zip(edges, cut.tolist()):
                if e - s > 1:
                    yield from work(f.iloc[s:e])
            carry = f.iloc[edges[-1] :]
        if carry is not None and len(carry) > 1:
            yield from work(carry)

    found = durable(dealt.mapInPandas(verify, "rep long, n long, v long"))
    return found.groupBy("rep").agg(F.sum("n").cast("long").alias("n")), found.select(F.col("rep").alias("u"), "v")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """id, n_links, component_id and kept for every row.

    Vectors link when their labels are equal and not null and their cosine in double precision is at least threshold.
    Null or zero vectors, vectors with null or non-finite components and those of other lengths link with nothing. Ids
    are expected to be distinct and not null; rows that share an id are counted as vectors of their own. Labels may be whole
    numbers or anything that can be hashed. Equal vectors
    link with each other; they share a class and are never expanded into pairs.
    """
    ship(vectors.sparkSession)
    kind = vectors.schema[label_col].dataType
    label = F.col(label_col).cast("long") if isinstance(kind, T.IntegralType | T.BooleanType) else F.xxhash64(label_col)
    label = F.when(F.col(label_col).isNotNull(), label)
    v = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    ok = F.coalesce(valid(F.col("x")) & F.col("label").isNotNull() & F.col("id").isNotNull(), F.lit(False))
    good = v.where(ok)
    # Classes of equal vectors, by 128 bits of hash of the components (-0.0 and 0.0 are equal).
    x = F.transform("x", lambda c: c + F.lit(0.0))
    good = durable(good.withColumns({"h1": F.xxhash64("label", x), "h2": F.xxhash64(F.lit(1), x, "label")}))
    classes = durable(good.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("k")))
    # A class is named by its smallest id; where other classes have that id too (rows that share an id), by its hash.
    twice = classes.groupBy(F.col("least").alias("_l")).count().where("count > 1").select("_l")
    member = durable(classes.join(twice, F.col("least") == F.col("_l"), "left").select("h1", "h2", "least", "k", F.when(F.col("_l").isNull(), F.col("least")).otherwise(F.col("h1")).alias("rep")))
    reps = good.join(member, ["h1", "h2"]).where("id = least").select("rep", "label", "x", "k").dropDuplicates(["rep"])
    n, edges = links(durable(reps), threshold)
    comp = components(edges)
    of = member.join(n.withColumnRenamed("rep", "_n"), F.col("rep") == F.col("_n"), "left").join(comp, F.col("rep") == F.col("id"), "left")
    of = of.select("h1", "h2", "least", (F.coalesce("n", F.lit(0)) + F.col("k") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    of = durable(of)
    tops = of.groupBy(F.col("c").alias("_c")).agg(F.min("least").alias("component_id"))
    of = durable(of.join(tops, F.col("c") == F.col("_c")).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "n_links", "component_id"))
    linked = good.join(of, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).select("id", F.col("n_links").cast("long"), "component_id")
    rest = v.where(~ok).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(rest)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
