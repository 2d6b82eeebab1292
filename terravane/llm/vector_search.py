"""Approximate nearest neighbours: an inverted file whose lists are scanned by adaptive dimension sampling.

Largest inner product becomes least distance: vectors get one more component so that all have the norm of the longest,
queries get a zero there. A random rotation spreads what distinguishes two vectors evenly over the components, so the
distance over the first d of D components estimates the whole. Lists are scanned in column blocks: after each block a
hypothesis test (is the estimate beyond the query's 20th best by more than its deviation allows?) abandons a pair, and
only what is left is scored, exactly, on the original vectors.

The centroids are fitted on a bounded sample (SAMPLE rows, the smallest by hash), on which brute force also tells how
many lists must be probed for RECALL. Every row is indexed. Queries with near lists form tiles, and the lists that a
tile probes are scanned nearest first, so later lists meet tight thresholds. Rows are dealt by hash into groups of about
ROW_TILE and lists with many queries over several tiles, so a list with a third of all rows is many cells; none is
capped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, ship
from .vector_dedup import valid

SAMPLE, PER_LIST, MAX_LISTS, RECALL = 16_384, 400, 1024, 0.985
BLOCK, EPSILON, ROW_TILE, QUERY_TILE, CHUNK, SEED = 16, 2.1, 32_768, 256, 512, 99


def _packed(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), "<f8").reshape(len(col), -1)


def augment(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0.0))
    return np.concatenate([x, rest[:, None]], axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    c = x[np.sort(rng.choice(len(x), size=k, replace=False))]
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centroids of each row, nearest first."""
    out = []
    for a in range(0, len(x), 4096):
        d = (c * c).sum(axis=1)[None, :] - 2 * x[a : a + 4096] @ c.T
        out.append(np.argsort(d, axis=1, kind="stable")[:, :k] if k > 1 else d.argmin(axis=1)[:, None])
    return np.concatenate(out) if out else np.zeros((0, k), dtype=np.int64)


def probes_for(x: np.ndarray, longest: float, c: np.ndarray, k: int, recall: float = RECALL) -> int:
    """How many lists hold `recall` of the true neighbours of some sampled queries, by brute force on the sample."""
    if len(c) == 1 or len(x) <= k:
        return len(c)
    q = np.linspace(0, len(x) - 1, min(400, len(x))).astype(int)
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -np.inf
    top = np.argpartition(-s, min(k, len(x) - 1) - 1, axis=1)[:, :k]
    home = nearest(augment(x, longest), c, 1)[:, 0]
    zero = np.concatenate([x[q], np.zeros((len(q), 1))], axis=1)
    order = nearest(zero, c, len(c))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(len(c)), order.shape), axis=1)
    need = np.sort(np.take_along_axis(place, home[top], axis=1).ravel())
    return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1


def scan(qn: np.ndarray, qi: np.ndarray, q: np.ndarray, xn: np.ndarray, xi: np.ndarray, x: np.ndarray, longest: float, rotation: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of a cell's rows for each of its queries, known by row number (qn, xn) and id (qi, xi), rows taken in the order given. Pairs are abandoned by the
    test, block by block; while most pairs of a chunk are alive a block is one product, after that only theirs."""
    dim = rotation.shape[0]
    ry, rq = augment(x, longest) @ rotation, np.concatenate([q, np.zeros((len(q), 1))], axis=1) @ rotation
    bounds = [(a, min(dim, a + BLOCK)) for a in range(0, dim, BLOCK)]
    if len(bounds) > 1 and bounds[-1][1] - bounds[-1][0] < BLOCK // 2:  # a short rest joins the block before it
        bounds[-2:] = [(bounds[-2][0], dim)]
    blocks = [np.ascontiguousarray(ry[:, a:b]) for a, b in bounds]
    squares = [(b * b).sum(axis=1) for b in blocks]
    best_s = np.full((len(q), k), -np.inf)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max)
    norm = (q * q).sum(axis=1) + longest**2  # distance**2 = norm - 2 * inner product
    slack = 1e-9 * norm

    def offer(pq: np.ndarray, px: np.ndarray, s: np.ndarray):
        """Take pairs (sorted by query) into the best of each query."""
        if not len(pq):
            return
        rows, n = np.unique(pq, return_counts=True)
        at = np.arange(len(pq)) - np.repeat(np.cumsum(n) - n, n)
        place = np.repeat(np.arange(len(rows)), n)
        cs, ci = np.full((len(rows), int(n.max())), -np.inf), np.full((len(rows), int(n.max())), np.iinfo(np.int64).max)
        cs[place, at], ci[place, at] = s, xi[px]
        cs, ci = np.concatenate([best_s[rows], cs], axis=1), np.concatenate([best_i[rows], ci], axis=1)
        order = np.lexsort((ci, -cs), axis=1)[:, :k]
        best_s[rows], best_i[rows] = np.take_along_axis(cs, order, 1), np.take_along_axis(ci, order, 1)

    for a in range(0, len(x), CHUNK):
        rows = np.arange(a, min(len(x), a + CHUNK))
        kth = best_s[:, -1]
        limit = np.where(np.isfinite(kth), np.maximum(norm - 2 * kth, 0.0) + slack, np.inf)
        part = np.zeros((len(q), len(rows)))
        pq = px = pairs = None
        for (lo, hi), block, square in zip(bounds, blocks, squares):
            own = rq[:, lo:hi]
            test = limit * ((1 + EPSILON / np.sqrt(hi)) ** 2 * hi / dim if hi < dim else 1.0)
            if pq is None:
                part += (own * own).sum(axis=1)[:, None] + square[rows][None, :] - 2 * own @ block[rows].T
                alive = part <= test[:, None]
                if alive.mean() < 0.2:
                    pq, px = np.nonzero(alive)
                    pairs = part[pq, px]
            else:
                diff = own[pq] - block[rows[px]]
                pairs = pairs + np.einsum("ij,ij->i", diff, diff)
                stay = pairs <= test[pq]
                pq, px, pairs = pq[stay], px[stay], pairs[stay]
        if pq is None:
            pq, px = np.nonzero(alive)
        px = rows[px]
        other = qn[pq] != xn[px]
        pq, px = pq[other], px[other]
        s = np.einsum("ij,ij->i", q[pq], x[px])
        stay = s >= kth[pq]
        offer(pq[stay], px[stay], s[stay])
    r, c = np.nonzero(np.isfinite(best_s))
    return pd.DataFrame({"qn": qn[r], "query_id": qi[r], "vec_id": best_i[r, c], "score": best_s[r, c]})


def search(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", is_query=None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query row among all other rows.

    Nearness is the inner product in double precision; ties go to the smaller id. Vectors that are null, zero or hold
    null or non-finite components take no part, nor do rows with a null id; all vectors are expected to have the length
    most rows have, others take no part. Rows that share an id are candidates and queries of their own. With fewer than k candidates a
    query gets all of them. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    query = (F.col("id") % 20 == 0) if is_query is None else is_query
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    v = v.where(valid(F.col("x")) & F.col("id").isNotNull())
    dims = v.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if dims is None:
        return spark.createDataFrame([], schema)
    v = v.where(F.size("x") == dims["d"])
    n = dims["count"]
    square = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    longest = float(np.sqrt(v.agg(F.max(square)).first()[0]) * (1 + 1e-12))
    sample = np.array([r.x for r in v.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
    lists = max(1, min(MAX_LISTS, n // PER_LIST, len(sample) // 8))
    c = kmeans(augment(sample, longest), lists)
    probes = probes_for(sample, longest, c, k)
    rotation = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims["d"] + 1,) * 2))[0]

    def index(frames):
        for f in frames:
            x = np.stack(f["x"].to_numpy()) if len(f) else np.zeros((0, dims["d"]))
            yield pd.DataFrame({"n": f["n"], "id": f["id"], "list": nearest(augment(x, longest), c, 1)[:, 0].astype("int32"), "q": f["q"], "x": [r.astype("<f8").tobytes() for r in x]})

    # n numbers the rows; frozen with the table
    numbered = v.select(F.monotonically_increasing_id().alias("n"), "id", "x", query.alias("q"))
    rows = durable(numbered.mapInPandas(index, "n long, id long, list int, q boolean, x binary"))

    # Queries of near lists go into one tile: lists in the order of their centroids along the main axis, cut into tiles
    # of QUERY_TILE queries; a list with more is dealt over several by hash. One row a list (MAX_LISTS at most).
    axis = np.linalg.svd(c - c.mean(axis=0), full_matrices=False)[2][0] if lists > 1 else np.ones(c.shape[1])
    held = {r.list: (r.m, r.asking) for r in rows.groupBy("list").agg(F.count(F.lit(1)).alias("m"), F.count_if("q").alias("asking")).collect()}
    asking, sizes = {i: a for i, (_, a) in held.items()}, np.array([held.get(i, (0, 0))[0] for i in range(lists)])
    tile_of, tile, room = [], 0, QUERY_TILE
    for i in np.argsort(c @ axis, kind="stable").tolist():
        m = asking.get(i, 0)
        if m > room and room < QUERY_TILE:
            tile, room = tile + 1, QUERY_TILE
        parts = max(1, -(-m // QUERY_TILE))
        tile_of.append((i, tile, parts))
        if parts > 1:
            tile, room = tile + parts, QUERY_TILE
        else:
            room -= m
    deal = F.broadcast(spark.createDataFrame(tile_of, "list int, tile int, parts int"))
    queries = rows.where("q").join(deal, "list").withColumn("tile", (F.col("tile") + F.pmod(F.xxhash64("n"), F.col("parts"))).cast("int")).select("n", "id", "x", "tile")

    def probe(frames):
        for f in frames:
            x = _packed(f["x"]) if len(f) else np.zeros((0, dims["d"]))
            zero = np.concatenate([x, np.zeros((len(x), 1))], axis=1)
            near = nearest(zero, c, probes)
            if len(x) and probes < lists and (sizes[near].sum(axis=1) <= k).any():
                # small lists: every query goes on until its lists hold k rows besides its own, or there are no more
                every = nearest(zero, c, lists)
                near = every[:, : max(probes, int((np.cumsum(sizes[every], axis=1) <= k).sum(axis=1).max()) + 1)]
            d = pd.DataFrame({"tile": np.repeat(f["tile"].to_numpy(), near.shape[1]), "list": near.ravel().astype("int32"), "place": np.tile(np.arange(near.shape[1], dtype=np.int32), len(x))})
            yield d.groupby(["tile", "list"], as_index=False)["place"].min()

    # Which lists a tile's queries probe, and how early. All of a tile's queries then scan all of its lists.
    wanted = queries.mapInPandas(probe, "tile int, list int, place int").groupBy("tile", "list").agg(F.min("place").alias("place"))
    groups = max(1, -(-n // ROW_TILE))
    rowside = rows.select("n", "id", "x", "list", F.pmod(F.xxhash64("n"), F.lit(groups)).cast("int").alias("g"))
    left = rowside.join(wanted, "list").select("n", "id", "x", "tile", "g", "place")
    right = queries.select(F.col("n").alias("qn"), F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("tile").alias("qt"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("qg"))

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"qn": [], "query_id": [], "vec_id": [], "score": []})
        a = a.sort_values(["place", "id"], kind="stable")
        return scan(b["qn"].to_numpy(), b["qid"].to_numpy(), _packed(b["qx"]), a["n"].to_numpy(), a["id"].to_numpy(), _packed(a["x"]), longest, rotation, k)

    found = left.groupBy("tile", "g").cogroup(right.groupBy("qt", "qg")).applyInPandas(cell, "qn long, query_id long, vec_id long, score double")
    w = Window.partitionBy("qn").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op6_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
