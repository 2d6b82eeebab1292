"""N-gram Jaccard join by universe-partition pigeonhole.

A document's set holds the hashes of its distinct five-word shingles. For sets x, y of Jaccard similarity >= 3/4 the
symmetric difference is at most H = floor((|x| + |y|) / 7). Sizes fall into bands that grow by 4/3, so partners are in
one band or in neighbouring ones; scheme k serves band k with itself and with band k + 1. Each scheme partitions the
universe of hashes into m segments, more than any of its H. Then some segments of x and y are equal, and a set that
publishes the hash of each segment's subset meets every partner, provided that more of its segments are non-empty than
H, so that not all equal ones can be empty.

Allocation is by cost: the cheap exact subsets alone where they cover H; where a set has too many empty segments, the
one-deletion neighbourhoods of its segments too, which count twice (a segment with one difference meets as well); and
where even that does not cover H, one signature for the scheme. Of two partners either one is covered by its own
segments, or both publish the neighbourhoods. So no link is lost; candidates are verified exactly.

Equal sets are one node from the start. Signatures travel packed: a chunk of documents sends each range of the
signatures one sorted array. As at most H of a set's non-empty segments differ from a partner's, each node leaves out its
commonest signatures as far as that bound has slack. What components need is connectivity: lists with one leading node
are a group, each node is first verified with a leader, and only pairs of a group in different components go on. These are
held against one another where they meet, cell by cell, by sketches that bound the difference of two sets from below;
the few pairs left are verified on the sets. So a group of thousands of near copies, or of texts that share a long
passage, sends on about its size, not its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable, release, ship, tidy
from .common import give_back, hash_words, mix64
from .components import components

N, CHUNK = 5, 2000
PER_RANGE = 3_000_000
#: Nodes of a tile: at least SPREAD, so that middling groups give many cells, at most TILE; bytes of its sketches.
SPREAD, TILE, CELL_BYTES = 256, 4096, 16_000_000
#: Bounds of the size bands: each at least 4/3 of the one before.
BANDS = [3]
while BANDS[-1] < 1 << 40:
    BANDS.append(max(BANDS[-1] + 1, -(-4 * BANDS[-1] // 3)))
_BANDS = np.array(BANDS)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; with fewer words the whole sequence; without words, none."""
    h = hash_words(text)
    if not len(h):
        return h
    n = min(N, len(h))
    k = np.uint64(0x9FB21C651E98DF25)
    out = np.full(len(h) - n + 1, np.uint64(n))
    with np.errstate(over="ignore"):
        for i in range(n):
            out = (out ^ (out >> np.uint64(29))) * k + h[i : len(h) - n + 1 + i]
    return np.unique(mix64(out))


def node_of(s: np.ndarray) -> int:
    """The identity of a set: equal sets are one node. Signed 64 bits."""
    with np.errstate(over="ignore"):
        a = mix64(s * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(mix64(np.array([a]))[0].astype(np.int64))


def segments(k: int) -> int:
    """How many segments scheme k has: a quarter more than the largest difference needs."""
    h = (BANDS[k + 1] - 1) // 3
    return h + 1 + -(-h // 4)


def signatures(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """All signatures of a set (64 bits each), the role of each (0 where the set is of the scheme's own band, 1 where of
    the band above), and the slack of each role: how many of its non-empty segments the set can do without."""
    n = len(s)
    if n < 3:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64), [0, 0]
    band = int(np.searchsorted(_BANDS, n, side="right")) - 1
    mixed, top = mix64(s), s >> np.uint64(32)
    out, roles, slack = [], [], [0, 0]
    for role, k in enumerate((band, band - 1)):
        if k < 0:
            continue
        m, h = segments(k), n // 3 if role == 0 else (n + BANDS[k + 1] - 1) // 7
        tag = np.uint64(((k + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        with np.errstate(over="ignore"):
            # Segments are equal ranges of the hashes, so a sorted set falls into runs.
            seg = (top * np.uint64(m)) >> np.uint64(32)
            first = np.flatnonzero(np.diff(seg, prepend=np.uint64(1 << 63)))
            sums = np.add.reduceat(mixed, first)
            base = mix64(tag + (seg[first] + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
            own = [mix64(sums ^ base)]
            slack[role] = max(0, len(first) - h - 1)
            if len(first) <= h:  # too many empty segments: the one-deletion neighbourhoods as well
                size = np.diff(np.append(first, n))
                big = np.repeat(size >= 2, size)
                own.append(mix64((np.repeat(sums, size) - mixed) ^ np.repeat(base, size))[big])
                if 2 * int((size >= 2).sum()) + int((size == 1).sum()) <= h:
                    own.append(mix64(np.array([tag])))
        out += own
        roles += [np.full(len(x), role, dtype=np.uint64) for x in own]
    return np.concatenate(out), np.concatenate(roles), slack


def pack_set(s: np.ndarray) -> bytes:
    """A sorted set as the differences of its elements, byte plane by byte plane; the upper planes compress away."""
    return np.diff(s, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_set(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def sketch_bits(band: int) -> int:
    """Four to eight bits for each element of the largest set of the band; a power of two."""
    return max(64, 1 << (4 * BANDS[band + 1] - 1).bit_length())


def sketch(s: np.ndarray) -> bytes:
    """One bit for each of many narrow segments: the parity of the set's elements there. Every element that is in one of
    two sets only turns one bit, so two sketches differ in at most as many bits as the sets differ in elements."""
    bits = sketch_bits(int(np.searchsorted(_BANDS, len(s), side="right")) - 1) if len(s) >= 3 else 64
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(b: bytes, size: int) -> bytes:
    """The sketch of the same set with `size` bytes: bits that fall together are added."""
    x = np.frombuffer(b, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, in whole numbers."""
    both = np.concatenate([a, b])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= 75 * (len(a) + len(b) - inter) and inter > 0


MET = "what int, a long, b long, c long, d long, e long, f int, k long"
TWO, LIST, ROW = 0, 1, 2


def _published(docs: DataFrame, ranges: int) -> DataFrame:
    """What a chunk of documents sends to each range: packed (sorted: 48 bits of signature, a role, 15 bits of node), the
    nodes with sizes and slacks; and to one range the id, node and size of its rows."""
    top = (1 << 64) // ranges + 1

    def run(batches):
        give_back()
        seen: set[int] = set()
        for b in batches:
            all_ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for c in range(0, len(texts), CHUNK):
                packed, nodes, sizes, slacks, row_node, row_size = [], [], [], [], [], []
                for t in texts[c : c + CHUNK]:
                    s = shingles(t)
                    node = node_of(s) if len(s) else None
                    row_node.append(node)
                    row_size.append(len(s))
                    if node is None or node in seen:  # equal sets of a task publish once
                        continue
                    if len(seen) > 2_000_000:
                        seen.clear()
                    seen.add(node)
                    g, role, slack = signatures(s)
                    packed.append((g & ~np.uint64(0xFFFF)) | (role << np.uint64(15)) | np.uint64(len(nodes)))
                    nodes.append(node)
                    sizes.append(len(s))
                    slacks.append(slack)
                p = np.sort(np.concatenate(packed)) if packed else np.zeros(0, np.uint64)
                cut = np.searchsorted(p, np.array([min(i * top, (1 << 64) - 1) for i in range(ranges + 1)], dtype=np.uint64))
                cut[-1] = len(p)
                nodes, info = np.array(nodes, dtype=np.int64), np.array([(z, *x) for z, x in zip(sizes, slacks)], dtype=np.int32).reshape(-1, 3)
                home = (hash((c, len(p), all_ids[c])) & 0x7FFFFFFF) % ranges
                rows = [(home, b"", b"", b"", all_ids[c : c + CHUNK], row_node, row_size)]
                for i, (x, y) in enumerate(zip(cut[:-1], cut[1:])):
                    if y > x:
                        own = p[x:y]
                        number = (own & np.uint64(0x7FFF)).astype(np.int64)
                        used = np.unique(number)
                        to = np.zeros(len(nodes), dtype=np.uint64)
                        to[used] = np.arange(len(used), dtype=np.uint64)
                        rows.append((i, ((own & ~np.uint64(0x7FFF)) | to[number]).tobytes(), nodes[used].tobytes(), info[used].tobytes(), [], [], []))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)), *(pa.array([r[k] for r in rows], longs) for k in (4, 5, 6))], names=["rng", "packed", "nodes", "info", "ids", "row_node", "row_size"])
        seen.clear()
        give_back()

    return docs.mapInArrow(run, "rng int, packed binary, nodes binary, info binary, ids array<bigint>, row_node array<bigint>, row_size array<bigint>")


def _met(t: pa.Table) -> pa.Table:
    """One range. TWO (signatures of two nodes): a, b the nodes, c how many signatures. LIST (signatures of three nodes or
    more; equal lists are one): a the list, b a node, c how many signatures, d size, e slack, f role, k nodes in all.
    ROW: a id, b node, c size."""
    flat = lambda name: t[name].combine_chunks().flatten()
    rows = [(ROW, flat("ids"), flat("row_node"), flat("row_size"), None, None, None, None)]
    sig, role, at, nodes, info, base = [], [], [], [], [], 0
    for p, n, z in zip(t["packed"].to_pylist(), t["nodes"].to_pylist(), t["info"].to_pylist()):
        if p:
            p, n = np.frombuffer(p, np.uint64), np.frombuffer(n, np.int64)
            sig.append(p >> np.uint64(16))
            role.append(((p >> np.uint64(15)) & np.uint64(1)).astype(np.int8))
            at.append((p & np.uint64(0x7FFF)).astype(np.int64) + base)
            nodes.append(n)
            info.append(np.frombuffer(z, np.int32).reshape(-1, 3))
            base += len(n)
    if sig:
        sig, role, at, nodes, info = map(np.concatenate, (sig, role, at, nodes, info))
        nodes, one, inverse = np.unique(nodes, return_index=True, return_inverse=True)
        info, at = info[one].astype(np.int64), inverse[at]
        low = sig.min()
        sig -= low
        bits = max(1, int(len(nodes) - 1).bit_length())
        if int(sig.max()).bit_length() + 1 + bits <= 64:
            # signature, node and role fit one number: sorted in place, told apart again after
            key = (sig << np.uint64(bits + 1)) | (at.astype(np.uint64) << np.uint64(1)) | role.astype(np.uint64)
            del sig, at, role
            key.sort()
            role, at = (key & np.uint64(1)).astype(np.int8), ((key >> np.uint64(1)) & np.uint64((1 << bits) - 1)).astype(np.int64)
            sig = key >> np.uint64(bits + 1)
            del key
        else:
            order = np.lexsort((at, sig))
            sig, at, role = sig[order], at[order], role[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (at[1:] != at[:-1])])  # equal sets of other tasks
        sig, at, role = sig[new], at[new], role[new]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        count = np.diff(np.append(first, len(sig)))
        keep = count >= 2
        scheme = np.searchsorted(_BANDS, info[at[first], 0], side="right") - 1 - role[first]
        with np.errstate(over="ignore"):
            content = np.add.reduceat(mix64(nodes[at].astype(np.uint64)), first) + mix64(scheme.astype(np.uint64) + np.uint64(1))
        first, count, content, scheme = first[keep], count[keep], content[keep], scheme[keep]
        content, one, times = np.unique(content, return_index=True, return_counts=True)
        first, count, scheme = first[one], count[one], scheme[one]
        spread = lambda which: np.concatenate([np.arange(first[i], first[i] + count[i]) for i in which]).astype(np.int64) if len(which) else np.zeros(0, np.int64)
        pair = np.flatnonzero(count == 2)
        u, v = at[first[pair]], at[first[pair] + 1]
        ok = 4 * np.minimum(info[u, 0], info[v, 0]) >= 3 * np.maximum(info[u, 0], info[v, 0])
        rows.append((TWO, nodes[u[ok]], nodes[v[ok]], times[pair][ok], None, None, None, None))
        long = np.flatnonzero(count >= 3)
        e = spread(long)
        n, of = at[e], np.repeat(long, count[long])
        rows.append((LIST, content[of].astype(np.int64), nodes[n], times[of], info[n, 0], info[n, 1 + role[e]], (2 * scheme[of] + role[e]).astype(np.int32), count[of]))
    out = []
    for what, *cols in rows:
        n = len(cols[0])
        arrays = [pa.array(np.full(n, what, np.int32))] + [pa.nulls(n, pa.int32() if i == 5 else pa.int64()) if x is None else x if isinstance(x, pa.Array) else pa.array(x) for i, x in enumerate(cols)]
        out.append(pa.Table.from_arrays(arrays, names=["what", "a", "b", "c", "d", "e", "f", "k"]))
    give_back()
    return pa.concat_tables(out)


def _cell(u, c, size, up, tile, sketches, i: int, j: int):
    """Pairs of rows of tile i with rows of tile j in different components, of fitting sizes, and whose sketches differ
    in no more bits than similar sets may differ in elements. Arrays (u, v), u < v."""
    a, b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
    for k in range(0, len(a), 128):
        x = a[k : k + 128]
        ok = (c[x][:, None] != c[b]) & ~(up[x][:, None] & up[b]) & (4 * size[x][:, None] >= 3 * size[b]) & (4 * size[b] >= 3 * size[x][:, None])
        if i == j:
            ok &= u[x][:, None] < u[b]
        p, q = np.nonzero(ok)
        step = max(1, (1 << 21) // sketches.shape[1])
        for m in range(0, len(p), step):
            y, z = x[p[m : m + step]], b[q[m : m + step]]
            near = np.bitwise_count(sketches[y] ^ sketches[z]).sum(axis=1, dtype=np.int64) <= (size[y] + size[z]) // 7
            y, z = u[y[near]], u[z[near]]
            if len(y):
                yield np.minimum(y, z), np.maximum(y, z)


def _crossed(grouped: DataFrame, packed: DataFrame) -> DataFrame:
    """grouped: lead, scheme, u, size, up, c, one row for each node of a group. packed: _n, k (sketch). The pairs (u, v) of
    a group's nodes that are in different components and may be similar, by size and sketch.

    A group is cut into tiles by a hash of the node, and each pair of tiles is a cell of its own, so no group has to fit
    a task; all that a cell sends on is pairs that survive the sketches.
    """
    spark = grouped.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    many = grouped.groupBy("lead", "scheme").agg(F.count(F.lit(1)).alias("g"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1")
    # a cell holds two tiles of sketches: wide ones make small tiles
    most = F.greatest(F.lit(16), F.floor(F.lit(CELL_BYTES) / F.pow(F.lit(4 / 3), F.col("scheme") + F.lit(4))))
    tiles = F.ceil(F.col("g") / F.least(most, F.greatest(F.lit(SPREAD), F.least(F.lit(TILE), F.ceil(F.col("g") / SPREAD))))).cast("int")
    many = durable(many.select(F.col("lead").alias("_lead"), F.col("scheme").alias("_scheme"), tiles.alias("tiles")))
    d = grouped.join(many, (F.col("lead") == F.col("_lead")) & (F.col("scheme") == F.col("_scheme"))).drop("_lead", "_scheme")
    d = d.join(packed.select("_n", "k"), F.col("u") == F.col("_n")).drop("_n")
    d = d.withColumn("tile", F.pmod(F.xxhash64("u"), "tiles").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    d = d.select("lead", "scheme", F.least("o", "tile").alias("i"), F.greatest("o", "tile").alias("j"), "tile", "u", "size", "up", "c", "k")
    d = d.repartition(width, "lead", "scheme", "i", "j").sortWithinPartitions("lead", "scheme", "i", "j", "u")

    def pairs(batches):
        keys, carry, out, n = ["lead", "scheme", "i", "j"], None, [], 0

        def take(t: pa.Table):
            nonlocal n
            u, c, size, up, tile = (t[x].to_numpy() for x in ("u", "c", "size", "up", "tile"))
            i, j, scheme = t["i"][0].as_py(), t["j"][0].as_py(), t["scheme"][0].as_py()
            width = sketch_bits(scheme) // 8
            sketches = np.frombuffer(b"".join(fold(k, width) for k in t["k"].to_pylist()), np.uint64).reshape(len(u), -1)
            for p in _cell(u, c, size, up > 0, tile, sketches, i, j):
                out.append(p)
                n += len(p[0])

        def send():
            nonlocal n
            if out:
                u, v = (np.concatenate([p[x] for p in out]) for x in (0, 1))
                out.clear()
                n = 0
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if carry is None else pa.concat_tables([carry, pa.Table.from_batches([b])]).combine_chunks()
            cells = np.stack([t[x].to_numpy() for x in keys], axis=1)
            edge = (np.flatnonzero((cells[1:] != cells[:-1]).any(axis=1)) + 1).tolist()
            for x, y in zip([0, *edge], edge):
                if y - x > 1:
                    take(t.slice(x, y - x))
                if n >= 1 << 16:
                    yield from send()
            carry = t.slice(edge[-1] if edge else 0)
        if carry is not None and carry.num_rows > 1:
            take(carry)
        yield from send()
        carry = None
        give_back()

    return d.mapInArrow(pairs, "u long, v long").distinct()


def _packed(docs: DataFrame, sets: DataFrame, need: DataFrame) -> DataFrame:
    """_n, s (packed set), k (sketch) of the nodes in need (column _n). The texts are looked up once, by one row of each
    node: equal sets have different texts at most in white space and case."""
    rows = sets.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("_rid")).join(need, F.col("node") == F.col("_n"), "left_semi")
    texts = docs.join(rows, F.col("id") == F.col("_rid")).select("node", "text")

    def pack(batches):
        seen: set[int] = set()
        for b in batches:
            node, packed, sketches = [], [], []
            for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(t)
                own = node_of(s) if len(s) else None
                if own is not None and own not in seen and (n is None or own == n):  # rows may share an id
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(own)
                    node.append(own)
                    packed.append(pack_set(s))
                    sketches.append(sketch(s))
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(packed, pa.binary()), pa.array(sketches, pa.binary())], names=["_n", "s", "k"])
        give_back()

    kind = "_n long, s binary, k binary"
    # a null id finds no text: the nodes of those rows are made again from their texts
    lost = docs.where("id IS NULL AND text IS NOT NULL").select(F.lit(None).cast("long").alias("node"), "text").mapInArrow(pack, kind)
    lost = lost.join(rows.where("_rid IS NULL").select(F.col("node").alias("_l")), F.col("_n") == F.col("_l"), "left_semi").dropDuplicates(["_n"])
    out = durable(texts.mapInArrow(pack, kind).unionByName(lost))
    tidy(docs.sparkSession)
    return out


def _verified(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""
    j = pairs.join(packed.select(F.col("_n").alias("_a"), F.col("s").alias("sa")), F.col("u") == F.col("_a")).drop("_a")
    j = j.join(packed.select(F.col("_n").alias("_b"), F.col("s").alias("sb")), F.col("v") == F.col("_b")).drop("_b")

    def check(batches):
        for b in batches:
            ok = [similar(unpack_set(x), unpack_set(y)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))
        give_back()

    out = durable(j.select("u", "v", "sa", "sb").mapInArrow(check, "u long, v long"))
    tidy(pairs.sparkSession)
    return out


def _rarest(met: DataFrame) -> DataFrame:
    """list, u, n (its signatures), size, role, scheme, k (nodes of the list), without each node's commonest lists as far
    as its slack goes.

    Partners share more signatures than the slack of either. Both leave out the first ones in the same order, so the
    rarest one that they share is left out by neither.
    """
    of = met.where(F.col("what") == LIST).select(F.col("a").alias("list"), F.col("b").alias("u"), F.col("c").alias("n"), F.col("d").alias("size"), F.col("e").alias("slack"), (F.col("f") % 2).alias("role"), F.shiftright("f", 1).alias("scheme"), "k")
    lists = of.repartition("u").groupBy("u", "list").agg(F.sum("n").alias("n"), *(F.max(x).alias(x) for x in ("size", "slack", "role", "scheme", "k")))
    common = Window.partitionBy("u", "role").orderBy(F.desc("k"), "list").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lists.withColumn("before", F.sum("n").over(common)).where("before > slack").drop("before", "slack")


def jaccard_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id of every row.

    Documents link when 100 * intersection >= 75 * union of their shingle sets. Null or empty texts, and texts without
    words, have an empty set, link with nothing and are their own component. Rows that share an id stay rows; a null id
    takes part but is never a component's name unless all ids in it are null. Ties do not matter: components are named
    by the smallest id.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // 7 // PER_RANGE))
    met = durable(_published(docs, ranges).groupBy("rng").applyInArrow(_met, MET))
    tidy(spark)
    sets = met.where(F.col("what") == ROW).select(F.col("a").alias("id"), F.col("b").alias("node"), F.col("c").alias("size"))
    twos = durable(met.where(F.col("what") == TWO).groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.sum("c").alias("n")))
    lists = durable(_rarest(met))
    # The leader of a list is its node that shares most with all others: of near copies of a text, that text itself.
    degree = lists.groupBy(F.col("u").alias("_u")).agg(F.sum(F.col("n") * F.col("k")).alias("degree"))
    led = lists.join(degree, F.col("u") == F.col("_u")).groupBy(F.col("list").alias("_l")).agg(F.max(F.struct("degree", "u", "size")).alias("m"), F.count(F.lit(1)).alias("left")).where("left > 1").select("_l", F.col("m.u").alias("lead"), F.col("m.size").alias("ls"))
    # Lists of one leader and scheme hold much the same nodes: they are one group.
    groups = lists.join(led, F.col("list") == F.col("_l")).groupBy("lead", "scheme", "u").agg(F.sum("n").alias("n"), F.max("size").alias("size"), F.max("role").alias("up"), F.max("ls").alias("ls"))
    groups = durable(groups)
    tidy(spark)
    need = groups.select(F.col("u").alias("_n")).unionByName(twos.select(F.col("u").alias("_n"))).unionByName(twos.select(F.col("v").alias("_n"))).distinct()
    packed = _packed(docs, sets, need)
    # First each node with the leader it meets most often; that connects most of a group of near copies.
    meets = groups.where("u <> lead AND 4 * size >= 3 * ls AND 4 * ls >= 3 * size").groupBy("u", F.col("lead").alias("v")).agg(F.sum("n").alias("n"))
    meets = meets.unionByName(twos).unionByName(twos.select(F.col("v").alias("u"), F.col("u").alias("v"), "n"))
    first = meets.groupBy("u").agg(F.max(F.struct("n", "v")).alias("m")).select(F.least("u", "m.v").alias("_a"), F.greatest("u", "m.v").alias("v")).select(F.col("_a").alias("u"), "v")
    first = durable(first.distinct())
    links = _verified(first, packed)
    comp = durable(components(links))
    # Then what a group's nodes in different components may still be, and pairs that share a signature of two.
    name = comp.select(F.col("id").alias("_id"), "component")
    grouped = durable(groups.join(name, F.col("u") == F.col("_id"), "left").select("lead", "scheme", "u", "size", "up", F.coalesce("component", "u").alias("c")))
    ends = twos.join(name, F.col("u") == F.col("_id"), "left").select("u", "v", F.coalesce("component", "u").alias("uc"))
    ends = ends.join(name, F.col("v") == F.col("_id"), "left").where(F.col("uc") != F.coalesce("component", "v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    more = durable(_crossed(grouped, packed).unionByName(ends).distinct().join(first, ["u", "v"], "left_anti"))
    tidy(spark)
    if not more.isEmpty():
        links = durable(links.unionByName(_verified(more, packed)))
        comp = durable(components(links))
    for x in (packed, lists, groups, grouped, twos, first, more):
        release(x)
    named = sets.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"))
    named = durable(named.join(comp, F.col("node") == F.col("id"), "left").select("node", "least", F.coalesce("component", "node").alias("c")))
    tops = named.groupBy("c").agg(F.min("least").alias("top")).select(F.col("c").alias("_c"), "top")
    of = durable(named.join(tops, F.col("c") == F.col("_c")).select(F.col("node").alias("_node"), "top"))
    out = sets.join(of, F.col("node") == F.col("_node"), "left")
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("top", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the smallest id. Rows with a null id stay."""
    keep = jaccard_components(docs, id_col, text_col).where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_keep")).distinct()
    kept = docs.join(keep, F.col(id_col) == F.col("_keep"), "left_semi")
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
