"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are chosen far apart from each other out of a bounded
sample of ``SAMPLE`` vectors; every vector is then described by its ``LIST`` nearest
pivots. A pair is a candidate when its label is equal and the two lists share at
least ``SHARED`` pivots, and linked when its cosine in double precision reaches the
threshold. The index is approximate only in that count: over random directions in
64 dimensions a pair at cosine 0.93 shares three of eight out of 256 pivots with
probability 0.994, at 0.95 with 0.997 (``tests/llm/test_pivots.py`` measures it).

Retrieval is by inverted lists. Two lists that share ``SHARED`` pivots share one
among the first ``LIST - SHARED + 1`` of each in any common order, so only those are
posted (pivots that are rare in the sample first). A posting list of more than
``CELL`` vectors is refined by the next shared pivot, and one that stays larger is
dealt into blocks that meet pairwise. Each pair counts only where its first shared
pivots name the list it meets in. A list hands on link counts and a spanning forest of
its links, never its pairs, so a large group of near copies costs matrix products but
no rows. Equal vectors of a label fold to one before all this.

Null, empty and zero vectors, vectors with null or non-finite components, vectors
without label and vectors whose length is not the most common one (the longer of
equally common ones) link with nothing. Repeated rows are vectors of their own and
link with each other. A null id never names a component unless it is alone in it
(then the component is null). An empty table gives an empty result. Other columns
are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import common_length, drop_stage, finite, give_back, matrix, stage
from .simhash import components

COSINE = 0.93
#: vectors of the sample that pivots are chosen from
SAMPLE = 4096
PIVOTS = 256
LIST = 8
SHARED = 3
#: longest posting list that one task compares at once
CELL = 2048
#: a join side of at most so many rows is broadcast
SMALL = 200_000


# ---- pivots ---------------------------------------------------------------------
def choose_pivots(sample: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Unit vectors, each the one farthest from those before it, rare ones in the sample first."""
    unit = sample / np.linalg.norm(sample, axis=1)[:, None]
    count = min(most, len(unit), max(LIST, len(unit) // 8))
    chosen = [0]
    nearest = unit @ unit[0]
    while len(chosen) < count:
        nxt = int(np.argmin(nearest))
        chosen.append(nxt)
        nearest = np.maximum(nearest, unit @ unit[nxt])
    pivots = unit[chosen]
    used = np.bincount(nearest_pivots(unit, pivots).ravel(), minlength=count)
    return pivots[np.lexsort((np.arange(count), used))]


def nearest_pivots(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of the nearest pivots of every row, in ascending number."""
    near = np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :LIST]
    return np.sort(near, axis=1).astype(np.int16)


def describe(nodes: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``nodes`` with ``pivots``: their nearest pivots in the common order of all lists."""
    names = nodes.columns
    at = names.index("vector")
    width = pivots.shape[1]

    def run(batches):
        for batch in batches:
            flat = matrix(batch.column(at), width)
            # largest entry first: squares of very small or large entries stay in range
            flat = flat / np.abs(flat).max(axis=1, keepdims=True, initial=0)
            near = nearest_pivots(flat / np.linalg.norm(flat, axis=1)[:, None], pivots)
            edges = np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*names, "pivots"])

    schema = T.StructType([*nodes.schema.fields, T.StructField("pivots", T.ArrayType(T.ShortType()))])
    return nodes.mapInArrow(run, schema)


# ---- inverted lists -------------------------------------------------------------
def _with_sizes(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``rows`` with ``large``: how many rows share ``keys``, null up to ``most``."""
    large = stage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("large")).filter(F.col("large") > most), "pivot-large")
    few = large.count() <= SMALL
    return rows.join(F.broadcast(large) if few else large, keys, "left")


def inverted_lists(described: DataFrame, needed: int, most: int = CELL) -> DataFrame:
    """``(label, p, q, i, j, block)`` and the columns of ``described`` for each list a vector is in.

    ``q`` is -1 unless the list of ``p`` was refined; ``i`` and ``j`` are the blocks
    that meet there, ``block`` is the vector's own.
    """
    posted = F.size("pivots") - F.lit(needed) + 1
    first = described.select("*", F.explode(F.slice("pivots", F.lit(1), posted)).alias("p"))
    first = _with_sizes(first, ["label", "p"], most)
    later = F.filter(F.slice("pivots", F.lit(1), posted + 1), lambda q: q > F.col("p"))
    q = F.explode(F.when(F.col("large").isNull(), F.array(F.lit(-1).cast("short"))).otherwise(later))
    second = _with_sizes(first.select(*described.columns, "p", q.alias("q")), ["label", "p", "q"], most)
    blocks = F.coalesce(F.ceil(F.col("large") / F.lit(most)), F.lit(1)).cast("int")
    second = second.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = second.select(*described.columns, "p", "q", "block", other)
    return met.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other")


def _bits(lists: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros((len(lists), words), np.uint64)
    for c in range(lists.shape[1]):
        at = lists[:, c].astype(np.int64)
        out[np.arange(len(lists)), at >> 6] |= np.uint64(1) << (at & 63).astype(np.uint64)
    return out


def _candidates(a: np.ndarray, b: np.ndarray, p: int, q: int, needed: int) -> np.ndarray:
    """Pairs that share enough pivots and whose first shared ones are ``p`` (and ``q``)."""
    last = q if q >= 0 else p
    shared = np.zeros((len(a), len(b)), np.uint8)
    early = np.zeros((len(a), len(b)), np.uint8)
    for w in range(a.shape[1]):
        both = a[:, w][:, None] & b[:, w][None, :]
        shared += np.bitwise_count(both)
        upto = min(last - 64 * w + 1, 64)
        if upto > 0:
            early += np.bitwise_count(both & np.uint64((1 << upto) - 1))
    return (shared >= needed) & (early == (2 if q >= 0 else 1))


def _cosines(x: np.ndarray, y: np.ndarray, wanted: np.ndarray, least: float) -> np.ndarray:
    """``wanted`` without the pairs of unit rows below ``least``."""
    if wanted.mean() > 0.02:
        return wanted & (x @ y.T >= least)
    out = np.zeros_like(wanted)
    i, j = np.nonzero(wanted)
    good = np.einsum("ij,ij->i", x[i], y[j]) >= least
    out[i[good], j[good]] = True
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Links out of ``linked`` (rows ``a`` against rows ``b`` of ``n``) that connect what it connects."""
    part = np.arange(n)
    out = []
    for r in range(len(a)):
        hit = b[np.flatnonzero(linked[r])]
        if not len(hit):
            continue
        mine = part[a[r]]
        others, first = np.unique(part[hit], return_index=True)
        fresh = others != mine
        for h in hit[first[fresh]].tolist():
            out.append((int(a[r]), h))
        part[np.isin(part, others[fresh])] = mine
    return out


def list_links(
    node: np.ndarray, unit: np.ndarray, bits: np.ndarray, copies: np.ndarray, block: np.ndarray, p: int, q: int, i: int, j: int,
    needed: int, least: float, tile: int = 1024,
) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Linked rows of every vector of one list, and a forest of the links (row numbers)."""
    counts = np.zeros(len(node), np.int64)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    forest: list[tuple[int, int]] = []
    for s in range(0, len(left), tile):
        a = left[s : s + tile]
        for t in range(s if i == j else 0, len(right), tile):
            b = right[t : t + tile]
            wanted = _candidates(bits[a], bits[b], p, q, needed)
            if i == j and s == t:
                wanted = np.triu(wanted, 1)
            if not wanted.any():
                continue
            linked = _cosines(unit[a], unit[b], wanted, least)
            counts[a] += linked @ copies[b]
            counts[b] += copies[a] @ linked
            forest += _forest(len(node), a, b, linked)
    return counts, forest


def search(lists: DataFrame, needed: int, pivots: int, dimension: int, least: float) -> DataFrame:
    """``(a, b, n)``: links of a forest (``n`` null), and of node ``a`` the linked rows ``n`` found (``b`` null)."""
    words = -(-pivots // 64)
    keys = ["label", "p", "q", "i", "j"]
    n = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.xxhash64(*keys).alias("cell")
    dealt = lists.select(key, "p", "q", "i", "j", "block", "node", "copies", "vector", "pivots", F.col("label").cast("string").alias("label"))
    # the label is part of the order, so equal hashes of two lists do not mix
    dealt = dealt.repartition(n, "cell").sortWithinPartitions("cell", *keys, "node")

    def solve(part: pa.Table):
        part = part.combine_chunks()
        get = {c: part.column(c).chunk(0) for c in part.column_names}
        node = get["node"].to_numpy()
        x = matrix(get["vector"], dimension)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1)[:, None]
        one = {c: get[c][0].as_py() for c in ("p", "q", "i", "j")}
        copies = get["copies"].to_numpy()
        counts, forest = list_links(
            node, x, _bits(matrix(get["pivots"], min(LIST, pivots)), words), copies, get["block"].to_numpy(), **one, needed=needed, least=least,
        )
        some = np.flatnonzero(counts)
        a = node[[f[0] for f in forest]] if forest else np.zeros(0, np.int64)
        b = node[[f[1] for f in forest]] if forest else np.zeros(0, np.int64)
        lone, full = pa.nulls(len(some), pa.int64()), pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([
            pa.concat_arrays([pa.array(node[some]), pa.array(a)]), pa.concat_arrays([lone, pa.array(b)]),
            pa.concat_arrays([pa.array(counts[some]), full]),
        ], ["a", "b", "n"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("cell", "label", "p", "q", "i", "j")]
            plain = [c.to_numpy(zero_copy_only=False) for c in cols]
            new = np.zeros(batch.num_rows - 1, bool)
            for c in plain:
                new |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:], strict=False):
                if s or (held and any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("cell", "label", "p", "q", "i", "j"))):
                    if held:
                        yield solve(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(s, e - s))
        if held:
            yield solve(pa.Table.from_batches(held))
        give_back()

    return dealt.mapInArrow(run, "a long, b long, n long")


# ---- the whole ------------------------------------------------------------------
def near_duplicate_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE,
    pivots: int = PIVOTS, sample: int = SAMPLE, most: int = CELL,
) -> DataFrame:
    """``key``, ``n_links``, ``component_id`` and ``kept`` of every row of ``vectors``."""
    dimension = common_length(vectors, vector)
    v, g = vectors[vector], vectors[label]
    usable = g.isNotNull() & finite(v, dimension) & F.exists(v, lambda c: c != 0)
    hashes = [F.when(usable, F.xxhash64(F.lit(s), g, v)).alias(h) for s, h in ((11, "__h1"), (23, "__h2"))]
    rows = vectors.select(vectors[key].alias("__key"), g.alias("label"), v.alias("vector"), *hashes)
    folded = rows.filter("__h1 is not null").groupBy("label", "__h1", "__h2").agg(
        F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("__key").alias("first_key")
    )
    nodes = stage(folded.withColumn("node", F.monotonically_increasing_id()), "pivot-nodes")
    # at most ``sample`` vectors, always the same ones
    drawn = nodes.select("__h1", "__h2", "vector").orderBy("__h1", "__h2").limit(sample).select("vector").toArrow()
    result = nodes.select("__h1", "__h2", "copies", F.col("first_key").alias("component_id"), F.lit(0).cast("long").alias("links"))
    if drawn.num_rows > 1:
        points = matrix(drawn.column(0).combine_chunks(), dimension)
        chosen = choose_pivots(points / np.abs(points).max(axis=1)[:, None], pivots)
        needed = min(SHARED, len(chosen))
        described = stage(describe(nodes.select("node", "label", "vector", "copies"), chosen), "pivot-lists")
        found = stage(search(inverted_lists(described, needed, most), needed, len(chosen), dimension, cosine), "pivot-links")
        drop_stage(described)
        degree = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("links"))
        roots = components(found.filter("b is not null").select("a", "b"))
        rooted = nodes.join(roots, nodes["node"] == roots["node"], "left").select(nodes["node"], "__h1", "__h2", "copies", "first_key", "root")
        named = rooted.filter("root is not null").groupBy("root").agg(F.min("first_key").alias("least"))
        result = (
            rooted.join(named, "root", "left").join(degree, rooted["node"] == degree["a"], "left")
            .select("__h1", "__h2", "copies", F.coalesce("least", "first_key").alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"))
        )
    result = stage(result, "pivot-result")
    slim = rows.select("__key", "__h1", "__h2")
    linked = slim.filter("__h1 is not null").join(result, ["__h1", "__h2"]).select(
        "__key", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    alone = slim.filter("__h1 is null").select("__key", F.lit(0).cast("long").alias("n_links"), F.col("__key").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("__key").alias(key), "n_links", "component_id", F.col("__key").eqNullSafe(F.col("component_id")).alias("kept"))
