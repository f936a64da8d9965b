"""Near-duplicates by SimHash.

A fingerprint is embedded as the vector of its 32 two-bit popcounts. Each
coordinate differs by at most the number of differing bits under it, so the
Manhattan distance of two vectors is a lower bound of the Hamming distance of the
fingerprints. Six groups of coordinates make the axes of a grid: within distance
three at most three groups differ, so a linked pair shares a cell on one of the
20 triples of groups. Pairs of a cell are tested against the Manhattan bound and
then exactly; a cell hands on a spanning forest of its links, never all pairs.
Components come from star contraction in rounds.

Texts are folded to distinct fingerprints first, so copies cost one row. Cells
of more than ``CELL`` fingerprints are split into blocks, and each pair of blocks
is a cell of its own.

Null text has no words and, as any text without words, fingerprint zero. Rows
with a null id count as members but never name a component unless no member has
an id. Repeated rows are members each. Empty input gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import carried, drop_stage, give_back, raw_texts, stage

#: differing bits that still link
DISTANCE = 3
#: words of a shingle
SHINGLE = 3
#: fingerprints of one cell that are compared in one block
CELL = 4096
GROUPS = 6
#: text bytes at a time: every word becomes 64 counted bits
BITS_BYTES = 1 << 20

FINGERPRINT = T.StructType([T.StructField("fp", T.LongType())])
_PAIRS = 0x5555555555555555


def fingerprint_texts(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Signed 64-bit fingerprints of UTF-8 texts."""
    hashes: list[int] = []
    counts = []
    digest = xxhash.xxh64_intdigest
    for b in texts:
        words = b.lower().split()
        n = len(words)
        if n <= shingle:
            if n:
                hashes.append(digest(b" ".join(words), 42))
            counts.append(min(n, 1))
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[: -shingle])).tolist()
        hashes += [digest(joined[s:e], 42) for s, e in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
        counts.append(n - shingle + 1)
    counts = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        first = np.concatenate(([0], np.cumsum(counts[some])))
        bits = np.zeros((len(some), 64), np.int64)
        all_hashes = np.array(hashes, np.uint64)
        step = 1 << 17
        for a in range(0, len(all_hashes), step):  # long texts are added up in parts
            part = np.unpackbits(all_hashes[a : a + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            lo = np.searchsorted(first, a, side="right") - 1
            hi = np.searchsorted(first, a + len(part), side="left")
            cuts = np.maximum(first[lo:hi] - a, 0)
            bits[lo:hi] += np.add.reduceat(part, cuts, axis=0, dtype=np.int64)
        ones = bits * 2 > counts[some][:, None]
        out[some] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
    return out.view(np.int64)


def with_fingerprint(docs: DataFrame, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``row`` (columns of the input) and ``out.fp``."""
    return carried(
        docs, text, FINGERPRINT, lambda b: {"fp": fingerprint_texts(raw_texts(b, "__text"))}, BITS_BYTES, columns
    )


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# ---- candidates ---------------------------------------------------------------
def _group_masks() -> list[int]:
    """Fields of two bits, dealt to the groups in runs of five or six."""
    edges = [round(i * 32 / GROUPS) for i in range(GROUPS + 1)]
    return [sum(3 << (2 * f) for f in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp: Column) -> Column:
    """Popcounts of the 32 segments, two bits each, packed into one long.

    A segment with both bits set counts two, with one of them one: no carries.
    """
    high = F.shiftrightunsigned(fp, 1)
    both = F.shiftleft(fp.bitwiseAND(high).bitwiseAND(F.lit(_PAIRS)), 1)
    return both.bitwiseOR(fp.bitwiseXOR(high).bitwiseAND(F.lit(_PAIRS)))


def grid_cells(fps: DataFrame) -> DataFrame:
    """``(cell, fp)`` for every triple of groups of the embedding."""
    masks = _group_masks()
    v = embedding(F.col("fp"))
    cells = [
        F.xxhash64(F.lit(i), v.bitwiseAND(F.lit(_signed(masks[a] | masks[b] | masks[c]))))
        for i, (a, b, c) in enumerate(combinations(range(GROUPS), DISTANCE))
    ]
    return fps.select("fp", F.explode(F.array(*cells)).alias("cell"))


def split_cells(cells: DataFrame, most: int = CELL) -> DataFrame:
    """Cells of more than ``most`` fingerprints become one cell for each pair of blocks."""
    large = (
        cells.groupBy("cell").count().filter(F.col("count") > most)
        .select("cell", F.ceil(F.col("count") / most).alias("blocks"))
    )
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("blocks"))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = cells.join(large, "cell", "left").select("cell", "fp", "blocks", own.alias("own"), other.alias("other"))
    return dealt.select(
        F.when(F.col("blocks").isNull(), F.col("cell"))
        .otherwise(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))).alias("cell"),
        "fp",
    )


_L1 = np.abs(
    np.stack([(np.arange(256) >> s) & 3 for s in (0, 2, 4, 6)])[:, :, None]
    - np.stack([(np.arange(256) >> s) & 3 for s in (0, 2, 4, 6)])[:, None, :]
).sum(axis=0).astype(np.uint8)


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs within the distance: the Manhattan bound first, then exactly."""
    pairs = np.uint64(_PAIRS)
    va = (a & pairs) + ((a >> np.uint64(1)) & pairs)
    vb = (b & pairs) + ((b >> np.uint64(1)) & pairs)
    bound = _L1[va.view(np.uint8), vb.view(np.uint8)].reshape(-1, 8).sum(axis=1)
    near = bound <= DISTANCE
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= DISTANCE
    return near


def _forest(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that join what is within the distance in one large cell."""
    part = np.arange(len(x))
    left, right = [], []
    for i in range(len(x) - 1):
        near = np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= DISTANCE) + i + 1
        for p in np.unique(part[near]):
            if p != part[i]:
                left.append(i)
                right.append(int(near[part[near] == p][0]))
                part[part == p] = part[i]
    return left, right


def cell_links(cell: np.ndarray, fp: np.ndarray, small: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal cells (sorted input)."""
    n = len(cell)
    starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, n))
    a, b = [], []
    size_of = np.repeat(sizes, sizes)
    short = size_of <= small
    for k in range(1, min(small, int(sizes.max(initial=1)))):
        at = np.flatnonzero(short[:-k] & (cell[k:] == cell[:-k]))
        if not len(at):
            break
        hit = at[_close(fp[at], fp[at + k])]
        a.append(fp[hit])
        b.append(fp[hit + k])
    for s, m in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        x = fp[s : s + m]
        i, j = _forest(x)
        a.append(x[i])
        b.append(x[j])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(fps: DataFrame) -> DataFrame:
    """Links ``(a, b)``, a < b, that connect what the distance connects.

    ``fps`` holds distinct fingerprints. Rows of a cell meet by a shuffle and are
    sorted, so a task holds one cell (at most two blocks) at a time.
    """
    cells = split_cells(grid_cells(fps))
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(n, "cell").sortWithinPartitions("cell", "fp")

    def run(batches):
        cell, fp = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def emit(c, f):
            a, b = cell_links(c, f.view(np.uint64))
            a, b = a.view(np.int64), b.view(np.int64)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            cell = np.concatenate((cell, batch.column(0).to_numpy()))
            fp = np.concatenate((fp, batch.column(1).to_numpy()))
            whole = np.searchsorted(cell, cell[-1]) if len(cell) else 0
            if whole:
                yield emit(cell[:whole], fp[:whole])
                cell, fp = cell[whole:], fp[whole:]
        if len(cell):
            yield emit(cell, fp)
        give_back()

    return dealt.select("cell", "fp").mapInArrow(run, "a long, b long").distinct()


# ---- components ---------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node.

    Star contraction: each round ties the larger neighbours of a node to its
    smallest one, then the smaller ones, until every edge ends in a root. Rounds
    grow with the logarithm of the longest chain; each is a written stage.
    """
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("root"))
            ).distinct()
        before = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # larger neighbours of u (and u's own) hang on its smallest neighbour
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.filter("u <> v").groupBy("u").agg(F.min("v").alias("m"))
        small = large.filter("u <> v").join(low, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.*").filter("u <> v").distinct()
        after = stage(small, "edges")
        drop_stage(now)
        now = after


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Written table of ``__key``, the text's hash and its fingerprint."""
    slim = docs.select(docs[key].alias("__key"), F.xxhash64(docs[text]).alias("__hash"), docs[text].alias("__body"))
    return stage(with_fingerprint(slim, "__body", ["__key", "__hash"]).select("row.*", "out.fp"), "fingerprints")


def groups(marks: DataFrame) -> DataFrame:
    """``(fp, group, component_id)`` of the distinct fingerprints of ``marked``."""
    nodes = stage(marks.groupBy("fp").agg(F.min("__key").alias("first_key")), "nodes")
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_key", "root")
    named = rooted.filter("root is not null").groupBy("root").agg(F.min("first_key").alias("component_id"))
    return stage(
        rooted.join(named, "root", "left")
        .select("fp", F.coalesce("root", "fp").alias("group"), F.coalesce("component_id", "first_key").alias("component_id")),
        "components",
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fp`` and ``component_id`` of every document.

    Components are worked out on distinct fingerprints; a document then looks up
    its fingerprint.
    """
    marks = marked(docs, key, text)
    return marks.join(groups(marks), "fp", "left").select(F.col("__key").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: the one with the smallest id.

    Of several rows with that id and the same text one stays. A component without
    any id keeps one row.
    """
    marks = marked(docs, key, text)
    named = marks.join(groups(marks), "fp")
    lead = named.groupBy("group").agg(F.min_by(F.struct("__key", "__hash"), F.struct(F.col("__key").isNull(), "__key", "__hash")).alias("lead"))
    copies = marks.groupBy("__key", "__hash").agg((F.count(F.lit(1)) > 1).alias("__many"))
    chosen = lead.select("lead.*")
    same = chosen["__key"].eqNullSafe(copies["__key"]) & (chosen["__hash"] == copies["__hash"])
    chosen = stage(chosen.join(copies, same).select(chosen["__key"], chosen["__hash"], "__many"), "chosen")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("__id"), F.xxhash64(docs[text]).alias("__body"))
    hit = rows["__id"].eqNullSafe(chosen["__key"]) & (rows["__body"] == chosen["__hash"])
    kept = rows.join(chosen, hit).select("row", "__key", "__hash", "__many")
    one = kept.filter("__many").groupBy("__key", "__hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.filter("not __many").select("row.*").unionByName(one.select("row.*"))
