"""Substring dedup by recompression.

Words are named by a hash of their bytes. A round then names neighbours: first
runs of one word become one symbol each, and in every pair round a symbol whose
coin (a bit of its own name) shows left joins a right neighbour whose coin shows
right. A name is the hash of what it stands for, so equal text gets equal names
everywhere in the corpus without a shared dictionary.

Which symbols inside a window of 20 words are the same wherever the window stands
follows from the window alone: a run at its edge may go on outside, and so may a
pair whose coin points outside; everything further in is fixed. The widest such
symbol is the window's anchor (windows without one, inside long runs, are their
own anchor). Equal windows share their anchor, so occurrences meet by anchor, and
a 64-bit hash of the whole window beside the 64 bits of the anchor verifies them there.

A task settles the windows that repeat within its slice and ships only the first
of each, so a passage that a third of all documents share sends one row per slice.
Windows of one anchor occurrence travel as one record of a few bytes per window.

A first pass counts the windows that slices would ship by anchor. An anchor with
more than its share (a short frequent line in varied surroundings) is hot: its
windows travel one by one and are dealt by their own hash, so equal ones still meet.

Null text has no words. Documents are ordered by id (null first), then by the hash
of their text; rows equal in both are one document and get the same result each.
Empty input gives an empty result. Texts of any length are read in parts that
overlap by 19 words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import NULL_ID, mix, mix2, raw_texts, slices, stage

#: words of a window
WINDOW = 20
#: pair rounds after the run round
ROUNDS = 3
#: words of a text that are read at a time
PART = 1 << 18
#: windows of a bucket, on average
BUCKET = 1 << 19
#: an anchor with fewer windows is not hot
HOT = 1 << 14
#: windows of an anchor in a slice that are worth counting
LEAST = 64


def window_hashes(w: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Hash of every ``width`` consecutive names, put together from powers of two."""
    n = len(w) - width + 1
    out, at, size, block = None, 0, 1, w
    while width:
        if width & 1:
            piece = block[at : at + n]
            out = piece.copy() if out is None else mix2(out, piece, size)
            at += size
        width >>= 1
        if width:
            block = mix2(block[: len(block) - size], block[size:], size)
            size *= 2
    return mix(out, 77)


def anchors(w: np.ndarray, part: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Anchor name of the windows at ``starts`` and the word where the anchor begins (-1: none)."""
    total = len(w)
    first = np.ones(total, bool)
    first[1:] = (w[1:] != w[:-1]) | (part[1:] != part[:-1])
    begin = np.flatnonzero(first)
    span = np.diff(np.append(begin, total))
    name = np.where(span > 1, mix2(w[begin], span.astype(np.uint64), 11), w[begin])
    at = np.cumsum(first) - 1  # word -> symbol
    end = np.append(begin[1:], total)
    # the runs at both edges of a window may go on outside
    a = end[at[starts]]
    b = begin[at[starts + width - 1]]
    for r in range(rounds):
        left = (mix(name, r + 20) & np.uint64(1)).astype(bool)
        some = a < b
        x, y = np.where(some, a, starts), np.where(some, b, starts + 1)
        k = at[x]
        x = np.where(left[k], x, end[k])
        k = at[y - 1]
        y = np.where(left[k], begin[k], y)
        a, b = np.where(some, x, a), np.where(some, y, b)
        joins = np.zeros(len(name), bool)
        joins[:-1] = left[:-1] & ~left[1:] & (part[begin[1:]] == part[begin[:-1]])
        joined = np.zeros(len(name), bool)
        joined[1:] = joins[:-1]
        pair = name.copy()
        k = np.flatnonzero(joins)
        pair[k] = mix2(name[k], name[k + 1], r + 31)
        name, begin = pair[~joined], begin[~joined]
        end = np.append(begin[1:], total)
        flag = np.zeros(total, np.int64)
        flag[begin] = 1
        at = np.cumsum(flag) - 1
    some = np.flatnonzero(a < b)
    lo, hi = at[a[some]], at[b[some] - 1]
    # windows move slowly over symbols: equal stretches are looked at once
    new = np.ones(len(some), bool)
    new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    group = np.cumsum(new) - 1
    lo, hi = lo[new], hi[new]
    rank = (np.minimum(end - begin, 255).astype(np.uint64) << np.uint64(56)) | (mix(name, 5) >> np.uint64(8))
    best = lo.copy()
    for step in range(1, int((hi - lo).max(initial=0)) + 1):
        k = np.minimum(lo + step, hi)
        best = np.where(rank[k] > rank[best], k, best)
    where = np.full(len(starts), -1, np.int64)
    where[some] = begin[best[group]]
    out = np.zeros(len(starts), np.uint64)
    out[some] = name[best[group]]
    return out, where


def read_parts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, part number, document and position in it of all words; parts overlap."""
    digest = xxhash.xxh64_intdigest
    names, sizes, owner, offset = [], [], [], []
    for i, b in enumerate(texts):
        words = b.split()
        for at in range(0, max(1, len(words) - WINDOW + 1), PART) if len(words) >= WINDOW else ():
            piece = words[at : at + PART + WINDOW - 1]
            names.append(np.fromiter(map(digest, piece), np.uint64, len(piece)))
            sizes.append(len(piece))
            owner.append(i)
            offset.append(at)
    if not names:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    size = np.array(sizes)
    part = np.repeat(np.arange(len(size)), size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return np.concatenate(names), part, np.array(owner)[part], inside + np.array(offset)[part]


_RECORD = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("pos", "<u4"), ("n", "u1")])
SHIPPED = T.StructType([
    T.StructField("bucket", T.LongType()), T.StructField("records", T.BinaryType()), T.StructField("checks", T.BinaryType()),
    T.StructField("doc", T.LongType()), T.StructField("text", T.LongType()), T.StructField("repeats", T.BinaryType()),
])
_SPAN = np.dtype([("pos", "<u4"), ("n", "<u4")])


def _runs(doc: np.ndarray, pos: np.ndarray, tie: np.ndarray | None = None, most: int = 1 << 30) -> np.ndarray:
    """Starts of stretches of consecutive positions of one document (and one tie value)."""
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
    if tie is not None:
        new[1:] |= tie[1:] != tie[:-1]
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(doc)))
    if (size > most).any():  # cut long stretches
        start = np.concatenate([np.arange(s, s + m, most) for s, m in zip(start.tolist(), size.tolist(), strict=True)])
    return start


def _windows(ids: np.ndarray, text_hash: np.ndarray, texts: list[bytes]):
    """Documents of a slice in order, and its windows: (ids, text hashes, document and position of words), starts, codes, equal to an earlier one, anchors and their places."""
    order = np.lexsort((text_hash, ids))
    same = np.zeros(len(order), bool)
    same[1:] = (ids[order][1:] == ids[order][:-1]) & (text_hash[order][1:] == text_hash[order][:-1])
    order = order[~same]
    ids, text_hash = ids[order], text_hash[order]
    w, part, doc, pos = read_parts([texts[i] for i in order])
    if not len(w):
        return None
    starts = np.flatnonzero(part[WINDOW - 1 :] == part[: len(part) - WINDOW + 1])
    code = window_hashes(w)[starts]
    by_code = np.argsort(code, kind="stable")  # equal windows in document order
    later = np.zeros(len(starts), bool)
    later[by_code[1:]] = code[by_code[1:]] == code[by_code[:-1]]
    name, where = anchors(w, part, starts)
    return (ids, text_hash, doc, pos), starts, code, later, np.where(where < 0, code, name), where


def slice_counts(ids: np.ndarray, text_hash: np.ndarray, texts: list[bytes], least: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Windows that a slice ships, and the anchors of at least ``least`` of them with their counts."""
    found = _windows(ids, text_hash, texts)
    if found is None:
        return 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    _, _, _, later, name, _ = found
    name, n = np.unique(name[~later], return_counts=True)
    return int(n.sum()), name[n >= least], n[n >= least]


def slice_records(ids: np.ndarray, text_hash: np.ndarray, texts: list[bytes], buckets: int, hot: np.ndarray | None = None):
    """What a slice ships: records of first windows by bucket, and spans of windows that repeat here.

    ``hot``: sorted anchors whose windows are dealt one by one.
    """
    found = _windows(ids, text_hash, texts)
    if found is None:
        return [], []
    (ids, text_hash, doc, pos), starts, code, later, name, where = found
    repeats = []
    s = starts[later]
    if len(s):
        run = _runs(doc[s], pos[s])
        spans = np.zeros(len(run), _SPAN)
        spans["pos"], spans["n"] = pos[s][run], np.diff(np.append(run, len(s)))
        of = doc[s][run]
        cut = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        repeats = [(int(ids[of[a]]), int(text_hash[of[a]]), spans[a:b].tobytes()) for a, b in zip(cut, np.append(cut[1:], len(of)), strict=True)]
    keep = ~later
    s, name, where, code = starts[keep], name[keep], where[keep], code[keep]
    run = _runs(doc[s], pos[s], where, 255)
    alone = where < 0  # windows without an anchor
    single = np.zeros(len(s), bool)
    if hot is not None and len(hot):
        single = hot[np.minimum(np.searchsorted(hot, name), len(hot) - 1)] == name
        alone |= single
    alone[1:] |= alone[:-1]  # nothing is joined to them
    run = np.unique(np.concatenate((run, np.flatnonzero(alone))))
    n = np.diff(np.append(run, len(s)))
    rec = np.zeros(len(run), _RECORD)
    rec["anchor"], rec["doc"], rec["text"] = name[run], ids[doc[s][run]], text_hash[doc[s][run]]
    rec["pos"], rec["n"] = pos[s][run], n
    dealt_by = np.where(single[run], mix2(name[run], code[run], 13), name[run])
    bucket = (mix(dealt_by, 3) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], np.diff(bucket[by]) > 0)))
    shipped = []
    window = np.repeat(np.argsort(by), n)  # rank of each window's record
    dealt = code[np.argsort(window, kind="stable")]
    upto = np.concatenate(([0], np.cumsum(n[by])))
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(by)], strict=True):
        shipped.append((int(bucket[by[a]]), rec[by[a:b]].tobytes(), dealt[upto[a] : upto[b]].tobytes()))
    return shipped, repeats


def later_spans(records: bytes, checks: bytes) -> list[tuple[int, int, bytes]]:
    """Windows of a bucket that start later than an equal one: spans by document."""
    rec = np.frombuffer(records, _RECORD)
    code = np.frombuffer(checks, np.uint64)
    n = rec["n"].astype(np.int64)
    of = np.repeat(np.arange(len(rec)), n)
    inside = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    anchor = rec["anchor"][of]
    order = np.lexsort((code, anchor))
    same = (code[order][1:] == code[order][:-1]) & (anchor[order][1:] == anchor[order][:-1])
    shared = np.zeros(len(order), bool)
    shared[1:] |= same
    shared[:-1] |= same
    k = order[shared]
    r = rec[of[k]]
    pos = r["pos"] + inside[k]
    by = np.lexsort((pos, r["text"], r["doc"], code[k], anchor[k]))
    k, r, pos = k[by], r[by], pos[by]
    c, a = code[k], anchor[k]
    head = np.concatenate(([True], (c[1:] != c[:-1]) | (a[1:] != a[:-1]))) if len(c) else np.zeros(0, bool)
    first = np.flatnonzero(head)[np.cumsum(head) - 1]
    late = (r["doc"] != r["doc"][first]) | (r["text"] != r["text"][first]) | (pos != pos[first])
    r, pos = r[late], pos[late].astype(np.int64)
    by = np.lexsort((pos, r["text"], r["doc"]))
    r, pos = r[by], pos[by]
    if not len(pos):
        return []
    run = _runs(r["doc"], pos, r["text"])
    spans = np.zeros(len(run), _SPAN)
    spans["pos"], spans["n"] = pos[run], np.diff(np.append(run, len(pos)))
    doc, text = r["doc"][run], r["text"][run]
    cut = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]))))
    return [(int(doc[a]), int(text[a]), spans[a:b].tobytes()) for a, b in zip(cut, np.append(cut[1:], len(doc)), strict=True)]


def _with_key(docs: DataFrame, key: str, text: str, names: list[str]) -> DataFrame:
    return docs.select(
        F.struct(*[docs[c] for c in names]).alias("row"), docs[text].alias("__text"),
        F.coalesce(docs[key].cast("long"), F.lit(NULL_ID)).alias("doc"),
        F.xxhash64(docs[text]).alias("text"),
    )


def hot_anchors(source: DataFrame) -> tuple[int, np.ndarray]:
    """Number of buckets for ``__text, doc, text``, and the sorted anchors that are too large for one.

    Windows under ``LEAST`` of an anchor in a slice are not counted, so an anchor can
    go unnoticed with that many a slice. There are at most four hot ones a bucket.
    """
    n, least = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), LEAST

    def count(batches):
        for batch in slices(batches, "__text"):
            total, name, many = slice_counts(batch.column(1).to_numpy(), batch.column(2).to_numpy(), raw_texts(batch, "__text"), least)
            names = pa.array([None, *name.view(np.int64).tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([names, pa.array([total, *many.tolist()], pa.int64())], ["anchor", "n"])

    counts = stage(source.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")), "anchors")
    total = counts.filter("anchor IS NULL").agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * n, total // BUCKET)
    found = counts.filter(F.col("anchor").isNotNull() & (F.col("n") >= max(HOT, total // (4 * buckets)))).select("anchor").toArrow()
    return buckets, np.sort(found.column(0).to_numpy().astype(np.int64).view(np.uint64))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, text`` (id and text hash) with spans of window starts that repeat an earlier window."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = _with_key(docs, key, text, [key]).select("__text", "doc", "text")
    buckets, hot = hot_anchors(source)

    def ship(batches):
        for batch in slices(batches, "__text"):
            ids, text_hash = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            shipped, repeats = slice_records(ids, text_hash, raw_texts(batch, "__text"), buckets, hot)
            rows = [(b, r, c, None, None, None) for b, r, c in shipped]
            rows += [(d % buckets, None, None, d, t, s) for d, t, s in repeats]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    SHIPPED.names,
                )

    def meet(batches):
        held: int | None = None
        records, checks = [], []

        def emit(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc", "text", "spans"]
            )

        for batch in batches:
            passed = []
            for bucket, rec, chk, doc, th, spans in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if spans is not None:
                    passed.append((doc, th, spans))
                    continue
                if bucket != held and records:
                    passed += later_spans(b"".join(records), b"".join(checks))
                    records, checks = [], []
                held = bucket
                records.append(rec)
                checks.append(chk)
            if passed:
                yield emit(passed)
        if records and (rows := later_spans(b"".join(records), b"".join(checks))):
            yield emit(rows)

    shipped = source.mapInArrow(ship, SHIPPED).repartition(n, "bucket").sortWithinPartitions("bucket")
    found = shipped.mapInArrow(meet, "doc long, text long, spans binary")
    return stage(found, "repeats")


def covered_words(n: int, spans: list[bytes]) -> np.ndarray:
    """Mask of the words that the windows of the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    for s in spans:
        x = np.frombuffer(s, _SPAN)
        np.add.at(edge, x["pos"].astype(np.int64), 1)
        np.add.at(edge, x["pos"].astype(np.int64) + x["n"] + WINDOW - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """Documents with ``n_words``, ``n_removed``, ``kept_sha256`` and, if wanted, the kept words as ``kept_text``."""
    spans = repeated_spans(docs, key, text).groupBy("doc", "text").agg(F.collect_list("spans").alias("spans"))
    joined = _with_key(docs, key, text, [key]).join(spans, ["doc", "text"], "left").select(F.col(f"row.{key}").alias("__key"), "__text", "spans")
    schema = T.StructType([
        T.StructField(key, joined.schema["__key"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept_text", T.StringType())] if texts else []),
    ])

    def cut(batches):
        for batch in slices(batches, "__text"):
            n_words, n_removed, digest, kept_text = [], [], [], []
            for b, s in zip(raw_texts(batch, "__text"), batch.column(2).to_pylist(), strict=True):
                words = b.split()
                n_words.append(len(words))
                if s:
                    gone = covered_words(len(words), s)
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                n_removed.append(n_words[-1] - len(words))
                kept = b" ".join(words)
                digest.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept.decode() if texts else None)
            columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept_text, pa.string())] if texts else [])], schema.names)

    return joined.mapInArrow(cut, schema)
