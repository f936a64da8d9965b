"""Substring dedup against a table of all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from chatloom.llm import recompress


def plain(docs):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda x: x[0]):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            if w in seen:
                gone.update(range(s, s + 20))
            seen.add(w)
        kept = [w for k, w in enumerate(words) if k not in gone]
        out[i] = (len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest(), " ".join(kept))
    return out


def result(frame):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in recompress.without_repeats(frame).collect()}


def test_documents(docs_frame, hard_docs):
    assert result(docs_frame) == plain(hard_docs)


@pytest.mark.parametrize("seed", range(4))
def test_small_alphabets_and_runs(spark, seed, monkeypatch):
    rng = random.Random(seed)
    docs = []
    for i in range(40):
        words = []
        while len(words) < rng.randrange(1, 300):
            words += [rng.choice("abcd"[: 1 + seed])] * rng.choice([1, 1, 2, 30])
        if docs and rng.random() < 0.5:
            other = rng.choice(docs)[1].split()
            words += other[rng.randrange(len(other)) :][: rng.randrange(60)]
        docs.append((i, " ".join(words)))
    rng.shuffle(docs)
    monkeypatch.setattr(recompress, "PART", 50)
    assert result(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) == plain(docs)


def test_equal_windows_share_their_anchor():
    rng = np.random.default_rng(7)
    w = rng.integers(1, 12, 3000).astype(np.uint64)
    w[2000:2300] = w[100:400]
    part = np.zeros(len(w), np.int64)
    starts = np.arange(len(w) - 19)
    name, where = recompress.anchors(w, part, starts)
    assert (name[100:381] == name[2000:2281]).all()
    assert (where[2000:2281] - where[100:381] == np.where(where[100:381] < 0, 0, 1900)).all()
    assert (where >= 0).mean() > 0.9


def test_nulls_repeats_and_empty(spark, no_docs):
    long = " ".join(f"n{i}" for i in range(30))
    docs = spark.createDataFrame([(None, long), (3, long), (3, long), (4, None), (5, "x " + long)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_removed) for r in recompress.without_repeats(docs).collect()))
    assert got == [(0, 30, 0), (3, 30, 30), (3, 30, 30), (4, 0, 0), (5, 31, 30)]
    assert recompress.without_repeats(no_docs).count() == 0


def slices_met(slices, **more):
    """(id, text hash, position) of the windows that repeat, from slices of (id, text hash, text)."""
    out, held = [], {}
    for docs in slices:
        ids, hashes, texts = zip(*docs)
        shipped, repeats = recompress.slice_records(np.array(ids), np.array(hashes), [t.encode() for t in texts], 8, **more)
        out += repeats
        for b, rec, chk in shipped:
            held.setdefault(b, []).append((rec, chk))
    for parts in held.values():
        out += recompress.later_spans(*(b"".join(x) for x in zip(*parts)))
    return sorted((d, t, p) for d, t, s in out for at, n in np.frombuffer(s, recompress._SPAN).tolist() for p in range(at, at + n))


def test_windows_of_one_anchor_differ_by_their_whole_hash(monkeypatch):
    rng = random.Random(3)
    line = "one frequent line of few words".split()
    real = recompress.window_hashes
    monkeypatch.setattr(recompress, "window_hashes", lambda w: real(w) & np.uint64(0xFFFFFF0000000000))
    around = [[f"v{rng.randrange(10**9)}" for _ in range(40)] for _ in range(30)]
    slices = [[(i, i, " ".join([*a[:20], *line, *a[20:]]))] for i, a in enumerate(around)]
    assert slices_met(slices) == []
    assert slices_met([*slices, [(30, 30, slices[4][0][2])]]) == [(30, 30, p) for p in range(27)]


def test_documents_of_one_id_differ_by_their_whole_hash(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(25)) for x in "ab")
    high = 1 << 40
    assert slices_met([[(1, 7, a)], [(1, 7 + high, a)], [(1, 7 + 2 * high, b)]]) == [(1, 7 + high, p) for p in range(6)]
    keyed = recompress._with_key(spark.createDataFrame([(1, a), (1, b)], "doc_id long, text string"), "doc_id", "text", ["doc_id"])
    assert all(abs(r.text) >> 32 for r in keyed.collect())


def test_windows_of_a_hot_anchor_are_dealt_over_buckets(spark, monkeypatch):
    rng = random.Random(4)
    line = " ".join(f"line{i}" for i in range(12))
    docs = [(i, " ".join([*(f"v{rng.randrange(10**9)}" for _ in range(15)), line, *(f"v{rng.randrange(10**9)}" for _ in range(15))])) for i in range(400)]
    docs += [(400 + i, "x " + docs[i][1]) for i in range(0, 400, 7)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(recompress, "HOT", 1000)
    buckets, hot = recompress.hot_anchors(recompress._with_key(frame, "doc_id", "text", ["doc_id"]).select("__text", "doc", "text"))
    assert len(hot)
    assert result(frame) == plain(docs)

    ids = np.array([i for i, _ in docs])
    texts = [t.encode() for _, t in docs]
    most = lambda hot: max(len(chk) // 8 for _, _, chk in recompress.slice_records(ids, ids, texts, 16, hot)[0])
    total, _, many = recompress.slice_counts(ids, ids, texts, 64)
    assert most(None) >= many.max() > total / 8 > most(hot)
    one_by_one = [[(i, i, t)] for i, t in docs]
    assert slices_met(one_by_one, hot=hot) == slices_met(one_by_one)
