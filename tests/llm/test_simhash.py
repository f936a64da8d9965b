"""SimHash: fingerprints by definition, components against all pairs."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from chatloom.llm import simhash


def fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def all_pairs(prints):
    part = list(range(len(prints)))

    def top(i):
        while part[i] != i:
            i = part[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                part[top(i)] = top(j)
    return [top(i) for i in range(len(prints))]


def test_documents(docs_frame, hard_docs):
    got = {r.doc_id: (r.f, r.component_id) for r in simhash.near_duplicates(docs_frame).select("doc_id", "component_id", simhash.hex_fingerprint(F.col("fp")).alias("f")).collect()}
    prints = [fingerprint(t) for _, t in hard_docs]
    tops = all_pairs(prints)
    ids = [i for i, _ in hard_docs]
    want = {i: (f"{p:016x}", min(k for k, t in zip(ids, tops) if t == tops[n])) for n, (i, p) in enumerate(zip(ids, prints))}
    assert got == want
    kept = sorted(r.doc_id for r in simhash.keep_one(docs_frame).collect())
    assert kept == sorted({c for _, c in want.values()})
    assert simhash.keep_one(docs_frame).columns == docs_frame.columns


def test_random_prints_and_chains(spark, monkeypatch):
    rng = random.Random(2)
    prints = {0, (1 << 64) - 1}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 40)):  # chains and clouds round a centre
            prints.add(x)
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                x ^= 1 << b
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    fps = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(fps)).collect()}
    tops = all_pairs(prints)
    want = {s: min(x for x, t in zip(signed, tops) if t == tops[n]) for n, s in enumerate(signed)}
    assert {s: roots.get(s, s) for s in signed} == want


def test_large_cells_are_split_and_whole(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    cloud = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))) for _ in range(400)})
    signed = [p - (1 << 64) if p >> 63 else p for p in cloud]
    fps = spark.createDataFrame([(s,) for s in signed], "fp long")
    cells = simhash.split_cells(simhash.grid_cells(fps), 20).distinct().toPandas().sort_values(["cell", "fp"])
    assert cells.groupby("cell").size().max() < 120
    a, b = simhash.cell_links(cells.cell.to_numpy(), cells.fp.to_numpy().view(np.uint64))
    tops = all_pairs(cloud)
    parts = {x: x for x in cloud}

    def top(x):
        while parts[x] != x:
            x = parts[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        parts[top(x)] = top(y)
    assert len({top(x) for x in cloud}) == len(set(tops))


def test_nulls_repeats_and_empty(spark, no_docs):
    docs = spark.createDataFrame(
        [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, "other words in here"), (None, None), (None, "")], "doc_id long, text string"
    )
    rows = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert rows == sorted([(None, 5), (5, 5), (5, 5), (7, 7), (None, None), (None, None)], key=repr)
    assert sorted((r.doc_id or 0, bool(r.text)) for r in simhash.keep_one(docs).collect()) == [(0, False), (5, True), (7, True)]
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0
