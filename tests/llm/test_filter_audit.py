"""The filter audit against counting one document after another."""

import re
from itertools import permutations

from chatloom.llm import filter_audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = {}
    for i, t, lang in docs:
        t = t or ""
        w = WORDS.findall(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and t in first and first[t] < i,
        }
        parts.setdefault(lang or "", []).append((fails, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                gone = lambda r: any(r[0][g] for g in order[: step - 1])
                here = [r for r in rows if r[0][f] and not gone(r)]
                out[part, order, step] = [
                    sum(not r[0][f] and not gone(r) for r in rows), len(here), sum(r[0][f] and gone(r) for r in rows),
                    sum(r[0][f] and sum(r[0].values()) == 1 for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)]
                removed_by[f] += len(here)
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(removed_by[f])
    return out


def test_audit(spark, hard_docs):
    langs = ["en", "fr", None, ""]
    docs = [(i, t, langs[n % 4]) for n, (i, t) in enumerate(hard_docs)]
    docs += [(12, hard_docs[12][1], "en"), (12, hard_docs[12][1], "fr"), (None, hard_docs[12][1], "en"), (None, None, "en"), (None, None, "en")]
    docs += [(500 + i, "SHOUT #1 " * (i + 1), "de") for i in range(4)] + [(600, " ".join(f"w{k}" for k in range(250)), "de"), (601, " ".join(f"w{k}" for k in range(250)), "de")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i, _, _ in docs if i is not None] + [(12, None, 1), (None, 1, 1), (999, 1, 1)]
    d = spark.createDataFrame([(*r, "n", 7, 8) for r in docs], "doc_id long, text string, lang string, part string, n int, mask int").repartition(3)
    l = spark.createDataFrame([(*r, "g") for r in labels], "doc_id long, quality int, toxic int, good string")
    rows = filter_audit.audit(d, l).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in rows}
    assert len(rows) == len(got) == 600 * 4
    assert got == brute(docs, labels)


def test_no_documents_and_no_labels(spark, no_docs):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(no_docs.withColumn("lang", no_docs.row), empty).count() == 0
    one = spark.createDataFrame([(1, "x y", None)], "doc_id long, text string, lang string")
    rows = filter_audit.audit(one, empty).collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""} and sum(r.good_lost + r.toxic_lost for r in rows) == 0
    assert {r.shapley for r in rows if r.filter_order[r.step - 1] == "A"} == {120}
