"""Whole runs over a memory: revised groups, replay, reconciliation."""

import random

import pandas as pd
from pyspark.sql import functions as F

from chatloom.operators import reconcile as RC, replay as RP
from chatloom.streaming.processors import RevisedGroups


class Value:
    def __init__(self):
        self.v = None

    exists = lambda self: self.v is not None
    get = lambda self: self.v

    def update(self, v):
        self.v = v


class Rows(Value):
    get = lambda self: iter(self.v)

    def put(self, v):
        self.v = list(v)


class Map:
    def __init__(self):
        self.d = {}

    containsKey = lambda self, k: k in self.d
    getValue = lambda self, k: self.d[k]

    def updateValue(self, k, v):
        self.d[k] = v

    def removeKey(self, k):
        del self.d[k]


class Handle:
    getMapState = lambda self, *_: Map()
    getListState = lambda self, *_: Rows()
    getValueState = lambda self, *_: Value()


def batch_groups(live, size, buffer):
    idx = sorted(live)
    if idx and not live[idx[-1]]:
        idx = idx[:-1]
    idx = idx[: max(0, len(idx) - buffer)]
    return {n: (idx[n * size], idx[n * size + size - 1]) for n in range(len(idx) // size)}


def test_groups_equal_the_batch_after_any_change():
    for seed in range(40):
        rng = random.Random(seed)
        size, buffer = rng.randrange(2, 5), rng.randrange(0, 3)
        p = RevisedGroups(size, buffer)
        p.init(Handle())
        live, standing, seen, seq = {}, {}, set(), 0
        for _ in range(25):
            rows = []
            for _ in range(rng.randrange(1, 7)):
                seq += 1
                i = rng.randrange(0, 60) if rng.random() < 0.5 else max(live, default=-1) + rng.randrange(1, 3)
                op, user = rng.choice(["new", "edit", "delete"] if i in live else ["new"]), rng.random() < 0.6
                rows.append({"idx": i, "seq": seq, "text": f"t{seq}", "is_user": user, "is_system": False, "op": op})
                if op == "delete":
                    live.pop(i, None)
                else:
                    live[i] = user
            for out in p.handleInputRows(("c",), iter([pd.DataFrame(rows)]), None):
                for r in out.itertuples():
                    if r.op == "insert":
                        assert r.group_no not in standing and (r.group_no, r.version) not in seen
                        seen.add((r.group_no, r.version))
                        standing[r.group_no] = (r.range_from, r.range_to, r.version)
                    else:
                        assert standing.pop(r.group_no) == (r.range_from, r.range_to, r.version)
            assert {k: v[:2] for k, v in standing.items()} == batch_groups(live, size, buffer)


def test_chats_and_ranges_leave_with_their_levels(spark):
    source = "array<struct<chat_key string, range_from long, range_to long>>"
    facts = spark.createDataFrame(
        [("a", "f1", [("a", 0, 7), ("b", 0, 7)]), ("a", "f2", [("b", 8, 15)]), ("b", "f3", [("b", 0, 7)])], f"chat_key string, id string, sources {source}")
    l1 = spark.createDataFrame([("a", "x0", 0, 7), ("a", "x1", 8, 15), ("b", "y0", 0, 7)], "chat_key string, id string, range_from long, range_to long")
    l2 = spark.createDataFrame([("a", "p", ["x0"]), ("a", "q", ["x1"]), ("b", "r", ["y0"])], "chat_key string, id string, child_ids array<string>")
    l3 = spark.createDataFrame([("a", "t", ["p", "q"]), ("a", "u", ["q"])], "chat_key string, id string, child_ids array<string>")
    memory = {"facts": facts, "l1": l1, "l2": l2, "l3": l3}
    ids = lambda m, c: {r.id for r in m[c].collect()}
    one = RP.remove_chats(memory, spark.createDataFrame([("b",)], "chat_key string"))
    assert ids(one, "facts") == {"f1"} and ids(one, "l1") == {"x0", "x1"} and ids(one, "l2") == {"p", "q"} and ids(one, "l3") == {"t", "u"}
    two = RP.remove_ranges(memory, spark.createDataFrame([("a", 0, 7)], "chat_key string, range_from long, range_to long"))
    assert ids(two, "facts") == {"f1", "f2", "f3"} and ids(two, "l2") == {"q", "r"} and ids(two, "l3") == {"u"}
    assert [len(r.sources) for r in two["facts"].filter("id = 'f1'").collect()] == [1]


def test_reconciling_what_changed_equals_reconciling_all(spark):
    rng = random.Random(4)
    people = ["Alba", "Boris", "Celia", "Dorin"]
    facts, messages = [], []
    for n in range(60):
        chat, who = rng.choice("xy"), rng.choice(people)
        lo = 8 * rng.randrange(4)
        kind = rng.randrange(4)
        if kind == 0:
            row = (who, "knowledge of harbor", f"{who} knows gate {rng.randrange(3)}.", "knowledge")
        elif kind == 1:
            row = (who, "bond", f"is the mentor of {rng.choice([p for p in people if p != who])}", "identity")
        else:
            row = (who, f"habit{rng.randrange(2)} — details", f"sails boat {n}", "trait")
        facts.append((chat, f"f{n:03}", *row, "persistent", 3, lo, lo + 7, n))
    for chat in "xy":
        messages += [(chat, i, "Guide", f"Rain {i} falls. Relic {i % 5} was recovered by the guide.") for i in range(32)]
    f = spark.createDataFrame(facts, "chat_key string, id string, subject string, predicate string, value string, category string, persistence string, importance int, range_from long, range_to long, seq long")
    m = spark.createDataFrame(messages, "chat_key string, idx long, name string, text string")
    entities = spark.createDataFrame([(c, f"{c}{p}", p, "person", []) for c in "xy" for p in people], "chat_key string, id string, name string, type string, aliases array<string>")
    relations = spark.createDataFrame([], "chat_key string, id string, endpoint_a string, endpoint_b string, kind string, dynamic string, status string, range_to long, seq long")
    threads = spark.createDataFrame(
        [(c, f"t{c}{i}", f"Recover relic {i % 3}", "the search goes on", "open", ["Alba"], 0, 31) for c in "xy" for i in range(5)],
        "chat_key string, id string, title string, detail string, status string, participants array<string>, range_from long, range_to long")
    evidence = m.select("chat_key", F.col("idx").alias("range_from"), F.col("idx").alias("range_to"), "text")
    done = m.select("chat_key", "idx")
    old = lambda df: df.filter("range_to < 31") if "seq" in df.columns and "range_from" in df.columns else df
    memory = {"facts": old(f), "relationships": relations, "threads": threads, "entities": entities}
    first = {k: v.persist() for k, v in RC.reconcile_memory(memory, evidence, m, done).items()}
    new = f.filter("range_to = 31")
    grown = first | {"facts": first["facts"].unionByName(new)}
    step = RC.reconcile_memory(grown, evidence, m, done, {"facts": new.select("chat_key", "id")}, m.limit(0).select("chat_key", "idx"))
    whole = RC.reconcile_memory(grown, evidence, m, done)
    for part, cols in (("facts", ("chat_key", "id", "subject", "predicate", "value")), ("relationships", ("chat_key", "endpoint_a", "endpoint_b", "kind", "dynamic")), ("threads", ("chat_key", "id", "title", "status"))):
        told = lambda df: sorted(tuple(r[c] for c in cols) for r in df.collect())
        assert told(step[part]) == told(whole[part]) and len(told(step[part])) > 0
