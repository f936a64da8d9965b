"""Rules without a length or depth limit, and repairs on replay and edits."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from chatloom.functions import text as X
from chatloom.operators import audit as A, entities as E, overlap as O, retrieval as Q
from chatloom.streaming.store import MessageStore, sync_index


def test_long_names_are_found_whole(spark):
    texts = spark.createDataFrame([
        ("c", 1, "The Order of the Silver Hand Guard's banner fell."), ("c", 2, "An order of the silver spoon."),
        ("c", 3, "Order of the Silver Hand, not of the Guard."),
    ], "chat_key string, text_id long, text string")
    ent = spark.createDataFrame([("c", "e", "Order of the Silver Hand Guard", [])], "chat_key string, id string, name string, aliases array<string>")
    got = O.mention_join(texts, ent, parts=False).collect()
    assert [(r.text_id, r.words, r.first_pos, r.possessive, r.mentions) for r in got] == [(1, 6, 2, True, 1)]


def test_short_records_are_supported(spark):
    rec = spark.createDataFrame([("c", "r", "k", 0, 3, "Ann sleeps")], "chat_key string, id string, identity string, range_from long, range_to long, text string")
    msg = spark.createDataFrame([("c", 0, "Ann", "Maybe nothing.")], "chat_key string, idx long, name string, text string")
    assert [(r.id, r.unsupported) for r in A.evidence_audit(rec, msg).collect()] == [("r", False)]


def test_descriptions_drop_linked_sentences_only_in_threes(spark):
    pair = "Her role was captain of harbor watch. A captain role at the harbor watch. Known member of north guild. A member in north guild hall."
    three = "Her role was captain of harbor watch. A captain role at harbor watch. The harbor watch captain has a role. She likes tea."
    rows = [("c", "two pairs", "Ann", pair), ("c", "three", "Ann", three), ("c", "equal", "Ann", "She likes tea. She likes  tea! He came."),
            ("c", "profile", "Ann", "Appearance: tall. Same. Same."), ("c", "none", "Ann", None)]
    ent = spark.createDataFrame(rows, "chat_key string, id string, name string, description string")
    got = {r.id: r.description for r in E.compact_descriptions(ent).collect()}
    assert got["two pairs"] == pair
    assert got["three"] == "Her role was captain of harbor watch. She likes tea."
    assert got["profile"] == "Appearance: tall. Same. Same." and got["none"] is None


def _events(spark, rows):
    return spark.createDataFrame(rows, "chat_key string, idx long, name string, text string, is_user boolean, is_system boolean, op string, seq long")


def test_replayed_batch_returns_its_mutations(spark, tmp_path):
    store = MessageStore(spark, str(tmp_path / "s"), chat_buckets=2, positions=8)
    store.apply(_events(spark, [("c", i, "A", f"t{i}", True, False, "new", i) for i in range(12)]), 0)
    edit = _events(spark, [("c", 3, "A", "other", True, False, "edit", 100)])
    first = [tuple(r) for r in store.apply(edit, 1).collect()]
    again = [tuple(r) for r in store.apply(edit, 1).collect()]
    assert first == again == [("c", "retract", 3)]


def test_index_rows_of_removed_records_go(spark, tmp_path):
    path = str(tmp_path / "i")
    schema = "chat_key string, key string, hash string, text string"
    rows = [("a", "fact:1", "h1", "x"), ("a", "fact:2", "h2", "y"), ("b", "fact:1", "h1", "x")]
    sync_index(spark.createDataFrame(rows, schema), path)
    assert sync_index(spark.createDataFrame(rows[:1], schema), path) == {"added": 0, "deleted": 1}
    none = spark.createDataFrame([], schema)
    assert sync_index(none, path, spark.createDataFrame([("b",)], "chat_key string")) == {"added": 0, "deleted": 1}
    assert [(r.chat_key, r.key) for r in spark.read.parquet(path).collect()] == [("a", "fact:1")]


def _size(text):
    wide = sum(ord(c) > 127 for c in text)
    return wide + -(-(len(text) - wide) // 4)


def _cut(text, room):
    if _size(text) <= room:
        return text
    return max((text[:n] for n in range(len(text)) if _size(text[:n] + "…") <= room), key=len, default="").rstrip() + "…"


def _packed(limit, sections):
    """First lines share the room, later turns take what fits whole."""
    head = {s: _size(f"\nSection {s}:\n") for s in sections}
    room, taken, todo = limit - sum(head.values()), [], sorted(sections)
    if room <= 0:
        room = limit
        for s in todo:
            if room > head[s]:
                taken.append((s, _cut(sections[s][0], room - head[s])))
                room = max(0, room - head[s] - _size(taken[-1][1] + "\n"))
        return taken
    whole = room >= sum(_size(sections[s][0] + "\n") for s in todo)
    for n, s in enumerate(todo):
        taken.append((s, sections[s][0] if whole else _cut(sections[s][0], max(1, room // (len(todo) - n)))))
        room = max(0, room - _size(taken[-1][1] + "\n"))
    for turn in range(1, 99):
        before = len(taken)
        for s in todo:
            line = sections[s][turn] if turn < len(sections[s]) else None
            if line and _size(line + "\n") <= room:
                taken.append((s, line))
                room -= _size(line + "\n")
        if len(taken) == before:
            return taken
    return taken


def test_packing_equals_the_plain_rule(spark):
    rnd, rows, limits = random.Random(9), [], {}
    for q in range(40):
        limits[q] = rnd.choice((4, 12, 24, 30, 45, 60, 90, 150, 400))
        for s in range(rnd.randrange(1, 6)):
            rows += [(q, s, f"Section {s}", n, f"{q} {s} {n} " + rnd.choice("xé") * rnd.randrange(1, 90)) for n in range(rnd.randrange(1, 6))]
    df = spark.createDataFrame(rows, "query_id long, section_no long, title string, row_no long, line string")
    budgets = spark.createDataFrame(list(limits.items()), "query_id long, budget long")
    got: dict = {}
    for r in Q.pack_budget(df, budgets, minimum=1).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append((r.section_no, r.line))
    for q, limit in limits.items():
        sections: dict = {}
        for r in rows:
            if r[0] == q:
                sections.setdefault(r[1], []).append(r[4])
        assert got.get(q, []) == _packed(limit, sections), (q, limit)


def test_renames_leave_kept_entities_alone(spark):
    from chatloom.operators.entities import apply_identity_resolutions

    rows = [("c", i, n, [], [], 1, k) for i, n, k in (("1", "Rider", False), ("2", "Anna", False), ("3", "Mask", True), ("4", "Ben", False), ("5", "Stranger", False), ("6", "Carl", True))]
    e = spark.createDataFrame(rows, "chat_key string, id string, name string, aliases array<string>, sources array<string>, importance int, corrected boolean")
    r = spark.createDataFrame([("c", "rider", "Anna"), ("c", "mask", "Ben"), ("c", "stranger", "Carl")], "chat_key string, k string, canonical string")
    got = {(x.name, tuple(x.aliases)) for x in apply_identity_resolutions(e, r, F.col("corrected")).collect()}
    assert got == {("Anna", ("Rider",)), ("Mask", ()), ("Ben", ()), ("Stranger", ()), ("Carl", ())}
    assert len(apply_identity_resolutions(e, r).collect()) == 3
