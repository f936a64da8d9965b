"""Names by the automaton, passages, and the recall run's routing."""

import random

import pytest
from pyspark.sql import functions as F

from chatloom.operators import names as N, recall as R, retrieval as Q


def test_automaton_finds_every_place():
    rng = random.Random(1)
    sequences = [[rng.choice("abcd") for _ in range(rng.randrange(1, 5))] for _ in range(25)] + [[]]
    machine = N.TokenAutomaton(sequences)
    for _ in range(60):
        text = [rng.choice("abcde") for _ in range(rng.randrange(0, 40))]
        want = sorted((n, i) for n, s in enumerate(sequences) if s for i in range(len(text) - len(s) + 1) if text[i : i + len(s)] == s)
        assert sorted(machine.mentions(text)) == want


@pytest.mark.parametrize("blocks", [(20_000, 500_000), (2, 7)])
def test_mentions_in_blocks(spark, blocks):
    rng = random.Random(2)
    word = lambda: rng.choice(["mara", "tobin", "ilse", "gate", "harbor"])
    texts = [(c, i, [word() for _ in range(rng.randrange(0, 9))]) for c in "xy" for i in range(30)] + [("x", 99, None), (None, 5, ["mara"])]
    names = [(c, f"n{i}", [word() for _ in range(rng.randrange(1, 3))]) for c in "xz" for i in range(9)]
    t = spark.createDataFrame(texts, "chat_key string, text_id long, tokens array<string>")
    n = spark.createDataFrame(names + names[:2], "chat_key string, name string, tokens array<string>")
    got = N.sequence_mentions(t, n, most_names=blocks[0], most_tokens=blocks[1]).collect()
    want = {(c, i, name, k) for c, i, toks in texts for d, name, s in names if c == d for k in range(len(toks or []) - len(s) + 1) if toks[k : k + len(s)] == s}
    assert {(r.chat_key, r.text_id, r.name, r.pos) for r in got} == want


def test_aliases_lead_to_the_canonical_name(spark):
    people = spark.createDataFrame(
        [("c", "Mara Stone", ["the grey pilot"]), ("c", "Tobin", ["old captain"]), ("d", "Ilse", ["grey pilot"])], "chat_key string, name string, aliases array<string>")
    asked = spark.createDataFrame(
        [(1, "c", "Tobin", "Did the grey pilot land?"), (2, "c", None, "Nobody came."), (3, "d", "x", "A grey pilot and the old captain")],
        "query_id long, chat_key string, speaker string, direct_text string")
    got = {(r.query_id, r.term) for r in N.resolved_identity_terms(asked, people).collect() if not r.term.startswith("~")}
    assert got == {(1, "mara"), (1, "stone"), (1, "tobin"), (3, "ilse")}
    vocabulary = spark.createDataFrame([("c", "tobin", True), ("c", "nobody", False)], "chat_key string, tok string, in_identity boolean")
    focus = {(r.query_id, r.term) for r in N.identity_focus_terms(asked, people, vocabulary).collect()}
    assert {(1, "tobin"), (1, "mara"), (1, "grey"), (2, "nobody")} <= focus and not any(q == 3 and t == "tobin" for q, t in focus)


@pytest.fixture(scope="module")
def small(spark):
    """One chat: level-1 rows whose words stand together or three beats apart, levels above, boundaries, facts."""
    beats = lambda *b: list(b)
    l1 = [("c", 10, ["Mara"], "", "Dawn breaks.", beats("The lantern burns by the bridge tonight.", "Rain falls."), "All sleep.", None),
          ("c", 11, ["Mara"], "", "A lantern is lit.", beats("Rain falls.", "Wind rises.", "Fog comes."), "The bridge stands.", None)]
    l1f = spark.createDataFrame(l1, "chat_key string, doc long, participants array<string>, title string, opening string, beats array<string>, closing string, emotional_arc string")
    rows = [("c", r[1], "", "Mara", "", " ".join([r[4], *r[5], r[6]])) for r in l1]
    other = [(20, "", "", "harbor years", "the lantern and the bridge of old"), (30, "", "", "age of lantern", "lantern bridge and more"),
             (40, "Boris", "", "knowledge", "does not know the vault"), (41, "Celia", "", "knowledge", "does not know the vault"),
             (50, "Mara", "", "habit", "walks over the lantern bridge"), (51, "Mara", "", "calls tobin", "captain")]
    rows += [("c", d, i, a, h, b) for d, i, a, h, b in other]
    rows += [("c", 60 + i, "", "", "noise", f"filler words number{i} everywhere") for i in range(20)]
    docs = spark.createDataFrame(rows, "chat_key string, doc long, identity string, anchor string, heading string, body string")
    records = spark.createDataFrame(
        [("c", 10, "l1", None, None, None, 1, None, None), ("c", 11, "l1", None, None, None, 2, None, None),
         ("c", 20, "l2", None, None, None, None, None, [10, 11]), ("c", 30, "l3", None, None, None, None, None, [20, 10]),
         ("c", 40, "facts", "knowledge", "does not know the vault", "knowledge boundary", None, "Boris", None),
         ("c", 41, "facts", "knowledge", "does not know the vault", "knowledge boundary", None, "Celia", None),
         ("c", 50, "facts", "habit", "walks over the lantern bridge", "trait", None, None, None),
         ("c", 51, "facts", "calls Tobin", "captain", "form of address", None, None, None)],
        "chat_key string, doc long, category string, predicate string, value string, fact_category string, order_no long, holder string, children array<long>")
    queries = spark.createDataFrame(
        [(1, "c", "the lantern near the bridge", "what Boris said", ["bridge"])], "query_id long, chat_key string, direct_text string, context_text string, expansions array<string>")
    index = Q.build_index(docs)
    return l1f, records, queries, index


def test_terms_three_beats_apart_are_no_passage(small):
    l1, _, queries, index = small
    got = {r.doc: r.direct_eligible for r in Q.passage_eligibility(queries.withColumn("expansions", F.array().cast("array<string>")), Q.passage_index(l1, index)).collect()}
    assert got[10]
    whole = {r.doc: r.direct_eligible for r in Q.direct_eligibility(queries, index).collect()}
    assert whole[10]
    # no two neighbouring lines of 11 hold both words in order; the frequent words alone decide nothing
    near = Q.passage_index(l1, index)
    rows = Q.near_pairs(Q.direct_terms(queries).filter(~F.col("term").startswith("~")).withColumn("concept", F.lit(True)), near).select("doc.doc").distinct().collect()
    assert {r.doc for r in rows} == {10}


def test_routing_and_boosts(small):
    _, records, _, _ = small
    got = {r.doc: (r.section, r.boost) for r in R.route(records).collect()}
    assert got[40] == ("boundaries", 20.0) and got[51] == ("addresses", 12.0) and got[50] == ("facts", 0.0) and got[10][0] == "l1"


def test_levels_hide_what_they_are_made_of(small):
    l1, records, queries, index = small
    run = lambda **kw: {(r.section, r.id, r.reason) for r in R.recall_run(queries, index, records, Q.passage_index(l1, index), **kw).collect()}
    free = run(forced={})
    deep = run(forced={}, hierarchy=True)
    assert ("l3", 30, "match") in deep and ("l2", 20, "match") in free
    assert not any(s in ("l1", "l2") and i in (10, 20) for s, i, _ in deep)
    # the holder named in the context brings its boundary in, the other one stays out
    assert ("boundaries", 40, "match") in free and not any(i == 41 for _, i, _ in free)
    latest = run(forced={"l1": 1})
    assert ("l1", 11, "latest") in latest and not any(s == "l1" and i == 11 and w == "match" for s, i, w in latest)


def test_relationships_by_both_names(spark, small):
    _, _, queries, index = small
    focus = spark.createDataFrame([(1, "c", "mara"), (1, "c", "stone"), (1, "c", "tobin"), (2, "c", "mara")], "query_id long, chat_key string, term string")
    sides = spark.createDataFrame(
        [("c", 7, ["Mara Stone", "Tobin"]), ("c", 8, ["Mara", "Ilse"]), ("c", 9, ["Mara"]), ("d", 7, ["Mara", "Tobin"]), ("c", 6, None)],
        "chat_key string, doc long, sides array<string>")
    assert {(r.query_id, r.chat_key, r.doc) for r in Q.paired_identities(focus, sides).collect()} == {(1, "c", 7)}
    rows = Q.candidates(queries.withColumn("direct_text", F.lit("Mara and captain lantern")), index,
                        spark.createDataFrame([("c", 50, "relationships"), ("c", 20, "facts")], "chat_key string, doc long, category string"),
                        sides=spark.createDataFrame([("c", 50, ["Mara", "the captain"])], "chat_key string, doc long, sides array<string>"))
    assert {r.doc: r.identity_central for r in rows.collect()} == {50: True, 20: False}
