"""One small case for each mended finding of round 3."""

from chatloom.operators import entities as E


def test_owner_role_covers_every_identity_role(spark):
    refs = spark.createDataFrame([("c", "Mara's guardian"), ("c", "Mara's former harbor ward"), ("c", "Mara's master")], "chat_key string, reference string")
    rel = spark.createDataFrame(
        [("c", "Mara", "Odo", "guardian"), ("c", "Mara", "Pia", "ward"), ("c", "Mara", "Quin", "master")],
        "chat_key string, endpoint_a string, endpoint_b string, kind string")
    got = {r.reference: r.canonical for r in E.owner_role_references(refs, rel).collect()}
    assert got == {"Mara's guardian": "Odo", "Mara's former harbor ward": "Pia", "Mara's master": "Quin"}


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_merge_profiles_broadcasts_no_derived_rows(spark):
    d = spark.createDataFrame([("c", "a", "appearance", "scar on cheek", 1), ("c", "a", "appearance", "Scar", 2)], "chat_key string, id string, field string, detail string, seq long")
    got = E.merge_profiles(d)
    assert "BroadcastHashJoin" not in _plan(got)
    assert got.first().details == ["scar on cheek"]


def test_identity_claims_broadcast_neither_names_nor_word_runs(spark):
    claims = spark.createDataFrame([("c", "the guard", "Mara", "a hint"), ("c", "the thief", "Odo", "a hint")], "chat_key string, reference string, canonical string, evidence string")
    entities = spark.createDataFrame([("c", "1", "Mara", []), ("c", "2", "Odo", [])], "chat_key string, id string, name string, aliases array<string>")
    messages = spark.createDataFrame([("c", 0, "The guard is Mara."), ("c", 1, "Odo slept.")], "chat_key string, idx long, text string")
    got = E.validate_identity_resolutions(claims, entities, messages)
    assert "BroadcastHashJoin" not in _plan(got)
    assert [r.reference for r in got.collect()] == ["the guard"]


def test_merged_facts_are_joined_by_shuffles(spark):
    from chatloom.operators import reconcile as RC

    rows = [("c", "f1", "Mara", "knowledge of gates", "Mara knows gate 1.", "knowledge", 7, 1), ("c", "f2", "Mara", "knowledge of gates", "Mara knows gate 2.", "knowledge", 15, 2)]
    f = spark.createDataFrame(rows, "chat_key string, id string, subject string, predicate string, value string, category string, range_to long, seq long")
    got = RC.merged_facts(f)
    assert "BroadcastHashJoin" not in _plan(got)
    assert [(r.id, r.value) for r in got.collect()] == [("f1", "Mara knows gate 1. Mara knows gate 2.")]


def test_join_side_is_broadcast_by_rows_not_by_file_size(spark):
    from chatloom.operators import scale

    stage = scale.write_through(spark.range(scale.BROADCAST_ROWS + 1), "rows")
    assert "BroadcastHashJoin" not in _plan(spark.range(10).join(scale.sized(stage), "id"))
    assert "BroadcastHashJoin" in _plan(spark.range(10).join(scale.sized(stage.limit(9)), "id"))


def test_descriptions_meet_on_the_rarest_word(spark):
    # 3,000 harbor masters in one chat: on the word "master" this would be nine million pairs
    from pyspark.sql import functions as F

    n = spark.range(3000).select(F.lit("c").alias("chat_key"), F.concat(F.lit("harbor master "), F.col("id").cast("string")).alias("name"), "id")
    plain = n.select("chat_key", F.concat(F.lit("d"), F.col("id")).alias("id"), "name", F.lit("").alias("description"))
    known = n.select("chat_key", F.concat(F.lit("m"), F.col("id")).alias("id"), F.concat(F.lit("Mara"), F.col("id")).alias("name"),
                     F.concat(F.lit("The "), "name", F.lit(", tall.")).alias("description"))
    got = E.description_resolutions(plain.unionByName(known))
    assert got.filter(F.regexp_extract("reference", r"(\d+)", 1) == F.regexp_extract("canonical", r"(\d+)", 1)).count() == 3000
    keys = [line for line in _plan(got).splitlines() if "Join" in line]
    assert keys and not any("NestedLoop" in k for k in keys)
    pairs = got._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by(w" in pairs  # joined by a counted word, not by the role


def test_names_of_the_same_words_are_one_row_of_the_join(spark):
    from pyspark.sql import functions as F

    many = spark.range(500).select(F.lit("c").alias("chat_key"), F.col("id").cast("string").alias("id"), F.lit("Large Ring 1").alias("name"), F.array().cast("array<string>").alias("aliases"))
    one = spark.createDataFrame([("c", "x", "Hot Bolt", [])], many.schema)
    subjects = spark.createDataFrame([("c", "the large ring 1 team"), ("c", "the hot bolt team"), ("c", "Bolt"), ("c", "hot bolt")], "chat_key string, subject string")
    got = E.subject_map(subjects, many.unionByName(one))
    assert {(r.subject, r.canonical) for r in got.collect()} == {("the hot bolt team", "Hot Bolt"), ("Bolt", "Hot Bolt"), ("hot bolt", "Hot Bolt")}
    assert "BroadcastHashJoin" not in _plan(got)


def test_words_in_python_are_those_of_the_jvm(spark):
    from pyspark.sql import functions as F

    from chatloom.functions import text as X, words as W

    latin = [chr(c) for c in range(0x250)] + [chr(c) for c in range(0x2000, 0x2070)] + ["€"]
    odd = ["".join(latin), " ".join(f"a{c}b {c}{c} {c}X" for c in latin), "rock-n-roll's can’t won't shan't o'neil's US us -x- ''' a-'-b", "ends in n't"]
    odd += ["statements ments ements biliti abilities aliti nationalization ing singing bed agreed es e glasses rational fulness"]
    df = spark.createDataFrame([(t,) for t in odd], "text string")
    got = df.select("text", X.tokenize(X.normalize_text("text"), morphology=True).alias("t"), F.col("text").rlike(W.NOT_PLAIN).alias("other")).collect()
    assert [r.t for r in got] == [W.tokens(r.text) for r in got]
    assert not any(r.other for r in got)


def test_terms_and_postings_come_from_one_pass_without_a_shuffle_of_tokens(spark):
    from chatloom.operators import retrieval as Q

    rows = [("c", i, "Mara", "en", "the gate", t) for i, t in enumerate(["gates open 東京都 gate", "gate gate shut", ""])]
    docs = spark.createDataFrame(rows, "chat_key string, doc long, identity string, anchor string, heading string, body string")
    terms = {r.tok: (r.df, r.in_identity) for r in Q.corpus_terms(docs).collect()}
    assert terms["gate"] == (3, False) and terms["mara"] == (3, True) and terms["東京都"] == (1, False)
    assert _plan(Q.corpus_terms(docs)).count("Sort") == 0
    part = Q.build_index(docs, spark.createDataFrame([("gate",)], "tok string"))
    assert {(r.doc, r.tf_heading, r.tf_body, tuple(r.body_pos)) for r in part.postings.collect()} == {(0, 1, 1, (7,)), (1, 1, 2, (0, 1)), (2, 1, 0, ())}
    assert sorted(r.len_body for r in part.documents.collect()) == [0, 3, 8]


def test_endpoint_names_are_no_join_keys(spark):
    from pyspark.sql import functions as F

    from chatloom.operators import merge as M

    a = spark.createDataFrame([(1, "Agent 3"), (2, "Agent 4"), (3, None)], "k long, endpoint_a string")
    b = spark.createDataFrame([(1, "agent  3"), (2, "agent 5"), (3, " ")], "k long, endpoint_b string")
    got = M.endpoint_conflicts(a.join(b.hint("merge"), "k"))
    assert sorted(r.k for r in got.collect()) == [1, 3]
    join = next(line for line in _plan(got).splitlines() if "SortMergeJoin" in line)
    assert "lower" not in join.split("Inner")[0]


def test_overlap_pairs_are_sifted_where_they_meet(spark, monkeypatch):
    import random

    from chatloom.operators import overlap as O

    monkeypatch.setattr(O, "TOKEN_ROWS", 3)  # every word is dealt over several shares
    rnd = random.Random(5)
    sets = {i: rnd.sample(range(60), rnd.choice((3, 6, 9, 40, 55))) for i in range(90)}
    for i in range(60, 90):
        sets[i] = list(dict.fromkeys(sets[i - 60][1:] + [rnd.randrange(60)]))
    df = spark.createDataFrame([("k", i, [f"w{t}" for t in v]) for i, v in sets.items()], "k string, id long, tokens array<string>")
    pairs = O.token_overlap_pairs(df, 3, 0.75, ["k"])
    assert "bit_count" in _plan(pairs)
    got = {(r.left_id, r.right_id): r.shared for r in pairs.collect()}
    first = {}
    for i, v in sets.items():
        first.setdefault(frozenset(v), i)
    want = {(first[frozenset(v)], i): len(v) for i, v in sets.items() if first[frozenset(v)] != i}
    reps = sorted(first.values())
    for i in reps:
        for j in reps:
            shared = len(set(sets[i]) & set(sets[j]))
            if i < j and shared >= 3 and shared / min(len(sets[i]), len(sets[j])) >= 0.75:
                want[i, j] = shared
    assert got == want


class _Map(dict):
    """A map state that counts its calls."""

    calls = 0

    def containsKey(self, k):
        self.calls += 1
        return k in self

    def getValue(self, k):
        self.calls += 1
        return self[k]

    def updateValue(self, k, v):
        self.calls += 1
        self[k] = v

    def removeKey(self, k):
        self.calls += 1
        del self[k]


class _Cell:
    """A value or list state."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def put(self, rows):
        assert rows, "the store takes no empty list"
        self.value = rows

    def clear(self):
        self.value = None


class _Handle:
    def __init__(self):
        self.maps = []

    def getMapState(self, name, key, value):
        self.maps.append(_Map())
        return self.maps[-1]

    def getListState(self, name, schema):
        return _Cell()

    getValueState = getListState


def test_revised_groups_call_the_state_by_blocks():
    import pandas as pd

    from chatloom.streaming import processors as P

    handle, p = _Handle(), P.RevisedGroups(8, 2)
    p.init(handle)
    frame = lambda idx, op, seq: pd.DataFrame({"idx": idx, "seq": seq, "text": "t", "is_user": True, "is_system": False, "op": op})
    n = 40_000
    first = next(p.handleInputRows(("c",), [frame(range(n), "new", range(n))], None))
    assert len(first) == (n - 2) // 8
    later = next(p.handleInputRows(("c",), [frame([3, 20_000], ["delete", "edit"], [n, n + 1])], None))
    assert sum(m.calls for m in handle.maps) < 400
    rows = pd.concat([first, later]).sort_values("n").groupby("group_no").tail(1)
    left = [i for i in range(n) if i != 3][: (n - 3) // 8 * 8]
    standing = rows[rows["op"] == "insert"].sort_values("group_no")
    assert list(zip(standing["range_from"], standing["range_to"])) == list(zip(left[::8], left[7::8]))


def test_state_timeline_reads_and_writes_an_identity_once_a_batch():
    import pandas as pd

    from chatloom.streaming import processors as P

    handle, p = _Handle(), P.StateTimeline()
    p.init(handle)
    n = 3_000
    rows = pd.DataFrame({"subject": "Mara", "attribute": [f"a{i % 3}" for i in range(n)], "value": [str(i) for i in range(n)],
                         "scope": ["ongoing" if i % 3 else "scene" for i in range(n)], "operation": "set", "range_to": [i // 4 for i in range(n)], "seq": range(n)})
    out = pd.concat([next(p.handleInputRows(("c",), [part], None)) for part in (rows[:2_000], rows[2_000:])])
    assert handle.maps[0].calls < 30
    assert list(out["n"]) == list(range(len(out)))
    last = out.groupby("attribute").tail(1).set_index("attribute")
    # 2,997 is the last scene row, of range 749, the newest
    assert {a: (last.op[a], last.value[a]) for a in ("a0", "a1", "a2")} == {"a0": ("set", "2997"), "a1": ("set", "2998"), "a2": ("set", "2999")}
    assert (out["op"] == "end").sum() == 749


def test_entity_pairs_are_made_from_rows_and_never_shuffled(spark):
    rows = [("c", f"e{i}", f"Red Harbor {i}", "", f"{'brass' if i < 2 else 'wooden'} bolt from the red harbor") for i in range(4)]
    rows += [("c", "f1", "Red Harbor 0", "", "brass bolt from the red harbor"), ("c", "g1", "Grey Mill 1", "", "tall tower")]
    e = spark.createDataFrame(rows, "chat_key string, id string, name string, type string, description string")
    pairs = E.semantic_pairs(e, "entities")
    got = sorted((r.left_id, r.right_id) for r in pairs.collect())
    assert got == [("e0", "e1"), ("e0", "e2"), ("e0", "e3"), ("e0", "f1"), ("e1", "e2"), ("e1", "e3"), ("e2", "e3")]
    # no row with a pair goes through an aggregate or an exchange after it is judged
    assert _plan(pairs).lstrip().startswith("Union")


def test_index_sync_writes_only_buckets_that_differ(spark, tmp_path):
    import glob

    from pyspark.sql import functions as F

    from chatloom.sources.memory import chat_bucket
    from chatloom.streaming.store import sync_index

    path, schema = str(tmp_path / "i"), "chat_key string, key string, hash string, text string"
    chats = [f"c{i}" for i in range(200)]
    at = {r.chat_key: r.b for r in spark.createDataFrame([(c,) for c in chats], "chat_key string").select("chat_key", chat_bucket(buckets=64).alias("b")).collect()}
    near = next(c for c in chats[1:] if at[c] == at["c0"])
    far = next(c for c in chats if at[c] != at["c0"])
    rows = [("c0", "k", "h", "x"), (near, "k", "h", "x"), (far, "k", "h", "x"), (far, None, None, None), (far, "k", "h", "x")]
    make = lambda rows: spark.createDataFrame(rows, schema)
    assert sync_index(make(rows), path) == {"added": 5, "deleted": 0}
    assert sync_index(make(rows), path) == {"added": 0, "deleted": 0}
    before = set(glob.glob(f"{path}/chat_bucket={at[far]}/*.parquet"))
    changed = [("c0", "k", "h2", "y"), *rows[2:]]
    assert sync_index(make(changed), path) == {"added": 1, "deleted": 1}
    assert set(glob.glob(f"{path}/chat_bucket={at[far]}/*.parquet")) == before
    got = spark.read.schema(f"{schema}, chat_bucket int").parquet(path).filter(F.col("chat_bucket") == at["c0"]).collect()
    assert sorted((r.chat_key, r.hash) for r in got) == sorted([("c0", "h2"), (near, "h")])


def test_semantic_pairs_join_words_for_undecided_pairs_only(spark, monkeypatch):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(7)
    word = lambda n: "".join(chr(97 + (n // 26**i) % 26) for i in range(3)) + "q"
    heads, rows = [[word(rng.randrange(40)) for _ in range(4)] for _ in range(6)], []
    base = [[word(500 + rng.randrange(400)) for _ in range(rng.choice((5, 8, 60, 400)))] for _ in range(8)]
    for i in range(160):
        h = list(rng.choice(heads))
        for _ in range(rng.randrange(4)):
            h[rng.randrange(4)] = word(rng.randrange(40))
        d = [w if rng.random() > 0.12 else word(500 + rng.randrange(400)) for w in rng.choice(base)]
        rows.append(("c", i, " ".join(h), "aaaaq aaabq " + " ".join(d), ["Mara"] if i % 3 == 0 else []))
    wrote, asked = {}, []
    plain, detail = E.write_through, E._detail_pairs
    monkeypatch.setattr(E, "write_through", lambda df, name="stage", *a: wrote.setdefault(name, df.columns) and plain(df, name, *a))
    monkeypatch.setattr(E, "_detail_pairs", lambda pairs, *a: asked.append(pairs) or detail(pairs, *a))
    for kind, names, words, least in (("threads", ("title", "detail"), 6, 0.5), ("backgrounds", ("topic", "summary"), 7, 0.6)):
        df = spark.createDataFrame(rows, f"chat_key string, id long, {names[0]} string, {names[1]} string, participants array<string>")
        got = {(r.left_id, r.right_id) for r in E.semantic_pairs(df, kind).collect()}
        f = E.semantic_features(df, kind).withColumn("all", F.struct("people", "ids", "head", "detail")).collect()
        want, seen, sure = set(), {}, set()
        for r in f:
            seen.setdefault((r.bucket, r.people, tuple(sorted(r.head)), tuple(r.detail)), []).append(r.id)
        rep = {i: min(ids) for ids in seen.values() for i in ids}
        for a in f:
            for b in f:
                if a.id >= b.id or a.bucket != b.bucket or (rep[a.id] != a.id or rep[b.id] != b.id) and rep[b.id] != a.id:
                    continue
                hs, ds = len({*a.head} & {*b.head}), len({*a.detail} & {*b.detail})
                nh, nd = min(len(a.head), len(b.head)), min(len(a.detail), len(b.detail))
                if kind == "threads" and a.people and b.people and a.people != b.people or hs < 2:
                    continue
                if hs >= 3 and hs >= 0.75 * nh:
                    sure.add((a.id, b.id))
                if (a.id, b.id) in sure or hs >= least * nh and ds >= words and ds >= 0.75 * nd:
                    want.add((a.id, b.id))
        assert got == want and 20 < len(sure) < len(want)
        assert not sure & {(r.left_id, r.right_id) for r in asked[-1].collect()}
    assert "content" not in wrote["features"]


def test_transfers_are_read_once_and_one_word_proves_them(spark, monkeypatch):
    from chatloom.operators import audit as A

    facts = spark.createDataFrame([
        ("c", "pending", "Odo", "condition", "has amulet's key", 0, 7), ("c", "proved", "Odo", "condition", "has lantern", 0, 7),
        ("c", "unsaid", "Odo", "condition", "has compass", 0, 7), ("c", "early", "Odo", "condition", "has amulet", 64, 71),
        ("c", "freed", "Mara Lee", "condition", "is bound", 0, 7), ("c", "other", "Pia", "condition", "is bound", 0, 7),
    ], "chat_key string, id string, subject string, predicate string, value string, range_from long, range_to long")
    messages = spark.createDataFrame([
        ("c", 1, "A", "The smith will give the amulet. Odo received a lantern. He offers a lantern."), ("c", 2, "A", "The guard released Mara Lee. Pia sleeps."), ("c", 3, None, None),
    ], "chat_key string, idx long, name string, text string")
    wrote, plain = [], A.write_through
    monkeypatch.setattr(A, "write_through", lambda df, name="stage", *a: wrote.append(name) or plain(df, name, *a))
    got = A.contradicted_objects(facts, messages)
    assert sorted(r.id for r in got.collect()) == ["early", "other", "proved", "unsaid"]
    # texts are cut into sentences in the written stage, not again for each rule
    assert wrote == ["audited", "transfers"]
    assert "sentence" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_only_words_known_on_the_right_are_ranked(spark):
    import random

    from pyspark.sql import functions as F

    from chatloom.operators.overlap import rare_candidates

    rng = random.Random(3)
    left = [("c", f"l{i}", rng.sample([f"w{k}" for k in range(20)], rng.randrange(1, 7))) for i in range(60)]
    right = [("c", f"r{i}", rng.sample([f"w{k}" for k in range(12)], rng.randrange(1, 7))) for i in range(40)]
    make = lambda rows, name: spark.createDataFrame(rows, f"chat_key string, {name} string, terms array<string>")
    pairs = rare_candidates(make(left, "l"), ["l"], make(right, "r"), ["r"], F.least(F.lit(2), F.size("terms")), ["chat_key"])
    got = {(r.l, r.r) for r in pairs.collect()}
    assert {(l, r) for _, l, a in left for _, r, b in right if len({*a} & {*b}) >= min(2, len(a))} <= got
    assert all({*dict((l, a) for _, l, a in left)[x]} & {*dict((r, b) for _, r, b in right)[y]} for x, y in got)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan
