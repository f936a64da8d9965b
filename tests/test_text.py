"""Text functions against plain Python restatements and hand-made cases."""

import re

from pyspark.sql import functions as F

from chatloom.functions import fixed, text as X


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_tokens_keep_identifiers_and_parts(spark):
    row = one(spark, X.tokenize(F.lit("The US can't find Mara's well-known log-2")).alias("t"))
    assert row.t == ["us", "find", "mara", "well-known", "well", "known", "log-2", "log"]


def test_stems_follow_words(spark):
    row = one(spark, X.tokenize(F.lit("running organization kindness"), True).alias("t"))
    assert row.t == ["running", "~runn", "organization", "~organize", "kindness", "~kind"]


def test_cjk_runs_give_grams(spark):
    row = one(spark, X.tokenize(F.lit("漢字テスト ok")).alias("t"))
    assert row.t == ["漢字", "字テ", "テス", "スト", "漢字テ", "字テス", "テスト", "ok"]
    assert one(spark, X.tokenize(F.lit("東京")).alias("t")).t == ["東京", "東京"]


def test_token_cap_keeps_both_ends(spark):
    text = " ".join(f"word{i}" for i in range(50))
    row = one(spark, X.tokenize(F.lit(text), cap=10).alias("t"), X.tokenize(F.lit(text)).alias("all"))
    assert row.t == [f"word{i}" for i in (0, 1, 2, 3, 4, 45, 46, 47, 48, 49)]
    assert len(row.all) == 50


def test_clip_tokens_is_longest_prefix(spark):
    text = "Añb c dé fgh ijk lmn"

    def size(s):
        wide = sum(ord(c) > 127 for c in s)
        return -(-(4 * wide + len(s) - wide) // 4)

    for limit in (1, 2, 4, 6, 50):
        got = one(spark, X.clip_tokens(F.lit(text), limit).alias("c")).c
        if size(text) <= limit:
            assert got == text
        elif limit <= 1:
            assert got == "…"
        else:
            best = max(n for n in range(len(text) + 1) if size(text[:n] + "…") <= limit)
            assert got == text[:best].rstrip() + "…"


def test_expansion_terms_survive_a_cut_list(spark):
    got = one(
        spark,
        X.parse_expansion_terms(F.lit('<think>hm</think>{"terms": ["a  b", "c", "a b"]}')).alias("ok"),
        X.parse_expansion_terms(F.lit('{"terms": ["old mill", "say \\"hi\\"", "cut of')).alias("cut"),
        X.parse_expansion_terms(F.lit("nothing")).alias("none"),
    )
    assert got.ok == ["a b", "c"]
    assert got.cut == ["old mill", 'say "hi"']
    assert got.none == []


def test_relative_time_binds_first_match_only(spark):
    row = one(spark, X.bind_relative_time(F.lit("He had known her; two days later and now he left"), F.lit("A1")).alias("t"))
    assert row.t == "He had known her; two days later (relative to A1) and now he left"


def test_date_families(spark):
    cases = {
        "1890-03-12": ("calendar", 1890, 3, 12, 0), "12/31/1999 at dawn": ("calendar", 1999, 12, 31, 360),
        "31.12.1999": ("calendar", 1999, 12, 31, 0), "12 March - late April 1890": ("calendar", 1890, 3, 12, 0),
        "3-5 May 2001": ("calendar", 2001, 5, 3, 0), "March 4th, 1900, 3:15 pm": ("calendar", 1900, 3, 4, 915),
        "winter 1812": ("calendar", 1812, 12, 1, 0), "14 July": ("yearless-calendar", 0, 7, 14, 0),
        "around 1750": ("calendar", 1750, 1, 1, 0), "5/6/xxxx": ("yearless-calendar", 0, 5, 6, 0),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.story_date_key("t").alias("k"))
    for r in df.collect():
        family, y, m, d, minutes = cases[r.t]
        assert r.k.family == f"main narrative|{family}", r.t
        assert r.k.value == y * 372 * 1440 + m * 31 * 1440 + d * 1440 + minutes, r.t
    row = one(spark, X.story_date_key(F.lit("Day 7 evening"), F.lit("Dream")).alias("a"), X.story_date_key(F.lit("some day")).alias("b"))
    assert (row.a.family, row.a.value) == ("dream|numbered-day", 7 * 1440 + 1080)
    assert row.b is None


def test_profile_text_round_trip(spark):
    p = F.struct(F.array(F.lit("harbor captain")).alias("role_background"), F.array(F.lit("aged 40")).alias("age_demographics"),
                 F.array().cast("array<string>").alias("appearance"), F.array(F.lit("stubborn"), F.lit("kind")).alias("personality_quirks"))
    text = one(spark, X.format_profile(p).alias("t")).t
    assert text == "Role/background: harbor captain\nAge/demographics: aged 40\nPersonality/quirks: stubborn; kind"
    back = one(spark, X.parse_profile(F.lit(text)).alias("p")).p
    assert back.role_background == ["harbor captain"] and back.personality_quirks == ["stubborn", "kind"] and back.appearance == []


def test_labels_and_previews(spark):
    t = F.struct(F.lit("A2").alias("anchor_id"), F.lit("").alias("frame"), F.lit("after").alias("relation"), F.lit("A1").alias("reference_id"),
                 F.lit("2 days").alias("elapsed"), F.lit("explicit").alias("certainty"))
    row = one(
        spark, X.temporal_summary(t).alias("t"),
        X.correction_preview(F.lit("update"), F.lit("facts"), F.lit("a"), F.lit("b")).alias("c"),
        X.compile_story(F.array(F.lit("one "), F.lit("two")), F.array().cast("array<string>"), F.array(F.lit("here")), F.array().cast("array<string>")).alias("s"),
    )
    assert row.t == "anchor A2; frame main narrative; after A1; explicit interval 2 days; explicit timing"
    assert row.c == "UPDATE facts\nBefore: a\nAfter: b"
    assert row.s == "Premise: one; two\nState at covered boundary: here"


def test_speech_segments(spark):
    row = one(
        spark, X.quoted_segments(F.lit('She said “go now” and "wait"')).alias("q"),
        X.labelled_speech(F.lit("Ann: hello there\nBen: hi\nann: bye"), F.lit("Ann")).alias("l"),
        X.is_vocative(F.lit("Well, Captain, we are late."), F.lit("captain")).alias("v"),
        X.is_vocative(F.lit("The captain was late."), F.lit("captain")).alias("n"),
    )
    assert row.q == ["go now", "wait"] and row.l == ["hello there", "bye"] and row.v and not row.n


def test_importance_and_budgets(spark):
    df = spark.createDataFrame([(None,), (0.0,), (9.0,), (2.5,), (-3.0,)], "v double")
    assert [r[0] for r in df.select(X.clamp_importance("v")).collect()] == [3, 3, 5, 3, 1]
    row = one(spark, X.budget_story(F.lit(None).cast("double")).alias("s"), X.budget_tail(F.lit(200000)).alias("t"), X.budget_story_chunk(F.lit(50000)).alias("c"))
    assert (row.s, row.t, row.c) == (1500, 25000, 50000 - 3000 - 2048)


def test_record_stems(spark):
    words = ["stories", "running", "planned", "boxes", "cats", "glass", "hidden", "identity", "ship"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.record_stem("w").alias("s"))
    assert {r.w: r.s for r in df.collect()} == {
        "stories": "story", "running": "run", "planned": "plan", "boxes": "boxe" if len("boxes") <= 5 else "box",
        "cats": "cats", "glass": "glass", "hidden": "conceal", "identity": "identify", "ship": "ship",
    }


def test_suffix_rules_first_fit_decides():
    # the rule table is read in order; a later, longer-looking rule never overrides
    suffixes = [s for s, _ in fixed.SUFFIX_RULES]
    assert suffixes.index("ization") < suffixes.index("ing") < suffixes.index("s")
    assert all(re.compile(s + "$") for s in suffixes)
