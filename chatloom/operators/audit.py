"""Audit rules: records against their source text and against each other
(B12, B14, B15, C23-C33, C37-C42, C46, D18).

Rule vocabularies stand in one place, those that decide results in ``functions/fixed.py``. Texts and records
meet through (chat, position bucket, word), never through a cross join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fixed, text as X
from .entities import PLACEHOLDER_DESCRIPTION
from .merge import addressee, pair_key
from .overlap import mention_join, rare_candidates
from .records import is_address, merge_address_values, type_family
from .scale import BROADCAST_ROWS, shuffled, top_k, write_through

# ---- rule pack --------------------------------------------------------------------
#: a matter that is still open
PENDING = rf"(?:{fixed.THREAD_GAP})|(?:{fixed.THREAD_COMMITMENT})"
UNCLEAR = rf"(?:{PENDING})|(?i:\bunclear\b)"
EPISTEMIC = r"(?i)\b(?:belief|believes?|suspicion|suspects?|claims?|knowledge|rumou?r|perspective|opinion|thinks?)\b"
#: every role a text may give a person towards another
ROLES = "|".join((*fixed.IDENTITY_ROLE_TOKENS, fixed.RELATIONSHIP_ROLE_WORDS))
#: one word of a pair of teacher and student
MENTORS = r"(?i)\b(?:master|mentor|teacher|instructor|apprentice|padawan|student|pupil|prot[eé]g[eé])\b"
DEAD = r"(?i)\b(?:dead|died|deceased|killed|late)\b"
BAD_FORM = f"{fixed.ADDRESS_PLACEHOLDER}|{fixed.ADDRESS_ABSENCE}|{fixed.ADDRESS_BRACKET}"
TRANSFER_DONE = r"(?i)\b(?:has|holds|carries|received|obtained|was given|took|possesses|transferred)\b"
TRANSFER_PENDING = r"(?i)\b(?:will (?:give|hand|receive)|asks? for|reaches? for|offers?|about to|promises? to give|waiting for)\b"
RELEASED = f"{fixed.RESTRAINT_RELEASED}|{fixed.RESTRAINT_ENDED}"
QUESTION_KNOWLEDGE = r"(?i)^(?:what|who|where|when|why|how|whether)\b|\?\s*$"


# ---- text units -------------------------------------------------------------------
def _terms(value, stop: tuple[str, ...]) -> Column:
    words = F.regexp_extract_all(X.straight_quotes(X.fold_key(value)), F.lit(r"([\p{L}\p{N}][\p{L}\p{N}'-]*)"), 1)
    cut = F.transform(words, lambda w: F.regexp_replace(w, "'s$", ""))
    return F.array_distinct(F.filter(cut, lambda w: (F.length(w) > 1) & ~w.isin(*stop)))


def audit_terms(value) -> Column:
    """Words of two and more characters, possessives cut, stop words out."""
    return _terms(value, fixed.STOP_WORDS)


def beat_terms(value) -> Column:
    """The same with the stop words of beats."""
    return _terms(value, fixed.COVERAGE_STOP_WORDS)


def evidence_sentences(messages: DataFrame) -> DataFrame:
    """(chat_key, idx, speaker, pos, sentence, objective): one row per sentence."""
    rows = messages.select("chat_key", "idx", F.col("name").alias("speaker"), F.posexplode(X.sentences("text")).alias("pos", "sentence"))
    note = F.col("sentence").rlike(r"(?i)^\W*(?:ooc|author(?:'s)? note)\b")
    return rows.withColumn("objective", X.objective_sentence("sentence", note))


def evidence_windows(sentences: DataFrame, width: int = 3) -> DataFrame:
    """Up to ``width`` consecutive sentences of one class inside one message."""
    w = Window.partitionBy("chat_key", "idx", "objective").orderBy("pos")
    t = sentences.withColumn("t", audit_terms("sentence"))
    out = F.col("t")
    for i in range(1, width):
        out = F.array_union(out, F.coalesce(F.lead("t", i).over(w), F.array().cast("array<string>")))
    return t.select("chat_key", "idx", "objective", F.col("pos").alias("unit"), out.alias("terms"))


def _range_hits(records: DataFrame, units: DataFrame, bucket: int) -> DataFrame:
    """Each word of a record that a text unit inside its range has."""
    spread = records.select(
        "chat_key", "id", "range_from", "range_to",
        F.explode(F.sequence(F.floor(F.col("range_from") / bucket), F.floor(F.col("range_to") / bucket))).alias("b"), "terms",
    ).select("chat_key", "id", "range_from", "range_to", "b", F.explode("terms").alias("w"))
    words = units.select("chat_key", "idx", "unit", "objective", F.floor(F.col("idx") / bucket).alias("b"), F.explode("terms").alias("w"))
    return spread.join(words, ["chat_key", "b", "w"]).filter((F.col("idx") >= F.col("range_from")) & (F.col("idx") <= F.col("range_to")))


def range_overlap_counts(records: DataFrame, units: DataFrame, bucket: int = 64) -> DataFrame:
    """Shared words of each record with each text unit inside its range.

    ``records(chat_key, id, range_from, range_to, terms)``, ``units(chat_key,
    idx, unit, objective, terms)``. The join key holds the position bucket, so a
    common word only meets the words of nearby messages.
    """
    return _range_hits(records, units, bucket).groupBy("chat_key", "id", "idx", "unit", "objective").agg(F.count(F.lit(1)).alias("shared"))


# ---- C23 ---------------------------------------------------------------------------
def evidence_audit(records: DataFrame, messages: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Verdict per record: supported or only subjective evidence.

    ``records(chat_key, id, identity, range_from, range_to, text)``. Unsupported:
    subjective evidence reaches the threshold, objective does not, and no
    ``stored(chat_key, identity, text)`` record of the same identity backs it.
    Records of fewer than four words are supported.
    """
    r = records.withColumn("terms", audit_terms("text"))
    r = r.withColumn("need", F.greatest(F.lit(4), F.least(F.lit(9), F.ceil(F.size("terms") * F.lit(0.42)).cast("int"))))
    r = write_through(r, "audit")
    long_enough = F.size("terms") >= 4
    counts = range_overlap_counts(r.filter(long_enough), evidence_windows(evidence_sentences(messages)))
    best = counts.groupBy("chat_key", "id").agg(
        F.max(F.when(F.col("objective"), F.col("shared"))).alias("objective_shared"),
        F.max(F.when(~F.col("objective"), F.col("shared"))).alias("subjective_shared"))
    j = r.join(best, ["chat_key", "id"], "left").fillna(0, ["objective_shared", "subjective_shared"])
    flagged = j.withColumn("unsupported", long_enough & (F.col("subjective_shared") >= F.col("need")) & (F.col("objective_shared") < F.col("need")))
    if stored is not None:
        flagged = write_through(flagged, "flagged")
        s = write_through(stored.select("chat_key", "identity", F.md5("text").alias("sid"), audit_terms("text").alias("terms")).distinct(), "backing")
        asked, of = flagged.filter("unsupported").select("chat_key", "identity", "id", "terms", "need"), ["chat_key", "identity"]
        pairs = rare_candidates(asked, ["id"], s, ["sid"], F.col("need"), of)
        backed = pairs.join(asked, [*of, "id"]).join(s.withColumnRenamed("terms", "st"), [*of, "sid"]).filter(
            F.size(F.array_intersect("terms", "st")) >= F.col("need")).select("chat_key", "id").distinct()
        flagged = flagged.join(backed.withColumn("backed", F.lit(True)), ["chat_key", "id"], "left").withColumn(
            "unsupported", F.col("unsupported") & ~F.coalesce("backed", F.lit(False))).drop("backed")
    return flagged.drop("terms", "need")


def remove_unsupported(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    return records.join(verdicts.filter("unsupported").select("chat_key", "id"), ["chat_key", "id"], "left_anti")


def restore_descriptions(entities: DataFrame, verdicts: DataFrame, previous: DataFrame) -> DataFrame:
    """Unsupported entity descriptions go back to the stored one."""
    bad = verdicts.filter("unsupported").select("chat_key", "id", F.lit(True).alias("bad"))
    p = previous.select("chat_key", X.fold_key("name").alias("k"), F.col("description").alias("old"))
    j = entities.withColumn("k", X.fold_key("name")).join(bad, ["chat_key", "id"], "left").join(p, ["chat_key", "k"], "left")
    return j.withColumn("description", F.when(F.col("bad"), F.coalesce("old", F.lit(""))).otherwise(F.col("description"))).drop("k", "bad", "old")


# ---- C24, C42 -------------------------------------------------------------------------
def cue_family(value) -> Column:
    """First family of cues a text has, null without one: something lasting happened."""
    chain = None
    for name, pattern in fixed.COVERAGE_CUES.items():
        hit = X.as_col(value).rlike(pattern)
        chain = F.when(hit, name) if chain is None else chain.when(hit, name)
    return chain


def beat_category(beat="beat") -> Column:
    """Category of the record a beat lacks: relationship, thread, fact, state or event.

    A relationship needs two people in the beat; the caller knows them.
    """
    has = lambda pattern: X.as_col(beat).rlike(pattern)
    return (
        F.when(has(fixed.COVERAGE_RELATIONSHIP), "relationships").when(has(fixed.COVERAGE_COMMITMENT), "threads")
        .when(has(fixed.COVERAGE_DESIGNATION), "facts").when(has(fixed.COVERAGE_LIMITATION) | has(fixed.COVERAGE_CAPABILITY), "facts")
        .when(has(fixed.COVERAGE_REMAINING_STATE), "states").otherwise("events"))


def uncovered_beats(beats: DataFrame, messages: DataFrame, records: DataFrame) -> DataFrame:
    """Level-1 beats with a durable cue that the text has and no record covers.

    ``beats(chat_key, id, range_from, range_to, beat)``, ``records(chat_key,
    range_from, range_to, text)``. Adds the ``family`` of the cue and the
    ``category`` of the record that is missing.
    """
    b = beats.withColumn("terms", beat_terms("beat")).withColumn("family", cue_family("beat")).filter(
        F.col("family").isNotNull() & ~F.col("beat").rlike(fixed.NOT_ASSERTED) & (F.size("terms") >= 3)).withColumn("category", beat_category())
    b = write_through(b.withColumn("need", F.when(F.size("terms") >= 5, 3).otherwise(2)), "beats")
    # the whole text of the range counts as one unit: distinct words over messages
    units = messages.select("chat_key", "idx", F.lit(0).alias("unit"), F.lit(True).alias("objective"), beat_terms(F.concat_ws(": ", "name", "text")).alias("terms"))
    buckets = F.sequence(F.floor(F.col("range_from") / 64), F.floor(F.col("range_to") / 64))
    spread = b.select("chat_key", "id", "range_from", "range_to", "terms", F.explode(buckets).alias("b")).select(
        "chat_key", "id", "range_from", "range_to", "b", F.explode("terms").alias("w"))
    words = units.select("chat_key", "idx", F.floor(F.col("idx") / 64).alias("b"), F.explode("terms").alias("w"))
    seen = spread.join(words, ["chat_key", "b", "w"]).filter((F.col("idx") >= F.col("range_from")) & (F.col("idx") <= F.col("range_to")))
    sourced = seen.groupBy("chat_key", "id").agg(F.countDistinct("w").alias("n")).join(b.select("chat_key", "id", "need"), ["chat_key", "id"]).filter("n >= need")
    rec = records.select("chat_key", "range_from", "range_to", F.md5("text").alias("rid"), beat_terms("text").alias("rt"))
    rw = rec.select("chat_key", "range_from", "range_to", "rid", F.explode("rt").alias("w"))
    covered = b.select("chat_key", "range_from", "range_to", "id", "need", F.explode("terms").alias("w")).join(
        rw, ["chat_key", "range_from", "range_to", "w"]).groupBy("chat_key", "id", "need", "rid").agg(F.count(F.lit(1)).alias("n")).filter("n >= need")
    return (
        b.join(sourced.select("chat_key", "id"), ["chat_key", "id"], "left_semi")
        .join(covered.select("chat_key", "id").distinct(), ["chat_key", "id"], "left_anti").drop("terms", "need"))


def l1_epistemic_beats(l1: DataFrame, facts: DataFrame, most: int | None = None, keep: int | None = None) -> DataFrame:
    """Add knowledge facts of a range its level-1 text does not reflect.

    ``most`` adds the most important ones only, ``keep`` bounds the beats with them.

    ``l1(chat_key, range_from, range_to, beats, text)``.
    """
    k = facts.filter(X.fold_key("category").isin("knowledge", "knowledge boundary", "knowledge gap"))
    k = k.withColumn("line", X.normalize_text(F.concat_ws(" ", "subject", "value")))
    j = k.join(l1.select("chat_key", "range_from", "range_to", F.concat_ws(" ", "text", F.array_join("beats", " ")).alias("all")), ["chat_key", "range_from", "range_to"])
    missing = j.filter(~X.fold_key("all").contains(X.fold_key("value")))
    order = [F.col("importance").desc(), F.col("id")]
    here = ["chat_key", "range_from", "range_to"]
    top = missing.withColumn("rank", F.row_number().over(Window.partitionBy(*here).orderBy(*order))) if most is None else top_k(missing, here, order, most)
    extra = top.groupBy("chat_key", "range_from", "range_to").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda r: r["line"]).alias("extra"))
    out = l1.join(extra, ["chat_key", "range_from", "range_to"], "left")
    own = F.col("beats") if keep is None else F.slice("beats", 1, F.greatest(F.lit(0), F.lit(keep) - F.size("extra")))
    room = F.concat(own, F.col("extra"))
    return out.withColumn("beats", F.when(F.col("extra").isNull(), F.col("beats")).otherwise(room)).drop("extra")


# ---- C25, C26 ---------------------------------------------------------------------------
def settles(title: Column, evidence: Column, rules=fixed.THREAD_RULES) -> Column:
    """The completed action fits the goal the title names; no named goal fits any."""
    chain = F.when(title.rlike(rules[0][0]), evidence.rlike(rules[0][1]))
    for goal, action in rules[1:]:
        chain = chain.when(title.rlike(goal), evidence.rlike(action))
    return chain.otherwise(F.lit(True))


def resolve_threads(threads: DataFrame, evidence: DataFrame, messages: DataFrame) -> DataFrame:
    """Close, reopen and split open matters.

    ``threads(chat_key, id, title, detail, status, participants, range_from,
    range_to)``, ``evidence(chat_key, range_from, range_to, text)``. A thread is
    closed by a completed clause that shares two title words (one for a one-word
    title) besides names, fits the named goal, names a participant, and is
    backed by a message of its range. "A and B" with only A settled becomes a
    resolved A and an open B. A resolved thread that still reads as pending is
    reopened. Output: ``resolution`` tells what happened.
    """
    names = F.flatten(F.transform("participants", audit_terms))
    t = threads.withColumn("tt", F.array_except(audit_terms("title"), names)).withColumn("parts", F.split("title", r"(?i)\s+and\s+"))
    t = write_through(t, "threads")
    c = evidence.select("chat_key", "range_from", "range_to", F.explode(X.clauses("text")).alias("clause")).distinct()
    c = c.filter(F.col("clause").rlike(fixed.THREAD_RESOLUTION) & ~F.col("clause").rlike(PENDING) & ~F.col("clause").rlike(fixed.NOT_ASSERTED))
    c = c.withColumn("cid", F.md5(F.concat_ws("|", "chat_key", F.col("range_from").cast("string"), "clause"))).withColumn("terms", audit_terms("clause"))
    c = write_through(c, "clauses")
    # a clause must be carried by one message of its range
    at = lambda position: F.floor(F.col(position) / 64)
    near = write_through(c.select("chat_key", F.explode(F.sequence(at("range_from"), at("range_to"))).alias("b")).distinct(), "near")
    if near.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:  # few clauses: only messages around them are cut into words
        messages = messages.withColumn("b", at("idx")).join(F.broadcast(near), ["chat_key", "b"], "left_semi")
    msgs = messages.select("chat_key", "idx", F.lit(0).alias("unit"), F.lit(True).alias("objective"), audit_terms(F.concat_ws(": ", "name", "text")).alias("terms"))
    carried = range_overlap_counts(c.withColumnRenamed("cid", "id"), msgs).join(
        c.select("chat_key", F.col("cid").alias("id"), F.greatest(F.lit(2), F.least(F.lit(6), F.ceil(F.size("terms") * F.lit(0.35)).cast("int"))).alias("need")), ["chat_key", "id"]
    ).filter("shared >= need").select("chat_key", F.col("id").alias("cid")).distinct()
    live = c.join(carried, ["chat_key", "cid"], "left_semi")
    needed = F.least(F.lit(2), F.size("tt"))
    pairs = rare_candidates(t.filter("status = 'open'").withColumn("terms", F.col("tt")), ["id"], live, ["cid"], needed, ["chat_key"])
    j = pairs.join(t, ["chat_key", "id"]).join(live.select("chat_key", "cid", "clause", "terms"), ["chat_key", "cid"])
    j = j.withColumn("shared", F.size(F.array_intersect("tt", "terms")))
    named = (F.size("participants") == 0) | F.exists("participants", lambda p: X.padded_words(F.col("clause")).contains(X.padded_words(p)))
    ok = j.filter((F.col("shared") >= needed) & named & settles(F.col("title"), F.col("clause")))
    best = ok.groupBy("chat_key", "id").agg(F.max_by("clause", F.struct("shared", "cid")).alias("clause"))
    d = t.join(best, ["chat_key", "id"], "left")
    covers = lambda part: F.size(F.array_intersect(F.array_except(audit_terms(part), names), audit_terms("clause"))) > 0
    two = (F.size("parts") == 2) & F.col("clause").isNotNull()
    only_first, only_second = two & covers(F.col("parts")[0]) & ~covers(F.col("parts")[1]), two & ~covers(F.col("parts")[0]) & covers(F.col("parts")[1])
    reopened = (F.col("status") == "resolved") & F.col("detail").rlike(PENDING)
    base = [c2 for c2 in threads.columns if c2 not in ("id", "title", "status")]

    def row(i: Column, title: Column, status: Column | str, what: str) -> Column:
        status = F.lit(status) if isinstance(status, str) else status
        return F.struct(i.alias("id"), title.alias("title"), status.alias("status"), F.lit(what).alias("resolution"))

    successor = F.concat(F.col("id"), F.lit("#next"))
    out = (
        F.when(only_first, F.array(row(F.col("id"), F.col("parts")[0], "resolved", "part"), row(successor, F.col("parts")[1], "open", "successor")))
        .when(only_second, F.array(row(F.col("id"), F.col("parts")[1], "resolved", "part"), row(successor, F.col("parts")[0], "open", "successor")))
        .when(F.col("clause").isNotNull(), F.array(row(F.col("id"), F.col("title"), "resolved", "closed")))
        .when(reopened, F.array(row(F.col("id"), F.col("title"), "open", "reopened")))
        .otherwise(F.array(row(F.col("id"), F.col("title"), F.col("status"), "kept"))))
    return d.select(*base, F.explode(out).alias("o")).select("o.*", *base)


def keep_resolved_history(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """An incoming open row does not undo a stored resolution of the same title."""
    done = stored.filter("status = 'resolved'").select("chat_key", X.fold_key("title").alias("k"), F.lit(True).alias("done")).distinct()
    j = incoming.withColumn("k", X.fold_key("title")).join(done, ["chat_key", "k"], "left")
    return j.withColumn("status", F.when(F.col("done") & (F.col("status") == "open") & ~F.col("detail").rlike(r"(?i)\b(?:again|reopened|anew)\b"), "resolved").otherwise(F.col("status"))).drop("k", "done")


def resolve_identity_threads(threads: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Accepted identity resolutions close matching identity matters.

    A detail sentence that is still pending becomes a successor.
    """
    cue = r"(?i)\b(?:identity|who (?:is|was|are)|true name|real name|unidentified|unknown)\b"
    t = threads.filter((F.col("status") == "open") & F.col("title").rlike(cue)).withColumn("tt", audit_terms("title"))
    r = resolutions.select("chat_key", "reference", "canonical", audit_terms("reference").alias("rt")).filter(F.size("rt") > 0)
    # all words of a reference stand in the title, its rarest one too
    pairs = rare_candidates(r.withColumn("terms", F.col("rt")), ["reference"], t.withColumn("terms", F.col("tt")), ["id"], F.size("rt"), ["chat_key"])
    hit = pairs.join(r, ["chat_key", "reference"]).join(t.select("chat_key", "id", "tt"), ["chat_key", "id"])
    hit = hit.filter(F.size(F.array_except("rt", "tt")) == 0).withColumn("n", F.size("rt"))
    best = hit.groupBy("chat_key", "id").agg(F.max_by("canonical", F.struct("n", "canonical")).alias("canonical"))
    j = threads.join(best, ["chat_key", "id"], "left")
    left = F.array_join(F.filter(X.sentences("detail"), lambda s: s.rlike(UNCLEAR) & ~s.rlike(cue)), " ")
    closed = j.select(*[c for c in threads.columns if c != "status"], F.when(F.col("canonical").isNotNull(), "resolved").otherwise(F.col("status")).alias("status"))
    successor = j.filter(F.col("canonical").isNotNull()).withColumn("rest", left).filter("rest <> ''").select(
        *[c for c in threads.columns if c not in ("id", "title", "detail", "status")],
        F.concat("id", F.lit("#next")).alias("id"), X.clip(F.concat(F.col("canonical"), F.lit(": "), F.col("rest")), 120).alias("title"), F.col("rest").alias("detail"), F.lit("open").alias("status"))
    return closed.unionByName(successor)


# ---- C28, C46 -------------------------------------------------------------------------
def address_forms(facts: DataFrame) -> DataFrame:
    """One row per address form: speaker, addressee, form."""
    a = facts.filter(is_address() & (addressee() != ""))
    forms = F.array_distinct(X.nonempty(F.transform(F.split("value", r"\s*;\s*"), lambda p: X.normalize_text(F.regexp_replace(p, "^[\"'“”‘’]+|[\"'“”‘’]+$", "")))))
    return a.select("chat_key", "id", "range_from", "range_to", X.fold_key("subject").alias("speaker"), addressee().alias("addressee"), F.explode(forms).alias("form"))


def address_evidence(forms: DataFrame, messages: DataFrame, own_range: bool) -> DataFrame:
    """Who uses each form: authored vocatives of both sides and explicit statements.

    Forms meet messages on their rarest word, inside the buckets of their range if
    only that counts; texts follow for the pairs, and the whole form is checked.
    """
    words = lambda c: F.array_distinct(F.split(F.trim(X.padded_words(c)), " "))
    f = forms.withColumn("terms", words("form"))
    m = messages.select("chat_key", "idx", words("text").alias("terms"))
    key, bucket = ["chat_key"], lambda c: F.floor(F.col(c) / 64)
    if own_range:
        key = ["chat_key", "bucket"]
        f = f.withColumn("bucket", F.explode(F.sequence(bucket("range_from"), bucket("range_to"))))
        m = m.withColumn("bucket", bucket("idx"))
    pairs = rare_candidates(f, ["id", "form"], m, ["idx"], F.size("terms"), key)
    j = pairs.join(forms, ["chat_key", "id", "form"])
    if own_range:
        j = j.filter((F.col("idx") >= F.col("range_from")) & (F.col("idx") <= F.col("range_to")))
    texts = messages.select("chat_key", "idx", X.fold_key("name").alias("author"), "text")
    j = j.join(texts, ["chat_key", "idx"]).filter(X.padded_words("text").contains(X.padded_words("form")))
    speech = X.sentences("text")
    vocative = F.exists(speech, lambda s: X.is_vocative(s, F.col("form")))
    says = F.exists(speech, lambda s: X.padded_words(s).contains(X.padded_words(F.col("speaker"))) & X.padded_words(s).contains(X.padded_words(F.col("form")))
                    & X.padded_words(s).contains(X.padded_words(F.col("addressee"))) & s.rlike(r"(?i)\b(?:calls?|called|addresse[sd]|names?|refers? to)\b"))
    has_author = lambda who: F.col("author") == F.col(who)
    pronoun_use = F.exists(speech, lambda s: s.rlike(r'["“]') & s.rlike(r"(?i)\b(?:pointedly|contempt|instead of|refuses?|disrespect)\b"))
    return j.groupBy("chat_key", "id", "form").agg(
        F.bool_or(vocative & has_author("speaker")).alias("forward"), F.bool_or(vocative & has_author("addressee")).alias("reverse"),
        F.bool_or(says).alias("explicit"), F.bool_or(pronoun_use).alias("significant"))


def address_form_audit(facts: DataFrame, messages: DataFrame, own_range: bool = False) -> DataFrame:
    """Verdict per address form: keep, flip or drop with its reason.

    A form in both directions whose use is proven only one way is dropped from
    the other; a self form needs an explicit statement.
    """
    forms = write_through(address_forms(facts), "forms")
    ev = address_evidence(forms, messages, own_range)
    j = forms.join(ev, ["chat_key", "id", "form"], "left").fillna(False, ["forward", "reverse", "explicit", "significant"])
    other = forms.select("chat_key", F.col("addressee").alias("speaker"), F.col("speaker").alias("addressee"), F.lower("form").alias("fk"), F.lit(True).alias("mirrored")).distinct()
    j = j.withColumn("fk", F.lower("form")).join(other, ["chat_key", "speaker", "addressee", "fk"], "left")
    proven = F.col("forward") | F.col("explicit")
    verdict = (
        F.when(X.fold_key("form").rlike(BAD_FORM) | ~F.col("form").rlike(r"[\p{L}\p{N}]"), "drop-malformed")
        .when(F.col("form").rlike(fixed.ADDRESS_PRONOUN) & ~F.col("significant"), "drop-pronoun")
        .when((F.col("speaker") == F.col("addressee")) & ~F.col("explicit"), "drop-self")
        .when(F.col("reverse") & ~proven & ~F.coalesce("mirrored", F.lit(False)), "flip")
        .when(F.coalesce("mirrored", F.lit(False)) & ~proven, "drop-mirrored")
        .when(~proven, "drop-unsupported").otherwise("keep"))
    return j.withColumn("verdict", verdict).select("chat_key", "id", "speaker", "addressee", "form", "verdict")


def apply_address_audit(verdicts: DataFrame) -> DataFrame:
    """Address facts rebuilt from the kept and flipped forms; same direction folds into one."""
    flip = F.col("verdict") == "flip"
    kept = verdicts.filter(F.col("verdict").isin("keep", "flip")).select(
        "chat_key", F.when(flip, F.col("addressee")).otherwise(F.col("speaker")).alias("speaker"),
        F.when(flip, F.col("speaker")).otherwise(F.col("addressee")).alias("addressee"), "form", "id")
    one = kept.groupBy("chat_key", "speaker", "addressee", F.lower("form").alias("k")).agg(F.min("form").alias("form"), F.min("id").alias("id"))
    return one.groupBy("chat_key", "speaker", "addressee").agg(F.array_join(F.array_sort(F.collect_list("form")), "; ").alias("value"), F.min("id").alias("id")).select(
        "chat_key", "id", F.col("speaker").alias("subject"), F.concat(F.lit("calls "), "addressee").alias("predicate"), "value", F.lit("form of address").alias("category"))


def generic_address(predicate="predicate", category="category") -> Column:
    """An address fact that names nobody: "uses nickname"."""
    return X.fold_key(category).rlike(fixed.GENERIC_ADDRESS_CATEGORY) & X.fold_key(predicate).rlike(fixed.GENERIC_ADDRESS_USE)


def fold_generic_addresses(facts: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Address facts without an addressee, folded where exactly one address identity fits.

    ``facts(chat_key, id, subject, predicate, value, category, temporal_anchor_id,
    importance, sources)``, ``stored`` alike. Rows of one speaker meet on each form they
    hold; the anchor may be blank on either side, which fits any. An identity is speaker,
    addressee and anchor. With one identity the row goes into its smallest local fact
    (forms, sources and importance unite there); if only stored facts have it, the row
    takes their addressee. With none or several it stays as it is.
    """
    cols = facts.columns
    forms = lambda c: F.array_distinct(F.transform(X.nonempty(F.split(merge_address_values(c), r"\s*;\s*")), lambda v: X.fold_key(v)))
    slim = lambda df, local: df.select(
        "chat_key", "id", "subject", "predicate", "category", "value", X.fold_key("subject").alias("speaker"),
        F.coalesce("temporal_anchor_id", F.lit("")).alias("anchor"), F.lit(local).alias("local"))
    known = slim(facts, True) if stored is None else slim(facts, True).unionByName(slim(stored, False))
    named = known.filter(is_address() & ~generic_address() & (addressee() != "") & (F.col("speaker") != "")).withColumn("to", addressee())
    asked = slim(facts, True).filter(generic_address() & (F.col("speaker") != ""))
    left = asked.select("chat_key", "speaker", F.col("id").alias("gid"), F.col("anchor").alias("ganchor"), F.explode(forms("value")).alias("form"))
    right = named.select("chat_key", "speaker", "id", "anchor", "to", "local", F.explode(forms("value")).alias("form"))
    met = left.join(right, ["chat_key", "speaker", "form"]).filter((F.col("ganchor") == "") | (F.col("anchor") == "") | (F.col("ganchor") == F.col("anchor")))
    identity = F.struct("speaker", "to", "anchor")
    one = met.groupBy("chat_key", "gid").agg(
        F.min(identity).alias("lo"), F.max(identity).alias("hi"), F.min(F.when(F.col("local"), F.col("id"))).alias("into"),
        F.min(F.when(~F.col("local"), F.struct("id", "to"))).alias("there"))
    one = write_through(one.filter("lo = hi").select("chat_key", F.col("gid").alias("id"), "into", "there"), "generic-addresses")
    folded = facts.join(one.filter("into is not null").select("chat_key", "id", "into"), ["chat_key", "id"])
    gains = folded.groupBy("chat_key", F.col("into").alias("id")).agg(
        F.array_sort(F.collect_set(F.struct("id", "value"))).alias("__more"), F.max("importance").alias("__importance"), F.flatten(F.collect_list("sources")).alias("__sources"))
    rest = facts.join(one.filter("into is not null").select("chat_key", "id"), ["chat_key", "id"], "left_anti").join(gains, ["chat_key", "id"], "left").join(
        one.filter("into is null").select("chat_key", "id", "there"), ["chat_key", "id"], "left")
    more = F.array_join(F.transform("__more", lambda m: m["value"]), "; ")
    moved = F.col("there").isNotNull()
    changed = {
        "value": F.when(F.col("__more").isNull(), F.col("value")).otherwise(merge_address_values("value", more)),
        "importance": F.greatest("importance", "__importance"),
        "sources": F.when(F.col("__more").isNull(), F.col("sources")).otherwise(F.array_distinct(F.concat(F.coalesce("sources", F.array().cast(facts.schema["sources"].dataType)), F.col("__sources")))),
        "predicate": F.when(moved, F.concat(F.lit("calls "), F.col("there.to"))).otherwise(F.col("predicate")),
        "category": F.when(moved, F.lit("form of address")).otherwise(F.col("category")),
    }
    return rest.select(*[changed.get(c, F.col(c)).alias(c) for c in cols], F.col("there.id").alias("target_id"))


def audit_stored_addresses(facts: DataFrame, messages: DataFrame, corrected: DataFrame) -> DataFrame:
    """Audit stored address facts against their own range only; corrected ones stay."""
    v = address_form_audit(facts, messages, own_range=True)
    fixed_ids = corrected.select("chat_key", "id").withColumn("fixed", F.lit(True))
    return v.join(fixed_ids, ["chat_key", "id"], "left").withColumn("verdict", F.when(F.col("fixed"), "keep").otherwise(F.col("verdict"))).drop("fixed")


# ---- C29, C30 ----------------------------------------------------------------------------
def topic_of(predicate="predicate") -> Column:
    return X.normalize_text(F.regexp_extract(X.normalize_text(predicate), r"(?i)^knowledge of\s+(.+?)(?:['’]s\s+(?:(?:true|real)\s+)?(?:identity|name))?$", 1))


def knowledge_boundaries(facts: DataFrame, messages: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """Verdict on knowledge facts (C29): withheld, retired, answered, misowned or kept.

    ``facts(chat_key, id, subject, predicate, value, category, seq)``.
    """
    f = facts.filter(X.fold_key("category").isin("knowledge", "knowledge boundary", "knowledge gap")).select(
        "chat_key", "id", X.fold_key("subject").alias("holder"), F.lower(topic_of()).alias("topic"), X.fold_key("predicate").alias("pk"),
        X.fold_key("category").alias("cat"), F.col("value"), "seq")
    f = write_through(f, "boundaries")
    negative = r"(?i)\b(?:not|never|unaware|no knowledge|unknown|n't)\b"
    is_boundary = F.col("cat").isin("knowledge boundary", "knowledge gap") | F.col("value").rlike(negative)
    b, k = f.filter(is_boundary), f.filter(~is_boundary)
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(X.fold_key(c), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: F.length(w) >= 4))
    # a sentence that names holder and topic and a way of learning grants it
    g = evidence_sentences(messages).filter(F.col("sentence").rlike(r"(?i)\b(?:learn(?:s|ed)|knows?|knew|told|reveal(?:s|ed)|recogni[sz]e[sd]?|realis|realiz)") & ~F.col("sentence").rlike(negative))
    split = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    g = g.select("chat_key", "idx", "pos", F.lower(X.padded_words("sentence")).alias("s")).withColumn("terms", split("s"))
    blocked = k.join(b.select("chat_key", "holder", "topic", F.col("seq").alias("b_seq")), ["chat_key", "holder", "topic"]).select("chat_key", "id", "holder", "topic").distinct()
    asked = blocked.withColumn("terms", split(F.concat_ws(" ", "holder", "topic")))
    pairs = rare_candidates(asked, ["id", "holder", "topic"], g, ["idx", "pos"], F.size("terms"), ["chat_key"])
    granted = pairs.join(g.drop("terms"), ["chat_key", "idx", "pos"]).filter(F.col("s").contains(F.concat(F.lit(" "), F.col("holder"), F.lit(" "))) & F.col("s").contains(F.concat(F.lit(" "), F.col("topic"), F.lit(" ")))).select("chat_key", "id").distinct()
    withheld = blocked.join(granted, ["chat_key", "id"], "left_anti").select("chat_key", "id", F.lit("withheld").alias("v"))
    # newer accepted knowledge of the same holder and predicate retires a boundary
    kk = k.join(withheld.select("chat_key", "id"), ["chat_key", "id"], "left_anti")
    pair = b.select("chat_key", "id", "holder", "pk", "seq", words("value").alias("bw")).join(
        kk.select("chat_key", "holder", "pk", F.col("seq").alias("k_seq"), words("value").alias("kw")), ["chat_key", "holder", "pk"]).filter(
        (F.col("k_seq") > F.col("seq")) & (F.size(F.array_intersect("bw", "kw")) >= 2))
    verdicts = withheld.unionByName(pair.select("chat_key", "id", F.lit("retired").alias("v")).distinct())
    if resolutions is not None:
        r = resolutions.select("chat_key", X.fold_key("reference").alias("topic"))
        verdicts = verdicts.unionByName(b.join(r, ["chat_key", "topic"], "left_semi").select("chat_key", "id", F.lit("answered").alias("v")))
    asked_only = k.filter(F.col("value").rlike(QUESTION_KNOWLEDGE)).select("chat_key", "id", F.lit("misowned").alias("v"))
    verdicts = verdicts.unionByName(asked_only).groupBy("chat_key", "id").agg(F.min("v").alias("verdict"))
    return f.select("chat_key", "id").join(verdicts, ["chat_key", "id"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("kept")))


def resolve_relational_topics(facts: DataFrame, relationships: DataFrame) -> DataFrame:
    """"knowledge of X's ROLE" becomes the one related person with that role.

    The owner must be the holder ("her", "his", "their" or the own name).
    """
    pattern = rf"(?i)^knowledge of\s+(?:(her|his|their)|(.+?)['’]s)\s+(?:(?:former|previous|dead|missing|unknown)\s+)?({ROLES})(?:['’]s\s+(?:true\s+|real\s+)?identity)?$"
    p = X.normalize_text("predicate")
    f = facts.withColumn("__owner", X.fold_key(F.regexp_extract(p, pattern, 2))).withColumn("__role", F.lower(F.regexp_extract(p, pattern, 3))).withColumn("__h", X.fold_key("subject"))
    asked = f.filter((F.col("__role") != "") & ((F.col("__owner") == "") | (F.col("__owner") == F.col("__h"))) & (X.fold_key("category") == "knowledge"))
    both = relationships.select("chat_key", X.fold_key("endpoint_a").alias("__h"), X.normalize_text("endpoint_b").alias("other"), X.fold_key("kind").alias("kind")).unionByName(
        relationships.select("chat_key", X.fold_key("endpoint_b").alias("__h"), X.normalize_text("endpoint_a").alias("other"), X.fold_key("kind").alias("kind")))
    rolew = both.select("chat_key", "__h", "other", F.explode(F.array_distinct(F.regexp_extract_all("kind", F.lit(rf"\b({ROLES})\b"), 1))).alias("__role"))
    one = rolew.groupBy("chat_key", "__h", "__role").agg(F.min("other").alias("other"), F.max("other").alias("hi")).filter("other = hi").drop("hi")
    hit = asked.select("chat_key", "id", "__h", "__role").join(one, ["chat_key", "__h", "__role"]).select("chat_key", "id", "other")
    return facts.join(hit, ["chat_key", "id"], "left").withColumn("predicate", F.when(F.col("other").isNotNull(), F.concat(F.lit("knowledge of "), "other")).otherwise(F.col("predicate"))).drop("other")


# ---- C31 -----------------------------------------------------------------------------------
def _absent(found: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    return found.join(stored.select(*keys).distinct(), keys, "left_anti")


def derive_aliases(messages: DataFrame, entities: DataFrame) -> DataFrame:
    """"NAME is known as X" -> alias of a known entity, when not yet there."""
    p = r"(?i)^(.{2,60}?),?\s+(?:is|was)?\s*(?:also\s+)?(?:known as|called|nicknamed)\s+[\"“]?([\p{Lu}][\p{L}\p{N}' -]{1,40}?)[\"”]?[.!;,]?$"
    s = evidence_sentences(messages).select("chat_key", F.trim(F.regexp_extract("sentence", p, 1)).alias("who"), F.trim(F.regexp_extract("sentence", p, 2)).alias("alias")).filter("who <> '' AND alias <> ''")
    e = entities.select("chat_key", F.col("id"), X.fold_key("name").alias("k"), "aliases")
    j = s.withColumn("k", X.fold_key("who")).join(e, ["chat_key", "k"]).filter(~F.exists("aliases", lambda a: X.fold_key(a) == X.fold_key(F.col("alias"))))
    return j.select("chat_key", "id", "alias").distinct()


def derive_commitments(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """"I will ... tomorrow" -> an open thread of the speaker, when none is alike."""
    s = messages.select("chat_key", "idx", F.col("name").alias("speaker"), F.posexplode(X.sentences("text")).alias("pos", "sentence"))
    s = s.withColumn("goal", F.trim(F.regexp_extract(X.straight_quotes("sentence"), fixed.FUTURE_COMMITMENT, 1))).filter((F.col("goal") != "") & F.col("goal").rlike(fixed.FUTURE_ANCHOR) & ~F.col("sentence").rlike(r"(?i)\b(?:if|maybe|might|perhaps)\b"))
    s = s.withColumn("cid", F.concat_ws("-", F.lit("commit"), "chat_key", F.col("idx").cast("string"), F.col("pos").cast("string"))).withColumn("terms", audit_terms("goal"))
    s = write_through(s, "commitments")
    open_t = threads.filter("status = 'open'").select("chat_key", "id", F.explode(audit_terms(F.concat_ws(" ", "title", "detail"))).alias("w"))
    known = s.select("chat_key", "cid", F.size("terms").alias("n"), F.explode("terms").alias("w")).join(open_t, ["chat_key", "w"]).groupBy("chat_key", "cid", "n", "id").agg(
        F.count(F.lit(1)).alias("c")).filter((F.col("c") >= 3) | ((F.col("n") < 6) & (F.col("c") >= 2))).select("chat_key", "cid").distinct()
    return s.join(known, ["chat_key", "cid"], "left_anti").select(
        "chat_key", F.col("cid").alias("id"), X.clip(F.concat(F.col("speaker"), F.lit(" will "), F.col("goal")), 120).alias("title"),
        F.col("sentence").alias("detail"), F.lit("open").alias("status"), F.array("speaker").alias("participants"), F.col("idx").alias("range_from"), F.col("idx").alias("range_to"))


def derive_knowledge(messages: DataFrame, entities: DataFrame, facts: DataFrame) -> DataFrame:
    """"HOLDER knows TOPIC ..." -> a knowledge fact, when not yet there.

    The holder is the nearest named person before the verb, the topic the
    nearest one after it; questions and hedged sentences do not count.
    """
    verb = r"(?i)\b(?:knows?|knew|already knew|is aware of|was aware of|remembers?|recogni[sz]es?)\b"
    s = evidence_sentences(messages).filter(F.col("objective") & F.col("sentence").rlike(verb) & ~F.col("sentence").rlike(r"\?|(?i)\b(?:not|never|n't)\b"))
    s = s.withColumn("text_id", F.concat_ws("-", F.col("idx").cast("string"), F.col("pos").cast("string"))).withColumnRenamed("sentence", "text")
    s = write_through(s, "knowing").withColumn("vpos", F.size(F.split(F.trim(X.padded_words(F.regexp_extract("text", rf"^(.*?){verb[4:]}", 1))), " ")))
    people = entities.filter(type_family("type").isin("person", ""))
    m = mention_join(s.select("chat_key", "text_id", "text"), people).filter(~F.col("possessive"))
    j = s.select("chat_key", "text_id", "text", "vpos", "idx").join(m, ["chat_key", "text_id"])
    holder = F.max_by(F.when(F.col("first_pos") <= F.col("vpos"), F.col("name")), F.when(F.col("first_pos") <= F.col("vpos"), F.col("first_pos")))
    topic = F.min_by(F.when(F.col("last_pos") > F.col("vpos"), F.col("name")), F.when(F.col("last_pos") > F.col("vpos"), F.col("last_pos")))
    g = j.groupBy("chat_key", "text_id", "text", "idx").agg(holder.alias("subject"), topic.alias("topic")).filter("subject IS NOT NULL AND topic IS NOT NULL AND subject <> topic")
    out = g.select("chat_key", F.concat_ws("-", F.lit("know"), "chat_key", "text_id").alias("id"), "subject", F.concat(F.lit("knowledge of "), "topic").alias("predicate"),
                   F.col("text").alias("value"), F.lit("knowledge").alias("category"), F.col("idx").alias("seq"))
    keyed = out.withColumn("ks", X.fold_key("subject")).withColumn("kp", X.fold_key("predicate"))
    return _absent(keyed, facts.select("chat_key", X.fold_key("subject").alias("ks"), X.fold_key("predicate").alias("kp")), ["chat_key", "ks", "kp"]).drop("ks", "kp")


def derive_relationships(facts: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """A lasting fact that states a role between exactly two people -> relationship."""
    f = facts.filter(~F.concat_ws(" ", "predicate", "category").rlike(EPISTEMIC) & (F.coalesce("persistence", F.lit("persistent")) != "temporary"))
    f = f.withColumn("text", F.concat_ws(" ", "subject", "predicate", "value")).withColumn("kind", F.lower(F.regexp_extract("text", rf"(?i)\b({ROLES})\b", 1))).filter("kind <> ''")
    m = mention_join(f.select("chat_key", F.col("id").alias("text_id"), "text"), entities.filter(type_family("type").isin("person", "")))
    two = m.groupBy("chat_key", "text_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("name", "first_pos").alias("endpoint_a"), F.max_by("name", "first_pos").alias("endpoint_b")).filter("n = 2")
    out = f.select("chat_key", F.col("id").alias("text_id"), "kind", F.col("text").alias("dynamic")).join(two, ["chat_key", "text_id"])
    keyed = out.withColumn("pk", pair_key())
    fresh = _absent(keyed, relationships.select("chat_key", pair_key().alias("pk")), ["chat_key", "pk"])
    status = F.when(F.col("dynamic").rlike(rf"(?i)\b(?:former|ex-|once)\b|{DEAD[4:]}"), "ended").otherwise("active")
    return fresh.groupBy("chat_key", "pk").agg(F.min_by(F.struct("text_id", "endpoint_a", "endpoint_b", "kind", "dynamic"), "text_id").alias("r")).select(
        "chat_key", F.concat(F.lit("rel-"), "r.text_id").alias("id"), "r.endpoint_a", "r.endpoint_b", "r.kind", "r.dynamic").withColumn("status", status)


def derive_identity_gaps(facts: DataFrame, threads: DataFrame) -> DataFrame:
    """A fact that someone does not know a person's identity -> open thread."""
    gap = r"(?i)\b(?:does not|doesn't|did not) know (?:who .+ is|.+?['’]s? (?:true |real )?identity|the identity of .+)"
    f = facts.filter(F.col("value").rlike(gap))
    out = f.select("chat_key", F.concat(F.lit("gap-"), "id").alias("id"), X.clip(F.concat(F.lit("Identity behind "), F.coalesce(F.nullif(topic_of(), F.lit("")), F.col("predicate"))), 120).alias("title"),
                   F.col("value").alias("detail"), F.lit("open").alias("status"), F.array("subject").alias("participants"))
    keyed = out.withColumn("k", X.fold_key("title"))
    return _absent(keyed, threads.select("chat_key", X.fold_key("title").alias("k")), ["chat_key", "k"]).drop("k")


# ---- C32 -----------------------------------------------------------------------------------
def consistency_warnings(
    states: DataFrame, scenes: DataFrame, facts: DataFrame, stored_facts: DataFrame, threads: DataFrame, most: int = 0
) -> DataFrame:
    """Possession, location, fact-change and thread warnings per chat."""
    live = states.filter((F.col("operation") != "clear") & (X.normalize_text("value") != ""))
    own = live.filter(F.col("attribute").rlike(fixed.POSSESSION_ATTRIBUTE)).groupBy("chat_key", X.fold_key("value").alias("item")).agg(
        F.min(X.fold_key("subject")).alias("a"), F.max(X.fold_key("subject")).alias("b")).filter("a <> b")
    w1 = own.select("chat_key", F.lit("possession").alias("kind"), F.col("item").alias("about"), F.concat_ws(" / ", "a", "b").alias("detail"))
    who = scenes.select("chat_key", F.col("location").alias("scene"), F.explode("participants").alias("p")).withColumn("k_subject", X.fold_key("p"))
    loc = live.filter(F.lower(X.canonical_attribute("attribute")) == "location").withColumn("k_subject", X.fold_key("subject"))
    away = loc.join(who, ["chat_key", "k_subject"]).filter(
        (X.fold_key("value") != X.fold_key("scene")) & (F.size(F.array_intersect(audit_terms("value"), audit_terms("scene"))) < 2))
    w2 = away.select("chat_key", F.lit("location").alias("kind"), F.col("k_subject").alias("about"), F.concat_ws(" / ", "value", "scene").alias("detail")).distinct()
    key = lambda df, v: df.select("chat_key", X.fold_key("subject").alias("s"), X.fold_key("predicate").alias("p"), X.fold_key("category").alias("c"), F.col("value").alias(v))
    label = F.concat_ws(" ", "p", "c")
    j = key(facts, "new").join(key(stored_facts, "old"), ["chat_key", "s", "p", "c"]).filter(label.rlike(fixed.IMMUTABLE_IDENTITY) | label.rlike(fixed.ROLE_IDENTITY))
    changed = (X.fold_key("new") != X.fold_key("old")) & (F.size(F.array_intersect(audit_terms("new"), audit_terms("old"))) < 2)
    explained = F.concat_ws(" ", "old", "new").rlike(fixed.TEMPORAL_TRANSITION)
    w3 = j.filter(changed & (label.rlike(fixed.IMMUTABLE_IDENTITY) | ~explained)).select("chat_key", F.lit("fact change").alias("kind"), F.concat_ws(" - ", "s", "p").alias("about"), F.concat_ws(" / ", "old", "new").alias("detail")).distinct()
    done, gap = F.col("detail").rlike(fixed.THREAD_RESOLUTION), F.col("detail").rlike(PENDING)
    bad = ((F.col("status") == "resolved") & gap) | ((F.col("status") == "open") & done & ~gap)
    w4 = threads.filter(bad).select("chat_key", F.lit("thread").alias("kind"), F.col("title").alias("about"), F.col("status").alias("detail"))
    allw = w1.unionByName(w2).unionByName(w3).unionByName(w4)
    return top_k(allw, ["chat_key"], [F.col("kind"), F.col("about"), F.col("detail")], most) if most else allw


# ---- C33, C38-C41 -----------------------------------------------------------------------------
def scene_participants(scenes: DataFrame, messages: DataFrame, entities: DataFrame, dead: DataFrame) -> DataFrame:
    """Listed minus unmentioned plus mentioned minus dead participants.

    ``scenes(chat_key, range_from, range_to, participants)``; unmentioned ones go
    only when the range has a line that lists positions.
    """
    m = messages.join(scenes.select("chat_key", "range_from", "range_to"), "chat_key").filter((F.col("idx") >= F.col("range_from")) & (F.col("idx") <= F.col("range_to")))
    lists = m.groupBy("chat_key").agg(F.bool_or(F.col("text").rlike(r"(?im)^\W*(?:positions?|present|in the scene)\s*:")).alias("has_list"))
    named = mention_join(m.select("chat_key", F.col("idx").alias("text_id"), "text"), entities.filter(type_family("type").isin("person", ""))).select("chat_key", "name").distinct()
    names = named.groupBy("chat_key").agg(F.collect_set("name").alias("named"))
    gone = dead.groupBy("chat_key").agg(F.collect_set(X.fold_key("name")).alias("gone"))
    j = scenes.join(lists, "chat_key", "left").join(names, "chat_key", "left").join(gone, "chat_key", "left")
    none = F.array().cast("array<string>")
    mentioned = F.coalesce("named", none)
    kept = F.when(F.coalesce("has_list", F.lit(False)), F.filter("participants", lambda p: F.exists(mentioned, lambda n: X.fold_key(n) == X.fold_key(p)))).otherwise(F.col("participants"))
    allp = F.array_distinct(F.concat(kept, F.when(F.coalesce("has_list", F.lit(False)), F.array_sort(mentioned)).otherwise(none)))
    return j.withColumn("participants", F.filter(allp, lambda p: ~F.array_contains(F.coalesce("gone", none), X.fold_key(p)))).drop("has_list", "named", "gone")


def description_enrichment(entities: DataFrame, facts: DataFrame, relationships: DataFrame) -> DataFrame:
    """Fill an empty or placeholder description from relationships or facts.

    The two longest objective identity facts of importance 4 and more add to a
    description they do not repeat.
    """
    k = X.fold_key
    e = entities.withColumn("k", k("name"))
    rel = relationships.select("chat_key", k("endpoint_a").alias("k"), "dynamic", "importance").unionByName(
        relationships.select("chat_key", k("endpoint_b").alias("k"), "dynamic", "importance")).filter("dynamic <> ''")
    r = rel.groupBy("chat_key", "k").agg(F.max_by("dynamic", F.struct("importance", F.length("dynamic"), "dynamic")).alias("rel_text"))
    good = facts.filter((F.col("importance") >= 4) & ~F.concat_ws(" ", "predicate", "category").rlike(EPISTEMIC) & F.concat_ws(" ", "predicate", "category", "value").rlike(fixed.IDENTITY_DESCRIPTION))
    top = top_k(good.withColumn("k", k("subject")), ["chat_key", "k"], [F.length("value").desc(), F.col("value")], 2)
    fx = top.groupBy("chat_key", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("fact_texts"))
    j = e.join(r, ["chat_key", "k"], "left").join(fx, ["chat_key", "k"], "left")
    weak = (X.normalize_text("description") == "") | F.col("description").rlike(PLACEHOLDER_DESCRIPTION)
    base = F.when(weak, F.coalesce("rel_text", F.lit(""))).otherwise(X.normalize_text("description"))
    j = j.withColumn("base", base)
    add = F.filter(F.coalesce("fact_texts", F.array().cast("array<string>")), lambda t: F.size(F.array_intersect(audit_terms(t), audit_terms(F.col("base")))) < 4)
    return j.withColumn("description", X.clip(F.concat_ws(" ", F.when(F.col("base") != "", F.col("base")), F.array_join(add, " ")), 800)).drop("k", "rel_text", "fact_texts", "base")


def contradicted_objects(facts: DataFrame, messages: DataFrame) -> DataFrame:
    """Drop "transfer done" facts the range only shows as pending, and restraint
    facts after a release of the same subject (C39)."""
    text = F.concat_ws(" ", "subject", "predicate", "value")
    ranged = ["chat_key", "id", "range_from", "range_to"]
    f = facts.select(*ranged, "subject", "value", text.rlike(TRANSFER_DONE).alias("done"), text.rlike(fixed.RESTRAINED).alias("held")).filter("done OR held")
    f = f.select(*ranged, "done", "held", F.when(F.col("done"), audit_terms("value")).alias("dt"), F.when(F.col("held"), audit_terms("subject")).alias("ht"))
    f = write_through(f, "audited")
    # each text is cut into sentences once, and only sentences that speak of a transfer or a release go on
    s = evidence_sentences(messages).select("chat_key", "idx", F.col("pos").alias("unit"), "sentence", *[
        F.col("sentence").rlike(p).alias(n) for n, p in (("done", TRANSFER_DONE), ("pend", TRANSFER_PENDING), ("freed", RELEASED))])
    s = s.filter("done OR pend OR freed").withColumn("terms", audit_terms("sentence")).drop("sentence")
    s = write_through(s, "transfers")
    # one shared word is proof enough
    hits = _range_hits(f.filter("done").withColumnRenamed("dt", "terms"), s.filter("done OR pend").withColumn("objective", ~F.col("pend")), 64)
    bad = hits.groupBy("chat_key", "id").agg(F.max("objective").alias("proof")).filter("NOT proof").select("chat_key", "id")
    held = f.filter("held").select(*ranged, F.col("ht").alias("terms"))
    free = range_overlap_counts(held, s.filter("freed").withColumn("objective", F.lit(True)))
    released = free.join(shuffled(held.select("chat_key", "id", F.size("terms").alias("n"))), ["chat_key", "id"]).filter("shared >= n").select("chat_key", "id")
    return facts.join(shuffled(bad.unionByName(released).distinct()), ["chat_key", "id"], "left_anti")


def historical_relationships(relationships: DataFrame, facts: DataFrame, dead: DataFrame) -> DataFrame:
    """Teacher-like pairs with a history fact and a dead endpoint or a "former" cue end."""
    r = relationships.withColumn("pk", pair_key())
    teach = r.filter(F.col("kind").rlike(MENTORS))
    ends = teach.select("chat_key", "id", "pk", X.fold_key("endpoint_a").alias("a"), X.fold_key("endpoint_b").alias("b"))
    f = facts.select("chat_key", X.fold_key("subject").alias("s"), F.lower(X.padded_words(F.concat_ws(" ", "predicate", "value"))).alias("t"))
    side = ends.select("chat_key", "id", F.col("a").alias("s"), F.col("b").alias("o")).unionByName(ends.select("chat_key", "id", F.col("b").alias("s"), F.col("a").alias("o")))
    both = side.join(f, ["chat_key", "s"]).filter(F.col("t").contains(F.concat(F.lit(" "), F.col("o"), F.lit(" "))) & F.col("t").rlike(MENTORS))
    hist = both.groupBy("chat_key", "id").agg(F.bool_or(F.col("t").rlike(r"\b(?:former|formerly|once|used to|previously)\b")).alias("former"))
    gone = dead.select("chat_key", X.fold_key("name").alias("s")).distinct()
    died = side.join(gone, ["chat_key", "s"], "left_semi").select("chat_key", "id").distinct().withColumn("died", F.lit(True))
    j = r.join(hist, ["chat_key", "id"], "left").join(died, ["chat_key", "id"], "left")
    ended = F.col("former").isNotNull() & (F.col("former") | F.coalesce("died", F.lit(False)))
    kind = F.when(ended & ~F.col("kind").rlike(r"(?i)^former"), F.concat(F.lit("former "), "kind")).otherwise(F.col("kind"))
    return j.withColumn("kind", kind).withColumn("status", F.when(ended, "ended").otherwise(F.col("status"))).drop("pk", "former", "died")


def pair_description_guard(incoming: DataFrame, stored: DataFrame, entities: DataFrame) -> DataFrame:
    """An update whose role sentence names two other people keeps the stored text."""
    m = mention_join(incoming.select("chat_key", F.col("id").alias("text_id"), F.col("dynamic").alias("text")), entities.filter(type_family("type").isin("person", "")))
    names = m.groupBy("chat_key", F.col("text_id").alias("id")).agg(F.collect_set(X.fold_key("name")).alias("named"))
    s = stored.select("chat_key", F.col("id").alias("target_id"), F.col("dynamic").alias("old"))
    j = incoming.join(names, ["chat_key", "id"], "left").join(s, ["chat_key", "target_id"], "left")
    foreign = F.size(F.array_except("named", F.array(X.fold_key("endpoint_a"), X.fold_key("endpoint_b"))))
    wrong = F.col("old").isNotNull() & (F.size("named") == 2) & (foreign == 2) & F.col("dynamic").rlike(rf"(?i)\b(?:{ROLES})\b")
    return j.withColumn("dynamic", F.when(F.coalesce(wrong, F.lit(False)), F.col("old")).otherwise(F.col("dynamic"))).drop("named", "old")


# ---- B12, B14, B15, C37 --------------------------------------------------------------------------
PROFILE_SIGNALS = (
    ("age_demographics", r"(?i)\b(?:\d+[- ]years?[- ]old|years old|aged?|born|teenage|elderly|young adult|middle-aged|gender|male|female)\b"),
    ("appearance", r"(?i)\b(?:hair|eyes?|tall|short|slim|build|skin|scar|tattoo|face|beard|height)\b"),
    ("personality_quirks", r"(?i)\b(?:shy|stubborn|kind|cruel|proud|cautious|brave|curious|sarcastic|patient|impulsive|habit|tends to|temper)\b"),
    ("role_background", r"(?i)\b(?:officer|doctor|teacher|soldier|merchant|captain|worked|served|trained|member|leader|rank|studied|former)\b"),
)
FLEETING = r"(?i)\b(?:currently|right now|today|tonight|this morning|is wearing|wears|standing|sitting|walking|for now|momentarily)\b"


def profile_detail_gate(details: DataFrame, longest: int | None = None) -> DataFrame:
    """Durable, atomic, certain third-person details, routed to the field they signal.

    ``longest`` leaves out details of more characters.

    ``details(chat_key, id, field, detail, seq)``.
    """
    d = details.withColumn("detail", X.normalize_text("detail"))
    speaking = F.col("detail").rlike(X.FIRST_PERSON) | F.col("detail").rlike(X.SECOND_PERSON)
    ok = (F.col("detail") != "") & ~F.col("detail").rlike(FLEETING) & ~F.col("detail").rlike(X.HEDGES) & ~speaking & (F.size(F.split("detail", r"[.;]\s+")) <= 1)
    if longest is not None:
        ok = ok & (F.length("detail") <= longest)
    own = reduce(lambda a, p: a.when(F.col("field") == p[0], F.col("detail").rlike(p[1])), PROFILE_SIGNALS[1:], F.when(F.col("field") == PROFILE_SIGNALS[0][0], F.col("detail").rlike(PROFILE_SIGNALS[0][1])))
    route = reduce(lambda a, p: a.when(F.col("detail").rlike(p[1]), p[0]), PROFILE_SIGNALS[1:], F.when(F.col("detail").rlike(PROFILE_SIGNALS[0][1]), PROFILE_SIGNALS[0][0]))
    return d.filter(ok).withColumn("field", F.when(own, F.col("field")).otherwise(F.coalesce(route, F.col("field"))))


def profile_grounding(details: DataFrame, entities: DataFrame, messages: DataFrame) -> DataFrame:
    """Keep details whose every word occurs in an objective window about the person.

    A sentence belongs to the person named first in it; a sentence led by a
    pronoun continues the one before.
    """
    s = evidence_sentences(messages).filter("objective").withColumn("text_id", F.concat_ws("-", F.col("idx").cast("string"), F.col("pos").cast("string")))
    s = write_through(s, "objective")
    m = mention_join(s.select("chat_key", "text_id", F.col("sentence").alias("text")), entities.filter(type_family("type").isin("person", "")))
    lead = m.groupBy("chat_key", "text_id").agg(F.min_by("name", F.struct("first_pos", "name")).alias("name"))
    w = Window.partitionBy("chat_key", "idx").orderBy("pos")
    j = s.join(lead, ["chat_key", "text_id"], "left")
    pronoun = F.col("sentence").rlike(r"(?i)^\W*(?:he|she|they|his|her|their)\b")
    j = j.withColumn("owner", F.when(pronoun | F.col("name").isNull(), F.last("name", ignorenulls=True).over(w)).otherwise(F.col("name"))).filter(F.col("owner").isNotNull())
    t = j.withColumn("t", audit_terms("sentence"))
    own = Window.partitionBy("chat_key", "idx", "owner").orderBy("pos")
    win = t.withColumn("win", F.array_union(F.array_union("t", F.coalesce(F.lead("t", 1).over(own), F.array().cast("array<string>"))), F.coalesce(F.lead("t", 2).over(own), F.array().cast("array<string>"))))
    win = win.select("chat_key", X.fold_key("owner").alias("k"), F.concat_ws("-", "text_id").alias("wid"), F.explode("win").alias("w"))
    d = details.join(entities.select("chat_key", "id", X.fold_key("name").alias("k")), ["chat_key", "id"]).withColumn("dt", F.array_except(audit_terms("detail"), audit_terms("k")))
    d = d.withColumn("did", F.md5(F.concat_ws("|", "id", "field", "detail")))
    dw = d.select("chat_key", "k", "did", F.size("dt").alias("n"), F.explode("dt").alias("w"))
    ok = dw.join(win, ["chat_key", "k", "w"]).groupBy("chat_key", "did", "n", "wid").agg(F.count(F.lit(1)).alias("c")).filter("c = n").select("chat_key", "did").distinct()
    return d.join(ok, ["chat_key", "did"], "left_semi").drop("k", "dt", "did")


def normalize_fact_shapes(facts: DataFrame) -> DataFrame:
    """Claims under their holder, taxonomy suffixes off, reversed self-identification swapped."""
    v, p = X.normalize_text("value"), X.normalize_text("predicate")
    claim = r"(?i)^([\p{Lu}][\p{L}'-]+(?: [\p{Lu}][\p{L}'-]+)?) (believes?|suspects?|claims?|thinks?) (?:that )?(.+)$"
    holder, rest = F.regexp_extract(v, claim.replace("(?i)", "", 1), 1), F.regexp_extract(v, claim.replace("(?i)", "", 1), 3)
    epistemic = F.concat_ws(" ", "predicate", "category").rlike(EPISTEMIC)
    moved = (holder != "") & ~epistemic & (F.lower(holder) != X.fold_key("subject"))
    bare = F.regexp_replace(p, r"(?i)\s*(?:[—–-]\s*|\()(?:status|details?|general|category|taxonomy)\)?$", "")
    swap = r"^(?:is|was) identified by ([\p{Lu}][\p{L}' -]+)$"
    by = F.regexp_extract(v, swap, 1)
    knows = X.fold_key("category") == "knowledge"
    return facts.withColumns({
        "subject": F.when(moved, holder).when(knows & (by != ""), by).otherwise(F.col("subject")),
        "predicate": F.when(moved, F.concat(F.lit("belief about "), X.normalize_text("subject"))).when(knows & (by != ""), F.concat(F.lit("knowledge of "), X.normalize_text("subject"))).otherwise(bare),
        "value": F.when(moved, rest).otherwise(v),
        "category": F.when(moved, "belief").otherwise(F.col("category")),
    })


def normalize_relationship_text(relationships: DataFrame, stored: DataFrame | None = None, longest: int | None = None) -> DataFrame:
    """Repeated clauses once, endpoints named, a role clause kept through sparse updates.

    ``longest`` clips texts that a kept clause makes longer.
    """
    cl = X.clauses("dynamic")
    folded = F.transform(cl, lambda c: F.regexp_replace(X.fold_key(c), r"[.;!?,]+$", ""))
    once = F.filter(cl, lambda c, i: ~F.array_contains(F.slice(folded, 1, i), F.regexp_replace(X.fold_key(c), r"[.;!?,]+$", "")))
    # "Ann Lee Lee" -> "Ann Lee"
    text = F.regexp_replace(F.array_join(once, " "), r"\b(\p{Lu}[\p{L}'-]+)(?: \1\b)+", "$1")
    a, b = X.normalize_text("endpoint_a"), X.normalize_text("endpoint_b")
    r = relationships.withColumn("__t", text)
    missing = (F.col("__t") != "") & ~(X.names_in("__t", a) & X.names_in("__t", b))
    out = F.when(missing, F.concat(a, F.lit(" and "), b, F.lit(": "), F.col("__t"))).otherwise(F.col("__t"))
    r = r.withColumn("dynamic", out).drop("__t")
    if stored is None:
        return r
    role = rf"(?i)\b(?:{ROLES})\b"
    s = stored.select("chat_key", pair_key().alias("pk"), F.col("dynamic").alias("old"))
    j = r.withColumn("pk", pair_key()).join(s, ["chat_key", "pk"], "left")
    clause = F.filter(X.clauses("old"), lambda c: c.rlike(role) & X.names_in(c, a) & X.names_in(c, b))[0]
    keep = F.col("old").isNotNull() & (F.col("dynamic") != "") & ~F.col("dynamic").rlike(role) & clause.isNotNull() & ~X.fold_key("dynamic").contains(X.fold_key(clause))
    joined = F.concat_ws("; ", F.regexp_replace(clause, r"[;,.\s]+$", ""), F.col("dynamic"))
    merged = F.when(F.col("dynamic") == "", F.coalesce("old", F.lit(""))).when(
        F.coalesce(keep, F.lit(False)), joined if longest is None else X.clip(joined, longest)).otherwise(F.col("dynamic"))
    return j.withColumn("dynamic", merged).drop("pk", "old")


# ---- D18 -----------------------------------------------------------------------------------
def reconcile_stored(
    facts: DataFrame, relationships: DataFrame, threads: DataFrame, entities: DataFrame, evidence: DataFrame,
    messages: DataFrame, processed: DataFrame,
) -> dict[str, DataFrame]:
    """Re-audit stored memory with processed messages only.

    Fact shapes, contradicted objects, derived relationships and their texts,
    then threads; merging (``merge_records``, ``dedupe_semantic``,
    ``merge_knowledge``) follows on the returned tables.
    """
    m = write_through(messages.join(processed.select("chat_key", "idx"), ["chat_key", "idx"], "left_semi"), "processed")
    f = contradicted_objects(write_through(normalize_fact_shapes(facts), "shaped"), m)
    derived = derive_relationships(f, entities, relationships)
    r = relationships.unionByName(derived.select(*[c for c in relationships.columns if c in derived.columns]), allowMissingColumns=True)
    return {"facts": f, "relationships": normalize_relationship_text(r), "threads": resolve_threads(threads, evidence, m)}
