"""Column expressions over text: normalising, tokens, stems, sizes, segments.

Everything here is a plain ``Column`` built from Spark functions, so it stays in
the JVM and can be used in select, filter, join and streaming alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import fixed

# characters a browser counts as white space, beyond the ASCII ones
_BLANKS = r"\s   -     　﻿"
# a single plain space is left as it is, so most blanks of a text match nothing; printable ASCII begins no other run
_SPACE = f"(?: [{_BLANKS}]+|[[^ -~]&&[{_BLANKS}]][{_BLANKS}]*)"
_WORD = r"[\p{L}\p{N}]+"
_RAW_TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}'-]*"
_CJK_RUN = f"[{fixed.CJK_CLASS}]+"
SENTENCE_BREAK = r"(?<=[.!?])\s+"
CLAUSE_BREAK = r"(?<=[.!?;])\s+"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def nonempty(values: Column) -> Column:
    """Array without nulls and empty strings."""
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row.

    Column expressions are inlined wherever they are used; binding one to a
    lambda variable keeps a costly text expression from running many times.
    """
    return F.transform(F.array(value), body)[0]


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Fixed dictionary lookup as a literal map (null when absent)."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.create_map(*pairs)[key]


# ---- B1 ---------------------------------------------------------------------
def normalize_text(value) -> Column:
    """Collapse white space and trim; null becomes the empty string."""
    return F.trim(F.regexp_replace(F.coalesce(as_col(value), F.lit("")), _SPACE, " "))


def fold_key(value) -> Column:
    return F.lower(normalize_text(value))


def clip(value, limit: int) -> Column:
    """At most ``limit`` characters, the last one an ellipsis when cut."""
    text = normalize_text(value)
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.rtrim(F.substring(text, 1, max(0, limit - 1))), F.lit("…"))
    )


# ---- B2 ---------------------------------------------------------------------
def strip_noise_blocks(value, tags=("stat", "background_updates")) -> Column:
    """Remove paired tag blocks (with their content), then collapse white space."""
    names = "|".join(tags)
    return normalize_text(
        F.regexp_replace(as_col(value), rf"(?is)<({names})\b[^>]*>.*?</\1>", " ")
    )


# ---- B3 ---------------------------------------------------------------------
def clamp_importance(value) -> Column:
    number = as_col(value).cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (number != 0)
    rounded = F.floor(F.when(usable, number).otherwise(fixed.DEFAULT_IMPORTANCE) + F.lit(0.5))
    return F.greatest(F.lit(1), F.least(F.lit(5), rounded)).cast("int")


def normalize_enum(value, kind: str, default: str | None = None) -> Column:
    allowed, fallback = fixed.ENUMS[kind]
    value = as_col(value)
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default or fallback))


# ---- H1-H4 ------------------------------------------------------------------
def morph_token(value) -> Column:
    """Light suffix stem of an ASCII word, marked with ``~``; null when none."""
    value = as_col(value)
    eligible = value.rlike("^[a-z]{5,}$")
    chain = None
    for suffix, replacement in fixed.SUFFIX_RULES:
        pattern = f"{suffix}$"
        stem = F.regexp_replace(value, pattern, replacement)
        hit = value.rlike(pattern) if suffix.endswith("?") else value.endswith(suffix)
        chain = F.when(hit, stem) if chain is None else chain.when(hit, stem)
    # the first rule that fits decides; a stem that is too short gives nothing
    return F.when(
        eligible, let(chain, lambda c: F.when(F.length(c) >= fixed.MIN_STEM, F.concat(F.lit("~"), c)))
    )


def straight_quotes(value) -> Column:
    return F.translate(as_col(value), "’‘‐‑‒–—", "''-----")


def lexical_base(raw) -> Column:
    """Lower-cased token without possessive or contraction endings."""
    low = F.regexp_replace(F.lower(as_col(raw)), "('(s|ll|re|ve|d|m))+$", "")
    stem = F.regexp_extract(low, "^(.+)n't$", 1)
    return F.when(stem == "", low).otherwise(
        F.coalesce(lookup(fixed.IRREGULAR_NEGATIVES, stem), stem)
    )


def lexical_forms(raw) -> Column:
    """Distinct surface forms of one raw token, hyphen parts included."""
    raw = as_col(raw)

    def split_forms(base: Column) -> Column:
        parts = nonempty(F.split(base, "'"))
        with_hyphens = F.transform(
            parts,
            lambda p: F.when(
                p.contains("-"), F.concat(F.array(p), nonempty(F.split(p, "-")))
            ).otherwise(F.array(p)),
        )
        return F.array_distinct(F.flatten(with_hyphens))

    return F.when(raw.rlike("['-]"), split_forms(lexical_base(raw))).otherwise(
        F.array(F.lower(raw))
    )


def _keep_form(form: Column, raw: Column) -> Column:
    size = F.length(form)
    stop = form.isin(*fixed.STOP_WORDS)
    shouted = (raw == F.upper(raw)) & (raw != F.lower(raw))
    return ((size >= 3) & ~stop) | ((size == 2) & (~stop | shouted))


def cjk_ngrams(value) -> Column:
    """Whole run up to four characters, then every 2-gram, then every 3-gram."""
    runs = F.regexp_extract_all(as_col(value), F.lit(f"({_CJK_RUN})"), 1)

    def grams(run: Column, n: int) -> Column:
        return F.when(
            F.length(run) >= n,
            F.transform(
                F.sequence(F.lit(1), F.length(run) - (n - 1)),
                lambda i: run.substr(i, F.lit(n)),
            ),
        ).otherwise(F.array().cast("array<string>"))

    def one(run: Column) -> Column:
        low = F.lower(run)
        whole = F.when(F.length(low) <= 4, F.array(low)).otherwise(
            F.array().cast("array<string>")
        )
        return F.concat(whole, grams(low, 2), grams(low, 3))

    return F.flatten(F.transform(runs, one))


def raw_tokens(value) -> Column:
    """Words of the non-CJK part, quotes and dashes made plain."""
    latin = F.regexp_replace(as_col(value), _CJK_RUN, " ")
    return F.regexp_extract_all(straight_quotes(latin), F.lit(f"({_RAW_TOKEN})"), 1)


def tokenize(value, morphology: bool = False, cap: int | None = None) -> Column:
    """Search tokens in order of appearance.

    ``morphology`` adds the marked stem after each word. ``cap`` keeps the first
    and last ``cap/2`` tokens; the default keeps the whole text.
    """
    source = F.coalesce(as_col(value), F.lit(""))

    def expand(raw: Column) -> Column:
        kept = F.filter(lexical_forms(raw), lambda f: _keep_form(f, raw))
        if not morphology:
            return kept
        return F.flatten(
            F.transform(
                kept,
                lambda f: F.when(F.length(f) >= 5, F.array_compact(F.array(f, morph_token(f)))).otherwise(F.array(f)),
            )
        )

    words = F.flatten(F.transform(raw_tokens(source), expand))
    has_cjk = source.rlike(f"[{fixed.CJK_CLASS}]")
    tokens = F.when(has_cjk, F.concat(cjk_ngrams(source), words)).otherwise(words)
    if cap is None:
        return tokens
    half = cap // 2
    return F.when(F.size(tokens) <= cap, tokens).otherwise(
        F.concat(F.slice(tokens, 1, half), F.slice(tokens, -half, half))
    )


def term_set(value, morphology: bool = False) -> Column:
    return F.array_distinct(tokenize(value, morphology))


def query_variants(term) -> Column:
    """A query term and its stem, the forms a record token may take."""
    term = as_col(term)
    stem = F.when(term.startswith("~"), F.lit(None)).otherwise(morph_token(term))
    return F.array_compact(F.array(term, stem))


# ---- H5, H6 -----------------------------------------------------------------
def estimate_tokens(value) -> Column:
    """ceil(non-ASCII characters + ASCII characters / 4)."""
    value = F.coalesce(as_col(value), F.lit(""))
    ascii_part = F.length(F.regexp_replace(value, r"[^\x00-\x7f]", ""))
    wide = F.length(value) - ascii_part
    return F.ceil(wide + ascii_part / F.lit(4.0)).cast("long")


def clip_tokens(value, limit) -> Column:
    """Longest prefix whose estimate, with the ellipsis, is within ``limit``."""
    value = F.coalesce(as_col(value), F.lit(""))
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    # a prefix longer than 4 x limit can never fit; the estimate grows with the prefix, so halving finds the longest
    window = F.greatest(F.lit(0), F.least(F.length(value), (limit * 4).cast("int")))

    def halve(acc: Column, _: Column) -> Column:
        low, high = acc["low"], acc["high"]
        mid = F.floor((low + high + 1) / 2).cast("int")
        fits = estimate_tokens(F.concat(value.substr(F.lit(1), mid), F.lit("…"))) <= limit
        return F.when(low >= high, acc).when(fits, F.struct(mid.alias("low"), high.alias("high"))).otherwise(
            F.struct(low.alias("low"), (mid - 1).alias("high")))

    best = F.aggregate(
        F.sequence(F.lit(1), F.lit(32)), F.struct(F.lit(0).alias("low"), window.alias("high")), halve, lambda acc: acc["low"])
    return (
        F.when(estimate_tokens(value) <= limit, value)
        .when(limit <= 1, F.lit("…"))
        .otherwise(F.concat(F.rtrim(value.substr(F.lit(1), best)), F.lit("…")))
    )


# ---- H7, H8 -----------------------------------------------------------------
def fingerprint(idx="idx", name="name", text="text") -> Column:
    """Identity of one message: position, speaker and text."""
    return F.md5(
        F.concat_ws(
            "\u001f",
            as_col(idx).cast("string"),
            F.coalesce(as_col(name), F.lit("")),
            F.coalesce(as_col(text), F.lit("")),
        )
    )


def stable_hash(*values) -> Column:
    """Short internal id of some columns."""
    return F.substring(F.md5(F.concat_ws("\u001f", *[as_col(v) for v in values])), 1, 8)


def anchor_id(chat_key="chat_key", range_from="range_from", range_to="range_to") -> Column:
    return F.concat_ws(
        "-", F.lit("L1"), stable_hash(chat_key),
        as_col(range_from).cast("string"), as_col(range_to).cast("string"),
    )


# ---- H10-H12 ----------------------------------------------------------------
def name_tokens(value) -> Column:
    """Words of a name, possessive endings removed."""
    plain = F.regexp_replace(
        straight_quotes(fold_key(value)), r"'s(?![\p{L}\p{N}_])", ""
    )
    return F.regexp_extract_all(plain, F.lit(f"({_WORD})"), 1)


def record_stem(token) -> Column:
    """Plural / -ing / -ed stem with the synonym table, used for near-duplicates."""
    token = as_col(token)
    size = F.length(token)

    def undouble(stem: Column) -> Column:
        return F.regexp_replace(stem, r"(.)\1$", "$1")

    def cut(n: int) -> Column:
        return token.substr(F.lit(1), size - n)

    stem = (
        F.when(~token.rlike("^[a-z]{5,}$"), token)
        .when(token.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(token.endswith("ing") & (size > 6), undouble(cut(3)))
        .when(token.endswith("ed") & (size > 5), undouble(cut(2)))
        .when(token.endswith("es") & (size > 5), cut(2))
        .when(token.endswith("s") & ~token.rlike(fixed.PLURAL_EXCEPTIONS), cut(1))
        .otherwise(token)
    )
    return F.coalesce(lookup(fixed.RECORD_EQUIVALENTS, token), stem)


def record_terms(value, excluded_names: Column | None = None) -> Column:
    """Distinct stems of a record text; participant names can be excluded."""
    stems = F.transform(name_tokens(value), record_stem)
    kept = F.filter(
        stems, lambda t: (F.length(t) >= 3) & ~t.isin(*fixed.RECORD_STOP_WORDS)
    )
    terms = F.array_distinct(kept)
    if excluded_names is None:
        return terms
    ignored = F.flatten(
        F.transform(excluded_names, lambda n: F.transform(name_tokens(n), record_stem))
    )
    return F.array_except(terms, ignored)


def entity_terms(value) -> Column:
    plain = F.regexp_replace(fold_key(value), "[’']", "")
    words = F.regexp_extract_all(plain, F.lit(f"({_WORD})"), 1)
    return F.array_distinct(
        F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*fixed.ENTITY_STOP_WORDS))
    )


def identifiers(value) -> Column:
    """Sorted distinct words holding a digit, joined with ``|``."""
    found = F.regexp_extract_all(
        fold_key(value), F.lit(r"([\p{L}\p{N}_-]*[0-9]+[\p{L}\p{N}_-]*)"), 1
    )
    return F.array_join(F.array_sort(F.array_distinct(found)), "|")


def name_identity_key(value) -> Column:
    """Letters of a name joined, possessor removed; empty when too short."""
    plain = straight_quotes(fold_key(value))
    thing = F.regexp_extract(plain, r"^[\p{L}\p{N} ._-]{1,80}'s\s+(.+)$", 1)
    words = F.regexp_extract_all(
        F.when(thing != "", thing).otherwise(plain), F.lit(f"({_WORD})"), 1
    )
    joined = F.array_join(words, "")
    return F.when((F.size(words) >= 2) | (F.length(joined) >= 8), joined).otherwise("")


def surface_key(value) -> Column:
    """Name without case, determiner, possessive ending, punctuation or spacing."""
    plain = F.regexp_replace(straight_quotes(fold_key(value)), r"^(?:the|a|an)\s+", "")
    plain = F.regexp_replace(plain, r"'s(?![\p{L}\p{N}])|(?<=s)'(?![\p{L}\p{N}])", "")
    return F.regexp_replace(plain, r"[^\p{L}\p{N}]+", "")


# ---- H14, H15 ---------------------------------------------------------------
def _pieces(value, pattern: str) -> Column:
    return nonempty(F.transform(F.split(normalize_text(value), pattern), F.trim))


def sentences(value) -> Column:
    return _pieces(value, SENTENCE_BREAK)


def clauses(value) -> Column:
    return _pieces(value, CLAUSE_BREAK)


def quoted_segments(value) -> Column:
    """Text inside double quotes, straight or curly."""
    plain = F.translate(F.coalesce(as_col(value), F.lit("")), "“”«»„", '"""""')
    return nonempty(F.regexp_extract_all(plain, F.lit(r'"([^"]+)"'), 1))


def labelled_speech(value, speaker: Column) -> Column:
    """Text after ``Speaker:`` at the start of a line."""
    lines = F.split(F.coalesce(as_col(value), F.lit("")), r"\n")
    label = F.concat(F.lower(speaker), F.lit(":"))
    own = F.filter(lines, lambda x: F.lower(F.ltrim(x)).startswith(label))
    return nonempty(
        F.transform(own, lambda x: F.trim(F.ltrim(x).substr(F.length(label) + 1, F.length(x))))
    )


def padded_words(value) -> Column:
    """`` word word `` form of a text: whole-word tests become ``contains``."""
    words = F.regexp_replace(straight_quotes(fold_key(value)), r"[^\p{L}\p{N}']+", " ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def names_in(text, name) -> Column:
    """True when ``text`` holds ``name`` as whole words."""
    return padded_words(text).contains(padded_words(name)) & (fold_key(name) != "")


def is_vocative(segment, form) -> Column:
    """A form used to address someone: set off by punctuation or alone."""
    plain = straight_quotes(fold_key(segment))
    safe = F.regexp_replace(straight_quotes(fold_key(form)), r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    lead = F.concat(F.lit(r"^[^\p{L}\p{N}]*(?:[\p{L}]+[,.!]?\s+)?"), safe, F.lit(r"\s*(?:[,.!?;:…-]|$)"))
    tail = F.concat(F.lit(r"[,;:-]\s*"), safe, F.lit(r"\s*(?:[,.!?;:…-]|$)"))
    return F.regexp_like(plain, lead) | F.regexp_like(plain, tail)


# closed word lists; pass another pattern to change the rule pack
FIRST_PERSON = r"(?i)(?<![\p{L}\p{N}])(?:i|me|my|mine|myself|we|us|our|ours|ourselves)(?![\p{L}\p{N}])"
SECOND_PERSON = r"(?i)(?<![\p{L}\p{N}])(?:you|your|yours|yourself|yourselves)(?![\p{L}\p{N}])"
HEDGES = (
    r"(?i)\b(?:perhaps|maybe|possibly|apparently|allegedly|seems?|seemed|might|may|could|suspects?|"
    r"suspected|believes?|believed|thinks?|thought|assumes?|guess(?:es|ed)?|rumou?r(?:s|ed)?|"
    r"claims?|claimed|wonders?|imagines?|supposes?)\b"
)


def third_person_only(value) -> Column:
    """Sentences without first- or second-person words, joined."""
    speaking = F"{FIRST_PERSON}|{SECOND_PERSON}"
    return F.array_join(F.filter(sentences(value), lambda s: ~s.rlike(speaking)), " ")


def objective_sentence(sentence, author_note: Column | None = None) -> Column:
    """False for quoted, first-person or hedged sentences; author notes always count."""
    s = as_col(sentence)
    subjective = s.rlike(r'["“”«»]') | s.rlike(FIRST_PERSON) | s.rlike(HEDGES)
    return ~subjective if author_note is None else (author_note | ~subjective)


# ---- H16-H25 ----------------------------------------------------------------
def canonical_attribute(value) -> Column:
    text = normalize_text(value)
    return F.coalesce(lookup(fixed.STATE_ATTRIBUTES, F.lower(text)), text)


def recency(updated_at, as_of) -> Column:
    """max(0, 2 - log10(days + 1)); the reference day is always a parameter."""
    updated, now = as_col(updated_at).cast("timestamp"), as_col(as_of).cast("timestamp")
    days = F.greatest(
        F.lit(0.0), (F.unix_micros(now) - F.unix_micros(updated)) / F.lit(86_400_000_000.0)
    )
    return F.coalesce(F.greatest(F.lit(0.0), F.lit(2.0) - F.log10(days + 1)), F.lit(0.0))


def _rounded(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("long")


def _size(context) -> Column:
    c = as_col(context).cast("double")
    return F.when(c.isNull() | (c == 0), F.lit(50_000.0)).otherwise(F.greatest(c, F.lit(0.0)))


def _within(low: int, high: int, value: Column) -> Column:
    return F.least(F.lit(high).cast("long"), F.greatest(F.lit(low).cast("long"), value))


def budget_injection(context) -> Column:
    return _rounded(_size(context) * 0.2)


def budget_story(context) -> Column:
    return _within(1500, 6000, _rounded(_size(context) * 0.02))


def budget_extraction(context) -> Column:
    return _within(1000, 8000, _rounded(_size(context) * 0.2))


def budget_tail(context) -> Column:
    return _within(8000, 25000, _rounded(F.greatest(_size(context), F.lit(4000.0)) * 0.25))


def budget_tail_turns(context) -> Column:
    size = F.greatest(_size(context), F.lit(4000.0))
    return (
        F.when(size <= 32000, 8).when(size <= 64000, 12).when(size <= 128000, 20).otherwise(30)
    ).cast("long")


def budget_story_chunk(context, prior: bool = True) -> Column:
    output = budget_story(context)
    taken = output * (2 if prior else 1) + 2048
    return F.greatest(F.lit(128).cast("long"), F.floor(_size(context) - taken).cast("long"))


def idf(documents, frequency) -> Column:
    n, df = F.greatest(F.lit(1.0), as_col(documents).cast("double")), as_col(frequency)
    return F.log1p((n - df + 0.5) / (df + 0.5))


_THINK_BLOCK = r"(?is)<(think|thinking|thought|reasoning)(?:\s[^>]*)?>.*?</\1>"


def parse_expansion_terms(raw, limit: int | None = None) -> Column:
    """Distinct terms of ``{"terms": [...]}``, the first ``limit`` if wanted; complete items survive a cut list."""
    clean = F.trim(F.regexp_replace(F.coalesce(as_col(raw), F.lit("")), _THINK_BLOCK, ""))
    whole = F.regexp_extract(clean, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(F.when(whole != "", whole), "terms array<string>")["terms"]
    # a cut list: quoted items that are complete, after the opening bracket
    tail = F.regexp_extract(clean, r'(?is)"terms"\s*:\s*\[((?:\s*"(?:[^"\\]|\\.)*"\s*,?)*)', 1)
    items = F.regexp_extract_all(tail, F.lit(r'"((?:[^"\\]|\\.)*)"'), 1)
    salvaged = F.transform(items, lambda v: F.regexp_replace(v, r"\\(.)", "$1"))
    values = F.transform(F.coalesce(parsed, salvaged), normalize_text)
    terms = F.array_distinct(nonempty(values))
    return terms if limit is None else F.slice(terms, 1, limit)


def compile_story(premise, developments, boundary, open_matters) -> Column:
    """Four labelled lists as text, empty sections left out."""
    parts = []
    for label, value in (
        ("Premise", premise), ("Major developments", developments),
        ("State at covered boundary", boundary), ("Open matters", open_matters),
    ):
        items = nonempty(F.transform(F.coalesce(as_col(value), F.array()), normalize_text))
        parts.append(
            F.when(F.size(items) > 0, F.concat(F.lit(f"{label}: "), F.array_join(items, "; ")))
        )
    return F.concat_ws("\n", *parts)


def record_text(*values) -> Column:
    """Searchable text of a record: its fields joined by spaces."""
    return normalize_text(F.concat_ws(" ", *[as_col(v).cast("string") for v in values]))


def labelled_text(category: Column | str, fields: list[tuple[str, Column]]) -> Column:
    """``Memory type: c`` then one ``Label: value`` line per filled field."""
    head = F.concat(F.lit("Memory type: "), F.lit(category) if isinstance(category, str) else category)
    lines = [
        F.when(normalize_text(v) != "", F.concat(F.lit(f"{label}: "), normalize_text(v)))
        for label, v in fields
    ]
    return F.concat_ws("\n", head, *lines)


PROFILE_LABELS = (
    ("role_background", "Role/background"), ("age_demographics", "Age/demographics"),
    ("appearance", "Appearance"), ("personality_quirks", "Personality/quirks"),
)


def format_profile(profile) -> Column:
    p = as_col(profile)
    parts = []
    for field, label in PROFILE_LABELS:
        items = nonempty(F.transform(F.coalesce(p[field], F.array()), normalize_text))
        parts.append(
            F.when(F.size(items) > 0, F.concat(F.lit(f"{label}: "), F.array_join(items, "; ")))
        )
    return F.concat_ws("\n", *parts)


def parse_profile(text) -> Column:
    stop = "|".join(label for _, label in PROFILE_LABELS)
    fields = []
    for field, label in PROFILE_LABELS:
        body = F.regexp_extract(
            F.coalesce(as_col(text), F.lit("")),
            rf"(?is)(?:^|[\s.;]){label}:\s*(.*?)(?=\s*(?:{stop}):|$)", 1,
        )
        fields.append(nonempty(F.transform(F.split(body, r"\s*;\s*"), normalize_text)).alias(field))
    return F.struct(*fields)


def temporal_summary(temporal) -> Column:
    t = as_col(temporal)
    frame = F.when(F.coalesce(t["frame"], F.lit("")) == "", F.lit(fixed.MAIN_FRAME)).otherwise(t["frame"])
    relation = F.when(F.coalesce(t["relation"], F.lit("")) == "", F.lit("unknown")).otherwise(t["relation"])

    def part(value: Column, text: Column) -> Column:
        return F.when(F.coalesce(value, F.lit("")) != "", text)

    line = F.concat_ws(
        "; ",
        F.concat(F.lit("anchor "), t["anchor_id"]),
        F.concat(F.lit("frame "), frame),
        part(t["reference_id"], F.concat_ws(" ", relation, t["reference_id"])),
        part(t["elapsed"], F.concat(F.lit("explicit interval "), t["elapsed"])),
        part(t["certainty"], F.concat(t["certainty"], F.lit(" timing"))),
    )
    return F.when(F.coalesce(t["anchor_id"], F.lit("")) == "", F.lit("")).otherwise(line)


def correction_preview(action, category, before, after) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.upper(as_col(action)), F.lit(" "), as_col(category)),
        F.when(F.coalesce(as_col(before), F.lit("")) != "", F.concat(F.lit("Before: "), as_col(before))),
        F.when(F.coalesce(as_col(after), F.lit("")) != "", F.concat(F.lit("After: "), as_col(after))),
    )


# ---- B13, H9 ----------------------------------------------------------------
def bind_relative_time(value, anchor) -> Column:
    """Append the anchor after the first relative time word of a text."""
    text = normalize_text(value)
    anchor = F.when(
        F.coalesce(as_col(anchor), F.lit("")) == "", F.lit(fixed.UNKNOWN_TIME_SOURCE)
    ).otherwise(as_col(anchor))
    pattern = f"(?i){fixed.RELATIVE_TIME}"
    hit = F.regexp_extract(text, f"({pattern})", 1)
    at = F.regexp_instr(text, F.lit(pattern))
    end = at + F.length(hit)
    return F.when(hit == "", text).otherwise(
        F.concat(
            text.substr(F.lit(1), end - 1), F.lit(" (relative to "), anchor, F.lit(")"),
            text.substr(end, F.length(text)),
        )
    )


def story_minutes(source: Column) -> Column:
    """Minutes of the day from ``3:15 pm`` or a day-part word."""
    clock = r"\b(\d{1,2})(?::(\d{2}))?\s*(am|pm)\b"
    hour = F.regexp_extract(source, clock, 1)
    minute = F.regexp_extract(source, clock, 2)
    half = F.regexp_extract(source, clock, 3)
    exact = (
        hour.try_cast("int") % 12 + F.when(half == "pm", 12).otherwise(0)
    ) * 60 + F.coalesce(minute.try_cast("int"), F.lit(0))
    part = reduce(
        lambda acc, p: acc.when(source.rlike(rf"\b{p[0]}\b"), p[1]),
        fixed.DAY_PARTS[1:],
        F.when(source.rlike(rf"\b{fixed.DAY_PARTS[0][0]}\b"), fixed.DAY_PARTS[0][1]),
    ).otherwise(0)
    return F.when(hour != "", exact).otherwise(part)


def story_date_key(story_time, frame=None) -> Column:
    """Sortable key of a narrative date: struct(family, value), null when unknown."""
    source = F.translate(fold_key(story_time), "—–", "--")
    name = fold_key(frame) if frame is not None else F.lit("")
    frame_name = F.when(name == "", F.lit(fixed.MAIN_FRAME)).otherwise(name)
    return let(source, lambda s: F.when(s.rlike("[0-9x]"), _date_rules(s, frame_name)))


def _date_rules(source: Column, frame_name: Column) -> Column:
    month_words = "|".join(fixed.MONTHS)
    month_number = {m: str(i + 1) for i, m in enumerate(fixed.MONTHS)}
    minutes = story_minutes(source)

    def month(text: Column) -> Column:
        return lookup(month_number, text).try_cast("long")

    def number(text: Column) -> Column:
        return text.try_cast("long")

    def key(year: Column, mon=F.lit(1), day=F.lit(1)) -> Column:
        return (year * (372 * 1440) + mon * (31 * 1440) + day * 1440 + minutes).cast("long")

    def group(pattern: str, i: int) -> Column:
        return F.regexp_extract(source, pattern, i)

    def entry(family: str, value: Column) -> Column:
        return F.struct(
            F.concat(frame_name, F.lit(f"|{family}")).alias("family"), value.alias("value")
        )

    rules = []
    iso = r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b"
    rules.append((iso, entry("calendar", key(*(number(group(iso, i)) for i in (1, 2, 3))))))
    for sep, (m, d) in ((r"\.", (2, 1)), ("/", (1, 2))):
        p = rf"\b(\d{{1,2}}){sep}(\d{{1,2}}){sep}(\d{{4}})\b"
        rules.append((p, entry("calendar", key(number(group(p, 3)), number(group(p, m)), number(group(p, d))))))
        q = rf"\b(\d{{1,2}}){sep}(\d{{1,2}}){sep}xxxx\b"
        rules.append((q, entry("yearless-calendar", key(F.lit(0), number(group(q, m)), number(group(q, d))))))
    p = rf"\b(\d{{1,2}})\s+({month_words})\s*-\s*(?:early|mid|late)?\s*(?:{month_words})\s+(\d{{4}})\b"
    rules.append((p, entry("calendar", key(number(group(p, 3)), month(group(p, 2)), number(group(p, 1))))))
    p = rf"\b(\d{{1,2}})(?:\s*-\s*\d{{1,2}})?\s+({month_words})\s+(\d{{4}})\b"
    rules.append((p, entry("calendar", key(number(group(p, 3)), month(group(p, 2)), number(group(p, 1))))))
    p = rf"\b(?:early|mid|late)?\s*({month_words})\s*-\s*(?:early|mid|late)?\s*(?:{month_words})\s+(\d{{4}})\b"
    rules.append((p, entry("calendar", key(number(group(p, 2)), month(group(p, 1))))))
    p = rf"\b({month_words})(?:\s+(\d{{1,2}})(?:st|nd|rd|th)?)?,?\s+(\d{{4}})\b"
    rules.append((p, entry("calendar", key(number(group(p, 3)), month(group(p, 1)), F.coalesce(number(group(p, 2)), F.lit(1))))))
    p = r"\b(?:rp\s*)?day\s+(\d+)\b"
    rules.append((p, entry("numbered-day", (number(group(p, 1)) * 1440 + minutes).cast("long"))))
    p = r"\b(spring|summer|autumn|fall|winter)\s+(\d{4})\b"
    season = lookup({k: str(v) for k, v in fixed.SEASON_MONTH.items()}, group(p, 1))
    rules.append((p, entry("calendar", key(number(group(p, 2)), season.try_cast("long")))))
    p = rf"\b(\d{{1,2}})\s+({month_words})\b"
    rules.append((p, entry("yearless-calendar", key(F.lit(0), month(group(p, 2)), number(group(p, 1))))))
    p = r"\b(\d{4})\b"
    rules.append((p, entry("calendar", key(number(group(p, 1))))))
    chain = F.when(source.rlike(rules[0][0]), rules[0][1])
    for pattern, value in rules[1:]:
        chain = chain.when(source.rlike(pattern), value)
    return chain
