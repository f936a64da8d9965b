"""Secret scans.

Plain patterns find assigned passwords, access keys and hexadecimal runs. Beside
them candidate strings are read with a sliding window per character class: symbol
counts are kept up by one character in and one out, the Shannon entropy of the
window follows from the counts, and a string with a window above its class's
limit is a secret unless an allow-list clears it.

Spans are in code points, end exclusive. Null text is empty. Repeated rows are
judged each on its own; empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame, functions as F, types as T

from .common import carried, raw_texts

ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "entropy")
_HINTS = (b"passw", b"secret", b"token", b"api")

CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
#: window length; class -> limit in bits. Shorter alphabets reach less.
WINDOW = 20
LIMITS = {"hex": 3.0, "upper": 3.4, "alnum": 3.7, "base64": 3.7}
#: strings that look random and are not secret
ALLOWED = (
    re.compile(rb"[A-Za-z_=-]*"),  # words and rules without a digit
    re.compile(rb"[0-9_=/+-]*"),  # numbers and dates
    re.compile(rb"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"),  # record numbers
    re.compile(rb"(?:[A-Za-z]{2,}[-_/+=])+[A-Za-z]*[0-9]{0,6}"),  # slugs and paths with a number behind
)
FOUND = T.StructType([T.StructField("spans", T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
])))])


def kind_of_string(s: bytes) -> str:
    if not s.strip(b"0123456789abcdefABCDEF"):
        return "hex"
    if s.isalnum():
        return "upper" if s.isupper() else "alnum"
    return "base64"


_TERM = [0.0, *(n * math.log2(n) for n in range(1, WINDOW + 1))]


def peak_entropy(s: bytes, width: int = WINDOW) -> float:
    """Largest entropy of a window of ``width`` characters, by counts moved along.

    With counts n of a window of w characters the entropy is
    log2(w) - sum(n log2 n) / w; moving by one character changes two terms.
    """
    width = min(width, len(s))
    if not width:
        return 0.0
    counts: dict[int, int] = {}
    total = 0.0
    for c in s[:width]:
        n = counts.get(c, 0)
        total += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
    least = total
    for gone, new in zip(s, s[width:], strict=False):
        n = counts[gone]
        total += _TERM[n - 1] - _TERM[n]
        counts[gone] = n - 1
        n = counts.get(new, 0)
        total += _TERM[n + 1] - _TERM[n]
        counts[new] = n + 1
        least = min(least, total)
    return math.log2(width) - least / width


def random_looking(s: bytes) -> bool:
    return not any(a.fullmatch(s) for a in ALLOWED) and peak_entropy(s) >= LIMITS[kind_of_string(s)]


def code_points(b: bytes, places: list[int]) -> dict[int, int]:
    """Code points before each byte position (ascending), counted once along the text."""
    out, at, count = {}, 0, 0
    for place in places:
        count += len(b[at:place].decode("utf-8", "replace"))
        at = place
        out[place] = count
    return out


def find_secrets(b: bytes) -> list[tuple[str, int, int]]:
    """Spans of one UTF-8 text by start, then kind as listed."""
    spans = []
    low = b.lower()
    if any(h in low for h in _HINTS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(b) if len(m[2]) >= 12]
    if b"AKIA" in b:
        spans += [("access", *m.span()) for m in ACCESS.finditer(b) if m.end() - m.start() >= 18]
    spans += [("hex", *m.span()) for m in HEX.finditer(b)]
    spans += [("entropy", *m.span()) for m in CANDIDATE.finditer(b) if random_looking(m[0])]
    if spans and not b.isascii():
        at = code_points(b, sorted({x for _, *ends in spans for x in ends}))
        spans = [(k, at[s], at[e]) for k, s, e in spans]
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def with_secrets(docs: DataFrame, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``row`` and ``out.spans`` of every text."""

    def scan(batch):
        return {"spans": [[{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(b)] for b in raw_texts(batch, "__text")]}

    return carried(docs, text, FOUND, scan, columns=columns)


DIGEST = T.StructType([
    *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]),
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
])


def digest_spans(spans: list[dict]) -> dict:
    """Counts of the base kinds, the hash of their spans, and all spans as text."""
    said = [(x["kind"], f"{x['kind']}:{x['start']}:{x['end']}") for x in spans]
    base = [s for k, s in said if k != "entropy"]
    counts = {f"n_{kind}": sum(k == kind for k, _ in said) for kind in KINDS[:3]}
    return counts | {"base_sha256": hashlib.sha256(",".join(base).encode()).hexdigest(), "spans": ",".join(s for _, s in said)}


def mask_secrets(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", count: str = "n_chars") -> DataFrame:
    """Documents with every found span replaced by ``mask``; overlapping spans become one.

    ``count`` names a column of text lengths to bring up to date, if there is one.
    """
    added = T.StructType([T.StructField("text", T.StringType())])

    def cover(batch):
        col = batch.column(batch.schema.get_field_index("__text")).to_pylist()
        return {"text": [t and covered(t, find_secrets(t.encode()), mask) for t in col]}

    found = carried(docs, text, added, cover)
    changed = {text: F.col("out.text")}
    if count in docs.columns:
        changed[count] = F.when(F.col("out.text").eqNullSafe(F.col(f"row.`{text}`")), F.col(f"row.`{count}`")).otherwise(
            F.length("out.text").cast(docs.schema[count].dataType)
        )
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def covered(t: str, spans: list[tuple[str, int, int]], mask: str) -> str:
    out, at = [], 0
    for _, s, e in spans:
        if s >= at:
            out += [t[at:s], mask]
        at = max(at, e)
    return "".join([*out, t[at:]])


def entropy_digest(batch) -> dict:
    """Columns of ``DIGEST`` for a slice."""
    rows = [digest_spans([{"kind": k, "start": s, "end": e} for k, s, e in find_secrets(b)]) for b in raw_texts(batch, "__text")]
    return {f.name: [r[f.name] for r in rows] for f in DIGEST}


def secret_digests(docs: DataFrame, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    return carried(docs, text, DIGEST, entropy_digest, columns=columns)


__all__ = ["find_secrets", "mask_secrets", "peak_entropy", "secret_digests", "with_secrets"]
