"""Raw extraction results to record tables (A4, A5)."""

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed, text as X
from ..operators.timeline import temporal_anchors

# ---- fixed values: JSON layout of one extraction result
TEMPORAL = "struct<frame:string,relation:string,elapsed:string,certainty:string>"
RESULT_SCHEMA = f"""struct<
scene:struct<location:string,time:string,participants:array<string>,activity:string,mood:string>,
sceneCapsule:struct<title:string,storyTime:string,location:string,participants:array<string>,opening:string,
  beats:array<string>,emotionalArc:string,closing:string,importance:double,temporal:{TEMPORAL}>,
entities:array<struct<targetId:string,name:string,type:string,aliases:array<string>,description:string,importance:double>>,
identityResolutions:array<struct<reference:string,canonical:string,evidence:string>>,
recordMerges:array<struct<category:string,canonicalId:string,duplicateIds:array<string>,evidence:string>>,
facts:array<struct<targetId:string,subject:string,predicate:string,value:string,category:string,importance:double,persistence:string>>,
states:array<struct<targetId:string,subject:string,attribute:string,value:string,previous:string,importance:double,scope:string,operation:string>>,
relationships:array<struct<targetId:string,from:string,to:string,kind:string,status:string,dynamic:string,importance:double>>,
events:array<struct<title:string,summary:string,participants:array<string>,location:string,storyTime:string,consequences:string,importance:double,temporal:{TEMPORAL}>>,
threads:array<struct<targetId:string,title:string,detail:string,status:string,participants:array<string>,importance:double>>,
backgrounds:array<struct<targetId:string,topic:string,summary:string,status:string,certainty:string,participants:array<string>,importance:double>>
>""".replace("\n", "")
REQUIRED_ARRAYS = ("entities", "facts", "states", "relationships", "events", "threads", "backgrounds")
RAW_SCHEMA = (
    "chat_key string, range_from long, range_to long, allow_state_updates boolean, "
    "message_fingerprints array<struct<idx:long,fingerprint:string>>, raw string"
)

_THINK = r"(?is)<(think|thinking|thought|reasoning)(?:\s[^>]*)?>.*?</\1>"


def clean_response(raw) -> Column:
    """Response without reasoning blocks and without an enclosing code fence."""
    text = F.trim(F.regexp_replace(F.coalesce(X.as_col(raw), F.lit("")), _THINK, ""))
    inner = F.regexp_extract(text, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(inner != "", inner).otherwise(text)


def _missing(result: Column, text: Column) -> Column:
    """Name of the first required part that is absent or not an array."""
    checks = F.when(result.isNull() | ~text.startswith("{"), "no JSON object")
    capsule = F.get_json_object(text, "$.sceneCapsule.beats")
    checks = checks.when(~F.coalesce(F.get_json_object(text, "$.facts"), F.lit("")).startswith("["), "facts")
    checks = checks.when(~F.coalesce(capsule, F.lit("")).startswith("["), "sceneCapsule")
    for name in REQUIRED_ARRAYS:
        checks = checks.when(~F.coalesce(F.get_json_object(text, f"$.{name}"), F.lit("")).startswith("["), name)
    return checks


def _last_object():
    """Arrow helper for responses with prose around the JSON: the last complete object."""
    @F.pandas_udf("string")
    def find(column: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def one(text: str):
            best, at = None, text.find("{")
            while at >= 0:
                try:
                    value, end = decoder.raw_decode(text, at)
                    best = text[at:end] if isinstance(value, dict) else best
                    at = text.find("{", end)
                except ValueError:
                    at = text.find("{", at + 1)
            return best

        return column.map(lambda t: one(t or ""))

    return find


def parse_extractions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) results of raw responses (A4).

    The plain case stays in the JVM. Only rows whose text is not one JSON object
    pass through the Python helper that looks for the last complete object.
    """
    c = raw.withColumn("__t", clean_response("raw"))
    whole = F.col("__t").startswith("{") & F.col("__t").endswith("}") & F.from_json("__t", "map<string,string>").isNotNull()
    plain = c.filter(F.coalesce(whole, F.lit(False)))
    salvaged = c.filter(~F.coalesce(whole, F.lit(False))).withColumn("__t", F.coalesce(_last_object()("__t"), F.lit("")))
    both = plain.unionByName(salvaged)
    parsed = both.withColumn("result", F.from_json("__t", RESULT_SCHEMA, {"mode": "PERMISSIVE"}))
    parsed = parsed.withColumn("problem", _missing(F.col("result"), F.col("__t"))).drop("__t")
    valid = parsed.filter("problem IS NULL").drop("problem", "raw")
    return valid, parsed.filter("problem IS NOT NULL").drop("result")


# source field of each record column: (column, expression builder)
def _text(name):
    return lambda r: X.normalize_text(r[name])


def _names(name):
    return lambda r: F.array_distinct(X.nonempty(F.transform(F.coalesce(r[name], F.array()), X.normalize_text)))


def _enum(name, kind, default=None):
    return lambda r: X.normalize_enum(r[name], kind, default)


_IMPORTANCE = ("importance", lambda r: X.clamp_importance(r["importance"]))
_TARGET = ("target_id", lambda r: X.normalize_text(r["targetId"]))
COLUMNS = {
    "entities": (_TARGET, ("name", _text("name")), ("type", _text("type")), ("aliases", _names("aliases")),
                 ("description", _text("description")), _IMPORTANCE),
    "identity_resolutions": (("reference", _text("reference")), ("canonical", _text("canonical")), ("evidence", _text("evidence"))),
    "record_merges": (("category", _text("category")), ("canonical_id", _text("canonicalId")),
                      ("duplicate_ids", _names("duplicateIds")), ("evidence", _text("evidence"))),
    "facts": (_TARGET, ("subject", _text("subject")), ("predicate", _text("predicate")), ("value", _text("value")),
              ("category", _text("category")), ("persistence", _enum("persistence", "persistence", "persistent")), _IMPORTANCE),
    "states": (_TARGET, ("subject", _text("subject")), ("attribute", lambda r: X.canonical_attribute(r["attribute"])),
               ("value", _text("value")), ("previous", _text("previous")), ("scope", _enum("scope", "scope")),
               ("operation", _enum("operation", "operation")), _IMPORTANCE),
    "relationships": (_TARGET, ("endpoint_a", _text("from")), ("endpoint_b", _text("to")), ("kind", _text("kind")),
                      ("status", _text("status")), ("dynamic", _text("dynamic")), _IMPORTANCE),
    "events": (("title", _text("title")), ("summary", _text("summary")), ("participants", _names("participants")),
               ("location", _text("location")), ("story_time", _text("storyTime")), ("consequences", _text("consequences")),
               _IMPORTANCE, ("temporal", lambda r: r["temporal"])),
    "threads": (_TARGET, ("title", _text("title")), ("detail", _text("detail")), ("status", _enum("status", "thread_status")),
                ("participants", _names("participants")), _IMPORTANCE),
    "backgrounds": (_TARGET, ("topic", _text("topic")), ("summary", _text("summary")),
                    ("status", _enum("status", "background_status")), ("certainty", _enum("certainty", "certainty")),
                    ("participants", _names("participants")), _IMPORTANCE),
}
#: most characters of a text, for callers that want texts cut
CLIPS = {
    "backgrounds": {"topic": 120, "summary": 400},
    "l1": {"title": 100, "story_time": 120, "location": 160, "opening": 320, "emotional_arc": 320, "closing": 320},
}
#: characters of a beat and beats of a row under the same option
BEAT_CLIP, BEATS_KEPT = 400, 10
_JSON_NAME = {"identity_resolutions": "identityResolutions", "record_merges": "recordMerges"}
_NEEDED = {
    "entities": "name <> ''", "facts": "subject <> '' AND predicate <> ''", "states": "subject <> '' AND attribute <> ''",
    "relationships": "endpoint_a <> '' AND endpoint_b <> ''", "events": "title <> '' OR summary <> ''",
    "threads": "title <> ''", "backgrounds": "topic <> ''",
}


def _provenance() -> list[Column]:
    return [
        F.col("chat_key"), F.col("range_from"), F.col("range_to"), F.col("allow_state_updates"),
        X.anchor_id().alias("temporal_anchor_id"),
    ]


def record_seq(range_from, n) -> Column:
    """Order of (range, record): an array index fits in 31 bits."""
    return F.shiftleft(F.col(range_from).cast("long"), 31) + F.col(n)


def _clipped(df: DataFrame, category: str) -> DataFrame:
    return df.withColumns({c: X.clip(c, n) for c, n in CLIPS.get(category, {}).items()})


def explode_category(extractions: DataFrame, category: str, clipped: bool = False) -> DataFrame:
    """Rows of one record table with provenance and anchor (A5); ``clipped`` cuts texts to ``CLIPS``."""
    field = F.col("result")[_JSON_NAME.get(category, category)]
    rows = extractions.select(*_provenance(), F.posexplode(field).alias("n", "r"))
    cols = [fn(F.col("r")).alias(name) for name, fn in COLUMNS[category]]
    seq = record_seq("range_from", "n").alias("seq")
    ident = F.concat_ws("-", F.lit(category[:3]), X.stable_hash("chat_key"), F.col("range_from").cast("string"),
                        F.col("range_to").cast("string"), F.col("n").cast("string")).alias("id")
    span = F.array(F.struct(F.col("chat_key").alias("chat_key"), "range_from", "range_to")).alias("sources")
    out = rows.select(*_provenance()[:4], "temporal_anchor_id", ident, seq, span, *cols)
    out = out.filter(_NEEDED[category]) if category in _NEEDED else out
    return _clipped(out, category) if clipped else out


def explode_l1(extractions: DataFrame, clipped: bool = False) -> DataFrame:
    """Level-1 rows with their temporal anchor; ``clipped`` cuts texts to ``CLIPS`` and the list of beats."""
    c = F.col("result")["sceneCapsule"]
    temporal = c["temporal"]
    rows = extractions.select(
        "chat_key", "range_from", "range_to",
        X.normalize_text(c["title"]).alias("title"), X.normalize_text(c["storyTime"]).alias("story_time"), X.normalize_text(c["location"]).alias("location"),
        _names("participants")(c).alias("participants"), X.normalize_text(c["opening"]).alias("opening"),
        X.nonempty(F.transform(c["beats"], X.normalize_text)).alias("beats"),
        X.normalize_text(c["emotionalArc"]).alias("emotional_arc"), X.normalize_text(c["closing"]).alias("closing"),
        X.clamp_importance(c["importance"]).alias("importance"),
        temporal["frame"].alias("frame"), temporal["relation"].alias("relation"), temporal["elapsed"].alias("elapsed"),
        temporal["certainty"].alias("certainty"),
    )
    if clipped:
        rows = _clipped(rows, "l1").withColumn("beats", F.slice(F.transform("beats", lambda b: X.clip(b, BEAT_CLIP)), 1, BEATS_KEPT))
    return temporal_anchors(rows)


def latest_scenes(extractions: DataFrame) -> DataFrame:
    """Current scene per chat: the newest range that may update state."""
    usable = extractions.filter(F.col("allow_state_updates") & F.col("result.scene").isNotNull())
    s = F.col("s")
    return usable.groupBy("chat_key").agg(F.max_by(F.col("result.scene"), F.struct("range_to", "range_from")).alias("s")).select(
        "chat_key", X.normalize_text(s["location"]).alias("location"), X.normalize_text(s["time"]).alias("time"),
        _names("participants")(s).alias("participants"), X.normalize_text(s["activity"]).alias("activity"),
        X.normalize_text(s["mood"]).alias("mood"))


def explode_records(extractions: DataFrame) -> dict[str, DataFrame]:
    """All record tables of the extractions (A5)."""
    tables = {name: explode_category(extractions, name) for name in COLUMNS}
    tables["l1"] = explode_l1(extractions)
    tables["scenes"] = latest_scenes(extractions)
    return tables


def extract_ranges(ranges: DataFrame, fn, measure_limit: int = 16) -> DataFrame:
    """Apply a user extraction function to message ranges, splitting failures (2.J).

    ``ranges(chat_key, range_from, range_to, messages array<struct<idx,name,text,tokens>>)``;
    ``fn(list of messages) -> str`` raises when its output is too large. A failed
    range is split at the token balance point and tried again, at most
    ``measure_limit`` splits per range. Ranges are independent rows.
    """
    def run(frames):
        for pdf in frames:
            out = []
            for chat, messages in zip(pdf["chat_key"], pdf["messages"]):
                queue, splits = [list(messages)], 0
                while queue:
                    part = queue.pop(0)
                    try:
                        out.append((chat, part[0]["idx"], part[-1]["idx"], fn(part), None))
                    except Exception as error:
                        if len(part) < 2 or splits >= measure_limit:
                            out.append((chat, part[0]["idx"], part[-1]["idx"], None, str(error)))
                            continue
                        weights = [max(1, m["tokens"]) for m in part]
                        total, run_sum, best, at = sum(weights), 0, None, 1
                        for i in range(1, len(part)):
                            run_sum += weights[i - 1]
                            gap = abs(total - 2 * run_sum)
                            if best is None or gap < best:
                                best, at = gap, i
                        queue[:0] = [part[:at], part[at:]]
                        splits += 1
            yield pd.DataFrame(out, columns=["chat_key", "range_from", "range_to", "raw", "error"])

    return ranges.select("chat_key", "messages").mapInPandas(
        run, "chat_key string, range_from long, range_to long, raw string, error string")
