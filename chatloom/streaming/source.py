"""Message event streams (A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# op: new, edit, swipe or delete; seq orders the events of the whole stream
EVENT_SCHEMA = (
    "chat_key string, idx long, name string, text string, is_user boolean, is_system boolean, op string, seq long"
)


def read_message_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """File stream of message events; any streaming source with this schema serves as well."""
    reader = spark.readStream.schema(EVENT_SCHEMA).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stream_from(spark: SparkSession, fmt: str, schema_sql: str = EVENT_SCHEMA, **options) -> DataFrame:
    """Message events from another source whose value is one JSON event (for example Kafka)."""
    from pyspark.sql import functions as F

    raw = spark.readStream.format(fmt).options(**options).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema_sql).alias("e")).select("e.*")
