"""Registry of named queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# named SQL fragments shared by oracles: name -> (needed fragments, body)
FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}


def fragment(name: str, body: str, needs: tuple[str, ...] = ()) -> None:
    FRAGMENTS[name] = (needs, body)


def sql(body: str, *needs: str) -> str:
    """Prefix ``body`` with the fragments it needs, in dependency order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in FRAGMENTS[name][0]:
            visit(dep)
        ordered.append(name)

    for n in needs:
        visit(n)
    body = body.strip()
    if not ordered:
        return body
    parts = ",\n".join(f"{n} AS ({FRAGMENTS[n][1].strip()})" for n in ordered)
    if body[:5].upper() == "WITH ":
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"


def _widen(df: DataFrame) -> DataFrame:
    """Plain column types: whole numbers as long, fractions as double."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(F.col(f.name).cast("long").alias(f.name))
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            out.append(F.col(f.name).cast("double").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def query(name: str, oracle: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = lambda spark, sf_dir: _widen(fn(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register
