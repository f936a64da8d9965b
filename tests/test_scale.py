"""Two-level windows equal the plain window, whatever the bucket size."""

import random

from pyspark.sql import Window, functions as F

from chatloom.operators import scale as S


def sample(spark, n=400, seed=7):
    rnd = random.Random(seed)
    rows = [("hot" if rnd.random() < 0.6 else f"c{rnd.randrange(5)}", i, rnd.randrange(9), None if rnd.random() < 0.4 else rnd.randrange(100)) for i in range(n) if rnd.random() < 0.8]
    return spark.createDataFrame(rows, "chat_key string, idx long, v long, x long")


def test_positions_sums_and_neighbours(spark):
    df = sample(spark).cache()
    up, down = Window.partitionBy("chat_key").orderBy("idx"), Window.partitionBy("chat_key").orderBy(F.desc("idx"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select(
        "chat_key", "idx", F.row_number().over(up).alias("a"), F.row_number().over(down).alias("b"),
        F.sum("v").over(up).alias("c"), F.sum("v").over(down).alias("d"), F.max("v").over(up).alias("m"), F.max("v").over(before).alias("ms"),
        F.lag("v").over(up).alias("e"), F.lead("v").over(up).alias("f"), F.last("x", True).over(before).alias("g")).cache()
    for rows in (1, 7, 100_000):
        seq = S.message_order(rows=rows)
        steps = {
            "a": S.with_position(df, seq, "a"), "b": S.with_position(df, seq, "b", descending=True),
            "c": S.with_running_sums(df, seq, {"c": F.col("v"), "one": F.lit(1)}), "d": S.with_running_sum(df, seq, F.col("v"), "d", descending=True),
            "m": S.with_running(df, seq, F.col("v"), "m", F.max), "ms": S.with_running(df, seq, F.col("v"), "ms", F.max, strict=True),
            "e": S.with_previous(df, seq, {"e": F.col("v")}), "f": S.with_previous(df, seq, {"f": F.col("v")}, descending=True),
            "g": S.with_last_before(df, seq, "g", F.col("x")),
        }
        for name, got in steps.items():
            cols = ["chat_key", "idx", name]
            assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.select(*cols).collect())), (rows, name)


def test_latest_and_distinct(spark):
    df = sample(spark)
    latest = {r.chat_key: r.idx for r in S.latest_by(df, ["chat_key"], F.col("idx")).collect()}
    first = {r.chat_key: r.idx for r in S.distinct_order(df, ["chat_key"], F.col("idx")).collect()}
    for chat in latest:
        ids = [r.idx for r in df.filter(F.col("chat_key") == chat).collect()]
        assert latest[chat] == max(ids) and first[chat] == min(ids)


def test_write_through_reads_back(spark):
    df = sample(spark)
    back = S.write_through(df, "x")
    assert back.schema == df.schema and back.count() == df.count()
