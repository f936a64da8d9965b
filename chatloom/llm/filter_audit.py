"""How quality filters interact under every order they can be applied in.

Documents are reduced to masks (one bit for each filter they fail) and counted by
part and mask, at most 2^5 cells a part. Each cell then folds across the array of
all orders, a literal of the plan that reaches every task: ``aggregate`` walks an
order and remembers whether the cell is already gone, ``transform`` does so for all
120 orders. The 600 weighted structs of a cell are merged with those of the part's
other cells by elementwise sums, and one row for each order and step comes out.

Only the first step reads texts; from there on rows are narrow, and counts combine
before each shuffle, so a text that a third of all rows share costs one row a task.

Filters (true when a document fails): A under 200 words; B 100 * distinct words below
50 * words; C 100 * letters A-Z above 3 * code points; D any of ``#$%&*|``; E identical
to the text of a smaller id anywhere in the table.

Null text is empty, null language is the part ''. A null id is smaller than none and
has no smaller one, so it neither fails E nor makes others fail, and it has no labels.
Repeated rows count each; rows that share the smallest id of a text all pass E.
A document is good (toxic) if any of its label rows says so. An empty table has no
parts and gives no rows. Other columns of the inputs are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window, functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_SPACE = r"[\x20\x09-\x0D]+"
#: what a step says of a cell, all multiplied by the cell's weights
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: filters A to D over one text."""
    words = F.array_remove(F.split(text, _SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [n < 200, 100 * distinct < 50 * n, 100 * capitals > 3 * F.length(text), text.rlike(r"[#$%&*|]")]
    mask = F.lit(0)
    for bit, failed in enumerate(fails):
        mask = mask + F.when(failed, 1 << bit).otherwise(0)
    return mask


def mask_cells(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang",
    quality: str = "quality", toxic: str = "toxic",
) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents of each part by the set of filters they fail."""
    body = F.coalesce(docs[text], F.lit(""))
    slim = docs.select(
        docs[key].alias("id"), F.coalesce(docs[part], F.lit("")).alias("part"), text_mask(body).alias("mask"),
        F.unhex(F.sha2(body, 256)).alias("body"),
    )
    rows = slim.groupBy("id", "body", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.filter(labels[key].isNotNull()).groupBy(labels[key].alias("id")).agg(
        F.max(F.coalesce(labels[quality] == 1, F.lit(False))).alias("good"), F.max(F.coalesce(labels[toxic] == 1, F.lit(False))).alias("toxic")
    )
    no = F.lit(False)
    # ids that are null match no label; they stay out of the join, where they would share one task
    named = rows.filter("id is not null").join(marks, "id", "left")
    rows = named.unionByName(rows.filter("id is null").withColumn("good", no).withColumn("toxic", no))
    rows = rows.select("id", "body", "part", "mask", "n", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
    # one row for each text, part and label: its smallest id, and how many rows have that id
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    same = rows.groupBy("body", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), first.alias("first")
    )
    lead = F.min("first.id").over(Window.partitionBy("body"))
    leading = F.when(F.col("first.id") == F.col("lead"), F.col("first.n")).otherwise(0)
    same = same.withColumn("lead", lead).withColumn("pass", F.col("nameless") + F.coalesce(leading, F.lit(0)))
    outcome = F.explode(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("pass").alias("n")),
        F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("pass")).alias("n")),
    )).alias("o")
    told = same.select("part", "good", "toxic", outcome).filter("o.n > 0")
    return told.groupBy("part", F.col("o.mask").alias("mask")).agg(
        F.sum("o.n").alias("n"), F.sum(F.when(F.col("good"), F.col("o.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("o.n")).otherwise(0)).alias("toxic"),
    )


def orders() -> Column:
    """All orders as strings: a constant, so every task gets it with the plan."""
    return F.split(F.lit(",".join(ORDERS)), ",")


def _steps(order: Column, fn: Callable[[Column, Column], Column]) -> Column:
    """``fn(step, letter)`` for the steps of one order."""
    return F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda s: fn(s, F.substring(order, s, F.lit(1))))


def _bit(letter: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord(FILTERS[0]))


def fold_orders(mask: Column, n: Column, good: Column, toxic: Column) -> Column:
    """600 structs of ``COUNTS``, order by order and step by step, for one cell."""
    zero = F.lit(0).cast("long")

    def step(gone: Column, bit: Column) -> Column:
        fails = mask.bitwiseAND(bit) != 0
        here = fails & ~gone
        return F.struct(
            F.when(fails | gone, zero).otherwise(n).alias("kept"), F.when(here, n).otherwise(zero).alias("removed"),
            F.when(fails & gone, n).otherwise(zero).alias("redundant"), F.when(mask == bit, n).otherwise(zero).alias("unique_fails"),
            F.when(here, good).otherwise(zero).alias("good_lost"), F.when(here, toxic).otherwise(zero).alias("toxic_lost"),
        )

    kind = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ">"

    def walk(order: Column) -> Column:
        start = F.struct(F.lit(False).alias("gone"), F.array().cast(f"array<{kind}>").alias("steps"))
        return F.aggregate(
            _steps(order, lambda s, letter: _bit(letter)), start,
            lambda acc, bit: F.struct(
                (acc["gone"] | (mask.bitwiseAND(bit) != 0)).alias("gone"), F.concat(acc["steps"], F.array(step(acc["gone"], bit))).alias("steps")
            ),
            lambda acc: acc["steps"],
        )

    return F.flatten(F.transform(orders(), walk))


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS]))


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``part, filter_order, step`` and the counts of that step, with the filter's ``shapley`` sum."""
    cells = mask_cells(docs, labels, key, text, part)
    weighed = cells.select("part", fold_orders(*[F.col(c) for c in ("mask", "n", "good", "toxic")]).alias("steps"))
    # a part has at most 32 cells, so its list is bounded
    parts = weighed.groupBy("part").agg(F.collect_list("steps").alias("cells"))
    merged = parts.select("part", F.aggregate(F.slice("cells", 2, 32), F.col("cells")[0], _add).alias("steps"))
    places = F.flatten(F.transform(orders(), lambda o: _steps(o, lambda s, letter: F.struct(o.alias("filter_order"), s.alias("step"), letter.alias("letter")))))
    rows = merged.select("part", F.explode(F.arrays_zip(places.alias("at"), F.col("steps").alias("counts"))).alias("z"))
    shapley = F.sum("z.counts.removed").over(Window.partitionBy("part", "z.at.letter"))
    return rows.select(
        "part", "z.at.filter_order", "z.at.step", *[F.col(f"z.counts.{c}").alias(c) for c in COUNTS], shapley.alias("shapley"),
    )
