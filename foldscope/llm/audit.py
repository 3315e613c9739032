"""Filter interaction audit: what every order of a set of filters removes, and what each filter alone answers for.

A document matters only through its mask, the set of filters it fails. Documents are counted by mask and by what
their loss means (a cell); each cell is folded once along every order of the filters.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldscope.llm.common import text_hash

# Letters of the filters, by bit of the mask.
FILTERS = "ABCDE"
BLANKS = r"[\x20\x09-\x0D]+"
FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
ROW = f"struct<{','.join(f'{f}:bigint' for f in FIELDS)}>"


def text_masks(text: Column) -> Column:
    """Bits of the filters that read the text alone: A short, B repetitive, C capitals, D marks of markup."""
    words = F.array_remove(F.split(text, BLANKS), "")
    n = F.size(words)
    fails = [
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        F.regexp_like(text, F.lit("[#$%&*|]")),
    ]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic, n: documents by source, filters failed and label; the whole corpus in a small table.

    The last filter fails where a smaller doc_id has the same text. A group of copies of any size is counted before
    it is gathered: per id first, then per (text, source, label), so a text meets at most one row per such triple.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("part"), text_hash(text).alias("h"), text_masks(text).alias("mask"))
    ids = d.groupBy("id", "h", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    ids = ids.join(marks, "id", "left").fillna({"good": False, "toxic": False})
    least = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "n"))
    groups = ids.groupBy("h", "part", "mask", "good", "toxic").agg(
        least.alias("m"), F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("without_id"))
    first = F.min(F.when(~F.col("m.null"), F.col("m.id"))).over(Window.partitionBy("h"))
    stays = F.col("without_id") + F.when(F.col("m.id") == F.col("first"), F.col("m.n")).otherwise(0)
    g = groups.withColumn("first", first).withColumn("stays", stays)
    e = 1 << FILTERS.index("E")
    split = F.explode(F.array(F.struct(F.col("mask"), F.col("stays").alias("n")), F.struct((F.col("mask") + e).alias("mask"), (F.col("n") - F.col("stays")).alias("n"))))
    out = g.select("part", "good", "toxic", split.alias("c")).groupBy("part", "c.mask", "good", "toxic").agg(F.sum("c.n").alias("n"))
    return out.filter("n > 0")


def orders(filters: str = FILTERS) -> list[str]:
    """All orders of the filters."""
    return ["".join(o) for o in permutations(filters)]


def fold(cell: Column, filters: str = FILTERS) -> Column:
    """The structs of one cell (mask, good, toxic, n), weighted by its count: all orders, step by step.

    The state along an order is the count still there; a step takes it to 0 where the cell fails the step's filter.
    """
    n, zero = cell["n"], F.lit(0).cast("long")
    alone = F.bit_count(cell["mask"]) == 1

    def step(state: Column, bit: Column) -> Column:
        fails, here = cell["mask"].bitwiseAND(bit) != 0, state["left"]
        gone = F.when(fails, here).otherwise(zero)
        row = (here - gone, gone, F.when(fails, n - here).otherwise(zero), F.when(fails & alone, n).otherwise(zero),
               F.when(cell["good"], gone).otherwise(zero), F.when(cell["toxic"], gone).otherwise(zero))
        row = F.struct(*[v.alias(f) for f, v in zip(FIELDS, row, strict=True)])
        return F.struct((here - gone).alias("left"), F.array_append(state["rows"], row).alias("rows"))

    start = F.struct(n.alias("left"), F.array().cast(f"array<{ROW}>").alias("rows"))
    bits = F.array(*[F.array(*[F.lit(1 << filters.index(f)) for f in o]) for o in orders(filters)])
    return F.flatten(F.transform(bits, lambda order: F.aggregate(order, start, step, lambda s: s["rows"])))


def interactions(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of ``FIELDS``, with shapley: removals of the step's filter over all orders.

    ``counted`` has a row per cell (see ``cells``). A part gathers at most 4 * 2^filters cells, whatever its documents;
    every cell gives a struct per order and step, and the structs of a part's cells are added place by place.
    """
    names = orders(filters)
    zeros = F.array_repeat(F.struct(*[F.lit(0).cast("long").alias(f) for f in FIELDS]), len(names) * len(filters))
    added = lambda a, b: F.struct(*[(a[f] + b[f]).alias(f) for f in FIELDS])
    whole = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("cells"))
    merged = F.aggregate("cells", zeros, lambda acc, c: F.zip_with(acc, fold(c, filters), added))
    rows = whole.select("part", F.posexplode(merged).alias("at", "v"))
    order = F.get(F.array(*[F.lit(o) for o in names]), F.floor(F.col("at") / len(filters)).cast("int"))
    rows = rows.select("part", order.alias("filter_order"), (F.col("at") % len(filters) + 1).alias("step"), *[F.col(f"v.{f}") for f in FIELDS])
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of the five filters over ``docs`` (doc_id, text, source) and ``labels`` (doc_id, quality, toxic).

    NULL texts are empty (short, nothing else, and equal to one another); a NULL source is the part '', as an empty
    one is; a NULL doc_id has no label, is nobody's smaller id and never fails the copies' filter. Rows of equal id and
    text are documents of their own, none smaller than the other. A document is good or toxic if any of its label rows
    says so. Other columns are ignored; an empty table gives no rows.
    """
    return interactions(cells(docs, labels))
