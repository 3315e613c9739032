"""Cells of a pair join below the limit are split where that saves comparisons."""

from pyspark.sql import functions as F

from foldscope.operators import boxes as B


def test_small_boxes_of_one_cell_meet_few_others(spark):
    i = F.col("id")
    xy = {"x1": i % 30 * 2.0, "z1": F.floor(i / 30) * 2.0, "x2": i % 30 * 2.0 + 1.5, "z2": F.floor(i / 30) * 2.0 + 1.5}
    rows = spark.range(900).select(F.lit(1).alias("unit"), *[c.alias(n) for n, c in xy.items()], (i % 2).cast("int").alias("_side"))
    dealt = B._dealt(rows, ["unit"], 64.0, 1024)
    leaves = dealt.groupBy("_lv", "_cx", "_cz", "_sh").agg(F.sum("_side").alias("b"), F.count("*").alias("n"))
    assert leaves.agg(F.sum(F.col("b") * (F.col("n") - F.col("b")))).first()[0] < 32 * 900
    side = lambda k: rows.filter(F.col("_side") == k).drop("_side")
    shifted = side(1).withColumns({c: F.col(c) - 1 for c in ("x1", "x2")})
    a, b = [[tuple(r) for r in t.select(*B.XY).collect()] for t in (side(0), shifted)]
    want = {(p, q) for p in a for q in b if p[0] < q[2] and q[0] < p[2] and p[1] < q[3] and q[1] < p[3]}
    got = [(tuple(r.a), tuple(r.b)) for r in B.overlap_pairs(side(0), shifted, ["unit"]).collect()]
    assert len(got) == len(want) and set(got) == want
