"""The range-split route must equal the plain window on the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldscope.operators import ordering as O


def rows(spark, n=500, seed=0):
    r = np.random.default_rng(seed)
    # One group holds most rows and scores tie often.
    data = [(("hot" if r.random() < 0.7 else f"g{r.integers(0, 5)}"), int(r.integers(0, 12)), i) for i in range(n)]
    return spark.createDataFrame(data, "g string, s int, id int"), data


@pytest.mark.parametrize("limit", [None, 20])
def test_ranked(spark, limit):
    df, data = rows(spark)
    got = {r.id: r.rn for r in O.ranked(df, [F.col("s").desc(), F.col("id")], ["g"], limit=limit).collect()}
    want = {}
    for g in {d[0] for d in data}:
        for k, d in enumerate(sorted((d for d in data if d[0] == g), key=lambda d: (-d[1], d[2]))):
            want[d[2]] = k + 1
    assert got == want


@pytest.mark.parametrize("limit", [None, 20])
def test_prefix_sum_without_group_and_with_null_group(spark, limit):
    df, data = rows(spark)
    got = {r.id: r.c for r in O.prefix_sum(df, [F.col("id")], {"c": F.col("s")}, limit=limit).collect()}
    run = 0
    for d in data:
        run += d[1]
        assert got[d[2]] == run
    nul = df.withColumn("g", F.when(F.col("g") != "hot", F.col("g")))
    a = {r.id: r.c for r in O.prefix_sum(nul, [F.col("id")], {"c": F.col("s")}, ["g"], limit).collect()}
    b = {r.id: r.c for r in O.prefix_sum(df, [F.col("id")], {"c": F.col("s")}, ["g"]).collect()}
    assert a == b and len(a) == 500


@pytest.mark.parametrize("limit", [None, 10])
def test_quantiles(spark, limit):
    r = np.random.default_rng(1)
    vals = r.normal(size=301)
    df = spark.createDataFrame([("a", float(v)) for v in vals] + [("b", 3.0), ("b", float("nan")), ("b", None)], "g string, v double")
    out = {x.g: x for x in O.quantiles(df, "v", {"q1": 0.013, "q2": 0.5, "q3": 1.0}, ["g"], limit=limit).collect()}
    assert out["a"].q1 == pytest.approx(np.quantile(vals, 0.013)) and out["a"].q2 == pytest.approx(np.median(vals)) and out["a"].q3 == vals.max()
    assert out["b"].q2 == 3.0 and out["b"].n == 1


def test_top_by(spark):
    df, data = rows(spark)
    got = {r.g: r.id for r in O.top_by(df, ["g"], [-F.col("s"), F.col("id")]).collect()}
    assert got == {g: min((d for d in data if d[0] == g), key=lambda d: (-d[1], d[2]))[2] for g in got}


def test_result_is_independent_of_partitioning(spark):
    df, _ = rows(spark)
    a = sorted(O.ranked(df.repartition(1), [F.col("s"), F.col("id")], ["g"], limit=20).collect())
    b = sorted(O.ranked(df.repartition(7), [F.col("s"), F.col("id")], ["g"], limit=20).collect())
    assert a == b
