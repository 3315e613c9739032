"""Sides that a generator multiplies are shuffled, never broadcast from the driver."""

from pyspark.sql import functions as F

from foldscope.operators import cohort, components, metrics


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_replicates_are_shuffled(spark):
    units = spark.range(40).select(F.col("id").alias("unit"), (F.col("id") % 2).cast("int").alias("label"), (F.col("id") / 40.0).alias("score"))
    rep = metrics.resample(units, ["unit"], 20)
    assert "BroadcastHashJoin" not in _plan(rep)
    assert rep.groupBy("_b").agg(F.sum("_wt").alias("n")).filter("n <> 40").isEmpty()


def test_candidate_counts_are_shuffled(spark):
    one = spark.range(1)
    masks = one.select(F.lit(1).alias("unit"), F.lit(10).alias("mask"), F.array(F.lit(5), F.lit(20)).alias("dims"))
    series = spark.range(7, 9).select(F.lit(1).alias("unit"), F.col("id").alias("series"), F.when(F.col("id") == 7, 6).otherwise(40).alias("n_files"))
    near = cohort.nearest_match(masks, series)
    assert "BroadcastHashJoin" not in _plan(near)
    assert [tuple(r) for r in near.collect()] == [(1, 10, 7, 1)]


def test_ring_cells_are_shuffled(spark):
    v = spark.range(30).select(F.lit(1).alias("unit"), F.col("id").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"), F.col("id").cast("double").alias("v"))
    assert _plan(components.ring_contrast(v, v.filter("v > 20"))).count("SortMergeJoin") == 2


def test_one_volume_per_shape_meets_the_masks(spark):
    ids = spark.range(300)
    dims = lambda *v: F.array(*[F.lit(x) for x in v])
    masks = ids.select(F.lit(1).alias("unit"), F.col("id").alias("mask"), dims(2, 3, 1).alias("dims"))
    volumes = ids.select(F.lit(1).alias("unit"), F.concat(F.lit("v"), F.col("id")).alias("file"), (F.col("id") % 7).alias("pref"), dims(3, 1, 2).alias("dims"))
    out = cohort.shape_match(masks, volumes)
    assert "Aggregate" in _plan(out).split("Join", 1)[1]
    assert [tuple(r) for r in out.groupBy("file").count().collect()] == [("v0", 300)]
