"""The keyed moving average folds bundles of keys: calls don't grow with the keys, and no key takes another's state."""

from pyspark.sql import functions as F

from foldscope.streaming import online as T


def test_keys_of_one_bundle_keep_their_own_state(spark, tmp_path):
    src, sink, ck = (str(tmp_path / n) for n in ("src", "sink", "ck"))
    rows = spark.range(0, 1200, numPartitions=1).select(
        F.when(F.col("id") % 300 < 299, F.col("id") % 300 + 2**60).alias("unit"), F.lit("a\"b").alias("slice_y"), F.col("id").alias("step"),
        (F.col("id") % 7 / 10).alias("score"), F.lit(False).alias("is_positive"))
    for k in range(2):
        rows.filter(F.col("step").between(600 * k, 600 * k + 599)).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    T.ema_keyed_stream(stream, sink, ck, bundles=3)
    got = {r.unit: (r.slice_y, round(r.ema, 9), r.n_updates, r.last_step) for r in T.ema_state(spark, sink, rows.schema.fields[:2]).collect()}
    want = {}
    for i in range(1200):
        u = i % 300 + 2**60 if i % 300 < 299 else None
        e = want.get(u)
        want[u] = (i % 7 / 10 if e is None else 0.9 * e[0] + (1 - 0.9) * (i % 7 / 10), (e[1] if e else 0) + 1, i)
    assert got == {u: ("a\"b", round(e, 9), n, last) for u, (e, n, last) in want.items()}
