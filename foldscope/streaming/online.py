"""Online computations as Structured Streaming jobs, each with a batch twin.

Sinks are append-only delta tables keyed by batch id, so a replayed batch rewrites
its own delta and the read-out stays exactly-once. Every ``SNAPSHOT_EVERY`` batches the
latest row of each key is written beside them, so a batch reads one snapshot and at most
that many deltas, however long the stream has run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from foldscope.operators.ordering import ranked, top_by
from foldscope.runtime import join_groups


SNAPSHOT_EVERY = 16


def _run(stream_writer, checkpoint: str) -> None:
    q = stream_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def _deltas(spark, path: str, schema: StructType, before: int | None = None) -> DataFrame:
    """Rows with their ``batch``: the last snapshot and the deltas since; ``before`` prunes to earlier batches."""
    full = StructType([*schema.fields, StructField("batch", LongType())])
    if not _exists(spark, path):
        return spark.createDataFrame([], full)
    d = spark.read.schema(full).parquet(path)
    if before is not None:
        d = d.filter(F.col("batch") < before)
    upto = max((n for n in _snapshots(spark, path) if before is None or n < before), default=None)
    if upto is None:
        return d
    return spark.read.schema(full).parquet(f"{path}_snapshots/upto={upto}").unionByName(d.filter(F.col("batch") > upto))


def _snapshots(spark, path: str) -> list[int]:
    """Batch ids up to which finished snapshots stand."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}_snapshots")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
    return [int(f.getName()[5:]) for f in found if f.getName().startswith("upto=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]


def _compact(spark, path: str, schema: StructType, key: Sequence[str], order: Sequence[Column], batch_id: int) -> None:
    """Write the first row of each key in ``order`` as a snapshot, once in ``SNAPSHOT_EVERY`` batches."""
    if (batch_id + 1) % SNAPSHOT_EVERY == 0:
        top_by(_deltas(spark, path, schema, batch_id + 1), key, order).write.mode("overwrite").parquet(f"{path}_snapshots/upto={batch_id}")


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# --- moving average -----------------------------------------------------------------------------


def _ema_schema(fields) -> StructType:
    rest = [StructField("ema", DoubleType()), StructField("n_updates", LongType()), StructField("last_step", LongType())]
    return StructType([*fields, *rest])


def ema_state(spark, path: str, fields) -> DataFrame:
    """Latest state per key from the delta table; ``fields`` are the key's schema fields."""
    d = _deltas(spark, path, _ema_schema(fields))
    return top_by(d, [f.name for f in fields], [-F.col("batch")]).drop("batch")


def ema_stream(stream: DataFrame, state: str, checkpoint: str, key: Sequence[str] = ("unit", "slice_y"), step="step", score="score", positive="is_positive", decay=0.9) -> None:
    """Per-key moving average over a stream; positives are ignored and rows at or behind the key's last step dropped.

    A batch folds into the state by its closed form, decay^n * old + weighted sum, so a hot
    key is summed by many tasks. Only keys in the batch are written.
    """
    key = list(key)
    schema = _ema_schema([stream.schema[k] for k in key])

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        d = _deltas(spark, state, schema, batch_id)
        touched = batch.select(*key).distinct()
        old = top_by(join_groups(d, touched, key, "left_semi"), key, [-F.col("batch")]).drop("batch")
        rows = join_groups(batch.filter(~F.col(positive)).select(*key, step, score), old, key, "left")
        rows = rows.filter(F.col("last_step").isNull() | (F.col(step) > F.col("last_step")))
        r = ranked(rows, [F.col(step), F.col(score)], key, "_i")
        n = r.groupBy(*key).agg(F.max("_i").alias("_n"))
        seed = (F.col("_i") == 1) & F.col("ema").isNull()
        w = F.pow(F.lit(decay), F.col("_n") - F.col("_i")) * F.when(seed, 1.0).otherwise(1.0 - decay)
        new = join_groups(r, n, key).groupBy(*key).agg(
            F.sum(w * F.col(score)).alias("_s"), F.max("_n").alias("_n"), F.max("ema").alias("_e"), F.max("n_updates").alias("_u"), F.max(step).alias("last_step"))
        out = new.select(
            *key, (F.col("_s") + F.coalesce(F.pow(F.lit(decay), F.col("_n")) * F.col("_e"), F.lit(0.0))).alias("ema"),
            (F.col("_n") + F.coalesce("_u", F.lit(0))).cast("long").alias("n_updates"), F.col("last_step").cast("long"))
        out.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")
        _compact(spark, state, schema, key, [-F.col("batch")], batch_id)

    _run(stream.writeStream.foreachBatch(fold), checkpoint)


# A fixed number of bundles of keys share a state each; it belongs to a checkpoint and must not change under it.
BUNDLES = 1 << 14


def ema_keyed_stream(
    stream: DataFrame, sink: str, checkpoint: str, key: Sequence[str] = ("unit", "slice_y"), step="step", score="score", positive="is_positive", decay=0.9,
    bundles: int = BUNDLES,
) -> None:
    """The moving average of ``ema_stream`` with the state in Spark's state store: a batch reads the bundles it touches.

    Rows at or behind a key's last step are dropped, positives ignored, rows of one batch folded by (step, score); NULL
    scores and steps are no rows. Updated keys go to ``sink``, read by ``ema_state``. A batch that is run again after a
    failure starts from the state before it and rewrites its own delta. The state is three numbers a key and is kept for
    good. Keys meet in ``bundles`` by hash and a call folds a bundle, because a call costs far more than a row. One batch's
    rows of a bundle are one task's; size the batches (files or bytes a trigger) where a key is hot.
    """
    import pickle

    import pandas as pd

    spark, key = stream.sparkSession, list(key)
    fields = [stream.schema[k] for k in key]
    stamp = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

    def fold(bundle, batches, state):
        held = pickle.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values([step, score])
        since, seen = {}, {}
        for k, at, value in zip(rows["_key"].tolist(), rows[step].tolist(), rows[score].tolist()):
            if k not in since:
                since[k] = held.get(k)
            ema, n, _ = seen.get(k) or since[k] or (None, 0, None)
            if since[k] is None or at > since[k][2]:
                seen[k] = value if ema is None else decay * ema + (1 - decay) * value, n + 1, at
        if seen:
            held.update(seen)
            state.update((pickle.dumps(held),))
            yield pd.DataFrame([(k, *v) for k, v in seen.items()], columns=["_key", "ema", "n_updates", "last_step"])

    def save(batch: DataFrame, batch_id: int) -> None:
        typed = F.from_json("_key", StructType([StructField(f"k{i}", f.dataType) for i, f in enumerate(fields)]), stamp)
        batch.withColumn("_key", typed).select(*[F.col(f"_key.k{i}").alias(k) for i, k in enumerate(key)], "ema", "n_updates", "last_step").write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        named = F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)]), stamp).alias("_key")
        kept = stream.filter(~F.col(positive)).select(named, F.col(step).cast("long").alias(step), F.col(score).cast("double").alias(score))
        kept = kept.filter(F.col(step).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score))
        bundled = kept.withColumn("_bundle", F.pmod(F.xxhash64("_key"), F.lit(bundles)))
        out = bundled.groupBy("_bundle").applyInPandasWithState(
            fold, "_key string, ema double, n_updates long, last_step long", "held binary", "update", "NoTimeout")
        _run(out.writeStream.outputMode("update").foreachBatch(save), checkpoint)
    finally:
        spark.conf.set(setting, before)


# --- windowed counts ----------------------------------------------------------------------------


def window_counts(stream: DataFrame, window: str, slide: str | None, watermark: str, counts: dict[str, Column], ts="ts", by: Sequence[str] = ()) -> DataFrame:
    """Counts of conditions per event-time window behind a watermark."""
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    aggs = [F.sum(c.cast("long")).alias(n) for n, c in counts.items()]
    g = stream.withWatermark(ts, watermark).groupBy(w.alias("w"), *by).agg(*aggs)
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *counts)


def run_windows(counts: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Run to the end of the available input; the read-out is the last update of every window."""
    keys = [c for c in counts.columns if dict(counts.dtypes)[c] != "bigint"]

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    _run(counts.writeStream.outputMode("update").foreachBatch(save), checkpoint)
    return top_by(_deltas(counts.sparkSession, sink, counts.schema), keys, [-F.col("batch")]).drop("batch")


def progress(counts: DataFrame, minutes: float, expected: int | None = None) -> DataFrame:
    """Rate per minute and remaining seconds of windows with ``done`` counts."""
    rate = F.col("done") / F.lit(minutes)
    eta = F.when(rate > 0, F.lit(expected) / rate * 60.0) if expected is not None else F.lit(None).cast("double")
    return counts.withColumns({"rate_per_min": rate, "eta_full_sec": eta})


def anomalies(counts: DataFrame, col: str, limit: int) -> DataFrame:
    """Windows with more than ``limit`` bad steps."""
    return counts.filter(F.col(col) > limit)


# --- resumable ingest ---------------------------------------------------------------------------


def ingest_stream(parts: DataFrame, sink: str, checkpoint: str, key="id", status="status") -> DataFrame:
    """Exactly-once ingest by key: finished keys are skipped, failed keys replaced by later rows."""
    def save(batch: DataFrame, batch_id: int) -> None:
        done = _deltas(batch.sparkSession, sink, parts.schema, batch_id)
        fresh = batch.join(done.filter(F.col(status) == "ok").select(key), key, "left_anti")
        rest = [c for c in parts.columns if c != key]
        best = top_by(fresh, [key], [F.col(status) != "ok", *[F.col(c) for c in rest]])
        best.select(*parts.columns).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")
        _compact(batch.sparkSession, sink, parts.schema, [key], [F.col(status) != "ok", -F.col("batch")], batch_id)

    _run(parts.writeStream.foreachBatch(save), checkpoint)
    d = _deltas(parts.sparkSession, sink, parts.schema)
    return top_by(d, [key], [F.col(status) != "ok", -F.col("batch")]).select(*parts.columns)
