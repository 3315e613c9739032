"""Cohort building: reject logs, roles, canonical picks, folds, cross-walks and summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldscope import runtime
from foldscope.functions.hashing import hash32
from foldscope.operators.ordering import quantiles, ranked, top_by
from foldscope.runtime import join_groups

# --- filters ------------------------------------------------------------------------------------


def filter_with_log(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped with ``reason``): the reason is the first rule that rejects the row."""
    reason = F.lit(None).cast("string")
    for name, bad in reversed(list(rules)):
        reason = F.when(F.coalesce(bad, F.lit(False)), F.lit(name)).otherwise(reason)
    tagged = df.withColumn("reason", reason)
    return tagged.filter("reason is null").drop("reason"), tagged.filter("reason is not null")


def to_nested(df: DataFrame, layout: Mapping[str, object]) -> DataFrame:
    """Reshape flat columns into nested records: values are columns or nested mappings."""
    def build(v):
        if isinstance(v, Mapping):
            return F.struct(*[build(x).alias(k) for k, x in v.items()])
        return v if isinstance(v, Column) else F.col(v)

    return df.select(*[build(v).alias(k) for k, v in layout.items()])


def split_to_fold(col: Column) -> tuple[Column, Column]:
    """(cohort, fold) of a split label ``holdout`` or ``fold<k>``; anything else is an error."""
    k = F.regexp_extract(col, r"^fold(\d+)$", 1)
    bad = F.raise_error(F.concat(F.lit("unknown split: "), F.coalesce(col, F.lit("NULL"))))
    cohort = F.when(col == "holdout", "holdout").when(k != "", "cross-validation").otherwise(bad)
    return cohort, F.when(k != "", F.try_to_number(k, F.lit("999")).cast("int"))


def fold_split(df: DataFrame, folds: int, fold="fold", cohort="cohort", only: int | None = None) -> DataFrame:
    """Role of every row in every fold: val in its own, train in the others, holdout apart."""
    ids = F.array(*[F.lit(i) for i in ([only] if only is not None else range(folds))])
    role = F.when(F.col(cohort) == "holdout", "holdout").when(F.col(fold) == F.col("run_fold"), "val").otherwise("train")
    return df.withColumn("run_fold", F.explode(ids)).withColumn("role", role)


def guard_holdout(df: DataFrame, allow: bool = False, cohort="cohort", key="unit") -> DataFrame:
    """Pass rows through; a holdout row stops the job unless allowed."""
    if allow:
        return df
    stop = F.raise_error(F.concat(F.lit("holdout unit requested: "), F.col(key).cast("string"))).cast("string")
    return df.withColumn(cohort, F.when(F.col(cohort) == "holdout", stop).otherwise(F.col(cohort)))


def reclassify(df: DataFrame, evidence: DataFrame, key="unit", cohort="cohort") -> DataFrame:
    """Positives without evidence become negatives with ``soft_negative``."""
    has = evidence.select(key).distinct().withColumn("_e", F.lit(True))
    j = df.join(has, key, "left")
    soft = (F.col(cohort) == "pos") & F.col("_e").isNull()
    return j.withColumn("soft_negative", soft).withColumn(cohort, F.when(soft, "neg").otherwise(F.col(cohort))).drop("_e")


def backfill(df: DataFrame, src: DataFrame, key: str, col: str) -> DataFrame:
    """Fill blank or NULL values of ``col`` from ``src``; of several values of a key the least."""
    s = src.groupBy(key).agg(F.min(col).alias("_src"))
    return df.join(s, key, "left").withColumn(col, F.coalesce(F.nullif(F.trim(col), F.lit("")), "_src")).drop("_src")


def shard(df: DataFrame, n: int, key: Sequence[str]) -> DataFrame:
    """Stable shard number from the key, not from row order."""
    return df.withColumn("shard", F.pmod(hash32(*[F.col(k) for k in key]), F.lit(n)).cast("int"))


def build_queue(df: DataFrame, key: str, wanted=None, failed=None, done=None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(queue, wanted ids missing from ``df``): restrict, drop finished, first N by id."""
    q, miss = df, df.select(key).limit(0)
    if wanted is not None:
        q, miss = q.join(wanted.select(key), key, "left_semi"), wanted.select(key).join(df.select(key), key, "left_anti")
    if failed is not None:
        q = q.join(failed.select(key), key, "left_semi")
    if done is not None:
        q = q.join(done.select(key), key, "left_anti")
    return (q.orderBy(key).limit(limit) if limit else q), miss


def derive_flags(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(flags))


# --- picks and roles ----------------------------------------------------------------------------


def value_freq(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("freq"))


def pick_canonical(df: DataFrame, unit="unit", descr="descr", n_files="n_files", name="series") -> DataFrame:
    """One row per unit: most frequent description overall, most files, first name.

    Rows collapse to the best per (unit, description) before the frequency join.
    """
    best = top_by(df, [unit, descr], [-F.col(n_files), F.col(name)])
    j = best.join(value_freq(df, descr), descr)
    return top_by(j, [unit], [-F.col("freq"), -F.col(n_files), F.col(name)])


def assign_roles(df: DataFrame, prefixes: Mapping[str, str], main="WATER", unit="unit", token="token", descr="descr", name="series", limit=None) -> DataFrame:
    """Canonical row of the main token plus numbered alternates and other tokens per unit."""
    canon = pick_canonical(df.filter(F.col(token) == main), unit, descr, name=name).select(unit, name, F.lit(True).alias("_c"))
    j = df.join(canon, [unit, name], "left").withColumn("_c", F.coalesce("_c", F.lit(False)))
    r = ranked(j, [F.col(descr), F.col(name)], [unit, token, "_c"], "_k", limit)
    prefix = F.lit(None).cast("string")
    for t, p in prefixes.items():
        prefix = F.when(F.col(token) == t, p).otherwise(prefix)
    role = F.when(F.col("_c"), F.lit("canonical")).otherwise(prefix)
    base = F.when(F.col("_c"), F.lit("canonical")).otherwise(F.format_string("%s_%02d", prefix, F.col("_k")))
    return r.withColumns({"role": role, "basename": base}).drop("_c", "_k")


def pick_subvolume(df: DataFrame, masks: DataFrame | None = None, unit="unit", file="file", kind="kind", want="ok", slices="n_slices", idx="idx") -> DataFrame:
    """One row per unit: preferred mask pairing, then wanted type, most slices, lowest index."""
    if masks is not None:
        df = df.join(masks.select(unit, file, "pref"), [unit, file], "left")
    else:
        df = df.withColumn("pref", F.lit(None).cast("int"))
    order = [F.coalesce("pref", F.lit(2147483647)), (F.col(kind) != want), -F.col(slices), F.col(idx)]
    return top_by(df, [unit], order)


def dedup_batches(df: DataFrame, positives: DataFrame | None = None, unit="unit", batch="batch", n="n_series") -> DataFrame:
    """Winning batch per unit (most series, then first name) with the number of alternates."""
    if positives is not None:
        df = df.join(positives.select(unit), unit, "left_anti")
    best = F.min(F.struct((-F.col(n)).alias("k"), F.col(batch))).alias("m")
    return df.groupBy(unit).agg(best, (F.count("*") - 1).alias("n_alternates")).select(
        unit, F.col(f"m.{batch}").alias(batch), (-F.col("m.k")).alias(n), "n_alternates")


def batch_alternates(df: DataFrame, winners: DataFrame, unit="unit", batch="batch") -> DataFrame:
    """The losing batches of every unit, one row each."""
    return df.join(winners.select(unit, batch), [unit, batch], "left_anti").join(winners.select(unit), unit, "left_semi")


def proportional_alloc(sizes: DataFrame, target: int, key: Sequence[str], size="size", limit=None) -> DataFrame:
    """Largest-remainder shares of ``target``, never above the stratum's size.

    With target <= total the leftover is smaller than the number of fractional strata,
    so one pass in remainder order places it; beyond the total every stratum is full.
    """
    total = sizes.agg(F.sum(size).alias("t")).scalar()
    raw = F.coalesce(F.try_divide(F.lit(target) * F.col(size), total), F.lit(0.0))
    f = sizes.withColumns({"_raw": raw, "_floor": F.least(F.floor(raw), F.col(size))}).withColumn("_frac", F.col("_raw") - F.col("_floor"))
    f = ranked(f, [F.col("_frac").desc(), *[F.col(k) for k in key]], (), "_rk", limit)
    left = F.lit(target) - f.agg(F.sum("_floor").alias("s")).scalar()
    extra = ((F.col("_rk") <= left) & (F.col("_floor") < F.col(size))).cast("long")
    return f.select(*key, size, (F.col("_floor") + extra).alias("alloc"))


def stratified_split(df: DataFrame, strata: Sequence[str], holdout: int, cv: int, folds: int, seed=42, unit="unit", leftover="unused", limit=None) -> DataFrame:
    """Split label per unit: keyed shuffle inside strata, holdout first, then folds round-robin."""
    strata = list(strata)
    sizes = df.groupBy(*strata).agg(F.count("*").alias("size"))
    h = proportional_alloc(sizes, holdout, strata, limit=limit).select(*strata, "size", F.col("alloc").alias("_h"))
    rest = h.select(*strata, (F.col("size") - F.col("_h")).alias("size"))
    c = proportional_alloc(rest, cv, strata, limit=limit).select(*strata, F.col("alloc").alias("_c"))
    r = ranked(df.withColumn("_x", hash32(seed, F.col(unit))), [F.col("_x"), F.col(unit)], strata, "_rk", limit)
    j = r.join(h.drop("size"), strata).join(c, strata)
    pos = F.col("_rk") - F.col("_h") - 1
    split = F.when(F.col("_rk") <= F.col("_h"), "holdout").when(pos < F.col("_c"), F.concat(F.lit("fold"), F.pmod(pos, F.lit(folds)).cast("string"))).otherwise(leftover)
    return j.withColumn("split", split).drop("_x", "_rk", "_h", "_c")


# --- joins --------------------------------------------------------------------------------------


def join_scan(plan: DataFrame, scan: DataFrame, left: str, right: str, cols: Sequence[str]) -> DataFrame:
    """Left join on differently named keys."""
    s = scan.select(F.col(right).alias("_k"), *cols)
    return plan.join(s, plan[left] == s["_k"], "left").drop("_k")


def annotate_splits(df: DataFrame, splits: DataFrame, key="unit") -> DataFrame:
    return df.join(splits.select(key, "split"), key, "left").withColumn("in_splits", F.col("split").isNotNull())


def attach(df: DataFrame, dim: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Add lookup columns by id; the join strategy follows the measured size of ``dim``."""
    return df.join(dim.select(key, *cols), key, "left")


def restrict(df: DataFrame, ids: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(ids, list(key), "left_semi")


def exclude(df: DataFrame, ids: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(ids, list(key), "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Long table of changed cells ``(key, col, old, new)`` and added/removed rows."""
    s = lambda df, p: df.select(F.col(key), F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols]).alias(p))
    j = s(old, "o").join(s(new, "n"), key, "full")
    status = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed")
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"o.{c}").alias("old"), F.col(f"n.{c}").alias("new")) for c in cols])
    out = j.select(key, status.alias("status"), F.explode(cells).alias("d")).select(key, "status", "d.*")
    return out.filter(~F.col("old").eqNullSafe(F.col("new"))).withColumn("status", F.coalesce("status", F.lit("changed")))


def assert_unchanged(old: DataFrame, new: DataFrame, key: str, hash_col: str, touched: DataFrame | None = None) -> DataFrame:
    """Rows outside ``touched`` whose hash changed or that vanished."""
    o = old if touched is None else old.join(touched.select(key), key, "left_anti")
    n = new.select(key, F.col(hash_col).alias("_new"))
    return o.select(key, hash_col).join(n, key, "left").filter(~F.col(hash_col).eqNullSafe(F.col("_new"))).withColumnRenamed("_new", "new_hash")


def crosswalk(manifest: DataFrame, sidecar: DataFrame, splits: DataFrame, key="unit", label="label") -> tuple[DataFrame, DataFrame]:
    """(rows present and consistent in all three, one row per violation)."""
    s = sidecar.select(key, F.col(label).alias("_sl"), F.lit(True).alias("_s"))
    p = splits.select(key, "split", F.lit(True).alias("_p"))
    j = manifest.join(s, key, "left").join(p, key, "left")
    v = F.array_compact(F.array(
        F.when(F.col("_s").isNull(), "no_sidecar"), F.when(F.col("_p").isNull(), "no_split"), F.when(F.col("_sl") != F.col(label), "label_mismatch")))
    j = j.withColumn("violations", v)
    ok = j.filter(F.size("violations") == 0).drop("_s", "_p", "_sl", "violations")
    bad = j.select(key, F.explode("violations").alias("violation"))
    orphan = splits.select(key).join(manifest.select(key), key, "left_anti").select(key, F.lit("split_without_row").alias("violation"))
    return ok, bad.unionByName(orphan)


def keep_best_rank(df: DataFrame, key: str, rank: str) -> DataFrame:
    """All rows of every key that carry its lowest rank."""
    best = df.groupBy(key).agg(F.min(rank).alias(rank))
    return df.join(best, [key, rank], "left_semi")


def nearest_match(masks: DataFrame, series: DataFrame, tol: int = 2, unit="unit", mask="mask", dims="dims", name="series", n="n_files") -> DataFrame:
    """Series whose file count is within ``tol`` of a mask dimension, when it is the only one.

    Candidate counts are generated from the mask side, so the join is an equality.
    """
    near = masks.select(unit, mask, F.explode(dims).alias("_d")).withColumn("_o", F.explode(F.sequence(F.lit(-tol), F.lit(tol))))
    near = near.groupBy(unit, mask, (F.col("_d") + F.col("_o")).alias("_n")).agg(F.min(F.abs("_o")).alias("diff"))
    j = runtime.spread(near).join(series.select(unit, name, F.col(n).alias("_n")), [unit, "_n"])
    one = j.groupBy(unit, mask).agg(F.count_distinct(name).alias("_k"), F.min(name).alias(name), F.min("diff").alias("diff"))
    return one.filter("_k = 1").drop("_k")


def cascade_match(masks: DataFrame, series: DataFrame, tol=2, unit="unit", mask="mask", suffix="suffix", dims="dims", name="series", descr="descr", n="n_files") -> DataFrame:
    """Series per mask by exact name, then nearest dimension, then the unit's only series; method recorded."""
    exact = masks.join(series.select(unit, F.replace(F.col(descr), F.lit(" "), F.lit("_")).alias(suffix), name), [unit, suffix])
    exact = exact.groupBy(unit, mask).agg(F.min(name).alias(name)).select(unit, mask, name, F.lit(0).alias("prio"))
    plain = nearest_match(masks, series, tol, unit, mask, dims, name, n).select(unit, mask, name, F.lit(1).alias("prio"))
    single = series.groupBy(unit).agg(F.count_distinct(name).alias("_k"), F.min(name).alias(name)).filter("_k = 1")
    only = masks.select(unit, mask).join(single.select(unit, name), unit).select(unit, mask, name, F.lit(2).alias("prio"))
    best = top_by(exact.unionByName(plain).unionByName(only), [unit, mask], [F.col("prio")])
    method = F.when(F.col("prio") == 0, "exact_name").when(F.col("prio") == 1, "nearest_dim").when(F.col("prio") == 2, "single_series").otherwise("no_match")
    return masks.select(unit, mask).join(best, [unit, mask], "left").withColumn("method", method).drop("prio")


def shape_match(masks: DataFrame, volumes: DataFrame, unit="unit", mask="mask", dims="dims", name="file", pref="pref") -> DataFrame:
    """First preferred volume with the same dimensions in any axis order.

    Of the volumes of a unit with equal dimensions only the first can be anyone's, so no mask meets the others.
    """
    s = lambda df: df.withColumn("_s", F.array_sort(dims)).drop(dims)
    firsts = top_by(s(volumes.select(unit, name, pref, dims)), [unit, "_s"], [F.col(pref), F.col(name)], [pref, name])
    j = s(masks.select(unit, mask, dims)).join(firsts, [unit, "_s"])
    return top_by(j.drop("_s"), [unit, mask], [F.col(pref), F.col(name)])


def prefix_map(files: DataFrame, ids: DataFrame, pattern: str, file="file", key="id") -> DataFrame:
    """File to id through a fixed-pattern prefix, as an equality join."""
    f = files.withColumn(key, F.regexp_extract(file, pattern, 1))
    return f.join(ids, key, "left")


def preflight(plan: DataFrame, files: DataFrame, path="path", expected="n_expected", count="n_files") -> DataFrame:
    """One row per problem: missing source (error) or unexpected file count (warning)."""
    j = plan.join(files.select(path, F.col(count).alias("_n")), path, "left")
    sev = F.when(F.col("_n").isNull(), "error").when(F.col("_n") != F.col(expected), "warning")
    kind = F.when(F.col("_n").isNull(), "missing_source").otherwise("count_mismatch")
    return j.withColumns({"severity": sev, "check": kind}).filter("severity is not null").drop("_n")


def presence_breakdown(a: DataFrame, b: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of ids only in a, only in b, and in both."""
    cols = [key, *by]
    j = a.select(*cols).distinct().withColumn("_a", F.lit(1)).join(b.select(*cols).distinct().withColumn("_b", F.lit(1)), cols, "full")
    kind = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("both")
    return j.groupBy(*by, kind.alias("presence")).agg(F.count("*").alias("n"))


# --- aggregates ---------------------------------------------------------------------------------


def count_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def n_unique(df: DataFrame, col: str, approx: bool = False) -> DataFrame:
    return df.agg((F.approx_count_distinct(col) if approx else F.count_distinct(col)).alias("n_unique"))


def fold_summary(df: DataFrame, cohort="cohort", label="label", fold="fold") -> DataFrame:
    """Units, positives and negatives per fold with a holdout row (NULL fold)."""
    f = F.when(F.col(cohort) == "holdout", None).otherwise(F.col(fold))
    return df.groupBy(cohort, f.alias(fold)).agg(
        F.count("*").alias("n"), F.sum(label).cast("long").alias("n_pos"), (F.count("*") - F.sum(label)).cast("long").alias("n_neg"))


def check_counts(df: DataFrame, expected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Group counts against expected ones, groups missing on either side included."""
    have = df.groupBy(*keys).agg(F.count("*").alias("actual"))
    j = have.join(expected.select(*keys, "expected"), list(keys), "full")
    j = j.withColumns({"actual": F.coalesce("actual", F.lit(0)), "expected": F.coalesce("expected", F.lit(0))})
    return j.withColumn("ok", F.col("actual") == F.col("expected"))


def quantize(v: Column, w: float = 0.01) -> Column:
    """Nearest multiple of ``w``, halves to even, printed to 2 places."""
    return F.bround(F.rint(v / F.lit(w)) * F.lit(w), 2)


def binned_mode(df: DataFrame, col: str, w: float = 0.01, top: int = 5) -> DataFrame:
    """Most frequent quantized values with their share in percent."""
    cells = df.filter(F.col(col).isNotNull()).groupBy(quantize(F.col(col), w).alias("value")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("t")).scalar()
    return cells.withColumn("pct", F.col("n") * 100.0 / total).orderBy(F.col("n").desc(), "value").limit(top)


def dominant_or_median(df: DataFrame, col: str, w: float = 0.01, limit=None) -> DataFrame:
    """The most frequent bin when it holds more than half of the values, else the quantized median."""
    cells = df.filter(F.col(col).isNotNull()).groupBy(quantize(F.col(col), w).alias("value")).agg(F.count("*").alias("n"))
    m = cells.agg(F.min(F.struct((-F.col("n")).alias("k"), "value")).alias("m"), F.sum("n").alias("t"))
    med = quantiles(df, col, {"med": 0.5}, limit=limit).select(quantize(F.col("med"), w).alias("med")).scalar()
    return m.select(F.when(-F.col("m.k") * 2 > F.col("t"), F.col("m.value")).otherwise(med).alias("chosen"))


def latency_summary(df: DataFrame, col: str, by: Sequence[str] = (), limit=None) -> DataFrame:
    """Mean and exact p50/p90/p99 over finite values."""
    fin = df.filter(F.col(col).isNotNull() & ~F.isnan(col) & (F.abs(col) != float("inf")))
    q = quantiles(fin, col, {"p50": 0.5, "p90": 0.9, "p99": 0.99}, by, limit=limit)
    m = fin.groupBy(*by).agg(F.avg(col).alias("mean"))
    return join_groups(q, m, by) if by else q.withColumn("mean", m.select("mean").scalar())


def run_summary(df: DataFrame, num: str, den: str, status="status", by: Sequence[str] = ()) -> DataFrame:
    """Ratio of sums, mean ratio and count of ok rows."""
    return df.groupBy(*by).agg(
        F.try_divide(F.sum(num), F.sum(den)).alias("growth"), F.avg(F.try_divide(F.col(num), F.col(den))).alias("mean_ratio"),
        F.sum((F.col(status) == "ok").cast("long")).alias("n_ok"), F.count("*").alias("n"))


def dataset_summary(df: DataFrame, unit="unit", label="label") -> DataFrame:
    """Units, rows and positive-to-negative ratio, infinite without negatives."""
    pos, neg = F.sum(label), F.sum(1 - F.col(label))
    return df.agg(F.count_distinct(unit).alias("n_units"), F.count("*").alias("n_rows"),
                  F.when(neg > 0, pos / neg).otherwise(F.lit(float("inf"))).alias("pos_neg_ratio"))


def score_ema(df: DataFrame, key: Sequence[str], order: Sequence[str], score="score", decay=0.9, limit=None) -> DataFrame:
    """Final moving average per key: seeded by the first score, then ``decay*old + (1-decay)*new``.

    The recurrence unrolls to a weighted sum over positions, so no group is gathered in one row.
    """
    r = ranked(df, [F.col(c) for c in order], key, "_i", limit)
    n = r.groupBy(*key).agg(F.max("_i").alias("_n"))
    w = F.pow(F.lit(decay), F.col("_n") - F.col("_i")) * F.when(F.col("_i") == 1, 1.0).otherwise(1.0 - decay)
    return join_groups(r, n, key).groupBy(*key).agg(F.sum(w * F.col(score)).alias("ema"), F.max("_n").alias("n_updates"))


def gap_pool(df: DataFrame, key: Sequence[str], feats="feats") -> DataFrame:
    """Mean of each channel over all rows of a key, as ``(key, channel, value)``."""
    e = df.select(*key, F.posexplode(feats).alias("channel", "_v"))
    return e.groupBy(*key, "channel").agg(F.avg(F.col("_v").cast("double")).alias("value"))


def score_hist(df: DataFrame, score="score", bins=10, lo=0.0, hi=1.0) -> DataFrame:
    b = F.least(F.width_bucket(F.col(score), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins))
    return df.groupBy(b.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


# --- windows ------------------------------------------------------------------------------------


def context_window(df: DataFrame, key: Sequence[str], order: str, half: int = 2, value="value") -> DataFrame:
    """Values at positions k-half..k+half of a gap-free sequence; incomplete windows are dropped.

    Each row is sent to the positions it serves, so a long sequence is not one task.
    """
    send = df.select(*key, F.col(order).alias("_o"), F.col(value).alias("_v"), F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("_d"))
    got = send.groupBy(*key, (F.col("_o") - F.col("_d")).alias(order)).agg(F.array_sort(F.collect_list(F.struct("_d", "_v"))).alias("_w"))
    return got.filter(F.size("_w") == 2 * half + 1).select(*key, order, F.transform("_w", lambda s: s["_v"]).alias("window"))


def regrid(df: DataFrame, key: Sequence[str], axis: str, value: str, n_in: int | Column, src: float | Column, dst: float, order: int = 1) -> DataFrame:
    """Resample ``n_in`` samples per key to a new spacing: linear (1) or nearest (0).

    Sample counts and spacings may be columns, one value per key. Every sample is sent to the target points
    around it, with its weight there.
    """
    n_in, src = (c if isinstance(c, Column) else F.lit(c) for c in (n_in, src))
    n_out = F.rint(n_in * src / dst).cast("int")
    step = F.when(n_out > 1, (n_in - 1) / F.greatest(n_out - 1, F.lit(1)).cast("double")).otherwise(F.lit(0.0))
    at = F.col(axis)
    # One point more on either side than the spacing asks for; the exact weight decides.
    first = F.coalesce(F.floor((at - 1) / F.nullif(step, F.lit(0.0))) - 1, F.lit(0))
    last = F.coalesce(F.ceil((at + 1) / F.nullif(step, F.lit(0.0))) + 1, F.lit(0))
    points = F.sequence(F.greatest(first, F.lit(0)).cast("int"), F.least(last, n_out - 1).cast("int"))
    sent = df.filter(n_out > 0).select(*df.columns, n_in.alias("_n"), step.alias("_step"), F.explode(F.when(first <= n_out - 1, points)).alias("_j"))
    p = F.col("_j") * F.col("_step")
    if order == 0:
        w = F.when(F.least(F.floor(p + 0.5), F.col("_n") - 1) == at, F.lit(1.0))
    else:
        lo = F.least(F.floor(p), F.col("_n") - 1)
        w = F.when(at == lo, 1.0 - (p - lo)).when(at == lo + 1, p - lo)
    sent = sent.withColumn("_w", w).filter("_w is not null")
    return sent.groupBy(*key, F.col("_j").alias(axis)).agg(F.sum(F.col(value) * F.col("_w")).alias(value))


def crop_pad(df: DataFrame, axis: str, lo: int | Column, hi: int | Column, n: int | Column) -> DataFrame:
    """Keep axis values in [lo, hi) and centre them in a frame of ``n``; a longer extent is an error.

    Bounds and frame may be columns, one value per row's key; rows without bounds are dropped.
    """
    if not any(isinstance(v, Column) for v in (lo, hi, n)):
        if hi - lo > n:
            raise ValueError(f"extent {hi - lo} exceeds frame {n}")
        return df.filter((F.col(axis) >= lo) & (F.col(axis) < hi)).withColumn(axis, F.col(axis) - lo + (n - (hi - lo)) // 2)
    lo, hi, n = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi, n))
    stop = F.raise_error(F.concat(F.lit("extent "), (hi - lo).cast("string"), F.lit(" exceeds frame "), n.cast("string"))).cast("int")
    pad = F.when(hi - lo > n, stop).otherwise(F.floor((n - (hi - lo)) / 2).cast("int"))
    return df.filter((F.col(axis) >= lo) & (F.col(axis) < hi)).withColumn(axis, F.col(axis) - lo + pad)


def last_per_epoch(history: DataFrame, metric: str | None = None) -> DataFrame:
    """Latest value of each metric in each epoch."""
    h = history if metric is None else history.filter(F.col("key") == metric)
    return h.groupBy("key", "epoch").agg(F.max_by("value", "step").alias("value"))


def trend_gates(history: DataFrame, slack: float = 1.05) -> DataFrame:
    """Per metric over epochs: strictly falling, never above ``slack`` times the previous, always zero."""
    e = last_per_epoch(history)
    w = Window.partitionBy("key").orderBy("epoch")
    p = e.withColumn("_p", F.lag("value").over(w))
    every = lambda c: F.coalesce(F.bool_and(F.when(F.col("_p").isNotNull(), c)), F.lit(False))
    return p.groupBy("key").agg(every(F.col("value") < F.col("_p")).alias("decreasing"), every(F.col("value") <= F.col("_p") * slack).alias("within"),
                                (F.max("value") == 0).alias("all_zero"))


def csr_offsets(df: DataFrame, key: Sequence[str], limit=None) -> DataFrame:
    """Row count and start offset of every key in key order."""
    from foldscope.operators.ordering import prefix_sum

    c = df.groupBy(*key).agg(F.count("*").alias("n"))
    return prefix_sum(c, [F.col(k) for k in key], {"_e": F.col("n")}, (), limit).select(*key, "n", (F.col("_e") - F.col("n")).alias("start"))


def progress_rate(df: DataFrame, ts="ts", ok: Column | None = None, expected: int | None = None, seconds: int = 600, limit=None) -> DataFrame:
    """Per second: done so far, done in the trailing window, rate per minute and ETA in seconds.

    Events collapse to one row per second and range-split sums replace a global window:
    the trailing count is the running count minus the one just before the window.
    """
    from foldscope.operators.ordering import prefix_sum

    good = ok if ok is not None else F.lit(True)
    s = df.groupBy(F.unix_timestamp(F.col(ts).cast("timestamp")).alias("sec")).agg(F.sum(good.cast("long")).alias("done"), F.sum((~good).cast("long")).alias("failed"))
    marks = s.select("sec", "done", "failed", F.lit(1).alias("own")).unionByName(
        s.select((F.col("sec") + seconds).alias("sec"), F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("failed"), F.lit(0).alias("own"), F.col("done").alias("gone")),
        allowMissingColumns=True)
    m = marks.groupBy("sec").agg(F.sum("done").alias("done"), F.sum("failed").alias("failed"), F.max("own").alias("own"), F.sum(F.coalesce("gone", F.lit(0))).alias("gone"))
    # A second t - seconds still counts at t, so what leaves is subtracted from the next mark on.
    c = prefix_sum(m, [F.col("sec")], {"total_done": F.col("done"), "total_failed": F.col("failed"), "_gone": F.col("gone")}, (), limit)
    recent = F.col("total_done") - (F.col("_gone") - F.col("gone"))
    rate = recent * 60.0 / seconds
    eta = F.when(rate > 0, (F.lit(expected) - F.col("total_done")) / (rate / 60.0)) if expected is not None else F.lit(None).cast("double")
    return c.filter("own = 1").select("sec", "total_done", "total_failed", recent.alias("recent"), rate.alias("rate_per_min"), eta.alias("eta_sec"))


def pad_sequences(df: DataFrame, key: Sequence[str], order: str, value: str, length: int | None = None) -> DataFrame:
    """Long form of padded sequences: position, value (0 when padded), validity.

    All are padded to the longest, or to ``length``; a sequence longer than that is an error, nothing is cut.
    Positions come from a ranked order; nothing is gathered into arrays.
    """
    r = ranked(df, [F.col(order)], key, "_i")
    longest = r.agg(F.coalesce(F.max("_i"), F.lit(0).cast("long")).alias("_l")).scalar()
    if length is None:
        to = longest
    else:
        too_long = F.raise_error(F.concat(F.lit("a sequence has rows beyond length "), F.lit(length))).cast("long")
        to = F.when(longest > length, too_long).otherwise(F.lit(length).cast("long"))
    grid = df.select(*key).distinct().select(*key, F.explode(F.sequence(F.lit(1).cast("long"), to)).alias("_i"))
    j = join_groups(grid, r.select(*key, "_i", F.col(value).alias("_v")), [*key, "_i"], "left")
    return j.select(*key, (F.col("_i") - 1).alias("pos"), F.coalesce("_v", F.lit(0)).alias(value), F.col("_v").isNotNull().alias("valid"))


# --- sets ---------------------------------------------------------------------------------------


def union_relaxed(*dfs: DataFrame) -> DataFrame:
    """Union by name; missing columns become NULL and differing types widen."""
    rank = ["boolean", "int", "bigint", "float", "double", "string"]
    types: dict[str, str] = {}
    for df in dfs:
        for c, t in df.dtypes:
            a, b = types.get(c, t), t
            types[c] = a if a == b else (max(a, b, key=rank.index) if a in rank and b in rank else "string")
    out = None
    for df in dfs:
        cast = df.select(*[F.col(c).cast(types[c]).alias(c) for c in df.columns])
        out = cast if out is None else out.unionByName(cast, allowMissingColumns=True)
    return out


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids present on both sides; must be empty for disjoint cohorts."""
    return a.select(key).intersect(b.select(key))


def except_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).subtract(b.select(key))
