"""Evaluation metrics over scored units, grouped and weighted.

All rank metrics share one table: rows collapsed to (group, score) with positive
and negative weights, plus running totals from the highest score down.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldscope import runtime
from foldscope.functions import hashing
from foldscope.operators.ordering import prefix_sum, quantiles, ranked

FP_POINTS = (0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0)


def _w(weight: str | None) -> Column:
    return F.col(weight) if weight else F.lit(1)


def score_curve(
    df: DataFrame, score="score", label="label", by: Sequence[str] = (), weight: str | None = None,
    order: Sequence[str] = (), limit: int | None = None,
) -> DataFrame:
    """Rows (by, score[, order]) with ``pos``, ``neg`` and inclusive ``tp``, ``fp`` from the top score down.

    ``order`` keeps tied scores apart and sorts them ascending by those columns.
    """
    w = _w(weight)
    pos, neg = w * F.col(label), w * (1 - F.col(label))
    keys = [*by, F.col(score).alias("score"), *order]
    cells = df.filter(F.col(score).isNotNull()).groupBy(*keys).agg(
        F.sum(pos).cast("long").alias("pos"), F.sum(neg).cast("long").alias("neg")
    )
    return prefix_sum(
        cells, [F.col("score").desc(), *[F.col(c) for c in order]], {"tp": F.col("pos"), "fp": F.col("neg")}, by, limit
    )


def with_totals(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add the group totals ``p`` and ``n`` to a score curve."""
    tot = curve.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    if by:
        return runtime.join_groups(curve, tot, by)
    row = tot.first()
    return curve.withColumns({c: F.lit(row[c]).cast("long") for c in ("p", "n")})


def _auroc_expr() -> Column:
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    below = F.sum(F.col("pos").cast("double") * (F.col("fp") - F.col("neg") / 2.0))
    return F.when((p > 0) & (n > 0), 1.0 - below / (p * n))


def _ap_expr() -> Column:
    p = F.sum("pos").cast("double")
    return F.when(p > 0, F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))) / p)


def auroc(df, score="score", label="label", by=(), weight=None, limit=None) -> DataFrame:
    """Area under the ROC curve, ties worth one half; NULL when one class is missing."""
    return score_curve(df, score, label, by, weight, (), limit).groupBy(*by).agg(_auroc_expr().alias("auroc"))


def average_precision(df, score="score", label="label", by=(), weight=None, limit=None) -> DataFrame:
    """Step-wise average precision; NULL when there is no positive."""
    return score_curve(df, score, label, by, weight, (), limit).groupBy(*by).agg(_ap_expr().alias("ap"))


def rank_metrics(df, score="score", label="label", by=(), weight=None, limit=None) -> DataFrame:
    """AUROC and AP from one pass over one curve."""
    curve = score_curve(df, score, label, by, weight, (), limit)
    return curve.groupBy(*by).agg(_auroc_expr().alias("auroc"), _ap_expr().alias("ap"))


def slice_metrics(df, score="score", label="label", by=("epoch",), limit=None) -> DataFrame:
    """AUROC and AP per group, 0 where a class is missing."""
    curve = score_curve(df, score, label, by, None, (), limit)
    both = (F.sum("pos") > 0) & (F.sum("neg") > 0)
    zero = F.lit(0.0)
    return curve.groupBy(*by).agg(
        F.when(both, _auroc_expr()).otherwise(zero).alias("auroc"), F.when(both, _ap_expr()).otherwise(zero).alias("ap")
    )


def roc_curve(df, score="score", label="label", by=(), weight=None, limit=None) -> DataFrame:
    """One ROC point per distinct score: threshold, fpr, tpr."""
    c = with_totals(score_curve(df, score, label, by, weight, (), limit), by)
    return c.select(
        *by, F.col("score").alias("threshold"),
        F.when(F.col("n") > 0, F.col("fp") / F.col("n")).alias("fpr"),
        F.when(F.col("p") > 0, F.col("tp") / F.col("p")).alias("tpr"), "tp", "fp", "p", "n",
    )


def mean_roc(df, fold="fold", score="score", label="label", grid: int = 100, limit=None) -> DataFrame:
    """Vertical average of per-fold ROC curves on ``grid + 1`` points with a min/max band.

    Curve points are first reduced to one pair per (fold, grid cell), so the
    interpolation windows hold at most ``grid + 1`` rows.
    """
    pts = roc_curve(df, score, label, [fold], None, limit).filter((F.col("n") > 0) & (F.col("p") > 0))
    k = F.ceil(F.col("fp") * grid / F.col("n")).cast("int")
    cells = pts.groupBy(fold, k.alias("k")).agg(
        F.max(F.struct("fpr", "tpr")).alias("hi"), F.min(F.struct("fpr", "tpr")).alias("lo")
    )
    base = pts.select(fold).distinct().select(fold, F.explode(F.sequence(F.lit(0), F.lit(grid))).alias("k"))
    w = Window.partitionBy(fold).orderBy("k")
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    after = w.rowsBetween(1, Window.unboundedFollowing)
    j = base.join(cells, [fold, "k"], "left").select(
        fold, "k", F.last("hi", True).over(up_to).alias("a"), F.first("lo", True).over(after).alias("b")
    )
    x = F.col("k") / F.lit(float(grid))
    ax, ay = F.coalesce(F.col("a.fpr"), F.lit(0.0)), F.coalesce(F.col("a.tpr"), F.lit(0.0))
    y = F.when(F.col("b").isNull() | (ax >= x), ay).otherwise(
        ay + (F.col("b.tpr") - ay) * (x - ax) / (F.col("b.fpr") - ax)
    )
    y = F.when((F.col("k") == 0), F.lit(0.0)).otherwise(y)
    return j.withColumn("y", y).groupBy("k").agg(
        F.avg("y").alias("mean_tpr"), F.min("y").alias("min_tpr"), F.max("y").alias("max_tpr")
    ).withColumn("fpr", F.col("k") / F.lit(float(grid)))


def coarse_metrics(df, score="score", label="label", by: Sequence[str] = (), limit=None) -> DataFrame:
    """Monitoring pair per group: AUROC, and sensitivity at the (1 - 2/n_neg) quantile of the negatives.

    Both are NULL when a class is missing.
    """
    c = with_totals(score_curve(df, score, label, by, None, (), limit), by)
    n = F.col("n")
    pos = F.greatest(F.lit(0.0), 1.0 - 2.0 / F.greatest(n, F.lit(1))) * (n - 1)
    at = lambda r: F.max(F.when((n - F.col("fp") <= r) & (r < n - F.col("fp") + F.col("neg")), F.col("score")))
    frac = F.max(pos - F.floor(pos))
    lo, hi = at(F.floor(pos)), at(F.ceil(pos))
    t = c.groupBy(*by).agg(_auroc_expr().alias("auroc"), (lo + (hi - lo) * frac).alias("thr"))
    if by:
        j = runtime.join_groups(c, t, by)
    else:
        j = c.withColumns({"auroc": t.select("auroc").scalar(), "thr": t.select("thr").scalar()})
    sens = F.try_divide(F.coalesce(F.max(F.when(F.col("score") >= F.col("thr"), F.col("tp"))), F.lit(0)), F.max("p"))
    return j.groupBy(*by).agg(F.max("auroc").alias("auroc"), F.when(F.max("auroc").isNotNull(), sens).alias("sens_at_2fp"))


def froc_curve(
    df, unit="unit", score="score", label="label", by=(), weight=None, group_ties: bool = False, limit=None
) -> DataFrame:
    """Unit-level FROC: false positives per unit against sensitivity, highest score first.

    Tied scores are swept unit by unit in ascending id unless ``group_ties``.
    """
    order = [] if group_ties else [unit]
    c = with_totals(score_curve(df, score, label, by, weight, order, limit), by)
    return c.select(
        *by, "score", *order, (F.col("fp") / (F.col("p") + F.col("n"))).alias("fp_per_unit"),
        F.when(F.col("p") > 0, F.col("tp") / F.col("p")).alias("sens"),
    )


def sens_at_fp(curve: DataFrame, targets: Sequence[float] = FP_POINTS, by: Sequence[str] = ()) -> DataFrame:
    """Sensitivity of the last curve point with fp <= target, 0 if there is none, long form.

    Both curve axes only grow, so the last point is a plain maximum: no sort, no target join.
    """
    has = F.max("sens").isNotNull()
    aggs = [
        F.when(has, F.coalesce(F.max(F.when(F.col("fp_per_unit") <= float(t), F.col("sens"))), F.lit(0.0))).alias(f"s{i}")
        for i, t in enumerate(targets)
    ]
    wide = curve.groupBy(*by).agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("fp_target"), F.col(f"s{i}").alias("sens")) for i, t in enumerate(targets)])
    return wide.select(*by, F.explode(pairs).alias("r")).select(*by, "r.fp_target", "r.sens")


def cpm(curve: DataFrame, targets: Sequence[float] = FP_POINTS, by: Sequence[str] = ()) -> DataFrame:
    """Mean sensitivity over the standard false-positive targets."""
    return sens_at_fp(curve, targets, by).groupBy(*by).agg(F.avg("sens").alias("cpm"))


def brier(df, score="score", label="label", by=(), weight=None) -> DataFrame:
    w = _w(weight)
    return df.groupBy(*by).agg((F.sum(w * F.pow(F.col(score) - F.col(label), 2)) / F.sum(w)).alias("brier"))


def bin_edges(bins: int) -> list[float]:
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def score_bin(score: Column, bins: int = 10) -> Column:
    """Equal-width bin of [0, 1] compared against double edges, last bin closed; NULL outside."""
    n = F.lit(0)
    for e in bin_edges(bins)[1:-1]:
        n = n + (score >= F.lit(e)).cast("int")
    return F.when((score >= 0.0) & (score <= 1.0), n)


def _bin_table(df, score, label, by, weight, bins):
    w = _w(weight)
    return df.groupBy(*by, score_bin(F.col(score), bins).alias("bin")).agg(
        F.sum(w).alias("cnt"), F.sum(w * F.col(score)).alias("ssum"), F.sum(w * F.col(label)).alias("ysum")
    )


def ece(df, score="score", label="label", by=(), weight=None, bins: int = 10) -> DataFrame:
    """Expected calibration error; scores outside [0, 1] count in the total but in no bin."""
    t = _bin_table(df, score, label, by, weight, bins)
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("ssum") - F.col("ysum"))).otherwise(0.0)
    return t.groupBy(*by).agg((F.sum(gap) / F.sum("cnt")).alias("ece"))


def reliability(df, score="score", label="label", by=(), bins: int = 10) -> DataFrame:
    """Reliability curve with one row per bin, empty bins included."""
    edges = bin_edges(bins)
    t = _bin_table(df, score, label, by, None, bins).filter(F.col("bin").isNotNull())
    rows = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(edges[i]).alias("lo"), F.lit(edges[i + 1]).alias("hi")) for i in range(bins)])
    groups = t.select(*by).distinct() if by else df.sparkSession.range(1).select()
    base = groups.select(*by, F.explode(rows).alias("b")).select(*by, "b.*")
    return runtime.join_groups(base, t, [*by, "bin"], "left").select(
        *by, "bin", "lo", "hi", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"),
        (F.col("ssum") / F.col("cnt")).alias("mean_score"), (F.col("ysum") / F.col("cnt")).alias("frac_pos"),
    )


# --- resampling ---------------------------------------------------------------------------------


def resample(
    df: DataFrame, key: Sequence[str], n_boot: int, seed: int = 42, by: Sequence[str] = (), method: str = "exact",
    limit: int | None = None,
) -> DataFrame:
    """Bootstrap replicates as rows: input columns plus replicate ``_b`` and multiplicity ``_wt``.

    ``exact`` draws as many units as the group holds, with replacement, from keyed
    hashes; draws are counted per (replicate, index) before they meet the units.
    ``poisson`` gives each unit a Poisson(1) weight and needs no join.
    """
    reps = F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("_b")
    if method == "poisson":
        out = df.select("*", reps).withColumn("_wt", hashing.poisson1(seed, F.col("_b"), *[F.col(k) for k in key]))
        return out.filter("_wt > 0")
    idx = ranked(df, [F.col(k) for k in key], by, "_i", limit).withColumn("_i", F.col("_i") - 1)
    if by:
        sizes = idx.groupBy(*by).agg(F.count("*").alias("_n"))
        slots = runtime.join_groups(idx.select(*by, "_i"), sizes, by)
    else:
        slots = idx.select("_i").withColumn("_n", idx.agg(F.count("*").alias("_n")).scalar())
    # Spread the units first: the replicates multiply them right after.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    draws = slots.repartition(parts, "_i").select(*by, "_n", "_i", reps).select(*by, "_b", hashing.index(F.col("_n"), seed, F.col("_b"), F.col("_i")).alias("_i"))
    counts = draws.groupBy(*by, "_b", "_i").agg(F.count("*").alias("_wt"))
    return runtime.join_groups(runtime.spread(counts), idx, [*by, "_i"]).drop("_i")


def _replicate_stat(rep: DataFrame, stat: str, score, label, keys, limit) -> DataFrame:
    if stat == "auroc":
        return auroc(rep, score, label, keys, "_wt", limit).withColumnRenamed("auroc", "_s")
    if stat == "ap":
        return average_precision(rep, score, label, keys, "_wt", limit).withColumnRenamed("ap", "_s")
    if stat == "brier":
        return brier(rep, score, label, keys, "_wt").withColumnRenamed("brier", "_s")
    if stat == "ece":
        return ece(rep, score, label, keys, "_wt").withColumnRenamed("ece", "_s")
    if stat == "mean":
        return rep.groupBy(*keys).agg((F.sum(F.col(score) * F.col("_wt")) / F.sum("_wt")).alias("_s"))
    raise ValueError(f"unknown statistic {stat}")


def bootstrap_ci(
    df, key, stat: str, score="score", label="label", n_boot=1000, seed=42, alpha=0.05, by=(), method="exact", limit=None
) -> DataFrame:
    """Percentile interval of a unit statistic; replicates without a value are dropped."""
    rep = resample(df, key, n_boot, seed, by, method, limit)
    s = _replicate_stat(rep, stat, score, label, [*by, "_b"], limit)
    return quantiles(s, "_s", {"ci_lower": alpha / 2, "ci_upper": 1 - alpha / 2}, by, limit=limit).withColumnRenamed("n", "n_reps")


def _rate_helper(n_boot: int, blocks: int, seed: int, span: int):
    """Arrow helper: one block of replicates and the words of hits that it meets become hits drawn by group and replicate.

    All groups draw from the same hashes, so a draw is hashed once, for the largest group.
    """
    import numpy as np
    import pyarrow as pa

    def run(key, t):
        block, part = (k.as_py() for k in key)
        group, at, bits, n = (t[c].to_numpy() for c in ("_group", "_at", "_bits", "_n"))
        least, held, out = part * span, [], []
        for g in np.unique(group):
            mine = group == g
            words = np.zeros(int(at[mine].max()) - least + 1, np.uint64)
            words[at[mine] - least] = bits[mine].view(np.uint64)
            held.append((int(g), int(n[mine][0]), words))
        for b in range(block * n_boot // blocks, (block + 1) * n_boot // blocks):
            hits = [0] * len(held)
            for first, drawn in hashing.hash60_range(f"{seed}:{b}", max(most for _, most, _ in held)):
                for k, (_, most, words) in enumerate(held):
                    i = drawn[: max(most - first, 0)] % np.uint64(most)
                    w = (i >> np.uint64(6)).astype(np.int64) - least
                    if least or most > 64 * span:
                        here = (w >= 0) & (w < len(words))
                        i, w = i[here], w[here]
                    hits[k] += int((words[w] >> (i & np.uint64(63)) & np.uint64(1)).sum())
            out += [(g, b, most, h) for (g, most, _), h in zip(held, hits)]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out)], names=["_group", "_b", "_n", "_hits"])

    return run


def bootstrap_rate(df: DataFrame, key: Sequence[str], hit: str, group: str, n_boot=1000, seed=42, alpha=0.05, limit=None) -> DataFrame:
    """``bootstrap_ci`` of the mean of ``hit`` (0 or 1) by ``group``, a whole number: the same draws, but none of them travels.

    Hits go as bits, 64 units a row, to every block of replicates; draws are made and looked up there. A task holds the bits
    of at most 64 x ``RATE_WORDS`` units of each group; where a group has more, every such part makes the draws for itself.
    """
    idx = ranked(df.select(*key, group, hit), [F.col(k) for k in key], [group], "_i", limit).select(F.col(group).cast("long").alias("_group"), (F.col("_i") - 1).alias("_i"), F.col(hit).alias("_hit"))
    bits = F.expr("bit_or(CASE WHEN _hit = 1 THEN shiftleft(1L, CAST(_i & 63 AS INT)) ELSE 0L END)").alias("_bits")
    words = runtime.cut(idx.groupBy("_group", F.shiftright("_i", 6).alias("_at")).agg(bits, F.count("*").alias("_c")))
    sizes = runtime.cut(words.groupBy("_group").agg(F.sum("_c").alias("_n")))
    most = sizes.agg(F.max("_n")).first()[0] or 1
    # Enough blocks for every task slot, none with more draws than a task makes in some 15 s, but a replicate is never cut.
    slots, span = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), runtime.RATE_WORDS
    blocks = -(-n_boot // max(1, min(n_boot // slots, 2**26 // most)))
    met = words.join(sizes, "_group").select(
        "_group", "_at", "_bits", "_n", F.floor(F.col("_at") / span).alias("_part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    met = met.repartitionByRange(blocks * -(-most // (64 * span)), "_block", "_part").groupBy("_block", "_part")
    drawn = met.applyInArrow(_rate_helper(n_boot, blocks, seed, span), "_group long, _b long, _n long, _hits long")
    s = drawn.groupBy("_group", "_b").agg((F.sum("_hits") / F.max("_n")).alias("_s")).withColumnRenamed("_group", group)
    return quantiles(s, "_s", {"ci_lower": alpha / 2, "ci_upper": 1 - alpha / 2}, [group], limit=limit).withColumnRenamed("n", "n_reps")


def bootstrap_froc(
    df, unit="unit", score="score", label="label", targets=FP_POINTS, n_boot=1000, seed=42, alpha=0.05, by=(), method="exact", limit=None
) -> DataFrame:
    """Intervals of the sensitivity at every target from one set of replicates."""
    rep = resample(df, [unit], n_boot, seed, by, method, limit)
    c = froc_curve(rep, unit, score, label, [*by, "_b"], "_wt", False, limit)
    s = sens_at_fp(c, targets, [*by, "_b"])
    return quantiles(s, "sens", {"ci_lower": alpha / 2, "ci_upper": 1 - alpha / 2}, [*by, "fp_target"], limit=limit).withColumnRenamed("n", "n_reps")


def bootstrap_udf(df, key, stat_fn, columns: Sequence[str], n_boot=1000, seed=42, alpha=0.05) -> DataFrame:
    """Interval of a user statistic ``stat_fn(*arrays) -> float`` over resampled rows.

    Replicates are independent groups handled by a grouped-aggregate pandas UDF;
    use it only for samples that fit one task, as the built-in statistics need no Python.
    """
    import pandas as pd

    def run(*cols: pd.Series) -> float:
        *vals, wt = cols
        return float(stat_fn(*[v.to_numpy().repeat(wt.to_numpy()) for v in vals]))

    run.__annotations__ = {**{"cols": pd.Series}, "return": float}
    agg = F.pandas_udf(run, "double")
    rep = resample(df, key, n_boot, seed)
    s = rep.groupBy("_b").agg(agg(*[F.col(c) for c in columns], F.col("_wt")).alias("_s"))
    return quantiles(s, "_s", {"ci_lower": alpha / 2, "ci_upper": 1 - alpha / 2}).withColumnRenamed("n", "n_reps")


# --- reports ------------------------------------------------------------------------------------


def unit_metrics(
    raw: DataFrame, thr: DataFrame | None = None, unit="unit", by=(), targets=FP_POINTS, n_boot: int = 0, seed=42, limit=None
) -> DataFrame:
    """Full battery as tidy rows: AUROC, AP, Brier, ECE on ``raw``; sensitivity at targets on ``thr``."""
    thr = raw if thr is None else thr
    point = rank_metrics(raw, by=by, limit=limit)
    rows = point.select(*by, F.explode(F.array(
        F.struct(F.lit("auroc").alias("metric"), F.col("auroc").alias("value")),
        F.struct(F.lit("ap").alias("metric"), F.col("ap").alias("value")))).alias("r")).select(*by, "r.*")
    rows = rows.unionByName(brier(raw, by=by).select(*by, F.lit("brier").alias("metric"), F.col("brier").alias("value")))
    rows = rows.unionByName(ece(raw, by=by).select(*by, F.lit("ece").alias("metric"), F.col("ece").alias("value")))
    name = F.concat(F.lit("sens@"), F.format_string("%.3f", F.col("fp_target")), F.lit("fp"))
    s = sens_at_fp(froc_curve(thr, unit, by=by, limit=limit), targets, by)
    rows = rows.unionByName(s.select(*by, name.alias("metric"), F.col("sens").alias("value")))
    if n_boot:
        rep = runtime.cut(resample(raw, [unit], n_boot, seed, by, limit=limit))
        keys, named = [*by, "_b"], lambda m, c: F.struct(F.lit(m).alias("metric"), F.col(c).alias("_s"))
        stats = runtime.join_groups(rank_metrics(rep, by=keys, weight="_wt", limit=limit), brier(rep, by=keys, weight="_wt"), keys)
        stats = runtime.join_groups(stats, ece(rep, by=keys, weight="_wt"), keys)
        stats = stats.select(*by, F.explode(F.array(*[named(m, m) for m in ("auroc", "ap", "brier", "ece")])).alias("r")).select(*by, "r.*")
        if thr is raw:
            c = froc_curve(rep, unit, "score", "label", keys, "_wt", False, limit)
        else:
            c = froc_curve(resample(thr, [unit], n_boot, seed, by, limit=limit), unit, "score", "label", keys, "_wt", False, limit)
        sens = sens_at_fp(c, targets, keys).select(*by, name.alias("metric"), F.col("sens").alias("_s"))
        ci = quantiles(stats.unionByName(sens), "_s", {"ci_lower": 0.025, "ci_upper": 0.975}, [*by, "metric"], limit=limit).drop("n")
        rows = runtime.join_groups(rows, ci, [*by, "metric"], "left")
    else:
        rows = rows.withColumns({"ci_lower": F.lit(None).cast("double"), "ci_upper": F.lit(None).cast("double")})
    return rows


def expand_strata(df: DataFrame, kinds: Mapping[str, Column]) -> DataFrame:
    """One copy of each row per stratum kind, so every kind is aggregated in a single grouping."""
    pairs = F.array(*[
        F.struct(F.lit(k).alias("stratum_kind"), F.coalesce(c.cast("string"), F.lit("unknown")).alias("stratum_value"))
        for k, c in kinds.items()
    ])
    return df.select("*", F.explode(pairs).alias("_s")).select(*df.columns, "_s.*")


def report_scopes(units: DataFrame, kinds: Mapping[str, Column], fold="fold", holdout: Column | None = None) -> DataFrame:
    """Copies of each unit for every report scope that it counts in, so that one grouping serves them all.

    Cross-validation units go to ``per_fold``, ``cv_pooled`` and a ``stratum`` of each kind, the others to
    ``holdout``. Holdout units are those without a fold unless a condition is given.
    """
    out = F.col(fold).isNull() if holdout is None else holdout
    none = F.lit(None).cast("string")

    def row(scope, f=F.lit(None).cast("int"), kind=none, value=none):
        return F.struct(F.lit(scope).alias("scope"), f.cast("int").alias("_fold"), kind.alias("stratum_kind"), value.alias("stratum_value"))

    inside = [row("per_fold", F.col(fold)), row("cv_pooled")]
    inside += [row("stratum", kind=F.lit(k), value=F.coalesce(c.cast("string"), F.lit("unknown"))) for k, c in kinds.items()]
    scopes = F.when(out, F.array(row("holdout"))).otherwise(F.array(*inside))
    rest = [c for c in units.columns if c != fold]
    return units.select(*rest, F.explode(scopes).alias("_s")).select(*rest, "_s.scope", F.col("_s._fold").alias(fold), "_s.stratum_kind", "_s.stratum_value")


SCOPE = ("scope", "fold", "stratum_kind", "stratum_value")


def scoped_report(units: DataFrame, kinds: Mapping[str, Column], run_id: str, entrypoint: str, rescored: bool, code_version: str, lesions: str | None = None, **kw) -> DataFrame:
    """Report rows of all scopes with the units and lesions that each of them counts."""
    scoped = runtime.cut(report_scopes(units, kinds))
    n = F.sum(lesions) if lesions else F.lit(None)
    counts = scoped.groupBy(*SCOPE).agg(F.count("*").alias("n_patients"), n.cast("long").alias("n_lesions"))
    m = runtime.join_groups(unit_metrics(scoped, by=list(SCOPE), **kw), counts, SCOPE)
    return report_rows(m, F.col("scope"), run_id, entrypoint, rescored, code_version)


def stratified_metrics(df, kinds: Mapping[str, Column], **kw) -> DataFrame:
    """The metric battery for every stratum of every kind."""
    return unit_metrics(expand_strata(df, kinds), by=["stratum_kind", "stratum_value"], **kw)


def size_threshold_scores(boxes: DataFrame, units: DataFrame, by=("unit",), split_mm=10.0, mm=0.82) -> DataFrame:
    """Best score of the large and of the small boxes of every unit: all a threshold grid needs."""
    dim = F.greatest(F.col("x2") - F.col("x1"), F.col("z2") - F.col("z1")) * mm
    top = boxes.groupBy(*by).agg(
        F.max(F.when(dim >= split_mm, F.col("score").cast("float"))).alias("large_max"),
        F.max(F.when(dim < split_mm, F.col("score").cast("float"))).alias("small_max"),
    )
    return runtime.join_groups(units, top, by, "left")


def _best(lt: Column, st: Column) -> Column:
    """Best surviving score of a unit, which follows from its two per-class maxima; 0 if none survives."""
    return F.greatest(F.when(F.col("large_max") >= lt, F.col("large_max")), F.when(F.col("small_max") >= st, F.col("small_max")), F.lit(0.0).cast("float"))


# Grid cells whose counts stand side by side in one histogram.
CELLS_AT_ONCE = 32


def grid_search(
    unit_tops: DataFrame, larges: Sequence[float], smalls: Sequence[float], fp: float = 2.0, unit="unit", by=(), limit=None
) -> DataFrame:
    """Sensitivity at ``fp`` for each threshold pair.

    One histogram of distinct scores serves the whole grid: whatever the cell, a unit scores its large maximum, its
    small one or 0, so a row per score counts the units of each class that have it in each cell. It is summed from the
    top once. Units are looked at again only where the target falls inside a tie, and there in ascending order.
    """
    by = list(by)
    cells = [(i * len(smalls) + j, float(lt), float(st)) for i, lt in enumerate(larges) for j, st in enumerate(smalls)]
    f32 = lambda v: F.lit(v).cast("float")
    zero = f32(0.0)
    scores = F.array_distinct(F.array(F.greatest("large_max", zero), F.greatest("small_max", zero), zero))
    rows = unit_tops.select(*by, unit, "label", "large_max", "small_max", F.explode(scores).alias("score"))
    totals = unit_tops.groupBy(*by).agg(F.sum("label").alias("p"), F.count("label").alias("_all"))
    parts = [_grid_part(rows, totals, cells[k : k + CELLS_AT_ONCE], fp, by, limit) for k in range(0, len(cells), CELLS_AT_ONCE)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = runtime.cut(found)
    keys = [*by, "cell"]
    ties = found.filter("tie_pos > 0").select(*keys, "large_thr", "small_thr", F.col("tie").alias("score"), "before", "_all")
    inside = runtime.join_groups(rows, ties, [*by, "score"]).filter(_best(F.col("large_thr").cast("float"), F.col("small_thr").cast("float")) == F.col("score"))
    inside = inside.groupBy(*keys, unit, "before", "_all").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    swept = prefix_sum(inside, [F.col(unit)], {"tp": F.col("pos"), "fp": F.col("neg")}, keys, limit)
    more = swept.groupBy(*keys).agg(F.max(F.when((F.col("before") + F.col("fp")) / F.col("_all") <= float(fp), F.col("tp"))).alias("more"))
    sens = (F.col("tp") + F.coalesce("more", F.lit(0))) / F.col("p")
    return runtime.join_groups(found, more, keys, "left").select(*keys, "large_thr", "small_thr", F.when(F.col("p") > 0, sens).alias("sens"))


def _grid_part(rows: DataFrame, totals: DataFrame, cells: Sequence[tuple[int, float, float]], fp: float, by: list[str], limit) -> DataFrame:
    """For each cell the true positives ``tp`` above the score ``tie`` at which the target is passed, the false
    positives ``before`` it and the positives ``tie_pos`` at it."""
    f32 = lambda v: F.lit(v).cast("float")
    counts = []
    for c, lt, st in cells:
        here = _best(f32(lt), f32(st)) == F.col("score")
        counts += [F.sum(F.when(here, F.col("label")).otherwise(0)).alias(f"_p{c}"), F.sum(F.when(here, 1 - F.col("label")).otherwise(0)).alias(f"_n{c}")]
    hist = rows.groupBy(*by, "score").agg(*counts)
    cum = prefix_sum(hist, [F.col("score").desc()], {f"{k}{c}": F.col(f"_{k}{c}") for c, _, _ in cells for k in "pn"}, by, limit)
    cum = runtime.join_groups(cum, totals, by) if by else cum.withColumns({c: totals.select(c).scalar() for c in ("p", "_all")})
    aggs = []
    for c, _, _ in cells:
        within = F.col(f"n{c}") / F.col("_all") <= float(fp)
        tie = F.struct(F.col("score").alias("tie"), (F.col(f"n{c}") - F.col(f"_n{c}")).alias("before"), F.col(f"_p{c}").alias("tie_pos"))
        aggs += [F.coalesce(F.max(F.when(within, F.col(f"p{c}"))), F.lit(0)).alias(f"t{c}"), F.max(F.when(~within, tie)).alias(f"b{c}")]
    wide = cum.groupBy(*by).agg(F.max("p").alias("p"), F.max("_all").alias("_all"), *aggs)
    each = F.array(*[
        F.struct(F.lit(c).alias("cell"), F.lit(lt).alias("large_thr"), F.lit(st).alias("small_thr"), F.col(f"t{c}").alias("tp"), F.col(f"b{c}").alias("b"))
        for c, lt, st in cells
    ])
    return wide.select(*by, "p", "_all", F.explode(each).alias("g")).select(*by, "p", "_all", "g.cell", "g.large_thr", "g.small_thr", "g.tp", "g.b.*")


def best_cell(grid: DataFrame, by=()) -> DataFrame:
    """Grid cell with the highest sensitivity, the first in grid order on ties."""
    best = F.min(F.struct((-F.col("sens")).alias("k"), "cell", "large_thr", "small_thr", "sens")).alias("m")
    return grid.filter("sens is not null").groupBy(*by).agg(best).select(*by, "m.large_thr", "m.small_thr", "m.sens")


def leave_one_out(df: DataFrame, folds: int, fold="fold", name="tune_fold") -> DataFrame:
    """Copies of every row for the folds it does not belong to (its own when there is only one fold)."""
    if folds == 1:
        return df.withColumn(name, F.col(fold))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col(fold))
    return df.select("*", F.explode(others).alias(name))


def tune_cross_fold(unit_tops, folds, larges, smalls, fp=2.0, unit="unit", limit=None) -> DataFrame:
    """Thresholds for each fold chosen on all the other folds, in one job."""
    pool = leave_one_out(unit_tops, folds)
    return best_cell(grid_search(pool, larges, smalls, fp, unit, ["tune_fold"], limit), ["tune_fold"])


def ensemble_threshold(tuned: DataFrame, large_default=0.05, small_default=0.30) -> DataFrame:
    """Mean threshold over folds, with defaults when no fold was tuned."""
    return tuned.agg(
        F.coalesce(F.avg("large_thr"), F.lit(large_default)).alias("large_thr"),
        F.coalesce(F.avg("small_thr"), F.lit(small_default)).alias("small_thr"),
    )


def size_bin_labels(edges: Sequence[float]) -> list[str]:
    """A label for each bin: ranges, with open ends at 0 and infinity."""
    out = [f"{a:g}-{b:g}mm3" for a, b in zip(edges, edges[1:])]
    ends = {0: (edges[0] == 0, f"<={edges[1]:g}mm3"), len(out) - 1: (edges[-1] == float("inf"), f">{edges[-2]:g}mm3")}
    return [ends[i][1] if i in ends and ends[i][0] else label for i, label in enumerate(out)]


VOLUME_EDGES = (0.0, 200.0, 1000.0, 5000.0, float("inf"))


def size_bin(volume: Column, edges: Sequence[float] = VOLUME_EDGES) -> Column:
    """Index of the half-open volume bin, last one closed; NULL outside all bins."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        inside = (volume >= edges[i]) & ((volume <= edges[i + 1]) if i == len(edges) - 2 else (volume < edges[i + 1]))
        out = F.when(inside, F.lit(i)).otherwise(out)
    return out


def size_strata(calls: DataFrame, edges=VOLUME_EDGES, n_boot=1000, seed=42, key=("call_id",), limit=None, size_of: str = "call") -> DataFrame:
    """Lesion sensitivity per volume bin with bootstrap interval; every bin gets a row.

    A TP counts in the bin of its call's volume (``size_of="call"``) or of the lesion it found (``"lesion"``); an FN
    always in that of its lesion.
    """
    size = F.col({"call": "volume_mm3", "lesion": "lesion_volume_mm3"}[size_of])
    hits = calls.filter(F.col("call_type").isin("tp", "fn") & size.isNotNull()).select(
        *key, size_bin(size, edges).alias("bin"), (F.col("call_type") == "tp").cast("double").alias("hit")
    ).filter("bin is not null")
    hits = runtime.cut(hits)
    stat = hits.groupBy("bin").agg(F.avg("hit").alias("value"), F.count("*").alias("n_lesions"), F.sum("hit").cast("long").alias("n_tp"))
    ci = bootstrap_rate(hits, key, "hit", "bin", n_boot, seed, 0.05, limit)
    rows = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(label).alias("stratum_value")) for i, label in enumerate(size_bin_labels(edges))])
    base = calls.sparkSession.range(1).select(F.explode(rows).alias("b")).select("b.*")
    return base.join(stat, "bin", "left").join(ci, "bin", "left").select(
        F.lit("lesion_volume_bin").alias("stratum_kind"), "stratum_value", "value", "ci_lower", "ci_upper",
        F.coalesce("n_lesions", F.lit(0)).cast("long").alias("n_lesions"), F.coalesce("n_tp", F.lit(0)).cast("long").alias("n_tp"),
        (F.coalesce("n_lesions", F.lit(0)) - F.coalesce("n_tp", F.lit(0))).cast("long").alias("n_fn"),
    )


REPORT_COLUMNS = (
    "run_id", "entrypoint", "metric", "scope", "fold", "stratum_kind", "stratum_value", "rescored",
    "value", "ci_lower_95", "ci_upper_95", "n_patients", "n_lesions", "code_version",
)


def report_rows(metrics: DataFrame, scope: str | Column, run_id: str, entrypoint: str, rescored: bool, code_version: str, **extra) -> DataFrame:
    """Metric rows in the fixed report layout; absent columns become NULL."""
    have = {
        "run_id": F.lit(run_id), "entrypoint": F.lit(entrypoint), "scope": scope if isinstance(scope, Column) else F.lit(scope), "rescored": F.lit(rescored),
        "code_version": F.lit(code_version), **extra,
    }
    types = {"fold": "int", "value": "double", "ci_lower_95": "double", "ci_upper_95": "double", "n_patients": "int", "n_lesions": "int"}
    src = metrics.withColumnsRenamed({"ci_lower": "ci_lower_95", "ci_upper": "ci_upper_95"})
    cols = []
    for c in REPORT_COLUMNS:
        e = have.get(c, F.col(c) if c in src.columns else F.lit(None))
        cols.append(e.cast(types.get(c, "boolean" if c == "rescored" else "string")).alias(c))
    return src.select(*cols)


def filter_report(report: DataFrame, **eq) -> DataFrame:
    """Rows whose columns equal the given values; None selects NULL."""
    for c, v in eq.items():
        report = report.filter(F.col(c).eqNullSafe(F.lit(v)))
    return report


def headline(report: DataFrame, order="run_id") -> DataFrame:
    """Newest value per metric, NaN and infinities as NULL."""
    best = F.max_by(F.struct("value", "ci_lower_95", "ci_upper_95"), F.col(order)).alias("m")
    fin = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    out = report.groupBy("metric").agg(best)
    return out.select("metric", *[fin(F.col(f"m.{c}")).alias(c) for c in ("value", "ci_lower_95", "ci_upper_95")])


def compare_methods(report: DataFrame, metric="metric", flag="rescored", value="value") -> DataFrame:
    """Mean and sample std per method and the winner (ties go to the plain method)."""
    on, off = F.when(F.col(flag), F.col(value)), F.when(~F.col(flag), F.col(value))
    return report.groupBy(metric).agg(
        F.avg(off).alias("mean_a"), F.stddev_samp(off).alias("std_a"), F.avg(on).alias("mean_b"), F.stddev_samp(on).alias("std_b")
    ).withColumn("winner", F.when(F.col("mean_b") > F.col("mean_a"), "b").otherwise("a"))


def log_loss(df, score="score", label="label", by=(), eps: float = 1e-7) -> DataFrame:
    p = F.greatest(F.least(F.col(score), F.lit(1 - eps)), F.lit(eps))
    y = F.col(label)
    return df.groupBy(*by).agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def dice(df, pred="pred", target="target", by=(), smooth: float = 1.0) -> DataFrame:
    """Soft Dice overlap of two masks given as rows."""
    inter = F.sum(F.col(pred) * F.col(target))
    return df.groupBy(*by).agg(((2.0 * inter + smooth) / (F.sum(pred) + F.sum(target) + smooth)).alias("dice"))


# --- two-sample comparison ----------------------------------------------------------------------


def ks_2samp(df, value="score", group="label", by=(), limit=None) -> DataFrame:
    """Largest gap between the two empirical distribution functions."""
    c = with_totals(score_curve(df, value, group, by, None, (), limit), by)
    gap = F.abs(F.col("tp") / F.col("p") - F.col("fp") / F.col("n"))
    return c.filter("p > 0 and n > 0").groupBy(*by).agg(F.max(gap).alias("ks"))


def cliffs_delta(df, value="score", group="label", by=(), limit=None) -> DataFrame:
    """P(group 1 > group 0) - P(group 1 < group 0), which is 2*AUROC - 1."""
    return auroc(df, value, group, by, None, limit).select(*by, (2.0 * F.col("auroc") - 1.0).alias("cliffs_delta"))


def chi2(df, a: str, b: str) -> DataFrame:
    """Pearson chi-square, degrees of freedom and Cramer's V of two categorical columns."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("o"))
    ra = cells.groupBy(a).agg(F.sum("o").alias("ra"))
    rb = cells.groupBy(b).agg(F.sum("o").alias("rb"))
    n = F.sum("o").cast("double")
    j = cells.join(ra, a).join(rb, b)
    # chi2 = n * (sum o^2/(ra*rb) - 1): empty cells need no row.
    out = j.agg(
        (n * (F.sum(F.col("o") * F.col("o") / (F.col("ra").cast("double") * F.col("rb"))) - 1.0)).alias("chi2"),
        F.countDistinct(a).alias("na"), F.countDistinct(b).alias("nb"), n.alias("n"),
    )
    k = F.least("na", "nb") - 1
    return out.select("chi2", ((F.col("na") - 1) * (F.col("nb") - 1)).cast("long").alias("dof"),
                      F.when(k > 0, F.sqrt(F.col("chi2") / (F.col("n") * k))).alias("cramers_v"))


def single_class_strata(df, stratum: str, label="label") -> DataFrame:
    """Strata in which only one class occurs."""
    return df.groupBy(stratum).agg(F.min(label).alias("lo"), F.max(label).alias("hi"), F.count("*").alias("n")).filter("lo = hi").select(
        stratum, F.col("lo").alias("only_label"), "n")


def profile(df, col: str, by=(), probs=(0.005, 0.05, 0.25, 0.5, 0.75, 0.95, 0.995), limit=None) -> DataFrame:
    """Exact percentiles with mean and sample std per group."""
    q = quantiles(df, col, {f"p{p * 100:g}".replace(".", "_"): p for p in probs}, by, limit=limit)
    m = df.groupBy(*by).agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"))
    if by:
        return runtime.join_groups(q, m, by)
    return q.withColumns({"mean": m.select("mean").scalar(), "std": m.select("std").scalar()})


def size_category(mm: Column) -> Column:
    return F.when(mm < 5, "small").when(mm <= 30, "medium").when(mm > 30, "large")


def fold_balance(df, fold="fold", label="label") -> DataFrame:
    return df.groupBy(fold).agg(
        F.count("*").alias("n"), F.sum(label).cast("long").alias("n_pos"), (F.count("*") - F.sum(label)).cast("long").alias("n_neg"),
        F.avg(label).alias("pos_frac"),
    )
