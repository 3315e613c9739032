"""Deterministic sampling and synthesis: pools, capped samples, scheduled draws, donor placement."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldscope import runtime
from foldscope.functions import hashing
from foldscope.functions.scalar import decay
from foldscope.operators import components as C
from foldscope.operators.ordering import prefix_sum, ranked, top_by


def hard_pool(slices: DataFrame, index: DataFrame, thr=0.05, k=1000, score="score", key=("unit", "slice_y")) -> DataFrame:
    """The k best-scoring known slices at or above the threshold, in rank order."""
    top = slices.filter(F.col(score) >= thr).join(index.select(*key), list(key), "left_semi")
    return top.orderBy(F.col(score).desc(), *key).limit(k)


def ema_topk(df: DataFrame, k: int, score="ema", key=("unit", "slice_y")) -> DataFrame:
    return df.orderBy(F.col(score).desc(), *key).limit(k)


def first_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per group; the rank filter is pushed below the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def select_pilot(members: DataFrame, quotas: Mapping[str, int], category="category", unit="unit") -> DataFrame:
    """Distinct units from the first ``quota`` ids of every category."""
    return cluster_sample(members, quotas, category, [F.col(unit)]).select(unit).distinct()


def cluster_sample(df: DataFrame, quotas: Mapping[str, int], cluster="cluster", order: Sequence[Column] = ()) -> DataFrame:
    """First rows of every cluster up to its own quota; clusters without one are dropped."""
    q = F.lit(None).cast("int")
    for name, n in quotas.items():
        q = F.when(F.col(cluster) == name, F.lit(n)).otherwise(q)
    w = Window.partitionBy(cluster).orderBy(*order)
    r = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(quotas.values()))
    return r.filter(F.col("_r") <= q).drop("_r")


def smoke_subset(df: DataFrame, n_pos=2, n_neg=3, unit="unit", label="label", fold="fold", size="size") -> DataFrame:
    """Smallest units with a positive in fold 0, one elsewhere, and a negative in fold 0; errors when short."""
    small = lambda c, n: df.filter(c).orderBy(size, unit).limit(n)
    pos, neg, zero = F.col(label) == 1, F.col(label) == 0, F.col(fold) == 0
    picked = small(pos & zero, 1).unionByName(small(pos & ~zero, n_pos - 1))
    picked = picked.unionByName(small(neg & zero, 1)).unionByName(small(neg & ~zero, n_neg - 1))
    total = picked.agg(F.count("*").alias("n")).scalar()
    return picked.filter(F.when(total < n_pos + n_neg, F.raise_error(F.lit("not enough candidates for fold coverage")).cast("boolean")).otherwise(True))


def sample_events(df: DataFrame, n: int, seed=42, kind="kind", path="path") -> DataFrame:
    """At most n distinct paths per event type, chosen by keyed hash."""
    d = df.groupBy(kind, path).agg(F.count("*").alias("copies")).withColumn("_h", hashing.hash32(seed, F.col(path)))
    return first_n(d, [kind], [F.col("_h"), F.col(path)], n).drop("_h")


def cap_per_type(df: DataFrame, n=200, kind="kind", order: Sequence[str] = ("step",)) -> DataFrame:
    return first_n(df, [kind], [F.col(c) for c in order], n)


# The documented setting names of a sampler configuration and their defaults.
SAMPLER = {
    "pos_frac_start": 0.50, "pos_frac_end": 0.25, "decay_epochs": 30, "neg_in_pos_vol_share": 0.50,
    "hard_pool_substitution_rate": 0.30, "hard_pool_start_epoch": 5,
}


def scheduled_sample(index: DataFrame, epoch: int, seed=42, cfg: Mapping | None = None, hard: DataFrame | None = None, n: int | None = None, limit=None) -> DataFrame:
    """Draws with replacement under the epoch's class mix: ``(draw, pool, unit, slice_y)``.

    ``n`` draws, or one per index row when None. Each draw picks a pool from a keyed
    uniform and a position in it from another; positions meet the pools by equality,
    which spreads evenly because they are uniform.
    """
    cfg = {**SAMPLER, **(cfg or {})}
    use_hard = hard is not None and epoch >= cfg["hard_pool_start_epoch"]
    names = F.when(F.col("kind") == "pos_slice", "pos").when(F.col("kind") == "neg_slice_pos_vol", "nipv").otherwise("ninv")
    pools = index.select("unit", "slice_y", names.alias("pool"))
    if use_hard:
        pools = pools.unionByName(hard.select("unit", "slice_y", F.lit("hard").alias("pool")))
    pools = runtime.cut(ranked(pools, [F.col("unit"), F.col("slice_y")], ["pool"], "_i", limit).withColumn("_i", F.col("_i") - 1))
    sizes = {r["pool"]: r["n"] for r in pools.groupBy("pool").agg(F.count("*").alias("n")).collect()}
    size = {p: sizes.get(p, 0) for p in ("pos", "nipv", "ninv", "hard")}
    draws = index.sparkSession.range(n if n is not None else sum(size[p] for p in ("pos", "nipv", "ninv"))).withColumnRenamed("id", "draw")

    eseed = hashing.fold_seed(seed, epoch)
    p_pos = decay(F.lit(float(epoch)), cfg["pos_frac_start"], cfg["pos_frac_end"], cfg["decay_epochs"]) if size["pos"] else F.lit(0.0)
    draws = draws.withColumns({"_r": hashing.uniform(eseed, F.col("draw"), "class"), "_h": hashing.uniform(eseed, F.col("draw"), "hard"), "_p": p_pos})
    in_pos = F.col("_r") < F.col("_p")
    want_nipv = (F.col("_r") - F.col("_p")) / F.greatest(1.0 - F.col("_p"), F.lit(1e-12)) < cfg["neg_in_pos_vol_share"]
    has = lambda p: F.lit(size[p] > 0)
    ninv = F.when(F.lit(use_hard and size["hard"] > 0) & (F.col("_h") < cfg["hard_pool_substitution_rate"]), "hard").otherwise("ninv")
    fallback = F.when(has("nipv"), "nipv").when(has("ninv"), "ninv").when(has("hard"), "hard").otherwise("pos")
    pool = F.when(in_pos & has("pos"), "pos").when(want_nipv & has("nipv"), "nipv").when(~want_nipv & has("ninv"), ninv).otherwise(fallback)
    draws = draws.withColumn("pool", pool)
    n_pool = F.lit(1).cast("long")
    for p, k in size.items():
        n_pool = F.when(F.col("pool") == p, F.lit(max(k, 1)).cast("long")).otherwise(n_pool)
    draws = draws.withColumn("_i", hashing.index(n_pool, eseed, F.col("draw"), "pick"))
    return draws.join(pools, ["pool", "_i"]).select("draw", "pool", "unit", "slice_y")


def n_pastes(p: float, sigma: float, n_max: int, *key) -> Column:
    """0 with probability 1-p, else min(floor(|N(0, sigma)|) + 1, max)."""
    n = F.least(F.floor(F.abs(hashing.normal(*key, "n")) * F.lit(sigma)) + 1, F.lit(n_max))
    return F.when(hashing.uniform(*key, "any") >= p, F.lit(0)).otherwise(n).cast("int")


def place_donors(
    targets: DataFrame, band: DataFrame, donors: DataFrame, occupied: DataFrame, frame: Sequence[int], attempts=50, max_clip=0.25, seed=42, limit=None
) -> DataFrame:
    """Accepted pastes ``(unit, paste, attempt, donor, sx, sy, sz)``.

    ``targets`` has (unit, n_pastes); ``band`` candidate sites, as cells or ``columns``; ``donors`` voxels
    (donor, dx, dy, dz) about the centroid, donor ids dense from 0; ``occupied`` taken cells.
    Units run side by side. An attempt fails on too much clipping or a collision. Clipping and the taken cells don't depend
    on other pastes, so the attempts of all pastes meet them at once; only what is left goes by paste number, against
    the cells of the earlier ones. Of the donors only those that are drawn travel.
    """
    band = C.columns(band)
    site = runtime.cut(prefix_sum(band, [F.col("x"), F.col("y"), F.col("_tz")], {"_end": F.bit_count("bits").cast("long")}, ["unit"], limit))
    n_site = site.groupBy("unit").agg(F.max("_end").alias("_n"))
    # The sites of a column are numbers [_from, _end), at most 2^TZ of them, so they lie in one block of that length or two.
    site = site.withColumn("_from", F.col("_end") - F.bit_count("bits"))
    block = F.array_distinct(F.array(F.shiftright("_from", C.TZ), F.shiftright(F.col("_end") - 1, C.TZ)))
    site = site.withColumn("_b", F.explode(block))
    n_donor = donors.agg(F.max("donor") + 1).first()[0]
    draws = targets.filter("n_pastes > 0").join(n_site, "unit").select("unit", "_n", F.explode(F.sequence(F.lit(1), F.col("n_pastes"))).alias("paste"))
    draws = runtime.cut(draws.withColumn("donor", hashing.index(F.lit(n_donor), seed, F.col("unit"), F.col("paste"), "donor")))
    dv = runtime.cut(donors.select("donor", "dx", "dy", "dz").join(draws.select("donor").distinct(), "donor", "left_semi").distinct())
    total = dv.groupBy("donor").agg(F.count("*").alias("_total"))
    n_cells = draws.join(total, "donor").agg(F.sum("_total")).first()[0] or 0
    rounds = draws.agg(F.max("paste")).first()[0] or 0
    nx, ny, nz = frame
    inside = (F.col("x") >= 0) & (F.col("x") < nx) & (F.col("y") >= 0) & (F.col("y") < ny) & (F.col("z") >= 0) & (F.col("z") < nz)
    cell, found = ["unit", "x", "y", "z"], ["unit", "attempt", "paste", "donor", "sx", "sy", "sz"]
    moved = lambda df, *cols: df.join(dv, "donor").select(
        "unit", *cols, (F.col("sx") + F.col("dx")).alias("x"), (F.col("sy") + F.col("dy")).alias("y"), (F.col("sz") + F.col("dz")).alias("z")).filter(inside)

    def valid(t: DataFrame, lo: int, hi: int) -> DataFrame:
        """Attempts in [lo, hi] of the pastes ``t`` that are clipped little enough and leave the taken cells alone."""
        a = t.withColumn("attempt", F.explode(F.sequence(F.lit(lo), F.lit(hi))))
        a = a.withColumn("_i", hashing.index(F.col("_n"), seed, F.col("unit"), F.col("paste"), F.col("attempt"), "site"))
        a = runtime.spread(a.withColumn("_b", F.shiftright("_i", C.TZ))).join(site, ["unit", "_b"]).filter("_i >= _from and _i < _end")
        z = F.shiftleft("_tz", C.TZ) + F.get(F.expr(C.BITS), (F.col("_i") - F.col("_from")).cast("int"))
        a = runtime.cut(a.select("unit", "attempt", "paste", "donor", F.col("x").alias("sx"), F.col("y").alias("sy"), z.alias("sz")))
        hit = occupied.select(*cell).distinct().withColumn("_t", F.lit(1))
        ok = runtime.spread(moved(a, *found[1:])).join(hit, cell, "left").groupBy(*found).agg(F.count("*").alias("_keep"), F.sum("_t").alias("_hit"))
        ok = ok.filter("_hit is null").join(total, "donor").filter(1.0 - F.col("_keep") / F.col("_total") <= max_clip)
        return runtime.cut(ok.select(*found))

    def first(a: DataFrame) -> DataFrame:
        """First of a unit's valid attempts that leaves its earlier pastes alone."""
        for cells in pasted:
            hit = moved(a, "attempt").join(cells, cell, "left_semi").select("unit", "attempt").distinct()
            a = a.join(hit, ["unit", "attempt"], "left_anti")
        return top_by(a, ["unit"], [F.col("attempt")]).select(*found)

    # Most pastes succeed early. All attempts go at once only where their cells are fewer than a second look at the taken ones.
    early = attempts if n_cells * attempts <= occupied.count() else min(4, attempts)
    ok, placed, pasted = valid(draws, 1, early), [], []
    for j in range(1, rounds + 1):
        win = runtime.cut(first(ok.filter(F.col("paste") == j)))
        rest = draws.filter(F.col("paste") == j).join(win.select("unit"), "unit", "left_anti")
        if early < attempts and not rest.isEmpty():
            win = runtime.cut(win.unionByName(first(valid(rest, early + 1, attempts))))
        placed.append(win)
        if j < rounds:
            pasted = [runtime.cut(functools.reduce(DataFrame.unionByName, [*pasted, moved(win)]))]
    return functools.reduce(DataFrame.unionByName, placed, ok.limit(0))


def blend_donor(v: Column, target: Column, dist: Column, mu_d: Column, sd_d: Column, mu_t: Column, sd_t: Column) -> Column:
    """Donor value moved to the target's statistics and blended with weight clip(1 - dist, 0, 1)."""
    moved = (v - mu_d) / F.when(sd_d > 1e-8, sd_d).otherwise(1.0) * sd_t + mu_t
    a = F.least(F.greatest(1.0 - dist, F.lit(0.0)), F.lit(1.0))
    return a * moved + (1.0 - a) * target


def paste_donors(volume: DataFrame, cells: DataFrame, key=("unit",), value: str = "v") -> DataFrame:
    """``volume`` (key, x, y, z, value) with one donor pasted for each key, and ``part`` (NULL where nothing changed).

    ``cells`` are the donor's cells at their target places: key, x, y, z, ``donor`` (its value), ``part`` (``inside`` or
    ``shell``) and ``dist``, the millimetres from a shell cell to the nearest inside cell. The target's statistics are
    those of the volume under the shell, without a shell the mean under the inside and a deviation of 1. Inside cells
    take the donor's value moved to them; a NULL donor value takes the target's mean. Shell cells blend the target's
    mean into what is there with weight clip(1 - dist, 0, 1). Deviations of at most 1e-6 count as 1 on the donor's side
    and as 1e-6 on the target's. Of cells at one place an inside one wins, then the nearest. A NULL key is a key.
    """
    key = list(key)
    at = [*key, "x", "y", "z"]
    first = F.min(F.struct((F.col("part") != "inside").alias("o"), "dist", "donor", "part")).alias("_m")
    cells = runtime.cut(cells.groupBy(*at).agg(first).select(*at, "_m.donor", "_m.part", "_m.dist"))
    under = runtime.join_groups(cells, volume.select(*at, F.col(value).alias("_v")), at)
    shell, inside = F.col("part") == "shell", F.col("part") == "inside"
    there = under.groupBy(*key).agg(
        F.count(F.when(shell, F.col("_v"))).alias("_n"), F.avg(F.when(shell, F.col("_v"))).alias("_m"), F.stddev_pop(F.when(shell, F.col("_v"))).alias("_s"),
        F.avg(F.when(inside, F.col("_v"))).alias("_i"), F.avg(F.when(inside, F.col("donor"))).alias("_dm"), F.stddev_pop(F.when(inside, F.col("donor"))).alias("_ds"))
    mean = F.coalesce("_m", "_i", F.lit(0.0))
    dev = F.greatest(F.when(F.col("_n") > 1, F.col("_s")).otherwise(1.0), F.lit(1e-6))
    own = F.when(F.col("_ds") > 1e-6, F.col("_ds")).otherwise(1.0)
    moved = F.coalesce((F.col("donor") - F.col("_dm")) / own, F.lit(0.0)) * dev + mean
    weight = F.when(inside, F.lit(1.0)).otherwise(F.least(F.greatest(1.0 - F.col("dist"), F.lit(0.0)), F.lit(1.0)))
    new = runtime.join_groups(cells, there, key).select(*at, F.when(inside, moved).otherwise(mean).alias("_new"), weight.alias("_w"), "part")
    out = runtime.join_groups(volume, new.filter("_w > 0"), at, "left")
    blended = F.when(F.col("_w") == 1, F.col("_new")).when(F.col("_w") > 0, F.col("_w") * F.col("_new") + (1 - F.col("_w")) * F.col(value)).otherwise(F.col(value))
    return out.select(*[blended.alias(c) if c == value else F.col(c) for c in volume.columns], "part")


def latest_run(df: DataFrame, by="experiment", order="mtime", run="run") -> DataFrame:
    return df.groupBy(by).agg(F.max_by(run, F.struct(order, run)).alias(run))
