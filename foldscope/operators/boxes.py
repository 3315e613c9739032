"""Box operators: geometry, pair joins, suppression, fusion and matching.

Order-dependent steps work on the graph of boxes that overlap, not on slices: suppression and matching run in rounds
of joins in which every box without an undecided stronger rival is settled at once, fusion by independent groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldscope import runtime
from foldscope.operators.components import graph_labels, unique_rows
from foldscope.operators.ordering import ranked, top_by

IN_PLANE_MM = 0.82
XY = ("x1", "z1", "x2", "z2")
# A cell of a pair join is split as long as that brings its boxes nearer to this number.
CELL_MATES = 32


# --- geometry -----------------------------------------------------------------------------------


def area(b: Column | None = None) -> Column:
    g = (lambda c: b[c]) if b is not None else F.col
    return F.greatest(g("x2") - g("x1"), F.lit(0)) * F.greatest(g("z2") - g("z1"), F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two box structs, 0 when the union is empty."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0))
    h = F.greatest(F.least(a["z2"], b["z2"]) - F.greatest(a["z1"], b["z1"]), F.lit(0))
    inter = (w * h).cast("double")
    union = area(a).cast("double") + area(b).cast("double") - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def max_dim_mm(mm: float = IN_PLANE_MM) -> Column:
    return F.greatest(F.col("x2") - F.col("x1"), F.col("z2") - F.col("z1")) * F.lit(mm)


def normalize(df: DataFrame, width: float, height: float) -> DataFrame:
    """Coordinates divided by the canvas size and clipped to [0, 1]."""
    size = {"x1": width, "x2": width, "z1": height, "z2": height}
    return df.withColumns({c: F.least(F.greatest(F.col(c) / F.lit(float(s)), F.lit(0.0)), F.lit(1.0)) for c, s in size.items()})


def denormalize(df: DataFrame, width: float, height: float) -> DataFrame:
    size = {"x1": width, "x2": width, "z1": height, "z2": height}
    return df.withColumns({c: F.col(c) * F.lit(float(s)) for c, s in size.items()})


def size_threshold(boxes: DataFrame, large: float, small: float, split_mm: float = 10.0, mm: float = IN_PLANE_MM) -> DataFrame:
    """Keep boxes at or above the threshold of their size class; scores compare in single precision."""
    f = lambda v: F.lit(float(v)).cast("float")
    return boxes.filter(F.col("score").cast("float") >= F.when(max_dim_mm(mm) >= split_mm, f(large)).otherwise(f(small)))


def passes_threshold(calls: DataFrame, large: float | None, small: float | None, split_mm: float = 10.0) -> DataFrame:
    """Flag calls with the size rule on ``max_dim_mm``; NULL when no thresholds are given."""
    if large is None or small is None:
        return calls.withColumn("passes_threshold", F.lit(None).cast("boolean"))
    thr = F.when(F.col("max_dim_mm") >= split_mm, F.lit(float(large))).otherwise(F.lit(float(small)))
    return calls.withColumn("passes_threshold", F.col("score") >= thr)


def crop_boxes(boxes: DataFrame, x0: Column, z0: Column, w: Column, h: Column) -> DataFrame:
    """Move boxes into a window frame, clip, and drop the degenerate ones."""
    clip = lambda c, o, n: F.least(F.greatest(F.col(c) - o, F.lit(0)), n)
    moved = boxes.withColumns({"x1": clip("x1", x0, w), "x2": clip("x2", x0, w), "z1": clip("z1", z0, h), "z2": clip("z2", z0, h)})
    return moved.filter("x2 > x1 and z2 > z1")


def clamp_boxes(boxes: DataFrame, width: int, height: int, min_dim: float = 2) -> DataFrame:
    """Clamp boxes to the frame and drop those with a side under ``min_dim``."""
    out = crop_boxes(boxes, F.lit(0), F.lit(0), F.lit(width), F.lit(height))
    return out.filter((F.col("x2") - F.col("x1") >= min_dim) & (F.col("z2") - F.col("z1") >= min_dim))


def affine_boxes(boxes: DataFrame, theta: Column, scale: Column, tx: Column, tz: Column, cx: float, cz: float) -> DataFrame:
    """Rotate, scale and shift boxes about a centre; the result is the hull of the four corners."""
    corners = [(a, b) for a in ("x1", "x2") for b in ("z1", "z2")]
    dx, dz = (lambda a: F.col(a) - F.lit(cx)), (lambda b: F.col(b) - F.lit(cz))
    xs = [scale * (F.cos(theta) * dx(a) - F.sin(theta) * dz(b)) + cx + tx for a, b in corners]
    zs = [scale * (F.sin(theta) * dx(a) + F.cos(theta) * dz(b)) + cz + tz for a, b in corners]
    return boxes.withColumns({"x1": F.least(*xs), "x2": F.greatest(*xs), "z1": F.least(*zs), "z2": F.greatest(*zs)})


# --- pair join ----------------------------------------------------------------------------------


def _touched(rows: DataFrame, size: Column, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """A copy of each row for every grid cell of side ``size`` that its box touches, within ``first`` to ``last`` if given."""
    for c, lo, hi in (("_cx", "x1", "x2"), ("_cz", "z1", "z2")):
        a, b = F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)
        if first is not None:
            a, b = F.greatest(a, first[c]), F.least(b, last[c])
        rows = rows.select("*", F.explode(F.sequence(a, b)).alias(c))
    return rows


def _dealt(rows: DataFrame, key: list[str], tile: float, limit: int) -> DataFrame:
    """Rows of both sides (``_side`` 0 or 1) dealt to leaf cells ``_lv, _cx, _cz`` and shares ``_sh`` of a cell.

    A cell is split, 2^k by 2^k, while more than ``limit`` boxes of both sides meet in it and most of them are smaller
    than it; k follows from the count and from the boxes' sizes. Both sides follow the same table of split cells, so two
    boxes that overlap meet in the leaf that holds the lower corner of their intersection. Where boxes are too large for
    smaller cells to part them, the longer side is dealt out to shares and the shorter one copied to each. Cells
    without one side hold no pair. Cells below the limit are split too, a few times, while smaller cells save many
    comparisons for each box.
    """
    cell = [*key, "_lv", "_cx", "_cz"]
    size = lambda lv: F.lit(float(tile)) / F.pow(F.lit(2.0), lv)
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("z2") - F.col("z1")).cast("double")
    todo, done = _touched(rows.withColumn("_lv", F.lit(0)), F.lit(float(tile))), None
    few, total, finer = min(CELL_MATES, limit), rows.count(), 4
    n = (F.col("_na") + F.col("_nb")).cast("double")
    work = F.col("_na") * F.col("_nb")
    # Enough to bring the count down, but no finer than the boxes, and few copies of those that cover the cell.
    most = F.least(F.ceil(F.log2(n / few) / 2), F.floor(F.log2(size(F.col("_lv"))) - F.col("_log")), F.floor(F.log2(2 * n / F.greatest("_wide", F.lit(1))) / 2))
    over = n > limit
    while True:
        covers = F.least(F.col("x2") - F.col("x1"), F.col("z2") - F.col("z1")) >= size(F.col("_lv"))
        met = todo.groupBy(*cell).agg(
            F.sum(F.lit(1) - F.col("_side")).alias("_na"), F.sum("_side").alias("_nb"), F.sum(F.when(covers, 1).otherwise(0)).alias("_wide"), F.avg(F.log2(side)).alias("_log"))
        gains = (F.col("_wide") * 2 <= n) & (most >= 1) & (work > few * n) & F.lit(finer > 0)
        crowded = runtime.cut(met.filter((F.col("_na") > 0) & (F.col("_nb") > 0) & (over | gains)))
        saved = crowded.filter(~over).agg(F.sum(work.cast("double"))).first()[0] or 0.0
        finer = finer - 1 if saved > few * total else 0
        crowded = crowded if finer else crowded.filter(over)
        if crowded.isEmpty():
            last = todo.withColumn("_sh", F.lit(0))
            return last if done is None else done.unionByName(last)
        k = F.when(F.col("_wide") * 2 <= n, F.greatest(most, F.lit(1)).cast("int"))
        shares = F.ceil(F.greatest("_na", "_nb") / F.lit(limit)).cast("int")
        flags = crowded.select(*cell, k.alias("_k"), F.when(k.isNull(), shares).alias("_shares"), (F.col("_nb") > F.col("_na")).cast("int").alias("_long"))
        seen = runtime.join_groups(todo, flags, cell, "left")
        own = F.array(F.pmod(F.xxhash64(*XY), F.col("_shares")).cast("int"))
        share = F.when(F.col("_shares").isNull(), F.array(F.lit(0))).when(F.col("_side") == F.col("_long"), own).otherwise(F.sequence(F.lit(0), F.col("_shares") - 1))
        leaf = seen.filter("_k is null").select(*todo.columns, F.explode(share).alias("_sh"))
        done = leaf if done is None else done.unionByName(leaf)
        if flags.filter("_k is not null").isEmpty():
            return done
        parts = F.pow(F.lit(2.0), F.col("_k")).cast("long")
        kept = [F.col(c) for c in todo.columns if c not in ("_lv", "_cx", "_cz")]
        rest = seen.filter("_k is not null").select(*kept, (F.col("_lv") + F.col("_k")).alias("_lv"), *[(F.col(c) * parts).alias(f"_p{c}") for c in ("_cx", "_cz")], (parts - 1).alias("_in"))
        low = {c: F.col(f"_p{c}") for c in ("_cx", "_cz")}
        inside = _touched(rest, size(F.col("_lv")), low, {c: low[c] + F.col("_in") for c in low})
        todo = runtime.cut(inside.select(*todo.columns))


def pair_join(a: DataFrame, b: DataFrame, key: Sequence[str] = ("unit", "slice_y"), tile: float = 64.0, limit: int | None = None) -> DataFrame:
    """Pairs of overlapping boxes ``(key, a, b, iou)``; ``a`` and ``b`` are structs of the columns other than the key.

    The equi-join key is a cell of a grid that adapts to the boxes (see ``_dealt``), so neither a crowded slice nor a
    crowded spot is one task. A pair that meets in several cells is kept only in the one that holds the lower corner
    of its intersection. Boxes without area overlap nothing.
    """
    key = list(key)
    limit = runtime.CELL_BOXES if limit is None else limit
    have = [[c for c in side.columns if c not in key] for side in (a, b)]
    rows = [
        side.filter("x2 > x1 and z2 > z1").select(*key, *XY, F.struct(*cols).alias(name), F.lit(None).cast(_struct_of(other, theirs)).alias(empty), F.lit(n).alias("_side"))
        for n, (side, cols, name, other, theirs, empty) in enumerate(((a, have[0], "a", b, have[1], "b"), (b, have[1], "b", a, have[0], "a")))
    ]
    both = runtime.cut(_wide_xy(rows[0], rows[1]))
    dealt = _dealt(both, key, tile, limit)
    on = [*key, "_lv", "_cx", "_cz", "_sh"]
    j = runtime.join_groups(dealt.filter("_side = 0").select(*on, "a"), dealt.filter("_side = 1").select(*on, "b"), on)
    A, B = F.col("a"), F.col("b")
    lo_x, lo_z = F.greatest(A["x1"], B["x1"]), F.greatest(A["z1"], B["z1"])
    meet = (lo_x < F.least(A["x2"], B["x2"])) & (lo_z < F.least(A["z2"], B["z2"]))
    size = F.lit(float(tile)) / F.pow(F.lit(2.0), F.col("_lv"))
    home = (F.floor(lo_x / size) == F.col("_cx")) & (F.floor(lo_z / size) == F.col("_cz"))
    return j.filter(meet & home).select(*key, "a", "b", iou(A, B).alias("iou"))


def _struct_of(df: DataFrame, cols: Sequence[str]):
    return df.select(F.struct(*cols).alias("s")).schema["s"].dataType


def _wide_xy(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of both sides; coordinates of different types become doubles."""
    if [a.schema[c].dataType for c in XY] != [b.schema[c].dataType for c in XY]:
        a, b = (t.withColumns({c: F.col(c).cast("double") for c in XY}) for t in (a, b))
    return a.unionByName(b)


def overlap_pairs(a: DataFrame, b: DataFrame, key: Sequence[str] = ("unit", "slice_y"), tile: float = 64.0, limit: int | None = None) -> DataFrame:
    """Overlapping geometry pairs ``(key, a, b, iou, na, nb)`` of two box tables.

    Equal geometries are one row with a count, and pairs meet by ``pair_join``, so neither copies nor one crowded
    spot square the work of a task.
    """
    side = lambda df: df.groupBy(*key, *XY).agg(F.count("*").alias("n"))
    j = pair_join(side(a), side(b), key, tile, limit)
    plain = lambda s: F.struct(*[F.col(f"{s}.{c}") for c in XY])
    return j.select(*key, plain("a").alias("a"), plain("b").alias("b"), "iou", F.col("a.n").alias("na"), F.col("b.n").alias("nb"))


def iou_join(a: DataFrame, b: DataFrame, key=("unit", "slice_y"), min_iou: float = 0.0, tile: float = 64.0) -> DataFrame:
    """Overlapping geometry pairs with IoU above 0 and at least ``min_iou``."""
    return overlap_pairs(a, b, key, tile).filter(F.col("iou") >= min_iou)


def max_iou(events: DataFrame, gt: DataFrame, key=("unit", "slice_y"), tile: float = 64.0) -> DataFrame:
    """Best IoU of every event with any ground-truth box of its slice, 0 without overlap."""
    best = overlap_pairs(events, gt, key, tile).groupBy(*key, *[F.col(f"a.{c}").alias(c) for c in XY]).agg(F.max("iou").alias("max_iou"))
    return events.join(best, [*key, *XY], "left").withColumn("max_iou", F.coalesce("max_iou", F.lit(0.0)))


# --- suppression --------------------------------------------------------------------------------


def nms(boxes: DataFrame, iou_thr: float = 0.5, max_per: int | None = None, key=("unit", "slice_y"), closed: bool = False) -> DataFrame:
    """Greedy suppression, best score first; drops boxes with IoU > thr (>= when ``closed``) to a kept one.

    Ties are broken by coordinates. Of equal geometries with an area only the strongest can
    survive, so such copies collapse first; boxes without area overlap nothing and stay, each of them.
    ``max_per`` keeps the strongest survivors. A NULL key is a group.

    Boxes that overlap so far are joined once, the stronger to the weaker. In every round the boxes that no undecided
    stronger one overlaps are kept and what they overlap goes, so a slice or heap of any size is settled by many tasks.
    """
    key = list(key)
    over = (lambda v: v >= iou_thr) if closed else (lambda v: v > iou_thr)
    strongest = [F.col("score").desc(), *[F.col(c) for c in XY]]
    rows = boxes.select(*key, *XY, "score")
    best = lambda out: ranked(out, strongest, key, "_rk").filter(F.col("_rk") <= max_per).drop("_rk") if max_per else out
    if iou_thr > 1 or (iou_thr == 1 and not closed):  # no overlap is that large
        return best(rows)
    if iou_thr < 0 or (iou_thr == 0 and closed):  # every overlap is, even none
        return top_by(rows, key, [-F.col("score"), *[F.col(c) for c in XY]]).select(*key, *XY, "score")
    empty = area(F.struct(*XY)) <= 0
    uniq = rows.filter(~empty).groupBy(*key, *XY).agg(F.max("score").alias("score"))
    uniq = runtime.cut(uniq.withColumn("_v", F.monotonically_increasing_id()))
    turn = lambda s: F.struct((-F.col(f"{s}.score")).alias("k"), *[F.col(f"{s}.{c}") for c in XY])
    met = pair_join(uniq, uniq, key).filter((turn("a") < turn("b")) & over(F.col("iou")))
    gone = _beaten(runtime.cut(met.select(F.col("a._v").alias("a"), F.col("b._v").alias("b"))))
    return best(uniq.join(gone, "_v", "left_anti").select(*key, *XY, "score").unionByName(rows.filter(empty)))


def _beaten(edges: DataFrame) -> DataFrame:
    """Vertices ``_v`` that fall to a kept stronger one, where ``edges`` lead from the stronger ``a`` to the weaker ``b``."""
    gone = None
    while not edges.isEmpty():
        kept = edges.select("a").distinct().join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        fall = runtime.cut(edges.join(kept, "a", "left_semi").select(F.col("b").alias("_v")).distinct())
        gone = fall if gone is None else gone.unionByName(fall)
        left = edges.join(fall, F.col("a") == F.col("_v"), "left_anti").join(fall, F.col("b") == F.col("_v"), "left_anti")
        edges = runtime.cut(left)
    return edges.select(F.col("a").alias("_v")) if gone is None else gone


# --- weighted fusion ----------------------------------------------------------------------------


def wbf(boxes: DataFrame, width: float, height: float, iou_thr: float = 0.4, skip: float = 0.001, key=("unit", "slice_y"), n_models: int = 1) -> DataFrame:
    """Weighted box fusion per slice: score-weighted coordinates, mean score.

    A box joins the cluster whose fused box overlaps it best (IoU > thr), else opens
    one. With several models the mean is scaled by min(models, members)/models.

    Slices are cut along lines that no box crosses, and small regions are folded as they are (see ``_regions``). In the others
    boxes only matter to each other within a group: the components of the graph of boxes that overlap by more than
    the threshold. Fusion moves boxes, so the fused boxes of every group are checked against the boxes of the other
    groups that come later in the order; groups that meet become one and are fused again, until none meet. A slice of
    any size is so many groups as it has places; equal boxes are one row with a count. Within a group the order
    decides, so a group is folded by one task.
    """
    key = list(key)
    clip = lambda c, hi: F.least(F.greatest(F.col(c).cast("double"), F.lit(0.0)), F.lit(float(hi)))
    src = boxes.filter(F.col("score") >= skip).withColumns(
        {"x1": clip("x1", width), "x2": clip("x2", width), "z1": clip("z1", height), "z2": clip("z2", height), "score": F.col("score").cast("double")}
    ).filter("x2 > x1 and z2 > z1").select(*key, *XY, "score")
    fused = _fused(src, key, float(iou_thr))
    scale = F.least(F.col("n"), F.lit(n_models)) / F.lit(float(n_models))
    return fused.select(*key, *XY, (F.col("sw") / F.col("n") * scale).alias("score"), F.col("n").cast("long").alias("n_boxes"))


CLUSTER = "struct<x1:double,z1:double,x2:double,z2:double,sw:double,wx1:double,wz1:double,wx2:double,wz2:double,n:bigint>"
# Summing equal boxes moves their place by a rounding error. Places whose overlap is that close to the threshold are
# fused in one group, where the order decides.
SLACK = 1e-6
# A region of boxes is cut at no more than about so many lines at once.
LINES = 65_536
MOVED = "struct<x1:double,z1:double,x2:double,z2:double,at:struct<k:double,x1:double,z1:double,x2:double,z2:double>>"


def _fused(src: DataFrame, key: list[str], thr: float) -> DataFrame:
    """Clusters (see ``CLUSTER``) of each slice of ``src``."""
    names = [f.split(":")[0] for f in CLUSTER[7:-1].split(",")]
    if thr < 0:  # every box joins the first cluster
        sums = src.groupBy(*key).agg(F.sum("score").alias("sw"), *[F.sum(F.col("score") * F.col(c)).alias(f"w{c}") for c in XY], F.count("*").alias("n"))
        return sums.withColumns({c: F.col(f"w{c}") / F.col("sw") for c in XY}).select(*key, *names)
    if thr >= 1:  # none joins another
        return src.withColumns({"sw": F.col("score"), "n": F.lit(1).cast("long"), **{f"w{c}": F.col("score") * F.col(c) for c in XY}}).select(*key, *names)
    uniq = runtime.cut(src.groupBy(*key, *XY, "score").agg(F.count("*").alias("_m")))
    small, crowds = _regions(uniq, key)
    folded = _fold_groups(small, key, thr).select(*key, F.inline("clusters"))
    return folded if crowds is None else folded.unionByName(_fused_crowds(crowds, key, thr))


def _regions(uniq: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Boxes of slices cut along lines that no box crosses: those of small regions ``_c``, and the others.

    A region of at most ``FOLD_BOXES`` rows is small; one that no line parts may have four times as many.

    A fused box lies within the bounds of its members, so what is on one side of such a line never meets the other side.
    Larger regions are cut across x and z in turn, at the multiples of a step that follows from their boxes' sizes (and
    leaves no more than ``LINES`` lines), until neither axis has a free line left.
    """
    cols, home = uniq.columns, [*key, "_c"]
    todo, small, idle, level = uniq.withColumn("_c", F.lit(0).cast("long")), None, 0, 0
    while True:
        lo, hi = (XY[level % 2], XY[2 + level % 2])
        size = F.floor(F.avg(F.log2(F.col(hi) - F.col(lo)))) - 3
        least = F.ceil(F.log2((F.max(hi) - F.min(lo)) / LINES))
        met = runtime.cut(todo.groupBy(*home).agg(F.count("*").alias("_rows"), F.pow(F.lit(2.0), F.greatest(size, least)).alias("_step")))
        seen = runtime.join_groups(todo, met, home)
        few = seen.filter(F.col("_rows") <= runtime.FOLD_BOXES).select(*cols, "_c")
        small = few if small is None else small.unionByName(few)
        many = met.filter(F.col("_rows") > runtime.FOLD_BOXES).count()
        large = seen.filter(F.col("_rows") > runtime.FOLD_BOXES)
        if not many:
            return small, None
        if idle == 2:
            most = 4 * runtime.FOLD_BOXES
            crowds = large.filter(F.col("_rows") > most).select(*cols) if met.filter(F.col("_rows") > most).count() else None
            return small.unionByName(large.filter(F.col("_rows") <= most).select(*cols, "_c")), crowds
        large = large.withColumn("_at", F.floor(F.col(lo) / F.col("_step")))
        # A line at a multiple of the step is free if no box that begins before it ends behind it.
        lines = large.groupBy(*home, "_at").agg(F.max(F.ceil(F.col(hi) / F.col("_step")) - 1).alias("_reach"))
        w = Window.partitionBy(*home).orderBy("_at")
        before = F.max("_reach").over(w.rowsBetween(Window.unboundedPreceding, -1))
        lines = lines.withColumn("_free", F.when(before.isNull() | (before < F.col("_at")), F.col("_at")))
        strips = runtime.cut(lines.select(*home, "_at", "_free", F.max("_free").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_strip")))
        idle = 0 if strips.filter("_free is not null").count() > many else idle + 1
        # Regions that share a hash are folded as one, which changes nothing.
        todo = runtime.join_groups(large, strips.drop("_free"), [*home, "_at"]).select(*cols, F.xxhash64("_c", "_strip").alias("_c"))
        todo, level = runtime.cut(todo), level + 1


def _fused_crowds(uniq: DataFrame, key: list[str], thr: float) -> DataFrame:
    """``_fused`` for boxes that no free line parts: by groups, until none of them meet."""
    # A place is a geometry of a slice. Two that share a hash would only be fused in one group, which changes nothing.
    uniq = runtime.cut(uniq.withColumn("_v", F.xxhash64(*key, *XY)))
    places = uniq.select(*key, *XY, "_v").distinct()
    edges = pair_join(places, places, key).filter((F.col("iou") > thr - SLACK) & (F.col("a._v") < F.col("b._v")))
    edges = runtime.cut(edges.select(*key, F.col("a.x1").alias("_x"), F.col("a._v").alias("a"), F.col("b._v").alias("b")))
    labels = graph_labels(edges, [*key, "_x"]).select(F.col("v").alias("_v"), "lab")
    rows = runtime.cut(uniq.join(labels, "_v", "left").select(*key, *XY, "score", "_m", F.coalesce("lab", "_v").alias("_c"), F.col("lab").isNull().alias("_alone")))
    done, todo = _piles(rows.filter("_alone"), key), rows.filter("not _alone")
    while True:
        fresh = runtime.cut(_fold_groups(todo, key, thr))
        done = done.unionByName(fresh.select(*key, "_c", "clusters"))
        moved = fresh.select(*key, "_c", F.inline("moved"))
        near = runtime.join_groups(rows, moved.select(*key).distinct(), key, "left_semi")
        last = near.groupBy(*key, *XY, "_c").agg(F.max(_turn()).alias("at"))
        met = pair_join(moved, last, key).filter((F.col("iou") > thr) & (F.col("a._c") != F.col("b._c")) & (F.col("a.at") < F.col("b.at")))
        links = runtime.cut(met.select(F.col("a._c").alias("a"), F.col("b._c").alias("b")).distinct())
        if links.isEmpty():
            return done.select(*key, F.inline("clusters"))
        joined = runtime.cut(graph_labels(links).select(F.col("v").alias("_c"), "lab"))
        done = done.join(joined, "_c", "left_anti")
        rows = runtime.cut(rows.join(joined, "_c", "left").withColumn("_c", F.coalesce("lab", "_c")).drop("lab"))
        todo = rows.join(joined.select(F.col("lab").alias("_c")).distinct(), "_c", "left_semi")


def _piles(rows: DataFrame, key: list[str]) -> DataFrame:
    """``clusters`` of places that overlap no other: the boxes of such a place are one cluster, whatever their order."""
    one = rows.groupBy(*key, *XY, "_c").agg(F.sum(F.col("score") * F.col("_m")).alias("sw"), F.sum("_m").alias("n"))
    cluster = F.struct(*XY, "sw", *[(F.col("sw") * F.col(c)).alias(f"w{c}") for c in XY], "n").cast(CLUSTER)
    return one.select(*key, "_c", F.array(cluster).alias("clusters"))


def _turn() -> Column:
    """A box's place in the order of fusion."""
    return F.struct((-F.col("score")).alias("k"), *XY)


def _fold_groups(rows: DataFrame, key: list[str], thr: float) -> DataFrame:
    """``clusters`` of every group ``_c`` and ``moved``: each fused box of two or more places, with the turn that made it."""
    box = F.struct(_turn().alias("at"), *XY, "score", "_m")
    start = F.struct(F.array().cast(f"array<{CLUSTER}>").alias("clusters"), F.array().cast(f"array<{MOVED}>").alias("moved"))
    folded = F.aggregate("bs", start, lambda acc, b: _fuse(acc, b, thr))
    groups = rows.groupBy(*key, "_c").agg(F.array_sort(F.collect_list(box)).alias("bs"))
    return groups.select(*key, "_c", folded.alias("_f")).select(*key, "_c", "_f.clusters", "_f.moved")


def _fuse(acc: Column, b: Column, thr: float) -> Column:
    """One fold step: clusters and moved boxes after the copies of box ``b``. Once its first copy is in, the others overlap that cluster best."""
    clusters, s, one = acc["clusters"], b["score"], b["_m"] == 1

    def plus(start, v):
        """``start`` and each copy's ``v``, one after the other, as a fold box by box rounds it."""
        if start is None:
            return F.when(one, v).otherwise(F.aggregate(F.array_repeat(v, (b["_m"] - 1).cast("int")), v, lambda a, x: a + x))
        return F.when(one, start + v).otherwise(F.aggregate(F.array_repeat(v, b["_m"].cast("int")), start, lambda a, x: a + x))

    def cluster(base):
        old = lambda c: None if base is None else base[c]
        sw = plus(old("sw"), s)
        cols = {"sw": sw, **{f"w{c}": plus(old(f"w{c}"), s * b[c]) for c in XY}}
        n = base["n"] + b["_m"] if base is not None else b["_m"]
        mean = {c: cols[f"w{c}"] / sw for c in XY}
        xy = [(mean[c] if base is not None else F.when(one, b[c]).otherwise(mean[c])).alias(c) for c in XY]
        return F.struct(*xy, sw.alias("sw"), *[cols[f"w{c}"].alias(f"w{c}") for c in XY], n.alias("n")).cast(CLUSTER)

    # Best cluster: highest IoU, the earliest on ties.
    best = F.array_max(F.transform(clusters, lambda c, i: F.struct(iou(c, b).alias("v"), (-i).alias("i"))))
    grown = F.transform(clusters, lambda c, i: F.when(i == -best["i"], cluster(c)).otherwise(c))
    joins = best["v"] > thr
    new = F.when(joins, grown).otherwise(F.array_append(clusters, cluster(None)))
    now = F.get(grown, -best["i"])
    moved = F.struct(*[now[c].alias(c) for c in XY], b["at"].alias("at")).cast(MOVED)
    return F.struct(new.alias("clusters"), F.when(joins, F.array_append(acc["moved"], moved)).otherwise(acc["moved"]).alias("moved"))


def ensemble(preds: DataFrame, width, height, iou_thr=0.4, skip=0.001, key=("unit", "slice_y"), model="model", per_model=False, n_models=1) -> DataFrame:
    """Fuse the boxes of several models per slice; ``per_model`` fuses each model's slice on its own."""
    return wbf(preds, width, height, iou_thr, skip, [*key, model] if per_model else key, 1 if per_model else n_models)


# --- matching -----------------------------------------------------------------------------------


def tag_events(pred: DataFrame, gt: DataFrame, iou_thr: float = 0.3, key=("unit", "slice_y"), tile: float = 64.0) -> DataFrame:
    """Greedy one-to-one matching: predictions in descending score take their best free box.

    Rows ``(key, tag, x1..z2, score, gt)``: ``tp`` and ``fp`` for predictions, ``fn`` for the rest.
    Ties go to the smaller coordinates, among copies to the lower copy number.

    Rounds of mutual first choices over (prediction, ground-truth geometry) edges. All boxes rank predictions alike,
    so a prediction that is within capacity of its first choice cannot be displaced; copies of a geometry are one
    seat count, not many edges.
    """
    key, thr = list(key), iou_thr
    pred = pred.select(*key, *XY, F.col("score").cast("double").alias("score"))
    prio = [F.col("score").desc(), *[F.col(c) for c in XY], F.col("_c")]
    p = pred.groupBy(*key, *XY, "score").agg(F.count("*").alias("_m"))
    p = p.select("*", F.explode(F.sequence(F.lit(1), F.col("_m").cast("int"))).alias("_c"))
    p = runtime.cut(ranked(p, prio, key, "_pid"))
    seats = runtime.cut(gt.groupBy(*key, F.struct(*XY).alias("g")).agg(F.count("*").alias("_cap")))
    pairs = overlap_pairs(pred, gt, key, tile).filter(F.col("iou") >= thr)
    e = pairs.select(*key, *[F.col(f"a.{c}").alias(c) for c in XY], F.col("b").alias("g"), "iou")
    edges = runtime.cut(runtime.join_groups(e, p.select(*key, *XY, "_pid"), [*key, *XY]).select(*key, "_pid", "g", "iou"))
    done = None
    left = seats
    while not edges.isEmpty():
        first = edges.groupBy(*key, "_pid").agg(F.min(F.struct((-F.col("iou")).alias("v"), "g")).alias("f")).select(*key, "_pid", F.col("f.g").alias("g"))
        # The strongest prediction of each geometry has a seat; further ones are ranked only where there are more seats.
        seat = edges.groupBy(*key, "g").agg(F.min("_pid").alias("_pid"))
        several = left.filter("_cap > 1")
        rivals = runtime.cut(runtime.join_groups(edges.select(*key, "_pid", "g"), several.select(*key, "g"), [*key, "g"], "left_semi"))
        if not rivals.isEmpty():
            more = runtime.join_groups(ranked(rivals, [F.col("_pid")], [*key, "g"], "_rk"), several, [*key, "g"]).filter("_rk between 2 and _cap")
            seat = seat.unionByName(more.select(*key, "g", "_pid"))
        won = runtime.cut(runtime.join_groups(first, seat.select(*key, "_pid", "g"), [*key, "_pid", "g"]))
        done = won if done is None else done.unionByName(won)
        used = won.groupBy(*key, "g").agg(F.count("*").alias("_u"))
        left = runtime.cut(runtime.join_groups(left, used, [*key, "g"], "left").select(*key, "g", (F.col("_cap") - F.coalesce("_u", F.lit(0))).alias("_cap")))
        full = left.filter("_cap = 0").select(*key, "g")
        rest = runtime.join_groups(edges, won.select(*key, "_pid"), [*key, "_pid"], "left_anti")
        edges = runtime.cut(runtime.join_groups(rest, full, [*key, "g"], "left_anti"))
    none = p.select(*key, "_pid", F.lit(None).cast(seats.schema["g"].dataType).alias("g")).limit(0)
    done = none if done is None else done
    tagged = runtime.join_groups(p, done, [*key, "_pid"], "left").select(
        *key, F.when(F.col("g").isNotNull(), "tp").otherwise("fp").alias("tag"), *XY, "score", F.col("g").alias("gt"))
    free = left.filter("_cap > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("_cap").cast("int"))).alias("_c"))
    fn = free.select(*key, F.lit("fn").alias("tag"), *[F.col(f"g.{c}").alias(c) for c in XY], F.lit(None).cast("double").alias("score"), F.col("g").alias("gt"))
    return tagged.unionByName(fn)


def dynamic_k_assign(cands: DataFrame, gt=("unit", "slice_y", "gt"), cand=("unit", "slice_y", "cand"), cost="cost", iou_col="iou", topk=13) -> DataFrame:
    """Per ground truth keep the k cheapest candidates, k = max(1, floor(sum of its top IoUs)).

    A candidate chosen by several goes to the one where it costs least. The two rank
    filters are bounded by ``topk``, so Spark prunes to the first rows before the shuffle.
    """
    gt, cand = list(gt), list(cand)
    tie = [c for c in cand if c not in gt]
    by_iou = Window.partitionBy(*gt).orderBy(F.col(iou_col).desc(), *tie)
    by_cost = Window.partitionBy(*gt).orderBy(cost, *tie)
    top = cands.withColumn("_r", F.row_number().over(by_iou)).filter(F.col("_r") <= topk)
    ks = top.groupBy(*gt).agg(F.greatest(F.floor(F.round(F.sum(iou_col), 9)), F.lit(1)).alias("_k"))
    cheap = cands.withColumn("_r", F.row_number().over(by_cost)).filter(F.col("_r") <= topk).join(ks, gt).filter("_r <= _k")
    pick = F.min(F.struct(F.col(cost).alias("c"), *[F.col(g).alias(f"g_{g}") for g in gt], F.col(iou_col).alias("v")))
    one = cheap.groupBy(*cand).agg(pick.alias("m"), F.count("*").alias("_n"))
    # A contested candidate goes to its cheapest ground truth of all, chosen by it or not.
    alt = cands.join(one.filter("_n > 1").select(*cand), cand, "left_semi").groupBy(*cand).agg(pick.alias("a"))
    best = one.join(alt, cand, "left").withColumn("m", F.coalesce("a", "m"))
    own = [c for c in gt if c not in cand]
    return best.select(*cand, *[F.col(f"m.g_{g}").alias(g) for g in own], F.col("m.c").alias(cost), F.col("m.v").alias(iou_col))


# --- slice and unit aggregates ------------------------------------------------------------------


def unit_score(boxes: DataFrame, units: DataFrame, key=("unit",)) -> DataFrame:
    """Best box score per unit, 0 for a unit without boxes."""
    top = boxes.groupBy(*key).agg(F.max("score").alias("score"))
    return units.join(top, list(key), "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def topk_mean(df: DataFrame, key: Sequence[str], k: int, score="score", tie: Sequence[str] = ()) -> DataFrame:
    """Mean of the k best scores per group, over fewer rows when the group is smaller."""
    w = Window.partitionBy(*key).orderBy(F.col(score).desc(), *tie)
    top = df.filter(F.col(score).isNotNull()).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k)
    return top.groupBy(*key).agg(F.avg(score).alias("topk_mean"), F.count("*").alias("k_used"))


def slice_max(boxes: DataFrame, aux: DataFrame, key=("unit", "slice_y"), aux_col="aux_max", mode="max") -> DataFrame:
    """Slice score: the larger of best box and auxiliary maximum, or auxiliary only without boxes."""
    top = boxes.groupBy(*key).agg(F.max("score").alias("_b"))
    s = F.greatest("_b", aux_col) if mode == "max" else F.coalesce("_b", aux_col)
    return aux.join(top, list(key), "left").select(*key, s.alias("slice_max"))


def rescore(boxes: DataFrame, probs: DataFrame, key=("unit", "slice_y"), prob="prob") -> DataFrame:
    """Multiply box scores by their slice probability; slices without one pass unchanged, one with two is an error."""
    return boxes.join(unique_rows(probs.select(*key, prob), list(key), prob), list(key), "left").withColumn("score", F.col("score") * F.coalesce(prob, F.lit(1.0))).drop(prob)


def slice_index(units: DataFrame, boxes: DataFrame, lo="lo", hi="hi") -> DataFrame:
    """One row per slice of every unit with a has-box flag and its class for sampling."""
    has = boxes.select("unit", "slice_y").distinct().withColumn("_h", F.lit(True))
    rows = units.select("unit", "label", F.explode(F.sequence(F.col(lo), F.col(hi))).alias("slice_y"))
    j = rows.join(has, ["unit", "slice_y"], "left")
    kind = F.when(F.col("_h"), "pos_slice").when(F.col("label") == 1, "neg_slice_pos_vol").otherwise("neg_slice_neg_vol")
    return j.select("unit", "slice_y", F.coalesce("_h", F.lit(False)).alias("is_positive_slice"), kind.alias("kind"))
