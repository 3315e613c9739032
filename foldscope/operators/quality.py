"""Rule sets that emit one row per violation, checklists and ledgers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldscope.operators.cohort import duplicates, trend_gates


def violations(df: DataFrame, rules: Mapping[str, Column], key: Sequence[str]) -> DataFrame:
    """One row per (key, rule) whose condition holds; NULL conditions do not count."""
    arr = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return df.select(*key, F.explode(arr).alias("rule"))


def manifest_invariants(df: DataFrame, folds: int, key="unit", cohort="cohort", fold="fold", label="label", mask="mask") -> DataFrame:
    """Unique id, holdout iff fold is NULL, positive iff a mask exists, fold in range."""
    rules = {
        "holdout_fold": (F.col(cohort) == "holdout") != F.col(fold).isNull(),
        "positive_mask": (F.col(label) == 1) != F.col(mask).isNotNull(),
        "fold_range": (F.col(fold) < 0) | (F.col(fold) >= folds),
    }
    dup = duplicates(df, [key]).select(key, F.lit("duplicate_id").alias("rule"))
    return violations(df, rules, [key]).unionByName(dup)


def box_invariants(boxes: DataFrame, units: DataFrame, width: int, height: int, key="unit") -> DataFrame:
    """Bounds, slice range, reference to a positive unit, and the component count of the unit."""
    u = units.select(key, "n_slices", "label", "n_components")
    j = boxes.join(u, key, "left")
    rules = {
        "bounds": (F.col("x1") < 0) | (F.col("z1") < 0) | (F.col("x2") > width) | (F.col("z2") > height) | (F.col("x2") <= F.col("x1")) | (F.col("z2") <= F.col("z1")),
        "slice_range": (F.col("slice_y") < 0) | (F.col("slice_y") >= F.col("n_slices")),
        "not_positive": F.coalesce(F.col("label"), F.lit(0)) != 1,
    }
    per_row = violations(j, rules, [key])
    have = boxes.groupBy(key).agg(F.count_distinct("cc_id").alias("_k"))
    miss = u.filter("label = 1").join(have, key, "left").filter(F.coalesce("_k", F.lit(0)) != F.col("n_components"))
    return per_row.unionByName(miss.select(key, F.lit("component_count").alias("rule")))


def cross_agreement(a: DataFrame, b: DataFrame, key="unit", fold="fold", version="code_version") -> DataFrame:
    """Checklist: folds agree per unit, each table has one code version."""
    j = a.select(key, F.col(fold).alias("_a")).join(b.select(key, F.col(fold).alias("_b")), key)
    folds = j.agg(F.sum((~F.col("_a").eqNullSafe(F.col("_b"))).cast("long")).alias("n")).select(F.lit("fold_agrees").alias("check"), (F.col("n") == 0).alias("ok"), F.col("n").alias("detail"))
    one = lambda df, name: df.agg(F.count_distinct(version).alias("n")).select(F.lit(name).alias("check"), (F.col("n") == 1).alias("ok"), F.col("n").alias("detail"))
    return folds.unionByName(one(a, "one_version_a")).unionByName(one(b, "one_version_b"))


def all_true(df: DataFrame, flags: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Per key whether every flag of every row holds; a NULL flag fails."""
    cond = F.lit(True)
    for f in flags:
        cond = cond & F.coalesce(F.col(f), F.lit(False))
    return df.groupBy(*key).agg(F.bool_and(cond).alias("aligned"), F.sum((~cond).cast("long")).alias("n_bad"))


def contrast_tiers(df: DataFrame, z="contrast_z", hard=0.0, warn=0.121) -> DataFrame:
    """Hard failures below ``hard``, warnings below ``warn``."""
    tier = F.when(F.col(z) < hard, "fail").when(F.col(z) < warn, "warn").otherwise("ok")
    return df.withColumn("severity", F.when(F.col(z).isNull(), "missing").otherwise(tier))


def run_gates(history: DataFrame, falling: Sequence[str], bounded: Sequence[str], zero: Sequence[str]) -> DataFrame:
    """PASS/FAIL checklist on metric trends; an absent metric fails except for the zero gates."""
    gates = [(k, "decreasing") for k in falling] + [(k, "within") for k in bounded] + [(k, "all_zero") for k in zero]
    want = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(g).alias("gate")) for k, g in gates])
    base = history.sparkSession.range(1).select(F.explode(want).alias("w")).select("w.*")
    t = trend_gates(history)
    ok = F.when(F.col("gate") == "decreasing", F.col("decreasing")).when(F.col("gate") == "within", F.col("within")).otherwise(F.coalesce("all_zero", F.lit(True)))
    return base.join(t, "key", "left").select("key", "gate", F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL").alias("result"))


def migration_preflight(plan: DataFrame, files: DataFrame, ids: DataFrame, expected_rows: int, src="src", dst="dst", key="id") -> DataFrame:
    """Checklist: missing sources, duplicate targets, ids without mapping, row count, bytes to move."""
    j = plan.join(files.select(F.col("path").alias(src), "length"), src, "left")
    row = lambda df, name, bad: df.select(F.lit(name).alias("check"), F.col("n").cast("long").alias("n"), bad.alias("ok"))
    zero = F.col("n") == 0
    out = row(j.filter("length is null").agg(F.count("*").alias("n")), "missing_source", zero)
    out = out.unionByName(row(duplicates(plan, [dst]).select("n").agg(F.count("*").alias("n")), "duplicate_target", zero))
    out = out.unionByName(row(plan.select(key).distinct().join(ids.select(key), key, "left_anti").agg(F.count("*").alias("n")), "unmapped_id", zero))
    out = out.unionByName(row(plan.agg(F.count("*").alias("n")), "row_count", F.col("n") == expected_rows))
    return out.unionByName(row(j.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")), "total_bytes", F.lit(True)))


def qc_summary(df: DataFrame, status="status") -> DataFrame:
    """Counts per status with a flag for the ones that need a look."""
    return df.groupBy(status).agg(F.count("*").alias("n")).withColumn("flagged", F.col(status) != "ok")


def update_ledger(ledger: DataFrame, failures: DataFrame, fixed: DataFrame, key="id") -> DataFrame:
    """Failure ledger after a retry: fixed ids leave, new failures join once, known ones stay."""
    stay = ledger.join(fixed.select(key), key, "left_anti")
    new = failures.select(*ledger.columns).join(fixed.select(key), key, "left_anti").join(stay.select(key), key, "left_anti")
    return stay.unionByName(new.dropDuplicates([key]))
