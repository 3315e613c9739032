"""Column helpers: parsing, classification, binning, ids and schedules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldscope import runtime
from foldscope.functions import hashing


def parse_name(col: Column, id_pattern: str, ext: str) -> tuple[Column, Column]:
    """(id, suffix) of ``id[_suffix].ext``; suffix is NULL when absent, id NULL when nothing matches."""
    rx = rf"^({id_pattern})(?:_(.*))?\.{ext}$"
    g = lambda i: F.nullif(F.regexp_extract(col, rx, i), F.lit(""))
    return g(1), g(2)


def classify(col: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str = "unknown") -> Column:
    """First class whose words all occur in the upper-cased text."""
    out = F.lit(default)
    for name, words in reversed(list(rules)):
        hit = F.lit(True)
        for w in words:
            hit = hit & F.upper(col).contains(w)
        out = F.when(F.coalesce(hit, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def prefix_family(col: Column, prefixes: Sequence[str], default: str = "OTHER") -> Column:
    out = F.lit(default)
    for p in reversed(list(prefixes)):
        out = F.when(F.upper(col).startswith(p), F.lit(p)).otherwise(out)
    return out


def safe_float(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit("")).try_cast("double")


def safe_int(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit("")).try_cast("long")


def parse_shape(col: Column) -> Column:
    """``512x110x512`` or ``(512, 110, 512)`` as an int array; NULL when blank or malformed."""
    body = F.regexp_replace(col, r"[\[\]() ]", "")
    parts = F.filter(F.split(body, F.when(body.contains("x"), F.lit("x")).otherwise(F.lit(","))), lambda p: p != "")
    nums = F.transform(parts, lambda p: p.try_cast("int"))
    bad = F.exists(nums, lambda n: n.isNull()) | (F.size(nums) == 0)
    return F.when(~bad, nums)


def middle_dim(shape: Column) -> Column:
    """Second of three dimensions, else the smallest."""
    return F.when(F.size(shape) == 3, F.get(shape, F.lit(1))).otherwise(F.array_min(shape))


def split_list(col: Column, sep: str) -> Column:
    """List text as array without blanks."""
    return F.filter(F.split(col, sep), lambda s: s != "")


def nth_token(col: Column, sep: str, n: int) -> Column:
    return F.get(F.split(col, sep), F.lit(n))


def phase_of(name: Column, prefix: str, suffix: str) -> Column:
    """Middle part of a part-file name."""
    return F.regexp_replace(F.regexp_replace(name, f"^{prefix}", ""), f"{suffix}$", "")


def path_of(template: str, *cols: Column) -> Column:
    return F.format_string(template, *cols)


def mnemonic(key: Column, attempt: Column, words: Sequence[Sequence[str]]) -> Column:
    """Word triple from consecutive 8-hex chunks of sha256(key:attempt), each modulo its list."""
    h = F.sha2(F.concat_ws(":", key.cast("string"), attempt.cast("string")), 256)
    pick = lambda i, ws: F.get(F.array(*[F.lit(w) for w in ws]), F.pmod(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long"), F.lit(len(ws))).cast("int"))
    return F.concat_ws("_", *[pick(i, ws) for i, ws in enumerate(words)])


def assign_mnemonics(ids: DataFrame, words: Sequence[Sequence[str]], key="id", max_rounds: int = 100) -> DataFrame:
    """Unique names in id order: of equal proposals the smallest id keeps the name, others try again.

    Only ids still contested are hashed again; the same winner holds a name in every round
    because all names rank ids alike.
    """

    cur = runtime.cut(ids.select(key, F.lit(0).alias("attempt")))
    for _ in range(max_rounds):
        named = cur.withColumn("name", mnemonic(F.col(key), F.col("attempt"), words))
        own = named.groupBy("name").agg(F.min(key).alias("_own"))
        nxt = runtime.cut(runtime.spread(named).join(own, "name").select(key, "name", F.when(F.col(key) == F.col("_own"), F.col("attempt")).otherwise(F.col("attempt") + 1).alias("attempt"),
                                                         (F.col(key) != F.col("_own")).alias("lost")))
        if nxt.filter("lost").isEmpty():
            return nxt.select(key, "name", "attempt")
        cur = nxt.select(key, "attempt")
    raise RuntimeError("names did not become unique; use longer word lists")


def replace_once(text: Column, old: Column, new: Column) -> Column:
    """Replace the first occurrence of ``old`` only."""
    i = F.position(old, text)
    return F.when(i > 0, F.concat(F.substr(text, F.lit(1), i - 1), new, F.substr(text, i + F.length(old)))).otherwise(text)


def signed_gamma(v: Column, gamma: Column) -> Column:
    return F.signum(v) * F.pow(F.abs(v), gamma)


def jitter(v: Column, bias: Column, gamma: Column, sigma: float, *key) -> Column:
    """Bias, sign-preserving gamma and keyed Gaussian noise."""
    return signed_gamma(v + bias, gamma) + F.lit(sigma) * hashing.normal(*key)


def rotate(x: Column, z: Column, theta: Column, scale: Column, tx: Column, tz: Column, cx: float, cz: float, inverse: bool = False) -> tuple[Column, Column]:
    """In-plane affine of a point about a centre, or its inverse."""
    if not inverse:
        dx, dz = x - F.lit(cx), z - F.lit(cz)
        return scale * (F.cos(theta) * dx - F.sin(theta) * dz) + cx + tx, scale * (F.sin(theta) * dx + F.cos(theta) * dz) + cz + tz
    dx, dz = (x - F.lit(cx) - tx) / scale, (z - F.lit(cz) - tz) / scale
    return F.cos(theta) * dx + F.sin(theta) * dz + cx, F.cos(theta) * dz - F.sin(theta) * dx + cz


def thickness_bin(mm: Column) -> Column:
    return F.when(mm.isNull(), "unknown").when(mm <= 4.0, "thin").otherwise("thick")


def stratum_thickness(mm: Column, variant: Column) -> Column:
    """Bin at 2 mm, else by variant (A thin, B thick), else unknown."""
    return F.when(mm <= 2.0, "<=2mm").when(mm > 2.0, ">2mm").when(variant == "A", "<=2mm").when(variant == "B", ">2mm").otherwise("unknown")


def decay(epoch: Column, start: float, end: float, epochs: int) -> Column:
    """Linear schedule from ``start`` to ``end`` over ``epochs``, clamped."""
    done = F.greatest(F.least(epoch / F.lit(float(epochs)), F.lit(1.0)), F.lit(0.0)) if epochs > 0 else F.lit(1.0)
    return F.lit(float(start)) + F.lit(float(end - start)) * done


def json_path(col: Column, path: str, default: str | None = None) -> Column:
    v = F.get_json_object(col, path)
    return v if default is None else F.coalesce(v, F.lit(default))


def run_id(prefix: str, ts: Column, sha: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), F.date_format(ts, "yyyy_MM_dd_HHmmss"), sha)


def sorted_unique(arr: Column) -> Column:
    return F.array_sort(F.array_distinct(arr))


def build_map(df: DataFrame, by: Sequence[str], key: str, value: str) -> DataFrame:
    """Key-to-value map per group, for export of small assignment tables."""
    return df.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value)))).alias("map"))


def config_diff(a: DataFrame, b: DataFrame, skip: str = "logging") -> DataFrame:
    """Differing paths of two flattened configurations ``(path, value)``, a subtree skipped."""
    keep = lambda d: d.filter(~(F.col("path").startswith(f"{skip}.") | (F.col("path") == skip)))
    sides = [keep(d).select("path", F.col("value").alias(v), F.lit(True).alias(f"_{v}")) for d, v in ((a, "old"), (b, "new"))]
    j = sides[0].join(sides[1], "path", "full")
    differs = ~F.col("old").eqNullSafe(F.col("new")) | F.col("_old").isNull() | F.col("_new").isNull()
    return j.filter(differs).drop("_old", "_new")


def flatten_json(df: DataFrame, col: str, depth: int | None = None) -> DataFrame:
    """Leaves ``(path, value)`` of JSON objects, level by level to the deepest one.

    Empty objects and text that starts like an object but isn't one are leaves. A ``depth`` saves the look for
    deeper levels where it is known; a deeper object is then an error.
    """
    kind = "map<string,string>"
    entries = lambda text: F.transform(F.map_entries(F.from_json(text, kind)), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    # The entries of an object, none of other text: each text is parsed once a level.
    inner = F.when(F.col("value").startswith("{"), entries(F.col("value")))
    level = df.select(F.lit("").alias("path"), F.explode(entries(F.col(col))).alias("e"))
    level = level.select(F.col("e.k").alias("path"), F.col("e.v").alias("value"))
    done, levels = None, 1
    while True:
        last = depth is not None and levels == depth
        seen = level.withColumn("_in", inner)
        is_obj = F.coalesce(F.size("_in") > 0, F.lit(False))
        if last:
            deeper = F.raise_error(F.concat(F.lit("an object lies deeper than stated: "), "path")).cast("string")
            return seen.select("path", F.when(is_obj, deeper).otherwise(F.col("value")).alias("value"))
        # A leaf goes on as its own only entry.
        own = F.array(F.struct(F.lit(None).cast("string").alias("k"), F.col("value").alias("v")))
        opened = seen.select("path", F.explode(F.when(is_obj, F.col("_in")).otherwise(own)).alias("e"), is_obj.alias("_open"))
        path = F.when(F.col("_open"), F.concat("path", F.when(F.col("path") != "", ".").otherwise(""), "e.k")).otherwise(F.col("path"))
        level = opened.select(path.alias("path"), F.col("e.v").alias("value"), "_open")
        if depth is None:
            level = runtime.cut(level)
            leaf, level = level.filter(~F.col("_open")), level.filter("_open")
            done = leaf if done is None else done.unionByName(leaf)
            if level.isEmpty():
                return done.select("path", "value")
        levels += 1


def status_of(exit_code: Column, n_files: Column, n_slices: Column, min_slices: int = 30) -> Column:
    """failed / no_output / qc_flag:low_slice_count / ok."""
    return (F.when((n_files == 0) & (exit_code != 0), "failed").when(n_files == 0, "no_output")
            .when(F.coalesce(n_slices, F.lit(0)) < min_slices, "qc_flag:low_slice_count").when(exit_code != 0, "failed").otherwise("ok"))


def verdict(reasons: Mapping[str, Column]) -> tuple[Column, Column]:
    """(PASS/REVIEW, joined reasons) from named conditions."""
    arr = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in reasons.items()]))
    return F.when(F.size(arr) == 0, "PASS").otherwise("REVIEW"), F.array_join(arr, ";")
