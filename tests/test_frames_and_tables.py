"""Per-unit windows, donor pasting, grouped lesion curves and published tables."""

import threading

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from foldscope.operators import cohort, components as C
from foldscope.operators import metrics as M
from foldscope.operators import sampling as K
from foldscope.sources import files as IO


# --- windows and frames


def points(spark, n=200):
    r = np.random.default_rng(1)
    rows = {(None if u == 3 else int(u), *map(int, p)) for u, *p in r.integers(0, [4, 12, 12, 12], (n, 4))}
    return sorted(rows, key=str), spark.createDataFrame(list(rows), "unit int, x int, y int, z int")


def test_crop_to_frames_equals_a_loop(spark):
    rows, df = points(spark)
    frames = {0: (2, 3, 4, 5, 6, 7), 1: (0, 0, 0, 1, 1, 1), None: (-3, 5, 0, 20, 4, 12)}
    got = C.crop_to_frames(df, spark.createDataFrame([(u, *f) for u, f in frames.items()], "unit int, ox int, oy int, oz int, nx int, ny int, nz int"))
    want = []
    for u, *p in rows:
        if u in frames:
            o, n = frames[u][:3], frames[u][3:]
            q = [a - b for a, b in zip(p, o)]
            if all(0 <= a < b for a, b in zip(q, n)):
                want.append((u, *q))
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    twice = spark.createDataFrame([(0, *frames[0])] * 2, "unit int, ox int, oy int, oz int, nx int, ny int, nz int")
    with pytest.raises(PySparkException, match="repeated key"):
        C.crop_to_frames(df, twice).collect()
    assert C.crop_to_frames(df, twice.limit(0)).count() == 0


def test_pad_to_frame_centres_each_unit(spark):
    rows, df = points(spark)
    boxes = {0: (1, 8, 0, 12, 3, 4), None: (0, 12, 2, 5, 0, 11)}
    schema = "unit int, x0 int, x1 int, y0 int, y1 int, z0 int, z1 int"
    got = C.pad_to_frame(df, spark.createDataFrame([(u, *b) for u, b in boxes.items()], schema), (13, 12, 15))
    want = []
    for u, *p in rows:
        if u in boxes:
            b = boxes[u]
            if all(lo <= a < hi for a, lo, hi in zip(p, b[::2], b[1::2])):
                want.append((u, *[a - lo + (n - (hi - lo)) // 2 for a, lo, hi, n in zip(p, b[::2], b[1::2], (13, 12, 15))]))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    with pytest.raises(PySparkException, match="extent 12 exceeds frame 11"):
        C.pad_to_frame(df, spark.createDataFrame([(0, 0, 12, 0, 1, 0, 12)], schema), (12, 12, 11)).collect()
    with pytest.raises(ValueError):
        cohort.crop_pad(df, "x", 0, 9, 8)


# --- pasting


@pytest.mark.parametrize("with_shell", [True, False])
def test_paste_equals_arrays(spark, with_shell):
    r = np.random.default_rng(4)
    vol = r.normal(50, 9, (6, 5, 4))
    inside = np.zeros(vol.shape, bool)
    inside[2:4, 1:3, 1:3] = True
    dist = np.min([np.linalg.norm(np.indices(vol.shape).transpose(1, 2, 3, 0) - c, axis=-1) for c in np.argwhere(inside)], axis=0) * 0.6
    shell = ~inside & (dist <= 1.2) & with_shell
    donor = r.normal(5, 2, vol.shape)
    donor[2, 1, 1] = np.nan
    given = inside & ~np.isnan(donor)
    mu, sd = (vol[shell].mean(), vol[shell].std()) if with_shell else (vol[inside].mean(), 1.0)
    want = vol.copy()
    want[inside] = np.where(np.isnan(donor[inside]), 0, (donor[inside] - donor[given].mean()) / donor[given].std()) * sd + mu
    near = shell & (dist < 1)
    want[near] = (1 - dist[near]) * mu + dist[near] * vol[near]
    cells = [(None, *map(int, c), None if np.isnan(donor[tuple(c)]) else float(donor[tuple(c)]), "inside" if inside[tuple(c)] else "shell", float(dist[tuple(c)])) for c in np.argwhere(inside | shell)]
    cells += [(None, 2, 2, 2, 1e9, "shell", 0.0), (None, 99, 0, 0, 7.0, "shell", 0.0)]  # the inside cell wins; one place is off the volume
    volume = [(u, *map(int, c), float(vol[tuple(c)])) for u in (None, 1) for c in np.argwhere(vol > -1e9)]
    got = K.paste_donors(spark.createDataFrame(volume, "unit int, x int, y int, z int, v double"), spark.createDataFrame(cells, "unit int, x int, y int, z int, donor double, part string, dist double")).collect()
    assert len(got) == 2 * vol.size
    for g in got:
        at = (g.x, g.y, g.z)
        assert g.v == pytest.approx(want[at] if g.unit is None else vol[at])
        assert g.part == (None if g.unit == 1 else "inside" if inside[at] else "shell" if near[at] else None)


def test_paste_with_flat_statistics(spark):
    """A deviation of 0 counts as 1 on the donor's side and as 1e-6 on the target's."""
    volume = spark.createDataFrame([(1, x, 0, 0, 4.0) for x in range(4)], "unit int, x int, y int, z int, v double")
    cells = spark.createDataFrame([(1, 0, 0, 0, 7.0, "inside", 0.0), (1, 1, 0, 0, None, "shell", 0.5), (1, 2, 0, 0, None, "shell", 1.0)], "unit int, x int, y int, z int, donor double, part string, dist double")
    got = {r.x: (r.v, r.part) for r in K.paste_donors(volume, cells).collect()}
    assert got == {0: (pytest.approx(4.0), "inside"), 1: (4.0, "shell"), 2: (4.0, None), 3: (4.0, None)}
    assert K.paste_donors(volume, cells.limit(0)).filter("part is not null").isEmpty() and K.paste_donors(volume.limit(0), cells).isEmpty()


# --- lesion curves and sizes


def blocks(spark, rows):
    return spark.createDataFrame(rows, "unit int, y int, z int, x0 int, x1 int, score double, cc_id int")


def test_lesion_curves_per_group(spark):
    calls = blocks(spark, [(1, 0, 0, 0, 3, 0.9, 1), (1, 5, 5, 0, 3, 0.8, 2), (2, 0, 0, 0, 3, 0.7, 1), (3, 9, 9, 0, 1, 0.6, 1)])
    lesions = blocks(spark, [(1, 0, 0, 0, 3, None, 1), (2, 0, 0, 0, 3, None, 1), (2, 4, 4, 0, 3, None, 2), (4, 1, 1, 0, 1, None, 1)])
    units = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "b"), (5, "a")], "unit int, fold string")
    got = {(r.fold, r.score): (r.fp_per_unit, r.sens) for r in C.lesion_froc(calls, lesions, units=units, by=["fold"]).collect()}
    assert got == {("a", 0.9): (0.0, 1.0), ("a", 0.8): (0.5, 1.0), ("b", 0.7): (0.0, pytest.approx(1 / 3)), (None, 0.6): (1.0, None)}
    whole = C.lesion_froc(calls, lesions, 5).collect()
    assert {r.score: r.sens for r in whole}[0.6] == 0.5


def test_sizes_by_call_or_lesion(spark):
    rows = [("1", "tp", 150.0, 900.0), ("2", "tp", 6000.0, 100.0), ("3", "fn", 100.0, 100.0), ("4", "fp", 100.0, None)]
    df = spark.createDataFrame(rows, "call_id string, call_type string, volume_mm3 double, lesion_volume_mm3 double")
    n = lambda **kw: [(r.n_lesions, r.n_tp) for r in M.size_strata(df, n_boot=20, **kw).collect()]
    assert sorted(n()) == [(0, 0), (0, 0), (1, 1), (2, 1)] and sorted(n(size_of="lesion")) == [(0, 0), (0, 0), (1, 1), (2, 1)]
    by = {r.stratum_value: r.n_lesions for r in M.size_strata(df, n_boot=20, size_of="lesion").collect()}
    assert by["<=200mm3"] == 2 and by["200-1000mm3"] == 1 and by[">5000mm3"] == 0


# --- published tables


def test_published_versions(spark, tmp_path):
    p = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        IO.read_published(spark, p)
    assert IO.current_version(spark, p) == 0
    first = IO.publish_table(spark.range(5), p)
    old = IO.read_published(spark, p)
    assert IO.publish_table(old.filter("id > 2"), p, expected=first) == 2
    # A reader that began with the old version keeps it; new ones see the new rows.
    assert old.count() == 5 and IO.read_published(spark, p).count() == 2 and IO.read_published(spark, p, 1).count() == 5
    with pytest.raises(RuntimeError, match="changed while"):
        IO.publish_table(spark.range(9), p, expected=first)
    assert IO.current_version(spark, p) == 2
    for _ in range(2):
        IO.publish_table(spark.range(1), p)
    IO.drop_versions(spark, p, keep=2)
    assert [v for v, _ in IO._pointers(spark, p)] == [3, 4] and IO.read_published(spark, p).count() == 1


def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path):
    p = tmp_path / "t"
    IO.publish_table(spark.range(3), str(p))
    spark.range(7).write.parquet(str(p / "data-begun"))  # died before it published
    assert IO.read_published(spark, str(p)).count() == 3
    (p / "_versions" / "2").write_text("")  # died between creating its pointer and writing it
    assert IO.current_version(spark, str(p)) == 1 and IO.read_published(spark, str(p)).count() == 3
    with pytest.raises(PySparkException):
        IO.publish_table(spark.range(3).select(F.raise_error(F.lit("no")).alias("id")), str(p))
    assert IO.read_published(spark, str(p)).count() == 3
    assert IO.publish_table(spark.range(4), str(p)) == 3 and IO.read_published(spark, str(p)).count() == 4


def test_two_writers_each_get_a_version(spark, tmp_path):
    p = str(tmp_path / "t")
    got = []
    writers = [threading.Thread(target=lambda n=n: got.append(IO.publish_table(spark.range(n), p))) for n in (10, 20, 30)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert sorted(got) == [1, 2, 3] and {IO.read_published(spark, p, v).count() for v in got} == {10, 20, 30}


def test_verified_write_sees_lost_and_changed_rows(spark, tmp_path):
    df = spark.range(20).select("id", F.map_from_arrays(F.array(F.lit("k")), F.array("id")).alias("m"), F.when(F.col("id") > 3, F.lit("x")).alias("s"))
    assert IO.write_verified(df, str(tmp_path / "a")).count() == 20
    assert IO.write_verified(df.limit(0), str(tmp_path / "b")).count() == 0
    with pytest.raises(RuntimeError):  # CSV has no types to read back
        IO.write_verified(spark.range(3), str(tmp_path / "c"), "csv")
