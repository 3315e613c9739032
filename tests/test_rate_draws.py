"""Bootstrap of a rate: the draws of the plain one, made where the bits of the hits are."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldscope import runtime
from foldscope.functions import hashing
from foldscope.operators import metrics as M


@pytest.mark.parametrize("head", ["42:0", "42:999", "-7:12345678901"])
@pytest.mark.parametrize("digits", [1, 3, 5])
def test_hashes_of_ranges(head, digits):
    for n in (0, 1, 10, 11, 1001, 2345):
        got = {first + k: int(h) for first, piece in hashing.hash60_range(head, n, digits) for k, h in enumerate(piece)}
        assert got == {i: int(hashlib.md5(f"{head}:{i}".encode()).hexdigest()[:15], 16) for i in range(n)}


@pytest.mark.parametrize("words", [2**21, 1])
def test_rate_equals_the_plain_bootstrap(spark, monkeypatch, words):
    monkeypatch.setattr(runtime, "RATE_WORDS", words)
    r = np.random.default_rng(3)
    rows = [(f"u{i}", int(g), float(h)) for i, (g, h) in enumerate(zip(r.choice([0, 1, 1, 1, 3], 400), r.integers(0, 2, 400)))] + [("one", 2, 1.0)]
    df = spark.createDataFrame(rows, "unit string, bin int, hit double").repartition(3)
    get = lambda ci: sorted((q.bin, q.ci_lower, q.ci_upper, q.n_reps) for q in ci.collect())
    assert get(M.bootstrap_rate(df, ["unit"], "hit", "bin", 60)) == get(M.bootstrap_ci(df, ["unit"], "mean", "hit", None, 60, by=["bin"]))


def test_empty_calls_have_no_interval(spark):
    calls = spark.createDataFrame([], "call_id string, call_type string, volume_mm3 double")
    assert [(q.n_lesions, q.ci_lower) for q in M.size_strata(calls, n_boot=10).collect()] == [(0, None)] * 4


def test_strata_shuffle_no_draws(spark, monkeypatch):
    monkeypatch.setattr(M, "resample", None)
    calls = spark.range(50).select(F.col("id").alias("call_id"), F.when(F.col("id") % 3 == 0, "tp").otherwise("fn").alias("call_type"), (F.col("id") * 40.0).alias("volume_mm3"))
    assert sum(q.n_tp for q in M.size_strata(calls, n_boot=10).collect()) == 17
