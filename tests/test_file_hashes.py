"""Digests of files equal hashlib's, whatever the bytes; no task takes in a large file whole."""

import gzip
import hashlib

import numpy as np
import pytest

from foldscope.sources import files as IO

STEP = 1000


def contents():
    r = np.random.default_rng(11)
    noise = lambda n: r.integers(0, 256, n, dtype=np.uint8).tobytes()
    made = {"newline": b"\n", "newlines": b"\n\n\n", "plain": b"hello", "returns": b"a\r\nb\rc\r\n\r", "bom": b"\xef\xbb\xbfab\nc", "bom_ends": b"\xef\xbb\xbfab\n",
            "bom_only": b"\xef\xbb\xbf", "zeros": bytes(5000), "many": b"\n" * 2500, "exact": noise(STEP), "twice": noise(2 * STEP)}
    return made | {f"noise{n}": noise(n) for n in (1, 63, 64, 999, 1001, 4999, 7000)} | {"noise_ends": noise(3000) + b"\n", "noise_begins": b"\n" + noise(3000)}


@pytest.mark.parametrize("handed", [True, False])
def test_digests_of_any_bytes(spark, tmp_path, monkeypatch, handed):
    if handed:
        assert IO.Sha256.library() is not None
    else:
        monkeypatch.setattr(IO.Sha256, "library", staticmethod(lambda: None))
    made = contents() | {"packed.gz": gzip.compress(b"x" * 3000), "not packed.gz": b"no\ngzip", "with space": b"a b\n"}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = IO.file_hashes(spark, str(tmp_path), step=STEP).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in made.items()}
    assert len(got) == len(made) and {r.name: (r.length, r.sha256) for r in got} == want


def test_state_is_handed_on():
    data, sha = bytes(range(256)) * 9, IO.Sha256()
    for a in range(0, len(data), 37):
        sha.update(data[a:a + 37])
        sha = IO.Sha256(sha.state())
    assert sha.hexdigest() == sha.hexdigest() == hashlib.sha256(data).hexdigest()


def test_a_task_takes_one_step(spark, tmp_path, monkeypatch):
    data = np.random.default_rng(12).integers(0, 256, 20_000, dtype=np.uint8).tobytes()
    (tmp_path / "x.bin").write_bytes(data)
    seen, helper = spark.sparkContext.accumulator(0), IO._hash_helper
    most = []

    def counted(first):
        before = seen.value
        most.append(before)

        def run(batches):
            def through():
                for b in batches:
                    seen.add(b.column("value").nbytes)
                    yield b
            return helper(first)(through())
        return run

    monkeypatch.setattr(IO, "_hash_helper", counted)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = IO.file_hashes(spark, str(tmp_path), step=4000).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[0].sha256 == hashlib.sha256(data).hexdigest()
    rounds = np.diff([*most, seen.value])
    assert len(rounds) == 5 and max(rounds) < 10_000
