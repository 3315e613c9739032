"""Session helpers: lineage cutting in shared storage and size bounds.

Every size switch in the library reads one of the constants below, so a test
can lower them and drive the large-data route on a small fixture.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One window partition may hold at most this many rows; larger inputs are range-split first.
WINDOW_ROWS = 1_000_000
# A grid cell of a pair join is split or dealt out beyond so many boxes of both sides; the result is the same.
CELL_BOXES = 1_024
# Fusion folds a region of at most so many boxes at once, four times as many if nothing parts it; a larger one is fused by groups, with
# the same result.
FOLD_BOXES = 32
# A task takes the tiles of so many runs or blocks; more of them are more tasks.
TILE_ROWS = 100_000
# A tile that waits for more of its blocks is merged whenever it holds twice so many.
TILE_HELD = 100_000
# A task of a rate's bootstrap holds so many words of 64 hits of a group.
RATE_WORDS = 2**21


def session(app: str = "foldscope", cpus: str = "*", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


# Folder of this process where the session names none (local mode only).
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder for cut tables: the cluster's checkpoint folder, or a temporary one in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _own_dir[0]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result has no upstream lineage, survives executor loss, and carries real
    file sizes, so later joins pick broadcast or shuffle from measured bytes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` with the wish that its next join shuffles both sides.

    Spark sizes a side by the rows that go into a generator, not by those that come out, and would broadcast from the
    driver what ``explode`` has multiplied a thousandfold.
    """
    return df.hint("merge")


def join_groups(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``cols`` in which NULL is a group like any other; the key columns of ``left`` stay."""
    names = {c: f"_k_{c}" for c in cols}
    cond = F.lit(True)
    for c, k in names.items():
        cond = cond & F.col(c).eqNullSafe(F.col(k))
    return left.join(right.withColumnsRenamed(names), cond, how).drop(*names.values())
