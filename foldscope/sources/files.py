"""Readers and writers for the study's file forms."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foldscope import runtime

GT_BOXES = "unit string, slice_y int, cc_id int, x1 int, z1 int, x2 int, z2 int, box_max_dim_mm float"


def read_csv(spark: SparkSession, path, schema: str | StructType | None = None) -> DataFrame:
    """CSV with header; types are inferred only when no schema is given."""
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path)


def read_manifest(spark: SparkSession, path, schema, key="unit") -> DataFrame:
    """JSON lines with nested rows; blank lines are skipped and a repeated key stops the job."""
    df = spark.read.schema(schema).json(path).filter(F.col(key).isNotNull())
    dup = df.groupBy(key).agg(F.count("*").alias("_n"))
    stop = F.raise_error(F.concat(F.lit("duplicate key: "), F.col(key).cast("string"))).cast("long")
    checked = dup.withColumn("_n", F.when(F.col("_n") > 1, stop).otherwise(F.col("_n")))
    return df.join(checked, key).filter("_n = 1").drop("_n")


def read_donors(spark: SparkSession, path, schema, pred: Column) -> DataFrame:
    """JSON lines scan with the filter at the source."""
    return spark.read.schema(schema).json(path).filter(pred)


def read_boxes(spark: SparkSession, path, schema: str = GT_BOXES) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def write_boxes(df: DataFrame, path: str, schema: str = GT_BOXES) -> None:
    """Parquet in the fixed, typed layout."""
    parts = [c.strip().split(" ") for c in schema.split(",")]
    df.select(*[F.col(n).cast(t).alias(n) for n, t in parts]).write.mode("overwrite").parquet(path)


def read_parts(spark: SparkSession, pattern, schema, name="part_file") -> DataFrame:
    """All part files of a glob, every row tagged with its file name."""
    df = spark.read.option("header", True).schema(schema).csv(pattern)
    return df.select("*", F.col("_metadata.file_name").alias(name))


def list_files(spark: SparkSession, root, pattern="*", min_bytes=0) -> DataFrame:
    """Recursive listing with sizes, hidden files left out; file contents are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return df.select("path", name.alias("name"), "length", "modificationTime").filter(~name.startswith(".") & (F.col("length") >= min_bytes))


class Sha256:
    """sha256 whose state another task can take up: OpenSSL's context, 112 bytes of plain memory, where Python has that library."""

    def __init__(self, state: bytes | None = None):
        import ctypes

        self.lib = self.library()
        self.ctx = ctypes.create_string_buffer(state or bytes(112), 112)
        if state is None:
            self.lib.SHA256_Init(self.ctx)

    @staticmethod
    def library():
        """The library that ``hashlib`` itself uses, or None if it keeps its context to itself."""
        import ctypes

        try:
            import _hashlib

            lib = ctypes.CDLL(_hashlib.__file__)
            lib.SHA256_Update.argtypes = [ctypes.c_char_p, ctypes.c_char_p, ctypes.c_size_t]
            return lib if lib.SHA256_Init and lib.SHA256_Final else None
        except (ImportError, AttributeError, OSError):
            return None

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.ctx, data, len(data))

    def state(self) -> bytes:
        return self.ctx.raw

    def hexdigest(self) -> str:
        import ctypes

        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, ctypes.create_string_buffer(self.ctx.raw, 112))
        return out.raw.hex()


# Bytes of a file that one task takes on, from where the task before it left off.
HASH_STEP = 128 << 20
BOM = b"\xef\xbb\xbf"


def _hash_helper(first: bool):
    """Arrow helper: rows by file and place, each file's state ahead of its lines, become a row per file with its new state or its digest."""
    import hashlib

    import numpy as np
    import pyarrow as pa

    handed = Sha256.library() is not None

    def run(batches):
        path = sha = how = None
        bare = False

        def done():
            if how & 1:
                sha.update(b"\n")
            last = bool(how & 2)
            state, hexed = (None, sha.hexdigest()) if last else (sha.state(), None)
            return pa.RecordBatch.from_pydict({"file": [path], "state": pa.array([state], pa.binary()), "sha256": pa.array([hexed], pa.string())})

        for batch in batches:
            files = batch.column("file").dictionary_encode()
            at = np.r_[0, np.flatnonzero(np.diff(files.indices.to_numpy())) + 1, len(files)] if len(files) else []
            for a, b in zip(at[:-1], at[1:]):
                lines = batch.column("value").slice(a, b - a).to_pylist()
                if (name := batch.column("file")[a].as_py()) != path:
                    if path is not None:
                        yield done()
                    path, how, bare, state = name, batch.column("at")[a].as_py(), first, lines.pop(0)
                    sha = (Sha256() if handed else hashlib.sha256()) if first else Sha256(state)
                    if first:
                        sha.update(state)
                if lines:
                    if not bare:
                        sha.update(b"\n")
                    sha.update(b"\n".join(lines))
                    bare = False
        if path is not None:
            yield done()

    return run


def _codec_suffixes(spark: SparkSession) -> list[str]:
    """Endings by which Hadoop's line reader would unpack a file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory.getCodecClasses(conf)
    return [jvm.org.apache.hadoop.util.ReflectionUtils.newInstance(c, conf).getDefaultExtension() for c in codecs]


def file_hashes(spark: SparkSession, root, pattern="*", step: int | None = None) -> DataFrame:
    """sha256 of every file's content.

    A file's bytes are read in splits, as lines without regard to what they mean, and kept with their places. The digest is a
    fold over them in order: round by round a task takes up each file's state and ``step`` more bytes, so no task reads a
    whole large file. A stretch without a newline is one row; files whose names end like a packed file's, which Spark would
    unpack, are read whole. Spark's readers leave out empty files.
    """
    step = step or HASH_STEP
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    file = F.col("_metadata.file_path").alias("file")
    whole = F.lit(False)
    for suffix in _codec_suffixes(spark):
        whole = whole | F.lower("_metadata.file_path").endswith(suffix)
    name = F.regexp_extract("path", r"([^/]+)$", 1).alias("name")
    listed = runtime.cut(binary.filter(~whole).select("path", name, "length", file))
    most = listed.agg(F.max("length")).first()[0] or 0
    if Sha256.library() is None:
        step = max(step, most)
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n").text(root).filter(~whole)
    start = F.col("_metadata.file_block_start")
    rows = text.select(file, start.alias("start"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("value"),
                       F.octet_length("value").cast("long").alias("n"), F.floor(start / step).cast("int").alias("round"))
    kept = f"{runtime.shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    rows.write.partitionBy("round").parquet(kept)
    rows = spark.read.schema(rows.schema).parquet(kept)
    # Every line of a file ends by a newline, but for the last, which may lack it; Hadoop skips a byte order mark at the start.
    held = listed.join(rows.groupBy("file").agg(F.sum(F.col("n") + 1).alias("_n")), "file", "left")
    over = F.coalesce("_n", F.lit(0)) - F.col("length")
    off = F.raise_error(F.concat(F.lit("changed while it was read: "), F.col("file"))).cast("int")
    state = F.when(over.isin(0, 1), F.lit(b"")).when(over.isin(-3, -2), F.lit(BOM)).otherwise(off.cast("string").cast("binary"))
    state = runtime.cut(held.select("file", "length", (over.isin(0, -3) & F.col("_n").isNotNull()).cast("long").alias("newline"), state.alias("state"), F.lit(None).cast("string").alias("sha256")))
    done = []
    for k in range(max(1, -(-most // step))):
        last = F.col("length") <= (k + 1) * step
        how = F.when(last, F.col("newline") + 2).otherwise(0)
        ahead = state.select("file", F.lit(-1).cast("long").alias("start"), how.cast("long").alias("at"), F.col("state").alias("value"))
        size = state.agg(F.sum(F.least(F.col("length"), F.lit(step)))).first()[0] or 0
        both = ahead.unionByName(rows.filter(F.col("round") == k).select(ahead.columns))
        both = both.repartition(4 * max(1, -(-size // step)), "file").sortWithinPartitions("file", "start", "at")
        new = runtime.cut(both.mapInArrow(_hash_helper(k == 0), "file string, state binary, sha256 string"))
        done.append(new.filter("sha256 is not null").select("file", "sha256"))
        state = runtime.cut(state.drop("state", "sha256").join(new.filter("sha256 is null"), "file"))
    hashed = listed.join(functools.reduce(DataFrame.unionByName, done), "file").select("path", "name", "length", "sha256")
    return hashed.unionByName(binary.filter(whole).select("path", name, "length", F.sha2("content", 256).alias("sha256")))


def write_verified(df: DataFrame, path: str, fmt="parquet") -> DataFrame:
    """Write, read back, and fail unless schema, row count and content hash survive.

    Count and hash of what was written are observed during the write, so the source is computed once.
    """
    from pyspark.sql import Observation

    def seen(t: DataFrame) -> list[Column]:
        # Sum of row hashes: the same in any order. Maps can't be hashed and count by their JSON.
        cols = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in t.schema.fields]
        return [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h")]

    wrote = Observation()
    df.observe(wrote, *seen(df)).write.mode("overwrite").format(fmt).save(path)
    back = df.sparkSession.read.format(fmt).load(path)
    plain = lambda s: [(f.name, f.dataType.simpleString()) for f in s.fields]
    if plain(back.schema) != plain(df.schema) or back.agg(*seen(back)).first().asDict() != wrote.get:
        raise RuntimeError(f"round trip of {path} does not match what was written")
    return back


def append_report(rows: DataFrame, path: str, run_id: str | None = None) -> str:
    """Append rows under a fresh run id; earlier runs stay as they are."""
    run_id = run_id or uuid.uuid4().hex
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
    return run_id


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a table's files by two renames of whole folders: between them readers find no table (see ``publish_table``)."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    stage, old = f"{path}.stage-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(stage)
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    had = fs.exists(at(path))
    if had and not fs.rename(at(path), at(old)):
        raise RuntimeError(f"could not move {path} aside")
    if not fs.rename(at(stage), at(path)):
        if had:
            fs.rename(at(old), at(path))
        raise RuntimeError(f"could not publish {path}")
    if had:
        fs.delete(at(old), True)


# Folders of a published table: a file per version, and the data of each beside them.
VERSIONS = "_versions"


def _fs(spark: SparkSession, path: str):
    """The Hadoop file system of ``path`` and a maker of its paths, so that any store Spark reads will do."""
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _pointers(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(version, data folder) in ascending order; a pointer that was begun but never written names no folder."""
    fs, at = _fs(spark, path)
    root = at(f"{path}/{VERSIONS}")
    if not fs.exists(root):
        return []
    found = []
    for f in fs.listStatus(root):
        if f.getPath().getName().isdigit():
            stream = fs.open(f.getPath())
            try:
                said = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            found.append((int(f.getPath().getName()), said[:-1] if said.endswith("\n") else ""))
    return sorted(found)


def current_version(spark: SparkSession, path: str) -> int:
    """Newest complete version of a published table, 0 if there is none."""
    return max((v for v, folder in _pointers(spark, path) if folder), default=0)


def read_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest complete version of a published table, or the one asked for."""
    known = {v: folder for v, folder in _pointers(spark, path) if folder}
    v = max(known, default=0) if version is None else version
    if v not in known:
        raise FileNotFoundError(f"{path} has no version {v}")
    return spark.read.parquet(f"{path}/{known[v]}")


def publish_table(df: DataFrame, path: str, expected: int | None = None, tries: int = 10) -> int:
    """Publish ``df`` as the next version of the table at ``path`` and return its number.

    The rows are written to a folder of their own; then one small file, created only if it isn't there yet, makes them
    the newest version. A reader therefore sees the old rows or the new ones, whole, and keeps what it began to read;
    a writer that dies at any point leaves the old version. Of two writers that reach for one number the later takes the
    next, so the last to publish wins; with ``expected``, the version the rows were made from, it fails instead.
    """
    spark = df.sparkSession
    fs, at = _fs(spark, path)
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    for _ in range(tries):
        taken = _pointers(spark, path)
        done = max((v for v, f in taken if f), default=0)
        if expected is not None and done != expected:
            break
        number = max((v for v, _ in taken), default=0) + 1
        try:
            stream = fs.create(at(f"{path}/{VERSIONS}/{number}"), False)
        except Exception as e:  # noqa: BLE001  the other writer's file is there
            if not fs.exists(at(f"{path}/{VERSIONS}/{number}")):
                raise RuntimeError(f"could not publish {path}") from e
            continue
        try:
            stream.write(f"{folder}\n".encode())
        finally:
            stream.close()
        return number
    fs.delete(at(f"{path}/{folder}"), True)
    raise RuntimeError(f"{path} changed while it was being written")


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the ``keep`` newest versions and their data; readers of older ones must be done."""
    fs, at = _fs(spark, path)
    known = [p for p in _pointers(spark, path) if p[1]]
    for number, folder in known[: max(len(known) - max(keep, 1), 0)]:
        fs.delete(at(f"{path}/{VERSIONS}/{number}"), False)
        fs.delete(at(f"{path}/{folder}"), True)


def upsert_by_key(old: DataFrame, new: DataFrame, key) -> DataFrame:
    """Rows of processed keys replaced, all others kept."""
    keys = [key] if isinstance(key, str) else list(key)
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def write_calls(df: DataFrame, path: str, fmt="json") -> None:
    """Record export; CSV keeps its header even with no rows."""
    if fmt == "csv":
        write_or_empty(df, path)
    else:
        df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_or_empty(df: DataFrame, path: str) -> None:
    """CSV whose header is there even with no rows; the source is computed once."""
    from pyspark.sql import Observation

    wrote = Observation()
    df.observe(wrote, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("header", True).csv(path)
    if not wrote.get["n"]:
        df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_id_list(df: DataFrame, path: str, key="unit") -> None:
    """Sorted ids, one per line."""
    df.select(F.col(key).cast("string").alias("value")).distinct().sort("value").write.mode("overwrite").text(path)


def ingest_parts(parts: DataFrame, done: DataFrame, key="id", status="status") -> DataFrame:
    """Rows still to do: keys without an ok result so far; failed keys come again."""
    return parts.join(done.filter(F.col(status) == "ok").select(key), key, "left_anti")
