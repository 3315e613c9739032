"""Logical tables derived from the driver's parquet tables.

Each binding is one SELECT that Spark SQL and DuckDB both accept, so queries and
their check SQL start from the same rows. All cover whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

UNITS = """
SELECT o_orderkey AS unit, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
       CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1250e0 + CASE WHEN o_orderstatus = 'F' THEN 2e-1 ELSE 0e0 END AS score,
       CAST(o_orderkey % 5 AS INT) AS fold,
       CASE WHEN o_orderkey % 10 = 9 THEN 'holdout' ELSE 'cross-validation' END AS cohort,
       o_orderpriority AS priority, o_orderstatus AS status, o_totalprice AS price, o_custkey AS cust, o_orderdate AS day
FROM orders"""

# The same units with the holdout as reports see it: without a fold.
UNITS_FOLDS = """
SELECT unit, label, score, CASE WHEN cohort = 'holdout' THEN NULL ELSE fold END AS fold, priority, price, label * (unit % 3 + 1) AS lesions
FROM (""" + UNITS + """) u"""

UNITS_SMALL = """
SELECT l.doc_id AS unit, CAST(l.quality AS INT) AS label, CAST(d.n_chars % 997 AS DOUBLE) / 1000e0 AS score,
       d.lang AS lang, d.source AS source, CAST(l.doc_id % 5 AS INT) AS fold, d.n_chars AS n_chars
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""

BOXES = """
SELECT unit, slice_y, x1, z1, x1 + w AS x2, z1 + h AS z2, score, is_pred, count(*) AS copies
FROM (SELECT l_suppkey AS unit, CAST(l_orderkey % 20 AS INT) AS slice_y,
             CAST(l_partkey % 12 AS INT) * 8 AS x1, CAST(floor(l_partkey / 12e0) % 12 AS INT) * 8 AS z1,
             4 + l_linenumber * 2 AS w, 4 + CAST(l_quantity AS INT) % 16 AS h,
             (l_extendedprice % 1000e0) / 1000e0 AS score, l_returnflag <> 'R' AS is_pred
      FROM lineitem) t
GROUP BY unit, slice_y, x1, z1, w, h, score, is_pred"""

# Every line of lineitem in four slices: heaps of boxes at places 36 apart, a third of them drawn so small that they
# share one spot. ``slice_y`` is the slice plus 4 * place: no box of one place reaches another, so check SQL may go place
# by place, while queries are only given the slice.
BOXES_CROWDED = """
SELECT unit, slice_y, x AS x1, z AS z1, x + w AS x2, z + h AS z2, score, is_pred, count(*) AS copies
FROM (SELECT l_partkey % 2 AS unit, l_linenumber % 2 + 2 * (l_suppkey % 2) + 4 * CAST(floor(l_orderkey / 16e0) AS BIGINT) AS slice_y,
             (floor(l_orderkey / 16e0) % 1000 * 36 + l_partkey % 12) * s AS x, (floor(l_orderkey / 16000e0) * 36 + l_suppkey % 12) * s AS z,
             (8 + l_linenumber * 2) * s AS w, (8 + CAST(l_quantity AS INT) % 16) * s AS h, (l_extendedprice % 1000e0) / 1000e0 AS score, l_returnflag <> 'R' AS is_pred
      FROM (SELECT *, CASE WHEN floor(l_orderkey / 16e0) % 3 = 0 THEN 0.0009765625e0 ELSE 1e0 END AS s FROM lineitem) l) t
GROUP BY unit, slice_y, x, z, w, h, score, is_pred"""

VOXELS = """
SELECT l_suppkey AS unit, CAST(l_partkey % 50 AS INT) AS x, l_linenumber AS y, CAST(l_quantity AS INT) AS z,
       sum(CAST(round(l_extendedprice * 100e0) AS BIGINT)) / (100e0 * count(*)) AS v, count(*) AS copies
FROM lineitem
GROUP BY l_suppkey, CAST(l_partkey % 50 AS INT), l_linenumber, CAST(l_quantity AS INT)"""

STEPS = """
SELECT event_id AS step, user_id AS unit, CAST(event_id % 20 AS INT) AS slice_y, event_type AS kind, ts, value AS score,
       event_type = 'purchase' AS is_positive
FROM events"""

SERIES = """
SELECT doc_id AS series, CAST(doc_id % 211 AS BIGINT) AS unit, source AS batch, lang AS descr, n_chars AS n_files,
       CASE WHEN n_chars < 200 THEN 'empty_folder' ELSE 'ok' END AS read_status,
       CASE WHEN doc_id % 3 = 0 THEN 'FAT' ELSE 'WATER' END AS token, CASE WHEN doc_id % 4 = 0 THEN 'pos' ELSE 'neg' END AS cohort
FROM documents"""

BINDINGS = {"units": UNITS, "units_folds": UNITS_FOLDS, "units_small": UNITS_SMALL, "boxes": BOXES, "boxes_crowded": BOXES_CROWDED, "voxels": VOXELS, "steps": STEPS, "series": SERIES}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Logical table ``name`` over the parquet tables it mentions."""
    text = BINDINGS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if f" {t}" in text and (f"FROM {t}" in text or f"JOIN {t}" in text)}
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **used)


def with_(*names: str, recursive: bool = False) -> str:
    """``WITH name AS (...), ...`` prefix for check SQL."""
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(f"{n} AS ({BINDINGS[n]})" for n in names)
