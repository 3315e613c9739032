"""JSON is flattened in one pass over its text."""

import pytest
from pyspark.sql import functions as F

from foldscope.functions import scalar as S


def test_each_level_is_parsed_once(spark):
    docs = spark.createDataFrame([('{"a": {"b": {"c": 1}, "e": {}}, "x": "{no", "": {"k": null}}',), (None,), ('{"a": 2}',)], "doc string")
    flat = S.flatten_json(docs, "doc", 3)
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") <= 4 and "Union" not in plan  # Spark looks for empty documents before it opens them
    want = {("a.b.c", "1"), ("a.e", "{}"), ("x", "{no"), ("k", None), ("a", "2")}
    assert {(r.path, r.value) for r in flat.collect()} == want == {(r.path, r.value) for r in S.flatten_json(docs, "doc").collect()}
    with pytest.raises(Exception, match="deeper than stated: a.b"):
        S.flatten_json(docs, "doc", 2).collect()
