"""The whole way from a JSON file to metrics."""

import json

import pytest
from pyspark.sql import functions as F

from tracelode.functions import symbols
from tracelode.plans import evaluate


@pytest.mark.parametrize("method,arguments", [("prefix_match", ()), ("brodie", (2.5,)), ("trace_sim", ()), ("fast", (1.0, 1.0, 1.0))])
def test_metrics(spark, tmp_path, method, arguments):
    stack = lambda *names: {"frames": [{"function": n} for n in names]}
    data = [
        {"bug_id": 1, "creation_ts": 10, "stacktrace": stack("a", "b", "c")}, {"bug_id": 2, "creation_ts": 20, "stacktrace": stack("x", "y", "c")}, {"bug_id": 3, "creation_ts": 30, "dup_id": 1, "stacktrace": [stack("a", "b", "d"), stack("q")]},
        {"bug_id": 4, "creation_ts": 40, "dup_id": 2, "stacktrace": stack("x", "y", "c")}, {"bug_id": 5, "creation_ts": 50, "stacktrace": stack("z")},
    ]
    path = tmp_path / "reports.json"
    path.write_text(json.dumps(data))
    r = evaluate.metrics(spark, str(path), method=method, arguments=arguments).first()
    assert r["n_queries"] == 2 and r["mrr"] == 1 and r["rr1"] == 1


def test_query_that_shares_nothing(spark, tmp_path):
    """A duplicate without a common symbol ranks last, and counts."""
    stack = lambda *names: {"frames": [{"function": n} for n in names]}
    data = [{"bug_id": 1, "creation_ts": 10, "stacktrace": stack("a", "b")}, {"bug_id": 2, "creation_ts": 20, "dup_id": 1, "stacktrace": stack("x", "y")}, {"bug_id": 3, "creation_ts": 30, "dup_id": 1, "stacktrace": stack("a", "b")}]
    path = tmp_path / "reports.json"
    path.write_text(json.dumps(data))
    got = {r["query"]: (r["rank"], r["top_correct"]) for r in evaluate.ranks(spark, str(path)).collect()}
    assert got == {2: (99999, 0), 3: (0, 1)}
    assert evaluate.metrics(spark, str(path)).first()["rr1"] == 0.5


def test_threads_and_time(spark):
    row = spark.range(1).select(symbols.thread_numbers(F.array(*map(F.lit, [0, 1, 2, 0, 1, 0]))).alias("t"), symbols.report_time(F.lit(86400)).cast("long").alias("s")).first()
    assert row["t"] == [0, 0, 0, 1, 1, 2] and row["s"] == 86400
