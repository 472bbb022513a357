"""Ingest, symbols, stacks, scoring and chronology on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from tracelode.functions import registry, symbols
from tracelode.operators import buckets, scoring
from tracelode.plans import neural, search
from tracelode.sources import reports
from tracelode.streaming import progressive


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(xs, kind="bigint"):
    return F.array(*[F.lit(x) for x in xs]).cast(f"array<{kind}>")


@pytest.mark.parametrize("given,expected", [("foo(int, bar(x)) const", "foo const"), ("__GI_raise", "raise"), ("*__GI_abort", "*__GI_abort"), ("_IO_puts", "IO_puts")])
def test_function(spark, given, expected):
    assert one(spark, symbols.clean_function(F.lit(given))) == expected


def test_trim_and_library(spark):
    assert [one(spark, symbols.trim_function(F.lit("a.b.c"), n)) for n in (0, 1, 2, 3, 4)] == ["a.b.c", "a.b", "a", "", ""]
    assert [one(spark, symbols.clean_library(F.lit(x))) for x in ("/usr/lib/libc.so.6", "/x/libfoo.so.1.2")] == ["libc.so", "libfoo.so.1"]


@pytest.mark.parametrize("given,all_,edges", [(range(10), [3, 4, 6, 7, 8], [3, 4, 5, 6, 7, 8]), (range(3, 11), [3, 4, 6, 7, 8], [3, 4, 5, 6, 7, 8]), ([11, 5, 1, 0, 9, 2, 10], [], []), ([], [], [])])
def test_strip(spark, given, all_, edges):
    stop = lambda x: x.isin(0, 1, 2, 5, 9, 10, 11)
    assert one(spark, symbols.strip(arr(given), stop, False)) == all_
    assert one(spark, symbols.strip(arr(given), stop, True)) == edges


def test_prefix_and_merge(spark):
    p1, p2 = [10, 9, 8, 5, 4, 3, 2, 1, 0], [10, 9, 8, 7, 6, 5, 4, 1, 0]
    p3, p4 = [15, 22, 16, 26, 3, 2, 1, 0], [15, 22, 16, 26, 4, 3, 2, 1, 0]
    for q, c, prefix, merge in ((p1, p1, 1, 1), (p1, p2, 1 / 3, 1 / 3), (p1, p3, 0, 0), (p3, p4, 4 / 9, 0.5)):
        assert one(spark, symbols.prefix_match(arr(q), arr(c))) == pytest.approx(prefix)
        assert one(spark, symbols.overlap_merge(arr(q), arr(c))) == pytest.approx(merge)
    assert one(spark, symbols.overlap_merge(arr([]), arr(p1))) == 0


def test_fast(spark):
    df = lambda s: [(x + 1) / 40 for x in s]
    a, b = list(range(10, -1, -1)), [32, 2, 1, 0]
    rows = [(1, 1, a, df(a), a, df(a)), (1, 2, a, df(a), b, df(b))]
    got = scoring.fast(spark.createDataFrame(rows, "query int, cand int, q array<int>, qw array<double>, c array<int>, cw array<double>"), 1.0, 1.0, 1.0)
    assert {r["cand"]: round(r["score"], 9) for r in got.collect()} == {1: 1.0, 2: -0.665110710}


MATRIX = [[1, 5, 7, -999], [0, 60, 999.9, 2000], [2, 23, 44, -20]]


@pytest.mark.parametrize("kind,expected", [("max", 2000), ("avg_query", 683.666667), ("avg_cand", 765.475), ("avg_short", 683.666667), ("avg_long", 765.475), ("avg_query_cand", 724.570833)])
def test_aggregate(spark, kind, expected):
    rows = [(1, i, j, float(x)) for i, r in enumerate(MATRIX) for j, x in enumerate(r)]
    got = scoring.aggregate(spark.createDataFrame(rows, "k int, q_idx int, c_idx int, score double"), ["k"], kind).first()["score"]
    assert got == pytest.approx(expected, abs=1e-6)


def test_threshold(spark):
    shares = [0.63, 0.42, 0.88, 0.40, 0.65, 0.33, 0.02, 0.60, 0.10]
    vocab = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(shares)], "symbol string, df double")
    for bad in (0, -1, 2):
        with pytest.raises(ValueError):
            scoring.rarity_threshold(vocab, 1, bad)
    assert scoring.rarity_threshold(vocab, 1, 0.5).first()[0] == pytest.approx(0.6)  # the unknown symbol counts as 1
    assert scoring.rarity_threshold(vocab, 1, 1).first()[0] == pytest.approx(0.12)


def test_ingest(spark, tmp_path):
    frame = lambda n: {"function": n}
    data = [
        {"bug_id": 1, "creation_ts": "100", "dup_id": None, "stacktrace": {"frames": [frame("a(x)"), frame("b"), frame("b")], "nested": [{"frames": [frame("c"), frame("d"), frame("e")]}]}, "more": 1},
        {"bug_id": 2, "creation_ts": 50, "dup_id": 1, "stacktrace": [{"frames": [frame("a"), {"dylib": "/l/libz.so.1"}]}, {"frames": [frame("a"), {"dylib": "/l/libz.so.1"}]}, {"frames": []}]},
        {"bug_id": 3, "creation_ts": 70, "stacktrace": {"frames": [{"file": "nameless"}]}},
    ]
    path = tmp_path / "r.json"
    path.write_text(json.dumps(data))
    for found in (reports.read_reports(spark, str(path)), reports.from_rows(spark, [None, *data])):
        assert sorted(r["bug_id"] for r in found[0].collect()) == [1, 2]
        rows = {(r["bug_id"], r["stack_idx"], r["list_idx"]): r["frames"] for r in found[1].collect()}
        assert rows == {(1, 0, 0): ["c", "d", "e"], (1, 0, 1): ["a", "b"], (2, 0, 0): ["a", "libz.so"]}
    split = tmp_path / "s.txt"
    split.write_text("title\n1 2 3\n2\n")
    assert {r["bug_id"]: r["is_duplicate"] for r in reports.read_split(spark, str(split)).collect()} == {1: False, 2: True, 3: False}


def test_buckets(spark):
    rows = [(1, None, 5), (2, 1, 3), (3, 2, 9), (4, 99, 1), (5, 99, 2), (6, 6, 1), (7, 8, 4), (8, 7, 2)]
    got = buckets.resolve(spark.createDataFrame(rows, "bug_id long, dup_id long, ts long"))
    assert {r["bug_id"]: r["bucket_id"] for r in got.collect()} == {1: 2, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 8, 8: 8}


def test_rank_without_match(spark):
    rows = [(1, 10, 1, 0.5, False), (1, 11, 2, 0.5, True), (2, 10, 1, 0.1, False)]
    got = scoring.first_correct(spark.createDataFrame(rows, "query int, cand int, cand_pos int, score double, same boolean"))
    assert {r["query"]: (r["rank"], r["top_correct"]) for r in got.collect()} == {1: (0, 1), 2: (scoring.FAR, 0)}
    assert scoring.auc(got).first()[0] == 1.0


def test_stream_counts(spark, tmp_path):
    schema = "report long, ts long, is_dup boolean"
    spark.createDataFrame([(i, i, i % 2 == 0) for i in range(20)], schema).write.parquet(str(tmp_path / "in"))
    seen = []
    q = progressive.stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda e, b: seen.append(b.filter("is_dup").count()), lambda e, b: seen.append(b.count()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sum(seen[0::2]) == 10 and sum(seen[1::2]) == 20


def test_prequential_and_vocabulary(spark):
    rows = spark.createDataFrame([(i, i * 1000, i > 1, ["x", f"s{i % 3}"]) for i in range(12)], "report long, ts long, is_dup boolean, frames array<string>")
    v = progressive.Vocabulary()
    stacks = lambda p: p.select(F.col("report").alias("doc"), "ts", "frames")
    asked = progressive.prequential(rows, lambda n, a, p: (v.compute(stacks(p)), a.count())[1], lambda n, p: v.fit(stacks(p)))
    cut = progressive.chunks(rows).toPandas()
    assert asked == [len(g) - len(g) // 2 for g in (c[c.is_dup] for _, c in cut.sort_values("ts").groupby("chunk"))]
    got = {r["symbol"]: (r["id"], r["df"]) for r in v.table().collect()}
    assert got["x"] == (1, 12) and sorted(i for i, _ in got.values()) == [1, 2, 3, 4]
    with pytest.raises(ValueError):
        progressive.load_until(rows, 5, 4)


def test_search_and_registry(spark):
    t = search.Tuner("brodie", incremental=True)
    best = t.fit(lambda s: abs(s["gap"] - 4), 30)
    assert abs(best["gap"] - 4) < 2 and t.fit(lambda s: abs(s["gap"] - 4), 2)["gap"] == best["gap"]
    with pytest.raises(KeyError):
        registry.method("none")
    assert registry.load("tracelode.functions.registry.method") is registry.method
    registry.register(spark)
    assert spark.sql("select brodie(array(1L, 2L), array(1L, 2L), array(0.1D, 0.2D), array(0.1D, 0.2D)) as s").first()["s"] == pytest.approx(0.9 + 0.8 * 0.5)


def test_neural(spark):
    m = neural.BiLstm.seeded(10, 4, 3)
    stacks = spark.createDataFrame([(1, [1, 2, 3]), (2, [1, 2, 3]), (3, [4])], "id long, ids array<long>")
    v = {r["id"]: r["vec"] for r in neural.encode(stacks, m).collect()}
    assert v[1] == pytest.approx(v[2]) and v[1] != v[3] and sum(x * x for x in v[3]) == pytest.approx(1)
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "query long, cand long")
    assert neural.pair_scores(pairs, neural.encode(stacks, m), neural.PairClassifier.seeded(3, 6)).count() == 2
    rows = spark.createDataFrame([(i, i, i // 4) for i in range(16)], "report long, ts long, bucket long")
    for r in neural.triplets(rows, 3).collect():
        assert r["query"] // 4 == r["good"] // 4 != r["bad"] // 4


def test_prepared(spark):
    """Stripping comes before choosing; what is left empty goes."""
    rows = spark.createDataFrame([(1, 0, [9, 1, 9], [0.1, 0.5, 0.1]), (1, 1, [2, 9], [0.6, 0.1]), (2, 0, [9], [0.1]), (3, 0, [1, 9, 2], [0.5, 0.1, 0.6])], "report long, stack long, ids array<long>, shares array<double>")
    got = lambda **k: sorted((r["report"], r["stack"], r["ids"], r["shares"]) for r in scoring.prepared(rows, **k).collect())
    assert got(stop=(9,)) == [(1, 0, [1], [0.5]), (1, 1, [2], [0.6]), (3, 0, [1, 9, 2], [0.5, 0.1, 0.6])]
    assert got(stop=(9,), edges=False, keep="one") == [(1, 0, [1], [0.5]), (3, 0, [1, 2], [0.5, 0.6])]
    limit = spark.createDataFrame([(0.5,)], "threshold double")
    assert [r[:2] for r in got(stop=(9,), edges=False, keep="rare", threshold=limit)] == [(1, 0), (3, 0)]
    with pytest.raises(ValueError):
        scoring.prepared(rows, keep="rare")
