"""Gradients against differences, and losses that fall."""

import numpy as np
import pytest

from tracelode.plans import neural, training

Q, GOOD, BAD = [[1, 2, 3], [4]], [[1, 2], [4, 5]], [[5, 6, 0, 1], [2, 2]]


@pytest.mark.parametrize("kind", [None, 1, 2, 3, 4, 5])
def test_gradients(kind):
    m = neural.BiLstm.seeded(7, 3, 2)
    c = kind and neural.PairClassifier.seeded(kind, 4)
    loss, _, grads = training.gradients(m, c, Q, GOOD, BAD, margin=-0.5)
    rng = np.random.default_rng(0)
    for a, g in zip(training.parameters(m, c), grads):
        assert a.shape == g.shape
        for at in {tuple(rng.integers(0, n) for n in a.shape) for _ in range(4)}:
            keep, eps = a[at], 1e-6
            a[at] = keep + eps
            up = training.gradients(m, c, Q, GOOD, BAD, margin=-0.5)[0]
            a[at] = keep - eps
            down = training.gradients(m, c, Q, GOOD, BAD, margin=-0.5)[0]
            a[at] = keep
            assert g[at] == pytest.approx((up - down) / (2 * eps), abs=1e-5)


@pytest.mark.parametrize("kind", [None, 3])
def test_fit(spark, kind):
    m = neural.BiLstm.seeded(5, 3, 2)
    before = m.table.copy()
    rows = spark.createDataFrame(list(zip(Q, GOOD, BAD)) * 4, "q array<long>, good array<long>, bad array<long>")
    encoder, classifier, losses = training.fit(rows, m, kind and neural.PairClassifier.seeded(kind, 4), n_symbols=7, epochs=12, batches=1, rate=0.05)
    assert len(losses) == 12 and losses[-1] < losses[0] and len(encoder.table) == 7
    assert (m.table == before).all() and bool(classifier) == bool(kind)


def test_empty(spark):
    rows = spark.createDataFrame([], "q array<long>, good array<long>, bad array<long>")
    m = neural.BiLstm.seeded(5, 3, 2)
    got, _, losses = training.fit(rows, m, epochs=1, batches=1)
    assert not losses and (got.table == m.table).all()


def test_earlier_triplets(spark):
    rows = spark.createDataFrame([(i, i * 50_000, i % 4) for i in range(24)], "report long, ts long, bucket long")
    got = neural.triplets(rows, 2, earlier=True).collect()
    assert got and all(r["bad"] < r["query"] and r["query"] % 4 == r["good"] % 4 != r["bad"] % 4 for r in got)


def test_triplet_counts(spark):
    """Each duplicate with any report of another bucket gets exactly k draws, with a bucket of most rows, and draws cover all of those."""
    bucket = [0, 0, 0, 1, 0, 0, 2, 0, 1, 0, 0, 3, 0, 2, 0, 1, 0, 0]
    rows = spark.createDataFrame([(i, i * 50_000, b) for i, b in enumerate(bucket)], "report long, ts long, bucket long")
    for earlier in (True, False):
        got, want = {}, {}
        for r in neural.triplets(rows, 200, earlier=earlier).collect():
            assert bucket[r["query"]] == bucket[r["good"]] and r["good"] < r["query"]
            got.setdefault(r["query"], []).append(r["bad"])
        for i, b in enumerate(bucket):
            others = {j for j, c in enumerate(bucket) if c != b and (j < i or not earlier)}
            if b in bucket[:i] and others:
                want[i] = others
        assert {i: set(x) for i, x in got.items()} == want and all(len(x) == 200 for x in got.values())
