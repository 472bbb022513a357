"""Sequence encoders and pair classifiers over stacks: forward passes, triplets and losses, with numpy in Arrow batches.

Weights are arrays drawn from a seed or handed in; no framework is needed. Encoded stacks go to operators.knn as vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import DAY, before


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


@dataclass
class BiLstm:
    """Embedding table and two LSTM directions; gates in the order input, forget, cell, output."""

    table: np.ndarray
    forward: tuple[np.ndarray, np.ndarray, np.ndarray]
    backward: tuple[np.ndarray, np.ndarray, np.ndarray]

    @classmethod
    def seeded(cls, n_symbols: int, embed: int, hidden: int, seed: int = 0) -> BiLstm:
        rng = np.random.default_rng(seed)
        k = 1 / np.sqrt(hidden)
        side = lambda: (rng.uniform(-k, k, (embed, 4 * hidden)), rng.uniform(-k, k, (hidden, 4 * hidden)), rng.uniform(-k, k, 4 * hidden))
        return cls(rng.standard_normal((n_symbols, embed)), side(), side())

    def grown(self, n_symbols: int, seed: int = 0) -> BiLstm:
        """A larger embedding table whose old rows stay."""
        more = np.random.default_rng(seed).standard_normal((max(0, n_symbols - len(self.table)), self.table.shape[1]))
        return BiLstm(np.concatenate([self.table, more]), self.forward, self.backward)

    def run(self, ids: np.ndarray, lengths: np.ndarray, weights) -> np.ndarray:
        wx, wh, b = weights
        size = wh.shape[0]
        h = c = np.zeros((len(ids), size))
        for t in range(ids.shape[1]):
            i, f, g, o = np.split(self.table[ids[:, t]] @ wx + h @ wh + b, 4, axis=1)
            c2 = sigmoid(f) * c + sigmoid(i) * np.tanh(g)
            h2 = sigmoid(o) * np.tanh(c2)
            on = (t < lengths)[:, None]
            h, c = np.where(on, h2, h), np.where(on, c2, c)
        return h

    def encode(self, stacks: list[list[int]]) -> np.ndarray:
        """Last forward state and last backward state of each stack; stacks are padded to the longest of the batch."""
        n = np.array([len(s) for s in stacks])
        ids, back = (np.zeros((len(n), max(1, n.max(initial=0))), np.int64) for _ in range(2))
        for i, s in enumerate(stacks):
            ids[i, : len(s)], back[i, : len(s)] = s, s[::-1]
        return np.concatenate([self.run(ids, n, self.forward), self.run(back, n, self.backward)], 1)


@dataclass
class PairClassifier:
    """Features of two encodings -> linear, relu, linear to two logits, of which the second is the score; one output gives itself."""

    kind: int
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def seeded(cls, kind: int, width: int, outputs: int = 2, seed: int = 1) -> PairClassifier:
        rng = np.random.default_rng(seed)
        n = width * {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}[kind]
        return cls(kind, rng.standard_normal((n, n // 2)) / np.sqrt(n), np.zeros(n // 2), rng.standard_normal((n // 2, outputs)) / np.sqrt(n), np.zeros(outputs))

    def score(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.outputs(a, b)[:, -1]

    def outputs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        apart, mean, product = np.abs(a - b), (a + b) / 2, a * b
        x = np.concatenate({1: [apart], 2: [apart, mean], 3: [apart, mean, product], 4: [apart, a, b, product], 5: [apart, a, b, mean, product]}[self.kind], 1)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def encode(stacks: DataFrame, model: BiLstm, unit: bool = True) -> DataFrame:
    """(id, ids) -> (id, vec), optionally of unit length: the index of candidates."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                v = model.encode(part.column(1).to_pylist())
                if unit:
                    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(v.tolist(), pa.list_(pa.float64()))], names=["id", "vec"])

    return stacks.select(F.col("id").cast("long"), F.col("ids").cast("array<bigint>")).mapInArrow(run, "id long, vec array<double>")


def pair_scores(pairs: DataFrame, vectors: DataFrame, model: PairClassifier) -> DataFrame:
    """(query, cand) with the classifier's score of their vectors."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = model.score(*(np.array(batch.column(c).to_pylist()) for c in ("a", "b")))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["query", "cand", "score"])

    a, b = vectors.select(F.col("id").alias("query"), F.col("vec").alias("a")), vectors.select(F.col("id").alias("cand"), F.col("vec").alias("b"))
    return pairs.select("query", "cand").join(a, "query").join(b, "cand").select("query", "cand", "a", "b").mapInArrow(run, "query long, cand long, score double")


def best_floor(scores: DataFrame) -> DataFrame:
    """Best score over a query report's stacks, at least 0."""
    return scores.groupBy("query", "cand").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))


def triplets(rows: DataFrame, k: int, seed: int = 0, earlier: bool = False) -> DataFrame:
    """(report, ts, bucket) -> (query, good, bad): per duplicate k draws, with replacement, of a report of its bucket and one of another.

    Draws are by index: members of a bucket have numbers, and a seeded hash picks one; all reports have numbers too, in order of time,
    and a bad one is picked among the reports outside the bucket: pick j is number j + m, m being the members of the bucket that have
    at most j reports of others before them. With `earlier`, bad ones come from reports before the query only. A duplicate gets k
    draws, or none where there is no report of another bucket to draw.
    """
    in_bucket, total = Window.partitionBy("bucket").orderBy("ts", "report"), Window.partitionBy("bucket")
    numbered = rows.withColumn("i", F.row_number().over(in_bucket) - 1).withColumn("n", F.count("*").over(total))
    placed = before(numbered, F.floor(F.col("ts") / DAY), ["ts", "report"], F.lit(1), "p")
    size = placed.agg(F.max("p").alias("last")).first()["last"] or 0
    others = F.col("p") - F.col("i") if earlier else F.lit(size + 1) - F.col("n")
    asked = placed.filter("i > 0").withColumn("others", others).filter("others > 0")
    asked = asked.select(F.col("report").alias("query"), F.col("bucket").alias("qb"), F.col("i").alias("qi"), "others", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("draw"))
    pick = lambda salt, n: F.pmod(F.xxhash64("query", "draw", F.lit(seed), F.lit(salt)), n)
    asked = asked.withColumn("gi", pick("good", F.col("qi"))).withColumn("j", pick("bad", F.col("others")))
    own = placed.select(F.col("bucket").alias("qb"), (F.col("p") - F.col("i")).alias("j"), F.lit(1).alias("own"))
    upto = Window.partitionBy("qb").orderBy("j", F.desc("own")).rowsBetween(Window.unboundedPreceding, 0)
    both = asked.withColumn("own", F.lit(0)).unionByName(own, allowMissingColumns=True)
    asked = both.withColumn("bp", F.col("j") + F.sum("own").over(upto)).filter("own = 0")
    good = placed.select(F.col("bucket").alias("b1"), F.col("i").alias("i1"), F.col("report").alias("good"))
    bad = placed.select(F.col("p").alias("p1"), F.col("report").alias("bad"))
    got = asked.join(good, (F.col("qb") == F.col("b1")) & (F.col("gi") == F.col("i1"))).join(bad, F.col("bp") == F.col("p1"))
    return got.select("query", "good", "bad", "draw")


def ranking_loss(good: np.ndarray, bad: np.ndarray) -> float:
    """Cross-entropy of the difference of scores against 1."""
    return float(np.mean(np.log1p(np.exp(-(good - bad)))))


def cosine_loss(q: np.ndarray, other: np.ndarray, target: np.ndarray, margin: float = 0.5) -> float:
    """1 - cosine for pairs of target 1; for -1, what the cosine is above the margin."""
    cos = (q * other).sum(1) / np.maximum(np.linalg.norm(q, axis=1) * np.linalg.norm(other, axis=1), 1e-12)
    return float(np.mean(np.where(target > 0, 1 - cos, np.maximum(0, cos - margin))))


def triplet_loss(q: np.ndarray, good: np.ndarray, bad: np.ndarray, margin: float = 0.5, metric: str = "cosine") -> float:
    if metric == "cosine":
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        near, far = (1 - (unit(q) * unit(x)).sum(1) for x in (good, bad))
    else:
        near, far = (np.linalg.norm(q - x, axis=1) for x in (good, bad))
    return float(np.mean(np.maximum(0, near - far + margin)))
