"""Toxic passages: maximal scoring segments over token log-odds, calibrated as extreme values.

Fit. A bounded sample of labelled rows (SAMPLE_TOXIC and SAMPLE_CLEAN at most, by hash of the id) gives, for each word and each
word start of four to six letters, the number of different contexts (word before, word, word after) per class; counting contexts
keeps a text and its copies from counting twice. Log-odds between classes under a Dirichlet prior in proportion to the pooled
counts score the terms; terms whose excess in toxic texts is beyond chance over all terms (Chernoff bound) and whose log-odds are
large make the lexicon. The bound on the sample bounds the lexicon: a term needs several toxic contexts of its own.

Score. Lexicon words score their log-odds, other words a small loss; all maximal scoring segments come out in one linear scan.
Under the clean texts' score distribution a segment of score S is due with expectation E = K n exp(-lambda S) among n words; the
sum of the r best normalised scores is kept for the r that is least likely, and a logistic fit on the sample turns it into 0..1.

Defined cases: null, empty and wordless texts have no segment and get the score of no evidence, below 0.5. Without labels of both
classes the lexicon is empty and every score is the same. Duplicate label rows count as toxic if any is; of several texts
under one labelled id the first by code point is learned from. Evidence counts up to 30, where every score is 1 or nearly so. Extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialize

SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 6000
STARTS = (4, 5, 6)
WORD = re.compile(r"\w+")
LEAST_ODDS = 1.5


@dataclass
class Model:
    lexicon: dict = field(default_factory=dict)
    loss: float = 0.25
    decay: float = 1.0
    scale: float = 1.0
    weight: float = 1.0
    bias: float = -4.0


def word_score(word: str, lexicon: dict) -> float:
    best = lexicon.get(word, 0.0)
    for k in STARTS:
        if len(word) > k:
            best = max(best, lexicon.get(word[:k] + "*", 0.0))
    return best


def maximal_segments(at: list[int], scores: list[float], loss: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last), given the positions of positive scores; all other positions score -loss.

    Linear: each kept segment remembers the nearest earlier one whose left sum is smaller.
    """
    kept: list[tuple[float, float, int, int, int]] = []
    total, before = 0.0, -1
    for p, s in zip(at, scores):
        total -= loss * (p - before - 1)
        before = p
        left, first = total, p
        total += s
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][0] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= total:
                kept.append((left, total, first, p, j))
                break
            left, first, link = kept[j][0], kept[j][2], kept[j][4]
            del kept[j:]
            j = link
    return [(r - l, a, b) for l, r, a, b, _ in kept]


def evidence(segments: list[tuple[float, int, int]], n: int, m: Model) -> float:
    """The largest, over r, of the sum of the r best normalised scores, with the ways to order them; 0 without a segment."""
    best = total = 0.0
    for r, (s, _, _) in enumerate(sorted(segments, reverse=True), 1):
        total += m.decay * s - math.log(max(m.scale * n, 1.0))
        best = max(best, total + math.lgamma(r + 1))
    return best


def judge(text: str | None, m: Model, memo: dict) -> tuple[float, int, list[tuple[float, int, int]]]:
    words = WORD.findall(text.lower()) if text else []
    at, scores = [], []
    for i, w in enumerate(words):
        s = memo.get(w)
        if s is None:
            if len(memo) >= 200_000:
                memo.clear()
            s = memo[w] = word_score(w, m.lexicon)
        if s > 0:
            at.append(i)
            scores.append(s)
    segments = maximal_segments(at, scores, m.loss)
    return evidence(segments, len(words), m), len(words), segments


def contexts(sample: DataFrame) -> DataFrame:
    """(word, toxic, n): different contexts of each word in each class."""

    def run(batches):
        import numpy as np
        import xxhash

        of = xxhash.xxh3_64_intdigest
        for batch in batches:
            words, kinds, keys = [], [], []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = WORD.findall((text or "").lower())
                seen = set(zip(["", *ws], ws, [*ws[1:], ""]))
                words += [w for _, w, _ in seen]
                kinds += [toxic] * len(seen)
                keys += [of("\0".join(x)) for x in seen]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(kinds, pa.int32()), pa.array(np.array(keys, np.uint64).view(np.int64))], names=["word", "toxic", "key"])

    rows = sample.select("text", F.col("toxic").cast("int")).mapInArrow(run, "word string, toxic int, key long")
    return rows.distinct().groupBy("word", "toxic").agg(F.count("*").alias("n"))


def solve_decay(gain: float, share: float, loss: float) -> float:
    """The positive root of E[exp(x s)] = 1 for scores of gain with the given share, and -loss else."""
    low, high = 1e-6, 50.0 / gain
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if share * math.exp(mid * gain) + (1 - share) * math.exp(-mid * loss) < 1 else (low, mid)
    return low


def fit(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0) -> Model:
    """Learn from labelled rows that are not held out."""
    of = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id"), mod, rest))
    totals = {r["toxic"]: r["n"] for r in of.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    m = Model()
    if len(totals) < 2:
        return m
    pick = [of.filter(c).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k) for c, k in (("toxic > 0", SAMPLE_TOXIC), ("toxic <= 0", SAMPLE_CLEAN))]
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(pick[0].union(pick[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "sample")

    counts = contexts(sample)
    terms = counts.select(F.explode(F.array_distinct(F.array("word", *[F.when(F.length("word") > k, F.concat(F.substring("word", 1, k), F.lit("*"))) for k in STARTS]))).alias("term"), "toxic", "n").filter("term is not null")
    terms = terms.groupBy("term").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c"))
    terms = materialize(terms, "terms")
    s = terms.filter(~F.col("term").endswith("*")).agg(F.sum("t").alias("t"), F.sum("c").alias("c")).first()
    n_terms = terms.count()
    nt, nc = s["t"] or 0, s["c"] or 0
    if not nt or not nc:
        return m
    share = nt / (nt + nc)
    n, q = F.col("t") + F.col("c"), F.least(F.col("t") / (F.col("t") + F.col("c")), F.lit(1 - 1e-12))
    surprise = n * (q * F.log(q / share) + (1 - q) * F.log((1 - q) / (1 - share)))
    prior = n * 0.05
    a0 = (nt + nc) * 0.05
    odds = F.log((F.col("t") + prior) / (nt + a0 - F.col("t") - prior)) - F.log((F.col("c") + prior) / (nc + a0 - F.col("c") - prior))
    found = terms.filter((F.col("t") > 0) & (q > share) & (surprise >= math.log(n_terms) + 3)).select("term", "t", "c", odds.alias("odds")).filter(F.col("odds") >= LEAST_ODDS)
    rows = found.collect()  # bounded by the sample: each term has several toxic contexts
    m.lexicon = {r["term"]: r["odds"] for r in rows}
    if rows:
        whole = [r for r in rows if not r["term"].endswith("*")] or rows
        seen = sum(r["c"] for r in whole)
        m.decay = solve_decay(max(m.lexicon.values()), (seen + 0.5) / (nc + 1), m.loss)

    def run(batches):
        memo: dict = {}
        for batch in batches:
            got = [judge(t, m, memo) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([max([0.0, *(s for s, _, _ in g[2])]) for g in got]), pa.array([g[1] for g in got], pa.int64()), pa.array([g[0] for g in got], pa.float64())], names=["toxic", "top", "n", "x"])

    seen = sample.select("text", "toxic").mapInArrow(run, "toxic int, top double, n long, x double").collect()  # as many rows as the sample
    tops = [m.decay * r["top"] - math.log(r["n"]) for r in seen if r["toxic"] == 0 and r["top"] > 0]
    if len(tops) >= 30:  # Gumbel location by moments over clean texts
        m.scale = min(1.0, math.exp(sum(tops) / len(tops) - 0.5772))
    base = math.log(max(totals.get(True, 0), 1) / max(totals.get(False, 0), 1))
    m.weight, m.bias = logistic([r["x"] for r in seen], [r["toxic"] for r in seen], base)
    return m


def logistic(x: list[float], y: list[int], base: float) -> tuple[float, float]:
    """Weight and bias by Newton steps with a small ridge; the bias is set to the labels' own share, whatever the sample's."""
    import numpy as np

    x, y = np.minimum(np.array(x, float), 30.0), np.array(y, float)
    w = np.array([0.0, 0.0])
    a = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 0.01 * w
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.01 * np.eye(2), grad)
    own = math.log(max(y.sum(), 1) / max(len(y) - y.sum(), 1))
    return max(float(w[0]), 1e-3), float(w[1]) + base - own


def score(docs: DataFrame, m: Model) -> DataFrame:
    """(id, score, n_words, passages) for every row; passages are (first, last, score, e_value) with E at most 0.05, in word positions."""

    def run(batches):
        memo: dict = {}
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
        for batch in batches:
            out, ns, ps = [], [], []
            for text in batch.column(1).to_pylist():
                x, n, segments = judge(text, m, memo)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, m.weight * min(x, 30.0) + m.bias)))))
                ns.append(n)
                ps.append([{"first": a, "last": b, "score": s, "e_value": e} for s, a, b in segments if (e := m.scale * max(n, 1) * math.exp(-m.decay * s)) <= 0.05])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array(ns, pa.int64()), pa.array(ps, kind)], names=["id", "score", "n_words", "passages"])

    return docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string")).mapInArrow(run, "id long, score double, n_words long, passages array<struct<first int, last int, score double, e_value double>>")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(docs, fit(docs, labels))
    return out.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def filter_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is below 0.5, with their own columns; scored in place, without a join."""
    m = fit(docs, labels)

    def run(batches):
        memo: dict = {}
        for batch in batches:
            keep = [m.weight * min(judge(t, m, memo)[0], 30.0) + m.bias < 0 for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
