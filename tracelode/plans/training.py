"""Training of encoders and pair classifiers on triplets: gradients summed over partitions, one Adam step a batch on the driver.

Triplets are rows (q, good, bad) of symbol ids. Each batch is a hash slice of them; a partition sends one row, the sum of its
gradients, as large as the model and no larger. The driver holds the model and its moments.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neural import BiLstm, PairClassifier, sigmoid

TINY = 1e-12


def padded(stacks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(s) for s in stacks])
    ids, back = (np.zeros((len(n), max(1, n.max(initial=0))), np.int64) for _ in range(2))
    for i, s in enumerate(stacks):
        ids[i, : len(s)], back[i, : len(s)] = s, s[::-1]
    return ids, back, n


def unroll(table, ids, n, weights):
    """Last states of one direction, and what its gradient needs."""
    wx, wh, b = weights
    h = c = np.zeros((len(ids), wh.shape[0]))
    steps = []
    for t in range(ids.shape[1]):
        x, on = table[ids[:, t]], (t < n)[:, None]
        zi, zf, zg, zo = np.split(x @ wx + h @ wh + b, 4, axis=1)
        i, f, g, o = sigmoid(zi), sigmoid(zf), np.tanh(zg), sigmoid(zo)
        new = f * c + i * g
        squashed = np.tanh(new)
        steps.append((x, h, c, i, f, g, o, squashed, on))
        h, c = np.where(on, o * squashed, h), np.where(on, new, c)
    return h, steps


def unroll_back(dh, ids, steps, weights, dtable):
    """Gradients of (wx, wh, b) for a gradient of the last states; adds that of the embedding table."""
    wx, wh, b = weights
    dwx, dwh, db, dc = np.zeros_like(wx), np.zeros_like(wh), np.zeros_like(b), np.zeros_like(dh)
    for t in reversed(range(len(steps))):
        x, h, c, i, f, g, o, squashed, on = steps[t]
        out = dh * on
        cell = dc * on + out * o * (1 - squashed**2)
        dz = np.concatenate([cell * g * i * (1 - i), cell * c * f * (1 - f), cell * i * (1 - g**2), out * squashed * o * (1 - o)], 1)
        dwx += x.T @ dz
        dwh += h.T @ dz
        db += dz.sum(0)
        np.add.at(dtable, ids[:, t], dz @ wx.T)
        dh, dc = dz @ wh.T + dh * ~on, cell * f + dc * ~on
    return dwx, dwh, db


def cosine_terms(q, x, target: int, margin: float):
    """Losses of rows by cosine, and the gradients of both sides."""
    a, b = (np.maximum(np.linalg.norm(v, axis=1, keepdims=True), TINY) for v in (q, x))
    cos = (q * x).sum(1, keepdims=True) / (a * b)
    slope = -np.ones_like(cos) if target > 0 else (cos > margin).astype(float)
    loss = 1 - cos if target > 0 else np.maximum(0, cos - margin)
    return loss.ravel(), slope * (x / (a * b) - cos * q / a**2), slope * (q / (a * b) - cos * x / b**2)


def classifier_back(m: PairClassifier, a, b, dout):
    """Gradients of (w1, b1, w2, b2) and of both encodings, for a gradient of the outputs."""
    k = a.shape[1]
    parts = {1: "d", 2: "dm", 3: "dmp", 4: "dabp", 5: "dabmp"}[m.kind]
    made = {"d": np.abs(a - b), "m": (a + b) / 2, "p": a * b, "a": a, "b": b}
    x = np.concatenate([made[p] for p in parts], 1)
    hidden = np.maximum(x @ m.w1 + m.b1, 0)
    dh = (dout @ m.w2.T) * (hidden > 0)
    dx = dh @ m.w1.T
    da, db = np.zeros_like(a), np.zeros_like(b)
    for at, p in enumerate(parts):
        g = dx[:, at * k : (at + 1) * k]
        left, right = {"d": (np.sign(a - b), -np.sign(a - b)), "m": (0.5, 0.5), "p": (b, a), "a": (1.0, 0.0), "b": (0.0, 1.0)}[p]
        da, db = da + g * left, db + g * right
    return [x.T @ dh, dh.sum(0), hidden.T @ dout, dout.sum(0)], da, db


def parameters(encoder: BiLstm, classifier: PairClassifier | None) -> list[np.ndarray]:
    own = [encoder.table, *encoder.forward, *encoder.backward]
    return own + ([classifier.w1, classifier.b1, classifier.w2, classifier.b2] if classifier else [])


def gradients(encoder: BiLstm, classifier: PairClassifier | None, q, good, bad, margin: float = 0.5):
    """(summed loss, rows it is the mean of, summed gradients in the order of parameters()).

    With a classifier: cross-entropy of the outputs for (q, good) minus those for (q, bad), against the second one. Without: the
    cosine embedding loss over both pairs.
    """
    k = len(q)
    ids, back, n = padded([*q, *good, *bad])
    (ahead, s1), (behind, s2) = unroll(encoder.table, ids, n, encoder.forward), unroll(encoder.table, back, n, encoder.backward)
    v = np.concatenate([ahead, behind], 1)
    vq, vg, vb = v[:k], v[k : 2 * k], v[2 * k :]
    if classifier:
        d = classifier.outputs(vq, vg) - classifier.outputs(vq, vb)
        top = d.max(1, keepdims=True)
        logp = d - top - np.log(np.exp(d - top).sum(1, keepdims=True))
        dd = np.exp(logp)
        dd[:, 1] -= 1
        g1, dq1, dg = classifier_back(classifier, vq, vg, dd)
        g2, dq2, db = classifier_back(classifier, vq, vb, -dd)
        loss, rows, dq, more = -logp[:, 1].sum(), k, dq1 + dq2, [x + y for x, y in zip(g1, g2)]
    else:
        l1, dq1, dg = cosine_terms(vq, vg, 1, margin)
        l2, dq2, db = cosine_terms(vq, vb, -1, margin)
        loss, rows, dq, more = l1.sum() + l2.sum(), 2 * k, dq1 + dq2, []
    dv = np.concatenate([dq, dg, db])
    h, dtable = ahead.shape[1], np.zeros_like(encoder.table)
    one, two = unroll_back(dv[:, :h], ids, s1, encoder.forward, dtable), unroll_back(dv[:, h:], back, s2, encoder.backward, dtable)
    return float(loss), rows, [dtable, *one, *two, *more]


def packed(arrays: list[np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


@dataclass
class Adam:
    rate: float = 1e-4
    step: int = 0
    moments: list | None = None

    def update(self, arrays: list[np.ndarray], grads: list[np.ndarray]) -> None:
        """Change the arrays in place."""
        self.moments = self.moments or [(np.zeros_like(a), np.zeros_like(a)) for a in arrays]
        self.step += 1
        for a, g, (m, v) in zip(arrays, grads, self.moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


def batch_gradients(rows: DataFrame, encoder: BiLstm, classifier: PairClassifier | None, margin: float):
    """(mean loss, mean gradients) over rows (q, good, bad); None for an empty batch."""

    def run(batches):
        loss = n = 0
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                l, k, g = gradients(encoder, classifier, *(c.to_pylist() for c in part.columns), margin)
                loss, n, total = loss + l, n + k, g if total is None else [x + y for x, y in zip(total, g)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([float(loss)]), pa.array([n], pa.int64()), pa.array([packed(total)], pa.binary())], names=["loss", "n", "grads"])

    loss = n = 0
    total = None
    for r in rows.mapInArrow(run, "loss double, n long, grads binary").toLocalIterator():  # one partition's sum at a time
        got = np.load(io.BytesIO(r["grads"]))
        each = [got[k] for k in got.files]
        loss, n, total = loss + r["loss"], n + r["n"], each if total is None else [x + y for x, y in zip(total, each)]
    return None if total is None else (loss / n, [g / n for g in total])


def fit(triplets: DataFrame, encoder: BiLstm, classifier: PairClassifier | None = None, n_symbols: int | None = None, epochs: int = 4, batches: int = 8, rate: float = 1e-4, margin: float = 0.5, seed: int = 0):
    """(encoder, classifier, losses): trained copies, with a new optimizer; a larger vocabulary first grows the embedding table, old rows kept.

    triplets: (q, good, bad) arrays of symbol ids. Each epoch goes over all of them in `batches` slices, dealt anew by a seeded hash.
    """
    encoder = encoder.grown(n_symbols or len(encoder.table), seed)
    encoder = BiLstm(encoder.table.copy(), tuple(x.copy() for x in encoder.forward), tuple(x.copy() for x in encoder.backward))
    classifier = classifier and PairClassifier(classifier.kind, *(x.copy() for x in (classifier.w1, classifier.b1, classifier.w2, classifier.b2)))
    rows = triplets.select(*[F.col(c).cast("array<bigint>").alias(c) for c in ("q", "good", "bad")])
    adam, losses = Adam(rate), []
    for epoch in range(epochs):
        dealt = rows.withColumn("slice_", F.pmod(F.xxhash64("q", "good", "bad", F.lit(seed * 1000 + epoch)), F.lit(batches)))
        for i in range(batches):
            got = batch_gradients(dealt.filter(F.col("slice_") == i).drop("slice_"), encoder, classifier, margin)
            if got:
                losses.append(got[0])
                adam.update(parameters(encoder, classifier), got[1])
    return encoder, classifier, losses
