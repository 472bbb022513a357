"""Alignment scores over batches of pairs.

One dynamic-programming row is found for all pairs of a batch at once. Let a be the best of coming from above and from the diagonal,
and G the running sum of what moves to the right cost; the row is then the running maximum of a + G, less G. So each row takes a few
numpy operations over the batch. Symbols come as numbers, with their document shares where a method weighs them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NO_MATCH = -9999.0


def padded(rows, fill, kind):
    n = np.array([len(r) for r in rows], np.int64)
    out = np.full((len(n), max(1, n.max(initial=0))), fill, kind)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, n


class Batch:
    """Padded pairs: symbols a, b, lengths m, n, and weights of the symbols."""

    def __init__(self, q, c, qw=None, cw=None):
        self.a, self.m = padded(q, -1, np.int64)
        self.b, self.n = padded(c, -2, np.int64)
        self.wa = padded(qw, 0.0, np.float64)[0] if qw is not None else None
        self.wb = padded(cw, 0.0, np.float64)[0] if cw is not None else None
        self.j = np.arange(self.b.shape[1], dtype=np.float64)[None, :]

    def same(self, i):
        return self.a[:, i, None] == self.b

    def solve(self, first_row, first_col, up, right, diagonal, swap=None, smallest=False):
        """The last cell per pair. first_row: (B, n + 1); first_col(i), up(i): (B,) or number, for row i + 1; right: (B, n) or number, a cost;
        diagonal(i): (B, n); swap(i): (B, n), what a swap of neighbours adds to the cell two up and left, or None."""
        sign = -1.0 if smallest else 1.0
        size, width = self.b.shape
        g = np.concatenate([np.zeros((size, 1)), np.cumsum(np.broadcast_to(right, (size, width)), 1)], 1)
        row, before = sign * first_row, None
        got = row[np.arange(size), self.n].copy()
        for i in range(int(self.m.max(initial=0))):
            nxt = np.empty_like(row)
            nxt[:, 0] = sign * np.broadcast_to(first_col(i), size)
            nxt[:, 1:] = np.maximum(row[:, 1:] - np.broadcast_to(up(i), size)[:, None], row[:, :-1] + sign * diagonal(i))
            if swap is not None and before is not None:
                nxt[:, 2:] = np.maximum(nxt[:, 2:], before[:, :-2] + sign * swap(i)[:, 1:])
            nxt = np.maximum.accumulate(nxt + g, 1) - g
            before, row = row, nxt
            here = self.m == i + 1
            got[here] = row[here, self.n[here]]
        return sign * got


def brodie(x: Batch, gap: float):
    """Matches weigh by rarity, place in the query and distance; mismatches are free, gaps cost."""
    m = np.maximum(x.m, 1)
    steps = np.arange(x.b.shape[1] + 1)[None, :] * np.ones((len(x.m), 1))
    gain = lambda i: np.where(x.same(i), (1 - x.wa[:, i, None]) * (1 - i / m)[:, None] * np.exp(-np.abs(i - x.j) / 2), 0.0)
    return x.solve(-gap * steps, lambda i: -gap * (i + 1), lambda i: gap, gap, gain)


def optimal_alignment(x: Batch, indel: float, mismatch: float, match: float, strict: bool = False):
    """Global alignment, scaled between the worst case (nothing matches) and the best.

    The first column lags one row behind, as the expected results have it; strict gives the textbook column.
    """
    steps = np.arange(x.b.shape[1] + 1)[None, :] * np.ones((len(x.m), 1))
    col = lambda i: -indel * (i + 1 if strict else i)
    best = x.solve(-indel * steps, col, lambda i: indel, indel, lambda i: np.where(x.same(i), match, -mismatch))
    worst = x.solve(-indel * steps, col, lambda i: indel, indel, lambda i: np.full(x.b.shape, -mismatch))
    with np.errstate(divide="ignore", invalid="ignore"):
        return (best - worst) / (np.minimum(x.m, x.n) * match - worst)


def damerau(x: Batch, insert: float, delete: float, substitute: float, transpose: float, swaps: bool, strict: bool = False):
    """1 - distance / worst distance. The first row is shifted by one with a zero at its end, as expected results have it; strict: textbook."""
    k = np.arange(x.b.shape[1] + 1)[None, :]
    row = k * insert * np.ones((len(x.m), 1)) if strict else np.where(k < x.n[:, None], (k + 1) * insert, 0.0)

    def swap(i):
        left = np.concatenate([np.full((len(x.b), 1), -3), x.b[:, :-1]], 1)
        fits = (x.a[:, i, None] == left) & (x.a[:, i - 1, None] == x.b) & ~x.same(i)
        return np.where(fits, transpose, np.inf)

    col = lambda i: (i + 1) * delete
    got = x.solve(row, col, lambda i: delete, insert, lambda i: np.where(x.same(i), 0.0, substitute), swap if swaps else None, True)
    worst = x.solve(row, col, lambda i: delete, insert, lambda i: np.full(x.b.shape, substitute), None, True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - got / worst


def position_dependent(x: Batch, c: float, o: float):
    """Matches near the top and at like places count most; over the most that equal stacks of the shorter length reach."""
    zero = np.zeros((len(x.m), x.b.shape[1] + 1))
    got = x.solve(zero, lambda i: 0.0, lambda i: 0.0, 0.0, lambda i: np.where(x.same(i), np.exp(-c * np.minimum(i, x.j)) * np.exp(-o * np.abs(i - x.j)), 0.0))
    short = np.minimum(x.m, x.n)
    sums = np.concatenate([[0.0], np.cumsum(np.exp(-c * np.arange(int(short.max(initial=0)))))])
    with np.errstate(divide="ignore", invalid="ignore"):
        out = got / sums[short]
    return np.where((x.m == 0) & (x.n == 0), 1.0, np.where(short == 0, NO_MATCH, out))


def trace_weights(shares, df_coef, pos_coef, sigmoid, gamma, use_idf, reciprocal):
    p = np.arange(shares.shape[1], dtype=np.float64)[None, :]
    local = (p + 1) ** -pos_coef if reciprocal else np.exp(-pos_coef * p)
    value = np.log(1 / np.where(shares == 0, 1.0, shares)) if use_idf else shares
    if sigmoid:
        s = 1 / (1 + np.exp(-df_coef * (value - gamma)))
        return local * (s if use_idf else 1 - s)
    return local * np.exp(-df_coef * value)


def trace_sim(x: Batch, df_coef=0.5, pos_coef=1.0, diff_coef=1.0, match=1.0, gap=1.0, mismatch=1.0, sigmoid=True, gamma=1.0, use_sum=True, use_idf=True, const_match=False, reciprocal=True, no_norm=False):
    """Alignment whose gains and costs are the symbols' weights, by place and rarity."""
    if use_idf and not sigmoid:
        raise ValueError("the exponential weight takes no idf")
    ina, inb = np.arange(x.a.shape[1])[None, :] < x.m[:, None], np.arange(x.b.shape[1])[None, :] < x.n[:, None]
    args = (df_coef, pos_coef, sigmoid, gamma, use_idf, reciprocal)
    wa, wb = trace_weights(x.wa, *args) * ina, trace_weights(x.wb, *args) * inb
    first = np.concatenate([np.zeros((len(x.m), 1)), -gap * np.cumsum(wb, 1)], 1)
    cum = -gap * np.cumsum(wa, 1)

    def diagonal(i):
        top = np.maximum(wa[:, i, None], wb)
        hit = match * (1.0 if const_match else top * np.exp(-diff_coef * np.abs(i - x.j)))
        return np.where(x.same(i), hit, -mismatch * (wa[:, i, None] + wb if use_sum else top))

    got = x.solve(first, lambda i: cum[:, i], lambda i: gap * wa[:, i], gap * wb, diagonal)
    if no_norm:
        return got
    total = wa.sum(1) + wb.sum(1)
    return np.where(total == 0, 0.0, got / np.where(total == 0, 1.0, total))


def fast(p: Batch, alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.0) -> np.ndarray:
    """The k-th occurrence of a symbol on one side meets the k-th on the other: a gain by both weights and the distance of places; what
    meets nothing costs its weight. All pairs of the batch are sorted at once."""

    def side(x, n, share):
        pair, pos = np.nonzero(np.arange(x.shape[1]) < n[:, None])
        symbol = x[pair, pos]
        weight = (pos + 1.0) ** -alpha * np.exp(-beta * share[pair, pos])
        order = np.lexsort((pos, symbol, pair))
        new = np.r_[True, (np.diff(pair[order]) != 0) | (np.diff(symbol[order]) != 0)][: len(order)]
        run = np.arange(len(order))
        nth = run - np.maximum.accumulate(np.where(new, run, 0))
        return pair[order], symbol[order], nth, pos[order], weight[order]

    pair, symbol, nth, pos, weight = (np.concatenate(x) for x in zip(side(p.a, p.m, p.wa), side(p.b, p.n, p.wb)))
    order = np.lexsort((nth, symbol, pair))  # stable: the query's side first
    pair, symbol, nth, pos, weight = (x[order] for x in (pair, symbol, nth, pos, weight))
    met = np.flatnonzero((pair[1:] == pair[:-1]) & (symbol[1:] == symbol[:-1]) & (nth[1:] == nth[:-1]))
    total = np.bincount(pair, weight, len(p.m))
    both = weight[met] + weight[met + 1]
    gain = np.bincount(pair[met], both * (1 + np.exp(-gamma * np.abs(pos[met] - pos[met + 1]))), len(p.m)) - total
    return np.divide(gain, total, out=np.full(len(total), np.nan), where=total > 0)


METHODS = {"fast": fast, "brodie": brodie, "optimal_alignment": optimal_alignment, "damerau": damerau, "position_dependent": position_dependent, "trace_sim": trace_sim}


def similarity(method: str, *args, **named):
    """A function of the columns (query symbols, candidate symbols, query shares, candidate shares) -> score, batched over Arrow.

    Pairs of a batch are solved in groups of like length, so that padding stays small.
    """
    of = METHODS[method]

    @F.pandas_udf("double")
    def score(q: pd.Series, c: pd.Series, qw: pd.Series, cw: pd.Series) -> pd.Series:
        out = np.full(len(q), np.nan)
        longest = np.maximum(q.map(len).to_numpy(), c.map(len).to_numpy())
        order = np.argsort(longest, kind="stable")
        cells = np.cumsum((longest[order] + 1.0) ** 2)
        for at in np.split(order, np.flatnonzero(np.diff(cells // 2_000_000)) + 1):
            if len(at):
                out[at] = of(Batch(*(x.iloc[at].tolist() for x in (q, c, qw, cw))), *args, **named)
        return pd.Series(out)

    def call(q: Column, c: Column, qw: Column, cw: Column) -> Column:
        return score(q.cast("array<bigint>"), c.cast("array<bigint>"), qw, cw)

    return call
