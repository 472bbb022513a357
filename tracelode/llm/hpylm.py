"""Text probabilities from a hierarchical Pitman-Yor model with Chinese-restaurant seating sampled by Gibbs.

Every word of the training texts, and the end of a text, has a context restaurant for what follows it. Context restaurants share
the parent restaurant of words, whose parent is uniform over the distinct words and one for all unknown. A cell is a pair (context,
word) with its count of customers over all training texts; there are as many cells as distinct pairs, and nothing about them
reaches the driver but sums.

Seating. A Gibbs step takes all customers of a context's cells from their tables and seats them anew, one after another, given the
parent as of the last round: an exact draw of each cell's number of tables, by one law at all sizes (`seat`). CHAINS chains run
side by side over ROUNDS rounds, each from one table a cell; the parent's customers, one for each table below, are seated the same
way. The predictive probability, which sums to one over words, is averaged over the chains. Random numbers come from hashes of (context,
word, chain, round), so that scores don't depend on how rows, chunks and buckets lie.

Words meet texts by chunk, a run of rows of one input partition of about CHUNK bytes: one scan writes texts as local word numbers and
a chunk's distinct words as sorted 63-bit hashes with counts. Ranges of hashes sum the words and number the training ones by hash.
A chunk sends its distinct pairs to buckets, a square grid over classes of (context, word), so that neither a frequent context nor a
frequent word gathers in one bucket; a class is SPLIT ranges, and the grid grows with the tokens, to about CELLS tokens a bucket. Each
round, buckets send tables per context and word to the ranges of words, which seat the parent and answer. At last buckets answer
chunks with customers and tables per pair, ranges with sums per word, and the chunk adds log10 of the probabilities along its texts.

Messages are sorted numbers as differences, in byte planes under zstandard. With few chunks there is one message for each pair of
chunk and bucket; with very many, messages shrink towards a row for each of a chunk's pairs, never more.

Defined cases: null and empty texts are the end alone; without training texts counts are 0, N and V are 0 and the one dish is
certain; repeated rows are scored each and, in training, counted each; a null id is in training; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from math import ceil, expm1, floor, log, sqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_list, discard, held_out, materialize, mixed, release

CHUNK, CELLS, SPLIT, CHAINS, ROUNDS, SPAN, FEW, ROWS, NODES = 16 << 20, 1 << 20, 16, 3, 3, 1 << 20, 16, 2048, 96
STRENGTH = 1.0
TEXTS, LOCAL, SPELLED, KNOWN, COUNTS, ONES, ASK, ASKED, STATE, PART_U, PART_W, REPLY_U, REPLY_W, TOTAL, WORDS, ANSWER = range(16)
MESSAGE = "kind int, src long, dst long, a binary, b binary, c binary, d binary, x double, y double"


def shrink(x) -> bytes:
    """A numpy array as byte planes, compressed."""
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).view(np.uint8).reshape(x.size, x.dtype.itemsize).T.tobytes())


def grow(raw: bytes, kind: str = "<i8"):
    import numpy as np
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, len(planes) // size).T).view(kind).ravel()


def shrink_sorted(x) -> bytes:
    import numpy as np

    return shrink(np.diff(x, prepend=x.dtype.type(0)).astype(np.int64))


def grow_sorted(raw: bytes):
    return grow(raw).cumsum()


def messages(rows: list[tuple]) -> pa.Table:
    """Rows of MESSAGE; what a row doesn't name at its end is null."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.float64(), pa.float64()]
    names = [f.split()[0] for f in MESSAGE.split(", ")]
    full = [(*r, *[None] * (len(names) - len(r))) for r in rows]
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*full) if full else [[]] * len(names), kinds)], names=names)


def by_kind(got: pa.Table) -> dict[int, list[dict]]:
    """A group's messages by kind, each in order of their senders."""
    out: dict[int, list[dict]] = {}
    for r in sorted(got.to_pylist(), key=lambda r: (r["kind"], r["src"])):
        out.setdefault(r["kind"], []).append(r)
    return out


def joined(rows: list[dict], name: str, read=grow):
    import numpy as np

    return np.concatenate([read(r[name]) for r in rows]) if rows else np.zeros(0, np.int64)


def by_chain(rows: list[dict], name: str):
    """Arrays of CHAINS lines side by side."""
    import numpy as np

    return np.concatenate([grow(r[name]).reshape(CHAINS, -1) for r in rows], axis=1) if rows else np.zeros((CHAINS, 0), np.int64)


def distinct(x):
    """As np.unique with the inverse, without a sort where the numbers lie close."""
    import numpy as np

    low = int(x.min()) if len(x) else 0
    span = int(x.max()) - low + 1 if len(x) else 0
    if span > 4 * len(x):
        return np.unique(x, return_inverse=True)
    there = np.zeros(span, bool)
    there[x - low] = True
    return np.flatnonzero(there) + low, (there.cumsum() - 1)[x - low]


# --- seating


def log_gamma(x):
    """By Stirling's series after a shift by six."""
    import numpy as np

    y = x + 6.0
    r = 1.0 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def uniform(key, turn):
    """Numbers in (0, 1) from 64-bit keys and counters."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = mixed(key + turn * np.uint64(0x9E3779B97F4A7C15))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


@lru_cache(4)
def stirling(d: float):
    """log of generalised Stirling numbers S(n, t) for n up to ROWS, a line of n numbers after those of n - 1."""
    import numpy as np

    out = np.empty(ROWS * (ROWS + 1) // 2)
    out[0], line = 0.0, np.zeros(1)
    for m in range(1, ROWS):
        t = np.arange(1, m + 1)
        line = np.concatenate([line + np.log(m - t * d), [-np.inf]])
        line[1:] = np.logaddexp(line[1:], out[m * (m - 1) // 2 : m * (m + 1) // 2])
        out[m * (m + 1) // 2 : (m + 1) * (m + 2) // 2] = line
    return out


def seat(n, a, discount: float, key):
    """An exact draw of each cell's number of tables, its n customers seated in sequence.

    To sit at a table of size k weighs k - discount, to open a table weighs a; the first opens its own. So t tables have probability
    in proportion to S(n, t) a^(t - 1), where S are generalised Stirling numbers: one law for all sizes, and t is found by its
    distribution function. Up to FEW customers its terms are powers of a, up to ROWS logarithms from the recursion of S, and terms
    below e^-45 of the largest, which no double tells from none, are left out; for more they come from an integral, once for cells of
    equal n. key: 64-bit numbers, one per cell; the draw depends on nothing else.
    """
    import numpy as np

    n = np.asarray(n, np.int64)
    out, d = (n > 0).astype(np.int64), max(discount, 1e-3)
    a, key = (np.broadcast_to(np.asarray(x, kind), out.shape) for x, kind in ((a, np.float64), (key, np.uint64)))
    order = np.flatnonzero(n > 1)
    order = order[np.argsort(np.minimum(n[order], ROWS + 1).astype(np.uint16), kind="stable")]
    sizes, a, u = n[order], a[order], uniform(key[order], np.uint64(1))
    drawn, hi = np.ones(len(order), np.int64), int(np.searchsorted(sizes, ROWS, "right"))
    known, most = stirling(d), 1 << 20
    cuts = np.flatnonzero(np.diff(sizes[:hi], prepend=0)).tolist()
    for lo, end in zip(cuts, [*cuts[1:], hi]):
        size = int(sizes[lo])
        line = known[size * (size - 1) // 2 : size * (size + 1) // 2]
        if size <= FEW:
            for i in range(lo, end, most // FEW):
                own = slice(i, min(i + most // FEW, end))
                power, upto = np.ones(own.stop - i), np.empty((size, own.stop - i))
                for t, weight in enumerate(np.exp(line).tolist()):
                    np.multiply(power, weight, out=upto[t])
                    if t:
                        upto[t] += upto[t - 1]
                    power *= a[own]
                drawn[own] += (upto < u[own] * upto[-1]).sum(0)
            continue
        step = max(1, most // size)
        for i in range(lo, end, step):
            own, t = slice(i, min(i + step, end)), np.arange(size)
            log = np.log(a[own])
            least, top = line + log.min() * t, line + log.max() * t
            first, last = int(np.argmax(least > least.max() - 45)), size - int(np.argmax(top[::-1] > top.max() - 45))
            law = line[first:last] + log[:, None] * t[first:last]
            upto = np.exp(law - law.max(1, keepdims=True)).cumsum(1)
            drawn[own] += first + (upto < (u[own] * upto[:, -1])[:, None]).sum(1)
    far: dict[int, list[int]] = {}
    for i in range(hi, len(order)):
        far.setdefault(int(sizes[i]), []).append(i)
    for size, own in far.items():
        drawn[own] = draw_far(float(size), a[own], d, u[own])
    out[order] = drawn
    return out


def stirling_far(n: float, t, d: float):
    """log of S(n, t) up to a constant of n, for an array t: coefficients of (1 - (1 - x)^d)^t / t!, by a contour integral.

    With x = exp(-q) the contour is a parabola in q through the saddle point, or, where that is nearer to the cut than 4 / n, round
    the cut, with the constant term of the power, which has no such coefficient, taken off; with few more customers than tables, x goes
    round a circle. Errors are below 1e-3 in the log.
    """
    import numpy as np

    def rest(q):
        """log of 1 - x"""
        far = q.real > 0.7
        return np.where(far, np.log1p(-np.exp(-np.where(far, q, 1))), np.log(-np.expm1(-q))) if far.any() else np.log(-np.expm1(-q))

    power_of = lambda q: -np.expm1(d * rest(q))
    slope = lambda q: -t * d * np.exp(-q + (d - 1) * rest(q)) / power_of(q)
    low, high = np.full(len(t), -60.0), np.full(len(t), 4.0)
    for _ in range(30):  # the contour may lie a little off
        mid = (low + high) / 2
        more = -slope(np.exp(mid)) > n
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    q = np.exp(low)
    bend = (slope(q * 1.0001) - slope(q * 0.9999)) / (0.0002 * q)
    near = n * q < 2
    q = np.maximum(q, np.where(near, 4 / n, 0.0))
    wide = np.minimum(np.where(near, np.inf, 4.5 / (np.sqrt(np.maximum(bend, 1e-300)) * q)), np.sqrt(1 + 36 / (n * q)))
    top = n * q + t * np.log(power_of(q))
    whole_turn = (2 * q * wide > np.pi)[:, None]  # x goes round a circle
    wide = np.minimum(wide, np.pi / (2 * q))
    u = 1j * (np.arange(NODES) + 0.5) / NODES * wide[:, None]
    path = q[:, None] * (1 + 2 * u + np.where(whole_turn, 0, u * u))
    with np.errstate(over="ignore", invalid="ignore"):
        power = np.exp(n * path + t[:, None] * np.log(power_of(path)) - top[:, None])
    if near.any():
        power[near] -= np.exp(np.minimum((n * path[near]).real - top[near, None], 600) + 1j * n * path[near].imag)
    whole = (power * np.where(whole_turn, 1, 1 + u) * 1j).imag.sum(1) * 2 * q * wide / NODES / np.pi
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(t < n, top + np.log(np.abs(whole)) - log_gamma(t + 1) - t * np.log(d), -log_gamma(n + 1))


def draw_far(n: float, a, d: float, u):
    """Numbers of tables of cells of n customers at the given levels of their distribution functions, which span at most about the root of their means.

    The integral is taken once for all cells, at places that are the same for all: whole numbers up to 160, then k^2 / 640, about 230 in a span.
    """
    import numpy as np

    places = []
    for x in a.tolist():
        low, high, level = 1e-12, 700 / (1 - d), log(n / x)
        for _ in range(60):  # where the tilted sizes of x / d tables add up to n
            z = (low + high) / 2
            low, high = (z, high) if log(-expm1(-z)) + (1 - d) * z < level else (low, z)
        about = 1 - x / d * expm1(-d * low)
        first, last = max(1.0, floor(about - 9 * sqrt(about) - 9)), min(n, ceil(about + 9 * sqrt(about) + 18))
        wide = np.arange(max(320, floor(sqrt(640 * first))), ceil(sqrt(640 * last)) + 1, dtype=np.float64)
        places.append(np.unique(np.minimum(n, np.concatenate([np.arange(first, min(last, 160) + 1), np.floor(wide * wide / 640)]))))
    every = np.unique(np.concatenate(places))
    plain, out = stirling_far(n, every, d), np.ones(len(a), np.int64)
    for i, t in enumerate(places):
        law = plain[np.searchsorted(every, t)] + t * log(a[i])
        law = np.exp(np.where(np.isnan(law), -np.inf, law) - np.nanmax(law))
        if len(t) == t[-1] - t[0] + 1:
            upto = law.cumsum()
            out[i] = t[np.searchsorted(upto, u[i] * upto[-1])]
        else:
            upto = np.concatenate([[0.0], ((law[1:] + law[:-1]) / 2 * np.diff(t)).cumsum()])
            out[i] = np.rint(np.interp(u[i] * upto[-1], upto, t))
    return out


def gamma_draws(shape, key):
    """Gamma variates of shapes of 1 or more, by squeezed normals."""
    import numpy as np

    out, at, turn = np.zeros(len(shape)), np.arange(len(shape)), 0
    while len(at):
        d = shape[at] - 1 / 3
        r, angle, u = (uniform(key[at], np.uint64(turn + i)) for i in (1, 2, 3))
        x = np.sqrt(-2 * np.log(r)) * np.cos(2 * np.pi * angle)
        v = np.maximum(1 + x / np.sqrt(9 * d), 0.0) ** 3
        good = (v > 0) & (np.log(u) < x * x / 2 + d - d * v + d * np.log(np.maximum(v, 1e-300)))
        out[at[good]] = (d * v)[good]
        at, turn = at[~good], turn + 3
    return out


def openings(tables, discount: float, u, chain: int, seed: int):
    """The weight of a new table in contexts, before the dish's own probability.

    A restaurant of T tables has weight (strength)(strength + discount) ... over its tables. Given a gamma variate of shape
    strength / discount + T, that is a constant weight per table, so its cells are independent.
    """
    import numpy as np

    d = max(discount, 1e-3)
    return d * gamma_draws(STRENGTH / d + tables, keyed(u, u, chain, -seed - 1))


def discount_of(once: float, twice: float) -> float:
    """The usual estimate, from how many cells have one and two customers."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


# --- words


@lru_cache(1)
def tables():
    """Of each byte: whether it is white space, and a 64-bit number, the same for both cases of A-Z."""
    import numpy as np

    blank = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += 32
    return blank, mixed(low * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03))


def word_keys(raw):
    """(hashes, starts) of the words of a byte array: 63-bit numbers above 0, a polynomial over the lower-cased bytes, mixed."""
    import numpy as np

    is_blank, number = tables()
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = is_blank[raw]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    size = ends - starts
    upto = size.cumsum()
    keys, at = np.zeros(len(starts), np.uint64), 0
    with np.errstate(over="ignore"):
        power = np.multiply.accumulate(np.full(int(size.max(initial=0)), 0x5851F42D4C957F2D, np.uint64))
        while at < len(starts):
            base = upto[at] - size[at]
            to = max(at + 1, int(np.searchsorted(upto, base + SPAN, "right")))
            s, e = starts[at], ends[to - 1]
            first = upto[at:to] - size[at:to] - base
            place = np.arange(upto[to - 1] - base) - np.repeat(first, size[at:to])
            keys[at:to] = np.add.reduceat(number[raw[s:e][~blank[s + 1 : e + 1]]] * power[place], first)
            at = to
        keys = mixed(keys + size.astype(np.uint64)) >> np.uint64(1)
    return np.maximum(keys, 1).astype(np.int64), starts


def encoded(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Messages of a chunk: TEXTS (ids, flags, lengths, local word numbers) and LOCAL (sorted hashes, training counts; x is its tokens).

    A word's local number is the place of its hash; 0 is the end of a text, whose hash is 0. Flags: 1 for training, 2 for a null id.
    """

    def run(batches):
        import numpy as np

        part, seq, held = TaskContext.get().partitionId(), 0, 0
        keys, lengths, flags, ids = [], [], [], []
        waiting: list[bytes] = []

        def digest():
            raw = np.frombuffer(b"\n".join(waiting), np.uint8)
            own, starts = word_keys(raw)
            bounds = np.cumsum([len(t) + 1 for t in waiting])
            ends = np.searchsorted(starts, bounds)
            keys.append(np.insert(own, ends, 0))
            lengths.append(np.diff(ends, prepend=0) + 1)
            waiting.clear()

        def chunk():
            if waiting:
                digest()
            n, f = np.concatenate(lengths), np.array(flags, np.uint8)
            local, place = np.unique(np.concatenate(keys), return_inverse=True)
            train = np.repeat((f & 1).astype(bool), n)
            at = (part << 24) + seq
            counts = np.bincount(place[train], minlength=len(local))
            rows = [(TEXTS, at, at, *map(shrink, (np.array([i or 0 for i in ids], np.int64), f, n.astype(np.int64), place.astype(np.uint32)))), (LOCAL, at, at, shrink_sorted(local), shrink(counts), None, None, float(len(place)))]
            for x in (keys, lengths, flags, ids):
                x.clear()
            return messages(rows).to_batches()

        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            size = 0
            for doc, train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_list(batch.column(2))):
                waiting.append(text or b"")
                ids.append(doc)
                flags.append(train + 2 * (doc is None))
                size += len(waiting[-1]) + 64
                held += len(waiting[-1]) + 64
                if size >= SPAN:
                    digest()
                    size = 0
                if held >= chunk_bytes:
                    yield from chunk()
                    seq, held, size = seq + 1, 0, 0
            if waiting:
                digest()
        if ids:
            yield from chunk()

    return docs.select("doc_id", (~held_out(F.col("doc_id"), 7, 2)).alias("train"), F.col("text").cast("string").alias("text")).mapInArrow(run, MESSAGE)


def spell(n_ranges: int):
    """A chunk's words to ranges of hashes."""

    def run(batches):
        import numpy as np

        edges = np.array([(i << 63) // n_ranges for i in range(1, n_ranges)], np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, a, b = (batch.column(x)[i].as_py() for x in ("src", "a", "b"))
                key, n = grow_sorted(a), grow(b)
                cuts = [0, *np.searchsorted(key, edges).tolist(), len(key)]
                rows = [(SPELLED, chunk, k, shrink_sorted(key[lo:hi]), shrink(n[lo:hi])) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
                yield from messages(rows).to_batches()

    return run


def count(key: tuple, got: pa.Table) -> pa.Table:
    """Sum a range's words, number those of training texts by hash, and tell each chunk numbers and counts of its words."""
    import numpy as np

    own = key[0].as_py()
    keys = [grow_sorted(x.as_py()) for x in got.column("a")]
    words, of = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.bincount(of, np.concatenate([grow(x.as_py()) for x in got.column("b")]), len(words)).astype(np.int64)
    number = np.cumsum(c > 0)  # from 1; that of an unknown word is the one before
    rows, at = [], 0
    for src, k in zip(got.column("src").to_pylist(), keys):
        mine = of[at : at + len(k)]
        at += len(k)
        rows.append((KNOWN, own, src, shrink_sorted(number[mine]), shrink(c[mine])))
    none = [None] * 4
    return messages([*rows, (COUNTS, own, -1, *none, float((c > 0).sum()), float(c.sum())), (ONES, own, -1, *none, float((c == 1).sum()), float((c == 2).sum()))])


class Numbers:
    """Numbers of training words, from 0 by hash: range k has those from base[k] to base[k + 1]; a class is SPLIT ranges."""

    def __init__(self, sizes: list[int], grid: int):
        import numpy as np

        self.base, self.grid = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), grid
        self.low = self.base[::SPLIT]

    def ranges(self, number):
        import numpy as np

        return np.searchsorted(self.base, number, "right") - 1

    def pair(self, key, bucket: int):
        row, column = divmod(bucket, self.grid)
        width = self.low[column + 1] - self.low[column]
        return self.low[row] + key // width, self.low[column] + key % width


class Chunk:
    """A chunk's texts as places in its distinct pairs (u, w) of local word numbers; `order` lists pairs of training words by bucket."""

    def __init__(self, texts: dict, words: list[dict], grid: int):
        import numpy as np

        self.docs, self.flags, self.lengths, self.ids = (grow(texts[x], k) for x, k in (("a", "<i8"), ("b", "u1"), ("c", "<i8"), ("d", "<u4")))
        self.starts = self.lengths.cumsum() - self.lengths
        self.count = joined(words, "b")
        n = len(self.count)
        u = np.concatenate([[0], self.ids[:-1]]).astype(np.int64)
        u[self.starts] = 0
        pairs, self.of = np.unique(u * n + self.ids, return_inverse=True)
        self.u, self.w = np.divmod(pairs, n)
        of_word = np.repeat([r["src"] // SPLIT for r in words], [len(grow(r["b"])) for r in words])
        kept = np.flatnonzero((self.count[self.u] > 0) & (self.count[self.w] > 0))
        bucket = of_word[self.u[kept]] * grid + of_word[self.w[kept]]
        by = np.argsort(bucket.astype(np.uint16) if grid < 256 else bucket, kind="stable")  # numpy sorts two bytes without comparing
        self.order, self.bucket = kept[by], bucket[by]


def ask(numbers: Numbers):
    """A chunk's distinct pairs, with counts of training texts, to their buckets."""

    def run(key: tuple, got: pa.Table) -> pa.Table:
        import numpy as np

        rows, chunk = by_kind(got), key[0].as_py()
        own = Chunk(rows[TEXTS][0], rows[KNOWN], numbers.grid)
        word = np.concatenate([grow_sorted(r["a"]) - 1 + numbers.base[r["src"]] for r in rows[KNOWN]])
        train = np.repeat((own.flags & 1).astype(bool), own.lengths)
        n = np.bincount(own.of[train], minlength=len(own.u))[own.order]
        u, w, low = word[own.u[own.order]], word[own.w[own.order]], numbers.low
        row, column = np.divmod(own.bucket, numbers.grid)
        keys = (u - low[row]) * (low[column + 1] - low[column]) + w - low[column]
        cuts = np.flatnonzero(np.diff(own.bucket, prepend=-1)).tolist()
        return messages([(ASK, chunk, int(own.bucket[lo]), shrink_sorted(keys[lo:hi]), shrink(n[lo:hi])) for lo, hi in zip(cuts, [*cuts[1:], len(keys)])])

    return run


def parts(numbers: Numbers, bucket: int, u, w, t) -> list[tuple]:
    """A bucket's tables per context and per word, chain by chain, to the ranges of words."""
    import numpy as np

    rows = []
    for kind, x in ((PART_U, u), (PART_W, w)):
        own, at = distinct(x)
        sums = np.array([np.bincount(at, line, len(own)) for line in t]).astype(np.int64).reshape(CHAINS, -1)
        of = numbers.ranges(own)
        cuts = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
        rows += [(kind, bucket, int(of[lo]), shrink_sorted(own[lo:hi] - numbers.base[of[lo]]), shrink(sums[:, lo:hi].ravel())) for lo, hi in zip(cuts, [*cuts[1:], len(own)])]
    return rows


def merge(numbers: Numbers):
    """Cells of a bucket from all asks, each at one table, and each ask as places in them."""

    def run(key: tuple, asks: pa.Table) -> pa.Table:
        import numpy as np

        bucket, rows = key[0].as_py(), asks.to_pylist()
        keys, of = np.unique(joined(rows, "a", grow_sorted), return_inverse=True)
        n = np.bincount(of, joined(rows, "b"), len(keys)).astype(np.int64)
        t = np.broadcast_to(np.minimum(n, 1), (CHAINS, len(n)))
        out, at = [(STATE, bucket, bucket, shrink_sorted(keys), shrink(n), shrink(t.ravel()), None, float((n == 1).sum()), float((n == 2).sum()))], 0
        for r in rows:
            size = len(grow(r["b"]))
            out.append((ASKED, r["src"], bucket, shrink_sorted(of[at : at + size])))
            at += size
        return messages([*out, *parts(numbers, bucket, *numbers.pair(keys, bucket), t)])

    return run


def parent(numbers: Numbers, discount: float, own_tables: list[float], seed: int):
    """Seat the parent's customers of a range of words; answer buckets, or chunks where they ask."""

    def run(key: tuple, got: pa.Table) -> pa.Table:
        import numpy as np

        me, rows = key[0].as_py(), by_kind(got)
        m, n_dishes = int(numbers.base[me + 1] - numbers.base[me]), int(numbers.base[-1]) + 1
        tables, below = np.zeros((CHAINS, m), np.int64), np.zeros((CHAINS, m), np.int64)
        for kind, sums in ((PART_U, tables), (PART_W, below)):
            for r in rows.get(kind, []):
                sums[:, grow_sorted(r["a"])] += grow(r["b"]).reshape(CHAINS, -1)
        word = (np.arange(m) + numbers.base[me]).astype(np.uint64)
        open_ = np.repeat([(STRENGTH + discount * x) / n_dishes for x in own_tables], m)
        own = seat(below.ravel(), open_, discount, np.concatenate([keyed(word, word, c, seed) for c in range(CHAINS)])).reshape(CHAINS, m)
        out = [(TOTAL, me, c, *[None] * 4, float(below[c].sum()), float(own[c].sum())) for c in range(CHAINS)]
        if KNOWN in rows:  # the last time
            for r in rows[KNOWN]:
                at, c = grow_sorted(r["a"]) - 1, grow(r["b"])
                sums = [np.where(c > 0, x[:, np.maximum(at, 0)], 0) if m else np.zeros((CHAINS, len(c)), np.int64) for x in (tables, below, own)]
                out.append((WORDS, me, r["src"], shrink(sums[0].ravel()), shrink(c), shrink(sums[1].ravel()), shrink(sums[2].ravel())))
            return messages(out)
        for r in rows.get(PART_U, []):
            out.append((REPLY_U, me, r["src"], shrink(tables[:, grow_sorted(r["a"])].ravel())))
        for r in rows.get(PART_W, []):
            at = grow_sorted(r["a"])
            out.append((REPLY_W, me, r["src"], shrink(below[:, at].ravel()), shrink(own[:, at].ravel())))
        return messages(out)

    return run


def keyed(u, w, chain: int, seed: int):
    import numpy as np

    with np.errstate(over="ignore"):
        return mixed(mixed(u.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64((chain << 32) + seed + (1 << 20))) + w.astype(np.uint64))


class Parent:
    """The parent's sums over all words, chain by chain."""

    def __init__(self, totals: list[tuple[float, float]], discount: float, n_dishes: int):
        self.totals, self.discount, self.n_dishes = totals, discount, n_dishes

    def p(self, chain: int, below, own, less=0.0):
        """The probability of words with `below` customers at `own` tables, after `less` of the customers have left."""
        import numpy as np

        customers, tables = self.totals[chain]
        left = below - less
        return (left - self.discount * np.minimum(own, left) + (STRENGTH + self.discount * tables) / self.n_dishes) / (STRENGTH + customers - less)


def sample(numbers: Numbers, discount: float, up: Parent, seed: int, last: bool):
    """One round of a bucket: its cells' tables anew, and their sums to the ranges; the last time, answers instead of cells."""

    def run(key: tuple, got: pa.Table) -> pa.Table:
        import numpy as np

        bucket, rows = key[0].as_py(), by_kind(got)
        state = rows[STATE][0]
        keys, n = grow_sorted(state["a"]), grow(state["b"])
        t = grow(state["c"]).reshape(CHAINS, -1).copy()
        u, w = numbers.pair(keys, bucket)
        tables, below, own = by_chain(rows[REPLY_U], "a"), by_chain(rows[REPLY_W], "a"), by_chain(rows[REPLY_W], "b")
        many = np.flatnonzero(n > 1)
        us, at_u = distinct(u)
        at_u, at_w = at_u[many], distinct(w)[1][many]
        p = np.array([up.p(c, below[c, at_w], own[c, at_w], t[c, many]) for c in range(CHAINS)])
        weight = np.array([openings(x, discount, us, c, seed) for c, x in enumerate(tables)])[:, at_u]
        tickets = np.concatenate([keyed(u[many], w[many], c, seed) for c in range(CHAINS)])
        t[:, many] = seat(np.tile(n[many], CHAINS), (weight * p).ravel(), discount, tickets).reshape(CHAINS, -1)
        out = parts(numbers, bucket, u, w, t)
        if not last:
            return messages([(STATE, bucket, bucket, state["a"], state["b"], shrink(t.ravel())), *out])
        for r in rows[ASKED]:
            at = grow_sorted(r["a"])
            out.append((ANSWER, bucket, r["src"], shrink(n[at]), shrink(t[:, at].ravel())))
        return messages(out)

    return run


def score(docs: DataFrame, chunk_bytes: int = CHUNK, cells: int = CELLS, discounts: tuple[float, float] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    discounts: of contexts and of the parent, in place of the estimates from counts of one and two.
    """
    spark = docs.sparkSession
    of = lambda df, *kinds: df.filter(F.col("kind").isin(*kinds))

    def kept(df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        release(spark)  # the files of its shuffles
        return out

    def groups(df: DataFrame, n: int):
        """Groups by receiver, n of them, over as many tasks as that allows; their bytes say little of their work."""
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, n // 32)
        return df.repartition(max(1, min(n, tasks)), "dst").groupBy("dst")

    coded = kept(encoded(docs, chunk_bytes), "coded")
    n_chunks = of(coded, LOCAL).count()
    grid = max(1, ceil(sqrt((of(coded, LOCAL).agg(F.sum("x")).first()[0] or 0) / cells)))
    n_ranges = grid * SPLIT
    counted = kept(groups(of(coded, LOCAL).select("src", "a", "b").mapInArrow(spell(n_ranges), MESSAGE), n_ranges).applyInArrow(count, MESSAGE), "counts")
    sizes, n_train = [0] * n_ranges, 0
    for r in of(counted, COUNTS).select("src", "x", "y").collect():  # a row per range
        sizes[r["src"]] = int(r["x"])
        n_train += int(r["y"])
    ones = of(counted, ONES).agg(F.sum("x").alias("once"), F.sum("y").alias("twice")).first()
    n_distinct, numbers = sum(sizes), Numbers(sizes, grid)
    up_discount = discounts[1] if discounts else discount_of(ones["once"] or 0, ones["twice"] or 0)
    told = of(coded, TEXTS).union(of(counted, KNOWN))
    state = kept(groups(groups(told, n_chunks).applyInArrow(ask(numbers), MESSAGE), grid * grid).applyInArrow(merge(numbers), MESSAGE), "cells")
    asked = of(state, ASKED)
    first = state
    ones = of(state, STATE).agg(F.sum("x").alias("once"), F.sum("y").alias("twice")).first()
    discount = discounts[0] if discounts else discount_of(ones["once"] or 0, ones["twice"] or 0)
    own_tables = [float(n_distinct)] * CHAINS

    def above(state: DataFrame, seed: int, *more: DataFrame) -> tuple[DataFrame, Parent]:
        got = of(state, PART_U, PART_W)
        for x in more:
            got = got.union(x)
        replies = kept(groups(got, n_ranges).applyInArrow(parent(numbers, up_discount, own_tables, seed), MESSAGE), "ranges")
        totals = {r["dst"]: (r["x"], r["y"]) for r in of(replies, TOTAL).groupBy("dst").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()}
        totals = [totals.get(c, (0.0, 0.0)) for c in range(CHAINS)]
        own_tables[:] = [y for _, y in totals]
        return replies, Parent(totals, up_discount, n_distinct + 1)

    for turn in range(rounds):
        replies, up = above(state, 2 * turn)
        met = of(state, STATE).union(of(replies, REPLY_U, REPLY_W))
        met = met.union(asked) if turn + 1 == rounds else met
        after = kept(groups(met, grid * grid).applyInArrow(sample(numbers, discount, up, 2 * turn + 1, turn + 1 == rounds), MESSAGE), "cells")
        discard(replies, *([state] if state is not first else []))
        state = after
    discard(first)
    wanted = of(counted, KNOWN).select("kind", F.col("dst").alias("src"), F.col("src").alias("dst"), "a", "b", "c", "d", "x", "y")
    replies, up = above(state, 2 * rounds, wanted)
    told = of(coded, TEXTS).union(of(replies, WORDS)).union(of(state, ANSWER))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def judge(key: tuple, got: pa.Table) -> pa.Table:
        import numpy as np

        rows = by_kind(got)
        own = Chunk(rows[TEXTS][0], rows[WORDS], grid)
        tables, below, tops = (by_chain(rows[WORDS], x) for x in "acd")
        n, t = np.zeros(len(own.u), np.int64), np.zeros((CHAINS, len(own.u)), np.int64)
        n[own.order], t[:, own.order] = joined(rows.get(ANSWER, []), "a"), by_chain(rows.get(ANSWER, []), "b")
        p = np.zeros(len(own.u))
        for c in range(CHAINS):
            top = up.p(c, below[c], tops[c])
            p += (n - discount * t[c] + (STRENGTH + discount * tables[c, own.u]) * top[own.w]) / CHAINS
        p = np.log10(p / (STRENGTH + own.count[own.u]))
        base = np.log10((own.count + 1) / (n_train + n_distinct + 1))
        known, base_score, total = (np.add.reduceat(x, own.starts) for x in ((own.count[own.ids] > 0).astype(np.int64), base[own.ids], p[own.of]))
        doc = pa.array(own.docs, mask=own.flags >= 2)
        cols = [doc, (own.flags & 1) == 0, own.lengths, known, np.full(len(doc), n_train, np.int64), base_score, total]
        return pa.table([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=[x.split()[0] for x in schema.split(", ")])

    return groups(told, n_chunks).applyInArrow(judge, schema)


def query(docs: DataFrame) -> DataFrame:
    out = score(docs)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
