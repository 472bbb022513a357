"""Language by bitmask n-gram filters.

One Bloom filter per language, bit-sliced: slot i holds a mask whose bit l is language l's filter bit, so that one lookup of an
n-gram, the AND of its slots, returns every language that contains it. A text's hits per language are popcounts over its n-grams;
with fill rate f^k a filter returns f^k of the absent n-grams too, so hits are corrected to (hits - n f^k) / (1 - f^k). The
language with most corrected hits wins; the score is its lead over the next, as a share of its own hits.

Fit. Per language a sample of rows bounded by SAMPLE (expected, by hash of the id); an n-gram belongs to a language when its share
there is at least KEEP of its largest share anywhere. Of a language's n-grams the GRAMS most frequent count, and of these only those
seen twice, unless none is. The filter's size is fixed, so what is sent to executors is bounded.

Defined cases: null texts and texts without a letter (`str.isalpha`, so numbers like ½ are none) are `und` with score 0, as is every text when no language was learned; a text
none of whose n-grams is known is `und` too only if nothing was learned, else the first language with score 0. Ties go to the
first language by code point. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out

SAMPLE, KEEP, GRAM, GRAMS = 3000, 0.5, 3, 1 << 17
SLOTS, HASHES = 1 << 20, 2
LETTER = re.compile(r"[^\W\d_]")
M1, M2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


@dataclass
class Filters:
    langs: list[str] = field(default_factory=list)
    slices: list = field(default_factory=list)  # one array of masks per 64 languages
    false_rate: list[float] = field(default_factory=list)


@lru_cache(1)
def plain():
    """Code points below 128 as they are if letters, else a blank; used after lower-casing."""
    import numpy as np

    return np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint64)


def grams(text: str):
    """Keys of all character n-grams that hold a letter, in lower case, all else as blanks, with a blank at either end."""
    import numpy as np

    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    low = c < 128
    c[low] = plain()[c[low].astype(np.int64)]
    with np.errstate(over="ignore"):
        h, some = np.zeros(max(0, len(c) - GRAM + 1), np.uint64), np.zeros(max(0, len(c) - GRAM + 1), bool)
        for i in range(GRAM):
            part = c[i : len(c) - GRAM + 1 + i]
            h = (h << np.uint64(21)) ^ part
            some |= part != 32
        return h[some]


def slots(keys, i: int):
    import numpy as np

    with np.errstate(over="ignore"):
        x = keys * np.uint64((M1, M2)[i % 2] + 2 * (i // 2))
        return ((x ^ (x >> np.uint64(32))) * np.uint64(M1) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def popcounts(text: str, f: Filters):
    """(n-grams, corrected hits per language)."""
    import numpy as np

    keys = grams(text)
    hits = np.zeros(len(f.langs))
    for s, masks in enumerate(f.slices):
        found = masks[slots(keys, 0)]
        for i in range(1, HASHES):
            found = found & masks[slots(keys, i)]
        own = f.langs[64 * s : 64 * s + 64]
        if len(own) <= 12:
            counts = np.bincount(found.astype(np.int64), minlength=1 << len(own))
            of = np.arange(len(counts))
            hits[64 * s : 64 * s + len(own)] = [counts[(of >> b) & 1 == 1].sum() for b in range(len(own))]
        else:
            hits[64 * s : 64 * s + len(own)] = [((found >> np.uint64(b)) & np.uint64(1)).sum() for b in range(len(own))]
    rate = np.array(f.false_rate)
    return len(keys), np.maximum(0, (hits - len(keys) * rate) / np.maximum(1 - rate, 1e-9))


def decide(text: str | None, f: Filters) -> tuple[str, float]:
    import numpy as np

    if not f.langs or text is None or not any(m.group().isalpha() for m in LETTER.finditer(text)):
        return "und", 0.0
    n, hits = popcounts(text, f)
    best = int(np.argmax(hits))
    if not n or hits[best] <= 0:
        return f.langs[best], 0.0
    rest = np.delete(hits, best)
    return f.langs[best], float(min(1.0, (hits[best] - (rest.max() if len(rest) else 0)) / hits[best]))


def build(counts: dict[str, dict[int, int]]) -> Filters:
    """Filters from n-gram counts per language."""
    import numpy as np

    langs = sorted(counts)
    totals = {k: sum(counts[k].values()) for k in langs}
    top: dict[int, float] = {}
    for k in langs:
        for g, n in counts[k].items():
            top[g] = max(top.get(g, 0.0), n / totals[k])
    f = Filters(langs)
    for at in range(0, len(langs), 64):
        masks = np.zeros(SLOTS, np.uint64)
        for b, k in enumerate(langs[at : at + 64]):
            own = np.array([g for g, n in counts[k].items() if n / totals[k] >= KEEP * top[g]], np.int64).view(np.uint64)
            for i in range(HASHES):
                masks[slots(own, i)] |= np.uint64(1 << b)
            f.false_rate.append(0.0)
        f.slices.append(masks)
        for b in range(len(langs[at : at + 64])):
            f.false_rate[at + b] = float(((masks >> np.uint64(b)) & np.uint64(1)).mean()) ** HASHES
    return f


def fit(docs: DataFrame, mod: int = 4, rest: int = 2) -> Filters:
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"), mod, rest))
    rates = rows.groupBy("lang").agg(F.count("*").alias("n")).select(F.col("lang").alias("l"), F.least(F.lit(1.0), SAMPLE / F.col("n")).alias("rate"))
    rates = {r["l"]: r["rate"] for r in rates.collect()}  # one row per language
    if not rates:
        return Filters()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    at = F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), F.lit(float(v)))])
    sample = rows.filter(share < F.element_at(at, F.col("lang"))).select("lang", "text")

    def run(batches):
        import numpy as np

        for batch in batches:
            by: dict[str, list] = {}
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(k, []).append(grams(text))
            for k, keys in by.items():
                g, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    found = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    often = F.max("n").over(Window.partitionBy("lang"))
    found = found.withColumn("top", top).withColumn("often", often).filter(f"top <= {GRAMS} and (n > 1 or often = 1)").select("lang", "gram", "n")
    counts: dict[str, dict[int, int]] = {k: {} for k in rates}
    for batch in found.toArrow().to_batches():  # at most GRAMS per language
        for k, g, n in zip(*(c.to_pylist() for c in batch.columns)):
            counts[k][g] = n
    return build({k: v for k, v in counts.items() if v})


def score(docs: DataFrame, f: Filters) -> DataFrame:
    """(id, lang_pred, score) for every row."""

    def run(batches):
        for batch in batches:
            got = [decide(t, f) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string")).mapInArrow(run, "id long, lang_pred string, score double")


def query(docs: DataFrame) -> DataFrame:
    return score(docs, fit(docs)).select(F.col("id").alias("doc_id"), held_out(F.col("id"), 4, 2).alias("held_out"), "lang_pred", "score")


def filter_languages(docs: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """The rows of docs in an allowed language (all learned ones by default); where no row names a language, none is learned and none stays."""
    f = fit(docs)

    def run(batches):
        for batch in batches:
            got = [decide(t, f)[0] for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([k != "und" and (allowed is None or k in allowed) for k in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
