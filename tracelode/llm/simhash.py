"""Near-duplicates by SimHash fingerprints, joined on a grid of segment popcounts.

A fingerprint of 64 bits is embedded as 32 counts: the bits set in each segment of two bits. A differing bit moves one count by
one, so the Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints. The counts are dealt into
`keep + bits` blocks; when at most `bits` counts' worth of distance is spent, at least `keep` blocks are equal. Every choice of
`keep` blocks is a subspace whose unit cells are the grid; fingerprints that share a cell are candidates, the Manhattan distance
over coarse segments rejects most of them, and the Hamming distance is verified, all inside the join, so that only true links
leave it. No link is lost at any size: the number of blocks follows the count of distinct fingerprints and changes the cost alone.

Equal fingerprints meet once, before the join. Defined cases: a null or blank text has no shingle, fingerprint zero, and links
like any other; fewer words than a shingle make one shingle; repeated rows share a component; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_list, components, materialize

SEED = 42
ALL = 0xFFFFFFFFFFFFFFFF


def hashes(text: bytes | None, shingle: int):
    """XXH64 values of all shingles of A-Z lower-cased words, repeats included, in the text's order."""
    import numpy as np
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    of = xxhash.xxh64_intdigest
    return np.fromiter([of(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64, n)


def fingerprint(text: bytes | None, shingle: int) -> int:
    """SimHash of the hashes of all shingles."""
    import numpy as np

    h = hashes(text, shingle)
    n = len(h)
    total = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        total += np.unpackbits(h[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp): one row per row; fp is the fingerprint's bits as a signed long."""

    def run(batches):
        import numpy as np

        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in byte_list(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def embedded(fp: Column) -> Column:
    """The 32 segment counts, packed two bits each: both bits set count two, one of them one."""
    low = F.lit(0x5555555555555555)
    a, b = F.shiftrightunsigned(fp, 1).bitwiseAND(low), fp.bitwiseAND(low)
    return F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseXOR(b))


def blocks_for(n: int, bits: int) -> int:
    """Blocks that must agree, so that chance leaves a fingerprint at most about 64 candidates; a count of two bits tells 1.5 bits."""
    for keep in range(2, 12):
        if comb(keep + bits, keep) * n / 2 ** (48 * keep / (keep + bits)) <= 64:
            return keep
    return 12


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(fps: DataFrame, bits: int, keep: int) -> DataFrame:
    """A row per subspace and fingerprint, with the grid cell's key."""
    n = keep + bits
    cut = [round(32 * i / n) for i in range(n + 1)]
    masks = [sum(3 << (2 * s) for s in range(cut[i], cut[i + 1])) for i in range(n)]
    spaces = [signed(sum(masks[i] for i in pick) & ALL) for pick in combinations(range(n), keep)]
    made = F.array(*[F.struct(F.lit(i).alias("space"), F.col("emb").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(spaces)])
    return fps.withColumn("emb", embedded(F.col("fp"))).select("fp", "rep", F.inline(made))


def links(fps: DataFrame, bits: int = 4, keep: int | None = None) -> DataFrame:
    """(a, b): representatives of distinct fingerprints (fp, rep) that differ in at most `bits` bits."""
    if keep is None:
        keep = blocks_for(fps.count(), bits)
    rows = cells(fps, bits, keep)
    l = rows.select(F.col("space"), F.col("cell"), F.col("fp").alias("f"), F.col("rep").alias("a"))
    r = rows.select(F.col("space").alias("s2"), F.col("cell").alias("c2"), F.col("fp").alias("g"), F.col("rep").alias("b"))
    quarter = [signed(0xFFFF << s) for s in (0, 16, 32, 48)]
    bound = sum((F.abs(F.bit_count(F.col("f").bitwiseAND(F.lit(q))) - F.bit_count(F.col("g").bitwiseAND(F.lit(q)))) for q in quarter[1:]), F.abs(F.bit_count(F.col("f").bitwiseAND(F.lit(quarter[0]))) - F.bit_count(F.col("g").bitwiseAND(F.lit(quarter[0])))))
    on = (F.col("space") == F.col("s2")) & (F.col("cell") == F.col("c2")) & (F.col("a") < F.col("b")) & (bound <= bits) & (F.bit_count(F.col("f").bitwiseXOR(F.col("g"))) <= bits)
    return l.hint("merge").join(r, on).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links, itself included. A null id stays alone under null."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fp")
    reps = materialize(rows.filter("id is not null").groupBy("fp").agg(F.min("id").alias("rep")), "reps")
    linked = components(links(reps, bits))
    named = reps.join(linked, reps.rep == linked.node, "left").select(F.col("fp").alias("fp_"), F.coalesce("component", "rep").alias("component"))
    named = materialize(named, "named")
    return rows.join(named, rows.fp == named.fp_, "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def query(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
