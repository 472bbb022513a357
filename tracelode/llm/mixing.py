"""Mixing sources to target weights by fixed-length blocks.

Each source's words, its documents in the order of a hash of id and text, are cut into blocks of `block` words. Output shards have
SHARD_SLOTS slots of a block each, the last one the rest; a shard's counts of sources are one multinomial draw by the targets'
weights, seeded by the shard. A source's slots are numbered on from shard to shard; slot k takes the block that the source's
pseudorandom permutation of block indexes (a keyed Feistel network, walked within the range; a new one for each pass over the source)
gives for k, and slots meet blocks by a join on (source, index). What is taken of a document is what the slots take: near its
source's target, by the spread of the draw. Slots beyond three passes over a source stay empty, so no block is used more often.
Nothing depends on how rows lie: the same rows give the same mix.

Targets. Sources by code point, null last, weigh 5, 2, 1, repeating, and share all words; a target stops at three times its
source's size and the excess is shared anew by weight: solved at once as filling to a common level. Sources are few: one row for
each reaches the driver.

Defined cases: a null or blank text has size 0 and none taken; sources of size 0 have target 0; repeated rows are dealt each; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK, materialize, mixed, ordered_starts

BLOCK, SHARD_SLOTS, BATCH, MOST, WEIGHTS = 16, 8192, 64, 3, (5, 2, 1)


def permuted(k, n: int, key: int):
    """The places of indexes k under a permutation of 0 .. n - 1."""
    import numpy as np

    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    out = np.array(k, np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        l, r = x >> h, x & mask
        for i in range(4):
            with np.errstate(over="ignore"):
                l, r = r, l ^ (mixed(r + np.uint64((key * 4 + i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) & mask)
        x = (l << h) | r
        out[todo] = x
        todo = todo[x >= n]
    return out.astype(np.int64)


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> also target; one row per source, so one task holds all."""
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS) + 1).cast("int"))
    rows = sizes.withColumn("w", w.cast("double")).withColumn("most", F.lit(float(MOST)) * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(all_) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after))
    rows = rows.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct(F.col("ratio"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(all_)["level"])
    return rows.select("source", "source_size", F.least("most", F.col("level") * F.col("w")).alias("target"))


def shard_counts(shard: int, total: int, weights, seed: int):
    """Slots of each source in an output shard, a multinomial draw."""
    import numpy as np

    size = min(SHARD_SLOTS, total - shard * SHARD_SLOTS)
    return np.random.default_rng([seed, shard]).multinomial(size, weights)


def slots(spark: SparkSession, sources: list[tuple[str | None, float, int]], seed: int = 0) -> DataFrame:
    """(source, block, shard, slot): one row per slot that holds a block. sources: name, expected slots, blocks; in a fixed order.

    Shards are drawn in batches; a first pass adds up each batch's counts, which places the slots of the next.
    """
    sources = [s for s in sources if s[1] > 0]
    expected = sum(s[1] for s in sources)
    total = round(expected)
    weights = [s[1] / expected for s in sources] if sources else []
    n_shards = -(-total // SHARD_SLOTS)
    batches = spark.range(0, -(-n_shards // BATCH) if sources else 0, numPartitions=max(1, min(4096, -(-n_shards // BATCH)))).select(F.col("id").alias("batch"))
    shards = lambda batch: range(batch * BATCH, min(n_shards, (batch + 1) * BATCH))

    def add(rows):
        for r in rows:
            for batch in r.column("batch").to_pylist():
                counts = sum(shard_counts(s, total, weights, seed) for s in shards(batch))
                yield pa.RecordBatch.from_arrays([pa.array([batch] * len(counts), pa.int64()), pa.array(range(len(counts)), pa.int32()), pa.array(counts, pa.int64())], names=["batch", "source", "n"])

    sums = batches.mapInArrow(add, "batch long, source int, n long")
    before = Window.partitionBy("source").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # few rows that slots are made from: their bytes say little of the work
    placed = placed.repartition(max(1, min(4096, -(-n_shards // BATCH))), "batch").groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("source", "first"))).alias("firsts"))

    def run(rows):
        import numpy as np
        import xxhash

        keys = [xxhash.xxh3_64_intdigest(b"\0" if s is None else b"\1" + s.encode(), seed) for s, _, _ in sources]
        for r in rows:
            for batch, firsts in zip(r.column("batch").to_pylist(), r.column("firsts").to_pylist()):
                at = [x["first"] for x in firsts]
                for shard in shards(batch):
                    for i, n in enumerate(shard_counts(shard, total, weights, seed).tolist()):
                        name, _, b = sources[i]
                        k = np.arange(at[i], min(at[i] + n, MOST * b), dtype=np.int64)
                        at[i] += n
                        block = np.empty(len(k), np.int64)
                        for e in np.unique(k // b).tolist():
                            own = k // b == e
                            block[own] = permuted(k[own] % b, b, keys[i] + 7919 * e)
                        if len(k):
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(block), pa.array(np.full(len(k), shard)), pa.array(k)], names=["source", "block", "shard", "slot"])

    return placed.mapInArrow(run, "source string, block long, shard long, slot long")


def plan(rows: DataFrame, block: int = BLOCK, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (source, size, key_, ...) -> (placed rows with start, source_size, target; pieces (s_, start, block, length); slots)."""
    placed = ordered_starts(rows, "source", "size", "key_", "mix")
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = materialize(source_targets(sizes).withColumn("n_blocks", F.ceil(F.col("source_size") / block)), "sources")
    named = sources.select(F.col("source").alias("s_"), "source_size", "target")
    placed = materialize(placed.join(named, placed.source.eqNullSafe(named.s_), "left").drop("s_"), "placed")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = placed.filter("size > 0").select(F.col("source").alias("s_"), "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    length = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    few = sorted(sources.collect(), key=lambda r: (r["source"] is None, (r["source"] or "").encode()))  # one row per source
    few = [(r["source"], r["target"] * r["n_blocks"] / r["source_size"] if r["source_size"] else 0.0, r["n_blocks"]) for r in few]
    return placed, pieces.withColumn("length", length), slots(rows.sparkSession, few, seed)


def row_key(text: Column) -> Column:
    """A hash of a row's id and text, by which the words of a source are ordered."""
    return F.xxhash64("doc_id", F.xxhash64(text), F.lit("mix")).alias("key_")


def uses(pieces: DataFrame, drawn: DataFrame) -> DataFrame:
    """Each piece with the number of slots that took its block."""
    per = drawn.groupBy("source", "block").agg(F.count("*").alias("uses")).withColumnRenamed("block", "b_")
    # a broadcast would be chosen for the few rows that slots are made from, but slots grow with the words
    return pieces.join(per.hint("merge"), (pieces.block == per.b_) & pieces.s_.eqNullSafe(per.source)).drop("b_", "source")


def manifest(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """(shard, source, slot, block, doc_id, first, length): which words of which document each slot of each output shard holds."""
    placed, pieces, drawn = plan(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words().alias("size"), row_key(F.col("text"))), block, seed)
    own = placed.select("doc_id", F.col("source").alias("o_"), F.col("start").alias("at_"), F.col("size").alias("n_")).filter("n_ > 0")
    held = pieces.join(own, pieces.s_.eqNullSafe(own.o_) & (pieces.start == own.at_)).drop("o_", "at_", "n_").withColumnRenamed("block", "b_")
    first = F.greatest(F.lit(0), F.col("b_") * block - F.col("start"))
    return drawn.join(held.hint("merge"), (drawn.block == held.b_) & drawn.source.eqNullSafe(held.s_)).select("shard", "source", "slot", "block", "doc_id", first.alias("first"), "length")


def n_words():
    return F.coalesce(F.regexp_count(F.col("text"), F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def query(docs: DataFrame) -> DataFrame:
    placed, pieces, drawn = plan(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words().alias("size"), row_key(F.col("text"))))
    got = uses(pieces, drawn).groupBy("s_", "start").agg(F.sum(F.col("length") * F.col("uses")).alias("took")).withColumnRenamed("start", "at_")
    out = placed.join(got.hint("merge"), placed.source.eqNullSafe(got.s_) & (placed.start == got.at_) & (placed["size"] > 0), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("took", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """docs' own columns, a row for each pass over a document: its whole text if the pass took all its blocks, else the words taken.

    n_chars, where there is one, is set to the length of the text.
    """
    names = {x: f"c{i}_" for i, x in enumerate(docs.columns)}
    wide = docs.select(F.col("source").cast("string").alias("source"), n_words().alias("size"), row_key(F.col("text")), *[F.col(x).alias(y) for x, y in names.items()])
    placed, pieces, drawn = plan(wide, block, seed)
    took = uses(pieces, drawn).groupBy("s_", "start").agg(F.collect_list(F.struct("block", "uses")).alias("took")).withColumnRenamed("start", "at_")
    took = took.withColumn("took", F.transform("took", lambda x: x.block * (MOST + 1) + F.least(x.uses, F.lit(MOST))))
    rows = placed.filter("size > 0").join(took.hint("merge"), placed.source.eqNullSafe(took.s_) & (placed.start == took.at_)).select("start", "size", "took", *names.values())
    at = {x: i + 3 for i, x in enumerate(docs.columns)}
    kinds = docs.schema

    def run(batches):
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            keep, texts = [], []
            for i, (start, size, took, text) in enumerate(zip(*(batch.column(j).to_pylist() for j in (0, 1, 2, at["text"])))):
                by = dict(divmod(x, MOST + 1) for x in took)
                first, last = start // block, (start + size - 1) // block
                words = None
                for p in range(MOST):
                    got = [b for b in range(first, last + 1) if by.get(b, 0) > p]
                    if not got:
                        break
                    keep.append(i)
                    if len(got) == last - first + 1:
                        texts.append(text)
                        continue
                    words = words or text.encode().split()
                    texts.append(b" ".join(w for b in got for w in words[max(0, b * block - start) : (b + 1) * block - start]).decode())
            cols = [batch.column(at[f.name]).take(pa.array(keep, pa.int64())) for f in kinds]
            j = kinds.names.index("text")
            cols[j] = pa.array(texts, pa.string())
            if "n_chars" in kinds.names:
                c = kinds.names.index("n_chars")
                cols[c] = pa.array([len(t) for t in texts], pa.int64()).cast(cols[c].type)
            yield pa.RecordBatch.from_arrays(cols, names=kinds.names)

    return rows.mapInArrow(run, kinds)
