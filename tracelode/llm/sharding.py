"""Shards by balanced label propagation: linked documents move to their neighbours' shards under quotas.

Documents with equal texts are linked. Rows start dealt evenly by position. In each round every group counts its members per
shard; its homes are the shards that hold most of it, as many as its size needs. A member outside them wants to go to one. Quotas
keep sizes: between two shards as many rows go as come; where more want to go one way, rows without links, indifferent to place,
come back in exchange. Which rows go is decided by rank, counted over partitions in two passes, so no shard's rows meet in one task.
A group counts through pre-aggregated rows of (group, shard), at most one per shard; the driver sees only counts of pairs of shards.

Law: `rows`. Counts of shards differ by at most one, always.

Defined cases: null texts are one group, of size 1 each; empty texts another; repeated rows are dealt each; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, with_starts

SHARDS, ROUNDS, FREE = 16, 4, -1


def quotas(want: dict[tuple[int, int], int], free: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Moves (from, wanted, low, high, to): rows of rank low to high - 1 among those in `from` that want `wanted` (FREE: no link) go to `to`."""
    moves, left, taken = [], dict(free), dict.fromkeys(free, 0)
    for a, b in sorted({(min(p), max(p)) for p in want}):
        x, y = want.get((a, b), 0), want.get((b, a), 0)
        lead, (src, dst) = abs(x - y), ((a, b) if x >= y else (b, a))
        back = min(lead, left.get(dst, 0))
        if back:
            moves.append((dst, FREE, taken[dst], taken[dst] + back, src))
            left[dst] -= back
            taken[dst] += back
        n = min(x, y)
        for s, d, k in ((src, dst, n + back), (dst, src, n)):
            if k:
                moves.append((s, d, 0, k, d))
    return moves


def propagate(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """rows (key, other columns) with a `shard` column; equal keys are linked. Counts of shards differ by at most one."""
    rows = rows.withColumn("one_", F.lit(1)).withColumn("all_", F.lit(0))
    state = materialize(with_starts(rows, "all_", "one_", "deal").withColumnRenamed("start", "row_").drop("all_"), "state")
    total = state.count()
    sizes = materialize(state.groupBy("key").agg(F.count("*").alias("n_")).filter("n_ > 1").withColumnRenamed("key", "k_"), "sizes")
    state = materialize(state.join(sizes, state.key == sizes.k_, "left").drop("k_").withColumn("shard", (F.col("row_") % shards).cast("int")), "state")
    cap = max(1, ceil(total / shards))
    for _ in range(rounds):
        held = state.filter("n_ is not null").groupBy("key", "shard").agg(F.count("*").alias("c_"), F.first("n_").alias("n_"))
        by = Window.partitionBy("key").orderBy(F.desc("c_"), F.xxhash64("key", "shard"))
        ranked = held.withColumn("r_", F.row_number().over(by)).filter(F.col("r_") <= F.ceil(F.col("n_") / cap))
        homes = materialize(ranked.groupBy("key").agg(F.sort_array(F.collect_list("shard")).alias("homes")).withColumnRenamed("key", "k_"), "homes")
        placed = state.join(homes, state.key == homes.k_, "left").drop("k_")
        goal = F.element_at("homes", (F.pmod(F.xxhash64("row_"), F.size("homes")) + 1).cast("int"))
        want = F.when(F.col("homes").isNull(), F.lit(FREE)).when(~F.array_contains("homes", F.col("shard")), goal).otherwise(F.col("shard"))
        ranks = with_starts(placed.withColumn("want_", want).drop("homes").withColumn("pair_", F.col("shard") * (shards + 1) + F.col("want_")), "pair_", "one_", "round")
        ranks = materialize(ranks, "ranks")
        counts = {(r["shard"], r["want_"]): r["n"] for r in ranks.groupBy("shard", "want_").agg(F.count("*").alias("n")).collect()}  # pairs of shards
        wants = {p: n for p, n in counts.items() if p[1] not in (FREE, p[0])}
        moves = quotas(wants, {a: n for (a, b), n in counts.items() if b == FREE})
        clean = ranks.drop("pair_")
        if not moves:
            state = clean.drop("start", "want_")
            break
        plan = state.sparkSession.createDataFrame(moves, "f_ int, w_ int, low_ long, high_ long, to_ int")
        on = (F.col("shard") == F.col("f_")) & (F.col("want_") == F.col("w_")) & (F.col("start") >= F.col("low_")) & (F.col("start") < F.col("high_"))
        moved = clean.join(F.broadcast(plan), on, "left")  # at most three rows for a pair of shards
        nxt = materialize(moved.withColumn("shard", F.coalesce("to_", "shard")).drop("f_", "w_", "low_", "high_", "to_", "start", "want_"), "state")
        discard(state, homes, ranks)
        state = nxt
    return state.drop("n_", "row_")


def cut_links(assigned: DataFrame) -> DataFrame:
    """One row: linked pairs, and those across shards, from counts alone."""
    per = assigned.groupBy("key", "shard").agg(F.count("*").cast("double").alias("c"))
    groups = per.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return groups.agg(F.sum((F.col("n") * F.col("n") - F.col("n")) / 2).alias("links"), F.sum((F.col("n") * F.col("n") - F.col("q")) / 2).alias("cut"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slot numbers a shard's rows from 0 without gaps."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("key"))
    return with_starts(propagate(rows, shards, rounds), "shard", "one_", "slots").drop("one_", "key").withColumnRenamed("start", "slot")


def query(docs: DataFrame) -> DataFrame:
    out = shard_documents(docs)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
