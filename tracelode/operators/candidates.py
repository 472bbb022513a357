"""Candidate pairs: a query report and the earlier reports it is held against. A block key keeps the pairs linear in a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECENT = 350 * 24 * 3600
TILE = 248  # queries that lie together in a list of pairs


def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.select([F.col(c).alias(f"{p}_{c}") for c in rows.columns]) for p in "qc")


def time_bounded(rows: DataFrame, block: list[str], numbered: bool = True) -> DataFrame:
    """rows (report, ts, ...) joined with themselves: candidates not later than the query, another report, of the same block.

    numbered: with `cand_pos`, a candidate's place by time among its query's. It follows from the candidate's place in the block, found
    before the join, less one for a candidate of the query's own time and greater id; so a report is one row, and pairs are not dealt.
    """
    if numbered:
        rows = rows.filter("ts is not null").withColumn("place_", F.row_number().over(Window.partitionBy(*block).orderBy("ts", "report")).cast("long"))
    q, c = sides(rows)
    on = [F.col(f"q_{b}") == F.col(f"c_{b}") for b in block] + [F.col("c_ts") <= F.col("q_ts"), F.col("c_report") != F.col("q_report")]
    pairs = q.join(c, on)
    if not numbered:
        return pairs
    after = (F.col("c_ts") == F.col("q_ts")) & (F.col("c_report") > F.col("q_report"))
    return pairs.withColumn("cand_pos", F.col("c_place_") - after.cast("long")).drop("q_place_", "c_place_")


def prefix_key(frames: Column, n: int = 2) -> Column:
    """The first n symbols of a longer stack; null for others."""
    return F.when(F.size(frames) > n, F.array_join(F.slice(frames, 1, n), "."))


def tiled(rows: DataFrame, block: list[str], size: int = TILE) -> DataFrame:
    """The pairs and places of time_bounded(), for blocks so large that what they cost is the pairs themselves.

    Pairs lie in the order of (`size` queries next to each other in time, candidate, query): a candidate and its place repeat, and so does
    the list of queries from candidate to candidate, which takes files of pairs a fraction of the room. Rows are dealt once for both
    sides, over all partitions: bytes don't tell how many pairs a partition makes.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.filter("ts is not null").repartition(n, *block)
    placed = dealt.withColumn("place_", F.row_number().over(Window.partitionBy(*block).orderBy("ts", "report")))
    q, c = sides(placed)
    others = [x for x in q.columns if x[2:] not in [*block, "place_"]]
    queries = F.array_sort(F.collect_list(F.struct("q_place_", *others)))
    tiles = q.groupBy(*[f"q_{b}" for b in block], F.floor((F.col("q_place_") - 1) / size).alias("tile_")).agg(queries.alias("queries_"), F.max("q_ts").alias("last_"))
    on = [F.col(f"q_{b}") == F.col(f"c_{b}") for b in block] + [F.col("c_ts") <= F.col("last_")]
    tiles = tiles.select("*", *[F.col("queries_")[x].alias(x) for x in others]).drop("tile_", "queries_")
    pairs = tiles.join(c, on).select("*", F.posexplode("q_report").alias("at_", "query_"))  # an array a column: a struct would be made anew for each pair
    pairs = pairs.withColumns({x: F.col("query_") if x == "q_report" else F.get(x, "at_") for x in others}).drop("at_", "query_", "last_")
    pairs = pairs.filter((F.col("c_ts") <= F.col("q_ts")) & (F.col("c_report") != F.col("q_report")))
    after = (F.col("c_ts") == F.col("q_ts")) & (F.col("c_report") > F.col("q_report"))
    return pairs.withColumn("cand_pos", F.col("c_place_").cast("long") - after.cast("long")).drop("c_place_")


def prefix_block(rows: DataFrame, n: int = 2) -> DataFrame:
    """Pairs of reports whose stacks begin alike. rows have frames, or `key` already."""
    rows = rows if "key" in rows.columns else rows.withColumn("key", prefix_key(F.col("frames"), n))
    return tiled(rows.filter("key is not null"), ["key"])


def overlap(rows: DataFrame, top: int = 50) -> DataFrame:
    """(query, cand, score, rank): per query the candidates with most frames among its symbols, counted as often as they occur.

    Only strictly earlier reports of other buckets count. Symbols shared are found by an equi-join on the symbol; counts per report and
    symbol are made before it.
    """
    counts = rows.select("report", "ts", "bucket", F.explode("frames").alias("symbol")).groupBy("report", "ts", "bucket", "symbol").agg(F.count("*").alias("n"))
    q, c = sides(counts)
    hits = q.join(c, (F.col("q_symbol") == F.col("c_symbol")) & (F.col("c_ts") < F.col("q_ts")) & (F.col("c_bucket") != F.col("q_bucket")))
    scores = hits.groupBy("q_report", "c_report").agg(F.sum("c_n").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q_report").orderBy(F.desc("score"), "c_report"))
    return scores.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select(F.col("q_report").alias("query"), F.col("c_report").alias("cand"), "score", "rank")


def recent_buckets(rows: DataFrame, window: int = RECENT) -> DataFrame:
    """Reports whose bucket has a member at most `window` seconds before them, or later."""
    newest = F.max("ts").over(Window.partitionBy("bucket"))
    return rows.withColumn("newest", newest).filter(F.col("ts") - F.col("newest") <= window)
