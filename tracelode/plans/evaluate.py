"""Rank the earlier reports of a JSON file for each of its duplicates, and measure the ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry
from ..operators import buckets, candidates, scoring, vocabulary
from ..sources.reports import read_reports


def ranks(spark: SparkSession, path: str, method: str = "prefix_match", arguments: tuple = (), aggregate: str = "max", remove_recursion: bool = True, trim: int = 0) -> DataFrame:
    """(query, rank, top_score, top_correct) for every report whose bucket has an older member; a stack's longest list stands for it.

    Equal scores go to the later candidate, of equal times to the larger id; without a candidate of its bucket a query ranks FAR.
    """
    reports, lists = read_reports(spark, path, remove_recursion, trim)
    resolved = buckets.resolve(reports.select("bug_id", "dup_id", F.col("creation_ts").alias("ts")))
    info = reports.join(resolved, "bug_id").select(F.col("bug_id").alias("report"), F.col("creation_ts").alias("ts"), F.col("bucket_id").alias("bucket"))
    docs = lists.join(reports.select("bug_id", F.col("creation_ts").alias("ts")), "bug_id").withColumn("doc", F.struct("bug_id", "stack_idx", "list_idx"))
    vocab = vocabulary.vocabulary(docs.select("doc", "ts", "frames"))
    codes = vocabulary.encode(docs.filter("list_idx = 0").select("doc", "ts", "frames"), vocab, docs.count())
    stacks = codes.select(F.col("doc")["bug_id"].alias("report"), F.col("doc")["stack_idx"].alias("stack"), "ids", "shares")
    keys = stacks.select("report", F.explode(F.array_distinct("ids")).alias("symbol")).distinct()
    pairs = candidates.time_bounded(info.join(keys, "report"), ["symbol"], numbered=False)
    pairs = pairs.filter(F.col("q_report") != F.col("q_bucket")).select(F.col("q_report").alias("query"), F.col("c_report").alias("cand"), (F.col("q_bucket") == F.col("c_bucket")).alias("same"), F.struct("c_ts", "c_report").alias("cand_pos")).distinct()
    found = scoring.first_correct(scoring.compare(pairs, stacks, registry.method(method, *arguments), aggregate))
    asked = info.filter("report <> bucket").select(F.col("report").alias("query"))
    # a duplicate that shares no symbol with an earlier report has no candidate
    return asked.join(found, "query", "left").select("query", F.coalesce("rank", F.lit(scoring.FAR).cast("long")).alias("rank"), F.coalesce("top_score", F.lit(scoring.NO_SCORE)).alias("top_score"), F.coalesce("top_correct", F.lit(0)).alias("top_correct"))


def metrics(spark: SparkSession, path: str, **named) -> DataFrame:
    got = ranks(spark, path, **named)
    return scoring.rank_metrics(got).crossJoin(scoring.auc(got))  # one row each
