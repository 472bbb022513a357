"""Groups of reports that duplicate each other, from duplicate-of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import durable

DAYS_2_YEARS = 2 * 365.2425


def resolve(links: DataFrame) -> DataFrame:
    """(bug_id, dup_id, ts) -> (bug_id, bucket_id): connected groups, named by their oldest member (ties: the smaller id).

    A target that is no report still joins the reports that name it; links to self and cycles are harmless. Each round every node takes
    the smallest label around it and then its label's label, so that rounds grow with the logarithm of a chain's length.
    """
    edges = durable(links.filter(F.col("dup_id").isNotNull() & (F.col("dup_id") != F.col("bug_id"))).select(F.col("bug_id").alias("a"), F.col("dup_id").alias("b")).distinct())
    both = durable(edges.union(edges.select("b", "a")))
    label = durable(both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("label").alias("m"))
        low = label.join(near, label.node == near.a).select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        up = low.select(F.col("node").alias("n2"), F.col("label").alias("l2"))
        nxt = durable(low.join(up, low.label == up.n2).select("node", F.least("label", "l2").alias("label"), "old"))
        done = nxt.filter("label <> old").isEmpty()
        label = nxt.select("node", "label")
        if done:
            break
    grouped = links.join(label, links.bug_id == label.node, "left").select("bug_id", "ts", F.coalesce("label", "bug_id").alias("group"))
    oldest = F.min(F.struct("ts", "bug_id")).over(Window.partitionBy("group"))["bug_id"]
    return grouped.select("bug_id", oldest.alias("bucket_id"))


def duplicates(links: DataFrame) -> DataFrame:
    """Links (bug_id, dup_id, ...) whose target is a report itself."""
    known = links.select(F.col("bug_id").alias("known_")).distinct()
    return links.join(known, F.col("dup_id") == F.col("known_"), "left_semi")


def originals(links: DataFrame) -> DataFrame:
    """Reports that name no other."""
    return links.filter(F.col("dup_id").isNull())


def members(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("bucket_id").agg(F.sort_array(F.collect_set("bug_id")).alias("members"))


def gap_stats(reports: DataFrame) -> DataFrame:
    """(bucket_id, ts) -> one row: over buckets with gaps, statistics of their largest gap in time; nulls where there is none."""
    before = F.lag("ts").over(Window.partitionBy("bucket_id").orderBy("ts"))
    gaps = reports.withColumn("gap", F.col("ts") - before).filter("gap > 0").groupBy("bucket_id").agg(F.max("gap").alias("gap"))
    return gaps.agg(
        F.count("*").alias("n_buckets"), F.max("gap").alias("max_gap"), F.avg("gap").alias("mean_gap"), F.median("gap").alias("median_gap"), F.stddev_pop("gap").alias("std_gap"),
        F.avg((F.col("gap") <= DAYS_2_YEARS * 86400).cast("double")).alias("share_two_years"),
    )
