"""Cutting lineage through the shared checkpoint folder, and sums in order without one sort of all rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86400


def durable(df: DataFrame) -> DataFrame:
    """df checkpointed to the folder in spark.checkpoint.dir; to a temporary one only where none is set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="tracelode-"))
    return df.checkpoint()


def before(rows: DataFrame, bucket: Column, order: list, size: Column, name: str) -> DataFrame:
    """rows with `name`: the sum of size over the rows that come earlier in the order.

    `bucket` must rise with the order. Buckets are summed first, and only their totals, a row each, are sorted in one task; a null
    bucket comes first, as null does in the order.
    """
    keyed = rows.withColumn("bucket_", bucket)
    first = Window.orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)
    bases = keyed.groupBy(F.col("bucket_").alias("b_")).agg(F.sum(size).alias("n_")).select("b_", F.coalesce(F.sum("n_").over(first), F.lit(0)).alias("base_"))
    local = F.coalesce(F.sum(size).over(Window.partitionBy("bucket_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = keyed.withColumn("local_", local).join(bases, F.col("bucket_").eqNullSafe(F.col("b_")))
    return placed.withColumn(name, F.col("base_") + F.col("local_")).drop("bucket_", "b_", "base_", "local_")
