"""Nearest vectors: a stated query set against all rows, block against block."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def blocks(rows: DataFrame) -> DataFrame:
    """(id, vec) -> rows of up to BLOCK ids with their vectors as one binary of doubles."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                m = np.array(part.column(1).to_pylist(), "<f8")
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())], names=["ids", "data"])

    return rows.mapInArrow(run, "ids array<long>, data binary")


def nearest(queries: DataFrame, rows: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query, cand, score, rank) for (id, vec) tables: the k rows nearest to each query, by cosine or by smallest L2 distance; ties by id.

    Each pair of blocks gives its own k best per query, so that k rows per query and block are ranked.
    """

    def run(batches):
        for batch in batches:
            for qi, qd, ci, cd in zip(*(batch.column(i).to_pylist() for i in range(4))):
                q, c = np.frombuffer(qd, "<f8").reshape(len(qi), -1), np.frombuffer(cd, "<f8").reshape(len(ci), -1)
                if metric == "cosine":
                    q, c = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (q, c))
                    s = q @ c.T
                else:
                    s = -np.sqrt(np.maximum((q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * q @ c.T, 0))
                ids = np.array(ci)
                for i, query in enumerate(qi):
                    top = np.lexsort((ids, -np.round(s[i], 9)))[:k]
                    yield pa.RecordBatch.from_arrays([pa.array([query] * len(top), pa.int64()), pa.array(ids[top]), pa.array(s[i, top])], names=["query", "cand", "score"])

    q = blocks(queries).select(F.col("ids").alias("qi"), F.col("data").alias("qd"))
    got = q.crossJoin(blocks(rows)).mapInArrow(run, "query long, cand long, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "cand"))
    return got.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)


def without(found: DataFrame, drop) -> DataFrame:
    """Hits that `drop` does not name, ranked anew: filtering follows the search."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    return found.filter(~drop).withColumn("rank", rank.cast("long"))


def merge_queries(found: DataFrame, group: DataFrame, owner: DataFrame) -> DataFrame:
    """Hits of several query vectors of one report as one ranking: the best score per report, own reports left out.

    group: (query, report); owner: (cand, cand_report).
    """
    rows = found.join(group, "query").join(owner, "cand").filter("report <> cand_report").groupBy("report", "cand_report").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("report").orderBy(F.desc(F.round("score", 9)), "cand_report"))
    return rows.withColumn("rank", rank.cast("long"))


def hard_negatives(found: DataFrame, same, most: int = 51) -> DataFrame:
    """Ranked hits outside the query's bucket, the first `most`."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    return found.filter(~same).withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most)
