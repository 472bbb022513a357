"""Chronological chunks of reports, test-then-train over them, and the same as a stream of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import vocabulary
from ..operators.tables import DAY, before, durable

SPLITS = (("warmup", 350), ("train", 3850), ("validation", 140), ("test", 700))


def split_by_days(rows: DataFrame, splits=SPLITS) -> DataFrame:
    """rows (ts, ...) with `split`: spans of days from the first report; a report on a boundary belongs to the later split, one beyond all to none."""
    start = F.lit(rows.agg(F.min("ts")).first()[0])
    label, at, spans = F.lit(None).cast("string"), 0, []
    for name, days in splits:
        spans.append((name, at, at + days))
        at += days
    for name, a, b in spans:  # the last is asked first
        label = F.when(F.col("ts").between(start + a * DAY, start + b * DAY), name).otherwise(label)
    return rows.withColumn("split", label)


def chunks(rows: DataFrame, n: int = 50) -> DataFrame:
    """rows (report, ts, is_dup) with `chunk` from 1: a chunk ends with every (duplicates // n)-th duplicate in order of time.

    Duplicates before a report are counted per day first, so that no sort of all rows meets in one task.
    """
    total = rows.agg(F.sum(F.col("is_dup").cast("long"))).first()[0] or 0
    step = max(1, total // n)
    placed = before(rows, F.floor(F.col("ts") / DAY), ["ts", "report"], F.col("is_dup").cast("long"), "dups_")
    # duplicates strictly before the report, in steps
    return placed.withColumn("chunk", F.greatest(F.lit(1), F.ceil(F.col("dups_") / step)).cast("long")).drop("dups_")


def load_until(rows: DataFrame, after: int, ts: int) -> DataFrame:
    """One row: reports and duplicates after one point of time, up to and with another; ties are allowed, going back is not."""
    if ts < after:
        raise ValueError("time must not go back")
    return rows.filter((F.col("ts") > after) & (F.col("ts") <= ts)).agg(F.count("*").alias("n_reports"), F.coalesce(F.sum(F.col("is_dup").cast("long")), F.lit(0)).alias("n_dups"))


class Vocabulary:
    """State of the prequential loop: `compute` registers symbols without counting, `fit` counts a chunk's documents."""

    def __init__(self):
        self.symbols: DataFrame | None = None
        self.counts: DataFrame | None = None

    def compute(self, stacks: DataFrame) -> None:
        self.symbols = durable(vocabulary.register(stacks, self.symbols))

    def fit(self, stacks: DataFrame) -> None:
        self.compute(stacks)
        df = vocabulary.document_frequency(stacks)
        both = df if self.counts is None else self.counts.union(df)
        self.counts = durable(both.groupBy("symbol").agg(F.sum("df").alias("df")))

    def table(self) -> DataFrame:
        return self.symbols.join(self.counts, "symbol", "left").select("symbol", "id", F.coalesce("df", F.lit(0)).alias("df"))


def prequential(rows: DataFrame, evaluate, train) -> list:
    """For each chunk: evaluate on the second half of its duplicates, then train on all of it; returns what evaluate returned."""
    dup = F.col("is_dup").cast("long")
    # chunks rise with time, so that one numbering of all duplicates gives their places in every chunk
    cut = durable(before(chunks(rows), F.floor(F.col("ts") / DAY), ["ts", "report"], dup, "place_"))
    out = []
    for n, first, size in cut.groupBy("chunk").agg(F.min(F.when(F.col("is_dup"), F.col("place_"))), F.sum(dup)).orderBy("chunk").collect():  # about 50 rows
        part = cut.filter(F.col("chunk") == n)
        asked = part.filter(F.col("is_dup") & (F.col("place_") >= (first or 0) + (size or 0) // 2)).drop("place_")
        part = part.drop("place_")
        out.append(evaluate(n, asked, part))
        train(n, part)
    return out


def stream(source: DataFrame, evaluate, train, checkpoint: str, trigger=None):
    """The loop over a streaming DataFrame of reports: each micro-batch is evaluated, then trained on; returns the started query."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            evaluate(epoch, batch)
            train(epoch, batch)
        finally:
            batch.unpersist()

    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
