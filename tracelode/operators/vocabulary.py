"""Symbols to numbers, with document frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import DAY, before


def occurrences(stacks: DataFrame) -> DataFrame:
    """stacks (doc, ts, frames) -> (doc, ts, pos, symbol)."""
    return stacks.select("doc", "ts", F.posexplode("frames").alias("pos", "symbol"))


def register(stacks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(symbol, id): numbers from 1 in the order first seen (ts, doc, place), after the known ones; 0 stands for unknown."""
    first = occurrences(stacks).groupBy("symbol").agg(F.min(F.struct("ts", "doc", "pos")).alias("first"))
    base = 0
    if known is not None:
        first = first.join(known.select("symbol"), "symbol", "left_anti")
        base = known.agg(F.max("id")).first()[0] or 0
    new = before(first, F.floor(F.col("first")["ts"] / DAY), ["first"], F.lit(1), "n_").select("symbol", (F.col("n_") + 1 + base).cast("long").alias("id"))
    return new if known is None else known.select("symbol", "id").union(new)


def document_frequency(stacks: DataFrame) -> DataFrame:
    """(symbol, df): in how many documents a symbol is."""
    return occurrences(stacks).select("doc", "symbol").distinct().groupBy("symbol").agg(F.count("*").alias("df"))


def vocabulary(stacks: DataFrame) -> DataFrame:
    """(symbol, id, df)."""
    return register(stacks).join(document_frequency(stacks), "symbol")


def encode(stacks: DataFrame, vocab: DataFrame, n_docs) -> DataFrame:
    """(doc, ids, shares): a stack's symbols as numbers, unknown ones 0, and their shares of documents."""
    rows = occurrences(stacks).join(vocab, "symbol", "left")
    made = F.struct("pos", F.coalesce("id", F.lit(0)).alias("id"), (F.coalesce("df", F.lit(0)) / F.greatest(F.lit(n_docs), F.lit(1))).alias("share"))
    out = rows.groupBy("doc").agg(F.array_sort(F.collect_list(made)).alias("x"))
    return out.select("doc", F.col("x")["id"].alias("ids"), F.col("x")["share"].alias("shares"))
