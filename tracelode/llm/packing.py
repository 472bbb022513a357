"""Packing by concatenation: two-pass prefix sums give global offsets, fixed windows cut the stream.

First pass: each partition tokenizes its rows in the order read, adds up tokens, and keeps the ids (two bytes each where they fit)
in the shared folder with the partition's number. Second pass: running sums over the partitions' totals give each partition's base,
and base plus local sum is a document's place in one long stream, cut every `window` tokens; a document that crosses a cut has a
record per window it touches. Only the last sequence is padded, and none where the total is a multiple of the window.

Ids are those of the `tokenizers` library for byte_bpe_50k.json, with no special tokens added, then id 1; where a text spells
<|endoftext|>, that is its own id, 50256. They are made by `tiktoken`
from the same vocabulary (byte_bpe_50k.tiktoken), which gives equal ids at a quarter of the CPU time (tested); a text it can't take is
given to `tokenizers`.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives no rows; null ids are
carried; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WINDOW, END = 2048, 1
#: The vocabulary's one added token, which a text may spell.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(2)
def encoder(vocabulary: str | None = None):
    """text -> list of ids; vocabulary is the folder of the tokenizer files, by default the installed one."""
    import base64
    import os

    import public_tokenizers
    import tiktoken

    where = (lambda n: os.path.join(vocabulary, n)) if vocabulary else public_tokenizers.path
    with open(where("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except (KeyboardInterrupt, SystemExit, MemoryError):
            raise
        except BaseException:  # the library's own panics are no Exceptions
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(where("byte_bpe_50k.json"))
            return t.encode(text, add_special_tokens=False).ids

    return encode


def tokenized(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, part, at, n, ids): at is the sum of n over the partition's earlier rows; ids are little-endian, of 16 bits if all fit, else 32."""

    def run(batches):
        import numpy as np

        encode, part, total = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            ats, ns, packed = [], [], []
            for text in batch.column(1).to_pylist():
                ids = np.array([*encode(text or ""), END], np.uint32)
                ats.append(total)
                ns.append(len(ids))
                packed.append((ids.astype("<u2") if ids.max() < 65536 else ids.astype("<u4")).tobytes())
                total += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([part] * len(ns), pa.int32()), pa.array(ats, pa.int64()), pa.array(ns, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "part", "at", "n", "ids"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, part int, at long, n long, ids binary")


def placed(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, start, n, ids): each document's place in the one stream."""
    rows = materialize(tokenized(docs, vocabulary), "tokens")
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))  # one row per partition read
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part").alias("p"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    # as many rows as tasks read the input, which the driver lists anyway
    return rows.join(F.broadcast(bases), F.col("part") == F.col("p")).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n", "ids")


def pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start and length in the document, ids_crc32, doc_tokens, sequence_id, offset, and the ids if asked for."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches):
        import numpy as np

        for batch in batches:
            cols: list[list] = [[] for _ in range(7 + with_ids)]
            for doc, at, n, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids = np.frombuffer(packed, "<u2" if len(packed) == 2 * n else "<u4").astype("<u4")
                first = 0
                while first < n:
                    seq, off = divmod(at + first, window)
                    k = min(n - first, window - off)
                    cut = ids[first : first + k]
                    for c, v in zip(cols, (doc, first, k, zlib.crc32(cut.tobytes()), n, seq, off, *([cut.tolist()] if with_ids else []))):
                        c.append(v)
                    first += k
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])

    return placed(docs, vocabulary).mapInArrow(run, schema)


def query(docs: DataFrame) -> DataFrame:
    return pieces(docs)
