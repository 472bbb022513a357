"""Helpers shared by the training-data operators: durable tables, word splitting, two-pass offsets."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words, as a Java and as a Python character class.
BLANK = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = getattr(shared_dir, "own", None)
        if base is None:
            base = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="tracelode-")
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to a new table in the shared folder and read it back, which cuts the lineage and survives lost executors.

    The table is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracelode-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a folder when the driver's JVM ends."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)


def removed(spark: SparkSession, path: str) -> None:
    """Remove a folder now."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables made by materialize() that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tracelode-" in root:
                removed(spark, root)


def release(spark: SparkSession) -> None:
    """Have the driver drop what ended plans left: Spark removes the files of shuffles that nothing refers to once the JVM sees it.

    The event of a plan's end holds the plan until all listeners, an event log among them, have had it; they are waited for, but not
    beyond half a minute.
    """
    bus = spark.sparkContext._jsc.sc().listenerBus()
    for _ in range(2):
        gc.collect()
        with contextlib.suppress(Py4JJavaError):
            bus.waitUntilEmpty(30_000)
        spark.sparkContext._jvm.System.gc()


def mixed(x):
    """A 64-bit finalizer, for numpy arrays."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def crc32_of(col: Column) -> Column:
    """Unsigned CRC-32 of a column's text form."""
    return F.crc32(col.cast("string").cast("binary"))


def held_out(col: Column, mod: int, rest: int) -> Column:
    """True where the CRC-32 of the id's text leaves the given remainder; a null id is never held out."""
    return F.coalesce(crc32_of(col) % mod == rest, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_list(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def with_starts(df: DataFrame, group: str, size: str, name: str) -> DataFrame:
    """Add `start`: the sum of `size` over the rows of the same group (null is a group) that come before, without dealing rows anew.

    First pass: each partition adds up its own rows in the order read and keeps its number. Second pass: sums over the totals of
    partitions give each partition's base. Only totals, one row per partition and group, are sorted. The first pass is kept in
    the shared folder, so that both passes see the same partitions.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("part_", T.IntegerType()), T.StructField("local_", T.LongType())])

    def first(batches):
        import numpy as np
        import pandas as pd

        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            n = batch.num_rows
            codes, keys = pd.factorize(pd.Series(batch.column(group).to_pylist(), dtype=object), use_na_sentinel=False)
            sizes = batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = [None if k is None or k != k else k for k in keys]
            upto = pd.Series(sizes).groupby(codes).cumsum().to_numpy()
            base = np.array([seen.get(k, 0) for k in keys], dtype=np.int64)
            local = upto - sizes + base[codes]
            for k, total in zip(keys, pd.Series(sizes).groupby(codes).sum().to_numpy()):
                seen[k] = seen.get(k, 0) + int(total)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(local)], names=[*batch.schema.names, "part_", "local_"])

    kept = materialize(df.mapInArrow(first, schema), name)
    totals = kept.groupBy("part_", group).agg(F.sum(size).alias("total_"))
    before = Window.partitionBy(group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("part_").alias("p_"), F.col(group).alias("g_"), F.coalesce(F.sum("total_").over(before), F.lit(0)).alias("base_"))
    joined = kept.join(bases, (F.col("part_") == F.col("p_")) & F.col(group).eqNullSafe(F.col("g_")), "left")
    return joined.withColumn("start", F.col("local_") + F.col("base_")).drop("part_", "local_", "p_", "g_", "base_")


def ordered_starts(df: DataFrame, group: str, size: str, key: str, name: str) -> DataFrame:
    """Add `start`: the sum of `size` over the rows of the same group (null is a group) that come before in the order of `key`.

    key is a 64-bit hash, read unsigned, and is dropped; rows of equal keys follow one another in any order. How rows lie doesn't
    matter: a row's bucket is the leading bits of its key, buckets are sorted and added up apart, and only their totals, one row
    per bucket and group, are summed in order.
    """
    spark = df.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    bits = min(40, (8 * parts).bit_length())
    rows = df.withColumn("part_", F.shiftrightunsigned(key, 64 - bits)).repartition(parts, "part_").sortWithinPartitions("part_", key).drop(key)
    schema = T.StructType([*rows.schema.fields, T.StructField("local_", T.LongType())])

    def first(batches):
        import numpy as np
        import pandas as pd

        seen: dict = {}
        for batch in batches:
            keys, part = batch.column(group).dictionary_encode(), batch.column("part_").to_numpy()
            names, codes = keys.dictionary.to_pylist(), keys.indices.fill_null(len(keys.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = batch.column(size).to_numpy(zero_copy_only=False).astype(np.int64)
            both, at = np.unique(np.stack([part, codes]), axis=1, return_inverse=True)
            at = at.ravel()
            upto = pd.Series(sizes).groupby(at).cumsum().to_numpy()
            pairs = [(p, names[c] if c < len(names) else None) for p, c in both.T.tolist()]
            base = np.array([seen.get(x, 0) for x in pairs], np.int64)
            totals = np.bincount(at, sizes, len(pairs))
            last = part[-1] if len(part) else None
            seen = {x: v for x, v in seen.items() if x[0] == last} | {x: int(b + n) for x, b, n in zip(pairs, base, totals) if x[0] == last}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - sizes + base[at])], names=[*batch.schema.names, "local_"])

    kept = materialize(rows.mapInArrow(first, schema), name)
    before = Window.partitionBy(group).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    totals = kept.groupBy("part_", group).agg(F.sum(size).alias("total_"))
    bases = totals.select(F.col("part_").alias("p_"), F.col(group).alias("g_"), F.coalesce(F.sum("total_").over(before), F.lit(0)).alias("base_"))
    met = kept.join(bases, (F.col("part_") == F.col("p_")) & F.col(group).eqNullSafe(F.col("g_")), "left")
    return met.withColumn("start", F.col("local_") + F.col("base_")).drop("part_", "local_", "p_", "g_", "base_")


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components: (node, component) for every node of edges (a, b), component being its smallest node.

    Each round points every node at its smallest neighbour or itself, doubles the pointers twice, and rewrites the edges onto the
    pointers; joined parts shrink by large factors, so a few rounds suffice. All state is tables: nothing reaches the driver but
    a count of the remaining edges. A smallest node is never pointed elsewhere, so it names its component.
    """
    e = materialize(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct(), name)
    maps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.union(e.select("b", "a"))
        to = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        to = materialize(to, name)
        for _ in range(2):
            up = to.select(F.col("a").alias("x"), F.col("p").alias("y"))
            nxt = materialize(to.join(up, to.p == up.x).select("a", F.col("y").alias("p")), name)
            discard(to)
            to = nxt
        maps.append(to)
        l, r = to.select(F.col("a").alias("la"), F.col("p").alias("lp")), to.select(F.col("a").alias("ra"), F.col("p").alias("rp"))
        nxt = e.join(l, e.a == l.la).join(r, e.b == r.ra).select(F.least("lp", "rp").alias("a"), F.greatest("lp", "rp").alias("b")).filter("a <> b").distinct()
        nxt = materialize(nxt, name)
        discard(e)
        e = nxt
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[-1].select(F.col("a").alias("node"), F.col("p").alias("component"))
    for m in reversed(maps[:-1]):
        up = out.select(F.col("node").alias("x"), F.col("component").alias("y"))
        out = m.join(up, m.p == up.x, "left").select(F.col("a").alias("node"), F.coalesce("y", "p").alias("component"))
    return materialize(out, name)
