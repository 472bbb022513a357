"""Near-duplicate vectors by NN-descent, per label, by cosine in double precision.

Equal vectors of a label are one node with a weight. A first graph comes from random-hyperplane codes: nodes sorted by code are cut
into blocks of BLOCK rows, each row takes its nearest K in its block, over TABLES codes. Each round joins neighbours of neighbours: the
members of a node's list, and the nodes that list it, are compared with each other, and every node keeps its nearest K; a list that
is full of links (cosine at or above the threshold) is saturated and may grow, twice as long each round. A hub's members are dealt
over groups of at most about GROUP. Links join into components by iterative joins.

Recall is audited against brute force over AUDIT sampled rows; below `target` another round runs with lists twice as long,
and a recall below LEAST after the last round is an error. At last
each component's links are counted exactly, block against block, so that a list's length limits no count: only counts leave a
block, never pairs.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components, or whose label is null, links with
nothing and is its own component; so do vectors of different lengths; repeated rows count as vectors of their own.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, materialize

THRESHOLD, K, TABLES, BITS, BLOCK, GROUP, AUDIT, ROUNDS, LEAST = 0.98, 8, 4, 24, 256, 64, 256, 2, 0.9


def unit(column, rows=None):
    """Rows of a list column as a matrix of unit vectors in double precision."""
    import numpy as np

    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(flat), -1)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def nearest(sims, k: int):
    """(row, column) of each row's k largest entries, the diagonal apart; the matrix is changed."""
    import numpy as np

    n = len(sims)
    np.fill_diagonal(sims, -2)
    k = min(k, n - 1)
    if k <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(n), k), top.ravel()


def first_graph(v: DataFrame, k: int) -> DataFrame:
    """(id, other, sim): from blocks of nodes sorted by hyperplane code."""

    def codes(batches):
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            col = batch.column(2)
            dims = np.diff(col.offsets.to_numpy())
            code = np.zeros((TABLES, batch.num_rows), np.int64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                m = unit(col.take(pa.array(at)))
                for t in range(TABLES):
                    planes = np.random.default_rng([t, d]).standard_normal((d, BITS))
                    code[t, at] = (m @ planes > 0) @ (1 << np.arange(BITS)[::-1])
            for t in range(TABLES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, t, np.int32)), batch.column(1), pa.array(dims.astype(np.int32)), pa.array(code[t]), batch.column(0), col], names=["t", "label", "dim", "code", "id", "vec"])

    def near(batches):
        import numpy as np

        held, key = [], None

        def done():
            if len(held) < 2:
                return None
            ids = np.array([h[0] for h in held])
            m = np.array([h[1] for h in held])
            sims = m @ m.T
            a, b = nearest(sims.copy(), k)
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(sims[a, b])], names=["id", "other", "sim"])

        for batch in batches:
            for t, label, dim, i, vec in zip(*(batch.column(c).to_pylist() for c in ("t", "label", "dim", "id")), batch.column("vec")):
                if (t, label, dim) != key or len(held) == BLOCK:
                    if (out := done()) is not None:
                        yield out
                    held, key = [], (t, label, dim)
                x = np.asarray(vec.values.to_numpy(zero_copy_only=False), np.float64)
                held.append((i, x / np.sqrt(x @ x)))
        if (out := done()) is not None:
            yield out

    rows = v.select("id", "label", "vec").mapInArrow(codes, "t int, label int, dim int, code long, id long, vec array<double>")
    order = ["t", "label", "dim", "code", F.xxhash64("id")]
    parts = max(v.sparkSession.sparkContext.defaultParallelism, int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(near, "id long, other long, sim double")


def best(pairs: DataFrame, k: int, grown: int, threshold: float) -> DataFrame:
    """Each node's nearest k, and beyond them links up to `grown` where the list is saturated."""
    pairs = pairs.groupBy("id", "other").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "other"))
    return pairs.withColumn("r_", rank).filter((F.col("r_") <= k) | ((F.col("sim") >= threshold) & (F.col("r_") <= grown))).drop("r_")


def descend(graph: DataFrame, v: DataFrame, k: int, grown: int, threshold: float) -> DataFrame:
    """One round: members of each node's neighbourhood meet."""
    both = graph.select(F.col("id").alias("centre"), F.col("other").alias("member")).union(graph.select(F.col("other").alias("centre"), F.col("id").alias("member"))).distinct()
    size = both.groupBy("centre").agg(F.count("*").alias("n_")).withColumnRenamed("centre", "c_")
    dealt = both.join(size, both.centre == size.c_).select("centre", "member", F.pmod(F.xxhash64("member", "centre"), F.ceil(F.col("n_") / GROUP)).alias("salt"))
    vecs = dealt.join(v.select(F.col("id").alias("m_"), "vec"), F.col("member") == F.col("m_")).select("centre", "salt", "member", "vec")

    def meet(group: pa.Table) -> pa.Table:
        import numpy as np

        ids, m = group.column("member").to_numpy(), unit(group.column("vec"))
        sims = m @ m.T
        a, b = nearest(sims.copy(), max(3, k // 2))
        return pa.table({"id": ids[a], "other": ids[b], "sim": sims[a, b]})

    found = vecs.groupBy("centre", "salt").applyInArrow(meet, "id long, other long, sim double")
    return materialize(best(graph.union(found), k, grown, threshold), "graph")


def recall(v: DataFrame, comp: DataFrame, threshold: float, queries: int = AUDIT) -> float:
    """Share of the true links of sampled nodes whose ends share a component; the sample is bounded, its partners are not."""
    import numpy as np

    named = v.join(comp, v.id == comp.node, "left").select("id", "label", "vec", F.coalesce("component", "id").alias("comp"))
    asked = named.orderBy(F.xxhash64("id"), "id").limit(queries).toArrow()
    if not asked.num_rows:
        return 1.0
    qs = list(zip(asked.column("id").to_pylist(), asked.column("label").to_pylist(), asked.column("comp").to_pylist(), [np.array(x, np.float64) for x in asked.column("vec").to_pylist()]))

    def run(batches):
        for batch in batches:
            true = same = 0
            dims = np.diff(batch.column("vec").offsets.to_numpy())
            ids, labels, comps = (batch.column(c).to_numpy() for c in ("id", "label", "comp"))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                own = [q for q in qs if len(q[3]) == d]
                if not own:
                    continue
                m = unit(batch.column("vec").take(pa.array(at)))
                q = np.array([x[3] for x in own])
                q /= np.sqrt((q * q).sum(1, keepdims=True))
                hit = (q @ m.T >= threshold) & (np.array([x[1] for x in own])[:, None] == labels[at]) & (np.array([x[0] for x in own])[:, None] != ids[at])
                true += int(hit.sum())
                same += int((hit & (np.array([x[2] for x in own])[:, None] == comps[at])).sum())
            yield pa.RecordBatch.from_arrays([pa.array([true]), pa.array([same])], names=["t", "s"])

    got = named.mapInArrow(run, "t long, s long").agg(F.sum("t"), F.sum("s")).first()
    return got[1] / got[0] if got[0] else 1.0


def count_links(v: DataFrame, comp: DataFrame, threshold: float) -> DataFrame:
    """(id, n): the weights of each node's links within its component, block against block."""
    sizes = comp.groupBy("component").agg(F.count("*").alias("n_")).withColumnRenamed("component", "k_")
    rows = comp.join(sizes, comp.component == sizes.k_).withColumn("blocks", F.ceil(F.col("n_") / BLOCK).cast("int"))
    rows = rows.join(v, rows.node == v.id).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.select("component", "id", "w", "vec", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"))
    rows = rows.select("component", F.least("own", "to").alias("low"), F.greatest("own", "to").alias("high"), "own", "id", "w", "vec")

    def count(group: pa.Table) -> pa.Table:
        import numpy as np

        ids, w, own = (group.column(c).to_numpy() for c in ("id", "w", "own"))
        m = unit(group.column("vec"))
        if group.column("low")[0] == group.column("high")[0]:
            hit = m @ m.T >= threshold
            np.fill_diagonal(hit, False)
            return pa.table({"id": ids, "n": (hit @ w).astype(np.int64)})
        a = own == group.column("low")[0].as_py()
        hit = m[a] @ m[~a].T >= threshold
        return pa.table({"id": np.concatenate([ids[a], ids[~a]]), "n": np.concatenate([hit @ w[~a], w[a] @ hit]).astype(np.int64)})

    return rows.groupBy("component", "low", "high").applyInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, k: int = K, target: float = 0.97, max_rounds: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id) for every row of vectors (vec_id, embedding, label)."""
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("vec", lambda x: x != 0)
    rows = vectors.select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("vec"))
    rows = rows.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & ~bad, F.lit(False)))
    rows = materialize(rows.withColumn("hash", F.xxhash64("label", "vec")), "rows")
    v = rows.filter("ok").groupBy("hash", "label", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"))
    v = materialize(v, "nodes")
    grown = 2 * k
    graph = materialize(best(first_graph(v, k), k, grown, threshold), "graph")
    for i in range(max_rounds):
        grown *= 2
        nxt = descend(graph, v, k, grown, threshold)
        discard(graph)
        graph = nxt
        if i + 1 >= ROUNDS:
            comp = components(graph.filter(F.col("sim") >= threshold).select(F.col("id").alias("a"), F.col("other").alias("b")))
            found = recall(v, comp, threshold)
            if found >= target:
                break
            if i + 1 == max_rounds and found < LEAST:
                raise RuntimeError(f"recall {found:.3f} after {max_rounds} rounds")
            k *= 2
    n = count_links(v, comp, threshold)
    nodes = v.join(comp, v.id == comp.node, "left").join(n.withColumnRenamed("id", "i_"), F.col("id") == F.col("i_"), "left")
    nodes = nodes.select(F.col("hash").alias("h_"), F.col("label").alias("l_"), F.col("vec").alias("v_"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    nodes = materialize(nodes, "linked")
    out = rows.join(nodes, rows.ok & (rows.hash == nodes.h_) & (rows.label == nodes.l_) & (rows.vec == nodes.v_), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def query(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors).withColumn("kept", F.col("vec_id") == F.col("component_id"))
