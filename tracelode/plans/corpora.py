"""Report corpora drawn from the driver's tables, each with its SQL twin.

baskets: an order is a report, the brands of its line items its frames, its customer's oldest order its bucket.
accounts: a customer is a report, each of its orders a stack.
named: a part makes a frame with a function and a library.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import vocabulary

BROADCAST = 1 << 21  # parts sent to all tasks at most


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def baskets(spark: SparkSession, sf_dir: str, kept: Callable[[Column], Column] | None = None) -> DataFrame:
    """(report, ts, cust, bucket, frames); orders without line items have no stack and are no reports.

    kept: a column of the frames to keep in their place, so that stacks are not dealt to customers.

    Up to BROADCAST parts go to all tasks, more are joined by a shuffle. Line items are dealt to their orders as flat rows: a row of
    lists for each would be several times as large where few of an order's items lie in one task.
    """
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    parts = F.broadcast(parts) if parts.count() <= BROADCAST else parts
    li = table(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "p_brand").repartition("l_orderkey")
    frames = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "p_brand")))
    frames = li.groupBy("l_orderkey").agg(frames["p_brand"].alias("frames"))
    frames = frames.select("l_orderkey", kept(F.col("frames"))) if kept else frames
    reports = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report"), F.unix_timestamp("o_orderdate").alias("ts"), F.col("o_custkey").alias("cust"))
    rows = reports.join(frames, F.col("report") == F.col("l_orderkey")).drop("l_orderkey")
    return rows.withColumn("bucket", F.min(F.struct("ts", "report")).over(Window.partitionBy("cust"))["report"])


def encoded(rows: DataFrame) -> DataFrame:
    """Reports with ids and shares of their frames."""
    stacks = rows.select(F.col("report").alias("doc"), "ts", "frames")
    codes = vocabulary.encode(stacks, vocabulary.vocabulary(stacks), rows.count())
    return rows.join(codes, F.col("report") == F.col("doc")).drop("doc")


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, function, dylib): raw names as reports carry them, some missing, some empty."""
    k = F.col("p_partkey")
    function = F.concat(F.when(k % 4 == 0, "__GI_").when(k % 4 == 1, "_").otherwise(""), F.translate("p_name", " ", "."), F.lit("("), F.col("p_type"), F.lit(", f("), F.col("p_brand"), F.lit(")) const"))
    library = F.concat(F.lit("/usr/lib/"), F.translate("p_type", " ", "_"), F.lit(".so."), F.col("p_size"))
    rows = table(spark, sf_dir, "part")
    return rows.select("p_partkey", F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "").otherwise(function).alias("function"), F.when(k % 7 == 0, F.lit(None)).otherwise(library).alias("dylib"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bug_id, dup_id, ts): orders with duplicate-of links: none, to the one before, to no report, to self, and in cycles of two."""
    k = F.col("o_orderkey")
    dup = F.when(k % 7 == 1, k - 1).when(k % 7 == 2, k + 10_000_000 + k % 50).when(k % 7 == 3, k).when(k % 7 == 4, k + 1).when(k % 7 == 5, k - 1)
    return table(spark, sf_dir, "orders").select(k.alias("bug_id"), dup.alias("dup_id"), F.unix_timestamp("o_orderdate").alias("ts"))


def accounts(spark: SparkSession, sf_dir: str, codes: bool = True) -> DataFrame:
    """(report, stack, frames, ids, shares, block): customers with a stack per order; block: nation, segment and first brand of the longest stack.

    Without codes, ids and shares are left out, and no vocabulary is made.
    """
    rows = baskets(spark, sf_dir)
    rows = encoded(rows) if codes else rows
    longest = Window.partitionBy("cust").orderBy(F.desc(F.size("frames")), "ts", "report")
    lead = rows.withColumn("lead", F.first(F.get("frames", F.lit(0))).over(longest))
    cust = table(spark, sf_dir, "customer")
    out = lead.join(cust, F.col("cust") == F.col("c_custkey"))
    block = F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_mktsegment", "lead")
    return out.select(F.col("cust").alias("report"), F.col("report").alias("stack"), "frames", *(["ids", "shares"] if codes else []), block.alias("block"))


def account_pairs(stacks: DataFrame) -> DataFrame:
    reports = stacks.select("report", "block").distinct()
    other = reports.select(F.col("report").alias("cand"), F.col("block").alias("b_"))
    return reports.join(other, (F.col("block") == F.col("b_")) & (F.col("cand") < F.col("report"))).select(F.col("report").alias("query"), "cand")


BASKETS_SQL = """
fr AS (SELECT l_orderkey AS report, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, p_brand AS symbol FROM lineitem JOIN part ON l_partkey = p_partkey),
rp AS (SELECT o_orderkey AS report, CAST(epoch(o_orderdate) AS BIGINT) AS ts, o_custkey AS cust FROM orders WHERE o_orderkey IN (SELECT report FROM fr)),
bk AS (SELECT report, ts, cust, first_value(report) OVER (PARTITION BY cust ORDER BY ts, report) AS bucket FROM rp),
oc AS (SELECT fr.report, pos, symbol, ts FROM fr JOIN rp USING (report)),
fs AS (SELECT report, list(symbol ORDER BY pos) AS frames, CAST(count(*) AS BIGINT) AS n FROM oc GROUP BY report),
nd AS (SELECT count(*) AS n_docs FROM rp),
vo AS (SELECT symbol, row_number() OVER (ORDER BY k) AS id, df FROM (SELECT symbol, min({'a': ts, 'b': report, 'c': pos}) AS k, count(DISTINCT report) AS df FROM oc GROUP BY symbol)),
en AS (SELECT report, list(id ORDER BY pos) AS ids, list(df / n_docs ORDER BY pos) AS w FROM oc JOIN vo USING (symbol), nd GROUP BY report)"""
PAIRS_SQL = BASKETS_SQL + """,
pr AS (SELECT q.report AS query, c.report AS cand, row_number() OVER (PARTITION BY q.report ORDER BY c.ts, c.report) AS cand_pos FROM bk q JOIN bk c ON q.bucket = c.bucket AND c.ts <= q.ts AND c.report <> q.report),
sq AS (SELECT query, cand, a.ids AS q, b.ids AS c, a.w AS qw, b.w AS cw, len(a.ids) AS m, len(b.ids) AS n FROM pr JOIN en a ON a.report = query JOIN en b ON b.report = cand)"""
BLOCKED_SQL = BASKETS_SQL + """,
ky AS (SELECT bk.report, ts, bucket, frames, frames[1] || '.' || frames[2] AS key FROM bk JOIN fs USING (report) WHERE n > 2),
pb AS (SELECT q.report AS query, c.report AS cand, row_number() OVER (PARTITION BY q.report ORDER BY c.ts, c.report) AS cand_pos, q.bucket = c.bucket AS same, q.frames AS q, c.frames AS c FROM ky q JOIN ky c ON q.key = c.key AND c.ts <= q.ts AND c.report <> q.report)"""
PREFIX_SQL = "len(list_filter(range(1, least(len(q), len(c)) + 1), lambda i: q[1:i] = c[1:i])) / greatest(len(q), len(c))"
RANKS_SQL = BLOCKED_SQL + f""",
sb AS (SELECT query, cand, cand_pos, same, {PREFIX_SQL} AS score FROM pb),
rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, cand_pos DESC) - 1 AS rank FROM sb),
fc AS (SELECT query, CAST(coalesce(min(CASE WHEN same THEN rank END), 99999) AS BIGINT) AS rank, max(score) AS top_score, max(CASE WHEN rank = 0 AND same THEN 1 ELSE 0 END) AS top_correct FROM rk GROUP BY query),
au AS (SELECT sum(p * (below + n / 2)) AS w, sum(p) AS p, sum(n) AS n FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY top_score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT top_score, sum(top_correct) AS p, sum(1 - top_correct) AS n FROM fc GROUP BY top_score)))"""
ACCOUNTS_SQL = BASKETS_SQL + """,
ld AS (SELECT bk.report, cust, frames, first_value(frames[1]) OVER (PARTITION BY cust ORDER BY n DESC, ts, bk.report) AS lead FROM bk JOIN fs USING (report)),
ac AS (SELECT cust AS report, ld.report AS stack, ids, w, concat_ws('|', CAST(c_nationkey AS VARCHAR), c_mktsegment, lead) AS block FROM ld JOIN customer ON cust = c_custkey JOIN en ON en.report = ld.report),
rb AS (SELECT DISTINCT report, block FROM ac),
ap AS (SELECT a.report AS query, b.report AS cand FROM rb a JOIN rb b ON a.block = b.block AND b.report < a.report),
mx AS (SELECT query, cand, x.stack AS q_idx, y.stack AS c_idx, x.ids AS q, y.ids AS c FROM ap JOIN ac x ON x.report = query JOIN ac y ON y.report = cand),
ms AS (SELECT query, cand, q_idx, c_idx, """ + PREFIX_SQL + """ AS score FROM mx),
qm AS (SELECT query, cand, avg(b) AS qa, count(*) AS qn FROM (SELECT query, cand, q_idx, max(score) AS b FROM ms GROUP BY ALL) GROUP BY query, cand),
cm AS (SELECT query, cand, avg(b) AS ca, count(*) AS cn FROM (SELECT query, cand, c_idx, max(score) AS b FROM ms GROUP BY ALL) GROUP BY query, cand)"""
NAMED_SQL = """
nm AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN '' ELSE concat(CASE p_partkey % 4 WHEN 0 THEN '__GI_' WHEN 1 THEN '_' ELSE '' END, replace(p_name, ' ', '.'), '(', p_type, ', f(', p_brand, ')) const') END AS function,
CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE concat('/usr/lib/', replace(p_type, ' ', '_'), '.so.', p_size) END AS dylib FROM part),
cl AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(function, '\\(.*\\)', '', 'g'), '^_*GI_+', ''), '^_+', '') AS f, regexp_replace(regexp_extract(dylib, '[^/]*$'), '\\.\\d+$', '') AS d FROM nm)"""
LINKS_SQL = """
lk AS (SELECT o_orderkey AS bug_id, CASE o_orderkey % 7 WHEN 1 THEN o_orderkey - 1 WHEN 2 THEN o_orderkey + 10000000 + o_orderkey % 50 WHEN 3 THEN o_orderkey WHEN 4 THEN o_orderkey + 1 WHEN 5 THEN o_orderkey - 1 END AS dup_id, CAST(epoch(o_orderdate) AS BIGINT) AS ts FROM orders),
eg AS (SELECT bug_id AS a, dup_id AS b FROM lk WHERE dup_id IS NOT NULL AND dup_id <> bug_id UNION SELECT dup_id, bug_id FROM lk WHERE dup_id IS NOT NULL AND dup_id <> bug_id),
rc(a, b) AS (SELECT a, a FROM eg UNION SELECT rc.a, eg.b FROM rc JOIN eg ON rc.b = eg.a),
gp AS (SELECT bug_id, ts, coalesce(g, bug_id) AS grp FROM lk LEFT JOIN (SELECT a, min(b) AS g FROM rc GROUP BY a) ON a = bug_id),
bu AS (SELECT bug_id, ts, first_value(bug_id) OVER (PARTITION BY grp ORDER BY ts, bug_id) AS bucket_id FROM gp)"""
