"""From stack scores to report scores, ranks and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.symbols import NO_SCORE, max_weight, mean_weight, strip
from .tables import before, durable

FAR = 99999
AGGREGATES = ("max", "avg_query", "avg_cand", "avg_short", "avg_long", "avg_query_cand")


def select_one(stacks: DataFrame) -> DataFrame:
    """(report, stack, shares, ...) -> each report's rarest stack: by greatest, then mean, weight, of nine digits; the first of equals."""
    by = Window.partitionBy("report").orderBy(F.desc("w_max"), F.desc("w_mean"), "stack")
    weighed = stacks.withColumns({"w_max": F.round(max_weight(F.col("shares")), 9), "w_mean": F.round(F.coalesce(mean_weight(F.col("shares")), F.lit(-1.0)), 9)})
    return weighed.withColumn("r_", F.row_number().over(by)).filter("r_ = 1").drop("r_", "w_max", "w_mean")


def rarity_threshold(vocab: DataFrame, n_docs, k: float) -> DataFrame:
    """One row: 1 - df at place floor((1 - k) V) among all symbols in ascending order, the unknown symbol among them."""
    if not 0 < k <= 1:
        raise ValueError("k must be above 0 and at most 1")
    counts = vocab.groupBy("df").agg(F.count("*").alias("n")).union(vocab.sparkSession.createDataFrame([(0, 1)], "df long, n long"))
    rows = counts.groupBy((1 - F.col("df") / F.greatest(F.lit(n_docs), F.lit(1))).alias("v")).agg(F.sum("n").alias("n"))  # a row per frequency that occurs
    upto = rows.withColumn("upto", F.sum("n").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    size = rows.agg(F.sum("n").alias("size"))
    return upto.crossJoin(size).filter(F.col("upto") > F.floor((1 - F.lit(k)) * F.col("size"))).agg(F.min("v").alias("threshold"))


def keep_rare(stacks: DataFrame, threshold: DataFrame) -> DataFrame:
    """Stacks with a frame at least as rare as the threshold, the one row of rarity_threshold()."""
    limit = F.broadcast(threshold.select(F.col("threshold").alias("limit_")))
    return stacks.crossJoin(limit).filter(F.exists("shares", lambda x: 1 - x >= F.col("limit_"))).drop("limit_")


def prepared(stacks: DataFrame, keep: str | None = None, threshold: DataFrame | None = None, stop: tuple = (), edges: bool = True) -> DataFrame:
    """(report, stack, ids, shares, ...) as compared: stop symbols stripped, at both ends or everywhere, without empty stacks.

    keep: None for all, `one` for each report's rarest stack, `rare` for the stacks above the threshold.
    """
    if keep not in (None, "one", "rare") or (keep == "rare") != (threshold is not None):
        raise ValueError("keep is None, 'one', or 'rare' with a threshold")
    if stop:
        left = strip(F.arrays_zip("ids", "shares"), lambda x: x["ids"].isin(*stop), edges)
        stacks = stacks.withColumn("left_", left).withColumns({"ids": F.col("left_")["ids"], "shares": F.col("left_")["shares"]}).drop("left_")
    stacks = stacks.filter(F.size("ids") > 0)
    return select_one(stacks) if keep == "one" else keep_rare(stacks, threshold) if keep == "rare" else stacks


def aggregate(matrix: DataFrame, keys: list[str], kind: str, weighted: bool = False) -> DataFrame:
    """(keys, q_idx, c_idx, score, and weights q_w, c_w if weighted) -> (keys, score) by the named kind."""
    if kind not in AGGREGATES:
        raise ValueError(f"no such aggregate: {kind}")
    if kind == "max":
        return matrix.groupBy(*keys).agg(F.max("score").alias("score"))

    def side(s: str) -> DataFrame:
        w = F.first(f"{s}_w") if weighted else F.lit(1.0)
        best = matrix.groupBy(*keys, f"{s}_idx").agg(F.max("score").alias("best"), w.alias("w"))
        return best.groupBy(*keys).agg((F.sum(F.col("best") * F.col("w")) / F.sum("w")).alias(f"{s}_mean"), F.count("*").alias(f"{s}_n"))

    if kind in ("avg_query", "avg_cand"):
        s = "q" if kind == "avg_query" else "c"
        return side(s).select(*keys, F.col(f"{s}_mean").alias("score"))
    both = side("q").join(side("c"), keys)
    by_query = F.col("q_n") <= F.col("c_n") if kind == "avg_short" else F.col("q_n") >= F.col("c_n")
    mean = (F.col("q_mean") + F.col("c_mean")) / 2 if kind == "avg_query_cand" else F.when(by_query, F.col("q_mean")).otherwise(F.col("c_mean"))
    return both.select(*keys, mean.alias("score"))


def compare(pairs: DataFrame, stacks: DataFrame, score, kind: str = "max", keep: str | None = None, threshold: DataFrame | None = None, stop: tuple = (), edges: bool = True) -> DataFrame:
    """pairs (query, cand), stacks (report, stack, ids, shares) -> (query, cand, score): all stacks against all, then the aggregate.

    Stacks are first stripped and chosen, see prepared(). Candidates left without a stack, and all of such a query, keep the sentinel score.
    """
    stacks = prepared(stacks, keep, threshold, stop, edges)
    q = stacks.select(F.col("report").alias("query"), F.col("stack").alias("q_idx"), F.col("ids").alias("q"), F.col("shares").alias("qw"))
    c = stacks.select(F.col("report").alias("cand"), F.col("stack").alias("c_idx"), F.col("ids").alias("c"), F.col("shares").alias("cw"))
    matrix = pairs.select("query", "cand").join(q, "query").join(c, "cand").withColumn("score", score(F.col("q"), F.col("c"), F.col("qw"), F.col("cw")))
    got = aggregate(matrix.select("query", "cand", "q_idx", "c_idx", "score"), ["query", "cand"], kind)
    return pairs.join(got, ["query", "cand"], "left").withColumn("score", F.coalesce("score", F.lit(NO_SCORE)))


def fast(pairs: DataFrame, alpha: float, beta: float, gamma: float) -> DataFrame:
    """(query, cand, q, qw, c, cw) -> (query, cand, score), for pairs that are not both empty: the registry's `fast`, in one pass."""
    score = kernels.similarity("fast", alpha, beta, gamma)
    return pairs.filter(F.size("q") + F.size("c") > 0).select("query", "cand", score(F.col("q"), F.col("c"), F.col("qw"), F.col("cw")).alias("score"))


def ranked(scores: DataFrame) -> DataFrame:
    """(query, cand, cand_pos, score, same) with 0-based rank: by score, later candidates first among equals."""
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("cand_pos"))
    return scores.withColumn("rank", (F.row_number().over(by) - 1).cast("long"))


def first_correct(scores: DataFrame) -> DataFrame:
    """(query, rank, top_score, top_correct): rank of the first candidate of the query's bucket, FAR where there is none."""
    rows = ranked(scores)
    return rows.groupBy("query").agg(F.coalesce(F.min(F.when(F.col("same"), F.col("rank"))), F.lit(FAR).cast("long")).alias("rank"), F.max("score").alias("top_score"), F.max(((F.col("rank") == 0) & F.col("same")).cast("int")).alias("top_correct"))


def queries_each(ranks: DataFrame) -> Column:
    """How many queries a row stands for: its n, or one."""
    return F.col("n") if "n" in ranks.columns else F.lit(1)


def rank_metrics(ranks: DataFrame, cuts=(1, 5, 10)) -> DataFrame:
    n = queries_each(ranks)
    return ranks.agg((F.sum(n / (F.col("rank") + 1)) / F.sum(n)).alias("mrr"), *[(F.sum(F.when(F.col("rank") < k, n).otherwise(0)) / F.sum(n)).alias(f"rr{k}") for k in cuts], F.coalesce(F.sum(n), F.lit(0)).alias("n_queries"))


def auc(ranks: DataFrame) -> DataFrame:
    """Area under the curve of (top_score, top_correct); 0.5 without positives or negatives. Equal scores are counted first, once, as they are read twice."""
    n = queries_each(ranks)
    per = durable(ranks.groupBy("top_score").agg(F.sum(F.col("top_correct") * n).alias("p"), F.sum((1 - F.col("top_correct")) * n).alias("n")))
    placed = before(per, F.floor(F.col("top_score") * 1024), ["top_score"], F.col("n"), "below")
    sums = placed.withColumn("wins", F.col("p") * (F.col("below") + F.col("n") / 2)).agg(F.sum("wins").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select(F.coalesce(F.col("w") / F.nullif(F.col("p") * F.col("n"), F.lit(0)), F.lit(0.5)).alias("auc"))


def objective(ranks: DataFrame) -> DataFrame:
    each = durable(ranks.groupBy("rank", "top_score", "top_correct").agg(F.count("*").alias("n")))  # else queries are ranked for each figure
    m = rank_metrics(each).crossJoin(auc(each))  # one row each
    return m.select((1 - (0.4 * F.col("mrr") + 0.3 * F.col("rr1") + 0.3 * F.col("auc"))).alias("objective"))


def rank_histogram(ranks: DataFrame) -> DataFrame:
    return ranks.groupBy("rank").agg(F.count("*").alias("n"))


def confusion(rows: DataFrame, target: Column, predicted: Column) -> DataFrame:
    """Accuracy, precision and recall, kept finite by a small constant."""
    tp, fp, fn, tn = (F.sum(((target == t) & (predicted == p)).cast("double")) for t, p in ((1, 1), (0, 1), (1, 0), (0, 0)))
    eps = 1e-10
    return rows.agg(((tp + tn) / (tp + tn + fp + fn + eps)).alias("accuracy"), (tp / (tp + fp + eps)).alias("precision"), (tp / (tp + fn + eps)).alias("recall"))


def offline_metrics(predictions: DataFrame, within: int = 20) -> DataFrame:
    """(query, prediction) 1-based places per stack -> MRR and hit rate over queries; a query without any counts as 999999."""
    best = predictions.groupBy("query").agg(F.min(F.coalesce("prediction", F.lit(999999))).alias("rank"))
    return best.agg(F.avg(1 / F.col("rank")).alias("mrr"), F.avg((F.col("rank") <= within).cast("double")).alias("hits"))
