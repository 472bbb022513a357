"""Search over parameters: settings as a relation, measured together."""

from __future__ import annotations

import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scoring import FAR

#: Search spaces (fixed values): lower bound, upper bound, default.
SPACES = {
    "brodie": {"gap": (0.0, 10.0, 2.5)},
    "trace_sim": {"df_coef": (0.0, 3.0, 0.5), "pos_coef": (0.0, 50.0, 1.0), "diff_coef": (0.0, 2.0, 1.0)},
    "fast": {"alpha": (0.0, 50.0, 1.0), "beta": (0.0, 50.0, 1.0), "gamma": (0.0, 50.0, 1.0)},
}
#: Arguments that the search leaves alone (fixed values).
TRACE_SIM_FIXED = {"match": 1.0, "gap": 1.0, "mismatch": 1.0, "sigmoid": True, "gamma": 1.0, "use_sum": True, "use_idf": True, "const_match": False, "reciprocal": True, "no_norm": False}
AGGREGATES = ("max", "avg_query", "avg_cand", "avg_short", "avg_long", "avg_query_cand")
EVALUATIONS = 50


def defaults(method: str) -> dict:
    return {k: v[2] for k, v in SPACES[method].items()} | {"aggregate": AGGREGATES[0]}


def draw(method: str, n: int = EVALUATIONS, seed: int = 0, start: dict | None = None) -> list[dict]:
    """n settings: the start or the defaults first, then uniform draws."""
    rng = random.Random(seed)
    made = [{**defaults(method), **(start or {})}]
    while len(made) < n:
        made.append({k: rng.uniform(a, b) for k, (a, b, _) in SPACES[method].items()} | {"aggregate": rng.choice(AGGREGATES)})
    return made[:n]


def relation(spark: SparkSession, settings: list[dict]) -> DataFrame:
    names = list(settings[0])
    return spark.createDataFrame([(i, *(s[k] for k in names)) for i, s in enumerate(settings)], ["param_id", *names])


def evaluate(scored: DataFrame) -> DataFrame:
    """(param_id, query, cand_pos, score, same) -> (param_id, mrr, rr1)."""
    by = Window.partitionBy("param_id", "query").orderBy(F.desc("score"), F.desc("cand_pos"))
    rows = scored.withColumn("rank", F.row_number().over(by) - 1).groupBy("param_id", "query").agg(F.coalesce(F.min(F.when(F.col("same"), F.col("rank"))), F.lit(FAR)).alias("rank"))
    return measured(rows)


def measured(ranks: DataFrame) -> DataFrame:
    """(param_id, query, rank) -> (param_id, mrr, rr1)."""
    return ranks.groupBy("param_id").agg(F.avg(1 / (F.col("rank") + 1)).alias("mrr"), F.avg((F.col("rank") < 1).cast("double")).alias("rr1"))


@dataclass
class Tuner:
    """Fit by search: `loss` takes a setting and returns the objective; a warm start keeps the last best."""

    method: str
    incremental: bool = False
    seed: int = 0
    best: dict = field(default_factory=dict)

    def fit(self, loss, n: int = EVALUATIONS) -> dict:
        tried = draw(self.method, n, self.seed, self.best if self.incremental else None)
        self.best = min(tried, key=loss)
        return self.best
