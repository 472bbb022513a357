"""Names of similarity methods, and of what they are made by; methods are also made known to SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import kernels
from .symbols import overlap_merge, prefix_match


@dataclass(frozen=True)
class Method:
    name: str
    arguments: tuple[str, ...]
    build: Callable  # arguments -> function of (q, c, q shares, c shares) columns


def kernel(name: str, method: str, *arguments: str) -> Method:
    return Method(name, arguments, lambda *a: kernels.similarity(method, *a))


METHODS = {
    m.name: m
    for m in (
        kernel("trace_sim", "trace_sim", "df_coef", "pos_coef", "diff_coef", "match", "gap", "mismatch", "sigmoid", "gamma", "use_sum", "use_idf", "const_match", "reciprocal", "no_norm"),
        kernel("brodie", "brodie", "gap"),
        kernel("fast", "fast", "alpha", "beta", "gamma"),
        kernel("damerau", "damerau", "insert", "delete", "substitute", "transpose", "swaps"),
        kernel("optimal_alignment", "optimal_alignment", "indel", "mismatch", "match"),
        kernel("position_dependent", "position_dependent", "c", "o"),
        Method("prefix_match", (), lambda: lambda q, c, qw, cw: prefix_match(q, c)),
        Method("crash_graph", (), lambda: lambda q, c, qw, cw: overlap_merge(q, c)),
    )
}


def method(name: str, *args) -> Callable[[Column, Column, Column, Column], Column]:
    if name not in METHODS:
        raise KeyError(f"no such method: {name}; there are {', '.join(sorted(METHODS))}")
    return METHODS[name].build(*args)


def load(path: str):
    """The object that `module.name` names."""
    where, _, name = path.rpartition(".")
    return getattr(importlib.import_module(where), name)


def register(spark: SparkSession) -> None:
    """Make the alignment methods, with their default arguments, SQL functions of (q, c, q shares, c shares)."""
    defaults = {"trace_sim": (), "fast": (1.0, 1.0, 1.0), "brodie": (2.5,), "damerau": (1.0, 1.0, 1.0, 1.0, True), "optimal_alignment": (1.0, 1.0, 1.0), "position_dependent": (1.0, 1.0)}

    def made(of, args):
        @F.pandas_udf("double")
        def score(q: pd.Series, c: pd.Series, qw: pd.Series, cw: pd.Series) -> pd.Series:
            return pd.Series(np.asarray(of(kernels.Batch(q.tolist(), c.tolist(), qw.tolist(), cw.tolist()), *args)))

        return score

    for name, args in defaults.items():
        spark.udf.register(name, made(kernels.METHODS[name], args))
