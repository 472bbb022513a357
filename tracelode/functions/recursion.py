"""Removal of repeated blocks from frame sequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def without_recursion(frames: list[str]) -> list[str]:
    """Fold runs of a block that repeats at once, at the leftmost place and the shortest block first, until none is left."""
    out = list(frames)
    while True:
        places: dict[str, list[int]] = {}
        found = None
        for i, f in enumerate(out):
            for p in reversed(places.get(f, ())):  # nearest first: the shortest block
                n = i - p
                if out[p:i] == out[i : i + n]:
                    found = (i, n)
                    break
            if found:
                break
            places.setdefault(f, []).append(i)
        if not found:
            return out
        i, n = found
        end = i + n
        while out[end : end + n] == out[i - n : i]:
            end += n
        out = out[:i] + out[end:]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def remove_recursion(frames: pd.Series) -> pd.Series:
    return frames.map(lambda x: None if x is None else without_recursion(list(x)))


def fold_runs(frames):
    """The JVM form for blocks of one symbol: equal neighbours fold."""
    return F.filter(frames, lambda x, i: (i == 0) | ~(x.eqNullSafe(F.get(frames, i - 1))))
