"""Column expressions over symbols, frames and stacks; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "UNK"
NO_SCORE = -9999999.99  # the score of a candidate without comparable stacks


def clean_function(name: Column) -> Column:
    """Drop the argument list (first to last parenthesis of a line), then a leading GI marker, then leading underscores."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\(.*\)", ""), r"^_*GI_+", ""), r"^_+", "")


def clean_library(path: Column) -> Column:
    """The file's name without one trailing version number."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.\d+$", "")


def trim_function(name: Column, n: int) -> Column:
    """Drop the last n dotted components; all of them leave an empty name."""
    if n <= 0:
        return name
    parts = F.split(name, r"\.")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - n, F.lit(0))), ".")


def symbol(function: Column, library: Column, trim: int = 0) -> Column:
    """What a frame is compared by: its trimmed function, else its library, else the unknown symbol; empty counts as missing."""
    return F.coalesce(F.nullif(trim_function(clean_function(function), trim), F.lit("")), F.nullif(clean_library(library), F.lit("")), F.lit(UNKNOWN))


def idf(df: Column, n_docs: Column) -> Column:
    return F.when(df > 0, F.log(n_docs / df)).otherwise(0.0)


def share(df: Column, n_docs: Column) -> Column:
    return df / F.greatest(n_docs, F.lit(1))


def pad(ids: Column, length: int, fill: int = 0) -> Column:
    """The ids with `fill` at the end up to the length; longer ones stay."""
    return F.concat(ids, F.array_repeat(F.lit(fill).cast("bigint"), F.greatest(F.lit(length) - F.size(ids), F.lit(0))))


def first_of_equal(stacks: Column) -> Column:
    """Stacks without later equal ones."""
    return F.array_distinct(stacks)


def mask_unknown(frames: Column, report: Column, token: str = "??") -> Column:
    """The unknown token made the report's own; a frame that already looks so is an error."""
    own = F.concat(F.lit(token), report.cast("string"))
    checked = F.when(F.exists(frames, lambda x: x == own), F.raise_error(F.concat(F.lit("token in use: "), own))).otherwise(frames)
    return F.transform(checked, lambda x: F.when(x == token, own).otherwise(x))


def mean_weight(shares: Column) -> Column:
    """Mean of 1 - df over a stack's frames; null when it has none."""
    return F.when(F.size(shares) > 0, F.aggregate(shares, F.lit(0.0), lambda a, x: a + 1 - x) / F.size(shares))


def max_weight(shares: Column) -> Column:
    return F.greatest(F.coalesce(F.array_max(F.transform(shares, lambda x: 1 - x)), F.lit(-1.0)), F.lit(-1.0))


def strip(ids: Column, is_stop, edges: bool) -> Column:
    """Without stop symbols: at both ends only, or everywhere. is_stop maps a symbol to a boolean column."""
    if not edges:
        return F.filter(ids, lambda x: ~is_stop(x))
    keep = F.transform(ids, lambda x: ~is_stop(x))
    first, last = F.array_position(keep, True), F.size(ids) - F.array_position(F.reverse(keep), True) + 1
    return F.when(first > 0, F.slice(ids, first.cast("int"), (last - first + 1).cast("int"))).otherwise(F.slice(ids, 1, 0))


def strip_stacks(stacks: Column, is_stop, edges: bool) -> Column:
    """A report's stacks, stripped if stop symbols are given, without those left empty."""
    return F.filter(F.transform(stacks, lambda s: strip(s, is_stop, edges)) if is_stop else stacks, lambda s: F.size(s) > 0)


def earlier_and_other(q_ts: Column, c_ts: Column, q: Column, q_dup: Column, c: Column, c_dup: Column) -> Column:
    """A candidate strictly earlier and of another group, by the four comparisons of ids, where null equals null."""
    same = q.eqNullSafe(c) | q_dup.eqNullSafe(c) | q.eqNullSafe(c_dup) | q_dup.eqNullSafe(c_dup)
    return (c_ts < q_ts) & ~same


def unit_vector(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def pair_features(a: Column, b: Column, kind: int) -> Column:
    """Features of two vectors: distances, and by kind means, products or the vectors themselves."""
    apart, mean, product = F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.zip_with(a, b, lambda x, y: (x + y) / 2), F.zip_with(a, b, lambda x, y: x * y)
    kinds = {1: [apart], 2: [apart, mean], 3: [apart, mean, product], 4: [apart, a, b, product], 5: [apart, a, b, mean, product]}
    if kind not in kinds:
        raise ValueError(f"no such kind of features: {kind}")
    return F.concat(*kinds[kind])


def prefix_match(q: Column, c: Column) -> Column:
    """Length of the common prefix over the longer length; null for two empty stacks."""
    n = F.least(F.size(q), F.size(c))
    miss = F.array_position(F.zip_with(F.slice(q, F.lit(1), n), F.slice(c, F.lit(1), n), lambda x, y: x == y), False)
    common = F.when(miss > 0, miss - 1).otherwise(n)
    longer = F.greatest(F.size(q), F.size(c))
    return F.when(longer > 0, common / longer)


def overlap_merge(q: Column, c: Column) -> Column:
    """Matches of a two-pointer walk that moves past the smaller symbol, over the shorter length; order as given, 0 if one is empty."""
    state = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("e"))

    def step(s, _):
        x, y = F.get(q, s["i"]), F.get(c, s["j"])
        moved = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")  # noqa: E731  null past an end: no move
        return F.struct((s["i"] + moved(x <= y)).alias("i"), (s["j"] + moved(y <= x)).alias("j"), (s["e"] + moved(x == y)).alias("e"))

    n = F.least(F.size(q), F.size(c))
    walked = F.aggregate(F.sequence(F.lit(1), F.size(q) + F.size(c)), state, step)
    return F.when(n > 0, walked["e"] / n).otherwise(0.0)


def report_time(epoch: Column) -> Column:
    """Seconds since the epoch as a timestamp; the present where missing or zero."""
    return F.when(F.coalesce(epoch, F.lit(0)) != 0, F.timestamp_seconds(epoch)).otherwise(F.current_timestamp())


def thread_numbers(depths: Column) -> Column:
    """Which thread each frame is of, from 0: a new one starts wherever the depth decreases."""
    drops = F.transform(depths, lambda d, i: F.when((i > 0) & (d < F.get(depths, i - 1)), 1).otherwise(0))
    return F.transform(drops, lambda d, i: F.aggregate(F.slice(drops, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x))
