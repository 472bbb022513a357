"""Reading reports and writing results.

A report is an object of a JSON array: bug_id, creation_ts, optional dup_id, and stacktrace, an object or an array of objects, each with
frames and, to any depth, nested ones. Stack traces stay raw text up to one parse in Arrow batches, as their type is recursive.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.recursion import without_recursion
from ..functions.symbols import symbol

FRAME_KEYS = {"function", "depth", "args", "extra", "address", "dylib", "file", "fileline", "is_crash", "lib_tag", "code"}
STACK_KEYS = {"frames", "nested", "message", "exception"}
RAW = T.StructType([T.StructField("bug_id", T.LongType()), T.StructField("dup_id", T.LongType()), T.StructField("creation_ts", T.StringType()), T.StructField("stacktrace", T.StringType())])
LISTS = "array<struct<stack_idx: int, list_idx: int, frames: array<struct<function: string, dylib: string, depth: int>>>>"


def frame_lists(stack: dict) -> list[list[dict]]:
    """Own frames first, then those of nested stack traces, at any depth."""
    if set(stack) - STACK_KEYS:
        raise ValueError(f"unknown keys of a stack trace: {sorted(set(stack) - STACK_KEYS)}")
    out, todo = [], [stack]
    while todo:
        s = todo.pop(0)
        rows = []
        for f in s.get("frames") or []:
            if set(f) - FRAME_KEYS:
                raise ValueError(f"unknown keys of a frame: {sorted(set(f) - FRAME_KEYS)}")
            if f.get("function") is not None or f.get("dylib") is not None:
                rows.append({"function": f.get("function"), "dylib": f.get("dylib"), "depth": int(f["depth"]) if f.get("depth") is not None else -1})
        out.append(rows)
        todo = list(s.get("nested") or []) + todo
    return out


def parser(recursion: bool):
    @F.pandas_udf(LISTS)
    def parse(raw: pd.Series) -> pd.Series:
        def one(text):
            value = json.loads(text) if text else []
            found = []
            for i, stack in enumerate(value if isinstance(value, list) else [value]):
                lists = frame_lists(stack)
                if recursion:
                    kept = []
                    for frames in lists:
                        names = [f["function"] or f["dylib"] or "UNK" for f in frames]
                        first = {}
                        for n, f in zip(names, frames):
                            first.setdefault(n, f)
                        kept.append([first[n] for n in without_recursion(names)])
                    lists = kept
                found += [{"stack_idx": i, "list_idx": k, "frames": x} for k, x in enumerate(lists)]
            return found

        return raw.map(one)

    return parse


def read_reports(spark: SparkSession, path: str, remove_recursion: bool = True, trim: int = 0) -> tuple[DataFrame, DataFrame]:
    """(reports, frame_lists) of a JSON file of reports."""
    return reports_from(spark.read.schema(RAW).option("multiLine", True).json(path), remove_recursion, trim)


def from_rows(spark: SparkSession, rows, remove_recursion: bool = True, trim: int = 0) -> tuple[DataFrame, DataFrame]:
    """The same from dicts; None is skipped and unknown keys of a report are ignored."""
    made = [(int(r["bug_id"]), r.get("dup_id"), str(r["creation_ts"]), json.dumps(r.get("stacktrace"))) for r in rows if r is not None]
    return reports_from(spark.createDataFrame(made, RAW), remove_recursion, trim)


def reports_from(raw: DataFrame, remove_recursion: bool, trim: int) -> tuple[DataFrame, DataFrame]:
    """reports (bug_id, dup_id, creation_ts), and frame_lists (bug_id, stack_idx, list_idx, frames), the longest list of a stack first.

    Within a report a stack is kept once per distinct longest list, empty ones go, and a report without a stack goes.
    """
    lists = raw.select(F.col("bug_id").cast("long"), F.inline(parser(remove_recursion)(F.col("stacktrace"))))
    names = F.transform("frames", lambda f: symbol(f["function"], f["dylib"], trim))
    lists = lists.withColumn("frames", names).withColumn("order", F.struct(-F.size("frames"), F.col("list_idx")))
    stacks = lists.groupBy("bug_id", "stack_idx").agg(F.array_sort(F.collect_list(F.struct("order", "frames"))).alias("lists"))
    stacks = stacks.withColumn("primary", F.element_at("lists", 1)["frames"]).filter(F.size("primary") > 0)
    first = stacks.groupBy("bug_id", "primary").agg(F.min("stack_idx").alias("stack_idx"), F.min_by("lists", "stack_idx").alias("lists"))
    kept = first.select("bug_id", "stack_idx", F.posexplode("lists").alias("list_idx", "x")).select("bug_id", "stack_idx", "list_idx", F.col("x")["frames"].alias("frames"))
    reports = raw.select("bug_id", "dup_id", F.col("creation_ts").cast("long").alias("creation_ts"))
    return reports.join(first.select("bug_id").distinct(), "bug_id", "left_semi"), kept


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(bug_id, is_duplicate) of a file of three lines: a title, ids, ids of duplicates."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", "\n").alias("x"))
    ids = lambda i: F.filter(F.split(F.coalesce(F.get("x", F.lit(i)), F.lit("")), r"\s+"), lambda v: v != "")
    all_ = lines.select(F.explode(F.transform(ids(1), lambda v: v.cast("long"))).alias("bug_id"))
    dups = lines.select(F.explode(F.transform(ids(2), lambda v: v.cast("long"))).alias("dup")).distinct()
    return all_.join(dups, all_.bug_id == dups.dup, "left").select("bug_id", F.col("dup").isNotNull().alias("is_duplicate"))


def write_cache(df: DataFrame, path: str) -> None:
    """Keep a prepared table; read it back with read_cache."""
    df.write.mode("overwrite").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_metrics(metrics: DataFrame, path: str, step: int) -> None:
    """Append a step's metrics to a table of all steps."""
    metrics.withColumn("step", F.lit(step)).write.mode("append").parquet(path)


def json_lines(records: DataFrame, template: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Log lines: the fields that a %-template names, then the extra ones, as JSON."""
    import re

    names = [*re.findall(r"\((.+?)\)", template), *extra]
    return records.select(F.to_json(F.struct(*dict.fromkeys(names))).alias("value"))
