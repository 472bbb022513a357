"""Quality rules in DataFrame functions alone: base counts, and divergence from language references.

Base counts come from higher-order functions over each row's words and lines; windows of eight words are compared by a 64-bit hash
of their words' hashes, within their text. The method: a text's histograms of character classes and of common words are held against
references, the sums of the same histograms over all rows of each `lang`, by Jensen-Shannon distance (the root of the divergence,
base 2). Common words are the TOP most frequent of each `lang`, counted over all its rows.

Limits are each reference's own: over the rows of its `lang` that pass the base rule, by length class (the bits of the number of words,
as short texts spread more), the mean distance plus SPREADS standard deviations, and RATIO means at least, so that a clean table
isn't cut at its edge. A text fails if, for classes or for words, it is beyond the limits of all references that have one for its
length. Texts of fewer than MIN_WORDS words are not judged by it: their histograms say little.

Texts are read twice, for the common words and for a narrow feature table in the shared folder; all else is made of that table. What
reaches the driver is TOP words, one histogram and at most 64 limits per language.

Defined cases: a null or blank text has all counts 0 and fails for its length; rows without a lang are judged, but make no
reference; if no row has one, all rows together are the reference; a text alone in its length class is its own limit and stays; ties
between common words go to the first by code point; repeated rows are judged each; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANK, discard, materialize

WINDOW, MIN_WORDS, TOP, SPREADS, RATIO = 8, 50, 12, 3.0, 2.0

#: What ends a word without being part of it.
STOPS = ".,;:!?"
#: Character classes: upper case, digit, blank, stop marks, symbols, beyond ASCII; the rest is one more.
CLASSES = ["[^A-Z]+", "[^0-9]+", f"[^{BLANK}]+", r"[^.,;:!?'\"()-]+", r"[^#*$%&|<>/=+@\\\[\]{}^~_`]+", r"[\x00-\x7F]+"]


def counted(text: Column, others: str) -> Column:
    return F.length(F.regexp_replace(text, others, ""))


def covered(spots: Column) -> Column:
    """Words under windows that start at the ascending places."""
    step = F.transform(spots, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(spots, i + 1) - x, F.lit(WINDOW))))
    return F.aggregate(step, F.lit(0), lambda a, x: a + x)


def plain(word: Column) -> Column:
    return F.lower(F.rtrim(word, F.lit(STOPS)))


def reduced(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text, words."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("words", F.filter(F.split("text", f"[{BLANK}]+"), lambda w: w != ""))


def common_words(docs: DataFrame, top: int = TOP) -> list[str]:
    """The union of each lang's most frequent words over all its rows, in code point order."""
    words = reduced(docs).filter("lang is not null").select("lang", F.explode("words").alias("w")).select("lang", plain(F.col("w")).alias("w"))
    counts = words.filter("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("n"))
    placed = counts.withColumn("r_", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w")))
    return sorted({r["w"] for r in placed.filter(F.col("r_") <= top).select("w").collect()})


def features(docs: DataFrame, common: list[str]) -> DataFrame:
    """doc_id, lang, the base counts, and arrays classes and common: histograms."""
    rows = reduced(docs)
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{BLANK}]"))
    # no class has a-z, most of a text: without it the rest is gone through for each class
    rows = rows.withColumns({"rest": F.regexp_replace("text", "[a-z]+", ""), "n_words": F.size("words"), "hashes": F.transform("words", lambda w: F.xxhash64(w)), "lines": lines})
    window = lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)])
    codes = "".join(chr(0x21 + i) for i in range(len(common)))  # a character for each common word
    known = F.array(*map(F.lit, common)).cast("array<string>")
    hits = F.filter(F.transform("words", plain), lambda w: w.isin(common))
    made = {
        "windows": F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.col("n_words") - WINDOW), window)),
        "codes": F.array_join(F.transform(hits, lambda w: F.substring(F.lit(codes), F.array_position(known, w).cast("int"), F.lit(1))), ""),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_chars_": F.length("text"),
        "n_symbols": counted(F.col("rest"), "[^#*$%&|<>]+"),
        **{f"class{i}": counted(F.col("rest"), c) for i, c in enumerate(CLASSES)},
    }
    rows = rows.select("doc_id", "lang", "n_words", *[v.alias(k) for k, v in made.items()])
    # only texts with equal windows are sorted
    rows = rows.withColumn("sorted", F.when(F.size("windows") > F.size(F.array_distinct("windows")), F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, i: (F.get("sorted", i - 1)["h"] == x["h"]) | (F.get("sorted", i + 1)["h"] == x["h"])
    rows = rows.withColumn("spots", F.sort_array(F.transform(F.filter("sorted", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])))
    classes = [f"class{i}" for i in range(len(CLASSES))]
    bins = [F.length("codes") - F.length(F.translate("codes", c, "")) for c in codes]
    return rows.select(
        "doc_id", "lang", F.col("n_words").cast("long").alias("n_words"), (F.col("n_chars_") - F.col("class2")).cast("long").alias("word_chars"), F.col("n_symbols").cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"), F.coalesce(covered(F.col("spots")), F.lit(0)).cast("long").alias("n_repeat_words"), F.col("n_chars_").alias("n_chars"),
        F.array(*classes, F.col("n_chars_") - reduce(lambda a, b: a + b, map(F.col, classes))).alias("classes"), F.array(*bins, F.col("n_words") - F.length("codes")).alias("common"),
    )


def shares(counts: Column) -> Column:
    """The bins of a histogram that aren't empty, as (n, i): its count and its place."""
    return F.filter(F.transform(counts, lambda c, i: F.struct(c.cast("double").alias("n"), i.alias("i"))), lambda x: x["n"] > 0)


def divergence(some: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon divergence, base 2, between a histogram, by shares and total, and a distribution; 0 for an empty one.

    By entropies: what bins that are empty here add is known beforehand, so only the others are gone through.
    """
    log = lambda x: x * math.log2(x) if x > 0 else 0.0
    known = F.array(*[F.struct(F.lit(q / 2).alias("q"), F.lit(log(q / 2)).alias("h")) for q in map(float, reference)])
    part, at = (lambda x: x["n"] / total), (lambda x: F.get(known, x["i"]))
    mean = lambda x: part(x) / 2 + at(x)["q"]
    step = lambda a, x: a + part(x) * F.log2(part(x)) / 2 - mean(x) * F.log2(mean(x)) + at(x)["h"]
    empty = sum(map(log, reference)) / 2 - sum(log(q / 2) for q in reference)
    return F.when(total > 0, F.aggregate(some, F.lit(empty), step)).otherwise(0.0)


def distance(some: Column, total: Column, reference: list[float]) -> Column:
    """The root of the divergence, of nine digits: below, sums in another order differ."""
    return F.sqrt(F.greatest(F.round(divergence(some, total, reference), 9), F.lit(0.0)))


def references(rows: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Per lang the distributions of classes and common words over all its rows; one row per language reaches the driver."""
    shape = rows.select(F.size("classes"), F.size("common")).first()
    if shape is None:
        return {}
    n, m = shape
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"a{i}") for i in range(n)] + [F.sum(F.get("common", F.lit(i))).alias(f"b{i}") for i in range(m)]
    out = {}
    for r in sorted(rows.groupBy("lang").agg(*sums).filter("lang is not null").collect(), key=lambda r: r["lang"]):
        a, b = [float(r[f"a{i}"]) for i in range(n)], [float(r[f"b{i}"]) for i in range(m)]
        if sum(a) and sum(b):
            out[r["lang"]] = ([x / sum(a) for x in a], [x / sum(b) for x in b])
    return out


def beyond(rows: DataFrame, names: list[str], kind: str, judged: Column, spreads: float, ratio: float) -> Column:
    """By how much a text exceeds the limit of the reference that it exceeds least; null without a limit for its length."""
    if not names:
        return F.lit(None).cast("double")
    sums = []
    for i, lang in enumerate(names):
        v = F.when(judged & (F.col("lang") == lang), F.get(kind, F.lit(i)))
        sums += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}")]
    found = {r["bits"]: r for r in rows.groupBy("bits").agg(*sums).collect()}  # at most 64 rows
    parts = []
    for i in range(len(names)):
        has = {b: r for b, r in found.items() if r[f"m{i}"] is not None}
        most = {b: max(r[f"m{i}"] + spreads * r[f"s{i}"], ratio * r[f"m{i}"]) for b, r in has.items()}
        limits = F.array(*[F.lit(most.get(b)).cast("double") for b in range(65)])
        parts.append(F.round(F.get(kind, F.lit(i)) - F.get(limits, F.col("bits")), 9))
    return F.least(*parts, F.lit(None).cast("double"))


def judge(docs: DataFrame, min_words: int = MIN_WORDS, spreads: float = SPREADS, ratio: float = RATIO, top: int = TOP) -> DataFrame:
    if docs.filter("lang is not null").isEmpty():
        docs = docs.withColumn("lang", F.lit("all"))
    found = materialize(features(docs, common_words(docs, top)), "features")
    refs = references(found)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kinds = {"classes": F.col("n_chars"), "common": F.col("n_words")}
    apart = {f"{k}_from": F.array(*[distance(F.col(k), total, r[i]) for r in refs.values()]).cast("array<double>") for i, (k, total) in enumerate(kinds.items())}
    some = found.withColumns({**{k: shares(F.col(k)) for k in kinds}, "base_failed": base, "bits": F.length(F.bin("n_words"))})
    rows = materialize(some.withColumns(apart).drop(*kinds), "distances")
    discard(found)
    judged = (F.col("n_words") >= min_words) & ~F.col("base_failed")
    far = [F.coalesce(beyond(rows, list(refs), k, judged, spreads, ratio) > 0, F.lit(False)) for k in apart]
    nearest = [F.coalesce(F.array_min(k), F.lit(0.0)).alias(n) for k, n in zip(apart, ("class_distance", "word_distance"))]
    counts = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return rows.select(*counts, (~F.col("base_failed") & ~(judged & (far[0] | far[1]))).alias("kept"), *nearest)


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).withColumns({k: F.round(k, 6) for k in ("class_distance", "word_distance")})


def oracle() -> str:
    """The same for DuckDB: words, windows and histogram bins as rows."""
    word = f"[^{BLANK}]+"
    left = lambda others: "length(regexp_replace(text, '" + others.replace("'", "''") + "', '', 'g'))"
    classes = ", ".join(f"{left(c)} AS k{i}" for i, c in enumerate(CLASSES))
    kinds = [f"k{i}" for i in range(len(CLASSES))]
    bins = " UNION ALL ".join([f"SELECT id, 'a' AS kind, '{i}' AS bin, {k} AS c FROM f" for i, k in enumerate(kinds)] + [f"SELECT id, 'a', '{len(kinds)}', chars - {' - '.join(kinds)} FROM f"])
    base = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS id, doc_id, CASE WHEN EXISTS (SELECT 1 FROM documents WHERE lang IS NOT NULL) THEN lang ELSE 'all' END AS lang, coalesce(text, '') AS text FROM documents),
    f AS (SELECT id, doc_id, lang, regexp_extract_all(text, '{word}') AS words, length(text) AS chars, {left("[^#*$%&|<>]+")} AS n_symbols, {classes}, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM d),
    wn AS (SELECT id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w FROM (SELECT id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM f)),
    sp AS (SELECT id, i FROM (SELECT *, count(*) OVER (PARTITION BY id, w) AS n FROM wn) WHERE n > 1),
    rp AS (SELECT id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT *, lead(i) OVER (PARTITION BY id ORDER BY i) AS nxt FROM sp) GROUP BY id),
    cw AS (SELECT id, lang, lower(rtrim(w, '{STOPS}')) AS w, count(*) AS c FROM (SELECT id, lang, unnest(words) AS w FROM f) GROUP BY ALL),
    lw AS (SELECT lang, w, sum(c) AS c FROM cw WHERE lang IS NOT NULL AND w <> '' GROUP BY ALL),
    co AS (SELECT DISTINCT w FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, w) AS r FROM lw) WHERE r <= {TOP}),
    cb AS (SELECT id, CASE WHEN w IN (SELECT w FROM co) THEN w ELSE '' END AS bin, sum(c) AS c FROM cw GROUP BY ALL),
    h AS ({bins} UNION ALL SELECT f.id, 'b', b.bin, coalesce(cb.c, 0) FROM f CROSS JOIN (SELECT w AS bin FROM co UNION ALL SELECT '') b LEFT JOIN cb ON cb.id = f.id AND cb.bin = b.bin),
    hp AS (SELECT id, kind, bin, c / nullif(sum(c) OVER (PARTITION BY id, kind), 0) AS p FROM h),
    rs AS (SELECT lang, kind, bin, sum(c) AS c FROM h JOIN f USING (id) WHERE lang IS NOT NULL GROUP BY ALL),
    rf AS (SELECT lang, kind, bin, c / sum(c) OVER (PARTITION BY lang, kind) AS q FROM rs WHERE lang IN (SELECT lang FROM (SELECT lang, kind, sum(c) AS c FROM rs GROUP BY ALL) GROUP BY lang HAVING min(c) > 0)),
    jd AS (SELECT id, kind, rf.lang, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 AS v FROM hp JOIN rf USING (kind, bin) WHERE p IS NOT NULL GROUP BY ALL),
    js AS (SELECT id, kind, lang, sqrt(greatest(round(v, 9), 0)) AS v FROM jd),
    o AS (SELECT id, doc_id, lang, len(words) AS n_words, chars - k2 AS word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(rp.n, 0) AS BIGINT) AS n_repeat_words FROM f LEFT JOIN rp USING (id)),
    ob AS (SELECT *, {base} AS base_failed, length(bin(n_words)) AS bits FROM o),
    lm AS (SELECT kind, js.lang, bits, greatest(avg(v) + {SPREADS} * stddev_pop(v), {RATIO} * avg(v)) AS most FROM js JOIN ob ON js.id = ob.id AND js.lang = ob.lang WHERE n_words >= {MIN_WORDS} AND NOT base_failed GROUP BY ALL),
    far AS (SELECT id FROM js JOIN ob USING (id) JOIN lm ON lm.kind = js.kind AND lm.lang = js.lang AND lm.bits = ob.bits WHERE n_words >= {MIN_WORDS} GROUP BY id, js.kind HAVING min(round(v - most, 9)) > 0),
    dv AS (SELECT id, min(v) FILTER (kind = 'a') AS a, min(v) FILTER (kind = 'b') AS b FROM js GROUP BY id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND id NOT IN (SELECT id FROM far) AS kept,
      round(coalesce(a, 0.0), 6) AS class_distance, round(coalesce(b, 0.0), 6) AS word_distance FROM ob LEFT JOIN dv USING (id)"""
