"""URL filters: pattern rules indexed by their rarest literal token, evaluated in DataFrame operations alone.

Two layers. Host rules, each a host suffix and a path prefix, decide first: the longest that fits wins. Where none fits, pattern
rules decide: each has literal tokens that any url it matches must hold; it is filed under the token that the fewest urls hold,
counted over the corpus. A url's tokens fetch the rules filed under them, and only those run their regular expressions; a url with a
matching rule is blocked, every other one allowed. The rules are a bounded list, so the index is a literal map in the plan: no
join, no shuffle of rows.

Defined cases: a null url, or one without `://`, has empty host and path, no rule, and is allowed; upper-case hosts are lowered
(A-Z); paths keep their case; repeated rows are judged each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Host rules: host suffix, path prefix, verdict.
HOST_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@dataclass(frozen=True)
class PatternRule:
    tokens: tuple[str, ...]  # lower-case literals, each a whole token of any url that matches
    pattern: str  # over the lower-case url


#: Pattern rules: literal tokens and the expression.
PATTERN_RULES = [
    PatternRule(("spam", "farm"), r"://([^/?#]*\.)?spam-farm\."),
    PatternRule(("cheap", "pills"), r"://([^/?#]*\.)?cheap-pills\."),
    PatternRule(("casino",), r"://[^/?#]*\bcasino\b"),
    PatternRule(("viagra",), r"\bviagra\b"),
    PatternRule(("xxx",), r"://[^/?#]*\bxxx\b"),
    PatternRule(("porn",), r"://[^/?#]*\bporn\b"),
    PatternRule(("free", "download"), r"\bfree-download\b"),
    PatternRule(("doubleclick",), r"://([^/?#]*\.)?doubleclick\."),
    PatternRule(("adclick",), r"/adclick\b"),
    PatternRule(("malware",), r"://[^/?#]*\bmalware\b"),
]
TOKEN = r"[a-z0-9]+"


def lowered(col: Column) -> Column:
    """A-Z in lower case, nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.when(url.contains("://"), lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def token_counts(urls: DataFrame, rules: list[PatternRule]) -> dict[str, int]:
    """How many rows' urls hold each literal token of the rules; one aggregate row, whatever the input."""
    tokens = sorted({t for r in rules for t in r.tokens})
    if not tokens:
        return {}
    held = F.array_distinct(F.regexp_extract_all(lowered(F.col("url")), F.lit(TOKEN), F.lit(0)))
    hits = urls.select(F.filter(held, lambda t: t.isin(tokens)).alias("held"))
    got = hits.agg(*[F.count(F.when(F.array_contains("held", t), 1)).alias(f"n{i}") for i, t in enumerate(tokens)]).first()
    return {t: got[i] for i, t in enumerate(tokens)}


def index(rules: list[PatternRule], counts: dict[str, int]) -> dict[str, list[PatternRule]]:
    """Rules by their rarest literal token; ties by code point."""
    out: dict[str, list[PatternRule]] = {}
    for r in rules:
        out.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(r)
    return out


def judge(pages: DataFrame, host_rules=None, rules: list[PatternRule] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern): pattern is the first pattern rule that matched, null if none ran and matched."""
    host_rules, rules = HOST_RULES if host_rules is None else host_rules, PATTERN_RULES if rules is None else rules
    urls = pages.select("page_id", F.col("url").cast("string").alias("url"))
    filed = index(rules, token_counts(urls, rules))
    low = lowered(F.col("url"))
    rows = urls.withColumns({"host": F.coalesce(host_of(F.col("url")), F.lit("")), "path": F.coalesce(path_of(F.col("url")), F.lit(""))})
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(host_rules, key=lambda r: (len(r[0]) + len(r[1]), r[0] + r[1])):  # the longest is asked first
        name, verdict = F.when(fits(h, p), h + p).otherwise(name), F.when(fits(h, p), v).otherwise(verdict)
    rows = rows.withColumns({"rule": name, "own": verdict})
    pattern = F.lit(None).cast("string")
    if filed:
        by = F.create_map(*[x for t, rs in sorted(filed.items()) for x in (F.lit(t), F.array(*[F.lit(r.pattern) for r in rs]))])
        tokens = F.array_distinct(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0)))
        fetched = F.flatten(F.transform(F.filter(tokens, lambda t: t.isin(sorted(filed))), lambda t: F.element_at(by, t)))
        rows = rows.withColumn("fetched", F.when(F.col("own").isNull() & F.col("url").contains("://"), fetched))
        pattern = F.try_element_at(F.array_sort(F.filter("fetched", lambda p: F.call_function("rlike", lowered(F.col("url")), p))), F.lit(1))
    return rows.withColumn("pattern", pattern).select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("pattern").isNotNull(), "block").otherwise("allow")).alias("verdict"), "pattern")


def query(pages: DataFrame) -> DataFrame:
    return judge(pages)


def oracle() -> str:
    """The same for DuckDB, each rule's expression run on every url."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    order = sorted(HOST_RULES, key=lambda r: (-len(r[0]) - len(r[1]), r[0] + r[1]))
    name = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for h, p, _ in order) + " END"
    own = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in order) + " END"
    rules = ", ".join(f"('{r.pattern}')" for r in PATTERN_RULES)
    return f"""
    WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN position('://' IN url) + 3 END AS begin_at FROM pages),
    s AS (SELECT page_id, url, CASE WHEN begin_at IS NULL THEN '' ELSE regexp_extract(substr(url, begin_at), '^[^/?#]*') END AS h0, begin_at FROM u),
    p AS (SELECT page_id, url, begin_at, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      CASE WHEN begin_at IS NULL THEN '' ELSE regexp_extract(substr(url, begin_at + length(h0)), '^[^?#]*') END AS path FROM s),
    j AS (SELECT page_id, host, path, begin_at, {name} AS rule, {own} AS own, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM p),
    m AS (SELECT j.*, (SELECT min(r.p) FROM (VALUES {rules}) r(p) WHERE j.own IS NULL AND begin_at IS NOT NULL AND regexp_matches(j.low, r.p)) AS pattern FROM j)
    SELECT page_id, host, path, rule, coalesce(own, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, pattern FROM m"""
