"""The training-data operators against brute force, round trips and held-out accuracy, on small tables and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tracelode.llm import common, hpylm, langid, mixing, neighbours, packing, quality, queries, sharding, simhash, toxicity, urls

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \t\n", "word", "a b c", "x" * 5000, "the same line\nthe same line\nthe same line\n" * 40, "Émile! 123 ### $%&", "a\x1cb\u2003c \u00a0 d", "日本語 テキスト", "same text", "same text", "w " * 3000]


def crc(x):
    return zlib.crc32(str(x).encode())


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else f"s{i % 2}", 1, "x", "y") for i, t in enumerate(ODD)] + [(None, "no id", "en", "s1", 1, "x", "y"), (3, "word", "en", "s0", 1, "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, fp string")


def words(t):
    return WORD.findall(t or "")


def result(spark, name):
    return queries.QUERIES[name](spark, SF_DIR).toPandas()


def joined(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = joined(pairs, {x for p in pairs for x in p})
    assert got == {k: v for k, v in want.items() if k in got} and all(want[k] == k for k in want.keys() - got.keys())
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_starts(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else f"g{i % 2}", i % 5) for i in range(500)], "i long, g string, n long").repartition(7)
    got = common.with_starts(rows, "g", "n", "t").toPandas()
    for _, g in got.groupby(got.g.fillna("-")):
        spans = sorted((s, s + n) for s, n in zip(g.start, g.n) if n)
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


# --- toxicity


def segments_slow(scores):
    """Maximal segments by their recursive definition: the best segment, shortest of equals, then both sides of it."""
    if not scores:
        return []
    cum = [0.0]
    for s in scores:
        cum.append(cum[-1] + s)
    best = max(((cum[b] - cum[a], a - b, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=None)
    if best[0] <= 1e-12:
        return []
    _, _, a, b = best
    left, right = segments_slow(scores[:a]), segments_slow(scores[b:])
    return left + [(best[0], a, b - 1)] + [(s, x + b, y + b) for s, x, y in right]


def test_segments():
    rng = np.random.default_rng(2)
    for _ in range(200):
        raw = [float(rng.choice([-0.25, -0.25, -0.25, rng.uniform(0.1, 2)])) for _ in range(30)]
        at = [i for i, s in enumerate(raw) if s > 0]
        got = toxicity.maximal_segments(at, [raw[i] for i in at], 0.25)
        assert [(round(s, 6), a, b) for s, a, b in got] == [(round(s, 6), a, b) for s, a, b in segments_slow(raw)]


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    r = queries.QUERIES["op1_toxicity"](spark, d).toPandas().merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    assert (r.held_out == [crc(i) % 5 == 0 for i in r.doc_id]).all() and r.score.between(0, 1).all() and ((r.score >= 0.5) == (r.predicted == 1)).all()
    held = r[r.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95


def test_toxicity_odd(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(i, 1, i % 2) for i in range(12)] + [(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        got = toxicity.query(odd, labels).toPandas()
        assert len(got) == odd.count() and got.score.between(0, 1).all() and got.score.notna().all()
    assert toxicity.query(odd.limit(0), some).count() == 0
    assert toxicity.filter_toxic(odd, none).columns == odd.columns


# --- language


def test_language(spark, docs):
    r = result(spark, "op2_language_id").merge(docs, on="doc_id")
    held = r[r.held_out]
    assert (r.held_out == [crc(i) % 4 == 2 for i in r.doc_id]).all() and (held.lang_pred == held.lang).mean() > 0.98


def test_language_odd(spark, odd):
    got = {r["doc_id"]: r for r in langid.query(odd).collect()}
    assert len(got) == len(ODD) + 1 and all(got[i]["lang_pred"] == "und" for i in (0, 1, 2))
    assert {r["lang_pred"] for r in langid.query(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.query(odd.limit(0)).count() == 0


def test_language_edges(spark):
    """Numbers are no letters; a language whose n-grams all come once is learned."""
    rows = [(i, t, k) for i, (t, k) in enumerate([("½ ² ②", "en"), ("abc", "xx"), ("the the the", "en"), ("the cat the cat", "en"), ("abc", None), ("Ⅻ 5", None)])]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.query(spark.createDataFrame([(10 + i, t, k) for i, t, k in rows], "doc_id long, text string, lang string")).collect()}
    assert got[10] == "und" and got[14] in ("xx", "en")
    assert langid.decide("abc", langid.build({"en": {int(g): 2 for g in langid.grams("the")}, "xx": {int(g): 1 for g in langid.grams("abc")}}))[0] == "xx"


def test_filters_give_languages():
    f = langid.build({"a": {1: 5, 2: 5, 3: 1}, "b": {2: 5, 3: 9, 4: 5}})
    masks = f.slices[0]
    of = lambda g: int(np.bitwise_and.reduce([masks[langid.slots(np.array([g], np.uint64), i)][0] for i in range(langid.HASHES)]))
    assert [of(g) for g in (1, 2, 3, 4)] == [1, 3, 2, 2]
    many = langid.build({f"l{i:03}": {i: 1} for i in range(70)})
    assert len(many.slices) == 2


# --- urls


def test_urls_odd(spark):
    given = {1: None, 2: "no scheme", 3: "HTTP://WWW.Example.COM/en/x?q", 4: "http://example.com/en/", 5: "http://a.example.com/EN/", 6: "x://notexample.com/en/", 7: "http://n.net/es/1#f", 8: "http://cheap-pills.example.org/a", 9: "http://xcheap-pills.org/", 10: "http://h", 11: "http://a.b/://c.net/es/"}
    pages = spark.createDataFrame([(k, v, "e") for k, v in given.items()], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    assert got == {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("www.example.com", "/en/x", "www.example.com/en/", "allow"), 4: ("example.com", "/en/", "example.com/en/", "block"), 5: ("a.example.com", "/EN/", "com/", "allow"),
        6: ("notexample.com", "/en/", "com/", "allow"), 7: ("n.net", "/es/1", "net/es/", "block"), 8: ("cheap-pills.example.org", "/a", None, "block"), 9: ("xcheap-pills.org", "/", None, "allow"), 10: ("h", "", None, "allow"), 11: ("a.b", "/://c.net/es/", None, "allow"),
    }
    assert urls.judge(pages.limit(0)).count() == 0


def test_urls_index():
    rules = [urls.PatternRule(("a", "b"), "a.*b"), urls.PatternRule(("b",), "b")]
    assert urls.index(rules, {"a": 1, "b": 9}) == {"a": [rules[0]], "b": [rules[1]]}


def test_urls_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF_DIR}/pages.parquet'")
    want, got = con.sql(queries.ORACLE_SQL["op3_url_filters"]).df(), result(spark, "op3_url_filters")
    key = lambda x: sorted(map(str, x[sorted(x.columns)].astype(object).where(x[sorted(x.columns)].notna(), None).values.tolist()))
    assert key(got) == key(want)


# --- simhash


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    n = max(1, len(w) - 3)
    counts = [0] * 64
    for i in range(n):
        h = xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > n)


def test_simhash(spark, docs):
    got = result(spark, "op4_simhash").set_index("doc_id")
    fp = {i: fingerprint(t) for i, t in zip(docs.doc_id, docs.text)}
    assert {i: int(x, 16) for i, x in got.fingerprint.items()} == fp
    pairs = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    assert got.component_id.to_dict() == joined(pairs, fp)


@pytest.mark.parametrize("keep", [1, 2, 3, 5])
def test_grid_loses_no_link(spark, keep):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 62, 60)]
    fps = set(base) | {b ^ sum(1 << int(i) for i in rng.choice(64, int(rng.integers(1, 6)), False)) for b in base for _ in range(4)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(i, simhash.signed(f)) for i, f in enumerate(fps)], "rep long, fp long")
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (fps[a] ^ fps[b]).bit_count() <= 4}
    assert {(r["a"], r["b"]) for r in simhash.links(frame, 4, keep).collect()} == want


def test_simhash_odd(spark, odd):
    got = simhash.query(odd).toPandas()
    by = got.dropna(subset=["doc_id"]).set_index("doc_id")
    assert all(int(x, 16) == fingerprint(ODD[int(i)]) for i, x in by.fingerprint.items())
    assert len(got) == odd.count() and (by.component_id.loc[[0, 1, 2]] == 0).all() and (by.component_id.loc[[10, 11]] == 10).all()
    assert simhash.query(odd.limit(0)).count() == 0


# --- vectors


def test_vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((150, 16))
    rows, vecs = [], []
    for i, b in enumerate(base):
        for _ in range(1 + i % 4 + 90 * (i == 3)):
            v = (b + rng.standard_normal(16) * 0.12).astype(np.float32)
            vecs.append((v, i % 3))
    vecs += [(vecs[0][0], vecs[0][1])] * 5  # equal vectors
    rows = [(i, [float(x) for x in v], int(k)) for i, (v, k) in enumerate(vecs)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, rows[0][1], None), (n + 4, [None] + [1.0] * 15, 1), (n + 5, [1.0, 2.0], 1), (n + 6, [], 1)]
    got = neighbours.query(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).toPandas().set_index("vec_id")
    m = np.array([v for v, _ in vecs], float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    k = np.array([k for _, k in vecs])
    hit = (m @ m.T >= 0.98) & (k[:, None] == k)
    np.fill_diagonal(hit, False)
    want = joined(list(zip(*map(lambda x: x.tolist(), np.nonzero(np.triu(hit))))), range(n))
    assert len(got) == len(rows) and hit.sum() > 5000
    assert got.n_links.loc[list(range(n))].sum() >= 0.97 * hit.sum() and (got.n_links.loc[list(range(n))].values <= hit.sum(1)).all()
    assert np.mean([got.component_id[i] == want[i] for i in range(n)]) > 0.97
    assert (got.n_links.loc[list(range(n, n + 7))] == 0).all() and got.kept.loc[list(range(n, n + 7))].all()
    assert neighbours.query(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# --- shards


def test_shards(spark, docs):
    got = result(spark, "op6_sharding")
    counts = got.shard.value_counts().reindex(range(16), fill_value=0)
    assert counts.max() - counts.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    own = got.merge(docs, on="doc_id")
    assert (own["size"] == [len(t.encode()) + 1 for t in own.text]).all() and (own.text_crc32 == [zlib.crc32(t.encode()) for t in own.text]).all()
    spread = own.groupby("text").shard.nunique()
    assert (spread == 1).mean() > 0.95


def test_shards_of_a_large_group(spark, odd):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    got = sharding.shard_documents(rows).toPandas()
    assert got.shard.value_counts().tolist() == [25] * 16
    hot = got[got.doc_id % 3 == 0].shard.value_counts()
    assert len(hot) <= 9  # 134 rows need 6 shards
    out = sharding.query(odd).toPandas()
    assert len(out) == odd.count() and out.text_crc32.isna().sum() == 1 and sharding.query(odd.limit(0)).count() == 0


# --- mixing


def targets(sizes):
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    capped, total = set(), sum(sizes.values())
    while True:
        rest = sum(w[s] for s in sizes if s not in capped)
        t = {s: 3.0 * sizes[s] if s in capped else (total - sum(3 * sizes[x] for x in capped)) * w[s] / rest for s in sizes}
        over = {s for s in t if s not in capped and t[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return t
        capped |= over


def test_mixing(spark, docs):
    got = result(spark, "op7_mixing").merge(docs, on="doc_id")
    assert (got["size"] == [len(words(t)) for t in got.text]).all() and (got.taken <= 3 * got["size"]).all()
    g = got.groupby("source").agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    want = targets(g["size"].to_dict())
    assert (g["size"] == g.own).all() and np.allclose(g.target, [want[s] for s in g.index]) and (abs(g.taken - g.target) <= 5 * (g.target * mixing.BLOCK) ** 0.5 + 3 * mixing.BLOCK).all()
    assert result(spark, "op7_mixing").sort_values("doc_id").taken.tolist() == got.sort_values("doc_id").taken.tolist()


def mixed_slowly(docs):
    """Words taken of each document, slot by slot from the shards' draws."""
    rows = {}
    for i, t, s in zip(docs.doc_id, docs.text, docs.source):
        rows.setdefault(s, []).append((docs.key_[i], i, len(words(t))))
    sizes = {s: sum(n for _, _, n in r) for s, r in rows.items()}
    want, names = targets(sizes), sorted(sizes, key=lambda s: s.encode())
    blocks = {s: -(-sizes[s] // mixing.BLOCK) for s in names}
    expected = [want[s] * blocks[s] / sizes[s] for s in names]
    total, at, used = round(sum(expected)), dict.fromkeys(names, 0), Counter()
    for shard in range(-(-total // mixing.SHARD_SLOTS)):
        for s, n in zip(names, mixing.shard_counts(shard, total, [e / sum(expected) for e in expected], 0)):
            for k in range(at[s], min(at[s] + int(n), 3 * blocks[s])):
                key = xxhash.xxh3_64_intdigest(b"\1" + s.encode(), 0) + 7919 * (k // blocks[s])
                used[s, int(mixing.permuted([k % blocks[s]], blocks[s], key)[0])] += 1
            at[s] += int(n)
    taken = Counter()
    for s, r in rows.items():
        place = 0
        for _, i, n in sorted(r):
            for x in range(place, place + n):
                taken[i] += used[s, x // mixing.BLOCK]
            place += n
    return taken


def test_mixing_by_slots(spark, docs):
    """Against the draws one slot at a time; and the same whatever way the rows lie."""
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    keys = {r["doc_id"]: r["key_"] % 2**64 for r in frame.select("doc_id", mixing.row_key(F.col("text"))).collect()}
    want = mixed_slowly(docs.assign(key_=pd.Series(keys)[docs.doc_id].values).set_index("doc_id", drop=False))
    for rows in (frame, frame.repartition(5), frame.orderBy(F.desc("text")).coalesce(2)):
        got = {r["doc_id"]: r["taken"] for r in mixing.query(rows).collect()}
        assert got == {i: want[i] for i in got}


def test_mixing_odd(spark, odd):
    got = mixing.query(odd).toPandas()
    assert len(got) == odd.count() and sorted(got["size"]) == sorted(len(words(t)) for t in [*ODD, "no id", "word"])
    rows = odd.select("source", "text").toPandas()
    sizes = {}
    for s, t in zip(rows.source, rows.text):
        s = None if pd.isna(s) else s
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = targets(sizes)
    assert sorted(set(got.target.round(6))) == sorted({round(v, 6) for v in want.values()})
    assert mixing.query(odd.limit(0)).count() == 0


def test_permutation():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 12345).tolist()) == list(range(n))


def test_mixed_documents_and_manifest(spark, docs):
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    taken = result(spark, "op7_mixing").set_index("doc_id").taken
    out = mixing.mix_documents(frame)
    assert out.columns == frame.columns
    by = Counter()
    text = dict(zip(docs.doc_id, docs.text))
    for r in out.collect():
        by[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"]) and set(words(r["text"])) <= set(words(text[r["doc_id"]]))
    assert {k: v for k, v in taken.items() if v} == dict(by)
    m = mixing.manifest(frame).toPandas()
    assert m.groupby("doc_id").length.sum().to_dict() == dict(by)


# --- quality


def base_counts(t):
    w = words(t)
    c, seen, dup, cover = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set(), 0, set()
    for k in range(len(w) - 7):
        if c[tuple(w[k : k + 8])] > 1:
            cover.update(range(k, k + 8))
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), dup, len(cover)


def test_quality(spark, docs, odd):
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = result(spark, "op8_quality_rules").set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        r = got.loc[i]
        assert tuple(r[cols]) == base_counts(t) and r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.base_failed and r.kept)
    other = quality.query(odd).toPandas()
    assert len(other) == odd.count()
    for r in other.dropna(subset=["doc_id"]).itertuples():
        assert tuple(getattr(r, c) for c in cols) == base_counts(ODD[int(r.doc_id)])
    assert quality.query(odd.limit(0)).count() == 0 and quality.query(odd.withColumn("lang", F.lit(None).cast("string"))).count() == odd.count()


def test_quality_method(spark, docs):
    """Both halves decide rows, clean rows stay, and the common words are the counted ones."""
    frame = spark.createDataFrame(docs[["doc_id", "text", "lang"]], "doc_id long, text string, lang string")
    most = {}
    for lang, text in zip(docs.lang, docs.text):
        most.setdefault(lang, Counter()).update(w for w in (x.rstrip(quality.STOPS).lower() for x in words(text)) if w)
    want = {w for c in most.values() for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: quality.TOP]}
    assert quality.common_words(frame) == sorted(want)
    clean = [" ".join(random.Random(i).choices(["the", "of", "and", "Rain", "falls", "hills,", "slow", "river."], k=120)) for i in range(200)]
    marks = [" ".join(w + "###" for w in clean[0].split()), " ".join(random.Random(1).choices([f"word{i}" for i in range(500)], k=120))]
    rows = [(i, t, "en") for i, t in enumerate(clean + marks)]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [i for i, k in sorted(got.items()) if not k] == [200, 201]


def test_quality_sql(spark, odd):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF_DIR}/documents.parquet'")
    same = lambda got, want: sorted(got.astype(str).values.tolist()) == sorted(want[list(got.columns)].astype(str).values.tolist())
    assert same(result(spark, "op8_quality_rules"), con.sql(queries.ORACLE_SQL["op8_quality_rules"]).df())
    con.sql("DROP VIEW documents")
    frame = odd.select("doc_id", "text", F.lit("en").alias("lang")).filter("doc_id is not null").toPandas()
    con.register("documents", frame)
    want = con.sql(queries.ORACLE_SQL["op8_quality_rules"]).df()
    assert same(quality.query(spark.createDataFrame(frame, "doc_id long, text string, lang string")).toPandas(), want)


def test_divergence(spark):
    p, q = [3, 1, 0, 6], [0.25, 0.25, 0.5, 0.0]
    a = np.array(p) / sum(p)
    m = (a + np.array(q)) / 2
    want = sum(x * math.log2(x / z) for x, z in zip(a, m) if x) / 2 + sum(x * math.log2(x / z) for x, z in zip(q, m) if x) / 2
    got = spark.range(1).select(quality.divergence(quality.shares(F.array(*map(F.lit, p))), F.lit(sum(p)), q).alias("d")).first()["d"]
    assert got == pytest.approx(want)


# --- packing


def check_packed(got, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in texts.items()}
    assert set(got.doc_id) == set(ids)
    for i, g in got.groupby("doc_id"):
        at = 0
        for r in g.sort_values("start").itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[i])
            at += r.length
        assert at == len(ids[i])
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.max() + 1 == math.ceil(sum(map(len, ids.values())) / 2048)


def test_packing(spark, docs, odd):
    check_packed(result(spark, "op9_packing"), dict(zip(docs.doc_id, docs.text)))
    once = odd.filter("doc_id is not null").dropDuplicates(["doc_id"]).repartition(5)
    check_packed(packing.query(once).toPandas(), dict(enumerate(ODD)))
    assert packing.query(odd.limit(0)).count() == 0 and packing.query(odd).filter("doc_id = 3").count() == 2
    row = packing.pieces(once, with_ids=True).filter("doc_id = 3").first()
    assert row["ids"][-1] == 1 and len(row["ids"]) == row["length"]


def test_packing_special(spark):
    texts = dict(enumerate(["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "a<|endoftext|> <|endoftext", "<|EndOfText|> \u00e9<|endoftext|>\n\nb"]))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_packed(packing.query(rows).toPandas(), texts)
    assert packing.encoder()(texts[0]) == [64, 220, 50256, 275]


# --- language model


def test_lm(spark, docs, odd):
    got = result(spark, "op10_hpylm").set_index("doc_id")
    tokens = {i: [*t.encode().lower().split(), b""] for i, t in zip(docs.doc_id, docs.text)}
    c = Counter(w for i, ws in tokens.items() if crc(i) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = got.loc[i]
        assert r.held_out == (crc(i) % 7 == 2) and (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()
    small = hpylm.score(spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(3), chunk_bytes=200_000, cells=40_000).toPandas().set_index("doc_id")
    same = got.loc[small.index]
    assert np.allclose(small.score, same.score, rtol=1e-12) and np.allclose(small.base_score, same.base_score) and (small.n_known == same.n_known).all()
    other = hpylm.query(odd).toPandas()
    assert len(other) == odd.count() and np.isfinite(other.score).all() and hpylm.query(odd.limit(0)).count() == 0


def test_lm_brute_force(spark):
    """Where no pair comes twice, each cell has one table and, without a discount at the parent, nothing is left to chance."""
    train = [i for i in range(40) if crc(i) % 7 != 2]
    held = [i for i in range(40) if crc(i) % 7 == 2]
    texts = {train[0]: "A b C d", train[1]: "b a c a d b", train[2]: "e f", **dict(zip(held, ["a b", "b c zzz a", "zzz", "c e f", "a d a"]))}
    d, s = 0.5, hpylm.STRENGTH
    pairs = Counter()
    for i in train[:3]:
        ws = [*texts[i].lower().split(), ""]
        pairs.update(zip(["", *ws], ws))
    assert set(pairs.values()) == {1}
    context, below = Counter(u for u, _ in pairs), Counter(w for _, w in pairs)

    def p(u, w):
        up = (below[w] + s / (len(below) + 1)) / (s + len(pairs))
        return (pairs[u, w] * (1 - d) + (s + d * context[u]) * up) / (s + context[u])

    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in hpylm.score(rows, chunk_bytes=8, cells=5, discounts=(d, 0.0)).collect()}
    for i, t in texts.items():
        ws = [*t.lower().split(), ""]
        assert got[i] == pytest.approx(sum(math.log10(p(u, w)) for u, w in zip(["", *ws], ws)), rel=1e-9)
    vocabulary = [*below, "zzz"]
    assert all(sum(p(u, w) for w in vocabulary) == pytest.approx(1) for u in vocabulary)


def slow_log_probabilities(texts, train, d, d0):
    """The model over plain dicts: the same chains, one cell at a time, for all texts."""
    s, number = hpylm.STRENGTH, {}
    pairs = Counter()
    for i in train:
        ws = [*texts[i].lower().split(), ""]
        pairs.update(zip(["", *ws], ws))
    words = {w: 0 if not w else int(hpylm.word_keys(np.frombuffer(w.encode(), np.uint8))[0][0]) for w in {w for p in pairs for w in p}}
    number = {w: k for k, w in enumerate(sorted(words, key=words.get))}
    dishes, context = len(number) + 1, Counter()
    for (u, _), n in pairs.items():
        context[u] += n
    one = lambda u, w, c, seed: hpylm.keyed(np.array([u]), np.array([w]), c, seed)

    def chain(c):
        t, own_total = dict.fromkeys(pairs, 1), float(len(number))

        def parent(seed):
            below = Counter()
            for (_, w), k in t.items():
                below[w] += k
            own = {w: int(hpylm.seat([k], [(s + d0 * own_total) / dishes], d0, one(number[w], number[w], c, seed))[0]) for w, k in below.items()}
            return below, own, sum(own.values())

        def up(w, less=0):
            left = below.get(w, 0) - less
            return (left - d0 * min(own.get(w, 0), left) + (s + d0 * own_total) / dishes) / (s + sum(below.values()) - less)

        for turn in range(hpylm.ROUNDS):
            below, own, own_total = parent(2 * turn)
            tables = Counter()
            for (u, _), k in t.items():
                tables[u] += k
            weight = {u: hpylm.openings(np.array([float(k)]), d, np.array([number[u]]), c, 2 * turn + 1)[0] for u, k in tables.items()}
            t = {(u, w): int(hpylm.seat([n], [weight[u] * up(w, t[u, w])], d, one(number[u], number[w], c, 2 * turn + 1))[0]) for (u, w), n in pairs.items()}
        below, own, own_total = parent(2 * hpylm.ROUNDS)
        tables = Counter()
        for (u, _), k in t.items():
            tables[u] += k
        return lambda u, w: (pairs.get((u, w), 0) - d * t.get((u, w), 0) + (s + d * tables[u]) * up(w)) / (s + context[u])

    chains = [chain(c) for c in range(hpylm.CHAINS)]
    p = lambda u, w: sum(f(u, w) for f in chains) / len(chains)
    assert all(sum(p(u, w) for w in [*number, None]) == pytest.approx(1) for u in number)
    return {i: sum(math.log10(p(u, w)) for u, w in zip(["", *x.lower().split()], [*x.lower().split(), ""])) for i, x in texts.items()}


def test_lm_repeated_pairs(spark):
    """Against one cell at a time in plain Python, where pairs come many times and some words hold a third of all."""
    rng = np.random.default_rng(4)
    names = ["the", "of", *[f"w{i}" for i in range(30)]]
    texts = {i: " ".join(names[min(int(k), 31)] for k in rng.zipf(1.6, 40) - 1) for i in range(30)}
    train = [i for i in texts if crc(i) % 7 != 2]
    texts[1000] = "the zzz of unknown w1"
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in hpylm.score(rows, chunk_bytes=3000, cells=300, discounts=(0.6, 0.4)).collect()}
    train += [1000] * (crc(1000) % 7 != 2)
    want = slow_log_probabilities(texts, train, 0.6, 0.4)
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in texts)


def test_lm_numbers_and_messages():
    sizes = [int(x) for x in np.random.default_rng(0).integers(0, 9, 3 * hpylm.SPLIT)]
    numbers = hpylm.Numbers(sizes, 3)
    low, total = numbers.low, sum(sizes)
    for u in range(0, total, 7):
        for w in range(0, total, 5):
            a, b = (int(np.searchsorted(low, x, "right") - 1) for x in (u, w))
            key = (u - low[a]) * (low[b + 1] - low[b]) + w - low[b]
            assert numbers.pair(np.array([key]), a * 3 + b) == (np.array([u]), np.array([w])) and sizes[int(numbers.ranges(u))] > 0
    x = np.array([-1, 0, 7, 1 << 40])
    assert (hpylm.grow(hpylm.shrink(x)) == x).all() and (hpylm.grow_sorted(hpylm.shrink_sorted(x)) == x).all() and len(hpylm.grow(hpylm.shrink(x[:0]))) == 0


def test_lm_word_keys():
    raw = b"  A b\tC  d\xc3\x89\na B c\x1cd " + b"x" * 3_000_000 + b" end"
    keys, starts = hpylm.word_keys(np.frombuffer(raw, np.uint8))
    ws = raw.lower().split()
    assert len(keys) == len(ws) and len(set(keys.tolist())) == len(set(ws)) and [raw[s : s + 1].lower() for s in starts] == [w[:1] for w in ws]
    assert keys[0] == keys[4] and keys[1] == keys[5] and (keys > 0).all() and len(hpylm.word_keys(np.frombuffer(b" \n", np.uint8))[0]) == 0


def expected_tables(n, new, d):
    """Over all ways to seat n customers: the mean number of tables."""

    def ways(sizes, left):
        if not left:
            return [(1.0, len(sizes))]
        out = [(new * p, t) for p, t in ways([*sizes, 1], left - 1)]
        for i, k in enumerate(sizes):
            out += [((k - d) * p, t) for p, t in ways([*sizes[:i], k + 1, *sizes[i + 1 :]], left - 1)]
        return out

    all_ = ways([1], n - 1)
    return sum(p * t for p, t in all_) / sum(p for p, _ in all_)


def exact_tables(n, new, d, most=None):
    """The same mean from generalised Stirling numbers, for larger n; `most` bounds the tables looked at."""
    k = min(n, most or n)
    log = np.full(k + 1, -np.inf)
    log[1], t = 0.0, np.arange(k + 1)
    for m in range(1, n):
        with np.errstate(divide="ignore"):
            log = np.logaddexp(log + np.log(np.maximum(m - t * d, 0)), np.concatenate([[-np.inf], log[:-1]]))
    law = log[1:] + t[:-1] * np.log(new)
    return (np.exp(law - np.logaddexp.reduce(law)) * t[1:]).sum()


@pytest.mark.parametrize("n, new, most", [(2, 0.3, None), (6, 3, None), (10, 0.5, None), (63, 3, None), (64, 3, None), (64, 20, None), (65, 20, None), (1000, 0.01, 100), (1000, 20, None), (2048, 8, 150), (2049, 8, 150), (100_000, 3, 120)])
def test_lm_seating(n, new, most):
    cells = 4000 if n <= hpylm.ROWS else 300  # an integral for each draw beyond
    for d in (0.4, 0.7):
        want = exact_tables(n, new, d, most)
        t = hpylm.seat(np.full(cells, n), np.full(cells, float(new)), d, hpylm.mixed(np.arange(cells, dtype=np.uint64)))
        assert t.mean() == pytest.approx(want, abs=max(0.02 * want, 4 * t.std() / cells**0.5))
        if n <= 6:
            assert want == pytest.approx(expected_tables(n, new, d))


def test_release_waits_for_listeners(spark):
    """Listeners that lag hold ended plans: without them, the JVM's collection leaves the files of the last shuffle."""
    from unittest.mock import MagicMock

    from tracelode.llm.common import release

    fake = MagicMock()
    release(fake)
    calls = [x[0].split(".")[-1] for x in fake.mock_calls]
    assert "waitUntilEmpty" in calls and calls.index("waitUntilEmpty") < calls.index("gc")
    release(spark)


def test_lm_chains_share_the_integral(monkeypatch):
    """Cells of equal size take S(n, t) once, small ones no more terms than count, and no draw moves with the cells beside it."""
    n, a, key = np.array([5000, 5000, 5000, 9, 700, 2048]), np.array([0.02, 0.021, 40.0, 0.3, 1e-5, 2.0]), hpylm.mixed(np.arange(6, dtype=np.uint64))
    alone = [int(hpylm.seat(n[i : i + 1], a[i : i + 1], 0.7, key[i : i + 1])[0]) for i in range(6)]
    calls, of = [], hpylm.stirling_far
    monkeypatch.setattr(hpylm, "stirling_far", lambda *x: calls.append(x) or of(*x))
    assert hpylm.seat(n, a, 0.7, key).tolist() == alone and len(calls) == 1
    for i, size in ((3, 9), (4, 700), (5, 2048)):  # the whole law
        law = hpylm.stirling(0.7)[size * (size - 1) // 2 : size * (size + 1) // 2] + np.log(a[i]) * np.arange(size)
        upto = np.exp(law - law.max()).cumsum()
        assert alone[i] == 1 + (upto < hpylm.uniform(key[i], np.uint64(1)) * upto[-1]).sum()


@pytest.mark.parametrize("d", [0.05, 0.4, 0.8, 0.95])
def test_lm_stirling_far(d):
    """The integral against the recursion, over the whole line."""
    n, known = hpylm.ROWS, hpylm.stirling(d)[-hpylm.ROWS :]
    t = np.unique(np.concatenate([np.geomspace(1, n, 200).astype(int), np.arange(n - 20, n + 1)]))
    gap = hpylm.stirling_far(float(n), t.astype(float), d) - known[t - 1]
    assert np.abs(gap - gap[0]).max() < 1e-3


def test_lm_seating_odd():
    t = hpylm.seat(np.array([0, 1, 10**9]), np.full(3, 0.5), 0.4, np.arange(3, dtype=np.uint64))
    assert t[0] == 0 and t[1] == 1 and 1 <= t[2] and len(hpylm.seat([], [], 0.4, np.zeros(0, np.uint64))) == 0
    x = hpylm.gamma_draws(np.repeat([1.5, 400.0], 20000), hpylm.mixed(np.arange(40000, dtype=np.uint64)))
    assert x[:20000].mean() == pytest.approx(1.5, rel=0.03) and x[:20000].var() == pytest.approx(1.5, rel=0.08) and x[20000:].mean() == pytest.approx(400, rel=0.01)


def test_quality_classes_skip_lower_case(spark):
    """Classes are counted on what is left without a-z, and are those of the whole text."""
    import re

    text = "Ab1 é<zZ>, \t\n\x7f~ÀÉz_9|q" * 3
    frame = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    rows = quality.features(frame, ["ab"])
    row = rows.first()
    assert list(row["classes"])[:-1] == [len(re.sub(c, "", text)) for c in quality.CLASSES]
    assert row["n_symbols"] == len(re.sub("[^#*$%&|<>]+", "", text))
    assert "[a-z]+" in rows._jdf.queryExecution().optimizedPlan().toString()
