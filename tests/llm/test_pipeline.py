"""The pipeline's stages on the smallest tables, each against its operator."""

from collections import Counter
from fractions import Fraction

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tracelode.llm import langid, packing, similar, toxicity
from tracelode.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "mixing", "packing"]
    docs = table(spark, SF_DIR, "documents")
    for i, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF_DIR).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "toxicity":
            assert ids == {r["id"] for r in toxicity.score(docs, toxicity.fit(docs, table(spark, SF_DIR, "labels"))).filter("score < 0.5").collect()}
        if name == "language_id":
            assert ids == {r["id"] for r in langid.score(docs, langid.fit(docs)).filter("lang_pred <> 'und'").collect()}
        if name == "simhash_near_dedup":
            assert ids == folded_ids(docs) and out.count() == len(ids)
        if name == "packing":
            assert out.agg({"length": "sum"}).first()[0] == packing.tokenized(docs).agg({"n": "sum"}).first()[0]
        else:
            assert out.columns == docs.columns
        docs = out


def test_run(spark):
    """Two runs agree, but for where documents lie in sequences."""
    piece = lambda df: sorted(map(tuple, df.groupBy("doc_id", "doc_tokens").agg(F.sum("length")).collect()))
    first = piece(cp.run(spark, SF_DIR))
    assert first and first == piece(cp.run(spark, SF_DIR))


def test_odd_rows(spark):
    """Nulls in any column, repeated and empty and long texts, clashing names, and an empty table, stage by stage."""
    rows = [(None, None, None, None, None), (1, "", "en", "web", 0), (1, "other text under one id", "en", None, 3), (2, "½ ² 12", "fr", "web", 1), (3, "word " * 40000, "en", "a", 1)]
    rows += [(4, "the cat sat on the mat and looked at the dog", "en", "web", 5)] * 3 + [(None, "le chat est sur la table avec le chien", "fr", "web", 5)]
    docs = spark.createDataFrame([(*r, "x", 1, 2.0, "t", None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, keep_ string, row_ int, c0_ double, text_ string, key_ string")
    for frame in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            out = stage(spark, frame, SF_DIR)
            got = out.collect()
            if name != "packing":
                assert out.columns == docs.columns
            if frame is not docs:
                assert not got
                continue
            ids = Counter(r["doc_id"] for r in got)
            if name == "toxicity":
                assert len(got) == len(rows)
            if name == "language_id":
                assert ids == Counter({1: 1, 3: 1, 4: 3, None: 1})
            if name == "simhash_near_dedup":
                assert ids == Counter({None: 2, 1: 2, 2: 1, 3: 1, 4: 1})
            if name == "mixing":
                assert set(ids) <= {None, 1, 2, 3, 4} and all(r["text"] for r in got)
            if name == "packing":
                assert set(ids) == {None, 1, 2, 3, 4}


def folded_ids(docs, similarity=0.8):
    """Smallest ids of the components of all pairs whose five-word sets reach the similarity, by brute force."""
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    holders, root = {}, {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sorted(sets.items()):
        met = {}
        for x in s:
            for j in holders.setdefault(x, []):
                met[j] = met.get(j, 0) + 1
            holders[x].append(i)
        for j, both in met.items():
            if 9 * both >= 4 * (len(s) + len(sets[j])):  # both / (union) >= 4/5
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {top(i) for i in sets if sets[i]} | set(sorted(i for i in sets if not sets[i])[:1])


def test_folds_by_jaccard(spark):
    """Against brute force on whole texts, and on edited copies at similarities around the limit."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = [r["doc_id"] for r in cp.fold_near_copies(spark, docs, SF_DIR).select("doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == folded_ids(docs)
    rows = []
    for f in range(6):
        words = [f"w{f}x{i}" for i in range(104)]  # 100 shingles
        rows.append((100 * f + 50, " ".join(words)))
        for c in range(8):  # one changed word costs five shingles (95 / 105), two ten (90 / 110), three fifteen (85 / 115 < 0.8)
            edited = list(words)
            for j in range(c % 4):
                edited[10 + 9 * c + 5 * j] = f"e{f}x{c}x{j}"
            rows.append((100 * f + c, " ".join(edited)))
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"] for r in cp.fold_near_copies(spark, docs, SF_DIR).select("doc_id").collect()}
    assert got == folded_ids(docs) and 0 in got and 50 not in got and 3 in got


def test_fold_keeps_odd_ids(spark):
    one, two, three = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(None, one), (None, two), (None, None), (7, two), (7, three), (7, three), (9, two), (4, one), (5, one + " more"), (8, ""), (6, None)]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.fold_near_copies(spark, docs, SF_DIR)
    assert got.columns == docs.columns
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(repr, [(None, one), (None, two), (None, None), (7, two), (7, three), (4, one), (6, None)]))


def test_fold_asks_simhash(spark):
    """SimHash names near copies, once each for a fingerprint that several texts have; what it names and is not similar stays apart."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(f"x{i}" for i in range(400)), "a b c d", "A  b c d"]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = similar.prefixed(docs, "text", 5, Fraction(4, 5)).localCheckpoint()
    node = {r["doc_id"]: r["node_"] for r in rows.collect()}
    assert node[3] == node[4]
    assert {frozenset(r) for r in similar.print_pairs(rows).collect()} == {frozenset((node[0], node[1]))}
    assert {r["doc_id"] for r in cp.fold_near_copies(spark, docs, SF_DIR).collect()} == {0, 2, 3}
