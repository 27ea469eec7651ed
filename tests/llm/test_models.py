"""Vector search and dedup against brute force, the classifier's held-out accuracy, components, the pipeline, the queries."""

import random

import numpy as np
import pytest
from brute import components
from compare import assert_same
from conftest import SF
from pyspark.sql import functions as F

from strandbook.llm import common, quality, queries, vector_dedup, vector_search


def cloud(n=900, d=24, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)).astype(np.float32)
    for i in range(200, 500):  # near copies of a few
        x[i] = x[i % 40] + 0.25 * rng.standard_normal(d)
    x[500:560] = x[7]
    return x


@pytest.fixture(scope="module")
def vectors(spark):
    x = cloud()
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 24, 0), (920, [float("nan")] * 24, 0), (940, [None] + [1.0] * 23, 0), (960, [float("inf")] * 24, 0), (980, [1.0] * 3, 0), (981, [], 0)]
    return x.astype(float), spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int").repartition(5)


def test_components(spark):
    rng = random.Random(2)
    for n, m in ((60, 40), (300, 280), (50, 49)):
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if n != 50 else [(i, i + 1) for i in range(49)]
        expected = components(range(n), links)
        touched = {x for a, b in links if a != b for x in (a, b)}
        for per_task in (500_000, 15):
            got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(links, "src long, dst long"), per_task).collect()}
            assert got == {x: expected[x] for x in touched}
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize(("k", "region"), [(20, 8192), (20, 128), (2000, 128)])
def test_search(vectors, monkeypatch, k, region):
    x, df = vectors
    monkeypatch.setattr(vector_search, "REGION", region)
    got = {}
    for r in vector_search.nearest(df, k=k, every=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r.rank))
    asked = [i for i in range(len(x)) if i % 20 == 0]
    assert sorted(got) == asked
    hit = 0
    for q in asked:
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:k]
        ids = [v for v, _, _ in got[q]]
        assert len(ids) == len(order) == len(set(ids)) and [r for _, _, r in got[q]] == list(range(1, len(ids) + 1))
        assert np.allclose([c for _, c, _ in got[q]], s[ids])
        hit += len(set(ids) & set(order)) / len(order)
    assert hit / len(asked) >= 0.95


def test_search_ties_and_edges(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(100)], "vec_id long, embedding array<float>")
    rows = vector_search.nearest(same, k=5, every=50).collect()
    assert {q: [r.vec_id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] for q in (0, 50)} == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4]}
    assert vector_search.nearest(same.limit(0)).count() == 0
    assert vector_search.nearest(same.limit(1), every=1).count() == 0


def links_of(x, cosine):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    a, b = np.nonzero(u @ u.T >= cosine)
    return [(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i < j]


@pytest.mark.parametrize("block", [4096, 50])
def test_dedup(vectors, monkeypatch, block):
    x, df = vectors
    monkeypatch.setattr(vector_dedup, "RESIDENTS", block)
    monkeypatch.setattr(vector_dedup, "VISITORS", block)
    got = {r.vec_id: r for r in vector_dedup.near_duplicates(df, 0.9).collect()}
    links = links_of(x, 0.9)
    count = np.bincount(np.array(links).ravel(), minlength=len(x))
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= count).all() and found.sum() >= 0.95 * count.sum()
    expected = components(range(len(x)), links)
    assert np.mean([got[i].component_id == expected[i] for i in range(len(x))]) >= 0.95
    assert all(got[i].kept == (got[i].component_id == i) for i in got)
    for i in (900, 901, 920, 940, 960, 980, 981):
        assert (got[i].n_links, got[i].component_id) == (0, i)
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_dedup_goes_by_row(spark):
    """Ids that repeat, lengths that differ, and links to either row of an id."""
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.05]), (3, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0, 0.0]), (5, [2.0, 0.0]), (6, None), (6, [0.0, 2.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("h", F.lit("clash"))
    got = sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(df, 0.9).collect())
    assert got == sorted([(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False), (3, 1, 3, True), (4, 0, 4, True), (5, 3, 1, False), (6, 0, 6, True), (6, 1, 3, False), (-1, 0, None, False)])


def test_dedup_query_on_planted_pairs(spark, tmp_path):
    """The query's SQL on a table with links, as the driver's has none: cosines on both sides of the threshold."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 16))
    rows = []
    for i, v in enumerate(x):
        aside = rng.standard_normal(16)
        aside -= aside @ v / (v @ v) * v
        cosine = (0.85, 0.899, 0.901, 0.95)[i % 4]
        near = cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * aside / np.linalg.norm(aside)
        rows += [(2 * i, [float(c) for c in v]), (2 * i + 1, [float(c) for c in near])]
    spark.createDataFrame([*rows, (500, None), (501, [0.0] * 16)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "all"))
    (part,) = (tmp_path / "all").glob("*.parquet")
    part.rename(tmp_path / "embeddings.parquet")
    ours = queries.op10_vector_dedup(spark, str(tmp_path)).toPandas().sort_values("vec_id").reset_index(drop=True)
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    theirs = con.execute(queries.ORACLE_SQL["op10_vector_dedup"]).df().sort_values("vec_id").reset_index(drop=True)
    assert (ours.n_links > 0).sum() == 60
    for c in ("vec_id", "n_links", "component_id", "kept"):
        assert (ours[c].astype(int) == theirs[c].astype(int)).all()


def test_search_of_repeated_ids_and_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [2.0, 0.0]), (0, [1.0, 0.0]), (2, [1.0, 1.0, 1.0]), (4, [2.0, 1.0, 1.0]), (6, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vector_search.nearest(df, k=20, every=2).collect())
    assert got == [(0, 1, 1, 3.0), (0, 2, 1, 2.0), (2, 1, 4, 4.0), (4, 1, 2, 4.0)]


def test_multi_sequence_is_nearest_first():
    rng = np.random.default_rng(4)
    index = vector_dedup.MultiIndex(rng.standard_normal((9, 5)), rng.standard_normal((7, 5)))
    x = rng.standard_normal((40, 10))
    total = vector_dedup.apart(x[:, :5], index.first)[:, :, None] + vector_dedup.apart(x[:, 5:], index.second)[:, None, :]
    for most in (1, 10, 63):
        cells = index.traverse(x, most)
        got = np.take_along_axis(total.reshape(40, -1), cells, 1)
        assert np.allclose(got, np.sort(total.reshape(40, -1), 1)[:, :most])


def test_quality_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    out = queries.op9_quality(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    held = out.merge(labels, on="doc_id").query("held_out")
    assert len(held) > 50 and (held.predicted == held.quality).mean() >= 0.93
    assert out.score.between(0, 1).all() and out.score.notna().all()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(i, "good words of all kinds here" if i % 2 else "!! ?? !! ??", "x") for i in range(60)] + [(70, None, "x"), (71, "", "x"), (None, "words", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (5, 7)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert all(out[i].predicted == i % 2 for i in range(60)) and out[70].score == out[71].score
    assert out[None].score > 0.5
    flat = {round(r.score, 9) for r in quality.classify(docs, labels.filter("quality = 1")).collect()}
    assert len(flat) == 1
    assert quality.classify(docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracles(spark, name):
    assert_same(queries.QUERIES[name], queries.ORACLE_SQL[name], spark, SF)


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from brute import jaccard, repeated_words

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / f"{k}"))
        was, docs = docs, spark.read.parquet(str(tmp_path / f"{k}"))
        seen[name] = ({r.doc_id: r for r in was.collect()}, docs.collect())
        assert k == 4 or docs.columns == corpus_pipeline.COLUMNS
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = seen["quality"]
    kept = {r.doc_id for r in after}
    assert np.mean([(d in kept) == bool(labels[d]) for d in before if d in labels]) >= 0.93
    before, after = seen["near_copies"]
    assert {r.doc_id for r in after} == {d for d, (_, c) in jaccard([(d, r.text) for d, r in before.items()]).items() if c == d}
    before, after = seen["passages"]
    assert not repeated_words([(r.doc_id, r.text) for r in after]) and all(r.n_chars == len(r.text) for r in after)
    before, after = seen["mixing"]
    assert {r.doc_id for r in after} <= set(before) and max(sum(r.doc_id == d for r in after) for d in before) <= 2
    assert len(seen["tokens"][1]) == len(after)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in seen["tokens"][1])


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_of_odd_rows(spark, tmp_path, empty):
    """Nulls in any column, ids and rows that repeat, long and empty texts, extra columns; and empty tables."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(5)
    some = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(n))
    a, b = some(80), some(90)
    rows = [(1, a), (1, a), (1, b), (2, a + " more"), (None, a), (3, None), (4, ""), (5, some(30_000)), (6, f"{some(60)} {b}"), *((k, some(40)) for k in range(10, 30))]
    docs = spark.createDataFrame([] if empty else [(d, t, None, None if k % 3 else "s", None, "x") for k, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars int, score string")
    labels = spark.createDataFrame([] if empty else [(d, 1) for d in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")
    for name, df in (("documents", docs), ("labels", labels)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(out) != empty
    if not empty:
        assert sum(r.doc_id == 1 for r in out) <= 4 and {None, 3, 4, 5, 6} <= {r.doc_id for r in out}


@pytest.mark.parametrize("piece", [65_536, 7])
def test_context_sums_and_pooling_against_plain_loops(monkeypatch, piece):
    import re

    import pyarrow as pa

    monkeypatch.setattr(quality, "PIECE", piece)
    rng = random.Random(4)
    texts = [None, "", "one", " ".join(rng.choice(["alpha", "beta!!", "c_d", "é, x", "9"]) for _ in range(80)), "a" * 9_000, "beta!! one\n\nalpha"]
    column = pa.array(texts)
    t, counts = quality.tokens(column)
    plain = [re.findall(r"\w+|[^\w\s]+", x or "") for x in texts]
    assert counts.tolist() == [len(x) for x in plain]
    bucket = {}
    for word, b in zip((w for x in plain for w in x), t.tolist(), strict=True):
        assert bucket.setdefault(word, b) == b
    index = quality.index_vectors(3)
    rows = np.zeros((quality.BUCKETS, quality.DIMS), np.int64)
    quality.add_contexts(rows, t, counts, index)
    expected = np.zeros_like(rows)
    for words in plain:
        for i, w in enumerate(words):
            for j in range(max(i - quality.REACH, 0), min(i + quality.REACH + 1, len(words))):
                if j != i:
                    expected[bucket[w]] += index[bucket[words[j]]]
    assert (rows == expected).all()
    vectors = quality.word_vectors(rows.astype(float), 3)
    pooled = quality.pooled(column, vectors)
    for x, words in zip(pooled, plain, strict=True):
        mean = np.mean([vectors[bucket[w]] for w in words], axis=0) if words else np.zeros(vectors.shape[1])
        n = max(len(words), 1)
        lengths = [np.log((half**2).sum() * n + 0.01) for half in (mean[:quality.DIMS], mean[quality.DIMS:])]
        assert np.allclose(x, [*mean, *lengths, np.log(n)], atol=1e-5)
