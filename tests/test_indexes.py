"""Indexes against full scans: results are the same, and the work that they save is counted."""

from __future__ import annotations

import random

import numpy as np
import pytest

from corpusloom.operators import retrieval as R
from corpusloom.operators import vector_index as V

DIM = 16


def clustered(n=3000, clusters=40, seed=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (clusters, DIM))
    middle /= np.linalg.norm(middle, axis=1, keepdims=True)
    hot = np.where(rng.random(n) < 0.35, 0, rng.integers(0, clusters, n))  # a third in one cluster
    return middle[hot] + rng.normal(0, 0.06, (n, DIM))


@pytest.fixture(scope="module")
def vectors(spark):
    x = clustered()
    x[100:140] = x[99]  # equal ones: ties by id
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * DIM), (5002, [float("nan")] * DIM)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(6)


def asked(vectors):
    return vectors.where("chunk_id % 60 = 39 or chunk_id >= 5000").selectExpr("chunk_id AS query_id", "embedding")


def rows(hits):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 8)) for r in hits.collect())


@pytest.mark.parametrize("bounds", [{}, {"lists": 7, "block": 100}, {"lists": 200}])
def test_the_index_gives_what_a_scan_gives(vectors, bounds):
    q = asked(vectors)
    fine = vectors.where("chunk_id < 5000")
    want = rows(R.dense_topk(q.where("query_id < 5000"), fine, 20))
    index = V.build_index(vectors, **bounds)
    hits, work = V.search(q, index, 20, probes=2, exact=True)
    assert rows(hits) == want
    read = work.toPandas()
    assert len(read) == 50 and read.rows_read.max() <= 3000
    if bounds == {}:
        assert read.rows_read.mean() < 0.75 * 3000 and read.rows_read.min() < 300


def test_probes_find_planted_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (4000, DIM))
    near = [(10_000 + 5 * i + j, x[i] + rng.normal(0, 0.05, DIM)) for i in range(60) for j in range(5)]
    data = spark.createDataFrame([(i, v.tolist()) for i, v in [*enumerate(x), *near]], "chunk_id long, embedding array<double>")
    q = data.where("chunk_id < 60").selectExpr("chunk_id AS query_id", "embedding")
    hits, work = V.search(q, V.build_index(data), 6, probes=4)
    found = {(r.query_id, r.chunk_id) for r in hits.collect()}
    recall = np.mean([(i, 10_000 + 5 * i + j) in found for i in range(60) for j in range(5)])
    read = work.toPandas()
    assert recall >= 0.9 and (read.lists == 4).all() and read.rows_read.max() < 0.2 * 4300


def test_an_empty_index(vectors):
    hits, work = V.search(asked(vectors), V.build_index(vectors.where("chunk_id >= 5000")), 5, exact=True)
    assert hits.count() == 0 and work.count() == 0
    hits, _ = V.search(asked(vectors).where("false"), V.build_index(vectors), 5, exact=True)
    assert hits.count() == 0


def texts(spark, n=2500, seed=8):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["the"] * rng.randint(1, 12) + [f"w{int(rng.paretovariate(0.5)) % 400}" for _ in range(rng.randint(2, 60))]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
    rows += [(n + i, "rareword the the " + rows[i][1]) for i in range(30)] + [(n + 50, ""), (n + 51, None)] + [(n + 60 + i, "the equal text w7") for i in range(20)]
    return spark.createDataFrame(rows, "chunk_id long, text string").repartition(5)


@pytest.mark.parametrize(("size", "first"), [(16, None), (1, 1), (300, 2)])
def test_blocks_give_what_a_full_scan_gives(spark, size, first):
    chunks = texts(spark)
    asked = spark.createDataFrame([(1, "the rareword"), (2, "the"), (3, "w7 w9 w11 w300"), (4, "unheard"), (5, ""), (6, "equal text the w1"), (7, None)], "query_id long, query string")
    index = R.bm25_index(chunks)
    hits, work = R.bm25_search(asked, index, 10, size=size, first=first)
    assert rows(hits) == rows(R.bm25_topk(asked, index, 10)) and hits.count() >= 40
    read = work.toPandas().set_index("query_id")
    assert (read.postings_read <= read.postings).all()
    if size == 16:  # the frequent word's postings are skipped where the rare word is not
        assert read.postings_read[1] < 0.45 * read.postings[1] and read.postings_read[6] < 0.6 * read.postings[6], read


def test_blocks_of_nothing(spark):
    chunks = texts(spark).where("false")
    hits, work = R.bm25_search(spark.createDataFrame([(1, "the")], "query_id long, query string"), R.bm25_index(chunks), 10)
    assert hits.count() == 0 and work.count() == 0


def plain_overlap(asked, chunks, k):
    out = []
    for q, text in asked:
        words = list(dict.fromkeys((text or "").lower().split()))
        scored = [(-round(sum(w in t.lower() for w in words) / len(words), 9), c) for c, t in chunks if words and t is not None]
        out += [(q, i + 1, c, round(-s, 8)) for i, (s, c) in enumerate(sorted(x for x in scored if x[0] < 0)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "grams"), [(2000, 2_000_000), (3, 2_000_000), (2000, 1)])
def test_contained_terms_by_grams(spark, monkeypatch, block, grams):
    monkeypatch.setattr(R, "GRAMS", grams)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abCDé中") for _ in range(rng.randint(1, 6)))
    chunks = [(i, " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(300)] + [(900, None), (901, ""), (902, "xyzabcd" * 50)]
    asked = [(i, " ".join(word() for _ in range(rng.randint(0, 8)))) for i in range(25)] + [(80, None), (81, "zabc yzabcdxyza the"), (82, "AB ab Ab")]
    c = spark.createDataFrame(chunks, "chunk_id long, text string").repartition(4)
    q = spark.createDataFrame(asked, "query_id long, query string")
    assert rows(R.overlap_topk(q, c, 7, block)) == plain_overlap(asked, chunks, 7)


def test_grams_leave_few_candidates(spark):
    chunks = texts(spark)
    terms = spark.createDataFrame([("rareword",), ("w300",), ("unheard",), ("e",)], "term string")
    got = R.containing(terms, chunks).toPandas()
    verified = sum(map(len, got.terms))
    assert verified >= 30 and got.candidates.sum() <= 1.2 * verified + 20
    assert R.containing(terms.where("false"), chunks).count() == 0 and R.containing(terms, chunks.where("false")).count() == 0


def test_more_queries_than_a_block(vectors):
    fine = vectors.where("chunk_id < 3000")
    q = asked(fine)
    assert rows(R.dense_topk(q, fine, 9, block=7)) == rows(R.dense_topk(q, fine, 9))
