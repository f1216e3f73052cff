"""The pipeline, stage by stage, against a plain version, and its registered queries."""

from __future__ import annotations

import pytest

import corpus_pipeline as P
from corpusloom.llm import queries
from corpusloom.llm.shared import staged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in P.STAGES:
        out.append((name, docs, docs := staged(f(spark, docs, SF), name)))
    return {n: (a, b) for n, a, b in out}


def test_language_keeps_clean_documents(stages):
    before, after = stages["language"]
    assert after.columns == before.columns and after.count() >= 0.97 * before.count()


def test_exact_keeps_one_of_each_text(stages):
    before, after = stages["exact"]
    best = {}
    for r in before.collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(best.values())


def test_near_keeps_one_of_each_component(stages):
    from itertools import combinations

    from corpusloom.llm.simhash_dedup import fingerprint

    before, after = stages["near"]
    fp = {r.doc_id: fingerprint(r.text) for r in before.collect()}
    label = {i: i for i in fp}
    links = [(a, b) for a, b in combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 3]
    for _ in fp:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(label.values()))


def test_mix_repeats_at_most_twice(stages):
    before, after = stages["mix"]
    known = {r.doc_id for r in before.collect()}
    n = {}
    for r in after.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    assert set(n) <= known and max(n.values()) == 2 and after.columns == before.columns


def test_pack_holds_every_token(stages):
    from corpusloom.llm.tokens import token_counts

    before, after = stages["pack"]
    tokens = sum(r.n_tokens + 1 for r in token_counts(before).collect())
    assert sum(r.length for r in after.collect()) == tokens


def test_queries_cover_the_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
    assert len(P.STAGES) == 5


def test_empty_table(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
