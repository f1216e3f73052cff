"""The pipeline's stages on rows that their ids don't tell apart: null ids, repeated rows, reused ids."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from corpusloom.llm.shared import staged
from corpusloom.llm.source_mix import source_mix

SHAPE = "doc_id long, text string, source string, lang string"


def text(i, n=12):
    return " ".join(f"w{i}x{j}" for j in range(n))


@pytest.fixture(scope="module")
def make(spark):
    return lambda rows, n=3: staged(spark.createDataFrame(rows, SHAPE).repartition(n), "test")


def test_exact_tells_rows_apart(spark, make):
    rows = [(1, text(0)), (9, text(0)), (1, text(1))]  # 1 is reused: one copy goes, the unique text stays
    rows += [(None, text(2)), (None, text(2)), (None, text(3))] + [(5, text(4))] * 6 + [(None, text(5)), (3, text(5)), (7, None), (None, "")]
    want = [(9, text(0)), (1, text(1)), (None, text(2)), (None, text(3)), (5, text(4)), (3, text(5)), (7, None)]
    got = P.exact(spark, make([(*r, "a", "en") for r in rows]), "")
    assert got.columns == ["doc_id", "text", "source", "lang"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)


def test_near_tells_rows_apart(spark, make):
    rows = [(4, text(0)), (8, text(0)), (8, text(1))]  # 8 is reused: the copy goes, the unique text stays
    rows += [(None, text(2)), (None, text(2)), (None, text(3)), (None, text(4)), (6, text(4))] + [(5, text(5))] * 6
    want = [(4, text(0)), (8, text(1)), (None, text(2)), (None, text(3)), (6, text(4)), (5, text(5))]
    got = P.near(spark, make([(*r, "a", "en") for r in rows]), "")
    assert got.columns == ["doc_id", "text", "source", "lang"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(want)


def test_mix_draws_each_row_as_often_as_it_is_taken(spark, make):
    rows = [(None, text(i), "a", "en") for i in range(30)] + [(7, text(100), "b", "en")] * 20 + [(8, text(200 + i), "c", "en") for i in range(20)]
    docs = make(rows)
    taken = source_mix(docs, keep=docs.columns).select("kept.*", "size", "taken")
    want, there = Counter(), Counter(rows)
    for r in taken.collect():
        want[tuple(r)[:4]] += r.taken // r.size
    got = Counter(map(tuple, P.mix(spark, docs, "").collect()))
    assert got == +want and all(n <= 2 * there[r] for r, n in got.items())
    assert any(r[0] is None for r in got) and got[7, text(100), "b", "en"] > 2
    again = Counter(map(tuple, P.mix(spark, docs.repartition(7), "").collect()))
    assert got == again
    words = source_mix(docs).groupBy("doc_id").agg(F.sum("taken").alias("n"))
    drawn = Counter()
    for r, n in got.items():
        drawn[r[0]] += 12 * n
    assert {r.doc_id: r.n for r in words.collect()} == dict(drawn)


def test_language_decides_each_row_by_itself(spark, make):
    from corpusloom.llm.language_id import fit, held_out, identify

    de, en = "der die das und ist nicht mit dem haus strasse", "the house and the people of that street were not there"
    rows = [(i, f"{en} {i}", "a", "en") for i in range(40)] + [(100 + i, f"{de} {i}", "b", "de") for i in range(40)]
    odd = [(None, en, "a", None), (None, en, "a", None), (3, None, "a", "en"), (3, "", None, "en"), (4, "12 34 !", "a", "de"), (5, "日本語 テキスト", "a", "en"), (600, f"{de} " * 4000, None, None)]
    docs = make(rows + odd).selectExpr("doc_id", "text", "source", "lang", "1 AS score", "'x' AS lang_pred")
    got = P.language(spark, docs, "")
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    assert kept == Counter((r[0], r[1]) for r in rows + odd if r[1] and r[1][0] not in "1日")
    same = identify(docs, fit(docs.where(~held_out())), keep=["doc_id", "text"]).where("lang_pred <> 'und' and score >= 0.5").select("kept.*")
    assert kept == Counter((r.doc_id, r.text) for r in same.collect())
    assert {r.lang for r in got.where("doc_id >= 100").collect()} == {"de"}
    assert P.language(spark, docs.where("false"), "").count() == 0


def test_pack_takes_every_row(spark, make):
    rows = [(7, text(0), "a", "en")] * 3 + [(None, text(1), "a", "en")] * 2 + [(8, None, None, None), (9, "", "a", "en"), (10, "word " * 9000, "a", "en")]
    got = P.pack(spark, make(rows), "").toPandas()
    assert (got.piece == 0).sum() == len(rows) and sorted(got[got.doc_id == 10].piece) == [0, 1, 2] and got.groupby("sequence_id").length.sum().max() <= 4096
    assert got[got.doc_id.isin([8, 9])].length.tolist() == [1, 1]


def test_stages_keep_columns_of_any_name(spark, make):
    de, en = "der die das und ist nicht mit dem haus strasse", "the house and the people of that street were not there"
    rows = [(i, f"{en} {text(i)}", "a", "en") for i in range(30)] + [(100 + i, f"{de} {text(i)}", "b", "de") for i in range(30)] + [(200, f"{en} {text(3)}", "a", "en")]
    named = {"_row": "concat('keep-', doc_id)", "ROW": "doc_id", "a.b": "doc_id + 1", "kept": "'k'", "doc": "'d'", "place": "1", "size": "-1", "taken": "0", "id": "7", "hash": "8", "a`c": "9"}
    docs = make(rows)
    for name, value in named.items():
        docs = docs.withColumn(name.replace("`", "`"), F.expr(value))
    docs = staged(docs.select(*[f"`{c.replace('`', '``')}`" for c in docs.columns if c != "lang"], "lang"), "named")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        got = [r.asDict() for r in out.collect()]
        assert got and all(r["_row"] == f"keep-{r['doc_id']}" and r["ROW"] == r["doc_id"] and r["a.b"] == r["doc_id"] + 1 and r["a`c"] == 9 for r in got), name
        assert stage(spark, docs.where("false"), "").count() == 0 or name == "language"
    assert P.pack(spark, docs, "").columns[0] == "doc_id"
