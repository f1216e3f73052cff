"""Tables of commits: readers see whole versions, a second writer is refused, a failed publication changes nothing."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.sources.snapshots import Conflict, Snapshots, publish_version
from corpusloom.streaming import lifecycle as L

SHAPE = "batch_id string, n long"


def rows(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture
def held(spark, tmp_path):
    table = Snapshots(spark, f"{tmp_path}/t", "batch_id")
    table.replace(spark.createDataFrame([("a", 1), ("a", 2), ("b=/%ü", 3)], SHAPE))
    return table


def test_parts_are_replaced_and_old_versions_stay(spark, held):
    assert held.version() == 1
    held.replace(spark.createDataFrame([("a", 9), ("c", 4)], SHAPE))
    assert rows(held.read()) == Counter({("a", 9): 1, ("b=/%ü", 3): 1, ("c", 4): 1})
    assert rows(held.read(1)) == Counter({("a", 1): 1, ("a", 2): 1, ("b=/%ü", 3): 1})
    assert rows(held.read(parts=["b=/%ü", "none"])) == Counter({("b=/%ü", 3): 1}) and held.read(parts=["none"]).count() == 0
    held.replace(spark.createDataFrame([], SHAPE), drop=["a"])
    assert rows(held.read()) == Counter({("b=/%ü", 3): 1, ("c", 4): 1})
    assert len(held.read(parts=["c"]).inputFiles()) == 1
    with pytest.raises(ValueError, match="columns"):
        held.commit(held.entry(), {}, spark.createDataFrame([], "x int").schema)


@pytest.mark.parametrize("step", ["stage", "commit"])
def test_a_writer_that_dies_leaves_the_old_version(spark, held, monkeypatch, step):
    whole, before = getattr(Snapshots, step), rows(held.read())

    def dies(self, *a, **k):
        if step == "stage":
            whole(self, *a, **k)  # the data is written, and then
        raise KeyboardInterrupt

    monkeypatch.setattr(Snapshots, step, dies)
    with pytest.raises(KeyboardInterrupt):
        held.replace(spark.createDataFrame([("a", 100)], SHAPE))
    monkeypatch.undo()
    reader = Snapshots(spark, held.root, "batch_id")
    assert rows(reader.read()) == before and reader.version() == 1
    reader.replace(spark.createDataFrame([("a", 5)], SHAPE))  # the table is not blocked
    assert rows(reader.read())["a", 5] == 1 and reader.vacuum() == 1 and rows(reader.read())["b=/%ü", 3] == 1


def test_of_two_writers_one_is_refused(spark, held):
    one, two = Snapshots(spark, held.root, "batch_id"), Snapshots(spark, held.root, "batch_id")
    first, second = one.entry(), two.entry()
    one.replace(spark.createDataFrame([("a", 10)], SHAPE), first)
    with pytest.raises(Conflict):
        two.replace(spark.createDataFrame([("a", 20)], SHAPE), second)
    assert rows(held.read())["a", 10] == 1 and held.version() == 2

    def late(df):  # another writer comes between; the change is made again on what it left
        if held.version() == 2:
            one.replace(spark.createDataFrame([("a", 11), ("a", 12)], SHAPE))
        return df.select("batch_id", (F.col("n") * 100).alias("n"))

    two.update(["a"], late, held.read().schema)
    assert rows(held.read(parts=["a"])) == Counter({("a", 1100): 1, ("a", 1200): 1}) and held.version() == 4
    with pytest.raises(Conflict):
        two.update(["a"], lambda df: (one.replace(spark.createDataFrame([("a", 1)], SHAPE)), df)[1], held.read().schema, tries=2)


def corpus(spark, tmp_path):
    table = Snapshots(spark, f"{tmp_path}/corpus", "corpus_version")
    data = [("v0", "approved", "published", 1), ("v0", "approved", "withdrawn", 2), ("v1", "approved", "unpublished", 3), ("v1", "rejected", "unpublished", 4), ("v2", "rejected", "unpublished", 5)]
    table.replace(spark.createDataFrame(data, "corpus_version string, review_status string, status string, n int"), note={"active": "v0"})
    return table


def states(table):
    return {r.n: r.status for r in table.read().collect()}


def test_publication_is_one_step(spark, tmp_path):
    table = corpus(spark, tmp_path)
    before, seen = states(table), []

    def smoke(df):
        seen.append({r.n: r.status for r in df.collect()})
        assert states(table) == before  # readers still see the old version
        return len(seen) > 1

    assert publish_version(table, "v1", smoke) == {"passed": False, "reason": "smoke test failed", "active": "v0", "previous": None}
    assert publish_version(table, "v1", lambda df: 1 / 0)["reason"] == "smoke test: ZeroDivisionError"
    assert publish_version(table, "v2")["reason"] == "nothing to publish"
    assert states(table) == before and table.version() == 1
    assert publish_version(table, "v1", smoke) == {"passed": True, "reason": "", "active": "v1", "previous": "v0"}
    assert states(table) == {1: "inactive", 2: "withdrawn", 3: "published", 4: "unpublished", 5: "unpublished"} == seen[1]
    assert table.entry()["note"] == {"active": "v1", "previous": "v0"} and states(table) != {r.n: r.status for r in table.read(1).collect()}


def test_an_ingest_batch_that_comes_again_changes_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(f'{{"id": {i % 5}, "n": {i}}}\n' for i in range(50)))
    table = Snapshots(spark, f"{tmp_path}/t", "bucket")

    def run(checkpoint):
        L.ingest_commits(spark, f"{tmp_path}/in", table, f"{tmp_path}/{checkpoint}", lambda df: df, "id long, n long", ["id"], "n", buckets=3).awaitTermination(300)
        return sorted((r.id, r.n) for r in table.read().collect())

    assert run("cp") == [(i, 45 + i) for i in range(5)] and table.version() == 1
    assert run("cp") == run("lost") == [(i, 45 + i) for i in range(5)] and table.version() == 1  # a lost checkpoint: the same epoch again
    (tmp_path / "in" / "b.json").write_text('{"id": 2, "n": 3}\n{"id": 3, "n": 99}\n{"id": 9, "n": 1}\n')
    assert run("cp") == [(0, 45), (1, 46), (2, 47), (3, 99), (4, 49), (9, 1)] and table.version() == 2
