"""The Merkle manifest against a plain version, row by row."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from oracle import differences, duck
from pyspark.sql import functions as F

from corpusloom.llm.merkle import merkle_manifest
from corpusloom.llm.queries import oracle_sql, queries
from corpusloom.llm.ranks import ranked

SHAPE = "doc_id long, source string, lang string, n_chars int, text string, rank int, tree string, `a.b` string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lower(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def climb(nodes, at):
    """Root of a list of digests and the runs (left, right) beside place ``at``, leaf first."""
    beside = []
    while len(nodes) > 1:
        run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
        beside.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        nodes, at = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], at // 8
    return nodes[0], beside


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r[:5]), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in langs:
        groups[g].sort(key=lambda t: t[:3])
    subroots = [climb([t[2] for t in groups[g]], 0)[0] for g in langs]
    out = []
    for k, g in enumerate(langs):
        for i, (_, _, digest, r) in enumerate(groups[g]):
            (sub, low), (root, high) = climb([t[2] for t in groups[g]], i), climb(subroots, k)
            turned = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            node = leaf((*r[:4], lower(r[4]))) if turned else digest
            for a, b in low + high:
                node = sha(a, node, b)
            out.append((r[0], digest, sub, root, sha(*(a + b for a, b in low + high)), node, node == root))
    return Counter(out)


def check(spark, rows, n=3):
    df = spark.createDataFrame(rows, SHAPE).repartition(n)
    changed = {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    got = merkle_manifest(df, tampered=F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changes=changed)
    assert Counter(map(tuple, got.collect())) == plain(rows)
    return got


def row(i, lang="en", text="Some Text"):
    return (i, "s", lang, 9, text, 5, "x", "y")


@pytest.mark.parametrize("n", [1, 8, 9, 65, 600])
def test_one_language(spark, n):
    check(spark, [row(i, text=f"Text {i} Ä") for i in range(n)])


def test_odd_rows(spark):
    rows = [row(i, ["en", "de", None, "", "ÿ", "z"][min(i % 9, 5)], [None, "", "Aa\n" * (i % 50), "É:Ü"][i % 4]) for i in range(700)]
    rows += [row(None)] * 3 + [row(None, None, None)] * 2 + [row(5)] * 100 + [row(12, "lone", "X" * 200_000)]
    rows += [(None, None, None, None, None, None, None, None)]
    got = check(spark, rows, 7)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert 0 < got.where("verified").count() < len(rows)


def test_many_languages(spark):
    check(spark, [row(i, f"l{i % 90}") for i in range(300)])


def test_no_rows(spark):
    assert merkle_manifest(spark.createDataFrame([], SHAPE)).count() == 0


def test_ranks_of_a_hot_group(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', concat('g', id % 7)) AS g", "id % 40 AS x", "id").repartition(9)
    got = ranked(rows, ["g"], ["x"]).toPandas()
    for _, part in got.groupby("g"):
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(len(part))) and part.x.is_monotonic_increasing and (part.n == len(part)).all()


def test_query_is_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert not differences(queries()["op13_merkle_manifest"](spark, sf), duck(sf), oracle_sql()["op13_merkle_manifest"])
