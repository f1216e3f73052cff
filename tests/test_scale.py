"""What grows with the tables must not pass through the driver, nor cost a call a key."""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from collections import Counter
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from corpusloom.functions import text as T
from corpusloom.operators import dedupe as D
from corpusloom.operators import evaluation as E
from corpusloom.operators import practice as P
from corpusloom.operators import retrieval as R
from corpusloom.operators import structure as K
from corpusloom.plans import evaluation_queries as Q
from corpusloom.plans import views as V
from corpusloom.plans.registry import queries
from corpusloom.streaming import lifecycle as L


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_questions_are_not_broadcast(spark):
    quiz = spark.range(5).select(F.col("id").alias("quiz_id"))
    q = quiz.select("quiz_id", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("question_no"), F.create_map(F.lit("A"), F.lit("one")).alias("options"))
    a = quiz.where("quiz_id < 3").select("quiz_id", F.explode(F.sequence(F.lit(1), (F.col("quiz_id") + 1).cast("int"))).alias("question_no"), F.array(F.lit("A")).alias("selected"))
    done = P.progress_status(quiz.withColumn("current_index", F.lit(0)), q, a)
    assert {r.quiz_id: (r.n_answers, r.status, r.error) for r in done.collect()} == {
        0: (1, "in_progress", None), 1: (2, "ready_for_report", None), 2: (3, None, "unknown_question"), 3: (0, "in_progress", None), 4: (0, "in_progress", None),
    }
    wrong = P.answer_violations(q, a)
    assert [tuple(r) for r in wrong.collect()] == [(2, 3, "unknown_question")]
    for df in (done, wrong):
        assert "BroadcastExchange" not in physical(df)


def log(spark, rows):
    return spark.createDataFrame(rows, "key string, seq long, s long, event string, expected_version long").select("key", "seq", F.timestamp_seconds("s").alias("ts"), "event", "expected_version")


def test_blocks_of_many_keys_stream_through_a_task(spark):
    rows = log(spark, [(f"k{i % 50}", i, i, ("create", "claim", "uploading", "ready")[i // 50 % 4], None) for i in range(400)])
    got = L.segmented_fold(rows, "asset", 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, L.fold(rows, "asset").collect()))
    assert "CoGroups" not in physical(got) and "MapInPandas" in physical(got)


def test_keys_of_a_stream_share_state(spark, tmp_path):
    now = 1_700_000_000
    rows = log(spark, [(f"k{i % 90}", i, now + i, ("create", "claim", "uploading")[i // 90], None) for i in range(270)])
    rows.unionByName(log(spark, [("clock", 999, now + 90 * 86400, "tick", None)])).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    out = L.watch(stream, "asset", buckets=4)
    q = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination(300)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in (json.loads(p.json) for p in q.recentProgress) if p["stateOperators"]]
    assert max(held) <= 4 and held[-1] == 1
    got = spark.read.schema(L.TIMED).parquet(f"{tmp_path}/out").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, L.timed_fold(rows, "asset").collect()), key=repr)


def test_terms_are_found_without_postings(spark, monkeypatch):
    chunks = spark.createDataFrame([(1, "The Cat sat"), (2, "concatenate"), (3, None), (4, ""), (5, "at e")], "chunk_id long, text string")
    terms = spark.createDataFrame([("cat",), ("concat",), ("e",), ("at e",), ("tac",)], "term string")
    found = lambda: {(r.chunk_id, t) for r in R.containing(terms, chunks).collect() for t in r.terms}
    want = {(1, "cat"), (1, "e"), (2, "cat"), (2, "concat"), (2, "e"), (5, "e"), (5, "at e")}
    assert found() == want and "Join" not in physical(R.containing(terms, chunks))
    monkeypatch.setattr(R, "TERMS", 2)
    assert found() == want and "Join" in physical(R.containing(terms, chunks))


def corpus(spark):
    rows = [(i, " ".join(f"w{i * j % 23}" for j in range(1, 4 + i % 9)) + (" the" * (i % 4))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "中文 the w1"), (903, "a whole long passage of more than thirty two bytes, kept"), (904, "xé the end")]
    return rows, spark.createDataFrame(rows, "chunk_id long, text string").repartition(5)


def test_lexical_scores_shuffle_no_postings(spark):
    rows, chunks = corpus(spark)
    queries = [(1, "the w3 w4 w4"), (2, "w5 w7 w11 the"), (3, "unheard"), (4, None), (5, "中文"), (6, "W9 w9")]
    asked = spark.createDataFrame(queries, "query_id long, query string")
    index = R.bm25_index(chunks)
    assert "Exchange" not in physical(index.docs)
    words = lambda t: re.findall(r"[a-z][a-z0-9]*", (t or "").lower()) or [(t or "").lower()]
    docs = {c: Counter(words(t)) for c, t in rows if c not in (902, 904)}
    df = Counter(w for d in docs.values() for w in d)
    for block in (2000, 2):
        got = R.bm25_topk(asked.where("query_id not in (4, 5)"), R.bm25_index(chunks.where("chunk_id not in (902, 904)")), 7, block=block)
        shared = R.shared_topk(asked.where("query_id not in (4, 5)"), index, 400, block=block)
        mean = sum(map(Counter.total, docs.values())) / len(docs)
        for q, text in queries:
            if q in (4, 5):
                continue
            idf = {w: math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) for w in set(words(text)) if w in df}
            score = {c: sum(x * d[w] * 2.2 / (d[w] + 1.2 * (0.25 + 0.75 * d.total() / mean)) for w, x in idf.items() if w in d) for c, d in docs.items()}
            best = sorted((-round(s, 9), c) for c, s in score.items() if s)[:7]
            assert [(r.chunk_id, r["rank"]) for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] == [(c, i + 1) for i, (_, c) in enumerate(best)]
            n = {r.chunk_id: r.score for r in shared.where(F.col("query_id") == q).collect()}
            assert {c: s for c, s in n.items() if c < 900} == {c: len(set(words(text)) & d.keys()) for c, d in docs.items() if c < 900 and set(words(text)) & d.keys()}


def test_documents_without_a_query_term_between_others(spark):
    rows = [(i, "none") for i in range(1100)] + [(2000 + i, "none of the w1 " + "more " * i) for i in range(9)] + [(3000 + i, "none " * 60) for i in range(1100)]
    index = R.bm25_index(spark.createDataFrame(rows, "chunk_id long, text string").coalesce(1))
    asked = spark.createDataFrame([(1, "the w1")], "query_id long, query string")
    want = [2000 + i for i in range(5)]
    for hits in (R.bm25_topk(asked, index, 5), R.bm25_search(asked, index, 5)[0]):
        assert [r.chunk_id for r in hits.orderBy("rank").collect()] == want


def test_answers_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    day = datetime(2020, 1, 1)
    orders = [(i, i % 7, "FOP"[i % 3], 1.0, day, "x") for i in range(40)]
    lines = [(i, 9 - j, j, j % 4, 1.0, 2.0, 0.0, 0.0, "ANR"[((i or 0) + j) % 3], "F", day) for i in [*range(39), 77, None] for j in range(6)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(lines, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")
    first = {}
    for i, part, supp, no, *_, flag, _, _ in lines:
        if i is not None and i < 40:
            first[i, no] = min(first.get((i, no), (99,)), (part, supp, flag))
    monkeypatch.setattr(V, "LINES", 20, raising=False)
    got = V.answers(spark, str(tmp_path))
    assert {(r.quiz_id, r.question_no): (r.user_id, r.selected[0]) for r in got.collect()} == {k: (k[0] % 7, v[2]) for k, v in first.items()}
    assert got.count() == len(first) and got.rdd.getNumPartitions() == -(-len(lines) // 20)
    xp = Counter()
    for i in {i for i, _ in first if i % 3 == 0}:
        xp[i % 7] += 10 + 2 * sum(v[2] == "A" for k, v in first.items() if k[0] == i)
    xps = queries()["xp_u8"](spark, str(tmp_path))
    assert {r.user_id: r.xp for r in xps.collect()} == xp
    assert len(re.findall(r"FileScan parquet \[l_orderkey", physical(xps).split("Initial Plan")[0])) == 1


def test_texts_without_a_hit_are_not_shuffled(spark, tmp_path):
    words = [(i, f"text {i} of w{i % 7}", "en", f"s{i % 3}") for i in range(300)]
    spark.createDataFrame(words, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 300, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    hits = spark.createDataFrame([(1, 4, 2.0, 1), (1, 9, 1.0, 2), (2, 9, 1.0, 1), (2, 777, 0.5, 2), (2, 3, 0.1, 6)], "query_id long, chunk_id long, score double, rank int")
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 4000)  # labels are beyond it, a run's hits are not
        got = Q._run(spark, str(tmp_path), hits)
        assert sorted((r.query_id, r["rank"], r.chunk_id, r.text, r.parent_recovered) for r in got.collect()) == [(1, 1, 4, "text 4 of w4", False), (1, 2, 9, "text 9 of w2", True), (2, 1, 9, "text 9 of w2", True)]
        assert "SortMergeJoin" in (plan := physical(got)) or "ShuffledHashJoin" in plan
        below = plan[plan.index("Exchange", plan.index("LeftOuter")) :]
        assert "LeftSemi" in below and "text#" in below
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)


def test_blocks_are_searched_where_documents_are(spark, monkeypatch):
    _, chunks = corpus(spark)
    asked = spark.createDataFrame([(1, "the w3 w4 w4"), (2, "w5 w7 w11 the"), (3, "unheard"), (6, "W9 w9")], "query_id long, query string")
    index = R.bm25_index(chunks)
    n, keep = [], R.staged

    def count(df, name):
        out = keep(df, name)
        n.append(out.count())
        return out

    for block in (2000, 2):
        want = [tuple(r) for r in R.bm25_topk(asked, index, 5, block=block).select("query_id", "rank", "chunk_id").orderBy("query_id", "rank").collect()]
        monkeypatch.setattr(R, "staged", count)
        hits, work = R.bm25_search(asked, index, 5, size=4, first=2, **({} if block == 2000 else {"block": block}))
        monkeypatch.setattr(R, "staged", keep)
        assert [tuple(r) for r in hits.select("query_id", "rank", "chunk_id").orderBy("query_id", "rank").collect()] == want and len(want) == 15
        read = work.collect()
        assert {r.query_id for r in read} == {1, 2, 6} and all(0 < r.postings_read <= r.postings for r in read)
        if block == 2000:  # neither postings nor a row for each block and query are staged
            assert max(n) < 200 < sum(r.postings for r in read)


def test_quoted_texts_are_found_by_windows(spark):
    rows, chunks = corpus(spark)
    queries = ["", "é", "the", " the the", "w0 w0 w0 w0 w0 w0 w0 w0 w0 w0 w0", rows[7][1], rows[7][1][1:-1], "passage of more than thirty two bytes", "thirty two bytes, kept", "中文 the w1", None, "passage of more than thirty two bytes!"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    want = {(q, c) for q, t in enumerate(queries) for c, text in rows if t is not None and text is not None and t in text}
    for block in (20_000, 3):
        got = R.quoting(asked, chunks, block)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_first_texts_stage_no_text(spark, tmp_path, monkeypatch):
    lines = [(f"d{i}:0", f"d{i}", 0, i % 3, ("Same text!", "same, text", f"own {i}")[i % 3], "paragraph") for i in range(60)]
    c = spark.createDataFrame(lines, "chunk_id string, document_id string, child_index int, authority_priority int, text string, knowledge_type string")
    columns = []
    monkeypatch.setattr(D, "staged", lambda df, name: columns.extend(df.columns) or df)
    got = D.first_texts(c).collect()
    assert "text" not in columns and columns
    assert sorted(r.chunk_id for r in got) == sorted(r.chunk_id for r in D.exact_dedupe(c)[0].collect()) and len(got) == 21


def test_a_query_is_not_copied_for_each_parent(spark):
    q = spark.createDataFrame([(1, "a", "An  Owl flies"), (2, "b", "owl"), (3, "c", "owl"), (4, "d", None), (5, "a", "of it"), (6, "e", "owl")], "query_id long, document_id string, query string")
    p = spark.createDataFrame([("a", f"a{i}", t) for i, t in enumerate([None, "an it", "the OWL", "flies"])] + [("b", "b1", "no"), ("b", "b0", "none"), ("d", "d0", "x"), ("e", "e9", "owl"), ("e", "e8", "owls")], "document_id string, parent_id string, text string")
    bound, unbound = E.bind_queries(q, p)
    assert {r.query_id: r.parent_id for r in bound.collect()} == {1: "a2", 2: "b0", 4: "d0", 5: "a0", 6: "e8"}
    assert [r.query_id for r in unbound.collect()] == [3]
    assert "collect_list" in physical(bound)


def test_a_shingle_is_hashed_once(spark, monkeypatch):
    texts = ["", "abc", "abcde", "the same words again and again " * 40, "中文字符的文本内容", "x\x00yzabc", "é" * 700, None, "0123456789" * 999] + [f"text {i} of {i * i} words" * (i % 5) for i in range(60)]
    c = spark.createDataFrame(list(enumerate(texts)), "i long, text string").coalesce(1)

    def plain(t, n, digest):
        grams = [t[k : k + n].encode() for k in range(max(1, len(t) - n + 1))]
        h = [int.from_bytes(digest(g), "big") for g in grams]
        x = sum(1 << j for j in range(64) if 2 * sum(v >> j & 1 for v in h) >= len(h))
        return x - (x >> 63 << 64)

    for at_once, n, algorithm in ((2_000_000, 5, "md5"), (200, 5, "md5"), (1000, 3, "blake2b")):
        monkeypatch.setattr(D, "AT_ONCE", at_once)
        digest = {"md5": lambda b: hashlib.md5(b).digest()[:8], "blake2b": lambda b: hashlib.blake2b(b, digest_size=8).digest()}[algorithm]
        got = {r.i: r.fp for r in c.select("i", D.simhash64(F.col("text"), n, algorithm).alias("fp")).collect()}
        assert got == {i: plain(t or "", n, digest) for i, t in enumerate(texts)}
    assert "SEEN" in vars(D)


def test_nfkc_makes_no_python_strings(spark):
    signs = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    texts = ["a".join(signs[i : i + 500]) for i in range(0, len(signs), 500)] + ["é ﬁ Å̧̊", "", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", T.nfkc("text").alias("t"))
    assert "ArrowEvalPython" in physical(got) and T.nfkc.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    assert {r.i: r.t for r in got.collect()} == {i: None if t is None else unicodedata.normalize("NFKC", t) for i, t in enumerate(texts)}


def test_personal_ingest_makes_blocks_once(spark, monkeypatch):
    names = []
    keep = K.staged
    monkeypatch.setattr(K, "staged", lambda df, name: names.append(name) or keep(df, name))
    docs = spark.createDataFrame([("a", "# H\n\nWhat is it?\nIt is a thing of some length, said here.\n\nmore"), ("b", ""), ("c", None), ("d", "plain text")], "document_id string, text string")
    kept, status = K.ingest_personal(docs, D.exact_dedupe)
    assert names == ["blocks", "parents", "chunks"]
    assert {r.document_id: r.status for r in status.collect()} == {"a": "ready", "b": "failed", "c": "failed", "d": "ready"}
