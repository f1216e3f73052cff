"""Literal cases: cleaning, structure, dedupe, retrieval rules, metrics, practice."""

from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import cleaning as C
from corpusloom.operators import dedupe as D
from corpusloom.operators import evaluation as E
from corpusloom.operators import practice as P
from corpusloom.operators import retrieval as R
from corpusloom.operators import structure as K
from corpusloom.sources import tables as S


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


def test_clean_text(spark):
    got = one(spark, "Redis\x00  RDB 机制\n\n\nAOF 写入", T.clean_text)
    assert (got.text, got.warnings) == ("Redis RDB 机制\n\nAOF 写入", ["control_characters_removed"])
    assert one(spark, None, T.clean_text).text == ""
    assert one(spark, "ab锟斤拷", T.clean_text).warnings == ["possible_mojibake"]


def test_identifiers_topics_and_terms(spark):
    assert one(spark, "hashM ap and J ava, Spring Boot", T.rejoin_identifiers) == "hashMap and Java, Spring Boot"
    assert one(spark, "请给我讲一下我想学习 Redis 持久化机制", T.normalize_topic) == "Redis 持久化机制"
    assert one(spark, "我想学习", T.normalize_topic) == "我想学习"
    got = one(spark, "Redis，Kafka、Redis;MySQL", T.prepare_topic)
    assert got.parts == ["Redis", "Kafka", "MySQL"] and not got.is_url
    assert one(spark, "https://example.org/x", T.prepare_topic).is_url
    assert one(spark, "求替考", T.blocked_term) == "替考" and one(spark, "Redis", T.blocked_term) is None
    assert one(spark, "怎样 洗 钱－教 程", T.safety_match).category == "illegal"
    assert one(spark, "ＲＥＤＩＳ ﬁ ⼀", T.clean_ocr_text) == "REDIS fi 一"
    assert one(spark, " YES ", T.judge_text) == "正确" and one(spark, "否", T.judge_text) == "错误" and one(spark, "maybe", T.judge_text) is None


def test_tokens(spark):
    got = one(spark, "HashMap 与 ConcurrentHashMap 的底层结构", T.tokens_topic)
    assert {"hashmap", "concurrenthashmap", "底层"} <= set(got)
    assert one(spark, "Redis 缓存", T.tokens_bm25) == ["redis", "缓", "存", "缓存"]
    assert one(spark, "!!", T.tokens_bm25) == ["!!"]


@pytest.mark.parametrize(("line", "asks"), [("Q1: what", True), ("问题 3：x", True), ("1. 如何使用 Redis", True), ("QPS …", False), ("Queue<Integer> …", False), ("这是一个真正的中文问题？", True), ("a = b ?", False), ("", False)])
def test_question_lines(spark, line, asks):
    assert one(spark, line, T.is_question_line) is asks


def test_blocks(spark):
    text = "# Redis\n\n- a\n- b\n\n```\ncode\n```\n\n## AOF\n\nplain words"
    got = K.segment_blocks(spark.createDataFrame([("d", text)], "document_id string, text string")).orderBy("block_index").collect()
    assert [b.kind for b in got] == ["heading", "list", "code", "heading", "paragraph"]
    assert [b.section_path for b in got] == [["Redis"]] * 3 + [["Redis", "AOF"]] * 2
    assert all(text[b.start_index :].lstrip("# ").startswith(b.text[:3]) for b in got)


def blocks(spark, *rows):
    full = [("d", i, t, k, p, p, [], 0) for i, (t, k, p) in enumerate(rows)]
    return spark.createDataFrame(full, "document_id string, block_index int, text string, kind string, page_start int, page_end int, section_path array<string>, start_index int")


def test_parents(spark):
    got, rejected = K.assemble_parents(blocks(spark, ("标题", "heading", 1), ("什么是 Redis？\n一个内存数据库。\n什么是 AOF？\n一种日志。", "paragraph", 1)))
    assert [p.parent_type for p in got.orderBy("parent_index").collect()] == ["qa", "qa"]
    assert [r.reason for r in rejected.collect()] == ["heading_context_only"]
    got, _ = K.assemble_parents(blocks(spark, ("什么是 Redis 的持久化机制以及它的作用？", "paragraph", 1), ("它把内存中的数据写入磁盘，重启之后可以恢复数据，有两种方式可以选择。", "paragraph", 2)))
    p = got.first()
    assert (p.parent_type, p.page_start, p.page_end, p.confidence) == ("qa", 1, 2, 0.82)
    got, _ = K.assemble_parents(blocks(spark, ("什么是 Redis？\n为什么它很快？\n因为在内存里。", "paragraph", 1)))
    assert got.count() == 1
    assert K.assemble_parents(blocks(spark, ("x", "table", 1)).where("false"))[0].count() == 0


def test_cover(spark):
    u = spark.createDataFrame([("d", 1, 5, "qa", 5)], "document_id string, start int, end int, type string, text_length int")
    assert [r.violation for r in K.cover_violations(u).collect()] == ["gap_or_overlap"]


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab ,。\n", max_size=120), st.integers(5, 30))
def test_pieces_cover_the_text(text, size):
    for pieces in (K.recursive_pieces(text, size, size // 4), K.line_windows(text, size, size // 4)):
        assert all(text[at:].lstrip().startswith(p[:3]) or not p for p, at in pieces)
        left = "".join(text.split())
        for p, _ in pieces:
            assert "".join(p.split()) in left
    assert all(len(p) <= size for p, _ in K.recursive_pieces(text, size, 0))


def plain_web(text, size):
    def cut(s):
        s = s.strip()
        if len(s) <= size:
            return [s] if s else []
        at = max((i for i, c in enumerate(s[:size]) if c == " " and i > size // 2), default=size)
        return [s[:at].strip(), *cut(s[at:])]

    return [p for part in re.split(r"\n(?=#)|\n\n+", text) for p in cut(part)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab# \n\t\u3000", max_size=90), st.integers(1, 25))
def test_web_pieces(text, size):
    assert K.web_pieces(text, size) == plain_web(text, size)


def test_parents_at_the_limit(spark):
    def recovered(*children):
        chunks = spark.createDataFrame([("p", i, t) for i, t in enumerate(children)], "parent_id string, child_index int, text string")
        return R.recover_parents(spark.createDataFrame([("q", "p")], "query_id string, parent_id string"), chunks, 10).first().parent_text

    for n in range(6, 13):  # the first child ends before, at and past the limit
        assert recovered("a" * n, "bc", "d") == ("a" * n + "\nbc\nd")[:10]
    assert recovered("", "", "x" * 12) == "\n\nxxxxxxxx"


def test_table_groups():
    text = "<table><tr><th>h</th></tr>" + "<tr><td>x</td></tr>" * 20 + "</table>"
    got = K.table_groups(text, 120)
    assert len(got) > 2 and all(s.startswith("<table>") and "<th>h</th>" in s and s.endswith("</table>") and len(s) <= 120 for s, _ in got)
    assert sum(s.count("<td>") for s, _ in got) == 20


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=25), st.integers(1, 60), st.integers(0, 20))
def test_runs(lengths, room, overlap):
    got = K.runs(lengths, room, overlap)
    assert got[0][0] == 0 and got[-1][1] == len(lengths)
    for a, b in got:
        assert b > a and (b == a + 1 or sum(lengths[a:b]) <= room) and (b == len(lengths) or sum(lengths[a : b + 1]) > room)
    for (a, b), (c, _) in zip(got, got[1:], strict=False):
        assert a < c <= b and (c == a + 1 or sum(lengths[c:b]) >= overlap) and (c == b or sum(lengths[c + 1 : b]) < overlap)


def test_a_slice_is_even_and_within_the_budget(spark):
    rows = [("a", i, "x" * 100) for i in range(10)] + [("b", i, "y" * (300 + 7 * (i % 5))) for i in range(40)] + [("c", 0, "z" * 9000)]
    rows += [("d", i, "w" * (900 if i % 2 else 60)) for i in range(21)]
    got = R.slice_document(spark.createDataFrame(rows, "document_id string, child_index int, text string"), 8000).collect()
    for doc in "abcd":
        size = {i: len(t) for d, i, t in rows if d == doc}
        n, total = len(size), sum(size.values())
        want = set(size)
        if total > 5000:
            slots = max(2, min(n, 5000 // max(1, total // n)))
            want = {round(k * (n - 1) / (slots - 1)) for k in range(slots)}
            left = 5000 - sum(size[i] for i in want)
            for i in sorted(set(size) - want):
                if size[i] <= left:
                    want.add(i)
                    left -= size[i]
        assert {r.child_index for r in got if r.document_id == doc} == want, doc


def test_parents_of_units_and_of_bare_texts(spark):
    b = blocks(spark, ("标题", "heading", 1), ("alpha beta", "paragraph", 2)).withColumn("start_index", F.when(F.col("kind") == "heading", 0).otherwise(3).cast("int"))
    docs = spark.createDataFrame([("d", "标题\nalpha beta"), ("bare", "only text"), ("none", "")], "document_id string, text string")
    parents, _ = K.assemble_parents(b, docs)
    got = {p.document_id: (p.parent_type, p.confidence, p.text) for p in parents.collect()}
    assert got == {"d": ("paragraph", 0.35, "alpha beta"), "bare": ("paragraph", 0.25, "only text")}
    units = [("d", 0, 3, "section"), ("d", 3, 13, "qa"), ("bare", 1, 9, "qa")]  # the second text is not covered
    made = K.parents_from_units(parents, b, docs, spark.createDataFrame(units, "document_id string, start int, end int, type string")).orderBy("document_id", "parent_index").collect()
    assert [(p.document_id, p.parent_type, p.text, p.confidence, p.page_start) for p in made] == [
        ("bare", "paragraph", "only text", 0.25, None), ("d", "section", "标题\n", 0.75, None), ("d", "qa", "alpha beta", 0.75, 2)
    ]


def test_overlap_counts_terms_that_texts_contain(spark):
    asked = spark.createDataFrame([(1, "Ab cd ab"), (2, " "), (3, "zz")], "query_id long, query string")
    chunks = spark.createDataFrame([(10, "xabx"), (11, "ABCD"), (12, "none"), (13, None)], "chunk_id long, text string")
    got = [(r.query_id, r.chunk_id, r.score, r["rank"]) for r in R.overlap_topk(asked, chunks, 5, block=1).orderBy("query_id", "rank").collect()]
    assert got == [(1, 11, 1.0, 1), (1, 10, 0.5, 2)]


def test_questions_too_close(spark):
    q = [(0, "什么是 Redis 的持久化", "a", ""), (1, "什么是 redis 的持久化？", "b", ""), (2, "另一个完全不同的题目内容", "A", ""), (3, "how does it work at all", "", "")]
    q += [(4, "explain the write ahead log in detail", "", ""), (5, "explain the write ahead logs in detail", "", "")]
    df = spark.createDataFrame([(1, *r) for r in q] + [(2, *q[0])], "quiz_id long, pos int, stem string, knowledge_point string, explanation string")
    got = {(r.quiz_id, r.pos, r.other_pos): r.reason for r in D.diversity_errors(df).collect()}
    assert got == {(1, 1, 0): "same_stem", (1, 2, 0): "same_point", (1, 5, 4): "similar_stem"}


def test_batches_are_numbered_over_partitions(spark):
    df = spark.createDataFrame([(f"q{i:03}", i) for i in range(237)], "query_id string, n int").repartition(7)
    assert [r.batch for r in E.batches(df).orderBy("query_id").collect()] == [i // 10 for i in range(237)]


CHUNK = "chunk_id string, document_id string, child_index int, authority_priority int, knowledge_type string, text string"


def greedy(rows):
    """Sequential near dedupe, as a plain loop."""
    seen, kept, gone = {}, [], {}
    canonical = lambda r: " ".join(r[5].split()) if r[4] == "code" else "".join(c for c in r[5].lower() if c.isascii() and c.isalnum()) or " ".join(r[5].split())
    for r in sorted(rows, key=lambda r: (r[3], r[1], r[2], r[0])):
        text = canonical(r)
        if text in seen:
            gone[r[0]] = seen[text]
            continue
        if r[4] != "code":
            near = next((k for k, f in kept if (f ^ fp(text)).bit_count() <= 3 and f >> 48 == fp(text) >> 48), None)
            if near:
                gone[r[0]] = near
                continue
            kept.append((r[0], fp(text)))
        seen[text] = r[0]
    return gone


def fp(text):
    import hashlib

    grams = [text[i : i + 5] for i in range(max(1, len(text) - 4))]
    h = [int.from_bytes(hashlib.md5(g.encode(), usedforsecurity=False).digest()[:8], "big") for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) >= len(h))


def test_greedy_dedupe_equals_the_loop(spark):
    import random

    rng = random.Random(4)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            words[rng.randrange(60)] = rng.choice(["alpha", "betas", "x"])
        rows.append((f"c{i:02d}", f"d{i % 7}", i, rng.randrange(3), rng.choice(["paragraph"] * 4 + ["code"]), " ".join(words)))
    df = spark.createDataFrame(rows, CHUNK)
    kept, gone = D.dedupe(df)
    assert {r.chunk_id: r.duplicate_of for r in gone.where("kind is not null").collect()} == greedy(rows)
    assert kept.count() == 60 - len(greedy(rows))


def test_retrieval_rules(spark):
    f = lambda t: spark.createDataFrame([(t,)], "t string").select(R.compound_queries(F.col("t"), F.lit("q")).alias("x")).first().x
    assert f("Redis 如何持久化和主从复制") == ["q", "Redis Redis 如何持久化", "Redis 主从复制"]
    assert f("Redis") == ["q"]
    d = spark.createDataFrame([("HashMap 底层", ["HashMap 底层 结构 详解", "HashMap 底层 结构", "ConcurrentHashMap"])], "t string, e array<string>")
    assert d.select(R.select_query(F.col("t"), F.col("e"))).first()[0] == "HashMap 底层 结构"
    plans = spark.createDataFrame([("a", "Redis", "Redis", ["redis a", "Redis A", "redis b"]), ("b", "Redis", "", ["Kafka"])], "plan_id string, topic string, canonical_topic string, queries array<string>")
    good, bad = R.validate_plans(plans)
    assert len(good.first().queries) == 2 and [r.reason for r in bad.collect()] == ["drifted"]


def test_evidence_grades(spark):
    rows = [(1, 1, "HashMap 用数组和链表", 0.9, "8"), (1, 2, "ConcurrentHashMap 用分段锁", 0.95, "8"), (2, 1, "Redis 数据", 0.4, None)]
    ev = spark.createDataFrame(rows, "request_id long, pos int, text string, score double, version string")
    topics = spark.createDataFrame([(1, "HashMap"), (2, "Redis Kafka"), (3, "none")], "request_id long, topic string")
    kept, grades = R.grade_evidence(ev, topics)
    assert [r.text[:7] for r in kept.where("request_id = 1").collect()] == ["HashMap"]
    g = {r.request_id: r for r in grades.collect()}
    assert g[2].coverage == 0.5 and g[1].coverage == 1 and g[1].confidence == pytest.approx(0.93) and g[3].n_kept == 0 and g[3].confidence == 0


def test_rank_metrics(spark):
    hits = spark.createDataFrame([("q", f"p{i}", i + 1) for i in range(3)], "query_id string, chunk_id string, rank int")
    qrels = spark.createDataFrame([("q", "p1", 2), ("q", "p2", 1)], "query_id string, chunk_id string, gain int")
    m = E.rank_metrics(hits, qrels).first()
    assert (m.hit, m.mrr) == (1, 0.5) and m.ndcg == pytest.approx(0.6590018, abs=1e-6)
    same = spark.createDataFrame([("q", "p1", i + 1) for i in range(5)], "query_id string, chunk_id string, rank int")
    assert E.rank_metrics(same, qrels.where("gain = 2")).first().ndcg == 1


def test_gates_and_comparison(spark):
    m = spark.createDataFrame([("hit_at_5", 0.8)], "metric string, value double")
    failed, result = E.enforce_gates(m, {"hit_at_5": ("min", 0.85), "gone": ("max", 1.0)})
    assert {r.metric: r.actual for r in failed.collect()} == {"hit_at_5": "0.8", "gone": "unavailable"} and not result.first().passed
    with pytest.raises(ValueError):
        E.enforce_gates(m, override_reason="because")
    assert E.enforce_gates(m, override_reason="because", override_by="me")[1].first().passed
    a = spark.createDataFrame([("hit", 0.9), ("p95_latency_ms", 20.0)], "metric string, value double")
    b = spark.createDataFrame([("hit", 0.8), ("p95_latency_ms", 40.0)], "metric string, value double")
    h = spark.createDataFrame([("q", "x", 1)], "query_id string, chunk_id string, rank int")
    deltas, drift = E.compare_runs(a, b, h, h)
    assert all(r.regression for r in deltas.collect()) and drift.count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([("k", "t", {"Authorization": "x", "a": "b"})], "api_key string, topic string, m map<string,string>")
    r = C.redact(df).first()
    assert (r.api_key, r.topic, r.m) == ("[REDACTED]", "t", {"Authorization": "[REDACTED]", "a": "b"})


def test_scores(spark):
    a = spark.createDataFrame([(1, 1, 1, ["A", "B"], ["B", "A"], "p"), (1, 1, 2, ["A"], ["A", "B"], "q")], "quiz_id long, user_id long, question_no int, selected array<string>, answer array<string>, knowledge_point string")
    r = P.score(a).first()
    assert (r.score, r.total, r.accuracy, r.mastered, r.review) == (1, 2, 50.0, ["p"], ["q"])


def test_file_types(spark):
    rows = [("a.pdf", "application/pdf", b"%PDF-1.4"), ("a.pdf", "text/plain", b"%PDF-1.4"), ("b.png", None, b"xx"), ("c.exe", None, b"MZ"), ("d.docx", None, b"{\\rtf1"), ("e.docx", None, b"PK\x03\x04"), ("f.txt", "text/plain", b"hello")]
    got = [tuple(r)[1:] for r in S.detect_file_types(spark.createDataFrame(rows, "path string, mime string, content binary")).collect()]
    assert got == [("pdf", None), (None, "mime_mismatch"), (None, "magic_mismatch"), (None, "extension_not_allowed"), ("doc", None), (None, "not_an_office_file"), ("text", None)]


def test_stages_and_markdown(spark, tmp_path):
    df = spark.createDataFrame([("b1", "d1", 1), ("b2", "d2", 2)], "batch_id string, document_id string, n int")
    S.write_stage(df, str(tmp_path), "parse")
    S.write_stage(df.where("batch_id = 'b1'").withColumn("n", F.lit(9)), str(tmp_path), "parse")
    assert S.read_stage(spark, str(tmp_path), "parse", "b1").first().n == 9 and S.read_stage(spark, str(tmp_path), "parse", "b2").first().n == 2
    (tmp_path / "x.md").write_text("# T\n\n\n\nx")
    assert S.read_markdown(spark, f"{tmp_path}/*.md").first().text == "# T\n\nx"
