"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import evaluation as E
from corpusloom.operators import retrieval as R
from corpusloom.plans.registry import query
from corpusloom.plans.retrieval_queries import _OVERLAP, QRELS, UNITS, VECTORS, _bm25_sql, _dense_sql, bench_queries, bm25_hits, channels, dense_hits, qrels
from corpusloom.plans.views import SOURCE_DOCS, docs_of, source_docs, table

_RANK = """best AS (SELECT query_id, chunk_id, min(rank) AS rank, max(gain) AS gain FROM {hits} JOIN qrels USING (query_id, chunk_id) WHERE rank <= 5 AND gain > 0 GROUP BY ALL),
got AS (SELECT query_id, min(rank) AS first, sum((2 ** gain - 1) / log2(rank + 1)) AS dcg FROM best GROUP BY query_id),
ideal AS (SELECT query_id, sum((2 ** gain - 1) / log2(place + 1)) AS idcg FROM (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS place FROM qrels) WHERE place <= 5 GROUP BY query_id),
per AS (SELECT query_id, CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END AS hit, coalesce(1 / first, 0) AS mrr, coalesce(dcg, 0) / idcg AS ndcg FROM ideal LEFT JOIN got USING (query_id))"""
_R = "CAST(round({0}, 6) AS DOUBLE) AS {0}"
_BM = f"{UNITS}, {_bm25_sql('units', 50)}, {_OVERLAP}, {QRELS}"


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("rank_metrics_e3", f"WITH {_BM}, {_RANK.format(hits='bm25')} SELECT query_id, {_R.format('hit')}, {_R.format('mrr')}, {_R.format('ndcg')} FROM per")
def rank_metrics_e3(spark, sf_dir):
    return _rounded(E.rank_metrics(bm25_hits(spark, sf_dir), qrels(spark, sf_dir)), "hit", "mrr", "ndcg")


@query("dense_metrics_e3", f"""WITH {VECTORS}, {_dense_sql(6)}, qrels AS (SELECT a.chunk_id AS query_id, b.chunk_id, 1 AS gain FROM vectors a JOIN vectors b ON a.label = b.label AND a.chunk_id <> b.chunk_id WHERE a.chunk_id % 100 = 0),
{_RANK.format(hits='dense')} SELECT query_id, {_R.format('hit')}, {_R.format('mrr')}, {_R.format('ndcg')} FROM per""")
def dense_metrics_e3(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    a = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    good = a.join(v.select(F.col("vec_id").alias("chunk_id"), "label"), "label").where("query_id <> chunk_id").select("query_id", "chunk_id", F.lit(1).alias("gain"))
    return _rounded(E.rank_metrics(dense_hits(spark, sf_dir, 6), good), "hit", "mrr", "ndcg")


def _run(spark, sf_dir, hits=None):
    hits, docs = docs_of(spark, sf_dir, (bm25_hits(spark, sf_dir) if hits is None else hits).where("rank <= 5"))
    docs = docs.select(
        F.col("doc_id").alias("chunk_id"), F.sha2("text", 256).alias("content_hash"), F.col("source_name").alias("parent_id"), "role_tags", "source_name", "text",
        (F.col("license_status") == "approved").alias("parent_recovered"), F.col("technology").alias("parent_type"),
    )
    return hits.join(docs, "chunk_id")


_RUN = f"{_BM}, {SOURCE_DOCS}, run AS (SELECT query_id, rank, d.* FROM bm25 JOIN source_docs d ON d.doc_id = chunk_id WHERE rank <= 5)"


@query("hit_quality_e4", f"""WITH {_RUN}, x AS (SELECT *, count(*) OVER (PARTITION BY query_id, text ORDER BY rank) > 1 OR count(*) OVER (PARTITION BY query_id, source_name ORDER BY rank) > 1 AS dup FROM run)
SELECT CAST(avg(dup::INT) AS DOUBLE) AS duplicate_result_rate, CAST(avg((NOT list_contains(role_tags, 'en') AND NOT list_contains(role_tags, 'general'))::INT) AS DOUBLE) AS role_contamination_rate,
CAST(avg((source_name IS NOT NULL)::INT) AS DOUBLE) AS source_traceability_rate, CAST(avg((license_status = 'approved')::INT) AS DOUBLE) AS parent_recovery_rate FROM x""")
def hit_quality_e4(spark, sf_dir):
    return E.hit_quality(_run(spark, sf_dir), bench_queries(spark, sf_dir).withColumn("role", F.lit("en")))


@query("context_metrics_e5", rf"""WITH {_RUN}, t AS (SELECT query_id, list_distinct(regexp_extract_all(lower(run.text), '[a-z0-9][a-z0-9_+#.\-]+')) AS have, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9][a-z0-9_+#.\-]+')) AS want
    FROM run JOIN benchmark b ON b.item_id = query_id), o AS (SELECT *, list_intersect(want, have) AS met, len(list_intersect(want, have)) / greatest(len(want), 1) >= 0.12 AS ok FROM t)
SELECT query_id, avg(ok::INT) AS context_precision, len(list_distinct(flatten(list(CASE WHEN ok THEN met ELSE [] END)))) / max(len(want)) AS context_recall FROM o GROUP BY query_id""")
def context_metrics_e5(spark, sf_dir):
    hits = _run(spark, sf_dir).select("query_id", F.col("chunk_id").cast("string").alias("identity"), "text")
    q = bench_queries(spark, sf_dir).select("query_id", F.array("query").alias("reference_contexts"), F.array().cast("array<string>").alias("reference_context_ids"))
    return E.context_metrics(hits, q)


@query("answer_integrity_e6", f"""WITH {_RUN} SELECT query_id, bool_and(length(trim(text)) >= 20 AND license_status = 'approved') AS intact FROM run GROUP BY query_id""")
def answer_integrity_e6(spark, sf_dir):
    return E.answer_integrity(_run(spark, sf_dir)).groupBy("query_id").agg(F.bool_and("intact").alias("intact"))


def _latencies(spark, sf_dir):
    return bench_queries(spark, sf_dir).select("query_id", (F.length("query") * 1.5).alias("latency_ms"))


_METRICS = """lat AS (SELECT quantile_disc(length(text) * 1.5, 0.5) AS p50, quantile_disc(length(text) * 1.5, 0.95) AS p95 FROM benchmark),
m AS (SELECT avg(hit) AS h, avg(mrr) AS r, avg(ndcg) AS n FROM per),
metrics AS (SELECT unnest(['hit_at_5', 'mrr_at_5', 'ndcg_at_5', 'knowledge_coverage_rate', 'p50_latency_ms', 'p95_latency_ms']) AS metric, unnest([h, r, n, h, p50, p95]) AS value FROM m, lat)"""


@query("evaluate_run_e8", f"WITH {_BM}, {_RANK.format(hits='bm25')}, {_METRICS} SELECT metric, CAST(round(value, 6) AS DOUBLE) AS value FROM metrics")
def evaluate_run_e8(spark, sf_dir):
    return _rounded(E.evaluate(bm25_hits(spark, sf_dir), qrels(spark, sf_dir), _latencies(spark, sf_dir))[1], "value")


@query("gate_e9", f"""WITH {_BM}, {_RANK.format(hits='bm25')}, {_METRICS}, gates AS (SELECT * FROM (VALUES ('hit_at_5', 'min', 0.85), ('mrr_at_5', 'min', 0.7), ('ndcg_at_5', 'min', 0.75),
    ('role_contamination_rate', 'max', 0.05), ('duplicate_result_rate', 'max', 0.1), ('parent_recovery_rate', 'min', 1.0), ('source_traceability_rate', 'min', 1.0), ('answer_integrity_rate', 'min', 1.0)) g(metric, operator, expected))
SELECT metric, value IS NULL AS unavailable, CAST(expected AS DOUBLE) AS expected, operator FROM gates LEFT JOIN metrics USING (metric)
WHERE value IS NULL OR CASE operator WHEN 'min' THEN value < expected ELSE value > expected END""")
def gate_e9(spark, sf_dir):
    metrics = E.evaluate(bm25_hits(spark, sf_dir), qrels(spark, sf_dir), _latencies(spark, sf_dir))[1]
    failed, _ = E.enforce_gates(metrics)
    return failed.select("metric", (F.col("actual") == "unavailable").alias("unavailable"), "expected", "operator")


@query("compare_runs_e10", f"""WITH {_BM}, {_RANK.format(hits='bm25')}, {_RANK.format(hits='over').replace('best AS', 'best2 AS').replace('FROM best', 'FROM best2').replace('got AS', 'got2 AS').replace('JOIN got', 'JOIN got2').replace('ideal AS', 'ideal2 AS').replace('FROM ideal', 'FROM ideal2').replace('per AS', 'per2 AS')},
a AS (SELECT unnest(['hit_at_5', 'mrr_at_5', 'ndcg_at_5', 'knowledge_coverage_rate', 'p50_latency_ms', 'p95_latency_ms']) AS metric, unnest([h, r, n, h, 0, 0]) AS v FROM (SELECT avg(hit) AS h, avg(mrr) AS r, avg(ndcg) AS n FROM per)),
b AS (SELECT unnest(['hit_at_5', 'mrr_at_5', 'ndcg_at_5', 'knowledge_coverage_rate', 'p50_latency_ms', 'p95_latency_ms']) AS metric, unnest([h, r, n, h, 0, 0]) AS v FROM (SELECT avg(hit) AS h, avg(mrr) AS r, avg(ndcg) AS n FROM per2))
SELECT metric, CAST(round(b.v - a.v, 6) AS DOUBLE) AS delta, CASE WHEN contains(metric, 'latency') THEN b.v - a.v > 0 ELSE a.v - b.v > 0.01 END AS regression FROM a JOIN b USING (metric)""")
def compare_runs_e10(spark, sf_dir):
    first, second = channels(spark, sf_dir)
    good, lat = qrels(spark, sf_dir), _latencies(spark, sf_dir)
    a, b = E.evaluate(first, good, lat)[1], E.evaluate(second, good, lat)[1]
    return _rounded(E.compare_runs(a, b, first, second, {"quality": 0.01})[0], "delta")


def traces(spark, sf_dir):
    """Conversations as agent traces: the turn's roles as tools, text lengths as tokens and latencies."""
    c = table(spark, sf_dir, "conversations")
    tool = F.when(F.col("role") == "user", "public_milvus_search").when(F.col("role") == "assistant", "tavily_search").otherwise("shell")
    t = c.groupBy(F.col("conv_id").alias("sample_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", tool.alias("tool")))), lambda x: x["tool"]).alias("tools"),
        F.sum(F.length("text")).cast("double").alias("tokens"), F.max(F.length("text")).cast("double").alias("total_latency_ms"),
        F.max_by("role", "turn").alias("last"), F.count(F.lit(1)).alias("n"),
    )
    i = F.col("sample_id")
    none = F.array().cast("array<string>")
    return t.withColumns({
        "route": F.when(i % 2 == 0, "public_kb").otherwise("web_search"), "expected_route": F.when(i % 3 == 0, "public_milvus_search").otherwise(""),
        "expected_tools": F.array(F.lit("tavily_search")), "retry_count": (i % 5).cast("int"), "completed": F.col("last") == "assistant", "answer": F.when(F.col("last") == "assistant", "yes").otherwise(""),
        "policy_findings": F.when(i % 13 == 0, F.array(F.lit("private_scope_leak"))).otherwise(none), "cost": F.when(i % 4 != 0, F.col("tokens") / 1000), "private": i % 6 == 0,
    })


_TRACES = """t AS (SELECT conv_id AS i, list(CASE role WHEN 'user' THEN 'public_milvus_search' WHEN 'assistant' THEN 'tavily_search' ELSE 'shell' END ORDER BY turn) AS tools, sum(length(text))::DOUBLE AS tokens,
    max(length(text))::DOUBLE AS lat, arg_max(role, turn) = 'assistant' AS completed FROM conversations GROUP BY conv_id),
s AS (SELECT *, i % 3 <> 0 OR i % 2 = 0 AS route_correct, list_contains(tools, 'tavily_search') AS tools_present, len(tools) <= 8 AND i % 5 <= 3 AS within_budget, i % 13 <> 0 AS risk_passed FROM t)"""


@query("score_traces_e11", f"WITH {_TRACES} SELECT i AS sample_id, route_correct, tools_present, within_budget, risk_passed, completed AND route_correct AND tools_present AND within_budget AND risk_passed AS passed FROM s")
def score_traces_e11(spark, sf_dir):
    return E.score_traces(traces(spark, sf_dir)).select("sample_id", "route_correct", "tools_present", "within_budget", "risk_passed", "passed")


@query("trace_risks_e12", f"""WITH {_TRACES} SELECT i AS sample_id, list_sort(list_distinct(list_concat(CASE WHEN i % 13 = 0 THEN ['private_scope_leak'] ELSE [] END, CASE WHEN list_contains(tools, 'shell') THEN ['forbidden_tool:shell'] ELSE [] END,
    CASE WHEN i % 6 = 0 THEN list_transform(list_filter(tools, lambda x: x <> 'shell'), lambda x: 'private_scope_violation:' || x) ELSE [] END))) AS findings FROM s""")
def trace_risks_e12(spark, sf_dir):
    return E.trace_risks(traces(spark, sf_dir)).select("sample_id", "findings")


@query("agent_aggregates_e13", f"""WITH {_TRACES} SELECT avg(completed::INT) AS completion_rate, avg(completed::INT) AS answer_rate, avg((route_correct AND tools_present)::INT) AS process_rate, avg(within_budget::INT) AS budget_rate,
avg((NOT risk_passed)::INT) AS risk_rate, quantile_disc(lat, 0.5) AS p50_latency_ms, quantile_disc(lat, 0.95) AS p95_latency_ms, avg(tokens) AS mean_tokens, avg(len(tools)) AS mean_tools, CAST(sum(i % 5) AS BIGINT) AS retries,
avg(CASE WHEN i % 4 <> 0 THEN tokens / 1000 END) AS mean_cost, avg((i % 4 <> 0)::INT) AS cost_observed_rate, avg((i % 13 = 0)::INT) AS private_violation_rate, avg((completed AND i % 13 = 0)::INT) AS high_risk_false_allow_rate FROM s""")
def agent_aggregates_e13(spark, sf_dir):
    return E.aggregate_traces(E.score_traces(traces(spark, sf_dir)))


def quizzes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    q = c.select(
        F.col("conv_id").alias("sample_id"), F.col("turn").alias("pos"), F.col("text").alias("stem"), F.lit("").alias("explanation"),
        F.when(F.col("role") == "user", "single").otherwise("multiple").alias("type"), F.array(F.lit("A"), F.lit("B")).alias("option_keys"),
        F.when(F.col("turn") % 3 == 0, F.array(F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("B"))).alias("answer"), F.lit("hard").alias("difficulty"),
    )
    s = c.groupBy(F.col("conv_id").alias("sample_id")).agg(F.array(F.min_by("text", "turn")).alias("expected_points"), F.max_by("text", "turn").alias("evidence_text"))
    return q, s.withColumn("expected_difficulty", F.lit("Hard"))


_T = r"list_distinct(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9_+#.\\-]+'))"
_QUIZ = f"""qc AS (SELECT *, regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS low FROM conversations WHERE role <> 'system'),
qs AS (SELECT conv_id AS sample_id, count(*) AS n, count(DISTINCT nullif(low, '')) AS u, count(nullif(low, '')) AS t, count(CASE WHEN (role = 'user') = (turn % 3 <> 0) THEN 1 END) AS bad,
    {_T.format("string_agg(text, ' ')")} AS have, {_T.format("arg_min(text, turn)")} AS want, arg_max(text, turn) AS proof FROM qc GROUP BY conv_id),
qx AS (SELECT *, len(list_intersect(want, have)) / greatest(len(want), 1) AS cover, proof = '' OR list_has_any({_T.format("proof")}, have) AS backed FROM qs),
quiz AS (SELECT sample_id, 'quiz' AS kind, unnest(['quiz.non_empty', 'quiz.no_duplicate_questions', 'quiz.valid_question_structure', 'quiz.knowledge_point_coverage', 'quiz.difficulty_matches', 'quiz.evidence_supported']) AS rule,
    unnest([true, t = u, bad = 0, len(want) = 0 OR cover >= 0.5, true, backed]) AS passed, unnest([1.0, (t = u)::DOUBLE, (bad = 0)::DOUBLE, cover, 1.0, backed::DOUBLE]) AS score FROM qx)"""
_REPORT = f"""rc AS (SELECT conv_id AS sample_id, arg_max(text, turn) AS summary, arg_min(text, turn) AS topic, coalesce(string_agg(text, ' ') FILTER (role = 'assistant'), '') AS weak, count(CASE WHEN role = 'assistant' THEN 1 END) AS n_weak
    FROM conversations WHERE role <> 'system' GROUP BY conv_id),
rt AS (SELECT *, {_T.format("topic")} AS want, {_T.format("concat_ws(' ', summary, weak, CASE WHEN sample_id % 2 = 0 THEN topic ELSE '' END)")} AS body FROM rc),
rx AS (SELECT *, len(list_intersect(want, body)) / greatest(len(want), 1) AS cover, list_has_any(want, body) AS hit FROM rt),
report AS (SELECT sample_id, 'report' AS kind, unnest(['report.has_summary', 'report.has_weakness', 'report.has_recommendation', 'report.covers_knowledge_points', 'report.topic_relevant', 'report.evidence_supported']) AS rule,
    unnest([trim(summary) <> '', n_weak > 0, sample_id % 2 = 0, len(want) = 0 OR cover >= 0.3, topic = '' OR hit, topic = '' OR hit]) AS passed,
    unnest([(trim(summary) <> '')::DOUBLE, (n_weak > 0)::DOUBLE, (sample_id % 2 = 0)::DOUBLE, cover, (topic = '' OR hit)::DOUBLE, (topic <> '' AND hit)::DOUBLE]) AS score FROM rx)"""


@query("quiz_rules_e14", f"WITH {_QUIZ} SELECT * FROM quiz")
def quiz_rules_e14(spark, sf_dir):
    return E.quiz_rules(*quizzes(spark, sf_dir))


def reports(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    r = c.groupBy(F.col("conv_id").alias("sample_id")).agg(
        F.max_by("text", "turn").alias("summary"), F.array(F.min_by("text", "turn")).alias("expected_points"), F.min_by("text", "turn").alias("topic"),
        F.filter(F.collect_list(F.when(F.col("role") == "assistant", F.col("text"))), lambda x: x.isNotNull()).alias("weaknesses"),
    )
    return r.withColumn("recommendations", F.when(F.col("sample_id") % 2 == 0, F.array("topic")).otherwise(F.array().cast("array<string>"))).withColumn("evidence_text", F.col("topic"))


@query("report_rules_e15", f"WITH {_REPORT} SELECT * FROM report")
def report_rules_e15(spark, sf_dir):
    return E.report_rules(reports(spark, sf_dir))


@query("rule_aggregates_e16", f"""WITH {_QUIZ}, {_REPORT}, per AS (SELECT kind, sample_id, min(passed::INT) AS ok, avg(score) AS score, max((rule LIKE '%no_duplicate_questions' AND NOT passed)::INT) AS dup FROM (SELECT * FROM quiz UNION ALL SELECT * FROM report) GROUP BY ALL)
SELECT kind, avg(ok) AS valid_rate, CAST(round(avg(score), 6) AS DOUBLE) AS mean_score, avg(dup) AS duplicate_rate FROM per GROUP BY kind""")
def rule_aggregates_e16(spark, sf_dir):
    return _rounded(E.aggregate_rules(E.quiz_rules(*quizzes(spark, sf_dir)).unionByName(E.report_rules(reports(spark, sf_dir)))), "mean_score")


def judge(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    samples = l.select(F.concat(F.lit("s"), i).alias("sample_id"), F.concat(F.lit("in"), i).alias("user_input"), F.concat(F.lit("sc"), i % 4).alias("scenario_type"))
    score = lambda n: (i % n / n).cast("double")
    scores = l.where(i % 9 != 0).select(
        F.when(i % 2 == 0, F.concat(F.lit("s"), i)).alias("sample_id"), F.concat(F.lit("in"), i).alias("user_input"), score(7).alias("context_precision"),
        score(11).alias("context_recall"), F.when(i % 5 != 0, score(13)).alias("faithfulness"), score(17).alias("answer_relevancy"),
    )
    return samples, scores


_JUDGE = """s AS (SELECT concat('s', doc_id) AS sample_id, concat('sc', doc_id % 4) AS scenario_type, CASE WHEN doc_id % 9 <> 0 THEN (doc_id % 7) / 7 END AS context_precision, CASE WHEN doc_id % 9 <> 0 THEN (doc_id % 11) / 11 END AS context_recall,
    CASE WHEN doc_id % 9 <> 0 AND doc_id % 5 <> 0 THEN (doc_id % 13) / 13 END AS faithfulness, CASE WHEN doc_id % 9 <> 0 THEN (doc_id % 17) / 17 END AS answer_relevancy FROM labels)"""


@query("judge_scores_e17", f"""WITH {_JUDGE} SELECT scenario_type, avg(context_precision) AS context_precision, avg(context_recall) AS context_recall, avg(faithfulness) AS faithfulness, avg(answer_relevancy) AS answer_relevancy,
count(*) AS n, min((faithfulness IS NOT NULL)::INT) AS complete FROM s GROUP BY ROLLUP (scenario_type)""")
def judge_scores_e17(spark, sf_dir):
    return E.aggregate_scores(*judge(spark, sf_dir))[1]


@query("missing_responses_e18", "SELECT concat(conv_id, '-', turn) AS sample_id, 'failed' AS status, 'generation_response_missing' AS error FROM conversations WHERE role <> 'assistant'")
def missing_responses_e18(spark, sf_dir):
    obs = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("sample_id"), F.when(F.col("role") == "assistant", F.col("text")).otherwise("  ").alias("response"))
    return E.split_missing_responses(obs)[1]


@query("pending_batches_e19", """WITH b AS (SELECT query_id, (row_number() OVER (ORDER BY query_id) - 1) // 10 AS batch FROM (SELECT item_id AS query_id FROM benchmark)) SELECT CAST(batch AS BIGINT) AS batch FROM b GROUP BY batch HAVING batch % 3 <> 0 OR count(*) <> 10""")
def pending_batches_e19(spark, sf_dir):
    batched = E.batches(bench_queries(spark, sf_dir))
    done = batched.select("batch").distinct().select("batch", F.when(F.col("batch") % 3 == 0, "success").otherwise("failed").alias("status"), F.lit(10).cast("long").alias("n_samples"))
    return E.pending_batches(batched, done)


@query("merge_batches_e19", f"""WITH {_JUDGE} SELECT 'partial' AS status, count(*) AS n_evaluated, count(CASE WHEN faithfulness IS NULL THEN 1 END) AS n_failed, avg(context_precision) AS context_precision, avg(context_recall) AS context_recall,
avg(faithfulness) AS faithfulness, avg(answer_relevancy) AS answer_relevancy FROM s""")
def merge_batches_e19(spark, sf_dir):
    samples, _ = E.aggregate_scores(*judge(spark, sf_dir))
    return E.merge_batches(samples, table(spark, sf_dir, "labels").count())


_MODES = f"""fused AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, sum(1 / (60 + rank)) AS score FROM (SELECT query_id, chunk_id, rank FROM bm25 UNION ALL SELECT query_id, chunk_id, rank FROM over) GROUP BY ALL) QUALIFY rank <= 50),
mh AS (SELECT 'bm25' AS mode, query_id, chunk_id, rank FROM bm25 UNION ALL SELECT 'overlap', query_id, chunk_id, rank FROM over UNION ALL SELECT 'rrf', query_id, chunk_id, rank FROM fused),
mb AS (SELECT mode, query_id, chunk_id, min(rank) AS rank, max(gain) AS gain FROM mh JOIN qrels USING (query_id, chunk_id) WHERE rank <= 5 AND gain > 0 GROUP BY ALL),
mg AS (SELECT mode, query_id, count(*) AS f, min(rank) AS first, sum((2 ** gain - 1) / log2(rank + 1)) AS dcg FROM mb GROUP BY ALL),
mi AS (SELECT query_id, count(*) FILTER (gain > 0) AS n, sum((2 ** gain - 1) / log2(place + 1)) FILTER (place <= 5) AS idcg FROM (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS place FROM qrels) GROUP BY query_id),
mp AS (SELECT m.mode, (first IS NOT NULL)::INT AS hit, coalesce(1 / first, 0) AS mrr, least(1, coalesce(dcg, 0) / idcg) AS ndcg, coalesce(f, 0) / n AS recall FROM (SELECT DISTINCT mode FROM mh) m CROSS JOIN mi LEFT JOIN mg ON mg.mode = m.mode AND mg.query_id = mi.query_id)"""


@query("mode_benchmark_e20", f"""WITH {_BM}, {_MODES} SELECT mode, {", ".join(f"CAST(round(avg({c}), 6) AS DOUBLE) AS {c}" for c in ("hit", "mrr", "ndcg", "recall"))}, (SELECT count(*) FROM mh WHERE mh.mode = mp.mode) AS candidates FROM mp GROUP BY mode""")
def mode_benchmark_e20(spark, sf_dir):
    a, b = channels(spark, sf_dir)
    fused = R.top_k(R.rrf(a, b), 50)
    modes = [df.select("query_id", "chunk_id", "rank", F.lit(m).alias("mode")) for m, df in (("bm25", a), ("overlap", b), ("rrf", fused))]
    return _rounded(E.mode_benchmark(modes[0].unionByName(modes[1]).unionByName(modes[2]), qrels(spark, sf_dir)), "hit", "mrr", "ndcg", "recall")


@query("golden_violations_e1", """SELECT NULL AS query_id, 'size' AS violation FROM benchmark HAVING count(*) <> 100
UNION ALL SELECT item_id::VARCHAR, 'missing_reference_answer' FROM benchmark WHERE item_id % 2 = 1 UNION ALL SELECT item_id::VARCHAR, 'reference_length_mismatch' FROM benchmark WHERE item_id % 3 = 0""")
def golden_violations_e1(spark, sf_dir):
    i = F.col("query_id")
    ids = F.when(i % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    q = bench_queries(spark, sf_dir).select(i, F.when(i % 2 == 0, F.col("query")).otherwise("").alias("reference_answer"), ids.alias("reference_context_ids"), F.array("query").alias("reference_contexts"), F.lit("public_kb").alias("expected_route"), F.array(F.lit("t")).alias("expected_tools"))
    return E.golden_violations(q)


@query("enrich_benchmark_e2", """SELECT item_id AS query_id, concat('t：', text, ' p1 p2') AS reference_answer, [concat('d', item_id)] AS reference_context_ids, [concat(text, ' p1 p2')] AS reference_contexts,
CASE WHEN item_id % 2 = 0 THEN 'web' ELSE 'public_milvus_search' END AS expected_route FROM benchmark""")
def enrich_benchmark_e2(spark, sf_dir):
    i = F.col("query_id")
    none = F.array().cast("array<string>")
    q = bench_queries(spark, sf_dir).withColumns({
        "topic": F.lit("t"), "expected_knowledge_points": F.array(F.lit("p1"), F.lit("p2")), "relevance": F.create_map(F.concat(F.lit("d"), i), F.lit(2)),
        "reference_answer": F.lit(""), "reference_context_ids": none, "reference_contexts": none, "expected_route": F.when(i % 2 == 0, "web"), "expected_tools": none,
    })
    return E.enrich_benchmark(q).select("query_id", "reference_answer", "reference_context_ids", "reference_contexts", "expected_route")


def parents(spark, sf_dir):
    return source_docs(spark, sf_dir).select(F.col("document_id").alias("parent_id"), "document_id", "technology", F.when(F.col("license_status") == "approved", "qa").otherwise("paragraph").alias("parent_type"), "text")


@query("golden_select_e21", f"""WITH {SOURCE_DOCS}, p AS (SELECT document_id AS parent_id, technology, CASE license_status WHEN 'approved' THEN 'qa' ELSE 'paragraph' END AS parent_type FROM source_docs),
r AS (SELECT *, row_number() OVER (PARTITION BY technology ORDER BY parent_type <> 'qa', parent_id) AS n FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY n > 5, CASE WHEN n <= 5 THEN technology ELSE '' END, CASE WHEN n <= 5 THEN n ELSE (parent_type <> 'qa')::INT END, parent_id) AS pos FROM r)
SELECT printf('g-%03d', pos) AS query_id, parent_id, technology, parent_type FROM o WHERE pos <= 100""")
def golden_select_e21(spark, sf_dir):
    return E.build_golden(parents(spark, sf_dir))


@query("bind_queries_e22", f"""WITH {SOURCE_DOCS}, l AS (SELECT doc_id, document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM source_docs),
p AS (SELECT document_id, printf('%s:%05d', document_id, n) AS parent_id, line FROM l),
q AS (SELECT doc_id AS query_id, concat('d', doc_id) AS document_id, list_filter(string_split(regexp_replace(regexp_replace(lower(text), '\\s+', ' ', 'g'), '^ | $', '', 'g'), ' '), lambda w: length(w) > 2) AS words FROM documents),
j AS (SELECT query_id, parent_id, len(list_filter(words, lambda w: contains(lower(line), w))) = 0 AS miss FROM q JOIN p USING (document_id))
SELECT query_id, parent_id FROM j QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY miss, parent_id) = 1""")
def bind_queries_e22(spark, sf_dir):
    docs = source_docs(spark, sf_dir)
    p = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("n", "text")).withColumn("parent_id", F.format_string("%s:%05d", "document_id", F.col("n") + 1))
    q = docs.select(F.col("doc_id").alias("query_id"), "document_id", F.col("text").alias("query"))
    return E.bind_queries(q, p.select("document_id", "parent_id", "text"))[0]


@query("atomic_answers_e23")
def atomic_answers_e23(spark, sf_dir):
    p = parents(spark, sf_dir).withColumn("question", F.concat(F.lit("t: "), F.substring_index("text", "\n", 1)))
    return E.atomic_answers(p)


@query("full_evaluation_e24")
def full_evaluation_e24(spark, sf_dir):
    """Retrieval, quiz, report, agent and judge metrics as one table of named values."""
    hits = bm25_hits(spark, sf_dir)
    retrieval = E.evaluate(hits, qrels(spark, sf_dir), _latencies(spark, sf_dir))[1]
    quality = E.as_metrics(E.hit_quality(_run(spark, sf_dir, hits), bench_queries(spark, sf_dir).withColumn("role", F.lit("en"))))
    agent = E.as_metrics(E.aggregate_traces(E.score_traces(traces(spark, sf_dir)))).withColumn("metric", F.concat(F.lit("agent."), "metric"))
    rules = E.aggregate_rules(E.quiz_rules(*quizzes(spark, sf_dir)).unionByName(E.report_rules(reports(spark, sf_dir))))
    rules = rules.select(F.concat("kind", F.lit("."), F.lit("valid_rate")).alias("metric"), F.col("valid_rate").alias("value"))
    scores = E.aggregate_scores(*judge(spark, sf_dir))[1].where("scenario_type is null").select(*E.JUDGE_METRICS)
    judged = E.as_metrics(scores).withColumn("metric", F.concat(F.lit("judge."), "metric"))
    return _rounded(retrieval.unionByName(quality).unionByName(agent).unionByName(rules).unionByName(judged), "value")


@query("visual_metrics_e25", """SELECT l_orderkey AS document_id, count(*) AS assets, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS ready, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS degraded, count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS skipped
FROM lineitem GROUP BY l_orderkey""")
def visual_metrics_e25(spark, sf_dir):
    status = F.when(F.col("l_returnflag") == "A", "ready").when(F.col("l_returnflag") == "R", "degraded").otherwise("skipped")
    return E.visual_metrics(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), status.alias("visual_status")))


@query("metric_cuts_e26", """WITH e AS (SELECT event_type AS scenario, concat('r', user_id % 3) AS role, value FROM events)
SELECT 'all' AS cut, 'all' AS value, count(*) AS n, avg(value) AS score FROM e UNION ALL SELECT 'scenario', scenario, count(*), avg(value) FROM e GROUP BY scenario UNION ALL SELECT 'role', role, count(*), avg(value) FROM e GROUP BY role""")
def metric_cuts_e26(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("scenario"), F.concat(F.lit("r"), F.col("user_id") % 3).alias("role"), F.col("value").alias("score"))
    return E.metric_cuts(e, ["scenario", "role"], ["score"])


@query("latency_selection_e7", """
SELECT event_type, unnest([0.5, 0.95, 0.99]) AS share, unnest([quantile_disc(value, 0.5), quantile_disc(value, 0.95), quantile_disc(value, 0.99)]) AS value FROM events GROUP BY event_type""")
def latency_selection_e7(spark, sf_dir):
    """By refined histograms: no task holds more than a bucket."""
    return E.select_ranks(table(spark, sf_dir, "events"), "value", [0.5, 0.95, 0.99], ["event_type"], small=100).drop("held")
