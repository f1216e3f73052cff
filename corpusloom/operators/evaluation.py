"""Evaluation: ranking metrics, hit quality, rule checks, gates, comparison, judge scores, golden sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import nearest_rank, squeeze, strip, tokens_eval
from corpusloom.sources.stages import staged

# Fixed values of the data contract.
GATES = {
    "hit_at_5": ("min", 0.85), "mrr_at_5": ("min", 0.70), "ndcg_at_5": ("min", 0.75), "role_contamination_rate": ("max", 0.05),
    "duplicate_result_rate": ("max", 0.10), "parent_recovery_rate": ("min", 1.0), "source_traceability_rate": ("min", 1.0),
    "answer_integrity_rate": ("min", 1.0),
}
ROUTE_ALIASES = {"public_milvus_search": "public_kb", "personal_milvus_search": "personal_kb", "tavily_search": "web_search", "tavily_extract": "web_extract"}
TRACE_TOOLS = ["public_milvus_search", "personal_milvus_search", "tavily_search", "tavily_extract", "base_model"]
PRIVATE_FORBIDDEN = ["public_milvus_search", "tavily_search", "tavily_extract"]
LOWER_IS_BETTER = ["latency", "duplicate", "contamination", "violation", "risk"]
JUDGE_METRICS = ["context_precision", "context_recall", "faithfulness", "answer_relevancy"]
NEXT_QUESTION = ["是什么", "有什么", "有哪几种", "有哪些", "有几种", "一共有", "如何", "区别", "作用", "原理"]
GOLDEN_FIELDS = ["reference_answer", "reference_context_ids", "reference_contexts", "expected_route", "expected_tools"]


def _log2(c: Column) -> Column:
    return F.log(c) / F.log(F.lit(2.0))


def rank_metrics(hits: DataFrame, qrels: DataFrame, k: int = 5, key: str = "chunk_id") -> DataFrame:
    """Per query of ``qrels`` ``hit, mrr, ndcg`` at ``k``; a relevant identity counts once."""
    ranked = hits.where(F.col("rank") <= k).join(qrels, ["query_id", key])
    first = Window.partitionBy("query_id", key).orderBy("rank")
    ranked = ranked.withColumn("n", F.row_number().over(first)).where("n = 1 and gain > 0")
    worth = lambda at: (F.pow(F.lit(2.0), "gain") - 1) / _log2(at + 1)
    got = ranked.groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(worth(F.col("rank"))).alias("dcg"))
    best = Window.partitionBy("query_id").orderBy(F.desc("gain"))
    ideal = qrels.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    ideal = ideal.groupBy("query_id").agg(F.sum(worth(F.col("place"))).alias("idcg"))
    out = ideal.join(got, "query_id", "left")
    zero = F.lit(0.0)
    return out.select(
        "query_id", F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("hit"), F.coalesce(1 / F.col("first"), zero).alias("mrr"),
        F.when(F.col("idcg") > 0, F.coalesce("dcg", zero) / F.col("idcg")).otherwise(zero).alias("ndcg"),
    )


def hit_quality(hits: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Rates over all ranked hits: duplicates, foreign roles, traceable sources, recovered parents."""
    rows = hits.where(F.col("rank") <= k).join(queries.select("query_id", "role"), "query_id")
    seen = lambda c: F.count(F.lit(1)).over(Window.partitionBy("query_id", c).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    dup = ((F.col("content_hash") != "") & (seen("content_hash") > 0)) | ((F.col("parent_id") != "") & (seen("parent_id") > 0))
    foreign = ~F.arrays_overlap(F.col("role_tags"), F.array(F.col("role"), F.lit("general")))
    rows = rows.select(F.coalesce(dup, F.lit(False)).alias("d"), foreign.alias("f"), F.col("source_name").isNotNull().alias("s"), F.col("parent_recovered").alias("p"))
    rate = lambda c: F.coalesce(F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")), F.lit(0.0))
    return rows.agg(
        rate("d").alias("duplicate_result_rate"), rate("f").alias("role_contamination_rate"),
        rate("s").alias("source_traceability_rate"), rate("p").alias("parent_recovery_rate"),
    )


def context_metrics(hits: DataFrame, queries: DataFrame, overlap: float = 0.12) -> DataFrame:
    """E5: lexical context precision and recall per query. ``queries`` has ``reference_contexts`` and ``reference_context_ids``."""
    q = queries.select("query_id", tokens_eval(F.array_join("reference_contexts", " ")).alias("want"), "reference_context_ids")
    rows = hits.select("query_id", "identity", tokens_eval(F.col("text")).alias("have")).join(q, "query_id")
    share = F.size(F.array_intersect("want", "have")) / F.greatest(F.size("want"), F.lit(1))
    relevant = F.array_contains("reference_context_ids", F.col("identity")) | ((F.size("want") > 0) & (F.size("have") > 0) & (share >= overlap))
    rows = rows.withColumn("ok", F.coalesce(relevant, F.lit(False)))
    covered = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("ok"), F.array_intersect("want", "have")))))
    per = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("ok").cast("int")).alias("r"), F.size(covered).alias("c"))
    out = q.join(per, "query_id", "left").na.fill(0, ["n", "r", "c"])
    recall = F.when(F.size("want") > 0, F.col("c") / F.greatest(F.size("want"), F.lit(1))).otherwise(F.when(F.col("r") > 0, 1.0).otherwise(0.0))
    return out.select("query_id", (F.col("r") / F.greatest("n", F.lit(1))).alias("context_precision"), recall.alias("context_recall"))


def answer_integrity(hits: DataFrame) -> DataFrame:
    """Hits with ``intact``; columns ``text, parent_id, parent_recovered, source_name, parent_type``."""
    text = strip(F.coalesce("text", F.lit("")))
    question = text.rlike(r"[?？]$") | text.rlike("(?:问题|什么|如何|为什么|区别|原理).{0,80}[?？]")
    after = strip(F.regexp_extract(text, r"(?s)[?？](.*)$", 1))
    answered = ((F.col("parent_type") == "qa") & (F.length(after) >= 20)) | text.rlike(r"(?i)(?:答案|解答|解析|答[:：]|Answer)\s*[:：]?\s*\S+")
    fine = (F.length(text) >= 20) & (F.col("parent_id").isNull() | F.coalesce("parent_recovered", F.lit(False))) & F.col("source_name").isNotNull()
    return hits.withColumn("intact", F.coalesce(fine & (~question | F.coalesce(answered, F.lit(False))), F.lit(False)))


def evaluate(hits: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 5, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Per-query metrics and their means for a run with latencies in ``queries.latency_ms``; named by ``k``."""
    per = rank_metrics(hits, qrels, k, key)
    ranks = select_ranks(queries, "latency_ms", [0.5, 0.95])  # a row for each, none without latencies
    at = lambda p: F.coalesce(F.max(F.when(F.col("share") == p, F.col("value"))), F.lit(0.0))
    lat = ranks.agg(at(0.5).alias("p50_latency_ms"), at(0.95).alias("p95_latency_ms"))
    mean = per.agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"{m}_at_{k}") for m in ("hit", "mrr", "ndcg")], F.coalesce(F.avg("hit"), F.lit(0.0)).alias("knowledge_coverage_rate"))
    return per, as_metrics(mean.crossJoin(F.broadcast(lat)))  # one row each


def select_ranks(df: DataFrame, value: str, shares: list[float], groups: list[str] | None = None, small: int = 10_000, buckets: int = 1024) -> DataFrame:
    """The value at rank ``ceil(share * n)`` for each share, ``(*groups, share, value, held)``, without a task that holds a group.

    Each round counts the values between two bounds in ``buckets`` of equal width, combined
    before the shuffle, and goes on in the one that has the rank, between the least and the
    greatest value there. When a bucket has one different value, or ``small`` rows (``held``), which
    are then sorted, the rank is found. The bounds tighten by the factor ``buckets`` a round at
    least. Null and NaN values don't count; a group without others has no row.
    """
    groups = groups or []
    x = F.col(value).cast("double")
    rows = df.select(*groups, x.alias("x")).where(x.isNotNull() & ~F.isnan(x))
    rows = staged(rows, "values")
    each = F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("share")
    todo = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    todo = todo.where("n > 0").select(*groups, "n", "low", "high", each).withColumn("rank", F.greatest(F.ceil(F.col("share") * F.col("n")), F.lit(1)).cast("long"))
    todo = staged(todo, "ranks")
    keys, done = [*groups, "share"], []

    def within(asked: DataFrame) -> DataFrame:
        """The rows between a rank's bounds; the ranks are few beside them, groups may be null."""
        mine = asked.select(*[F.col(g).alias(f"_{g}") for g in groups], "share", "low", "high", "rank")
        same = F.lit(True)
        for g in groups:
            same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
        return rows.join(mine, same & F.col("x").between(F.col("low"), F.col("high"))).drop(*[f"_{g}" for g in groups])

    while True:
        done.append(todo.where("low = high").select(*keys, F.col("low").alias("value"), F.lit(0).cast("long").alias("held")))
        last = within(todo.where(f"low < high and n <= {small}")).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("xs"), F.first("rank").alias("rank"))
        done.append(last.select(*keys, F.element_at("xs", F.col("rank").cast("int")).alias("value"), F.size("xs").cast("long").alias("held")))
        wide = todo.where(f"low < high and n > {small}")
        if wide.isEmpty():
            break
        place = F.floor((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * buckets)  # halves can't overflow
        counts = within(wide).groupBy(*keys, place.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.first("rank").alias("rank"))
        before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` + 1 rows
        counts = counts.withColumn("rank", F.col("rank") - F.coalesce(F.sum("n").over(before), F.lit(0)))
        todo = staged(counts.where("rank between 1 and n").select(*groups, "n", "low", "high", "share", "rank"), "ranks")
    return reduce(DataFrame.unionByName, done)


def as_metrics(row: DataFrame) -> DataFrame:
    """A one-row table of measures as ``(metric, value)``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns])
    return row.select(F.explode(pairs).alias("m")).select("m.*")


def enforce_gates(metrics: DataFrame, gates: dict[str, tuple[str, float]] = GATES, full: bool = True, override_reason: str | None = None, override_by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(failed(metric, actual, expected, operator), result)``; a missing metric fails (``full``) or counts 0. An override needs reason and name."""
    if override_reason is not None and not (override_reason.strip() and (override_by or "").strip()):
        raise ValueError("an override needs a reason and a name")
    spark = metrics.sparkSession
    rules = spark.createDataFrame([(m, op, float(v)) for m, (op, v) in gates.items()], "metric string, operator string, expected double")
    rows = rules.join(metrics, "metric", "left")
    actual = F.col("value") if full else F.coalesce("value", F.lit(0.0))
    bad = actual.isNull() | F.when(F.col("operator") == "min", actual < F.col("expected")).otherwise(actual > F.col("expected"))
    failed = rows.where(bad).select("metric", F.coalesce(actual.cast("string"), F.lit("unavailable")).alias("actual"), "expected", "operator")
    n = failed.agg(F.count(F.lit(1)).alias("n_failed"))
    return failed, n.select(((F.col("n_failed") == 0) | F.lit(override_reason is not None)).alias("passed"), "n_failed", F.lit(override_reason).alias("override_reason"))


def compare_runs(a: DataFrame, b: DataFrame, hits_a: DataFrame, hits_b: DataFrame, thresholds: dict[str, float] | None = None, key: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Metric deltas of run b over a with regressions, and the queries whose ordered results changed."""
    t = thresholds or {}
    zero = F.lit(0.0)
    both = a.withColumnRenamed("value", "va").join(b.withColumnRenamed("value", "vb"), "metric", "full")
    lower = reduce(lambda x, y: x | y, [F.contains("metric", F.lit(w)) for w in LOWER_IS_BETTER])
    delta = F.coalesce("vb", zero) - F.coalesce("va", zero)
    own = F.coalesce(*[F.when(F.col("metric") == m, v) for m, v in t.items()], F.when(F.contains("metric", F.lit("latency")), t.get("latency_ms", 0.0)), F.when(lower, t.get("risk_rate", 0.0)).otherwise(t.get("quality", 0.0)))
    deltas = both.select("metric", delta.alias("delta"), F.when(lower, delta > own).otherwise(-delta > own).alias("regression"))
    ids = lambda h: F.transform(F.array_sort(F.collect_list(F.struct("rank", key))), lambda x: x[key])
    drift = hits_a.groupBy("query_id").agg(ids(hits_a).alias("x")).join(hits_b.groupBy("query_id").agg(ids(hits_b).alias("y")), "query_id")
    return deltas, drift.where("x <> y").select("query_id")


def score_traces(traces: DataFrame) -> DataFrame:
    """``route, tools, expected_route, expected_tools, retry_count, policy_findings, completed`` -> verdict columns."""
    want = F.coalesce(*[F.when(F.col("expected_route") == a, b) for a, b in ROUTE_ALIASES.items()], F.col("expected_route"))
    route = F.coalesce(want, F.lit("")).isin("") | (F.col("route") == want)
    tools = F.size(F.array_except("expected_tools", "tools")) == 0
    budget = (F.size("tools") <= 8) & (F.col("retry_count") <= 3)
    risk = F.size("policy_findings") == 0
    return traces.withColumns({
        "route_correct": route, "tools_present": tools, "within_budget": budget, "risk_passed": risk,
        "passed": F.col("completed") & route & tools & budget & risk,
    })


def trace_risks(traces: DataFrame, allowed: list[str] = TRACE_TOOLS) -> DataFrame:
    """Sorted distinct findings of each trace; ``private`` marks private scope."""
    pick = lambda names, label: F.transform(names, lambda t: F.concat(F.lit(f"{label}:"), t))
    forbidden = pick(F.filter("tools", lambda t: ~t.isin(allowed)), "forbidden_tool")
    none = F.array().cast("array<string>")
    private = F.when(F.col("private"), pick(F.filter("tools", lambda t: t.isin(PRIVATE_FORBIDDEN)), "private_scope_violation")).otherwise(none)
    retry = F.when(F.col("retry_count") < 0, F.array(F.lit("invalid_retry_count"))).otherwise(none)
    return traces.withColumn("findings", F.array_sort(F.array_distinct(F.concat("policy_findings", forbidden, private, retry))))


def aggregate_traces(scored: DataFrame) -> DataFrame:
    """One row of rates over scored traces; zeros for none."""
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return scored.agg(
        rate(F.col("completed")).alias("completion_rate"), rate(F.col("answer") != "").alias("answer_rate"),
        rate(F.col("route_correct") & F.col("tools_present")).alias("process_rate"), rate(F.col("within_budget")).alias("budget_rate"),
        rate(~F.col("risk_passed")).alias("risk_rate"), nearest_rank("total_latency_ms", 0.5).alias("p50_latency_ms"),
        nearest_rank("total_latency_ms", 0.95).alias("p95_latency_ms"), rate(F.col("tokens")).alias("mean_tokens"),
        rate(F.size("tools")).alias("mean_tools"), F.coalesce(F.sum("retry_count"), F.lit(0)).alias("retries"),
        F.coalesce(F.avg("cost"), F.lit(0.0)).alias("mean_cost"), rate(F.col("cost").isNotNull()).alias("cost_observed_rate"),
        rate(F.exists("policy_findings", lambda f: F.contains(f, F.lit("private_scope")))).alias("private_violation_rate"),
        rate(F.col("completed") & (F.size("policy_findings") > 0)).alias("high_risk_false_allow_rate"),
    )


def _rules(keys: list[str], rules: list[tuple[str, Column, Column]]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(p, F.lit(False)).alias("passed"), F.coalesce(s.cast("double"), F.lit(0.0)).alias("score")) for n, p, s in rules]))


def quiz_rules(questions: DataFrame, samples: DataFrame) -> DataFrame:
    """``questions(sample_id, pos, stem, explanation, type, option_keys, answer, difficulty)`` against ``samples(sample_id, expected_points, expected_difficulty, evidence_text)``."""
    text = F.lower(squeeze(F.concat_ws(" ", "stem", "explanation")))
    n = F.size("answer")
    kind = F.lower(F.coalesce("type", F.lit("single")))
    wrong = (
        (kind.isin("single", "single_choice", "choice") & (n != 1)) | (kind.isin("multiple", "multiple_choice", "multi") & (n < 2))
        | (kind.isin("true_false", "判断题", "judge") & ~F.size("option_keys").isin(0, 2)) | ((F.size("option_keys") > 0) & (F.size(F.array_except("answer", "option_keys")) > 0))
    )
    per = questions.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(text != "", text)).alias("u"), F.count(F.when(text != "", 1)).alias("t"),
        F.sum(wrong.cast("int")).alias("bad"), F.array_distinct(F.flatten(F.collect_list(tokens_eval(text)))).alias("have"),
        F.collect_set(F.lower("difficulty")).alias("levels"),
    )
    rows = samples.join(per, "sample_id", "left").na.fill(0, ["n", "u", "t", "bad"])
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"have": F.coalesce("have", none), "levels": F.coalesce("levels", none)})
    want = tokens_eval(F.array_join("expected_points", " "))
    cover = F.size(F.array_intersect(want, "have")) / F.greatest(F.size(want), F.lit(1))
    level = (F.size(F.filter("levels", lambda v: v != "")) == 0) | F.array_contains("levels", F.lower("expected_difficulty"))
    has = F.coalesce(F.col("evidence_text") != "", F.lit(False))
    supported = ~has | F.arrays_overlap(tokens_eval(F.col("evidence_text")), F.col("have"))
    one = lambda c: c.cast("double")
    rules = [
        ("quiz.non_empty", F.col("n") > 0, one(F.col("n") > 0)), ("quiz.no_duplicate_questions", F.col("t") == F.col("u"), one(F.col("t") == F.col("u"))),
        ("quiz.valid_question_structure", F.col("bad") == 0, one(F.col("bad") == 0)),
        ("quiz.knowledge_point_coverage", F.when(F.size(want) > 0, cover >= 0.5).otherwise(F.col("n") > 0), cover),
        ("quiz.difficulty_matches", level, one(level)), ("quiz.evidence_supported", supported, one(supported)),
    ]
    return rows.select("sample_id", F.lit("quiz").alias("kind"), _rules([], rules).alias("r")).select("sample_id", "kind", "r.*")


def report_rules(reports: DataFrame) -> DataFrame:
    """``(sample_id, summary, weaknesses, recommendations, expected_points, topic, evidence_text)`` -> rule rows."""
    body = tokens_eval(F.concat_ws(" ", "summary", F.array_join("weaknesses", " "), F.array_join("recommendations", " ")))
    want = tokens_eval(F.array_join("expected_points", " "))
    cover = F.size(F.array_intersect(want, body)) / F.greatest(F.size(want), F.lit(1))
    relevant = F.when(F.col("topic") != "", F.arrays_overlap(tokens_eval(F.col("topic")), body)).otherwise(F.lit(True))
    has = F.coalesce(F.col("evidence_text") != "", F.lit(False))
    backed = F.arrays_overlap(tokens_eval(F.col("evidence_text")), body)
    full = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    said = F.coalesce(strip(F.col("summary")) != "", F.lit(False))
    one = lambda c: c.cast("double")
    rules = [
        ("report.has_summary", said, one(said)), ("report.has_weakness", full("weaknesses"), one(full("weaknesses"))),
        ("report.has_recommendation", full("recommendations"), one(full("recommendations"))),
        ("report.covers_knowledge_points", F.when(F.size(want) > 0, cover >= 0.3).otherwise(F.lit(True)), cover),
        ("report.topic_relevant", relevant, one(relevant)), ("report.evidence_supported", ~has | backed, one(has & backed)),
    ]
    return reports.select("sample_id", F.lit("report").alias("kind"), _rules([], rules).alias("r")).select("sample_id", "kind", "r.*")


def aggregate_rules(rules: DataFrame) -> DataFrame:
    """Per kind the share of samples that pass all rules, the mean score and the duplicate rate."""
    per = rules.groupBy("kind", "sample_id").agg(
        F.min(F.col("passed").cast("int")).alias("ok"), F.avg("score").alias("score"),
        F.max((F.endswith("rule", F.lit("no_duplicate_questions")) & ~F.col("passed")).cast("int")).alias("dup"),
    )
    return per.groupBy("kind").agg(F.avg("ok").alias("valid_rate"), F.avg("score").alias("mean_score"), F.avg("dup").alias("duplicate_rate"))


def aggregate_scores(samples: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judge scores by sample id, else by equal input (k-th to k-th); ``(samples with status, metrics per scenario and overall)``."""
    nth = lambda w, o: F.row_number().over(Window.partitionBy(w).orderBy(o))
    direct = samples.join(scores.where("sample_id is not null").dropDuplicates(["sample_id"]).drop("user_input"), "sample_id", "left")
    direct = direct.withColumn("found", reduce(lambda a, b: a | b, [F.col(m).isNotNull() for m in JUDGE_METRICS]))
    loose = scores.where("sample_id is null").withColumn("nth", nth("user_input", F.struct(*JUDGE_METRICS))).drop("sample_id")
    waiting = direct.where("not found").drop(*JUDGE_METRICS).withColumn("nth", nth("user_input", "sample_id"))
    rows = direct.where("found").drop("found").unionByName(waiting.join(loose, ["user_input", "nth"], "left").drop("found", "nth"))
    missing = F.array_compact(F.array(*[F.when(F.col(m).isNull(), m) for m in JUDGE_METRICS]))
    rows = rows.withColumn("status", F.when(F.size(missing) == 0, "success").otherwise("failed")).withColumn("missing", missing)
    means = [F.avg(m).alias(m) for m in JUDGE_METRICS]
    metrics = rows.rollup("scenario_type").agg(*means, F.count(F.lit(1)).alias("n"), F.min((F.col("status") == "success").cast("int")).alias("complete"))
    return rows, metrics


def split_missing_responses(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations with a response, and the failed rest."""
    has = F.coalesce(strip(F.col("response")) != "", F.lit(False))
    return obs.where(has), obs.where(~has).select("sample_id", F.lit("failed").alias("status"), F.lit("generation_response_missing").alias("error"))


def batches(queries: DataFrame, size: int = 10) -> DataFrame:
    """Queries with their batch number, in id order.

    A global sort numbers the rows of each partition; what earlier partitions hold is added from one row a partition.
    """
    kept = queries.columns
    rows = staged(queries.orderBy("query_id").withColumn("_at", F.monotonically_increasing_id()), "in-order")
    rows = rows.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("_part")) - F.col("n")  # one row a partition
    rows = rows.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return rows.select(*kept, F.floor((F.col("_before") + F.col("_at")) / size).alias("batch"))


def pending_batches(batched: DataFrame, done: DataFrame) -> DataFrame:
    """Batches to run: all but those that succeeded with every sample; ``done(batch, status, n_samples)``."""
    want = batched.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    whole = done.where("status = 'success'").select("batch", F.col("n_samples").alias("n"))
    return want.join(whole, ["batch", "n"], "left_anti").select("batch")


def merge_batches(samples: DataFrame, n_queries: int) -> DataFrame:
    """Means of the scores there are, and ``success`` only if all samples are there and succeeded."""
    bad = F.count(F.when(F.col("status") != "success", 1))
    return samples.agg(
        F.when((F.count(F.lit(1)) == n_queries) & (bad == 0), "success").otherwise("partial").alias("status"),
        F.count(F.lit(1)).alias("n_evaluated"), bad.alias("n_failed"), *[F.avg(m).alias(m) for m in JUDGE_METRICS],
    )


def mode_benchmark(hits: DataFrame, qrels: DataFrame, k: int = 5, key: str = "chunk_id") -> DataFrame:
    """``hits`` of several modes -> per mode recall, hit, MRR, nDCG (at most 1) and candidates per query."""
    modes = hits.select("mode").distinct()
    ask = modes.join(qrels.select("query_id").distinct(), how="cross")  # a handful of modes
    flat = lambda df: df.withColumn("query_id", F.concat_ws("|", "mode", "query_id"))
    each = flat(ask.join(qrels, "query_id").select("mode", "query_id", key, "gain"))
    per = rank_metrics(flat(hits).drop("mode"), each.drop("mode"), k, key).withColumn("mode", F.substring_index("query_id", "|", 1))
    found = flat(hits.where(F.col("rank") <= k)).select("query_id", key).distinct().join(each.where("gain > 0"), ["query_id", key])
    want = each.where("gain > 0").groupBy("mode", "query_id").agg(F.count(F.lit(1)).alias("n"))
    recall = want.join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("f")), "query_id", "left").groupBy("mode").agg(F.avg(F.coalesce("f", F.lit(0)) / F.col("n")).alias("recall"))
    cand = hits.groupBy("mode").agg(F.count(F.lit(1)).alias("candidates"))
    mean = per.groupBy("mode").agg(F.avg("hit").alias("hit"), F.avg("mrr").alias("mrr"), F.avg(F.least(F.lit(1.0), F.col("ndcg"))).alias("ndcg"))
    return mean.join(recall, "mode").join(cand, "mode")


def golden_violations(queries: DataFrame, size: int = 100) -> DataFrame:
    """``(query_id, violation)``; a null id for the set's size."""
    n = queries.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != size).select(F.lit(None).cast("string").alias("query_id"), F.lit("size").alias("violation"))
    dup = queries.groupBy("query_id").count().where("count > 1").select(F.col("query_id").cast("string"), F.lit("duplicate_query_id").alias("violation"))
    kinds = dict(queries.dtypes)
    empty = lambda c: F.size(c) == 0 if kinds[c].startswith("array") else F.col(c) == ""
    rules = [F.when(F.col(c).isNull() | empty(c), f"missing_{c}") for c in GOLDEN_FIELDS]
    rules.append(F.when(F.size("reference_context_ids") != F.size("reference_contexts"), "reference_length_mismatch"))
    rows = queries.select(F.col("query_id").cast("string"), F.explode(F.array_compact(F.array(*rules))).alias("violation"))
    return n.unionByName(dup).unionByName(rows)


def enrich_benchmark(queries: DataFrame) -> DataFrame:
    """Missing reference fields from the query, its points and its relevance map."""
    context = F.concat_ws(" ", "query", F.array_join("expected_knowledge_points", " "))
    text = lambda c, d: F.when(F.coalesce(F.col(c), F.lit("")) == "", d).otherwise(F.col(c))
    many = lambda c, d: F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, d).otherwise(F.col(c))
    return queries.withColumns({
        "reference_answer": text("reference_answer", F.concat(F.col("topic"), F.lit("："), context)),
        "reference_context_ids": many("reference_context_ids", F.map_keys("relevance")), "reference_contexts": many("reference_contexts", F.array(context)),
        "expected_route": text("expected_route", F.lit("public_milvus_search")), "expected_tools": many("expected_tools", F.array(F.lit("public_milvus_search"))),
    })


def build_golden(parents: DataFrame, per_tech: int = 5, size: int = 100) -> DataFrame:
    """Up to ``per_tech`` parents a technology, qa first, then by id; filled to ``size`` from the rest."""
    ranked = parents.withColumn("late", F.col("parent_type") != "qa").withColumn("n", F.row_number().over(Window.partitionBy("technology").orderBy("late", "parent_id")))
    place = F.when(F.col("n") <= per_tech, F.struct(F.lit(0).alias("a"), F.col("technology").alias("b"), F.col("n").alias("c"), F.col("parent_id").alias("d"))).otherwise(
        F.struct(F.lit(1).alias("a"), F.lit("").alias("b"), F.col("late").cast("int").alias("c"), F.col("parent_id").alias("d"))
    )
    top = ranked.withColumn("place", place).orderBy("place").limit(size)
    return top.withColumn("pos", F.row_number().over(Window.orderBy("place"))).select(F.format_string("g-%03d", "pos").alias("query_id"), "parent_id", "technology", "parent_type")


def bind_queries(queries: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per query the first parent of its document with a query word of over two characters, else the first; and the unbound.

    A document's parents are one row, so its query meets them once and isn't copied for each.
    """
    whole = parents.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("parent_id", F.lower(F.coalesce("text", F.lit(""))).alias("low")))).alias("parents"))
    words = F.array_distinct(F.filter(F.split(squeeze(F.lower("query")), " "), lambda w: F.length(w) > 2))
    rows = queries.join(whole, "document_id").select("query_id", words.alias("words"), "parents")
    fits = lambda p: F.exists("words", lambda w: F.contains(p["low"], w))
    first = lambda p, miss: F.struct(F.lit(miss).alias("m"), p["parent_id"].alias("parent_id"))
    found = F.filter("parents", fits)
    best = F.when(fits(F.col("parents")[0]), first(F.col("parents")[0], False)).when(F.size(found) > 0, first(found[0], False)).otherwise(first(F.col("parents")[0], True))
    bound = rows.select("query_id", best.alias("best")).groupBy("query_id").agg(F.min("best").alias("best")).select("query_id", "best.parent_id")
    return bound, queries.join(parents, "document_id", "left_anti").select("query_id")


def atomic_answers(parents: DataFrame, min_len: int = 180, max_question: int = 180) -> DataFrame:
    """``parents(parent_id, text, question)`` -> the lines from the question to the next question-like line, and whether it is usable."""
    lines = F.filter(F.transform(F.split("text", "\n"), squeeze), lambda s: s != "")
    body = squeeze(F.regexp_replace("question", r"^[^:]*: ", ""))
    p = parents.withColumns({"lines": lines, "body": body})
    hit = F.transform("lines", lambda s, i: F.when(F.contains(s, F.left(F.col("body"), F.lit(36))) | F.contains(F.col("body"), F.left(s, F.lit(36))), i))
    p = p.withColumn("at", F.coalesce(F.array_min(F.array_compact(hit)), F.lit(0)))
    asks = lambda s: (F.length(s) <= max_question) & s.rlike("[?？]") & s.rlike(f"({'|'.join(NEXT_QUESTION)}).*[？?]")
    ends = F.transform("lines", lambda s, i: F.when((i > F.col("at")) & asks(s), i))
    p = p.withColumn("end", F.coalesce(F.array_min(F.array_compact(ends)), F.size("lines")))
    answer = F.array_join(F.slice("lines", F.col("at") + 1, F.greatest(F.col("end") - F.col("at"), F.lit(0))), "\n")
    malformed = (squeeze(F.col("question")) == "") | (~F.col("question").rlike("[?？]") & F.col("question").rlike(r"[();{}=]"))
    return p.select("parent_id", answer.alias("answer"), (~malformed & (F.length(answer) >= min_len)).alias("usable"))


def visual_metrics(blocks: DataFrame) -> DataFrame:
    """Per document counts of visual blocks by status."""
    n = lambda s: F.count(F.when(F.col("visual_status") == s, 1)).alias(s)
    return blocks.where("visual_status is not null").groupBy("document_id").agg(F.count(F.lit(1)).alias("assets"), n("ready"), n("degraded"), n("skipped"))


def metric_cuts(per_query: DataFrame, dims: list[str], measures: list[str]) -> DataFrame:
    """The means overall and cut by each dimension, in one pass."""
    cuts = [F.struct(F.lit("all").alias("cut"), F.lit("all").alias("value"))] + [F.struct(F.lit(d).alias("cut"), F.col(d).cast("string").alias("value")) for d in dims]
    rows = per_query.select(*measures, F.explode(F.array(*cuts)).alias("c")).select(*measures, "c.*")
    return rows.groupBy("cut", "value").agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in measures])
