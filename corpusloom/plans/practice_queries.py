"""Queries of the practice operators over orders and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import practice as P
from corpusloom.operators.dedupe import new_uploads
from corpusloom.plans.registry import query
from corpusloom.plans.views import ANSWERS, SESSIONS, answers, sessions, table

_SCORES = f"""{ANSWERS}, scores AS (SELECT quiz_id, user_id, sum((selected = answer)::INT)::BIGINT AS score, count(*) AS total, round(100.0 * sum((selected = answer)::INT) / count(*), 1) AS accuracy FROM answers GROUP BY quiz_id, user_id)"""
_OPTIONS = {"A": "one", "N": "two", "R": "three"}


def questions(spark, sf_dir):
    """Seven questions a quiz with options A, N and R."""
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("quiz_id"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("question_no"))
    options = F.create_map(*[F.lit(x) for kv in _OPTIONS.items() for x in kv])
    return q.withColumn("options", options).withColumn("answer", F.array(F.lit("A"))).withColumn("type", F.when(F.col("question_no") == 5, "multiple").when(F.col("question_no") == 6, "judge").otherwise("single"))


_QUESTIONS = "questions AS (SELECT o_orderkey AS quiz_id, unnest(range(1, 8)) AS question_no FROM orders)"


@query("score_u1", f"""WITH {_SCORES}, p AS (SELECT quiz_id, list_distinct(list(knowledge_point) FILTER (selected = answer)) AS m, list_distinct(list(knowledge_point) FILTER (selected <> answer)) AS r FROM answers GROUP BY quiz_id)
SELECT quiz_id, user_id, score, total, CAST(accuracy AS DOUBLE) AS accuracy, list_sort(coalesce(m, [])) AS mastered, list_sort(coalesce(r, [])) AS review FROM scores JOIN p USING (quiz_id)""")
def score_u1(spark, sf_dir):
    return P.score(answers(spark, sf_dir)).withColumns({"mastered": F.array_sort("mastered"), "review": F.array_sort("review")})


@query("question_results_u2", f"""WITH {ANSWERS}, {_QUESTIONS} SELECT q.quiz_id, q.question_no::INT AS question_no, CASE WHEN selected IS NULL THEN 'unanswered' WHEN selected = ['A'] THEN 'correct' ELSE 'incorrect' END AS status,
CASE selected[1] WHEN 'A' THEN ['one'] WHEN 'N' THEN ['two'] WHEN 'R' THEN ['three'] ELSE [] END AS selected_texts FROM questions q LEFT JOIN answers a ON q.quiz_id = a.quiz_id AND q.question_no = a.question_no""")
def question_results_u2(spark, sf_dir):
    return P.question_results(questions(spark, sf_dir), answers(spark, sf_dir))


@query("strict_correct_u3", "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag = 'A' AND l_linestatus = 'F' AS strict FROM lineitem")
def strict_correct_u3(spark, sf_dir):
    picked = F.when(F.col("l_linestatus") == "F", F.array("l_returnflag")).otherwise(F.array("l_returnflag", "l_returnflag"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", P.strict_correct(picked, F.array(F.lit("A"))).alias("strict"))


@query("merge_answers_u4", f"WITH {ANSWERS} SELECT quiz_id, question_no, CASE WHEN question_no % 2 = 0 THEN ['Z'] ELSE selected END AS selected FROM answers")
def merge_answers_u4(spark, sf_dir):
    a = answers(spark, sf_dir).select("quiz_id", "question_no", "selected")
    return P.merge_answers(a.where("question_no < 6"), a.where("question_no % 2 = 0 or question_no >= 6").withColumn("selected", F.when(F.col("question_no") % 2 == 0, F.array(F.lit("Z"))).otherwise(F.col("selected"))))


@query("review_rows_u5", f"""WITH {ANSWERS}, {_QUESTIONS} SELECT q.quiz_id, q.question_no::INT AS question_no, CASE q.question_no WHEN 5 THEN '多选题' WHEN 6 THEN '判断题' ELSE '单选题' END AS type_label,
coalesce(selected[1], '') AS selected_keys, 'A' AS right_keys, coalesce(selected[1] = 'A', false) AS is_correct FROM questions q LEFT JOIN answers a ON q.quiz_id = a.quiz_id AND q.question_no = a.question_no""")
def review_rows_u5(spark, sf_dir):
    return P.review_rows(questions(spark, sf_dir), answers(spark, sf_dir))


@query("quiz_violations_u6", f"""WITH {ANSWERS}, n AS (SELECT quiz_id, count(*) AS n FROM answers GROUP BY quiz_id)
SELECT quiz_id, 'answer_not_in_options' AS violation FROM answers WHERE selected[1] = 'R' UNION ALL SELECT quiz_id, 'option_not_explained' FROM answers WHERE selected[1] = 'N'
UNION ALL SELECT quiz_id, 'question_count' FROM n WHERE n <> 6 UNION ALL SELECT quiz_id, 'type_quota' FROM n UNION ALL SELECT quiz_id, 'repeated_stem' FROM answers GROUP BY quiz_id HAVING count(DISTINCT knowledge_point) < count(*)""")
def quiz_violations_u6(spark, sf_dir):
    """Each answer as a single-choice question with options A and N."""
    options = F.create_map(F.lit("A"), F.lit("one"), F.lit("N"), F.lit("two"))
    q = answers(spark, sf_dir).select(
        "quiz_id", "question_no", F.col("question_no").alias("id"), F.lit("single").alias("type"), F.col("knowledge_point").alias("stem"), options.alias("options"),
        F.col("selected").alias("answer"), F.when(F.col("selected")[0] == "N", F.array(F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("N"))).alias("explained"),
    )
    return P.quiz_violations(q)


@query("answer_violations_u7", """SELECT DISTINCT l_orderkey AS quiz_id, l_linenumber AS question_no, 'unknown_question' AS violation FROM lineitem WHERE l_linenumber > 5
UNION ALL SELECT l_orderkey, l_linenumber, 'repeated_answer' FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def answer_violations_u7(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("quiz_id"), F.col("l_linenumber").alias("question_no"))
    q = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("quiz_id"), F.explode(F.sequence(F.lit(1), F.lit(5))).alias("question_no"))
    return P.answer_violations(q, a)


@query("xp_u8", f"WITH {_SCORES}, {SESSIONS} SELECT s.user_id, CAST(sum(10 + 2 * score) AS BIGINT) AS xp FROM scores s JOIN sessions USING (quiz_id) WHERE has_report GROUP BY s.user_id")
def xp_u8(spark, sf_dir):
    done = sessions(spark, sf_dir).where("has_report").select("quiz_id", "created_at")
    scored = P.score(answers(spark, sf_dir)).join(done, "quiz_id").select("quiz_id", "user_id", "score", "created_at")
    both = F.array(F.struct(F.lit(1).alias("report_id"), "score"), F.struct(F.lit(2).alias("report_id"), F.lit(99).cast("long").alias("score")))
    reports = scored.withColumn("r", F.explode(both)).select("quiz_id", "user_id", "created_at", "r.report_id", "r.score")
    return P.xp(reports)  # a second report earns nothing


@query("profile_u9", f"""WITH {_SCORES}, {SESSIONS} SELECT c_custkey AS user_id, count(DISTINCT s.quiz_id) AS quizzes, CAST(coalesce(sum(score), 0) AS BIGINT) AS correct, CAST(round(coalesce(avg(accuracy), 0), 6) AS DOUBLE) AS accuracy
FROM customer LEFT JOIN sessions s ON s.user_id = c_custkey LEFT JOIN scores USING (quiz_id) GROUP BY c_custkey""")
def profile_u9(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return P.profiles(users, sessions(spark, sf_dir), P.score(answers(spark, sf_dir)))


@query("history_page_u10", f"""WITH {_SCORES}, {SESSIONS}, d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, quiz_id DESC) AS n FROM sessions WHERE has_report)
SELECT d.user_id, quiz_id, n::INT AS n, strftime(created_at, '%Y-%m-%d %H:%M') AS created, CAST(accuracy AS DOUBLE) AS accuracy, total FROM d LEFT JOIN scores USING (quiz_id) WHERE n BETWEEN 3 AND 4""")
def history_page_u10(spark, sf_dir):
    s = sessions(spark, sf_dir)
    return P.history_page(s, P.score(answers(spark, sf_dir)), s.where("has_report").select("quiz_id"), page=2, size=2)[0]


@query("history_totals_u10", f"WITH {SESSIONS} SELECT user_id, count(*) AS total FROM sessions WHERE has_report GROUP BY user_id")
def history_totals_u10(spark, sf_dir):
    s = sessions(spark, sf_dir)
    return P.history_page(s, P.score(answers(spark, sf_dir)), s.where("has_report").select("quiz_id"))[1]


@query("quiz_detail_u11", f"""WITH {_SCORES}, {SESSIONS}, a AS (SELECT quiz_id, count(*) AS n FROM answers GROUP BY quiz_id)
SELECT s.quiz_id, status, coalesce(n, -1)::INT AS n_answers, CASE WHEN has_report THEN score END AS score FROM sessions s LEFT JOIN a USING (quiz_id) LEFT JOIN scores USING (quiz_id)""")
def quiz_detail_u11(spark, sf_dir):
    s, a = sessions(spark, sf_dir), answers(spark, sf_dir)
    reports = P.score(a).join(s.where("has_report").select("quiz_id"), "quiz_id").select("quiz_id", F.to_json(F.struct("score", "accuracy")).alias("report_json"))
    d = P.quiz_detail(s, a, reports)
    return d.select("quiz_id", "status", F.coalesce(F.size("answers"), F.lit(-1)).alias("n_answers"), F.col("report.score").alias("score"))


@query("incomplete_u12", f"WITH {SESSIONS} SELECT quiz_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, quiz_id DESC)::INT AS n FROM sessions WHERE status <> 'completed'")
def incomplete_u12(spark, sf_dir):
    s = sessions(spark, sf_dir)
    return P.incomplete(s.select("quiz_id", "status", F.col("created_at").alias("updated_at")), s).select("quiz_id", "user_id", "n")


@query("progress_status_u13", f"""WITH {ANSWERS}, a AS (SELECT quiz_id, count(*) AS n, max(CASE WHEN selected[1] = 'R' THEN 'bad_option' END) AS e FROM answers GROUP BY quiz_id)
SELECT o_orderkey AS quiz_id, coalesce(n, 0) AS n_answers, CASE WHEN e IS NULL AND o_orderkey % 10 < 7 THEN CASE WHEN coalesce(n, 0) = 7 THEN 'ready_for_report' ELSE 'in_progress' END END AS status,
coalesce(e, CASE WHEN o_orderkey % 10 >= 7 THEN 'bad_index' END) AS error FROM orders LEFT JOIN a ON quiz_id = o_orderkey""")
def progress_status_u13(spark, sf_dir):
    q = questions(spark, sf_dir).withColumn("options", F.create_map(F.lit("A"), F.lit("one"), F.lit("N"), F.lit("two")))
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("quiz_id"), (F.col("o_orderkey") % 10).alias("current_index"))
    return P.progress_status(p, q, answers(spark, sf_dir))


def documents(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("updated_at"), F.sha2("o_orderpriority", 256).alias("content_hash"))


@query("user_documents_u15", "SELECT o_custkey AS user_id, o_orderkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS n FROM orders QUALIFY n BETWEEN 4 AND 6")
def user_documents_u15(spark, sf_dir):
    return P.user_documents(documents(spark, sf_dir), page=2, size=3)[0].select("user_id", "document_id", "n")


@query("document_caps_u15", "SELECT o_custkey AS user_id, count(*) AS n_documents, count(*) < 12 AS may_add FROM orders GROUP BY o_custkey")
def document_caps_u15(spark, sf_dir):
    return P.user_documents(documents(spark, sf_dir), cap=12)[1]


@query("find_by_hash_u15", "SELECT o_custkey AS user_id, sha256(o_orderpriority) AS content_hash, min(o_orderkey) AS upload_id FROM orders GROUP BY ALL")
def find_by_hash_u15(spark, sf_dir):
    d = documents(spark, sf_dir).withColumnRenamed("document_id", "upload_id")
    return new_uploads(d, d.where("false"))


def tasks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("user_id"), F.sha2(F.col("user_id").cast("string"), 256).alias("guest_hash"),
        F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view", "generating").otherwise("completed").alias("status"), F.col("ts").alias("created_at"),
    )


@query("owner_scope_u16", "SELECT event_id FROM events WHERE user_id = 41")
def owner_scope_u16(spark, sf_dir):
    t = tasks(spark, sf_dir)
    return t.where(P.owner_filter(guest_hash="3d914f9348c9cc0ff8a79716700b9fcd4d2f3e711608004eb8f138bcba7f14d9")).select("event_id")


@query("guest_usage_u17", "SELECT sha256(user_id::VARCHAR) AS guest_hash, count(CASE WHEN event_type IN ('click', 'view') THEN 1 END) AS active, count(CASE WHEN ts::DATE = DATE '2024-01-15' THEN 1 END) AS today FROM events GROUP BY user_id")
def guest_usage_u17(spark, sf_dir):
    return P.guest_usage(tasks(spark, sf_dir), "2024-01-15")


@query("upsert_assets_u18", """WITH a AS (SELECT l_suppkey AS k, min(l_partkey) AS asset_id FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL), b AS (SELECT l_suppkey AS k, min(l_partkey) AS asset_id FROM lineitem WHERE l_linenumber > 1 GROUP BY ALL)
SELECT concat('k', k) AS dedupe_key, asset_id FROM a UNION ALL SELECT concat('k', k), asset_id FROM b WHERE k NOT IN (SELECT k FROM a)""")
def upsert_assets_u18(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("k"), "l_suppkey").alias("dedupe_key"), F.col("l_partkey").alias("asset_id"), "l_linenumber")
    have = l.where("l_linenumber = 1").groupBy("dedupe_key").agg(F.min("asset_id").alias("asset_id"))
    return P.upsert_assets(have, l.where("l_linenumber > 1").drop("l_linenumber"))


@query("question_images_u18", f"WITH {ANSWERS} SELECT quiz_id, count(CASE WHEN selected[1] = 'A' THEN 1 END) AS n_images FROM answers GROUP BY quiz_id")
def question_images_u18(spark, sf_dir):
    a = answers(spark, sf_dir)
    quiz = a.groupBy("quiz_id").agg(F.array_sort(F.collect_list(F.struct("question_no", F.col("knowledge_point").alias("stem"), F.lit(None).cast("string").alias("image")))).alias("questions"))
    assets = a.where("selected[0] = 'A'").select("quiz_id", "question_no", F.concat(F.lit("u"), "question_no").alias("url"))
    done = P.set_question_image(quiz, assets)
    return done.select("quiz_id", F.size(F.filter("questions", lambda q: q["image"] == F.concat(F.lit("u"), q["question_no"]))).cast("long").alias("n_images"))


@query("first_images_u19", f"""WITH {ANSWERS} SELECT quiz_id, question_no, selected[1] <> 'A' AND sum((selected[1] <> 'A')::INT) OVER (PARTITION BY quiz_id ORDER BY question_no) <= 3 AS image_enabled FROM answers""")
def first_images_u19(spark, sf_dir):
    q = answers(spark, sf_dir).withColumn("wants_image", F.col("selected")[0] != "A")
    return P.first_n_images(q).select("quiz_id", "question_no", "image_enabled")


@query("normalize_questions_c21", f"""WITH {ANSWERS} SELECT quiz_id, question_no, CASE question_no % 3 WHEN 0 THEN 'judge' WHEN 1 THEN 'single' ELSE 'multiple' END AS type, CASE question_no % 2 WHEN 0 THEN 'hard' ELSE 'easy' END AS difficulty,
CASE WHEN question_no % 3 = 0 THEN ['B'] WHEN question_no % 3 = 1 THEN ['A'] ELSE ['A', 'B'] END AS answer FROM answers""")
def normalize_questions_c21(spark, sf_dir):
    n = F.col("question_no")
    opt = lambda k, t: F.struct(F.lit(k).alias("key"), F.lit(t).alias("text"))
    raw = answers(spark, sf_dir).select(
        "quiz_id", n, F.when(n % 3 == 0, "判断题").when(n % 3 == 1, "Single_Choice").otherwise("multi").alias("type"), F.when(n % 2 == 0, "Advanced").otherwise("简单").alias("difficulty"),
        F.array(opt("x", "对"), opt("y", "错")).alias("options"), F.when(n % 3 == 0, F.array(F.lit("false"))).when(n % 3 == 1, F.array(F.lit("0"))).otherwise(F.array(F.lit("y"), F.lit("a"))).alias("answer"),
    )
    return P.normalize_questions(raw).select("quiz_id", "question_no", "type", "difficulty", "answer")
