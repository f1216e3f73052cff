"""Practice records: scores, results, profiles, histories, progress, documents and assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import judge_text, squeeze

# Fixed values of the data contract.
TYPE_LABELS = {"single": "单选题", "multiple": "多选题", "judge": "判断题"}
QUOTA = {"single": 4, "multiple": 1, "judge": 1}


def _shuffled(rows: DataFrame) -> DataFrame:
    """Questions grow with the quizzes, but as exploded rows are estimated at a file's size: never for the driver to collect."""
    return rows.hint("merge")


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def strict_correct(selected: Column, expected: Column) -> Column:
    """Equal sets, and no key selected twice."""
    return same_set(selected, expected) & (F.size(F.array_distinct(selected)) == F.size(selected))


def score(answers: DataFrame) -> DataFrame:
    """Answers with their question's ``answer`` and ``knowledge_point`` -> score, accuracy (%, one digit), mastered and review points in order."""
    right = same_set(F.col("selected"), F.col("answer"))
    points = lambda ok: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("question_no", "knowledge_point")))), lambda x: x["knowledge_point"]))
    n = F.count(F.lit(1))
    good = F.sum(right.cast("int"))
    return answers.groupBy("quiz_id", "user_id").agg(
        good.alias("score"), n.alias("total"), F.round(100.0 * good / n, 1).alias("accuracy"), points(right).alias("mastered"), points(~right).alias("review")
    )


def question_results(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Every question with its status and the texts of the selected options in their order."""
    rows = questions.join(answers.select("quiz_id", "question_no", "selected"), ["quiz_id", "question_no"], "left")
    status = F.when(F.col("selected").isNull(), "unanswered").when(same_set(F.col("selected"), F.col("answer")), "correct").otherwise("incorrect")
    texts = F.array_compact(F.transform(F.coalesce("selected", F.array().cast("array<string>")), lambda k: F.try_element_at("options", k)))
    return rows.select("quiz_id", "question_no", status.alias("status"), texts.alias("selected_texts"))


def merge_answers(server: DataFrame, local: DataFrame, keys: tuple[str, ...] = ("quiz_id", "question_no")) -> DataFrame:
    """U4: local answers override the server's, new ones are added."""
    rest = [c for c in server.columns if c not in keys]
    s = server.select(*keys, F.struct(*rest).alias("s"))
    m = s.join(local.select(*keys, F.struct(*rest).alias("l")), list(keys), "full").withColumn("x", F.coalesce("l", "s"))
    return m.select(*keys, "x.*")


def review_rows(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """One row a question with its type label, the selected and the right keys."""
    label = F.coalesce(*[F.when(F.col("type") == k, v) for k, v in TYPE_LABELS.items()], F.col("type"))
    rows = questions.join(answers.select("quiz_id", "question_no", "selected"), ["quiz_id", "question_no"], "left")
    picked = F.coalesce("selected", F.array().cast("array<string>"))
    return rows.select(
        "quiz_id", "question_no", label.alias("type_label"), F.array_join(picked, ",").alias("selected_keys"), F.array_join("answer", ",").alias("right_keys"),
        strict_correct(picked, F.col("answer")).alias("is_correct"),
    )


def quiz_violations(questions: DataFrame, per_quiz: int = 6, strict: bool = True) -> DataFrame:
    """``(quiz_id, violation)``; questions carry ``question_no, id, type, stem, options map, answer, explained``."""
    keys = F.map_keys("options")
    n = F.size("answer")
    kind = F.col("type")
    judge = F.transform(F.map_values("options"), judge_text)
    rules = F.array_compact(F.array(
        F.when(F.size(F.array_except("answer", keys)) > 0, "answer_not_in_options"),
        F.when((kind == "single") & (n != 1), "single_needs_one_answer"), F.when((kind == "multiple") & (n < 2), "multiple_needs_two_answers"),
        F.when((kind == "judge") & (n != 1), "judge_needs_one_answer"),
        F.when((kind == "judge") & ((F.size(keys) != 2) | (F.size(F.array_distinct(F.array_compact(judge))) != 2)), "judge_options"),
        F.when(F.size(F.array_except(keys, "explained")) > 0, "option_not_explained"),
    ))
    own = questions.select("quiz_id", F.explode(rules).alias("violation"))
    stem = F.lower(F.regexp_replace(F.coalesce("stem", F.lit("")), r"\s+", ""))
    per = questions.groupBy("quiz_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct(stem).alias("stems"),
        *[F.count(F.when(F.col("type") == t, 1)).alias(t) for t in QUOTA],
    )
    off = F.lit(False)
    for t, want in QUOTA.items():
        off = off | (F.col(t) != want)
    whole = F.array_compact(F.array(
        F.when(F.col("n") != per_quiz, "question_count"), F.when(F.col("ids") != F.col("n"), "repeated_id"),
        F.when(F.col("stems") != F.col("n"), "repeated_stem"), F.when(off if strict else F.lit(False), "type_quota"),
    ))
    return own.unionByName(per.select("quiz_id", F.explode(whole).alias("violation")))


def answer_violations(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers to unknown questions, and questions answered twice."""
    key = ["quiz_id", "question_no"]
    unknown = answers.join(_shuffled(questions), key, "left_anti").select(*key, F.lit("unknown_question").alias("violation")).distinct()
    return unknown.unionByName(answers.groupBy(*key).count().where("count > 1").select(*key, F.lit("repeated_answer").alias("violation")))


def xp(reports: DataFrame) -> DataFrame:
    """U8: per user 10 + 2 score for each quiz's first report."""
    first = reports.groupBy("quiz_id").agg(F.min_by(F.struct("user_id", "score"), F.struct("created_at", "report_id")).alias("r"))
    return first.groupBy(F.col("r.user_id").alias("user_id")).agg(F.sum(10 + 2 * F.col("r.score")).alias("xp"))


def profiles(users: DataFrame, sessions: DataFrame, scores: DataFrame) -> DataFrame:
    """Distinct quizzes, right answers and mean accuracy per user, zero where there are none."""
    rows = users.join(sessions.select("user_id", "quiz_id"), "user_id", "left").join(scores.select("quiz_id", "score", "accuracy"), "quiz_id", "left")
    return rows.groupBy("user_id").agg(
        F.count_distinct("quiz_id").alias("quizzes"), F.coalesce(F.sum("score"), F.lit(0)).alias("correct"), F.round(F.coalesce(F.avg("accuracy"), F.lit(0.0)), 6).alias("accuracy")
    )


def history_page(sessions: DataFrame, scores: DataFrame, reports: DataFrame, page: int = 1, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """A page of every user's sessions that have a report, newest first, and each user's total."""
    done = sessions.join(reports, "quiz_id", "left_semi")
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("quiz_id"))
    paged = done.withColumn("n", F.row_number().over(newest)).where(F.col("n").between((page - 1) * size + 1, page * size))
    rows = paged.join(scores.select("quiz_id", "accuracy", "total"), "quiz_id", "left").select("user_id", "quiz_id", "n", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created"), "accuracy", "total")
    return rows, done.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))


def quiz_detail(sessions: DataFrame, answers: DataFrame, reports: DataFrame) -> DataFrame:
    """Session, its answers in order, and its report, JSON decoded."""
    a = answers.groupBy("quiz_id").agg(F.array_sort(F.collect_list(F.struct("question_no", "selected"))).alias("answers"))
    r = reports.select("quiz_id", F.from_json("report_json", "score long, accuracy double").alias("report"))
    return sessions.join(a, "quiz_id", "left").join(r, "quiz_id", "left")


def incomplete(progress: DataFrame, sessions: DataFrame) -> DataFrame:
    """Unfinished quizzes, per user newest first (``n``)."""
    rows = progress.where(F.col("status").isin("in_progress", "ready_for_report")).join(sessions.select("quiz_id", "user_id"), "quiz_id")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), F.desc("quiz_id"))))


def progress_status(progress: DataFrame, questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Per quiz its status after the answers, or why they are refused."""
    q = questions.groupBy("quiz_id").agg(F.count(F.lit(1)).alias("n_questions"))
    rows = answers.join(_shuffled(questions.select("quiz_id", "question_no", "options")), ["quiz_id", "question_no"], "left")
    bad = F.when(F.col("options").isNull(), "unknown_question").when(F.size(F.array_except("selected", F.map_keys("options"))) > 0, "bad_option")
    a = rows.groupBy("quiz_id").agg(F.count_distinct("question_no").alias("n_answers"), F.max(bad).alias("error"))
    s = progress.join(_shuffled(q), "quiz_id").join(_shuffled(a), "quiz_id", "left").na.fill(0, ["n_answers"])
    error = F.coalesce("error", F.when((F.col("current_index") < 0) | (F.col("current_index") >= F.col("n_questions")), "bad_index"))
    status = F.when(error.isNotNull(), None).when(F.col("n_answers") == F.col("n_questions"), "ready_for_report").otherwise("in_progress")
    return s.select("quiz_id", "n_answers", status.alias("status"), error.alias("error"))


def user_documents(docs: DataFrame, cap: int = 50, page: int = 1, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """Per user a page of documents, last updated first; and counts with whether another may be added."""
    order = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), F.desc("document_id"))
    rows = docs.withColumn("n", F.row_number().over(order)).where(F.col("n").between((page - 1) * size + 1, page * size))
    n = F.count(F.lit(1))
    return rows, docs.groupBy("user_id").agg(n.alias("n_documents"), (n < cap).alias("may_add"))


def document_status(docs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``docs(document_id, status, chunk_count, error)`` after ``outcomes(document_id, outcome, chunk_count, reason)``, one a document.

    ``ready`` sets the chunks and clears the error, ``failed`` keeps a reason of 500
    characters, ``reset`` puts a failed document, and no other, back to processing.
    """
    rows = docs.join(outcomes.select("document_id", "outcome", F.col("chunk_count").alias("n"), "reason"), "document_id", "left")
    reset = (F.col("outcome") == "reset") & (F.col("status") == "failed")
    status = F.when(F.col("outcome").isin("ready", "failed"), F.col("outcome")).when(reset, "processing").otherwise(F.col("status"))
    error = F.when(F.col("outcome") == "failed", F.left("reason", F.lit(500))).when((F.col("outcome") == "ready") | reset, None).otherwise(F.col("error"))
    count = F.when(F.col("outcome") == "ready", F.col("n")).otherwise(F.col("chunk_count"))
    return rows.select("document_id", status.alias("status"), count.alias("chunk_count"), error.alias("error"))


def owner_filter(user_id: int | None = None, guest_hash: str | None = None) -> Column:
    """U16: a user's rows, or a guest's rows without user."""
    if user_id is not None:
        return F.col("user_id") == user_id
    return F.col("user_id").isNull() & (F.col("guest_hash") == guest_hash)


def guest_usage(tasks: DataFrame, day: str) -> DataFrame:
    """Per guest the active tasks and those of the day."""
    active = F.col("status").isin("queued", "generating")
    return tasks.groupBy("guest_hash").agg(F.count(F.when(active, 1)).alias("active"), F.count(F.when(F.to_date("created_at") == F.lit(day).cast("date"), 1)).alias("today"))


def upsert_assets(assets: DataFrame, delta: DataFrame) -> DataFrame:
    """Insert or get by ``dedupe_key``: what is there stays, of the new the smallest id."""
    first = delta.join(assets, "dedupe_key", "left_anti").groupBy("dedupe_key").agg(F.min_by(F.struct(*[c for c in assets.columns if c != "dedupe_key"]), "asset_id").alias("x"))
    return assets.unionByName(first.select("dedupe_key", "x.*"))


def set_question_image(quizzes: DataFrame, assets: DataFrame) -> DataFrame:
    """Write each asset's url into the question of its quiz; ``quizzes(quiz_id, questions array<struct<question_no, stem, image>>)``."""
    urls = assets.groupBy("quiz_id").agg(F.map_from_entries(F.collect_list(F.struct("question_no", "url"))).alias("urls"))
    rows = quizzes.join(urls, "quiz_id", "left")
    put = F.transform("questions", lambda q: q.withField("image", F.coalesce(F.try_element_at("urls", q["question_no"]), q["image"])))
    return rows.select("quiz_id", F.when(F.col("urls").isNull(), F.col("questions")).otherwise(put).alias("questions"))


def first_n_images(questions: DataFrame, n: int = 3) -> DataFrame:
    """At most ``n`` questions of a quiz keep their wish for an image, the first ones."""
    before = F.sum(F.col("wants_image").cast("int")).over(Window.partitionBy("quiz_id").orderBy("question_no").rowsBetween(Window.unboundedPreceding, 0))
    return questions.withColumn("image_enabled", F.coalesce(F.col("wants_image"), F.lit(False)) & (before <= n))


def normalize_questions(raw: DataFrame) -> DataFrame:
    """Model questions to the contract: type and difficulty aliases, options re-keyed A.. by position, answers resolved.

    ``raw(quiz_id, question_no, type, difficulty, options array<struct<key, text>>, answer array<string>)``. An answer
    is an option's key, its upper-case key, a 0-based then 1-based position, or a judge synonym; others are dropped.
    """
    alias = lambda c, table, default: F.coalesce(*[F.when(F.lower(squeeze(c)).isin(*names), to) for to, names in table.items()], F.lit(default))
    kinds = {"single": ["single", "single_choice", "choice", "单选", "单选题"], "multiple": ["multiple", "multiple_choice", "multi", "多选", "多选题"], "judge": ["judge", "true_false", "判断", "判断题"]}
    levels = {"easy": ["easy", "simple", "beginner", "简单", "初级"], "medium": ["medium", "normal", "intermediate", "中等", "中级"], "hard": ["hard", "difficult", "advanced", "困难", "高级"]}
    options = F.transform("raw_options", lambda o, i: F.struct(F.chr(i + 65).alias("key"), o["text"].alias("text"), o["key"].alias("old")))
    kind = alias(F.col("raw_type"), kinds, "single")

    def resolve(a: Column) -> Column:
        by = lambda test: F.get(F.filter(options, test), F.lit(0))["key"]
        position = F.when(a.rlike("^[0-9]{1,2}$"), a.cast("int"))
        word = F.when(kind == "judge", by(lambda o: judge_text(o["text"]) == judge_text(a)))
        return F.coalesce(by(lambda o: o["old"] == a), by(lambda o: o["key"] == F.upper(a)), F.get(options, position)["key"], F.get(options, position - 1)["key"], word)

    answer = F.array_sort(F.array_distinct(F.array_compact(F.transform("raw_answer", resolve))))
    raw = raw.withColumnsRenamed({c: f"raw_{c}" for c in ("type", "difficulty", "options", "answer")})
    return raw.select(
        "quiz_id", "question_no", kind.alias("type"), alias(F.col("raw_difficulty"), levels, "medium").alias("difficulty"),
        F.map_from_entries(F.transform(options, lambda o: F.struct(o["key"], o["text"]))).alias("options"), answer.alias("answer"),
    )
