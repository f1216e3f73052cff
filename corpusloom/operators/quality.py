"""Quality review, batch reports, registry, approval and publication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import content_hash, strip

# Fixed values of the data contract.
REQUIRED = ["chunk_id", "document_id", "document_version", "corpus_version", "parent_id", "technology", "content_hash", "review_status", "status"]
PUBLIC_REQUIRED = [
    "chunk_id", "document_id", "document_version", "corpus_version", "parent_id", "technology", "role_tags", "knowledge_type",
    "document_hash", "parent_hash", "content_hash", "license_status", "review_status", "status",
]
STATUSES = ["unpublished", "published", "inactive", "withdrawn"]
REVIEW_MOJIBAKE = ["锟斤拷", "ï¿½", "�"]
LOOKS_LIKE_QUESTION = r"(?:什么|如何|怎么|为什么|为何|区别|原理|流程|作用|场景|哪些|是否|能否|何时|怎样|请(?:说明|解释)|谈谈)|(?i:(?:问题|question)\s*\d*\s*[:：])"
NOT_BLOCKING = ["low_structure_confidence", "duplicate_content"]


def _empty(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(True)
    c = F.col(name)
    none = F.size(c) <= 0 if dict(df.dtypes)[name].startswith("array") else c.cast("string") == ""
    return c.isNull() | none


def quality_issues(chunks: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Q1: ``(document_id, chunk_id, code, severity)``; a null document for an empty corpus."""
    text = strip(F.coalesce("text", F.lit("")))
    garbled = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in REVIEW_MOJIBAKE])
    issue = lambda test, code, severity="error": F.when(test, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    no_answer = (F.col("parent_type") == "question") & text.rlike(LOOKS_LIKE_QUESTION) & ~text.rlike("(?i)(?:答案|解答|解析|answer)") if "parent_type" in chunks.columns else F.lit(False)
    issues = F.array_compact(F.array(
        issue(F.length(text) < 20, "content_too_short"), issue(garbled, "possible_mojibake"),
        issue(_empty(chunks, "source_name") & _empty(chunks, "source_url"), "missing_source"), issue(_empty(chunks, "role_tags"), "missing_role_tags"),
        issue(F.coalesce(F.col("license_status"), F.lit("")) != "approved", "license_not_approved"),
        issue(F.coalesce(F.col("structure_confidence"), F.lit(0.0)) < threshold, "low_structure_confidence", "warning"),
        issue(no_answer, "answer_missing"), issue(reduce(lambda a, b: a | b, [_empty(chunks, c) for c in REQUIRED]), "metadata_incomplete"),
    ))
    rows = chunks.select("document_id", "chunk_id", F.explode(issues).alias("i")).select("document_id", "chunk_id", "i.*")
    own = lambda df, code: df.select("document_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(code).alias("code"), F.lit("error").alias("severity"))
    versions = chunks.groupBy("document_id").agg(F.count_distinct(F.coalesce("document_version", F.lit(""))).alias("n")).where("n > 1")
    none = chunks.agg(F.count(F.lit(1)).alias("n")).where("n = 0").withColumn("document_id", F.lit(None).cast("string"))
    return rows.unionByName(own(versions, "document_version_conflict")).unionByName(own(none, "no_chunks"))


def passed(issues: DataFrame) -> DataFrame:
    """Q1: whether no issue is an error."""
    return issues.agg((F.count(F.when(F.col("severity") == "error", 1)) == 0).alias("passed"))


def metadata_violations(chunks: DataFrame) -> DataFrame:
    """Q2: ``(chunk_id, violation)`` against the public contract."""
    rules = [F.when(_empty(chunks, c), f"missing_{c}") for c in PUBLIC_REQUIRED]
    rules.append(F.when(~F.coalesce(F.col("status").isin(STATUSES), F.lit(False)), "invalid_status"))
    local = F.col("license_status") == "local-evaluation-only"
    rules.append(F.when(local & (F.col("status") != "unpublished"), "local_only_published"))
    rules.append(F.when(~F.coalesce((F.col("license_status") == "approved") | local, F.lit(False)), "license_not_approved"))
    return chunks.select("chunk_id", F.explode(F.array_compact(F.array(*rules))).alias("violation"))


def batch_report(docs: DataFrame, chunks: DataFrame, duplicates: DataFrame, issues: DataFrame) -> DataFrame:
    """Q3: per document its chunks, duplicates, sorted issue codes and status."""
    n = lambda df, name: df.groupBy("document_id").agg(F.count(F.lit(1)).alias(name))
    codes = issues.groupBy("document_id").agg(F.array_sort(F.collect_set("code")).alias("issues"), F.max((F.col("severity") == "error").cast("int")).alias("bad"))
    rows = docs.select("document_id").join(n(chunks, "n_chunks"), "document_id", "left").join(n(duplicates, "n_duplicates"), "document_id", "left").join(codes, "document_id", "left")
    rows = rows.na.fill(0, ["n_chunks", "n_duplicates", "bad"])
    status = F.when(F.col("n_chunks") == 0, "failed").when(F.col("bad") == 1, "needs_review").otherwise("ready")
    return rows.select("document_id", "n_chunks", "n_duplicates", F.coalesce("issues", F.array().cast("array<string>")).alias("issues"), status.alias("status"))


def batch_id(sources: DataFrame, revision: str, max_sources: int = 1_000_000) -> DataFrame:
    """Q4: one id for a set of sources whatever their order: a sum of hashes, so no list is gathered."""
    mark = F.conv(F.left(F.sha2(F.concat_ws(":", "document_id", "document_version"), 256), F.lit(15)), 16, 10).cast("decimal(38,0)")
    return sources.agg(F.sum(mark).alias("s"), F.count(F.lit(1)).alias("n")).select(
        F.left(F.sha2(F.concat_ws(":", F.lit(revision), F.col("s").cast("string"), F.col("n").cast("string")), 256), F.lit(16)).alias("batch_id")
    )


def pending(docs: DataFrame, stages: DataFrame, stage: str) -> DataFrame:
    """Q5: the documents whose ``stage`` isn't complete; a failed one comes again."""
    done = stages.where((F.col("stage") == stage) & (F.col("status") == "completed")).select("document_id").distinct()
    return docs.join(done, "document_id", "left_anti")


def registry_latest(log: DataFrame, key: str = "corpus_version", order: str = "seq", kind: str | None = None) -> DataFrame:
    """Q6: the latest record per key of an append-only log, of one ``kind`` if given."""
    rows = log if kind is None else log.where(F.col("kind") == kind)
    rest = [c for c in log.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def active_version(log: DataFrame) -> DataFrame:
    """Q6: the version set active last, unless it was withdrawn since."""
    last = log.where(F.col("kind").isin("activate", "withdraw")).agg(F.max_by(F.struct("kind", "corpus_version"), "seq").alias("r"))
    return last.where("r.kind = 'activate'").select(F.col("r.corpus_version").alias("corpus_version"))


def approval_checks(candidates: DataFrame) -> DataFrame:
    """Q7: ``(corpus_version, rule, passed)``; ``candidates`` has one row a version with
    ``issues, n_failed, reviewer, override, gate_passed`` and ``review_*`` fields of the review artefact."""
    said = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    override = F.length(F.trim(F.coalesce("override", F.lit("")))) >= 8
    rules = {
        "no_blocking_issues": F.size(F.array_except("issues", F.array(*map(F.lit, NOT_BLOCKING)))) == 0, "no_failed_documents": F.col("n_failed") == 0,
        "reviewer_named": said("reviewer"), "override_long_enough": F.col("override").isNull() | override, "gate_passed_or_overridden": F.col("gate_passed") | override,
        "review_version_matches": F.col("review_version") == F.col("corpus_version"), "review_reviewer_matches": F.trim("review_reviewer") == F.trim("reviewer"),
        "review_dated": said("review_at"), "review_approves": F.lower("review_decision").isin("approved", "approve", "pass"), "review_reasoned": said("review_reason"),
        "review_has_samples": F.col("review_samples") > 0,
    }
    each = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in rules.items()])
    return candidates.select("corpus_version", F.explode(each).alias("r")).select("corpus_version", "r.*")


def publish(chunks: DataFrame, version: str, previous: str | None) -> tuple[DataFrame, DataFrame]:
    """Q8: the candidate's chunks published, the previous version inactive; unchanged if nothing would be published.

    The caller commits by writing the new table and moving the active pointer.
    """
    ready = chunks.where((F.col("corpus_version") == version) & (F.col("review_status") == "approved"))
    result = ready.agg(F.count(F.lit(1)).alias("n_published")).select(F.lit(version).alias("corpus_version"), "n_published", (F.col("n_published") > 0).alias("passed"))
    go = F.broadcast(result.select("passed"))  # one row
    new = F.when(~F.col("passed"), F.col("status")).when((F.col("corpus_version") == version) & (F.col("review_status") == "approved"), "published")
    new = new.when((F.col("corpus_version") == F.lit(previous)) & (F.col("status") == "published"), "inactive").otherwise(F.col("status"))
    return chunks.crossJoin(go).withColumn("status", new).drop("passed"), result


def withdraw(chunks: DataFrame, version: str) -> DataFrame:
    """Q9."""
    return chunks.withColumn("status", F.when(F.col("corpus_version") == version, "withdrawn").otherwise(F.col("status")))


def statistics(chunks: DataFrame) -> DataFrame:
    """Q9: documents, parents and chunks by version and status."""
    return chunks.groupBy("corpus_version", "status").agg(F.count_distinct("document_id").alias("n_documents"), F.count_distinct("parent_id").alias("n_parents"), F.count(F.lit(1)).alias("n_chunks"))


def legacy_review(chunks: DataFrame) -> DataFrame:
    """Q10: per chunk the reason for refusal, if any; and the hash of the document's chunk texts joined by blank lines."""
    reason = F.when(strip(F.coalesce("text", F.lit(""))) == "", "empty_text").when(F.coalesce("source_name", F.lit("")) == "", "missing_source")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("child_index", "text"))), lambda c: c["text"])
    hashes = chunks.groupBy("document_id").agg(F.sha2(F.array_join(texts, "\n\n"), 256).alias("document_hash"))
    return chunks.withColumn("reason", reason).join(hashes, "document_id")


def legacy_publish(reviewed: DataFrame) -> DataFrame:
    """Q10: accepted chunks with the public defaults filled in."""
    return reviewed.where("reason is null").drop("reason").withColumns({"status": F.lit("published"), "review_status": F.lit("approved"), "content_hash": content_hash(F.col("text"))})


def block_accounting(blocks: DataFrame, rejected: DataFrame) -> DataFrame:
    """Q11: parsed, rejected and assigned blocks per document."""
    n = lambda df, name: df.groupBy("document_id").agg(F.count(F.lit(1)).alias(name))
    rows = n(blocks, "parsed").join(n(rejected, "rejected"), "document_id", "left").na.fill(0, ["rejected"])
    return rows.withColumn("assigned", F.col("parsed") - F.col("rejected"))
