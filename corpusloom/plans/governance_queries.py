"""Queries of sources and sinks, cleaning rules, quality and publication."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.operators import cleaning as C
from corpusloom.operators import practice as P
from corpusloom.operators import quality as Q
from corpusloom.operators.dedupe import exact_dedupe
from corpusloom.plans.dedupe_queries import _CANON
from corpusloom.plans.registry import query
from corpusloom.plans.views import CHUNKS, SOURCE_DOCS, chunks, source_docs, table
from corpusloom.sources import tables as S
from corpusloom.sources.snapshots import Snapshots, publish_version
from corpusloom.sources.stages import shared_folder


def governed(spark, sf_dir):
    """Chunks with the governance columns of the contract."""
    return chunks(spark, sf_dir).withColumns({
        "document_version": F.concat(F.lit("r"), F.col("child_index") % 2), "content_hash": F.sha2("text", 256), "document_hash": F.sha2("document_id", 256), "parent_hash": F.sha2("parent_id", 256),
        "review_status": F.when(F.col("license_status") == "approved", "approved").otherwise("pending"), "status": F.when(F.col("doc_id") % 5 == 0, "published").otherwise("unpublished"),
        "structure_confidence": F.when(F.col("knowledge_type") == "paragraph", 0.5).otherwise(0.99), "parent_type": F.col("knowledge_type"),
    })


@query("quality_issues_q1", f"""WITH {CHUNKS}
SELECT document_id, chunk_id, 'content_too_short' AS code, 'error' AS severity FROM chunks WHERE length(text) < 20 UNION ALL SELECT document_id, chunk_id, 'license_not_approved', 'error' FROM chunks WHERE license_status <> 'approved'
UNION ALL SELECT document_id, chunk_id, 'low_structure_confidence', 'warning' FROM chunks WHERE knowledge_type = 'paragraph'
UNION ALL SELECT document_id, NULL, 'document_version_conflict', 'error' FROM chunks GROUP BY document_id HAVING count(DISTINCT child_index % 2) > 1""")
def quality_issues_q1(spark, sf_dir):
    return Q.quality_issues(governed(spark, sf_dir))


@query("metadata_contract_q2", f"""WITH {CHUNKS} SELECT chunk_id, 'license_not_approved' AS violation FROM chunks WHERE license_status <> 'approved'""")
def metadata_contract_q2(spark, sf_dir):
    return Q.metadata_violations(governed(spark, sf_dir))


@query("batch_report_q3", f"""WITH {CHUNKS}, {_CANON}, n AS (SELECT document_id, count(*) AS n_chunks, count(CASE WHEN chunk_id <> first_id THEN 1 END) AS n_duplicates, count(DISTINCT child_index % 2) > 1 AS v,
    bool_or(length(text) < 20) AS s, bool_or(license_status <> 'approved') AS l, bool_or(knowledge_type = 'paragraph') AS p FROM dups GROUP BY document_id)
SELECT d.document_id, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_duplicates, 0) AS n_duplicates,
       list_filter([CASE WHEN s THEN 'content_too_short' END, CASE WHEN v THEN 'document_version_conflict' END, CASE WHEN l THEN 'license_not_approved' END, CASE WHEN p THEN 'low_structure_confidence' END], lambda x: x IS NOT NULL) AS issues,
       CASE WHEN n_chunks IS NULL THEN 'failed' WHEN s OR v OR l THEN 'needs_review' ELSE 'ready' END AS status FROM source_docs d LEFT JOIN n USING (document_id)""")
def batch_report_q3(spark, sf_dir):
    c = governed(spark, sf_dir)
    gone = exact_dedupe(c)[1].join(c.select("chunk_id", "document_id"), "chunk_id")
    return Q.batch_report(source_docs(spark, sf_dir), c, gone, Q.quality_issues(c))


@query("batch_id_q4", f"""WITH {SOURCE_DOCS} SELECT left(sha256(concat_ws(':', 'rev1', sum(('0x' || left(sha256(concat_ws(':', document_id, corpus_version)), 15))::BIGINT::HUGEINT)::VARCHAR, count(*)::VARCHAR)), 16) AS batch_id FROM source_docs""")
def batch_id_q4(spark, sf_dir):
    return Q.batch_id(source_docs(spark, sf_dir).withColumn("document_version", F.col("corpus_version")), "rev1")


@query("pending_q5", f"WITH {SOURCE_DOCS} SELECT document_id FROM source_docs WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def pending_q5(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), "doc_id").alias("document_id"), F.lit("parse").alias("stage"), F.when(F.col("quality") == 1, "completed").otherwise("failed").alias("status"))
    return Q.pending(source_docs(spark, sf_dir), done, "parse").select("document_id")


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "ingest").when(F.col("event_type") == "purchase", "activate").when(F.col("event_type") == "error", "withdraw").otherwise("preview")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("v"), F.col("user_id")).alias("corpus_version"), kind.alias("kind"), "value")


@query("latest_registry_q6", "SELECT concat('v', user_id) AS corpus_version, max(event_id) AS seq, arg_max(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY user_id")
def latest_registry_q6(spark, sf_dir):
    return Q.registry_latest(_log(spark, sf_dir), kind="ingest").select("corpus_version", "seq", "value")


@query("active_version_q6", "SELECT corpus_version FROM (SELECT concat('v', arg_max(user_id, event_id)) AS corpus_version, arg_max(event_type, event_id) AS t FROM events WHERE event_type IN ('purchase', 'error')) WHERE t = 'purchase'")
def active_version_q6(spark, sf_dir):
    return Q.active_version(_log(spark, sf_dir))


@query("approval_checks_q7", """SELECT concat('v', c_custkey) AS corpus_version, unnest(['no_blocking_issues', 'no_failed_documents', 'reviewer_named', 'override_long_enough', 'gate_passed_or_overridden', 'review_version_matches', 'review_reviewer_matches', 'review_dated', 'review_approves', 'review_reasoned', 'review_has_samples']) AS rule,
unnest([c_custkey % 2 = 0, c_custkey % 3 <> 0, true, c_custkey % 5 <> 0, c_custkey % 7 <> 0, true, c_custkey % 4 <> 0, true, c_mktsegment = 'BUILDING', true, c_custkey % 6 <> 0]) AS passed FROM customer""")
def approval_checks_q7(spark, sf_dir):
    i = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("v"), i).alias("corpus_version"), F.when(i % 2 == 0, F.array(F.lit("duplicate_content"))).otherwise(F.array(F.lit("content_too_short"))).alias("issues"), F.when(i % 3 == 0, 2).otherwise(0).alias("n_failed"),
        F.col("c_name").alias("reviewer"), F.when(i % 5 == 0, "short").alias("override"), (i % 7 != 0).alias("gate_passed"), F.concat(F.lit("v"), i).alias("review_version"),
        F.when(i % 4 == 0, "someone").otherwise(F.concat(F.col("c_name"), F.lit(" "))).alias("review_reviewer"), F.lit("2024-01-01").alias("review_at"), F.when(F.col("c_mktsegment") == "BUILDING", "Approved").otherwise("no").alias("review_decision"),
        F.lit("fine").alias("review_reason"), (i % 6).alias("review_samples"),
    )
    return Q.approval_checks(c)


_PUBLISHED = f"""WITH {CHUNKS} SELECT corpus_version, CASE WHEN corpus_version = 'v1' AND license_status = 'approved' THEN 'published' WHEN corpus_version = 'v0' AND doc_id % 5 = 0 THEN 'inactive' WHEN doc_id % 5 = 0 THEN 'published' ELSE 'unpublished' END AS status, count(*) AS n_chunks FROM chunks GROUP BY ALL"""


@query("publish_q8", _PUBLISHED)
def publish_q8(spark, sf_dir):
    return Q.publish(governed(spark, sf_dir), "v1", "v0")[0].groupBy("corpus_version", "status").agg(F.count(F.lit(1)).alias("n_chunks"))


@query("withdraw_stats_q9", f"""WITH {CHUNKS} SELECT corpus_version, CASE WHEN corpus_version = 'v1' THEN 'withdrawn' WHEN doc_id % 5 = 0 THEN 'published' ELSE 'unpublished' END AS status, count(DISTINCT document_id) AS n_documents, count(DISTINCT parent_id) AS n_parents, count(*) AS n_chunks FROM chunks GROUP BY ALL""")
def withdraw_stats_q9(spark, sf_dir):
    return Q.statistics(Q.withdraw(governed(spark, sf_dir), "v1"))


@query("legacy_review_q10", f"WITH {CHUNKS} SELECT document_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY child_index)) AS document_hash, count(*) AS n FROM chunks GROUP BY document_id")
def legacy_review_q10(spark, sf_dir):
    done = Q.legacy_publish(Q.legacy_review(chunks(spark, sf_dir)))
    return done.groupBy("document_id", "document_hash").agg(F.count(F.lit(1)).alias("n")).select("document_id", "document_hash", "n")


@query("block_accounting_q11", f"WITH {CHUNKS} SELECT document_id, count(*) AS parsed, count(CASE WHEN length(text) < 20 THEN 1 END) AS rejected, count(CASE WHEN length(text) >= 20 THEN 1 END) AS assigned FROM chunks GROUP BY document_id")
def block_accounting_q11(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return Q.block_accounting(c, c.where("length(text) < 20"))


@query("manifest_s1", f"WITH {SOURCE_DOCS} SELECT document_id, 'path_required' AS violation FROM source_docs WHERE doc_id % 7 = 0 UNION ALL SELECT document_id, 'bad_priority' FROM source_docs WHERE authority_priority > 15")
def manifest_s1(spark, sf_dir):
    d = source_docs(spark, sf_dir)
    m = d.select(
        "document_id", F.when(F.col("doc_id") % 7 != 0, F.col("document_id")).alias("path"), "source_name", F.lit("https://example.org").alias("source_url"), "technology", "role_tags", F.col("corpus_version").alias("document_version"),
        F.lit(None).cast("string").alias("language"), F.lit("markdown").alias("content_type"), "license_status", F.lit("v1").alias("target_corpus_version"),
        F.when(F.col("authority_priority") > 15, 5000).otherwise(F.col("authority_priority")).alias("authority_priority"), F.lit(True).alias("enabled"),
    )
    return S.check_manifest(m)[1].select("document_id", "violation")


@query("upsert_s7", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.5 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT o_orderkey + 100000000, 2.5 FROM orders WHERE o_orderstatus = 'P'")
def upsert_s7(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    delta = o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit(1.5).alias("o_totalprice")).unionByName(o.where("o_orderstatus = 'P'").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), F.lit(2.5).alias("o_totalprice")))
    return S.upsert(o.select("o_orderkey", "o_totalprice"), delta, ["o_orderkey"])


_REPLACED = f"WITH {CHUNKS} SELECT document_id, chunk_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT concat('d', doc_id), 'new' FROM labels WHERE toxic = 1"


@query("replace_document_s8", _REPLACED)
def replace_document_s8(spark, sf_dir):
    c = chunks(spark, sf_dir).select("document_id", "chunk_id").withColumn("owner_id", F.lit(0))
    new = table(spark, sf_dir, "labels").where("toxic = 1").select(F.concat(F.lit("d"), "doc_id").alias("document_id"), F.lit("new").alias("chunk_id"), F.lit(0).alias("owner_id"))
    return S.replace_document(c, new).select("document_id", "chunk_id")


@query("scalar_query_s9", f"WITH {SOURCE_DOCS} SELECT document_id FROM source_docs WHERE technology = 'fr' AND license_status = 'approved'")
def scalar_query_s9(spark, sf_dir):
    return S.query(source_docs(spark, sf_dir), {"technology": "fr", "license_status": "approved"}, limit=None).select("document_id")


@query("update_where_s10", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_where_s10(spark, sf_dir):
    return S.update_where(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_totalprice") > 100000, o_orderstatus="X")[0].drop("o_totalprice")


@query("delete_where_s11", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def delete_where_s11(spark, sf_dir):
    return S.delete_where(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F").select("o_orderkey")


@query("backfill_s12", "SELECT vec_id::VARCHAR AS pk, concat('t', label) AS text, len(embedding)::INTEGER AS dim FROM embeddings WHERE vec_id % 4 <> 0")
def backfill_s12(spark, sf_dir):
    old = table(spark, sf_dir, "embeddings").select(F.lit(None).cast("string").alias("pk"), F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 4 != 0, F.concat(F.lit("t"), "label")).alias("evidence_text"), F.lit("").alias("text"), F.col("embedding").alias("vector"))
    return S.backfill_hybrid(old).select("pk", "text", F.size("vector").alias("dim"))


@query("index_rows_s13", f"WITH {CHUNKS} SELECT chunk_id, concat('|', array_to_string(list_sort(role_tags), '|'), '|') AS role_tags, -1 AS page_start, corpus_version, sha256(text) AS text_hash FROM chunks")
def index_rows_s13(spark, sf_dir):
    return S.to_index_rows(chunks(spark, sf_dir)).select("chunk_id", "role_tags", "page_start", "corpus_version", F.sha2("evidence_text", 256).alias("text_hash"))


@query("redact_keys_c16", """SELECT event_id, '[REDACTED]' AS api_key, event_type AS topic, '[REDACTED]' AS inner_token, '[REDACTED]' AS map_password, concat('n', user_id) AS map_name FROM events""")
def redact_keys_c16(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "event_id", F.col("event_type").alias("api_key"), F.col("event_type").alias("topic"), F.struct(F.col("event_type").alias("auth_token")).alias("inner"),
        F.create_map(F.lit("password"), F.col("event_type"), F.lit("name"), F.concat(F.lit("n"), F.col("user_id"))).alias("m"),
    )
    return C.redact(e).select("event_id", "api_key", "topic", F.col("inner.auth_token").alias("inner_token"), F.col("m")["password"].alias("map_password"), F.col("m")["name"].alias("map_name"))


@query("credential_scan_c17", r"SELECT doc_id, 'text' AS field, 'credential_like_text' AS reason FROM documents WHERE regexp_matches(text, '(?i)(?:api[_-]?key|password|authorization|openid)\s*[:=]\s*\S+|bearer\s+[A-Za-z0-9._-]{12,}') UNION ALL SELECT doc_id, 'cookie', 'sensitive_key' FROM documents WHERE source = 'src1'")
def credential_scan_c17(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.create_map(F.lit("text"), F.col("text"), F.lit("cookie"), F.when(F.col("source") == "src1", F.col("source")).otherwise(" ")).alias("fields"))
    return C.credential_violations(d, "doc_id")


@query("image_routes_c24", rf"""WITH {CHUNKS}, b AS (SELECT chunk_id, lower(regexp_extract(concat('media/', text, '.png'), '([^/]*?)(?:\.[^./]*)?$', 1)) AS name, knowledge_type AS kind, lower(trim(text)) AS caption, corpus_version = 'v0' AND child_index > 9 AS scanned FROM chunks)
SELECT chunk_id, CASE WHEN r LIKE 'd%name' THEN 'skip' WHEN r IN ('scanned_pdf_page', 'default_ocr') THEN 'ocr' ELSE 'visual' END AS mode, r AS reason FROM (SELECT chunk_id, CASE WHEN regexp_matches(name, 'logo|avatar|icon|decoration|背景') THEN 'decorative_filename'
WHEN scanned THEN 'scanned_pdf_page' WHEN kind = 'table' THEN 'structured_node:table' WHEN regexp_matches(caption, '{"|".join(C.VISUAL_HINTS)}') THEN 'caption_or_context_hint' WHEN regexp_matches(name, 'chart|flow|table|figure|diagram') THEN 'filename_fallback' ELSE 'default_ocr' END AS r FROM b)""")
def image_routes_c24(spark, sf_dir):
    """Chunks as images that are named and captioned by their text."""
    scanned = (F.col("corpus_version") == "v0") & (F.col("child_index") > 9)
    b = chunks(spark, sf_dir).select(
        "chunk_id", F.concat(F.lit("media/"), "text", F.lit(".png")).alias("path"), F.col("knowledge_type").alias("kind"), F.lit(None).cast("string").alias("layout_type"),
        F.col("text").alias("caption"), F.when(scanned, "scanned_pdf_page").alias("source_type"),
    )
    return C.image_route(b).select("chunk_id", "mode", "reason")


@query("table_checks_c25", """WITH d AS (SELECT l_orderkey AS id, list(CASE l_returnflag WHEN 'A' THEN ['x'] ELSE ['x', 'y'] END) AS rows, list(l_quantity::INT) AS seen, list(l_linenumber) AS read FROM lineitem WHERE l_orderkey % 2 = 1 OR l_returnflag <> 'A' GROUP BY l_orderkey)
SELECT id, reason IS NULL AS valid, reason FROM (SELECT id, CASE WHEN len(list_filter(rows, lambda r: len(r) <> 2)) > 0 THEN 'row_width' WHEN NOT list_has_any(seen, read) THEN 'no_number_agrees' END AS reason FROM d)""")
def table_checks_c25(spark, sf_dir):
    """An order as a table of its lines: quantities were seen, line numbers read."""
    l = table(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 1 or l_returnflag <> 'A'")
    number = lambda c: F.col(c).cast("int").cast("string")
    d = l.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.collect_list(F.when(F.col("l_returnflag") == "A", F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), F.lit("y")))).alias("rows"),
        F.collect_list(F.concat(F.lit("value "), number("l_quantity"))).alias("elements"), F.array_join(F.collect_list(number("l_linenumber")), " and ").alias("ocr_text"),
    )
    d = d.withColumns({"headers": F.array(F.lit("a"), F.lit("b")), "confidence": F.lit(1.7)})
    return C.visual_valid(d).select("id", "valid", "reason")


@query("read_markdown_s2", "SELECT sha256(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS text_hash, count(*) AS n FROM benchmark GROUP BY ALL")
def read_markdown_s2(spark, sf_dir):
    """The benchmark texts, written as a file each and read back."""
    root = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string"), "text").repartition("item_id").write.partitionBy("item_id").text(root)
    return S.read_markdown(spark, f"{root}/*/*.txt").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("n"))


@query("file_types_s3", """WITH f AS (SELECT page_id, regexp_extract(url, '[a-z]+$') AS tail, length(html) AS n FROM pages)
SELECT page_id, CASE WHEN e IS NULL THEN CASE k WHEN 'md' THEN 'markdown' ELSE k END END AS logical_type, e AS error FROM (SELECT page_id, k, CASE WHEN k = 'exe' THEN 'extension_not_allowed' WHEN k = 'pdf' AND page_id % 2 = 1 THEN 'magic_mismatch' END AS e
FROM (SELECT page_id, CASE WHEN tail = 'html' THEN 'pdf' WHEN tail = 'top' THEN 'exe' ELSE 'md' END AS k FROM f))""")
def file_types_s3(spark, sf_dir):
    """Pages as uploads whose extension follows from how their url ends; half of the PDFs begin as such."""
    tail = F.regexp_extract("url", "[a-z]+$", 0)
    kind = F.when(tail == "html", "pdf").when(tail == "top", "exe").otherwise("md")
    opening = F.when((kind == "pdf") & (F.col("page_id") % 2 == 0), "%PDF-").otherwise("")
    files = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("up/"), "page_id", F.lit("."), kind).alias("path"), F.when(kind == "pdf", "application/pdf").otherwise("application/octet-stream").alias("mime"),
        F.encode(F.concat(opening, "html"), "utf-8").alias("content"),
    )
    return S.detect_file_types(files).select(F.regexp_extract("path", "[0-9]+", 0).cast("long").alias("page_id"), "logical_type", "error")


_BATCHES = f"WITH {CHUNKS} SELECT chunk_id, concat('b', authority_priority % 3) AS batch_id, sha256(CASE authority_priority % 3 WHEN 1 THEN concat('new ', text) ELSE text END) AS text_hash FROM chunks WHERE authority_priority % 3 < 2"


@query("staged_batches_s6", _BATCHES)
def staged_batches_s6(spark, sf_dir):
    """Chunks by batch; one batch is written again, which replaces it and no other; two of them are read."""
    root = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    c = chunks(spark, sf_dir).select("document_id", "chunk_id", "text", F.concat(F.lit("b"), F.col("authority_priority") % 3).alias("batch_id"))
    S.write_stage(c, root, "chunks")
    S.write_stage(c.where("batch_id = 'b1'").withColumn("text", F.concat(F.lit("new "), "text")), root, "chunks")
    both = S.read_stage(spark, root, "chunks", "b0").unionByName(S.read_stage(spark, root, "chunks", "b1"))
    return both.select("chunk_id", "batch_id", F.sha2("text", 256).alias("text_hash"))


@query("staged_commits_s6", _BATCHES)
def staged_commits_s6(spark, sf_dir):
    """The same on a table of commits, each batch a part: the second write is a version of its own."""
    c = chunks(spark, sf_dir).select("document_id", "chunk_id", "text", F.concat(F.lit("b"), F.col("authority_priority") % 3).alias("batch_id"))
    held = Snapshots(spark, f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}", "batch_id")
    held.replace(c)
    held.replace(c.where("batch_id = 'b1'").withColumn("text", F.concat(F.lit("new "), "text")))
    return held.read(parts=["b0", "b1"]).select("chunk_id", "batch_id", F.sha2("text", 256).alias("text_hash"))


@query("replace_commits_s8", _REPLACED)
def replace_commits_s8(spark, sf_dir):
    """The same as a commit on a table divided by buckets of documents, of which only those of the delta are read and written."""
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(16)).cast("int").alias("bucket")
    c = chunks(spark, sf_dir).select("document_id", "chunk_id", F.lit(0).alias("owner_id"), bucket)
    new = table(spark, sf_dir, "labels").where("toxic = 1").select(F.concat(F.lit("d"), "doc_id").alias("document_id"), F.lit("new").alias("chunk_id"), F.lit(0).alias("owner_id"))
    new = new.select("*", bucket)
    held = Snapshots(spark, f"{shared_folder(spark)}/documents-{uuid.uuid4().hex}", "bucket")
    held.replace(c)
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most 16
    held.update(touched, lambda rows: S.replace_document(rows, new), c.schema)
    return held.read().select("document_id", "chunk_id")


@query("publish_commit_q8", _PUBLISHED)
def publish_commit_q8(spark, sf_dir):
    """The same as one commit on a table divided by version: the active one first, then the candidate, with a look at what readers would see."""
    rows = governed(spark, sf_dir)
    held = Snapshots(spark, f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", "corpus_version")
    held.replace(rows, note={"active": "v0"})
    done = publish_version(held, "v1", lambda seen: not seen.where("corpus_version = 'v1' and status = 'published'").isEmpty())
    assert done["passed"] and held.entry()["note"] == {"active": "v1", "previous": "v0"}
    return held.read().groupBy("corpus_version", "status").agg(F.count(F.lit(1)).alias("n_chunks"))


@query("records_s14", "SELECT conv_id, turn, text FROM conversations")
def records_s14(spark, sf_dir):
    return S.to_record(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("evidence_text")))


@query("envelope_s15", """WITH m AS (SELECT event_type AS metric, count(*)::DOUBLE AS value FROM events GROUP BY event_type)
SELECT metric, value, (SELECT list_sort(list(metric)) FROM m WHERE value < (SELECT avg(value) FROM m)) AS failed_gates, 'v1' AS version FROM m""")
def envelope_s15(spark, sf_dir):
    """Event counts as metrics, those under their mean as failed gates; the envelope is parsed again."""
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    gates = m.join(F.broadcast(m.agg(F.avg("value").alias("mean"))), F.col("value") < F.col("mean"))  # one row
    shape = "metadata map<string, string>, metrics map<string, double>, failed_gates array<string>"
    e = S.evaluation_envelope(m, gates, {"version": "v1"}).select(F.from_json("json", shape).alias("e"))
    return e.select(F.explode("e.metrics").alias("metric", "value"), "e.failed_gates", F.col("e.metadata")["version"].alias("version"))


@query("upsert_answers_u14", """SELECT user_id, question, arg_max(event_id, event_id) AS event_id FROM (SELECT user_id, event_type AS question, event_id FROM events) GROUP BY ALL""")
def upsert_answers_u14(spark, sf_dir):
    """Answer records by (user, question): those of even events stand, all are written over them, the last counts."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("question"), "event_id")
    none = e.where("false")
    first = S.upsert(none, e.where("event_id % 2 = 0"), ["user_id", "question"], "event_id")
    return S.upsert(first, e, ["user_id", "question"], "event_id")


@query("document_status_u15", """WITH d AS (SELECT o_orderkey AS document_id, o_orderstatus AS s, o_custkey AS c FROM orders)
SELECT document_id, CASE WHEN s = 'F' THEN 'ready' WHEN s = 'O' THEN 'failed' WHEN c % 2 = 0 THEN 'processing' ELSE 'ready' END AS status, CASE WHEN s = 'F' THEN c ELSE 0 END AS chunk_count,
CASE WHEN s = 'O' THEN left(repeat(concat(c, ' '), 200), 500) WHEN s = 'P' AND c % 2 = 1 THEN 'old' END AS error FROM d""")
def document_status_u15(spark, sf_dir):
    """Orders as documents: F became ready, O failed, P is reset, which only failed ones take."""
    o = table(spark, sf_dir, "orders")
    docs = o.select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_custkey") % 2 == 0, "failed").otherwise("ready").alias("status"), F.lit(0).cast("long").alias("chunk_count"), F.lit("old").alias("error"))
    kind = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "failed").otherwise("reset")
    done = o.select(F.col("o_orderkey").alias("document_id"), kind.alias("outcome"), F.col("o_custkey").cast("long").alias("chunk_count"), F.repeat(F.concat("o_custkey", F.lit(" ")), F.lit(200)).alias("reason"))
    return P.document_status(docs, done)


@query("page_profiles_c26", """WITH p AS (SELECT o_custkey AS document_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 100 END AS chars FROM orders)
SELECT document_id, count(*) AS n_pages, CASE WHEN count(CASE WHEN chars = 0 THEN 1 END) / count(*) >= 0.7 THEN 'scanned_pdf' WHEN min(chars) < 30 THEN 'mixed_pdf' ELSE 'text_pdf' END AS content_profile, sum(chars) / count(*) AS density, sum(chars) > 0 AND sum(chars) / count(*) < 30 AS low_density FROM p GROUP BY document_id""")
def page_profiles_c26(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_orderkey") % 100).alias("chars"))
    return C.page_profiles(p)[1]
