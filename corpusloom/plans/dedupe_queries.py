"""Queries of the duplicate operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import dedupe as D
from corpusloom.plans.registry import query
from corpusloom.plans.views import CHUNKS, WEB_SOURCES, chunks, table, web_sources
from corpusloom.sources.stages import staged

_CANON = r"""canon AS (
    SELECT *, CASE WHEN knowledge_type = 'table' OR knowledge_type = 'code' OR prose = '' THEN squeezed ELSE prose END AS canonical
    FROM (SELECT *, regexp_replace(lower(text), '[^0-9a-z\x{4e00}-\x{9fff}]+', '', 'g') AS prose, regexp_replace(text, '\s+', ' ', 'g') AS squeezed FROM chunks)
), dups AS (
    SELECT *, first_value(chunk_id) OVER (PARTITION BY sha256(canonical) ORDER BY authority_priority, document_id, child_index, chunk_id) AS first_id FROM canon
)"""


@query("exact_dedupe_d1", f"WITH {CHUNKS}, {_CANON} SELECT chunk_id, first_id AS duplicate_of, 'exact' AS kind FROM dups WHERE chunk_id <> first_id")
def exact_dedupe_d1(spark, sf_dir):
    return D.exact_dedupe(chunks(spark, sf_dir))[1]


_BITS = ", ".join(
    f"sum(CASE WHEN ({'hi' if b >= 32 else 'lo'} >> {b % 32}) & 1 = 1 THEN 1 ELSE -1 END) AS b{b}" for b in range(64)
)
_FP = " + ".join(f"(CASE WHEN b{b} >= 0 THEN {1 << b}::HUGEINT ELSE 0 END)" for b in range(64))
_SIMHASH = f"""items AS (
    SELECT item_id, regexp_replace(lower(text), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g') AS t FROM benchmark
    UNION ALL SELECT 1000000 + doc_id, regexp_replace(lower(text), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g') FROM documents
), grams AS (
    SELECT item_id, md5(substr(t, i, 5)) AS m FROM (SELECT item_id, t, unnest(generate_series(1, greatest(1, length(t) - 4))) AS i FROM items)
), halves AS (
    SELECT item_id, ('0x' || substr(m, 1, 8))::BIGINT AS hi, ('0x' || substr(m, 9, 8))::BIGINT AS lo FROM grams
), votes AS (SELECT item_id, {_BITS} FROM halves GROUP BY item_id),
fps AS (SELECT item_id, ({_FP})::UBIGINT AS fp FROM votes)"""


def _items(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", "text").unionByName(
        table(spark, sf_dir, "documents").select((F.col("doc_id") + 1_000_000).alias("item_id"), "text")
    )
    # The plain alphabet, without the fallback for empty forms, to keep the SQL short.
    prose = F.regexp_replace(F.lower("text"), f"[^0-9a-z{T.CJK}]+", "")
    return items.select("item_id", D.simhash64(prose).alias("fp"))


@query("simhash_d2", f"WITH {_SIMHASH} SELECT item_id, printf('%016x', fp) AS fingerprint FROM fps")
def simhash_d2(spark, sf_dir):
    return _items(spark, sf_dir).select("item_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"))


@query("near_pairs_d3", f"""WITH {_SIMHASH}, one AS (SELECT fp, min(item_id) AS item_id FROM fps GROUP BY fp)
SELECT a.item_id AS a, b.item_id AS b, bit_count(xor(a.fp, b.fp))::INTEGER AS distance FROM one a JOIN one b ON a.item_id < b.item_id AND a.fp >> 48 = b.fp >> 48
WHERE bit_count(xor(a.fp, b.fp)) <= 3""")
def near_pairs_d3(spark, sf_dir):
    one = staged(_items(spark, sf_dir).groupBy("fp").agg(F.min("item_id").alias("item_id")), "fingerprints")  # both sides of the join read it
    return D.near_pairs(one, key="item_id")


@query("greedy_dedupe_d4")
def greedy_dedupe_d4(spark, sf_dir):
    """No SQL: the resolution is sequential by definition; tests hold it against a sequential fold."""
    return D.dedupe(chunks(spark, sf_dir))[1]


@query("dup_ratio_d5", f"""WITH {CHUNKS}, {_CANON}, n AS (
    SELECT document_id, count(*) AS n_chunks, CAST(sum(CASE WHEN chunk_id <> first_id THEN 1 ELSE 0 END) AS BIGINT) AS n_duplicates FROM dups GROUP BY document_id)
SELECT *, n_duplicates / n_chunks AS ratio, CASE WHEN n_duplicates / n_chunks > 0.5 THEN 'duplicate_ratio_exceeded' WHEN n_duplicates > 0 THEN 'duplicate_content' END AS issue FROM n""")
def dup_ratio_d5(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return D.duplicate_ratio(c, D.exact_dedupe(c)[1])


@query("new_uploads_d6", """
WITH u AS (SELECT o_custkey AS user_id, sha256(concat_ws('-', o_orderstatus, o_orderpriority)) AS content_hash, o_orderkey AS upload_id FROM orders),
e AS (SELECT o_custkey AS user_id, sha256(concat_ws('-', 'F', o_orderpriority)) AS content_hash FROM orders WHERE o_totalprice > 200000)
SELECT user_id, content_hash, min(upload_id) AS upload_id FROM u WHERE (user_id, content_hash) NOT IN (SELECT user_id, content_hash FROM e) GROUP BY ALL""")
def new_uploads_d6(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    mark = lambda s: F.sha2(F.concat_ws("-", s, "o_orderpriority"), 256).alias("content_hash")
    uploads = o.select(F.col("o_custkey").alias("user_id"), mark(F.col("o_orderstatus")), F.col("o_orderkey").alias("upload_id"))
    existing = o.where("o_totalprice > 200000").select(F.col("o_custkey").alias("user_id"), mark(F.lit("F")))
    return D.new_uploads(uploads, existing)


@query("dedupe_evidence_d7", f"""WITH {CHUNKS}
SELECT corpus_version AS request_id, chunk_id FROM chunks
QUALIFY row_number() OVER (PARTITION BY corpus_version, left(lower(regexp_replace(text, '\\s+', ' ', 'g')), 500) ORDER BY doc_id, child_index) = 1""")
def dedupe_evidence_d7(spark, sf_dir):
    e = chunks(spark, sf_dir).select(F.col("corpus_version").alias("request_id"), F.struct("doc_id", "child_index").alias("pos"), "chunk_id", "text")
    return D.dedupe_evidence(e).select("request_id", "chunk_id")


_D8 = f"""WITH {WEB_SOURCES}, s AS (
    SELECT page_id, regexp_replace(lower(url), '#.*$', '') AS url_key, lower(trim(regexp_replace(title, '\\s+', ' ', 'g'))) AS title_key, excerpt,
           lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS request_id FROM web_sources WHERE length(excerpt) > 0
), u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY request_id, url_key ORDER BY length(excerpt) DESC, page_id) = 1),
t AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY request_id, CASE title_key WHEN '' THEN url_key ELSE title_key END ORDER BY length(excerpt) DESC, page_id) = 1)
SELECT request_id, page_id FROM t QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY page_id) <= 18"""


@query("source_dedupe_d8", _D8)
def source_dedupe_d8(spark, sf_dir):
    s = web_sources(spark, sf_dir).withColumn("request_id", T.url_site(F.col("url")))
    return D.dedupe_sources(s, pos="page_id").select("request_id", "page_id")


@query("merge_hits_d9", f"""WITH {CHUNKS}
SELECT technology AS query_id, chunk_id FROM chunks QUALIFY row_number() OVER (PARTITION BY technology, sha256(text) ORDER BY doc_id, child_index) = 1""")
def merge_hits_d9(spark, sf_dir):
    hits = chunks(spark, sf_dir).select(
        F.col("technology").alias("query_id"), "chunk_id", F.sha2("text", 256).alias("content_hash"), "parent_id", "document_id",
        F.struct("doc_id", "child_index").alias("pos"),
    )
    return D.merge_hits(hits).select("query_id", "chunk_id")


@query("question_diversity_d10")
def question_diversity_d10(spark, sf_dir):
    """No SQL for the sequence ratio; conversations are the quizzes."""
    q = table(spark, sf_dir, "conversations").where("role = 'user'").select(
        F.col("conv_id").alias("quiz_id"), F.col("turn").alias("pos"), F.col("text").alias("stem"),
        F.element_at(F.split("text", " "), 1).alias("knowledge_point"), F.col("text").alias("explanation"),
    )
    return D.diversity_errors(q)
