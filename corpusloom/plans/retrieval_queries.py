"""Queries of the retrieval operators: the benchmark texts against documents, and vectors against vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import retrieval as R
from corpusloom.operators import vector_index as V
from corpusloom.operators.dedupe import ORDER, first_texts
from corpusloom.plans.registry import query
from corpusloom.plans.views import CHUNKS, SOURCE_DOCS, WEB_SOURCES, chunks, docs_of, source_docs, table, web_sources


def bench_queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def units(spark, sf_dir):
    """Documents as retrieval units."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def qrels(spark, sf_dir):
    """Documents that contain a benchmark text: relevance 2."""
    return R.quoting(bench_queries(spark, sf_dir), units(spark, sf_dir)).select("query_id", "chunk_id", F.lit(2).alias("gain"))


QRELS = "qrels AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id, 2 AS gain FROM benchmark b, documents d WHERE contains(d.text, b.text))"


_EDGE = "[^\\p{L}\\p{N}_]"


def _rejoin(x: str) -> str:
    """Identifiers split at a capital are joined; twice, as a match uses up the character beside it."""
    for p in ("([a-z]+[A-Z])\\s+([a-z]+)", "([A-Z])\\s+([a-z]{2,})"):
        for _ in range(2):
            x = f"regexp_replace({x}, '(^|{_EDGE}){p}($|{_EDGE})', '\\1\\2\\3\\4', 'g')"
    return x


def _bm25_sql(source: str, k: int, name: str = "bm25") -> str:
    return f"""{name}_tok AS (SELECT chunk_id, regexp_extract_all(lower({_rejoin("text")}), '[a-z][a-z0-9_+.#:/\\-]*') AS t, lower({_rejoin("text")}) AS low FROM {source}),
{name}_docs AS (SELECT chunk_id, CASE WHEN len(t) = 0 THEN [low] ELSE t END AS t FROM {name}_tok),
{name}_tf AS (SELECT chunk_id, len(t) AS length, unnest(t) AS term FROM {name}_docs),
{name}_post AS (SELECT chunk_id, length, term, count(*) AS tf FROM {name}_tf GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_post GROUP BY term),
{name}_all AS (SELECT count(*) AS n, avg(len(t)) AS l FROM {name}_docs),
{name}_q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower({_rejoin("text")}), '[a-z][a-z0-9_+.#:/\\-]*')) AS term FROM benchmark),
{name}_s AS (SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / l))) AS score
    FROM {name}_post JOIN {name}_df USING (term) JOIN {name}_q USING (term), {name}_all GROUP BY query_id, chunk_id),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {name}_s
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) <= {k})"""


UNITS = "units AS (SELECT doc_id AS chunk_id, text FROM documents)"
VECTORS = "vectors AS (SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings)"


def _dense_sql(k: int, name: str = "dense") -> str:
    return f"""{name}_s AS (SELECT q.chunk_id AS query_id, v.chunk_id, list_cosine_similarity(q.e, v.e) AS score FROM vectors q, vectors v WHERE q.chunk_id % 100 = 0),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {name}_s
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) <= {k})"""


def bm25_hits(spark, sf_dir, k=50, **kw):
    return R.bm25_topk(bench_queries(spark, sf_dir), R.bm25_index(units(spark, sf_dir)), k, **kw)


def dense_inputs(spark, sf_dir):
    """Every vector whose id is divisible by 100 asks, all vectors answer."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return v.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), "embedding"), v


def dense_hits(spark, sf_dir, k=50):
    return R.dense_topk(*dense_inputs(spark, sf_dir), k)


_CLEANED = f"""{CHUNKS}, firsts AS (
    SELECT doc_id, text, child_index, first_value(chunk_id) OVER (PARTITION BY sha256(CASE WHEN knowledge_type IN ('table', 'code')
        OR regexp_replace(lower(text), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g') = '' THEN regexp_replace(text, '\\s+', ' ', 'g')
        ELSE regexp_replace(lower(text), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g') END) ORDER BY authority_priority, document_id, child_index, chunk_id) AS first_id, chunk_id FROM chunks
), kept AS (SELECT chunk_id, text FROM firsts WHERE chunk_id = first_id)"""


@query("flagship_slice", f"""WITH {_CLEANED}, {_bm25_sql('kept', 5)}, good AS (
    SELECT query_id, rank, CAST(contains(text, b.text) AS INTEGER) AS gain FROM bm25 JOIN kept USING (chunk_id) JOIN (SELECT item_id AS query_id, text FROM benchmark) b USING (query_id)
) SELECT query_id, max(gain) AS hit, coalesce(1 / min(CASE WHEN gain > 0 THEN rank END), 0) AS mrr, count(*) AS n_hits FROM good GROUP BY query_id""".replace("contains(text, b.text)", "contains(kept.text, b.text)"))
def flagship_slice(spark, sf_dir):
    """Documents to chunks, exact dedupe, BM25 for the benchmark texts, rank of the first chunk with the whole text."""
    lines = chunks(spark, sf_dir).select(*ORDER, "text", "knowledge_type")
    kept = first_texts(lines).select("chunk_id", "text")
    asked = bench_queries(spark, sf_dir)
    hits = R.bm25_topk(asked, R.bm25_index(kept), 5).select("query_id", "chunk_id", "rank")
    gain = F.contains("text", F.col("query")).cast("int")
    texts = lines.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")  # a hit's text is read again, not kept for all
    good = hits.join(texts, "chunk_id").join(asked, "query_id").select("query_id", "rank", gain.alias("gain"))
    return good.groupBy("query_id").agg(
        F.max("gain").alias("hit"), F.coalesce(1 / F.min(F.when(F.col("gain") > 0, F.col("rank"))), F.lit(0.0)).alias("mrr"), F.count(F.lit(1)).alias("n_hits")
    )


@query("term_overlap_r2", f"""WITH {CHUNKS}, t AS (SELECT DISTINCT item_id AS query_id, unnest(string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' ')) AS term FROM benchmark),
n AS (SELECT query_id, count(*) AS n FROM t GROUP BY query_id),
s AS (SELECT t.query_id, chunk_id, count(*) / n.n AS score FROM chunks JOIN t ON contains(lower(chunks.text), t.term) JOIN n USING (query_id) GROUP BY t.query_id, chunk_id, n.n)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) WHERE rank <= 10""")
def term_overlap_r2(spark, sf_dir):
    return R.overlap_topk(bench_queries(spark, sf_dir), chunks(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query("dense_topk_r3", f"WITH {VECTORS}, {_dense_sql(50)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM dense")
def dense_topk_r3(spark, sf_dir):
    return dense_hits(spark, sf_dir).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("dense_index_r3", f"WITH {VECTORS}, {_dense_sql(50)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM dense")
def dense_index_r3(spark, sf_dir):
    """The exact search through the index: some lists first, then only what the bounds leave."""
    q, v = dense_inputs(spark, sf_dir)
    return V.search(q, V.build_index(v), 50, exact=True)[0].select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("dense_probes_r3")
def dense_probes_r3(spark, sf_dir):
    """What a few probes find of the exact best ten, and the rows that each query reads for it."""
    q, v = dense_inputs(spark, sf_dir)
    index = V.build_index(v)
    near, work = V.search(q, index, 10, probes=8)
    best, _ = V.search(q, index, 10, exact=True)
    both = best.join(near.select("query_id", "chunk_id", F.lit(1).alias("seen")), ["query_id", "chunk_id"], "left")
    return both.groupBy("query_id").agg(F.avg(F.coalesce("seen", F.lit(0))).alias("recall")).join(work, "query_id")


@query("bm25_topk_r4", f"WITH {UNITS}, {_bm25_sql('units', 50)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM bm25")
def bm25_topk_r4(spark, sf_dir):
    return bm25_hits(spark, sf_dir).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("bm25_blocks_r4", f"WITH {UNITS}, {_bm25_sql('units', 50)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM bm25")
def bm25_blocks_r4(spark, sf_dir):
    """The same through blocks with bounds."""
    hits, _ = R.bm25_search(bench_queries(spark, sf_dir), R.bm25_index(units(spark, sf_dir)), 50)
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


_OVERLAP = """over_s AS (SELECT query_id, chunk_id, count(*) AS score FROM bm25_q JOIN bm25_post USING (term) GROUP BY query_id, chunk_id),
over AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM over_s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 50)"""


def channels(spark, sf_dir):
    """Two lexical channels over one index: BM25, and the number of shared terms."""
    index = R.bm25_index(units(spark, sf_dir))
    asked = bench_queries(spark, sf_dir)
    return R.bm25_topk(asked, index, 50), R.shared_topk(asked, index, 50)


_RRF = f"""{UNITS}, {_bm25_sql('units', 50)}, {_OVERLAP},
rrf AS (SELECT query_id, chunk_id, sum(1 / (60 + rank)) AS score FROM (SELECT query_id, chunk_id, rank FROM bm25 UNION ALL SELECT query_id, chunk_id, rank FROM over) GROUP BY query_id, chunk_id)"""


@query("rrf_r5", f"WITH {_RRF} SELECT query_id, chunk_id, round(score, 6) AS score FROM rrf")
def rrf_r5(spark, sf_dir):
    return R.rrf(*channels(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("scope_r6_r7", f"""WITH {SOURCE_DOCS} SELECT document_id, corpus_version FROM source_docs
WHERE license_status = 'approved' AND corpus_version = 'v1' AND (list_contains(role_tags, 'fr') OR list_contains(role_tags, 'general'))""")
def scope_r6_r7(spark, sf_dir):
    d = source_docs(spark, sf_dir).withColumn("status", F.col("license_status"))
    return d.where(R.scope(role="fr", status="approved", version="v1")).select("document_id", "corpus_version")


@query("rerank_r8", f"""WITH {_RRF} SELECT query_id, chunk_id, round(score * 30, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score * 30, 9) DESC, chunk_id) AS rank
FROM rrf WHERE score * 30 >= 0.5 QUALIFY rank <= 8""")
def rerank_r8(spark, sf_dir):
    fused = R.rrf(*channels(spark, sf_dir))
    return R.rerank(fused, F.col("score") * 30, 0.5, 8).withColumn("score", F.round("score", 6))


@query("parent_recovery_r9", f"""WITH {CHUNKS}, hits AS (SELECT min(chunk_id) AS chunk_id, parent_id, document_id, corpus_version FROM chunks GROUP BY ALL),
p AS (SELECT parent_id, document_id, corpus_version, left(string_agg(text, chr(10) ORDER BY child_index), 6000) AS parent_text FROM chunks GROUP BY ALL)
SELECT h.chunk_id, h.document_id, sha256(parent_text) AS parent_hash, parent_text IS NOT NULL AS parent_recovered FROM hits h LEFT JOIN p USING (parent_id, document_id, corpus_version)""")
def parent_recovery_r9(spark, sf_dir):
    c = chunks(spark, sf_dir)
    hits = c.groupBy("parent_id", "document_id", "corpus_version").agg(F.min("chunk_id").alias("chunk_id"))
    return R.recover_parents(hits, c).select("chunk_id", "document_id", F.sha2("parent_text", 256).alias("parent_hash"), "parent_recovered")


@query("document_scan_r10", f"""WITH {CHUNKS} SELECT document_id, list(chunk_id ORDER BY child_index) AS chunk_ids FROM chunks
WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY document_id""")
def document_scan_r10(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.concat(F.lit("d"), "doc_id").alias("document_id"))
    c = R.document_chunks(chunks(spark, sf_dir), toxic)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("child_index", "chunk_id"))), lambda x: x["chunk_id"])
    return c.groupBy("document_id").agg(ordered.alias("chunk_ids"))


@query("compound_queries_r11", """WITH t AS (SELECT page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages),
p AS (SELECT *, list_filter(list_transform(string_split_regex(title, '和|与|以及|同时|、|,|，|及'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts FROM t)
SELECT page_id, CASE WHEN len(parts) > 1 THEN len(list_distinct(list_concat([url], list_transform(parts, lambda x: concat(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), ' ', x))))) ELSE 1 END AS n_queries FROM p""")
def compound_queries_r11(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))
    return t.select("page_id", F.size(R.compound_queries(F.col("title"), F.col("url"))).cast("long").alias("n_queries"))


@query("select_query_r12", r"""WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
f AS (SELECT conv_id, arg_min(text, turn) AS topic, list(trim(text) ORDER BY turn) AS expanded FROM u GROUP BY conv_id),
x AS (SELECT conv_id, topic, unnest(expanded) AS q, generate_subscripts(expanded, 1) AS i FROM f),
ok AS (SELECT * FROM x WHERE q <> '' AND q <> trim(topic) AND len(list_filter(regexp_extract_all(lower(topic), '[a-z][a-z0-9_+#.\-]+'), lambda t: NOT contains(lower(q), t))) = 0)
SELECT f.conv_id, coalesce((SELECT arg_min(q, length(q) * 1000 + i) FROM ok WHERE ok.conv_id = f.conv_id), topic) AS query FROM f""")
def select_query_r12(spark, sf_dir):
    u = table(spark, sf_dir, "conversations").where("role = 'user'")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    f = u.groupBy("conv_id").agg(F.min_by("text", "turn").alias("topic"), ordered.alias("expanded"))
    return f.select("conv_id", R.select_query(F.col("topic"), F.col("expanded")).alias("query"))


@query("query_plans_r13")
def query_plans_r13(spark, sf_dir):
    u = table(spark, sf_dir, "conversations").where("role = 'user'")
    plans = u.groupBy(F.col("conv_id").alias("plan_id")).agg(
        F.min_by("text", "turn").alias("topic"), F.max_by("text", "turn").alias("canonical_topic"),
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("queries"),
    )
    good, bad = R.validate_plans(plans)
    return good.select("plan_id", "queries", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("plan_id", F.array().cast("array<string>").alias("queries"), "reason")
    )


def evidence(spark, sf_dir):
    """The BM25 hits of the benchmark texts as evidence."""
    hits, docs = docs_of(spark, sf_dir, bm25_hits(spark, sf_dir, 8))
    docs = docs.select(F.col("doc_id").alias("chunk_id"), "text", "technology", F.col("corpus_version").alias("version"), F.col("source_name").alias("source_type"), F.col("document_id").alias("citation"))
    return hits.join(docs, "chunk_id").select(
        F.col("query_id").alias("request_id"), F.col("rank").alias("pos"), "text", "technology", "version", "source_type", "citation",
        F.least(F.lit(1.0), F.round(F.col("score") / 100, 9)).alias("score"),
    )


@query("grade_evidence_r14")
def grade_evidence_r14(spark, sf_dir):
    topics = bench_queries(spark, sf_dir).select(F.col("query_id").alias("request_id"), F.col("query").alias("topic"))
    return R.grade_evidence(evidence(spark, sf_dir), topics)[1]


_EV = f"""{UNITS}, {_bm25_sql('units', 8)}, {SOURCE_DOCS}, ev AS (SELECT query_id AS request_id, rank AS pos, s.text, corpus_version AS version, source_name AS source_type, document_id AS citation,
    least(1, round(score / 100, 9)) AS score FROM bm25 JOIN source_docs s ON s.doc_id = chunk_id)"""


@query("evidence_confidence_r15", rf"""WITH {_EV}, per AS (SELECT request_id, max(score) AS top, string_agg(lower(text), ' ' ORDER BY pos) AS text FROM ev GROUP BY request_id),
q AS (SELECT item_id AS request_id, regexp_extract_all(lower(text), '[a-z][a-z0-9_+#.\-]+') AS terms FROM benchmark),
r AS (SELECT request_id, top, len(list_distinct(regexp_extract_all(text, '(?:v|version\s*)\d+(?:\.\d+)*|20\d{{2}}'))) > 1 AS conflict,
      CASE WHEN len(terms) = 0 THEN 0.5 ELSE len(list_filter(terms, lambda t: contains(text, t))) / len(terms) END AS coverage FROM q JOIN per USING (request_id))
SELECT request_id, coverage, conflict, CASE WHEN 0.7 * top + 0.3 * coverage >= 0.75 AND NOT conflict THEN 'high' WHEN 0.7 * top + 0.3 * coverage >= 0.45 THEN 'medium' ELSE 'low' END AS level FROM r""")
def evidence_confidence_r15(spark, sf_dir):
    topics = bench_queries(spark, sf_dir).select(F.col("query_id").alias("request_id"), F.col("query").alias("topic"))
    return R.evidence_confidence(evidence(spark, sf_dir), topics)


@query("slice_document_r16", f"""WITH RECURSIVE {CHUNKS}, c AS (SELECT document_id, length(text) AS size, row_number() OVER w - 1 AS p, count(*) OVER d AS n, sum(length(text)) OVER d AS whole FROM chunks
    WINDOW d AS (PARTITION BY document_id), w AS (PARTITION BY document_id ORDER BY child_index)),
m AS (SELECT *, greatest(2, least(n, 2000 // greatest(1, whole // n)))::INT AS slots FROM c),
g AS (SELECT *, whole <= 2000 OR list_contains(list_transform(range(0, slots), lambda k: round_even(k * (n - 1) / (slots - 1), 0)::BIGINT), p) AS even FROM m),
u AS (SELECT document_id, size, row_number() OVER (PARTITION BY document_id ORDER BY p) AS i FROM g WHERE NOT even),
f(document_id, i, room, size, fits) AS (SELECT document_id, 0::BIGINT, (2000 - sum(size))::BIGINT, 0::BIGINT, false FROM g WHERE even GROUP BY document_id
    UNION ALL SELECT u.document_id, u.i, CASE WHEN u.size <= f.room THEN f.room - u.size ELSE f.room END, u.size, u.size <= f.room FROM f JOIN u ON u.document_id = f.document_id AND u.i = f.i + 1)
SELECT document_id, count(*) AS n_chunks, sum(size)::BIGINT AS n_chars FROM (SELECT document_id, size FROM g WHERE even UNION ALL SELECT document_id, size FROM f WHERE fits) GROUP BY document_id""")
def slice_document_r16(spark, sf_dir):
    c = chunks(spark, sf_dir).select("document_id", "child_index", "text")
    return R.slice_document(c, 5000).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


@query("finalize_evidence_r17", f"""WITH {_EV} SELECT request_id, list_sort(list_distinct(list(source_type))) AS source_types, list(citation ORDER BY score DESC, pos) AS citations FROM ev GROUP BY request_id""")
def finalize_evidence_r17(spark, sf_dir):
    return R.finalize_evidence(evidence(spark, sf_dir))


@query("apply_relevance_r18", f"""WITH {WEB_SOURCES}, d AS (SELECT page_id, lower(regexp_extract(url, '://([^/:?#]*)', 1)) AS request_id, (page_id % 10) / 10 AS s FROM web_sources),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, page_id) AS rank FROM d WHERE s >= 0.75) SELECT request_id, page_id, rank FROM r WHERE rank <= 5""")
def apply_relevance_r18(spark, sf_dir):
    s = web_sources(spark, sf_dir).select(F.col("page_id").alias("source_id"), F.col("page_id").alias("pos"), F.lower(F.regexp_extract("url", "://([^/:?#]*)", 1)).alias("request_id"))
    decisions = s.select("source_id", F.lit(True).alias("keep"), (F.col("source_id") % 10 / 10).alias("relevance_score"))
    return R.apply_relevance(s, decisions).select("request_id", F.col("source_id").alias("page_id"), "rank")


def requests(spark, sf_dir):
    """User turns as requests; every third is a guest's, some ask for a document, some topics are urls."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    n = F.col("conv_id")
    return c.select(
        F.concat_ws("-", n, "turn").alias("request_id"), F.when(n % 7 == 0, F.lit("https://example.org/a")).otherwise(F.col("text")).alias("topic"),
        F.when(n % 3 != 0, n).alias("user_id"), F.when(n % 5 == 0, F.lit("doc")).alias("document_id"), (n % 11 == 0).alias("knowledge_only"),
        F.when(n % 2 == 0, "hard").otherwise("medium").alias("difficulty"),
    )


_REQ = """r AS (SELECT concat_ws('-', conv_id, turn) AS request_id, CASE WHEN conv_id % 7 = 0 THEN 'https://example.org/a' ELSE text END AS topic, conv_id % 3 = 0 AS guest,
    conv_id % 5 = 0 OR conv_id % 11 = 0 AS personal, conv_id % 7 = 0 AS url, conv_id % 2 = 0 AS hard, conv_id FROM conversations WHERE role = 'user')"""


@query("route_rules_r19", f"""WITH {_REQ} SELECT request_id, CASE WHEN guest THEN 'base_model' WHEN personal THEN 'personal_kb' WHEN url THEN 'web_extract' ELSE 'web_search' END AS route,
CASE WHEN guest THEN 0 WHEN personal OR url THEN 1 WHEN hard OR length(topic) > 40 THEN 4 ELSE 3 END AS max_tool_calls,
CASE WHEN guest THEN 0 WHEN personal OR url THEN 1 WHEN hard OR length(topic) > 40 THEN 4 ELSE 3 END AS n_tools FROM r""")
def route_rules_r19(spark, sf_dir):
    return R.route_requests(requests(spark, sf_dir)).select("request_id", "route", "max_tool_calls", F.size("tools").alias("n_tools"))


@query("route_violations_r19", f"""WITH {_REQ} SELECT request_id, unnest(list_filter([
    CASE WHEN url THEN 'url_with_keyword_search' END,
    CASE WHEN guest OR url OR conv_id % 11 = 0 THEN 'forbidden_tool' END, CASE WHEN personal THEN 'document_only_uses_web' END,
    CASE WHEN (CASE WHEN guest THEN 0 WHEN personal OR url THEN 1 WHEN hard OR length(topic) > 40 THEN 4 ELSE 3 END) < 2 THEN 'over_budget' END], lambda v: v IS NOT NULL)) AS violation FROM r""")
def route_violations_r19(spark, sf_dir):
    """Every request gets the decision to search the web with expansion."""
    req = requests(spark, sf_dir)
    policy = R.route_requests(req).select("request_id", "allowed_tools", F.col("max_tool_calls").alias("max_allowed_calls"))
    d = req.join(policy, "request_id").select(
        "*", F.col("topic").startswith("https://").alias("is_url"), F.array(F.lit("query_expansion"), F.lit("tavily_search")).alias("tools"),
        F.lit(True).alias("allow_public_web"), F.lit("web_search").alias("route"), F.lit(2).alias("max_tool_calls"),
    )
    return R.route_violations(d)


@query("heuristic_route_r20", f"""WITH {_REQ}, m AS (SELECT *, regexp_matches(lower(topic), '最新|当前|现在|最近|新版本|2024|2025|2026|latest|current|recent|new version|version') AS fresh,
    CASE WHEN hard OR length(topic) > 80 OR regexp_matches(topic, '对比|比较|原理|架构|tradeoff|compare') THEN 'complex' ELSE 'medium' END AS complexity FROM r)
SELECT request_id, CASE WHEN url THEN 'extract' WHEN fresh OR complexity = 'complex' OR len(string_split(regexp_replace(topic, '\\s+', ' ', 'g'), ' ')) > 2 THEN 'web_only' ELSE 'none' END AS route, complexity, url OR fresh AS needs_freshness,
CASE WHEN url THEN 2 WHEN fresh THEN 3 WHEN complexity = 'complex' OR len(string_split(regexp_replace(topic, '\\s+', ' ', 'g'), ' ')) > 2 THEN 2 ELSE 0 END AS max_tool_calls FROM m""")
def heuristic_route_r20(spark, sf_dir):
    return R.heuristic_route(requests(spark, sf_dir))


@query("retrieval_agreement_r22", f"""WITH {UNITS}, {_bm25_sql('units', 50)}, {_OVERLAP},
a AS (SELECT query_id, list(chunk_id) AS x FROM bm25 WHERE rank <= 5 GROUP BY query_id), b AS (SELECT query_id, list(chunk_id) AS y FROM over WHERE rank <= 5 GROUP BY query_id)
SELECT query_id, len(x)::INTEGER AS primary_count, len(y)::INTEGER AS secondary_count, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS agreement,
list_sort(list_filter(list_concat(x, y), lambda i: NOT (list_contains(x, i) AND list_contains(y, i)))) AS mismatch FROM a JOIN b USING (query_id)""")
def retrieval_agreement_r22(spark, sf_dir):
    return R.retrieval_agreement(*channels(spark, sf_dir))[0]


@query("web_rows_c20", f"""WITH {WEB_SOURCES} SELECT page_id, regexp_replace(url, '[.,;:!?)\\]}}>]+$', '') AS url, left(excerpt, 12000) AS excerpt, CASE WHEN page_id % 3 = 0 THEN 'partial' ELSE 'ok' END AS status
FROM web_sources WHERE regexp_matches(url, '^https?://[^/?#\\s]+')""")
def web_rows_c20(spark, sf_dir):
    s = web_sources(spark, sf_dir).withColumn("status", F.when(F.col("page_id") % 3 == 0, "partial").when(F.col("page_id") % 3 == 1, "strange"))
    return R.normalize_web_rows(s).select("page_id", "url", "excerpt", "status")
