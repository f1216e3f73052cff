"""Queries of the structuring operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.text import clean_public_text
from corpusloom.operators import structure as K
from corpusloom.operators.dedupe import exact_dedupe
from corpusloom.plans.registry import query
from corpusloom.plans.views import table, web_sources


def pages(spark, sf_dir):
    """Conversations as documents, their turns as pages under a common head line."""
    return table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("document_id"), F.col("turn").cast("int").alias("page"), F.concat(F.lit("Head line\n"), "text").alias("text"))


@query("page_edges_c3", r"""WITH p AS (SELECT concat('c', conv_id) AS document_id, turn::INT AS page, 'Head line' || chr(10) || text AS text FROM conversations),
l AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS lines FROM p), n AS (SELECT document_id, count(*) AS n FROM p GROUP BY ALL),
e AS (SELECT document_id, unnest([lines[1], lines[-1]]) AS line FROM l), d AS (SELECT document_id, list(line) AS dropped FROM (SELECT document_id, line, n, count(*) AS k FROM e JOIN n USING (document_id) GROUP BY ALL) WHERE n >= 3 AND k >= greatest(3, floor(n * 0.6)) AND length(line) < 120 GROUP BY document_id)
SELECT document_id, page, sha256(CASE WHEN dropped IS NULL THEN text ELSE array_to_string(list_filter(lines, lambda s: NOT list_contains(dropped, s)), chr(10)) END) AS text_hash, dropped IS NOT NULL AS edges_removed FROM l LEFT JOIN d USING (document_id)""")
def page_edges_c3(spark, sf_dir):
    return K.remove_page_edges(pages(spark, sf_dir)).select("document_id", "page", F.sha2("text", 256).alias("text_hash"), "edges_removed")


def marked(spark, sf_dir):
    """Documents with every line as its own piece, so that headings and tables appear."""
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("document_id"), F.regexp_replace("text", "\n", "\n\n").alias("text"))


@query("block_kinds_c4", r"""WITH p AS (SELECT concat('d', doc_id) AS document_id, regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') AS v FROM documents)
SELECT document_id, CASE WHEN regexp_matches(v, '^#{1,6}\s+[^\n]+$') THEN 'heading' WHEN regexp_matches(v, '^```.*```$') THEN 'code' WHEN regexp_matches(v, '^\$\$.*\$\$$') THEN 'formula'
WHEN regexp_matches(v, '!\[[^\]]*\]\([^)]+\)') THEN 'image' WHEN regexp_matches(v, '^(?:[-*+] |\d+[.)] )') THEN 'list' ELSE 'paragraph' END AS kind, count(*) AS n FROM p WHERE v <> '' GROUP BY ALL""")
def block_kinds_c4(spark, sf_dir):
    return K.segment_blocks(marked(spark, sf_dir)).groupBy("document_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("section_paths_c5")
def section_paths_c5(spark, sf_dir):
    return K.segment_blocks(marked(spark, sf_dir)).select("document_id", "block_index", "start_index", F.array_join("section_path", " > ").alias("section"))


def raw_blocks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("c"), "conv_id").alias("document_id"), F.col("turn").cast("int").alias("block_index"), F.when(F.col("turn") % 4 != 3, F.col("text")).alias("text"),
        F.when(F.col("role") == "user", "paragraph").otherwise("image").alias("kind"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit("m/"), "turn", F.lit(".png"))).alias("media_path"),
    )


@query("finalize_blocks_c6", r"""WITH r AS (SELECT concat('c', conv_id) AS document_id, turn::INT AS block_index, CASE WHEN turn % 4 <> 3 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') ELSE '' END AS t, role <> 'user' AS img, turn FROM conversations),
f AS (SELECT *, CASE WHEN t = '' AND img THEN concat('[image: m/', turn, '.png]') ELSE t END AS text FROM r)
SELECT document_id, block_index, sha256(text) AS text_hash, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY document_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_index FROM f WHERE text <> ''""")
def finalize_blocks_c6(spark, sf_dir):
    return K.finalize_blocks(raw_blocks(spark, sf_dir))[0].select("document_id", "block_index", F.sha2("text", 256).alias("text_hash"), "start_index")


@query("kind_map_c7", "SELECT event_id, CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN 'heading' WHEN 'purchase' THEN 'formula' ELSE 'paragraph' END AS kind FROM events")
def kind_map_c7(spark, sf_dir):
    raw = F.when(F.col("event_type") == "click", "page_number").when(F.col("event_type") == "view", "Title").when(F.col("event_type") == "purchase", "equation").otherwise("strange")
    return table(spark, sf_dir, "events").select("event_id", K.normalize_kind(raw).alias("kind"))


@query("image_merge_c27")
def image_merge_c27(spark, sf_dir):
    b = raw_blocks(spark, sf_dir)
    a = b.where("media_path is not null").select("document_id", F.when(F.col("block_index") == 1, F.col("media_path")).otherwise(F.concat(F.lit("x/"), F.col("media_path"))).alias("path"), F.lit("analysed").alias("analysis"))
    return K.merge_image_blocks(b, a).select("document_id", "block_index", F.sha2("text", 256).alias("text_hash"), "appended")


@query("page_offsets_c28", """SELECT concat('c', conv_id) AS document_id, turn::INT AS page, CAST(coalesce(sum(length(text) + 12) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_index FROM conversations""")
def page_offsets_c28(spark, sf_dir):
    return K.page_offsets(pages(spark, sf_dir)).select("document_id", "page", "start_index")


def _parents(spark, sf_dir):
    blocks = K.segment_blocks(marked(spark, sf_dir)).withColumns({"page_start": (F.col("block_index") / 4).cast("int"), "page_end": (F.col("block_index") / 4).cast("int")})
    return K.assemble_parents(blocks)


@query("split_qa_k2")
def split_qa_k2(spark, sf_dir):
    blocks = K.segment_blocks(marked(spark, sf_dir)).where("kind = 'paragraph'")
    return K.split_qa(blocks).groupBy("document_id", "parent_type").agg(F.count(F.lit(1)).alias("n"))


@query("assemble_parents_k3")
def assemble_parents_k3(spark, sf_dir):
    return _parents(spark, sf_dir)[0].groupBy("document_id", "parent_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query("parent_ids_k4", r"""WITH d AS (SELECT doc_id, text, sha256(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS content_hash FROM documents)
SELECT doc_id AS document_id, content_hash, sha256(concat_ws(':', doc_id, 'v1', 0, content_hash)) AS parent_id, left(regexp_replace(regexp_replace(string_split(text, chr(10))[1], '^\s+|\s+$', '', 'g'), '(?i)^(?:问题|Q\d*)\s*[:：]?', ''), 200) AS title FROM d""")
def parent_ids_k4(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text", F.lit("v1").alias("document_version"), F.lit(0).alias("parent_index"))
    return K.with_parent_ids(d).select("document_id", "content_hash", "parent_id", "title")


@query("cover_check_k5", """WITH u AS (SELECT l_orderkey AS d, l_linenumber AS s, l_linenumber + 1 AS e FROM lineitem GROUP BY ALL), o AS (SELECT *, lag(e) OVER w AS b, lead(s) OVER w AS a FROM u WINDOW w AS (PARTITION BY d ORDER BY s, e))
SELECT d AS document_id, s AS start, 'gap_or_overlap' AS violation FROM o WHERE s <> coalesce(b, 0) UNION ALL SELECT d, s, 'wrong_end' FROM o WHERE a IS NULL AND e <> 8""")
def cover_check_k5(spark, sf_dir):
    u = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("start"), (F.col("l_linenumber") + 1).alias("end")).distinct()
    return K.cover_violations(u.withColumn("type", F.lit("qa")).withColumn("text_length", F.lit(8)))


def whole(spark, sf_dir, kind="paragraph"):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("parent_id"), F.col("doc_id").cast("string").alias("document_id"), F.lit(kind).alias("parent_type"), "text")


@query("line_windows_k7", r"""WITH RECURSIVE t AS (SELECT doc_id AS d, text, string_split(text, chr(10)) AS v FROM documents), l AS (SELECT d, text, len(v) AS c, unnest(v) AS s, generate_subscripts(v, 1) AS i FROM t WHERE length(text) > 850),
e AS (SELECT d, i, sum(size) OVER w AS b, sum(size) OVER w - size AS a, max(i) OVER (PARTITION BY d) AS n FROM (SELECT d, i, length(s) + (i < c)::INT AS size FROM l WHERE s <> '' OR i < c) WINDOW w AS (PARTITION BY d ORDER BY i)),
r AS (SELECT x.d, x.i, x.a, x.n, coalesce(max(y.i), x.i) AS last FROM e x LEFT JOIN e y ON y.d = x.d AND y.i >= x.i AND y.b <= x.a + 850 GROUP BY x.d, x.i, x.a, x.n),
k AS (SELECT r.d, r.i, r.a, r.n, r.last, z.b, greatest(r.i + 1, coalesce(max(y.i), 0)) AS follow FROM r JOIN e z ON z.d = r.d AND z.i = r.last LEFT JOIN e y ON y.d = r.d AND y.a <= z.b - 100 AND y.i <= r.last GROUP BY r.d, r.i, r.a, r.n, r.last, z.b),
w(d, i, a, b, n, last, follow) AS (SELECT d, i, a, b, n, last, follow FROM k WHERE i = 1 UNION ALL SELECT k.d, k.i, k.a, k.b, k.n, k.last, k.follow FROM w JOIN k ON k.d = w.d AND k.i = w.follow WHERE w.last < w.n),
o AS (SELECT d, a AS pos, regexp_replace(substr(text, a::BIGINT + 1, (b - a)::BIGINT), '^\s+|\s+$', '', 'g') AS seg FROM w JOIN t USING (d) UNION ALL SELECT d, 0, text FROM t WHERE length(text) <= 850)
SELECT d::VARCHAR AS parent_id, count(*) AS n, max(length(seg)) AS longest, sum(pos)::BIGINT AS offsets FROM o WHERE seg <> '' OR length(seg) = 0 AND pos = 0 GROUP BY d""")
def line_windows_k7(spark, sf_dir):
    return K.segment_parents(whole(spark, sf_dir, "list")).groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("segment")).alias("longest"), F.sum("offset").alias("offsets"))


@query("table_groups_k8")
def table_groups_k8(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("parent_id"), F.col("url").alias("document_id"), F.lit("table").alias("parent_type"), F.regexp_replace(F.regexp_replace("html", "<p>", "<tr>"), "</p>", "</tr>").alias("text"))
    return K.segment_parents(p).groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("segment")).alias("longest"))


@query("recursive_split_k9")
def recursive_split_k9(spark, sf_dir):
    return K.segment_parents(whole(spark, sf_dir)).groupBy("parent_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("segment")).alias("longest"), F.sum("offset").alias("offsets"))


@query("child_chunks_k10")
def child_chunks_k10(spark, sf_dir):
    parents = K.with_parent_ids(_parents(spark, sf_dir)[0].withColumn("document_version", F.lit("v1")).withColumn("technology", F.lit("en")))
    return K.build_chunks(parents).select("chunk_id", "document_id", "parent_type", "child_index", F.sha2("embedding_text", 256).alias("embed_hash"), "start_index")


@query("simple_chunks_k11", """WITH d AS (SELECT doc_id, text, sha256(text) AS digest, unnest(generate_series(0, greatest(0, ceil((length(text) - 120) / 780)::INT - 1))) AS chunk_index FROM documents WHERE length(text) > 0)
SELECT doc_id AS document_id, chunk_index::INT AS chunk_index, sha256(concat_ws(':', digest, chunk_index, substr(text, chunk_index * 780 + 1, 900))) AS chunk_id FROM d""")
def simple_chunks_k11(spark, sf_dir):
    return K.simple_chunks(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")).select("document_id", "chunk_index", "chunk_id")


_CP = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f]', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@query("ingest_public_k12", rf"""WITH d AS (SELECT DISTINCT {_CP} AS text FROM documents), e AS (SELECT text, left(sha256(text), 24) AS document_id, unnest(generate_series(0, greatest(0, ceil((length(text) - 120) / 780)::INT - 1))) AS chunk_index FROM d WHERE length(text) >= 40),
f AS (SELECT document_id, sha256(regexp_replace(substr(text, chunk_index * 780 + 1, 900), '^\s+|\s+$', '', 'g')) AS fp, min(chunk_index) AS i FROM e GROUP BY ALL)
SELECT document_id, i::INT AS chunk_index, concat_ws(':', document_id, i, left(fp, 12)) AS chunk_id FROM f""")
def ingest_public_k12(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return K.ingest_public(d, clean_public_text)[0].select("document_id", "chunk_index", "chunk_id")


@query("web_chunks_k13")
def web_chunks_k13(spark, sf_dir):
    return K.split_web_content(web_sources(spark, sf_dir).withColumn("text", F.col("excerpt")), 500).groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("longest"))


@query("personal_ingest_k14")
def personal_ingest_k14(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("document_id"), "text")
    return K.ingest_personal(d, exact_dedupe)[1]


@query("layout_json_s4_s5", """SELECT concat('c', conv_id) AS document_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS block_index, (turn + 1)::INT AS page, CASE role WHEN 'system' THEN 'heading' ELSE 'paragraph' END AS kind, sha256(text) AS text_hash FROM conversations""")
def layout_json_s4_s5(spark, sf_dir):
    """Turns as the blocks of pages, their text nested twice; every page also has a page number to drop."""
    c = table(spark, sf_dir, "conversations")
    block = F.struct(F.when(F.col("role") == "system", "title").otherwise("text").alias("type"), F.struct(F.array(F.struct(F.col("text").alias("content"))).alias("paragraph_content")).alias("content"))
    noise = F.struct(F.lit("page_number").alias("type"), F.struct(F.array(F.struct(F.lit("1").alias("content"))).alias("paragraph_content")).alias("content"))
    docs = c.groupBy(F.concat(F.lit("c"), "conv_id").alias("document_id")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.array(block, noise).alias("b")))), lambda x: x["b"])).alias("layout"))
    return K.read_layout_json(docs).select("document_id", "block_index", "page", "kind", F.sha2("text", 256).alias("text_hash"))
