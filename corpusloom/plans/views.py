"""The given tables as the library's domain tables, as DataFrames and as SQL prefixes of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.sources.stages import staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_docs(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Documents with their governance columns; those of ``only(doc_id)`` are picked before texts meet labels in a shuffle."""
    docs = table(spark, sf_dir, "documents")
    docs = docs if only is None else docs.join(only, "doc_id", "left_semi")
    docs = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    good = F.coalesce(F.col("quality") == 1, F.lit(False))
    return docs.select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("document_id"), "doc_id", "text",
        F.col("lang").alias("technology"), F.col("source").alias("source_name"),
        F.regexp_extract("source", "[0-9]+", 0).cast("int").alias("authority_priority"),
        F.when(good, F.array(F.col("lang"), F.lit("general"))).otherwise(F.array("lang")).alias("role_tags"),
        F.when(good, "approved").otherwise("unknown").alias("license_status"),
        F.concat(F.lit("v"), F.col("doc_id") % 2).alias("corpus_version"),
    )


def docs_of(spark: SparkSession, sf_dir: str, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits, staged as few rows of a known size, and the documents that they name."""
    hits = staged(hits, "run")
    return hits, source_docs(spark, sf_dir, hits.select(F.col("chunk_id").alias("doc_id")))


SOURCE_DOCS = """source_docs AS (
    SELECT concat('d', d.doc_id) AS document_id, d.doc_id, d.text, d.lang AS technology, d.source AS source_name,
           CAST(regexp_extract(d.source, '[0-9]+') AS INTEGER) AS authority_priority,
           CASE WHEN coalesce(l.quality = 1, false) THEN [d.lang, 'general'] ELSE [d.lang] END AS role_tags,
           CASE WHEN coalesce(l.quality = 1, false) THEN 'approved' ELSE 'unknown' END AS license_status,
           concat('v', d.doc_id % 2) AS corpus_version
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The non-empty lines of documents as chunks; the parent is the document."""
    lines = source_docs(spark, sf_dir).select("*", F.posexplode(F.split("text", "\n")).alias("child_index", "line")).drop("text")
    lines = lines.withColumn("text", strip(F.col("line"))).where("text <> ''")
    kind = F.when(F.contains("text", F.lit("|")), "table").when(F.contains("text", F.lit('= "')), "code").otherwise("paragraph")
    return lines.select(
        F.concat_ws(":", "document_id", F.col("child_index").cast("string")).alias("chunk_id"),
        "document_id", "doc_id", F.col("document_id").alias("parent_id"), "child_index", "text", kind.alias("knowledge_type"),
        "technology", "source_name", "authority_priority", "role_tags", "license_status", "corpus_version",
    )


CHUNKS = (
    SOURCE_DOCS
    + r""", chunk_lines AS (
    SELECT s.*, unnest(string_split(s.text, chr(10))) AS line, generate_subscripts(string_split(s.text, chr(10)), 1) - 1 AS child_index
    FROM source_docs s
), chunks AS (
    SELECT concat(document_id, ':', child_index) AS chunk_id, document_id, doc_id, document_id AS parent_id, child_index,
           regexp_replace(line, '^\s+|\s+$', '', 'g') AS text,
           CASE WHEN contains(line, '|') THEN 'table' WHEN contains(line, '= "') THEN 'code' ELSE 'paragraph' END AS knowledge_type,
           technology, source_name, authority_priority, role_tags, license_status, corpus_version
    FROM chunk_lines WHERE regexp_replace(line, '^\s+|\s+$', '', 'g') <> ''
)"""
)


def web_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as web candidates; a request is one host."""
    pages = table(spark, sf_dir, "pages")
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    body = F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "(?s)<[^>]*>", " ")
    return pages.select(
        "page_id", "url", title.alias("title"), F.regexp_replace(F.regexp_replace(body, r"\s+", " "), "^ | $", "").alias("excerpt")
    )


WEB_SOURCES = r"""web_sources AS (
    SELECT page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
           regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
               '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g') AS excerpt
    FROM pages
)"""


#: Lines that one task sorts.
LINES = 400_000


def dealt(rows: DataFrame, lines: int, key: str) -> DataFrame:
    """Rows by ``key`` in as many parts as the order lines need, so a task's memory doesn't grow with the tables."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-lines // LINES)), key)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as answers: one per (quiz, question), the first by all its columns; ``A`` returned is the right one.

    The first are found before orders are met, so that lines are sorted once; an order given twice is met once.
    """
    items = table(spark, sf_dir, "lineitem")
    lines = items.count()
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    items = dealt(items, lines, "l_orderkey").withColumn("n", F.row_number().over(first)).where("n = 1")
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), lines, "o_orderkey").groupBy("o_orderkey").agg(F.min("o_custkey").alias("o_custkey"))
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("quiz_id"), F.col("o_custkey").alias("user_id"), F.col("l_linenumber").alias("question_no"),
        F.array(F.col("l_returnflag")).alias("selected"), F.array(F.lit("A")).alias("answer"),
        F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("knowledge_point"),
    )


ANSWERS = """answers AS (
    SELECT l_orderkey AS quiz_id, o_custkey AS user_id, l_linenumber AS question_no, [l_returnflag] AS selected, ['A'] AS answer,
           concat('p', l_partkey % 50) AS knowledge_point
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                               ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag) = 1
)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("quiz_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderstatus") == "F").alias("has_report"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "ready_for_report").otherwise("in_progress").alias("status"),
    )


SESSIONS = """sessions AS (
    SELECT o_orderkey AS quiz_id, o_custkey AS user_id, o_orderdate AS created_at, o_orderstatus = 'F' AS has_report,
           CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'ready_for_report' ELSE 'in_progress' END AS status
    FROM orders
)"""
