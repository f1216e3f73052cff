"""Sources, sinks and table changes: manifests, files, stage tables, upserts, filtered reads and updates."""

from __future__ import annotations

import io
import zipfile
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusloom.functions.text import clean_text

MANIFEST = (
    "document_id string, path string, source_name string, source_url string, technology string, role_tags array<string>, document_version string, "
    "language string, content_type string, license_status string, target_corpus_version string, retrieved_at date, authority_priority int, enabled boolean"
)
# Fixed values of the data contract: extension -> (opening bytes in hex, MIME types, logical type).
FILE_TYPES = {
    "pdf": (["255044462D"], ["application/pdf"], "pdf"), "png": (["89504E470D0A1A0A"], ["image/png"], "image"), "jpg": (["FFD8FF"], ["image/jpeg"], "image"),
    "jpeg": (["FFD8FF"], ["image/jpeg"], "image"), "gif": (["474946383761", "474946383961"], ["image/gif"], "image"),
    "docx": (["504B0304", "7B5C727466"], ["application/vnd.openxmlformats-officedocument.wordprocessingml.document"], "docx"),
    "pptx": (["504B0304"], ["application/vnd.openxmlformats-officedocument.presentationml.presentation"], "pptx"),
    "xlsx": (["504B0304"], ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"], "xlsx"),
    "md": ([""], ["text/markdown", "text/plain"], "markdown"), "txt": ([""], ["text/plain"], "text"),
}


def check_manifest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(enabled sources, violations(document_id, document_version, violation))`` of manifest rows."""
    roles = F.array_distinct(F.filter(F.transform("role_tags", lambda r: F.trim(r)), lambda r: r != ""))
    m = rows.withColumns({
        "role_tags": roles, "language": F.coalesce("language", F.lit("zh-CN")), "authority_priority": F.coalesce("authority_priority", F.lit(100)),
        "enabled": F.coalesce("enabled", F.lit(True)), "publishable": F.coalesce(F.col("license_status") == "approved", F.lit(False)),
    })
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    rules = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("document_id").rlike("^[A-Za-z0-9][A-Za-z0-9._-]*$"), F.lit(False)), "bad_document_id"),
        F.when(F.coalesce(F.size("role_tags"), F.lit(0)) <= 0, "role_tags_empty"), F.when(~F.col("authority_priority").between(0, 1000), "bad_priority"),
        F.when((F.coalesce("content_type", F.lit("")) != "webpage") & blank("path"), "path_required"),
        F.when(blank("path") & blank("source_url"), "location_required"), *[F.when(blank(c), f"missing_{c}") for c in ("source_name", "technology", "document_version", "license_status", "target_corpus_version")],
    ))
    own = m.select("document_id", "document_version", F.explode(rules).alias("violation"))
    twice = m.groupBy("document_id", "document_version").count().where("count > 1").select("document_id", "document_version", F.lit("duplicate_identity").alias("violation"))
    return m.where("enabled"), own.unionByName(twice)


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A manifest as JSON lines."""
    return check_manifest(spark.read.schema(MANIFEST).json(path))


def read_markdown(spark: SparkSession, glob: str) -> DataFrame:
    """Whole text files, cleaned: ``(path, text, warnings)``."""
    raw = spark.read.text(glob, wholetext=True).select("_metadata.file_path", clean_text(F.col("value")).alias("c"))
    return raw.select(F.col("file_path").alias("path"), "c.text", "c.warnings")


@F.pandas_udf(StringType())
def _office_part(content: pd.Series) -> pd.Series:
    """The first folder of an office archive that tells its kind."""

    def one(b: bytes) -> str | None:
        try:
            names = zipfile.ZipFile(io.BytesIO(b)).namelist()
        except (zipfile.BadZipFile, TypeError):
            return None
        return next((k for k in ("word/", "ppt/", "xl/") if any(n.startswith(k) for n in names)), None)

    return content.map(one)


def detect_file_types(files: DataFrame, max_bytes: int = 20 << 20) -> DataFrame:
    """S3: ``files(path, mime, content)`` -> ``logical_type`` or ``error``."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring("content", 1, 16))
    known = ext.isin(*FILE_TYPES)
    mime = F.coalesce("mime", F.lit(""))
    mime_ok = reduce(lambda a, b: a | b, [(ext == e) & (mime.isin(*m, "application/octet-stream", "")) for e, (_, m, _) in FILE_TYPES.items()])
    magic_ok = reduce(lambda a, b: a | b, [(ext == e) & reduce(lambda x, y: x | y, [F.startswith(head, F.lit(h)) for h in hs]) for e, (hs, _, _) in FILE_TYPES.items()])
    part = F.when(ext.isin("docx", "pptx", "xlsx") & F.startswith(head, F.lit("504B0304")), _office_part("content"))
    want = F.when(ext == "docx", "word/").when(ext == "pptx", "ppt/").when(ext == "xlsx", "xl/")
    rtf = (ext == "docx") & F.startswith(head, F.lit("7B5C727466"))
    error = (
        F.when(~known, "extension_not_allowed").when(F.octet_length("content") > max_bytes, "too_large").when(F.octet_length("content") == 0, "empty_file")
        .when(~mime_ok, "mime_mismatch").when(~magic_ok, "magic_mismatch").when(want.isNotNull() & ~rtf & (F.coalesce(part, F.lit("")) != want), "not_an_office_file")
    )
    logical = F.coalesce(*[F.when(ext == e, t) for e, (_, _, t) in FILE_TYPES.items()])
    rows = files.withColumn("error", error)
    return rows.select("path", F.when(F.col("error").isNull(), F.when(rtf, "doc").otherwise(logical)).alias("logical_type"), "error")


def write_stage(df: DataFrame, root: str, stage: str) -> None:
    """Replace one batch's stage table; ``df`` has ``batch_id`` and ``document_id``."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{root}/{stage}")


def read_stage(spark: SparkSession, root: str, stage: str, batch_id: str) -> DataFrame:
    """One batch of a stage table; other batches are pruned."""
    return spark.read.parquet(f"{root}/{stage}").where(F.col("batch_id") == batch_id)


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of ``delta`` replace those with their key, the last by ``order`` of several."""
    if order:
        last = Window.partitionBy(*keys).orderBy(F.desc(order))
        delta = delta.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(delta.select(*base.columns))


def replace_document(base: DataFrame, delta: DataFrame, keys: tuple[str, ...] = ("owner_id", "document_id")) -> DataFrame:
    """All rows of the delta's documents go, then its rows come."""
    return base.join(delta.select(*keys).distinct(), list(keys), "left_anti").unionByName(delta.select(*base.columns))


def query(df: DataFrame, filters: dict, limit: int | None = 10_000, order: list[str] | None = None) -> DataFrame:
    """Rows that equal all filters, at most ``limit`` by ``order`` (null: all)."""
    rows = reduce(lambda d, kv: d.where(F.col(kv[0]).eqNullSafe(F.lit(kv[1]))), filters.items(), df)
    return rows if limit is None else rows.orderBy(*(order or df.columns)).limit(limit)


def update_where(df: DataFrame, cond: Column, **cols) -> tuple[DataFrame, DataFrame]:
    """The table with columns set where ``cond`` holds, and how many rows that were."""
    new = {c: F.when(cond, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in cols.items()}
    return df.withColumns(new), df.where(cond).agg(F.count(F.lit(1)).alias("n_updated"))


def delete_where(df: DataFrame, cond: Column) -> DataFrame:
    """The rows for which ``cond`` doesn't hold (or is null)."""
    return df.where(~F.coalesce(cond, F.lit(False)))


def backfill_hybrid(old: DataFrame) -> DataFrame:
    """Old rows to ``pk, text, vector`` and the other columns; rows without one of the three go."""
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in old.columns])
    rest = [c for c in old.columns if c not in ("pk", "id", "text", "vector", "sparse")]
    rows = old.select(pick("pk", "id").alias("pk"), pick("text", "evidence_text", "page_content").alias("text"), "vector", *rest)
    return rows.where("pk is not null and text is not null and size(vector) > 0")


def to_record(chunks: DataFrame) -> DataFrame:
    """S14."""
    return chunks.withColumnRenamed("evidence_text", "text")


def to_index_rows(chunks: DataFrame) -> DataFrame:
    """Store rows: defaults, -1 for unknown pages and levels, nested values as JSON, roles between bars."""
    have = set(chunks.columns)
    col = lambda c, default: F.coalesce(F.col(c), F.lit(default)).alias(c) if c in have else F.lit(default).alias(c)
    roles = F.array_sort(F.array_distinct(F.filter("role_tags", lambda r: r != "")))
    texts = [col(c, "") for c in ("chunk_id", "document_id", "parent_id", "technology", "source_name", "media_path", "visual_type", "visual_status")]
    numbers = [col(c, -1) for c in ("page_start", "page_end", "heading_level")]
    section = F.array_join("section_path", " > ").alias("section_path") if "section_path" in have else F.lit("").alias("section_path")
    meta = F.coalesce(F.to_json("structure_metadata"), F.lit("{}")) if "structure_metadata" in have else F.lit("{}")
    return chunks.select(
        *texts, *numbers, section, meta.alias("structure_metadata"), F.concat(F.lit("|"), F.array_join(F.when(F.size(roles) > 0, roles).otherwise(F.array(F.lit("general"))), "|"), F.lit("|")).alias("role_tags"),
        col("corpus_version", "personal"), col("language", "zh-CN"), col("license_status", "approved"), F.lit("ready").alias("status"), F.col("text").alias("evidence_text"),
    )


def evaluation_envelope(metrics: DataFrame, gates: DataFrame, meta: dict[str, str]) -> DataFrame:
    """One JSON row: metadata, metrics by name and failed gates."""
    m = metrics.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    g = gates.agg(F.array_sort(F.collect_list("metric")).alias("failed_gates"))
    metadata = F.create_map(*[F.lit(x) for kv in sorted(meta.items()) for x in kv])
    return m.crossJoin(F.broadcast(g)).select(F.to_json(F.struct(metadata.alias("metadata"), "metrics", "failed_gates")).alias("json"))  # one row each
