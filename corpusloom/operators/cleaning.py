"""Redaction, credential scans, image routing, table checks and page profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data contract.
SENSITIVE = r"(?i)(api[_-]?key|secret|token|password|authorization)"
SENSITIVE_EVALUATION = r"(?i)(api[_-]?key|secret|token|password|authorization|cookie|openid|user_id)"
CREDENTIAL = r"(?i)(?:api[_-]?key|password|authorization|openid)\s*[:=]\s*\S+|bearer\s+[A-Za-z0-9._-]{12,}"
VISUAL_HINTS = [
    "流程图", "架构图", "时序图", "关系图", "类图", "状态图", "拓扑图", "图表", "柱状图", "折线图", "饼图", "散点图", "复杂表格", "表格",
    "chart", "diagram", "flowchart", "figure", "table", "graph",
]


def _redacted(c: Column, kind: T.DataType, pattern: str) -> Column:
    import re

    if isinstance(kind, T.StructType):
        hide = lambda f: F.lit("[REDACTED]") if re.search(pattern, f.name) else _redacted(c[f.name], f.dataType, pattern)
        return F.when(c.isNotNull(), F.struct(*[hide(f).alias(f.name) for f in kind.fields]))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        inner = lambda v: _redacted(v, kind.valueType, pattern)
        if isinstance(kind.valueType, T.StringType):
            return F.transform_values(c, lambda k, v: F.when(k.rlike(pattern), "[REDACTED]").otherwise(v))
        return F.transform_values(c, lambda k, v: inner(v))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda v: _redacted(v, kind.elementType, pattern))
    return c


def redact(df: DataFrame, pattern: str = SENSITIVE) -> DataFrame:
    """Fields and string map values under a sensitive key become ``[REDACTED]``, at any depth of the schema."""
    import re

    return df.select(*[(F.lit("[REDACTED]") if re.search(pattern, f.name) else _redacted(F.col(f"`{f.name}`"), f.dataType, pattern)).alias(f.name) for f in df.schema])


def credential_violations(df: DataFrame, key: str, fields: str = "fields", pattern: str = SENSITIVE_EVALUATION) -> DataFrame:
    """C17: rows of a map column with a value under a sensitive key, or a credential-like text: ``(key, field, reason)``."""
    rows = df.select(key, F.explode(fields).alias("field", "value"))
    named = F.col("field").rlike(pattern) & (F.trim(F.coalesce("value", F.lit(""))) != "")
    like = F.coalesce(F.col("value").rlike(CREDENTIAL), F.lit(False))
    return rows.select(key, "field", F.when(named, "sensitive_key").when(like, "credential_like_text").alias("reason")).where("reason is not null")


def image_route(blocks: DataFrame) -> DataFrame:
    """``(path, kind, layout_type, caption, source_type)`` -> ``mode, reason``."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    name = F.lower(F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/]*?)(?:\.[^./]*)?$", 1))
    node = F.when(low("layout_type") != "", low("layout_type")).otherwise(low("kind"))
    hint = low("caption").rlike("|".join(VISUAL_HINTS))
    rules = [
        (name.rlike("logo|avatar|icon|decoration|背景"), "skip", F.lit("decorative_filename")), (low("source_type") == "scanned_pdf_page", "ocr", F.lit("scanned_pdf_page")),
        (low("kind").isin("chart", "table") | low("layout_type").isin("chart", "figure", "table"), "visual", F.concat(F.lit("structured_node:"), node)),
        (hint, "visual", F.lit("caption_or_context_hint")), (name.rlike("chart|flow|table|figure|diagram"), "visual", F.lit("filename_fallback")),
    ]
    mode, reason = F.lit("ocr"), F.lit("default_ocr")
    for test, m, r in reversed(rules):
        mode, reason = F.when(test, m).otherwise(mode), F.when(test, r).otherwise(reason)
    return blocks.withColumn("mode", mode).withColumn("reason", reason)


def visual_valid(df: DataFrame) -> DataFrame:
    """Table analyses ``(headers, rows, elements, ocr_text, confidence)`` -> ``valid, reason`` and the confidence within 0 and 1."""
    number = r"\d+(?:\.\d+)?"
    seen = F.flatten(F.transform("elements", lambda e: F.regexp_extract_all(e, F.lit(number), F.lit(0))))
    read = F.regexp_extract_all(F.coalesce("ocr_text", F.lit("")), F.lit(number), F.lit(0))
    reason = (
        F.when(F.col("headers").isNull() | F.col("rows").isNull() | F.col("elements").isNull(), "missing_fields")
        .when(~F.forall("rows", lambda r: F.size(r) == F.size("headers")), "row_width").when((F.size(read) > 0) & ~F.arrays_overlap(seen, read), "no_number_agrees")
    )
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    return df.withColumns({"reason": reason, "confidence": sure}).withColumn("valid", F.col("reason").isNull())


def page_profiles(pages: DataFrame, min_chars: int = 30, ratio: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """``pages(document_id, page, chars)`` -> pages with ``profile``, and documents with ``content_profile, density, low_density``."""
    profile = F.when(F.col("chars") >= min_chars, "text_page").when(F.col("chars") == 0, "scanned_page").otherwise("mixed_page")
    p = pages.withColumn("profile", profile)
    n = F.count(F.lit(1))
    scanned = F.count(F.when(F.col("profile") == "scanned_page", 1))
    odd = F.count(F.when(F.col("profile") != "text_page", 1))
    density = F.sum("chars") / n
    docs = p.groupBy("document_id").agg(
        n.alias("n_pages"), F.when(scanned / n >= ratio, "scanned_pdf").when(odd > 0, "mixed_pdf").otherwise("text_pdf").alias("content_profile"), density.alias("density"),
        ((F.sum("chars") > 0) & (density < min_chars)).alias("low_density"),
    )
    return p, docs
