"""Exact duplicates by salted, content-comparing aggregation (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import column, staged

#: A digest with more than this share of all rows is hot, so there are fewer than 1 / HOT of them.
HOT = 1 / 4096
#: The class's name: SHA-256, a second hash and the length.
NAME = ["digest", "mark", "size_bytes"]


def _named(text: Column) -> dict[str, Column]:
    return {"digest": F.sha2(text, 256), "mark": F.xxhash64(text), "size_bytes": F.octet_length(text)}


def _hot(names: DataFrame) -> DataFrame:
    """``(digest)`` of the hot groups; counted on names, and no more than 1 / ``HOT`` rows."""
    n = names.count()
    return staged(names.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT * n).select("digest"), "hot-digests")


def _combine(rows: DataFrame, hot: DataFrame, salts: int, first: list[Column], last: list[Column]) -> DataFrame:
    """``rows(digest, text, ...)`` -> one row per distinct text, by full content at every stage.

    1. Locally: the text itself is a grouping key, so each task combines its own
       copies before anything is shuffled.
    2. Salted: the survivors meet by (salt, digest, text). A hot group is dealt over
       ``salts`` tasks; every other digest has a single salt and is done.
    3. Globally: at most ``salts`` winners of each hot group meet by (digest, text).

    So a text crosses the network once, and a hot one once more for each salt.
    """
    hot = F.broadcast(hot)  # fewer than 1 / HOT rows
    cold = rows.join(hot, "digest", "left_anti").groupBy("digest", "text").agg(*first)
    salted = rows.join(hot, "digest", "left_semi").withColumn("salt", F.spark_partition_id() % salts)
    winners = salted.groupBy("salt", "digest", "text").agg(*first)
    return cold.unionByName(winners.groupBy("digest", "text").agg(*last))


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per distinct text: ``digest, mark, size_bytes, keep_id, group_size``.

    See ``_combine`` for the stages. Null texts count as empty. Ids may be null; the
    largest id wins, null only where a group has no other.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return _classes(docs.select(F.col(id_col).alias("id"), text.alias("text")), docs.select(F.sha2(text, 256).alias("digest")), salts)


def _classes(rows: DataFrame, names: DataFrame, salts: int) -> DataFrame:
    found = _combine(
        rows.withColumn("digest", F.sha2("text", 256)), _hot(names), salts,
        [F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")],
        [F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")],
    )
    return found.select("digest", F.xxhash64("text").alias("mark"), F.octet_length("text").alias("size_bytes"), "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """``docs`` -> one row per input row: id, ``keep_id, group_size, kept, text_sha256``.

    Equality is decided on whole contents in ``_combine``. Its classes are then handed
    back to the rows by the class's name, which is the SHA-256 together with a second
    64-bit hash and the length; each class of copies is replicated over ``salts`` keys,
    so that the rows of a hot group spread over as many tasks. Names are made once.
    Repeated rows (same id and text) count in ``group_size`` and share one verdict.
    Null texts count as empty. Other columns of ``docs`` are neither read nor
    returned. No rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = staged(docs.select(F.col(id_col).alias("id"), *(c.alias(n) for n, c in _named(text).items())), "names")
    copies = _classes(docs.select(F.col(id_col).alias("id"), text.alias("text")), names, salts).where("group_size > 1")
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = names.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    found = rows.join(copies, [*NAME, "salt"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias(id_col), keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """``docs`` -> one row per distinct text, with the columns of ``docs``.

    The row of the largest id stays, null only where a text has no other; of equal ids
    the largest by the other columns. The columns ride through ``_combine``, so no row
    is looked up by an id that others may share, and they may have any names. Null texts
    count as empty; texts of any length are compared whole. No rows give no rows.
    """
    rest = {c: f"_{i}" for i, c in enumerate(docs.columns) if c not in (id_col, text_col)}
    row = F.struct(
        column(id_col).alias("id"), column(text_col).isNotNull().alias("given"), *(column(c).alias(n) for c, n in rest.items())
    )
    text = F.coalesce(column(text_col), F.lit(""))
    hot = _hot(docs.select(F.sha2(text, 256).alias("digest")))
    best = F.max("row").alias("row")
    found = _combine(docs.select(row.alias("row"), text.alias("text"), F.sha2(text, 256).alias("digest")), hot, salts, [best], [best])
    place = {id_col: F.col("row.id"), text_col: F.when(F.col("row.given"), F.col("text"))}
    return found.select(*(place.get(c, F.col(f"row.{rest.get(c)}")).alias(c) for c in docs.columns))
