"""The corpus pipeline: language, exact copies, near copies, mixture, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``docs``. ``run`` writes every stage as Parquet to the shared
folder and hands the reread table on, so a lost executor costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.exact_dedup import one_of_each
from corpusloom.llm.language_id import fit, held_out, identify
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.shared import column, staged, table
from corpusloom.llm.simhash_dedup import simhash_dedup
from corpusloom.llm.source_mix import source_mix

#: Share of a document's letters that its language must have.
MIN_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labelled documents have; ``und`` and mixtures under ``MIN_SCORE`` go.

    ``lang`` becomes the predicted language. Null texts and texts without letters are
    ``und``. Each row is decided by itself, so null, repeated and reused ids don't matter.
    """
    found = identify(docs, fit(docs.where(~held_out())), keep=docs.columns, with_spans=False)
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return found.select(*(F.col("lang_pred").alias("lang") if c == "lang" else F.col("kept").getField(c).alias(c) for c in docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep one row: the largest id, null only where a text has no other; of repeated rows, one.

    Texts are compared whole, columns may have any names, and no rows give no rows.
    """
    return one_of_each(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies linked by SimHash, keep one row: the smallest id, null only where a component has no other.

    Ids may be null, repeated or reused, so rows are told apart by a number that is written
    with them once; the columns of ``docs`` ride in a struct, whatever their names. Texts are
    read whole. No rows give no rows.
    """
    rows = staged(docs.select(F.struct(*map(column, docs.columns)).alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    texts = rows.select("row", F.col("doc.text").alias("text"))
    place = F.struct(F.isnull("doc.doc_id").alias("unnamed"), F.col("doc.doc_id").alias("id"), F.xxhash64("doc.text").alias("hash"), "row")
    found = simhash_dedup(texts, "row").join(rows.select("row", place.alias("place")), "row")
    found = staged(found.select("component_id", "place"), "places")
    best = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("best")).where("n > 1")
    gone = found.join(best, "component_id").where("place.row <> best.row").select("place.row")
    gone = staged(gone, "gone")  # its size is known then, so that few rows are broadcast and no text is shuffled
    return rows.join(gone, "row", "left_anti").select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents to the sources' targets: each row comes as often as the mix takes it, 0 to 2 times.

    Documents without words go; a null source is a source of its own. Documents that the mix
    can't tell apart are drawn in any order. Columns may have any names; no rows give no rows.
    """
    taken = source_mix(docs, keep=docs.columns).where("size > 0 and taken > 0")
    times = F.expr("array_repeat(1, cast(taken div size as int))")
    return taken.select("kept", F.explode(times)).select("kept.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack into sequences of 4096 tokens; each row is a document of its own, a null text an empty one.

    No rows give no rows.
    """
    return pack_documents(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: Token ids, fingerprints and the selection have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
