"""What the operators of this subpackage have in common: tables, words, and stage tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.stages import shared_folder, staged

__all__ = ["SPACES", "WORD", "column", "shared_folder", "staged", "table"]

#: White space of the contracts: blank and the control characters from tab to carriage return.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")
