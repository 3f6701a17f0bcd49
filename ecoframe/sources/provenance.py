"""Content hashes and the data dictionary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecoframe import schemas


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 and md5 of every file below ``path``, computed where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def distinct_sorted(df: DataFrame, column: str, separator: str = ";") -> DataFrame:
    """Distinct parts of a joined list column, in order: one row per value."""
    return df.where(F.col(column).isNotNull()).select(F.explode(F.split(column, separator)).alias("value")).distinct().orderBy("value")


def undescribed(columns: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Rows (table, column) whose column has no description."""
    return columns.join(descriptions.select("column"), "column", "left_anti").select("table", "column")


def data_dictionary(tables: Mapping[str, Sequence[str]], descriptions: Mapping[str, str] | None = None) -> str:
    """Markdown dictionary of the given tables; a column without description fails."""
    known = schemas.DESCRIPTION if descriptions is None else descriptions
    missing = [f"{t}.{c}" for t, names in tables.items() for c in names if c not in known]
    if missing:
        raise ValueError(f"columns without description: {missing}")
    parts = ["# Data dictionary", ""]
    for table, names in tables.items():
        parts += [f"## `{table}`", "", "| Column | Description |", "|---|---|", *[f"| `{c}` | {known[c]} |" for c in names], ""]
    return "\n".join(parts)
