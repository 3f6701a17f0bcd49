"""CSV tables: typed scans, encoding fallback, whitelisted source readers, sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ecoframe import constants as C
from ecoframe import schemas
from ecoframe.functions.scalars import finite, rate_in_hz


def scan_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """An exported CSV table with its declared types; empty text and NaN are missing."""
    read = spark.read.schema(schemas.schema(table, exported=True)).option("header", True).option(
        "nullValue", "").option("enforceSchema", False).csv(path)
    doubles = {f.name for f in read.schema if isinstance(f.dataType, T.DoubleType)}
    clean = read.select(*[finite(F.col(c)).alias(c) if c in doubles else F.col(c) for c in read.columns])
    return schemas.from_export(clean, table)


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names only; with inference off no data row is read."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether every line is valid UTF-8 (the text source keeps the bytes as they are)."""
    return spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()


def scan_text_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """All columns as text, as UTF-8 or, if any byte does not fit, as Latin-1, which reads every byte.

    ``multi_line``: quoted fields may hold line breaks; each file is then read by one task.
    """
    encoding = "UTF-8" if is_utf8(spark, path) else "ISO-8859-1"
    read = (spark.read.option("header", True).option("inferSchema", False).option("encoding", encoding)
            .option("multiLine", multi_line).option("escape", '"').csv(path))
    return read.toDF(*[c.lstrip("\ufeff").removeprefix("ï»¿") for c in read.columns])


def points_from_source(metadata: DataFrame, sites: Sequence[str]) -> DataFrame:
    """Points of the wanted sites from the source's metadata; the contact column (personal data) is not read on."""
    return metadata.where(F.col("Site ID").isin(list(sites))).select(
        F.col("Site ID").alias("site"), F.col("Site ID").alias("validation_group"),
        F.col("Study area").alias("study_area"), F.col("Recording location").alias("country"),
        F.col("Biome").alias("biome"), F.col("Latitude").alias("latitude"), F.col("Longitude").alias("longitude"),
        F.lit(C.COORDINATE_PRECISION).alias("coordinate_precision"),
        F.col("Recorder (+ microphone)").alias("recorder"), rate_in_hz(F.col("Sampling rate")).alias("declared_rate_hz"),
        F.col("Recording date").cast("string").alias("declared_year"),
        F.col("Minutes Annotated").try_cast("double").cast("int").alias("annotated_minutes"))


def detections_from_source(annotations: DataFrame, sites: Sequence[str], source: str = C.ANNOTATION_SOURCE) -> DataFrame:
    """Annotations of the wanted sites. A row is one vocalisation, so rows count activity, not presence."""
    def number(name: str):
        return F.col(f"`{name}`").try_cast("double")
    return annotations.where(F.col("Site").isin(list(sites))).select(
        F.col("Site").alias("site"), F.col("Recording").alias("file"), F.col("Species").alias("species"),
        number("Begin_Time_(s)").alias("start_s"), number("End_Time_(s)").alias("end_s"),
        number("Low_Freq_(Hz)").alias("freq_min_hz"), number("High_Freq_(Hz)").alias("freq_max_hz"),
        F.lit(source).alias("source"))


def write_table(df: DataFrame, path: str, table: str, csv: bool = False) -> None:
    """Parquet for the engine; CSV under the exported names for exchange. Written in parallel, one file per task."""
    if csv:
        schemas.to_export(df, table).write.mode("overwrite").option("header", True).option(
            "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    else:
        df.write.mode("overwrite").parquet(path)
