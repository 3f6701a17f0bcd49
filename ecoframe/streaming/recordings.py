"""Recordings that keep arriving: the same scan and campaign summary over a file stream.

The batch operators apply unchanged to a stream; only what needs the whole table at once (modes, orphans) stays
in batch. Late files are handled by the campaign keys, not by time, so no watermark is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecoframe.operators.acoustic import campaign_table
from ecoframe.sources.audio import recording_table, wav_header


def stream_recordings(spark: SparkSession, path: str) -> DataFrame:
    """New WAV files below ``path`` as rows of the recordings table (one folder per site)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = (spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[wW][aA][vV]")
             .option("recursiveFileLookup", True).load(path))
    head = files.select("path", F.sha2("content", 256).alias("sha256"), wav_header(F.col("content")).alias("h"))
    return recording_table(head.select("path", "sha256", "h.*"))


def stream_campaigns(recordings: DataFrame) -> DataFrame:
    """Running campaign summary; write it in complete or update mode."""
    return campaign_table(recordings)
