"""WAV files: header scan, content hashes, recordings table and extraction from zip archives."""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ecoframe import constants as C
from ecoframe.functions import scalars as S

HEADER = "duration_s double, rate_hz int, channels int, header_error string"
HASH_BLOCK = 1 << 20


def _wav_header(f) -> tuple[float, int, int]:
    """Duration, rate and channels from the chunks before the samples; the samples are skipped, not read."""
    riff = f.read(12)
    if len(riff) < 12 or riff[:4] != b"RIFF" or riff[8:] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    layout = None
    while len(chunk := f.read(8)) == 8:
        name, size = struct.unpack("<4sI", chunk)
        if name == b"fmt ":
            _, channels, rate, _, frame, _ = struct.unpack("<HHIIHH", f.read(16))
            layout = (channels, rate, frame)
            size -= 16
        elif name == b"data":
            if layout is None or not layout[1] or not layout[2]:
                break
            return size // layout[2] / layout[1], layout[1], layout[0]
        f.seek(size + size % 2, 1)
    raise ValueError("no fmt and data chunks")


def _header_row(f) -> tuple:
    try:
        return (*_wav_header(f), None)
    except (ValueError, struct.error) as error:
        return None, None, None, f"unreadable header: {error}"


def wav_header(content: Column) -> Column:
    """Header of WAV bytes held in a column: struct(duration_s, rate_hz, channels, header_error)."""
    @F.pandas_udf(HEADER)
    def parse(batch: pd.Series) -> pd.DataFrame:
        rows = [_header_row(BytesIO(b)) for b in batch]
        return pd.DataFrame(rows, columns=["duration_s", "rate_hz", "channels", "header_error"])
    return parse(content)


def _open(path: str):
    """A stream on a local or remote file, through Arrow's file systems."""
    from pyarrow import fs
    if path.startswith("file:") or path.startswith("/"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    system, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return system.open_input_file(inner)


def scan_wavs(spark: SparkSession, path: str) -> DataFrame:
    """path, header fields and sha256 of every WAV below ``path``.

    Spark lists and distributes the files (without reading their content); each task streams its files in
    1 MiB blocks, so memory does not depend on the length of a recording.
    """
    listed = (spark.read.format("binaryFile").option("pathGlobFilter", "*.[wW][aA][vV]")
              .option("recursiveFileLookup", True).load(path).select("path"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name in frame["path"]:
                with _open(name) as f:
                    head = _header_row(f)
                    f.seek(0)
                    digest = hashlib.sha256()
                    while block := f.read(HASH_BLOCK):
                        digest.update(block)
                rows.append((name, *head, digest.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "duration_s", "rate_hz", "channels", "header_error", "sha256"])

    return listed.mapInPandas(read, f"path string, {HEADER}, sha256 string")


def recording_table(scanned: DataFrame) -> DataFrame:
    """One row per audio file. Files with a bad name or header stay, with the reasons in ``error``."""
    name = S.base_name(F.col("path"))
    name_ok = S.recording_name_error(name).isNull()
    return scanned.select(
        "path", name.alias("file"), F.when(name_ok, S.recording_site(name)).alias("site"),
        S.folder_site(F.col("path")).alias("source_site"), S.recording_clock(name).alias("clock_start"),
        "duration_s", "rate_hz", "channels", "sha256",
        S.join_messages(S.recording_name_error(name), F.col("header_error")).alias("error"),
        F.lit(C.UNKNOWN_ZONE).alias("time_zone"), F.lit(C.UNKNOWN_RECORDER).alias("point_id"))


def wav_members(archive: DataFrame) -> DataFrame:
    """Zip members (zip, member, size, crc) → the audio files to extract, with flattened names.

    Folders, other types and ``._`` files are left out. Two members of one zip that would flatten to the same
    name fail the job, because one would overwrite the other.
    """
    name = S.base_name(F.col("member"))
    wanted = archive.where(F.lower("member").endswith(".wav") & ~name.startswith("._")).withColumn("name", name)
    extra = [c for c in ("size", "crc") if c in archive.columns]
    checked = wanted.groupBy("zip", "name").agg(
        F.count(F.lit(1)).alias("_n"), F.min("member").alias("member"), *[F.min(c).alias(c) for c in extra])
    return checked.select("zip", "member", F.when(F.col("_n") == 1, F.col("name")).otherwise(F.raise_error(
        F.concat(F.col("zip"), F.lit(": .wav name repeated in several folders: "), F.col("name"))).cast("string")
    ).alias("name"), *extra)


def _same(system, path: str, size: int, crc: int) -> bool:
    """Whether the file is there with this size and content."""
    if system.get_file_info(path).size != size:
        return False
    have = 0
    with system.open_input_stream(path) as f:
        while block := f.read(HASH_BLOCK):
            have = zlib.crc32(block, have)
    return have == crc


def extract_wavs(spark: SparkSession, zip_path: str, target: str) -> DataFrame:
    """Extract the audio files of every zip under ``zip_path`` into ``target``, a folder that all executors share.

    Each archive gets a folder of its own, named as the archive is below ``zip_path`` (site folders stay), so equal
    names in two archives never meet. Returns (zip, folder, name, size) of the files now in place. A file that is
    there with the same size and checksum is kept. Tasks write under a name of their own and rename, so a task that
    runs again leaves nothing half done. Each task streams its own archives.
    """
    from pyarrow import fs

    zips = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option(
        "recursiveFileLookup", True).load(zip_path).select("path")
    root = zip_path.split("://", 1)[-1].removeprefix("file:").strip("/")
    uri = target if "://" in target else "file://" + os.path.abspath(target)

    def members(frames):
        for frame in frames:
            for path in frame["path"]:
                with _open(path) as f, zipfile.ZipFile(f) as archive:
                    infos = [i for i in archive.infolist() if not i.is_dir()]
                    yield pd.DataFrame({"zip": path, "member": [i.filename for i in infos],
                                        "size": [i.file_size for i in infos], "crc": [i.CRC for i in infos]})

    def extract(frames):
        system, base = fs.FileSystem.from_uri(uri)
        for frame in frames:
            for path, rows in frame.groupby("zip"):
                with _open(path) as f, zipfile.ZipFile(f) as archive:
                    for row in rows.itertuples():
                        folder = f"{base}/{row.folder}"
                        if not _same(system, f"{folder}/{row.name}", row.size, row.crc):
                            system.create_dir(folder, recursive=True)
                            part = f"{folder}/.{row.name}.{uuid.uuid4().hex}"
                            with archive.open(row.member) as src, system.open_output_stream(part) as dst:
                                while block := src.read(HASH_BLOCK):
                                    dst.write(block)
                            system.move(part, f"{folder}/{row.name}")
            yield frame[["zip", "folder", "name", "size"]]

    listed = wav_members(zips.mapInPandas(members, "zip string, member string, size long, crc long"))
    inner = F.regexp_replace(F.element_at(F.split("zip", f"/{root}/", 2), -1), r"(?i)\.zip$", "")
    placed = listed.withColumn("folder", F.regexp_replace(inner, r"^.*:/+", ""))
    return placed.mapInPandas(extract, "zip string, folder string, name string, size long")
