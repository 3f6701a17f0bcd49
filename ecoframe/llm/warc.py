"""WARC archives: a writer with deduplicated payloads and a salvage reader.

Each record is a gzip member of its own. Records with equal payloads (by digest) become revisits of the one with the smallest
page id. Archives are written by the tasks into the shared folder; the list of finished files, cut into that folder too, says
which ones count, so a task that runs again leaves no doubled records.

The reader checks each record (header, lengths, block digest, gzip's own check). After a failed check it searches for the next
valid member or version line, in the file and in the inflated bytes of a member, goes on from there, and reports the bytes in
between as a gap. Members are inflated in pieces, so a member of many records is never held as a whole.

Defined results: a null payload is empty; a null page id is written as such and comes last; rows that repeat an id with the
same payload are all responses or all revisits; empty tables give no rows; other columns are ignored. Payloads are written and
read whole, however long; one record is held in memory at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecoframe.llm.common import NO_ID, cut, scratch, text_rows

MAGIC = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
VERSION_START = re.compile(rb"WARC/1\.")
STARTS = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
READ = 1 << 18
#: A member is inflated in pieces of so many bytes, which give 1032 times as many at most.
PIECE = 1 << 14
RECORDS = ("page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, "
           "path string, gap_start long, gap_end long, reason string")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, which has the payload's length, and the payload's digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = lambda x: f"<urn:page:{'none' if x is None else x}>"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page)}", f"WARC-Target-URI: {uri}",
            "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
            f"WARC-Block-Digest: sha1:{digest(block)}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers)}"]
    return "\r\n".join([*head, "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    out = zlib.compressobj(level, zlib.DEFLATED, 31)
    return out.compress(data) + out.flush()


def parse(data: bytes | bytearray, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(header, block, end) of the record at place `at`; ValueError if a check fails, EOFError if it is cut off.

    The header is read line by line and given up at the first line that can't belong to it, so a false start costs no more than
    the bytes up to the next line.
    """
    version = VERSION.match(data, at)
    if not version:
        raise ValueError("no version line") if len(data) - at >= 10 else EOFError("the version line is cut off")
    head: dict[str, str] = {}
    start = version.end()
    while True:
        stop = data.find(b"\n", start)
        if stop < 0:
            raise EOFError("the header has no end")
        line = bytes(data[start:stop + 1])
        start = stop + 1
        if line == b"\r\n":
            break
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not line.endswith(b"\r\n"):
            raise ValueError("a header line has no colon or no end")
        head[name.strip().lower()] = value.strip()
    size = head.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        raise ValueError("no content length")
    end = start + int(size)
    if len(data) < end + 4:
        raise EOFError("the block is cut off")
    if data[end:end + 4] != b"\r\n\r\n":
        raise ValueError("no end mark after the block")
    block = bytes(data[start:end])
    told = head.get("warc-block-digest", "")
    if told.startswith("sha1:") and told[5:] != digest(block):
        raise ValueError("the block digest differs")
    return head, block, end + 4


class _Buffer:
    """A window on a stream, bytes from `base` on: `data` from place `at`. It grows on demand; what is behind is freed now and then."""

    def __init__(self, stream: BinaryIO | _Inflated):
        self.stream, self.data, self.at, self.base, self.ended = stream, bytearray(), 0, 0, False

    def __len__(self) -> int:
        return len(self.data) - self.at

    def more(self) -> bool:
        piece = b"" if self.ended else self.stream.read(max(READ, len(self) // 2))
        self.ended = not piece
        self.data += piece
        return bool(piece)

    def drop(self, n: int) -> None:
        n = min(n, len(self))
        self.at, self.base = self.at + n, self.base + n
        if self.at > max(READ, len(self.data) // 2):
            del self.data[:self.at]
            self.at = 0


class _Inflated:
    """What the gzip member at the start of a buffer holds, as a stream; `error` says why it stopped before the member's end."""

    def __init__(self, buffer: _Buffer):
        self.buffer, self.inflate, self.piece, self.used = buffer, zlib.decompressobj(31), 0, 0
        self.error, self.reason, self.given = "", "", False  # of the member; of the first bad record in it; whether any is valid

    def read(self, _: int) -> bytes:
        """The bytes that the next piece of the member gives; nothing at its end or at an error."""
        while not self.inflate.eof and not self.error:
            if self.used == len(self.buffer) and not self.buffer.more():
                self.error = "the member is cut off"
                break
            at = self.buffer.at + self.used
            piece = bytes(self.buffer.data[at:at + PIECE])
            self.piece, self.used, spare = self.used, self.used + len(piece), self.inflate.copy()
            try:
                out = self.inflate.decompress(piece)
            except zlib.error as e:
                self.error = f"gzip: {e}"
                out = _upto_error(spare, piece)
            if out:
                return out
        return b""

    def forget(self) -> None:
        """Frees the member's bytes before the last piece: a checked record lies behind them."""
        self.buffer.drop(self.piece)
        self.piece, self.used = 0, self.used - self.piece


def _upto_error(inflate, piece: bytes) -> bytes:
    """The bytes that a damaged piece gives before its error."""
    out = []
    for i in range(len(piece)):
        try:
            out.append(inflate.decompress(piece[i:i + 1]))
        except zlib.error:
            break
    return b"".join(out)


Found = Iterator[tuple[str, object]]


def salvage(stream: BinaryIO) -> Found:
    """("record", (header, block)) in order, and ("gap", (start, end, reason)) for bytes that no valid record holds.

    Records are given out one by one as they parse, also out of a gzip member that holds many. One without a block digest waits
    for the check of its member, and is lost with it. A gap between records of one member has the file's places from the
    member's start (or its last 16 KB before the gap) to what was read of it; its reason tells the inflated bytes.
    A record whose length is damaged is read up to the end of its member or file before the search goes on behind its start.
    """
    yield from _scan(_Buffer(stream), True)


def _scan(buffer: _Buffer, packed: bool) -> Found:
    """Records and gaps of a file (`packed`: gzip members count) or of one member."""
    start, bad = (STARTS if packed else VERSION_START), []

    def told(end: int) -> Found:
        if bad:
            yield "gap", (bad[0][0], end, bad[0][1])
            bad.clear()

    while len(buffer) or buffer.more():
        while len(buffer) < 16 and buffer.more():
            pass
        at = buffer.base
        if packed and buffer.data.startswith(MAGIC, buffer.at):
            member = _Inflated(buffer)
            for found in _of_member(member):
                yield from told(at)
                yield found
            reason = member.error
            if not reason:
                if member.reason and not member.given:
                    bad.append((at, member.reason))
                buffer.drop(member.used - len(member.inflate.unused_data))
        else:
            try:
                head, block, end = _parse(buffer)
                yield from told(at)
                yield "record", (head, block)
                buffer.drop(end - buffer.at)
                reason = ""
            except (ValueError, EOFError) as e:
                reason = str(e)
        if reason:
            bad.append((buffer.base, reason))
            buffer.drop(1)
            while len(buffer):  # the next place at which a record may start
                place = start.search(buffer.data, buffer.at)
                if place:
                    buffer.drop(place.start() - buffer.at)
                    break
                buffer.drop(len(buffer) - 6 if len(buffer) > 6 else 0)
                if not buffer.more():
                    buffer.drop(len(buffer))
    yield from told(buffer.base)


def _parse(buffer: _Buffer) -> tuple[dict[str, str], bytes, int]:
    while True:
        try:
            return parse(buffer.data, buffer.at)
        except EOFError:
            if not buffer.more():
                raise


def _of_member(member: _Inflated) -> Found:
    """The checked records of a gzip member and the gaps between them; nothing where no record is valid."""
    buffer, held, sure, waiting = member.buffer, [], True, None

    def gap(a: int, b: int, reason: str) -> tuple[str, object]:
        return "gap", (buffer.base, buffer.base + member.used, f"inflated bytes {a} to {b}: {reason}")

    for what, value in _scan(_Buffer(member), False):
        if what == "gap":
            waiting, member.reason = value, member.reason or value[2]
            continue
        held += [gap(*waiting)] if waiting else []
        waiting = None
        held.append((what, value))
        sure = sure and _has_digest(value[0])
        if sure:
            member.given = True
            yield from held
            held = []
            member.forget()
    if member.error:
        held = [(what, value) for what, value in held if what == "record" and _has_digest(value[0])]
    elif waiting and (held or member.given):
        held.append(gap(*waiting))
    member.given = member.given or bool(held)
    yield from held


def _has_digest(head: dict[str, str]) -> bool:
    return head.get("warc-block-digest", "").startswith("sha1:")


def revisits(pages: DataFrame) -> DataFrame:
    """(key, print, first): rows whose payload a smaller page id has too."""
    rows = text_rows(pages, "page_id", "html").select("key", "print", F.sha1(F.encode("text", "utf-8")).alias("sha1"))
    first = rows.groupBy("sha1").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first <> last")
    return rows.join(first, "sha1").filter("key <> first").select("key", "print", "first").distinct()


def write(pages: DataFrame, folder: str, least_bytes: int = 0, roll: int = 128 << 20) -> DataFrame:
    """Archives `pages` (page_id, url, html) under `folder`; (path, records, bytes) of the finished files."""
    html, page = F.coalesce(F.col("html"), F.lit("")), F.col("page_id").cast("long")
    rows = pages.select(page.alias("doc_id"), F.coalesce(page, F.lit(NO_ID)).alias("key"), F.xxhash64(html).alias("print"),
                        html.alias("text"), F.col("url").cast("string").alias("url"))
    again = revisits(pages).withColumnsRenamed({"key": "k", "print": "p"})
    rows = rows.join(again, (F.col("key") == F.col("k")) & (F.col("print") == F.col("p")), "left").select(
        "doc_id", "url", "text", F.when(F.octet_length("text") >= least_bytes, F.col("first")).alias("first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, system, n, size, path = None, None, 0, 0, ""
        done = []
        for x in batches:
            for page, url, text, first in zip(x["doc_id"], x["url"], x["text"], x["first"]):
                page, first = (None if pd.isna(v) else int(v) for v in (page, first))
                if out is None:
                    system, root = fs.FileSystem.from_uri(folder)
                    system.create_dir(root, recursive=True)
                    path, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{path}", compression=None)
                data = gzip_member(record(page, url, text.encode("utf-8", "surrogatepass"), first, first is not None))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll:
                    out.close()
                    done, out = [*done, (f"{folder}/{path}", n, size)], None
        if out is not None:
            out.close()
            done.append((f"{folder}/{path}", n, size))
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return cut(rows.mapInPandas(run, "path string, records long, bytes long"))


def read(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and gaps (RECORDS) of the archives in the column `path` of `files`; a file is read by one task, in pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = lambda s: None if not s.startswith("<urn:page:") or s[10:-1] == "none" else int(s[10:-1])
        rows: list[tuple] = []
        names = [c.split()[0] for c in RECORDS.split(", ")]
        frame = lambda: pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64", "gap_start": "Int64", "gap_end": "Int64"})
        held = 0
        for x in batches:
            for uri in x["path"]:
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_stream(path, compression=None) as stream:
                    for what, value in salvage(stream):
                        if what == "gap":
                            rows.append((None, None, None, None, None, None, uri, *value))
                        else:
                            head, block = value
                            http, _, payload = block.partition(b"\r\n\r\n")
                            kind = head.get("warc-type")
                            told = head.get("warc-payload-digest", "").removeprefix("sha1:")
                            length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
                            size = len(payload) if kind == "response" or not length else int(length[1])
                            rows.append((number(head.get("warc-record-id", "")), kind, number(head["warc-refers-to"]) if "warc-refers-to" in head else None,
                                         digest(payload) if kind == "response" else told, size, payload if with_payload else None, uri, None, None, None))
                            held += len(payload) * with_payload
                        if len(rows) >= 2000 or held > 8 << 20:
                            yield frame()
                            rows, held = [], 0
        yield frame()

    return files.select("path").mapInPandas(run, RECORDS)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """What the archives of `pages` give back, one row for each record; RuntimeError if that is not every record written."""
    files = write(pages, scratch(pages.sparkSession))
    total = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("records"), F.lit(0)).alias("records")).first()
    rows = cut(read(files.repartition(max(1, total["files"]), "path"), with_payload=False).filter("record_type is not null"))
    back = rows.count()
    if back != total["records"]:
        raise RuntimeError(f"{total['records']} records were written and {back} read back")
    return rows
