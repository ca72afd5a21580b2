"""WARC archives: one gzip member for each record, written by tasks and read back in sequence."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.llm.common import packed, stored, text_or_empty
from loreline.session import scratch_path

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:loreline:page:"
#: Bytes read and decompressed at a time.
CHUNK = 1 << 16
#: An archive is closed and a new one begun when it is larger than this.
ARCHIVE_BYTES = 1 << 28
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def field_text(value: object) -> str:
    """A header value on one line: control characters, line ends above all, are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(value))


def member(page: str, url: str | None, date: str, payload: bytes, refers_to: str | None) -> bytes:
    """A response record, or a revisit record when the payload stands elsewhere, as one gzip member."""
    head = HTTP_HEAD % len(payload)
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{RECORD_ID}{page}>"), ("WARC-Date", date)]
    if isinstance(url, str):
        fields.append(("WARC-Target-URI", field_text(url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest(payload)}"))
    if refers_to is None:
        block = head + payload
    else:
        block = head
        fields += [("WARC-Refers-To", f"<{RECORD_ID}{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in fields)
    pack = zlib.compressobj(wbits=31)
    return pack.compress(lines + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, sha, response) of pages (page_id, payload) whose payload stands in a page with a larger id too.

    Payloads are compared by SHA-256 and length. A payload that many pages share is aggregated before the
    shuffle and joined as one narrow row for each of them.
    """
    keyed = pages.withColumns({"sha": F.unhex(F.sha2("payload", 256)), "bytes": F.octet_length("payload")})
    last = stored(keyed.groupBy("sha", "bytes").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).where("copies > 1").drop("copies"), "warc-shared")
    narrow = stored(keyed.select("page_id", "sha", "bytes"), "warc-keys")
    later = narrow.join(last, ["sha", "bytes"]).where("page_id < response OR page_id IS NULL AND response IS NOT NULL")
    return stored(later.select("page_id", "sha", "response").distinct(), "warc-revisits")


def _writer(folder: str, date: str, least: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, name, size, n = None, "", 0, 0

        def close():
            out.close()
            # A file gets its name when whole; a task that is lost leaves only a part file that no manifest lists.
            store.move(f"{root}/{name}.part", f"{root}/{name}")
            return pd.DataFrame({"archive": [f"{folder.rstrip('/')}/{name}"], "records": [n]})

        for batch in batches:
            for page, url, payload, refers in zip(batch["page"], batch["url"], batch["payload"], batch["refers_to"], strict=True):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/{name}.part", compression=None)
                data = payload.encode("utf-8", "surrogatepass")
                revisit = refers if isinstance(refers, str) and len(data) >= least else None
                record = member(page, url, date, data, revisit)
                out.write(record)
                size, n = size + len(record), n + 1
                if size >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return write


def write_warc(
    pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
    date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0,
) -> DataFrame:
    """Write a record for each page below `folder` (a URI all executors can reach); returns (archive, records).

    Of pages with equal payloads of at least `least_bytes` bytes the one with the largest id is a response
    and the others revisit it. Each task writes archives of its own. A null payload is empty, a page without
    url has no target field, a null id is written as an empty one and counts as the smallest. Rows that
    repeat an id with its payload are of one type. Line ends in urls are percent-encoded.
    """
    rows = packed(pages).select(
        F.col(f"row.`{id_col}`").alias("page_id"), F.col(f"row.`{url_col}`").cast("string").alias("url"), text_or_empty(F.col(f"row.`{text_col}`")).alias("payload")
    )
    shared = revisits(rows).toDF("r_id", "r_sha", "response")
    same = F.col("page_id").eqNullSafe(F.col("r_id")) & (F.unhex(F.sha2("payload", 256)) == F.col("r_sha"))
    marked = rows.join(shared, same, "left").select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page"), "url", "payload", F.col("response").cast("string").alias("refers_to")
    )
    return stored(marked.mapInPandas(_writer(folder, date, least_bytes), "archive string, records long"), "warc-manifest")


class Members:
    """Bytes of a stream of gzip members, decompressed as they are asked for, one member after the other."""

    def __init__(self, stream):
        self.stream, self.rest, self.unpack = stream, b"", None

    def next_member(self) -> bool:
        """Step to the next member; false at the end of the archive."""
        if not self.rest:
            self.rest = self.stream.read(CHUNK)
        self.unpack, self.ready = zlib.decompressobj(wbits=31), bytearray()
        return bool(self.rest)

    def more(self) -> bool:
        """Decompress some more of the member; false at its end."""
        while not self.unpack.eof:
            data = self.unpack.unconsumed_tail or self.rest or self.stream.read(CHUNK)
            if not data:
                raise ValueError("the archive ends inside a record")
            self.rest = b""
            out = self.unpack.decompress(data, CHUNK)
            if self.unpack.eof:
                self.rest = self.unpack.unused_data
            if out:
                self.ready += out
                return True
        return False

    def line(self) -> bytes:
        while (at := self.ready.find(b"\r\n")) < 0:
            if not self.more():
                raise ValueError("a header line has no end")
        out = bytes(self.ready[:at])
        del self.ready[: at + 2]
        return out

    def take(self, n: int) -> bytes:
        while len(self.ready) < n:
            if not self.more():
                raise ValueError("a block is shorter than its content length")
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out


def records(stream) -> Iterator[dict]:
    """Records of an archive, in sequence: fields by lower-case name, `block`, and `payload` (None in revisits).

    Framing is by content length, and block and payload digests are verified. A damaged archive raises.
    """
    members = Members(stream)
    while members.next_member():
        if members.line() != VERSION:
            raise ValueError("not a record of this version")
        fields: dict[str, str] = {}
        while line := members.line():
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            fields[name.lower()] = value.strip()
        block = members.take(int(fields["content-length"]))
        if members.take(4) != b"\r\n\r\n" or members.more():
            raise ValueError("a record does not end with its member")
        if fields.get("warc-block-digest") != f"sha1:{digest(block)}":
            raise ValueError("block digest differs")
        payload = None
        if fields["warc-type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if fields.get("warc-payload-digest") != f"sha1:{digest(payload)}":
                raise ValueError("payload digest differs")
        yield fields | {"block": block, "payload": payload}


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def named(urn: str | None) -> str | None:
        return None if urn is None else urn.strip("<>").removeprefix(RECORD_ID)

    for batch in batches:
        for archive in batch["archive"]:
            store, path = fs.FileSystem.from_uri(archive)
            rows, held = [], 0
            with store.open_input_stream(path, compression=None) as stream:
                for r in records(stream):
                    rows.append((
                        named(r["warc-record-id"]), r["warc-type"], r.get("warc-target-uri"), r["warc-payload-digest"].removeprefix("sha1:"), named(r.get("warc-refers-to")),
                        None if r["payload"] is None else r["payload"].decode("utf-8", "surrogatepass"),
                    ))
                    held += len(r["block"])
                    if len(rows) >= 500 or held >= 16 << 20:
                        yield pd.DataFrame(rows, columns=COLUMNS)
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=COLUMNS)


COLUMNS = ["page", "record_type", "url", "payload_digest", "refers_to", "payload"]


def read_warc(manifest: DataFrame) -> DataFrame:
    """Records of the archives named in `manifest`: page, record_type, url, payload_digest, refers_to, payload.

    One task reads an archive from its start to its end, in small pieces. Revisits have no payload here.
    """
    # A task for each archive, as far as that goes: Spark would join such short rows into one task.
    spread = manifest.select("archive").repartition(max(1, min(manifest.count(), 10_000)))
    return spread.mapInPandas(_read, ", ".join(f"{c} string" for c in COLUMNS))


def archive_folder(spark) -> str:
    """A fresh folder for archives, as a URI, under the shared folder of the cluster."""
    path = scratch_path(spark, "warc")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
