"""WARC archives as a PySpark data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Writing: a task writes one archive, a gzip member for each record, and beside it an index of the members' offsets. Files appear under
their final names only when the job commits; what lost or repeated tasks of the job have left is deleted then.

Reading: the driver plans ranges of about `split` bytes from the files' sizes alone. A task reads the members that begin in its range; it
finds the first in the index, or in a file without one by looking for a gzip header behind which a record begins. Predicates on record_type, record_id, target_uri, payload_digest and refers_to are pushed down to the reader (`read_archives`). A record's headers are
inflated and parsed first; if a predicate rejects them, the reader goes to the next member without inflating the rest. Payloads are
decoded only if the schema has the payload column.

Predicates go by an option of the scan. With the option pushdown=true, and spark.sql.python.filterPushdown.enabled set, the reader takes
filters from Spark's optimizer as well; it is not the default, as Spark 4.1.2 keeps the filters of one query for later queries on the same
frame.

The path must be a folder that all nodes mount.
"""

from __future__ import annotations

import base64
import contextlib
import glob
import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote, unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from spindrift.llm.shared import columns, documents, prepared, shared_folder

FIELDS = {
    "record_id": ("WARC-Record-ID", pa.string()),
    "record_type": ("WARC-Type", pa.string()),
    "target_uri": ("WARC-Target-URI", pa.string()),
    "payload_digest": ("WARC-Payload-Digest", pa.string()),
    "refers_to": ("WARC-Refers-To", pa.string()),
    "payload_length": (None, pa.int64()),
    "payload": (None, pa.binary()),
}
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_length long, payload binary"
INDEX = ".offsets"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEAD_END = b"\r\n\r\n"
GZIP = b"\x1f\x8b\x08"


def folder_of(path: str) -> str:
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"archives need a mounted folder, not {parts.scheme}://")
    return parts.path


def sha1_base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def sha1_hex(header: str | None) -> str | None:
    """Bare lower-case hex of a sha1:BASE32 header; other digests stay as they are."""
    if header is None or not header.startswith("sha1:"):
        return header
    return base64.b32decode(header[5:]).hex()


def encoded(value: str) -> str:
    """A header value; characters that would end the line or the field, and per cent signs, are escaped."""
    return quote(value, safe="".join(chr(c) for c in range(33, 127) if c != 37))


def record(row: dict) -> bytes:
    """One record. A revisit has the HTTP header of the full payload, but no payload."""
    payload = row["payload"] or b""
    kind = row["record_type"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{encoded(row['record_id'])}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {encoded(row['target_uri'])}")
    if row["payload_digest"] is not None:
        lines.append(f"WARC-Payload-Digest: {sha1_base32(row['payload_digest'])}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{encoded(row['refers_to'])}>", f"WARC-Profile: {IDENTICAL}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + HEAD_END + body + HEAD_END


def parsed(head: bytes) -> dict[str, str]:
    """Headers of a record, names in lower case."""
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, sep, value = line.partition(":")
        if sep:
            out[name.strip().lower()] = value.strip()
    return out


def field_of(headers: dict[str, str], name: str) -> str | None:
    header = FIELDS[name][0]
    value = headers.get(header.lower())
    if value is None:
        return None
    if name in ("record_id", "refers_to"):
        value = value.strip("<>")
    return sha1_hex(value) if name == "payload_digest" else unquote(value)


@dataclass
class Stretch(InputPartition):
    """The members of a file that begin at `start` or later, before `end`."""

    path: str
    start: int
    end: int


def indexed(part: Stretch) -> list[int] | None:
    """Offsets of the members of a stretch by the file's index; None without one. Reads only the stretch's part of the index."""
    if not os.path.exists(part.path + INDEX):
        return None
    size = os.path.getsize(part.path + INDEX) // 8
    if not size:
        return []
    every = np.memmap(part.path + INDEX, "<i8", "r", shape=(size,))
    first, after = np.searchsorted(every, [part.start, part.end])
    return every[first:after].tolist()


def first_member(f: BinaryIO, start: int, end: int) -> int:
    """Offset of the first member of a file that begins in the range and holds a record; `end` without one."""
    at = start
    while at < end:
        f.seek(at)
        data = f.read(1 << 16)
        if not data:
            return end
        found = data.find(GZIP)
        while found >= 0:
            f.seek(at + found)
            with contextlib.suppress(zlib.error):
                if at + found < end and zlib.decompressobj(31).decompress(f.read(4096), 5) == b"WARC/":
                    return at + found
            found = data.find(GZIP, found + 1)
        at += max(1, len(data) - len(GZIP) + 1)
    return end


class Reader(DataSourceReader):
    def __init__(self, options: dict, names: list[str]):
        self.path, self.split, self.names = folder_of(options["path"]), int(options.get("split", 16 << 20)), names
        self.filters = [tuple(x) for x in json.loads(options.get("predicates", "[]"))]
        self.n_own = len(self.filters)

    def accepts(self, headers: dict[str, str]) -> bool:
        for kind, name, want in self.filters:
            value = field_of(headers, name)
            ok = {"EqualTo": lambda: value is not None and value == want, "In": lambda: value is not None and value in want, "IsNull": lambda: value is None, "IsNotNull": lambda: value is not None, "StringStartsWith": lambda: value is not None and value.startswith(want)}[kind]()
            if not ok:
                return False
        return True

    def partitions(self) -> list[Stretch]:
        out = []
        for path in sorted(glob.glob(os.path.join(glob.escape(self.path), "*.warc.gz"))):
            size = os.path.getsize(path)
            out += [Stretch(path, at, min(size, at + self.split)) for at in range(0, size, self.split)]
        return out

    def read(self, partition: Stretch | None) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row, size in self.rows(partition) if partition else ():
            rows.append(row)
            held += size
            if held > 8 << 20 or len(rows) >= 5000:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, FIELDS[n][1]) for n, x in zip(self.names, zip(*rows, strict=True), strict=True)], self.names)

    def rows(self, part: Stretch) -> Iterator[tuple[tuple, int]]:
        wants_payload = "payload" in self.names
        wants_http = wants_payload or "payload_length" in self.names
        offsets = indexed(part)
        with open(part.path, "rb") as f:
            at = first_member(f, part.start, part.end) if offsets is None else part.start
            waiting = iter(offsets or ())
            while True:
                if offsets is not None:
                    at = next(waiting, part.end)
                if at >= part.end:
                    break
                f.seek(at)
                buffered = b""
                member, data = zlib.decompressobj(31), b""

                def more(limit: int, member=member) -> bytes:
                    """Up to `limit` further bytes of the member; none at its end."""
                    nonlocal buffered
                    while not member.eof:
                        source = member.unconsumed_tail or buffered or f.read(1 << 16)
                        if not member.unconsumed_tail:
                            buffered = b""
                        if not source:
                            return b""
                        if got := member.decompress(source, limit):
                            return got
                    return b""

                while (cut := data.find(HEAD_END)) < 0 and (got := more(4096)):
                    data += got
                if cut < 0:
                    if not data:
                        break
                    raise ValueError(f"a record of {part.path} has no header")
                headers = parsed(data[:cut])
                if self.accepts(headers):
                    body, length = data[cut + 4 :], int(headers.get("content-length", 0))
                    http = "http" in headers.get("content-type", "")
                    if wants_http and http:
                        while (end := body.find(HEAD_END)) < 0 and (got := more(4096)):
                            body += got
                    if wants_payload:
                        chunks = [body]
                        size = len(body)
                        while size < length and (got := more(1 << 20)):
                            chunks.append(got)
                            size += len(got)
                        body = b"".join(chunks)[:length]
                    payload_length, payload = length, body
                    if wants_http and http and end >= 0:
                        payload_length = int(parsed(b"\r\n" + body[:end]).get("content-length", length - end - 4))
                        payload = body[end + 4 :]
                    special = {"payload_length": payload_length, "payload": payload}
                    yield tuple(special[n] if n in special else field_of(headers, n) for n in self.names), 200 + len(payload) * wants_payload
                if offsets is None:  # the next member starts where this one ends
                    while not member.eof and more(1 << 20):
                        pass
                    at = f.tell() - len(member.unused_data)


class FilteringReader(Reader):
    """Takes filters from Spark's optimizer as well, in place of those that it took before; for a frame that one query uses."""

    def pushFilters(self, filters: list) -> Iterable:
        known = {"record_id", "record_type", "target_uri", "payload_digest", "refers_to"}
        self.filters = self.filters[: self.n_own]
        for f in filters:
            if isinstance(f, EqualTo | In | IsNull | IsNotNull | StringStartsWith) and len(f.attribute) == 1 and f.attribute[0] in known:
                self.filters.append((type(f).__name__, f.attribute[0], getattr(f, "value", None)))
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    part: str
    name: str


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.level, self.job = folder_of(options["path"]), int(options.get("level", 6)), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.path, exist_ok=True)
        name = f"{self.job}-{uuid.uuid4().hex}"
        part, offsets, at = os.path.join(self.path, f".{name}.part"), [], 0
        with open(part, "wb") as out:
            for batch in iterator:
                for i in range(batch.num_rows):
                    squeeze = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                    data = squeeze.compress(record(batch.slice(i, 1).to_pylist()[0])) + squeeze.flush()
                    out.write(data)
                    offsets.append(at)
                    at += len(data)
        with open(part + INDEX, "wb") as out:
            out.write(struct.pack(f"<{len(offsets)}q", *offsets))
        return Written(part, f"part-{name}.warc.gz")

    def commit(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                os.replace(m.part + INDEX, os.path.join(self.path, m.name + INDEX))
                os.replace(m.part, os.path.join(self.path, m.name))
        self.abort(messages)

    def abort(self, messages: list) -> None:
        """Delete the job's parts, those of tasks whose messages never came included."""
        for path in glob.glob(os.path.join(glob.escape(self.path), f".{self.job}-*")):
            with contextlib.suppress(FileNotFoundError):
                os.remove(path)


class Warc(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        if unknown := set(schema.names) - set(FIELDS):
            raise ValueError(f"archives have no {', '.join(sorted(unknown))}")
        return (FilteringReader if self.options.get("pushdown") == "true" else Reader)(self.options, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if missing := {"record_id", "record_type", "target_uri", "payload_digest", "refers_to", "payload"} - set(schema.names):
            raise ValueError(f"the frame has no {', '.join(sorted(missing))}")
        if overwrite:
            raise ValueError("archives are added to, not overwritten")
        return Writer(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known; workers must find this package from then on."""
    prepared(spark).dataSource.register(Warc)


def read_archives(spark: SparkSession, path: str, *predicates: tuple[str, str, object], columns: list[str] | None = None, split: int = 16 << 20) -> DataFrame:
    """Records of the archives in a folder that satisfy all predicates (kind, column, value), and of their columns only those named.

    Kinds: EqualTo, In (a list), IsNull, IsNotNull, StringStartsWith. Without "payload" among the columns no payload is decoded.
    """
    kinds = {"EqualTo", "In", "IsNull", "IsNotNull", "StringStartsWith"}
    if bad := [p for p in predicates if p[0] not in kinds or FIELDS.get(p[1], (None,))[0] is None]:
        raise ValueError(f"can't push down {bad}")
    register(spark)
    types = dict(x.split(" ") for x in SCHEMA.split(", "))
    schema = ", ".join(f"{c} {types[c]}" for c in columns or types)
    return spark.read.format("warc").schema(schema).option("predicates", json.dumps(predicates)).option("split", str(split)).load(path)


def page_id_of(column) -> F.Column:
    """The id in urn:page:ID; null for urn:page:null."""
    return F.regexp_extract(column, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")


def page_records(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """What to write: a record for each row. Of equal payloads of at least `least` bytes, those with the largest id are responses and others revisit it.

    Smaller payloads are all responses, as are payloads of which all ids are null. Null html is an empty payload; a null url has no header.
    Rows that repeat the largest id are responses too. Digests are counted with a map-side maximum; only digests that more than one row
    has go on to the join, where rows of small payloads have keys of their own, so none is hot but a repeated payload, which Spark splits.
    """
    own = columns(pages, page_id=id_col, url=url_col, html=html_col)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = own.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("payload_digest"))
    long = F.length("payload") >= least
    holders = rows.where(long).groupBy("payload_digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1 AND holder IS NOT NULL").select(F.col("payload_digest").alias("key"), "holder")
    keyed = rows.withColumn("key", F.when(long, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))))
    joined = keyed.join(holders, "key", "left")
    revisit = F.col("holder").isNotNull() & ~F.col("holder").eqNullSafe(F.col("page_id"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    return joined.select(urn(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), "payload_digest", F.when(revisit, urn(F.col("holder"))).alias("refers_to"), "payload")


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Responses are read with their payloads, whose lengths and digests are taken anew; revisits by a scan of its own that decodes none."""
    register(spark)
    folder = shared_folder(spark, "warc")
    page_records(documents(spark, sf_dir, "pages")).write.format("warc").mode("append").save(folder)
    page = page_id_of(F.col("record_id")).alias("page_id")
    full = read_archives(spark, folder, ("EqualTo", "record_type", "response"), columns=["record_id", "payload"])
    again = read_archives(spark, folder, ("EqualTo", "record_type", "revisit"), columns=["record_id", "payload_digest", "refers_to", "payload_length"])
    responses = full.select(page, F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(again.select(page, F.col("payload_length").alias("payload_bytes"), "payload_digest", F.lit("revisit").alias("record_type"), page_id_of(F.col("refers_to")).alias("refers_to")))


#: The same in DuckDB SQL.
OP6_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
h AS (SELECT d, max(page_id) AS holder FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN holder <> page_id OR (page_id IS NULL AND holder IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN holder <> page_id OR (page_id IS NULL AND holder IS NOT NULL) THEN holder END AS refers_to
FROM p LEFT JOIN h ON p.d = h.d AND p.n >= 1000
"""
