"""WARC archives: a writer with payload-digest revisits and a salvage reader.

Writing: payloads are grouped by SHA-1 and SHA-256 (narrow rows only); the record with the largest key of equal
payloads is the response, the others are revisit records that refer to it. Each task writes one archive of gzip
members, one per record, under a temporary name that is moved to the task's final name, so a retried task replaces its
file by the same bytes.

Reading: one task per archive streams it with bounded buffers. A record must pass these checks: whole gzip member
with right CRC, version line, header block, Content-Length equal to the block, payload digest. After a failure the
reader searches from the byte after the failed start for the next valid member (or, in plain archives, the next version
line), goes on there, and logs the bytes between as a quarantined gap (path, start, end, reason). Both kinds of archive
may be mixed in one file.

Defined results: a null payload is empty; repeated keys each give a record, those with the largest key of their group
are responses; a null key is written as the word null and read back as null; an empty table gives one
empty archive per task and no records; extra columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hybridctx.llm.common import shared_path, stored

VERSION = b"WARC/1.1"
GZIP_MAGIC = b"\x1f\x8b\x08"
#: Bytes in which a header block must end.
MAX_HEADER_BYTES = 16 << 20
READ_BYTES = 1 << 20
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)", re.I)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path inside it, for plain paths and URIs (file, hdfs, s3, gs)."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


# ------------------------------------------------------------------------------------------------ writing

def sha1_header(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record_bytes(key, payload: bytes, refers_to=None, is_revisit: bool = False, uri: str | None = None) -> bytes:
    """One WARC record (not compressed). A revisit keeps digest and length of the payload, not the payload."""
    uri = re.sub(r"[\r\n]", " ", uri) if uri else None
    fields = ["WARC-Type: " + ("revisit" if is_revisit else "response"), f"WARC-Record-ID: <urn:page:{_name(key)}>",
              "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: {sha1_header(hashlib.sha1(payload).digest())}",
              f"X-Payload-Length: {len(payload)}"]
    if uri:
        fields.append(f"WARC-Target-URI: {uri}")
    block = payload
    if is_revisit:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                   f"WARC-Refers-To: <urn:page:{_name(refers_to)}>"]
        block = b""
    fields += ["Content-Type: application/octet-stream", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _name(key) -> str:
    """The key in a record id: null as the word, which no key is written as, others with unsafe characters quoted."""
    if key is None:
        return "null"
    name = quote(str(key), safe="")
    return "%6Eull" if name == "null" else name


def member(record: bytes, level: int = 1) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def classify(pages: DataFrame, key: str, payload: str, min_bytes: int) -> DataFrame:
    """Revisits only: (k, refers_to): rows whose payload of at least min_bytes equals that of a larger key."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    small = pages.select(F.col(key).alias("k"), F.octet_length(body).alias("n"),
                         F.sha1(body).alias("h1"), F.sha2(body, 256).alias("h2")).where(F.col("n") >= min_bytes)
    groups = stored(small.groupBy("h1", "h2").agg(F.max("k").alias("refers_to"), F.count(F.lit(1)).alias("n_rows"))
                    .where("n_rows > 1"), "warc-groups")
    return small.join(groups, ["h1", "h2"]).where(~F.col("k").eqNullSafe(F.col("refers_to"))) \
        .select("k", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", uri: str | None = None,
                   min_revisit_bytes: int = 1000, compressed: bool = True) -> DataFrame:
    """Write one archive per task below folder; the manifest (path, records, bytes), already computed."""
    revisits = classify(pages, key, payload, min_revisit_bytes).withColumnRenamed("k", "__rk")
    rows = pages.select(F.col(key).alias("__key"), F.col(payload).alias("__payload"),
                        (F.col(uri) if uri else F.lit(None).cast("string")).alias("__uri"))
    rows = rows.join(revisits, F.col("__key").eqNullSafe(F.col("__rk")), "left").select(
        "__key", "__payload", "__uri", F.col("refers_to").alias("__ref"), F.coalesce(
            F.octet_length(F.coalesce("__payload", F.lit(""))) >= min_revisit_bytes, F.lit(False)).alias("__long"),
        (F.col("refers_to").isNotNull()).alias("__revisit"))

    def write(batches):
        fs, base = file_system(folder)
        fs.create_dir(base, recursive=True)
        ctx = TaskContext.get()
        name = f"part-{ctx.partitionId():06d}.warc" + (".gz" if compressed else "")
        tmp = f"{base}/.{name}.{ctx.taskAttemptId()}"
        n = size = 0
        with fs.open_output_stream(tmp, compression=None) as out:
            for batch in batches:
                c = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
                for i in range(batch.num_rows):
                    text = c["__payload"][i].as_py()
                    rec = record_bytes(c["__key"][i].as_py(), (text or "").encode("utf-8", "surrogatepass"),
                                       c["__ref"][i].as_py(), c["__revisit"][i].as_py(), c["__uri"][i].as_py())
                    data = member(rec) if compressed else rec
                    out.write(data)
                    n, size = n + 1, size + len(data)
        fs.move(tmp, f"{base}/{name}")
        uri_base = folder.rstrip("/")
        yield pa.RecordBatch.from_arrays([pa.array([f"{uri_base}/{name}"]), pa.array([n]), pa.array([size])],
                                         names=["path", "records", "bytes"])

    return stored(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


# ------------------------------------------------------------------------------------------------ reading

class Window:
    """Bytes of a stream by absolute offset; keeps only what lies at or after `base`."""

    def __init__(self, stream, size: int | None = None):
        self.stream, self.base, self.data, self.ended, self.size = stream, 0, bytearray(), False, size

    def fill(self, upto: int) -> bool:
        """Have bytes up to the absolute offset `upto`; False if the stream ends before (known at once from its size, so a
        wrong length field makes nobody read a whole file)."""
        if self.size is not None and upto > self.size and self.size > self.end() + READ_BYTES:
            return False
        while not self.ended and self.base + len(self.data) < upto:
            more = self.stream.read(READ_BYTES)
            if not more:
                self.ended = True
            self.data += more
        return self.base + len(self.data) >= upto

    def at(self, start: int, n: int) -> bytes:
        self.fill(start + n if self.size is None else min(start + n, self.size))
        return bytes(self.data[start - self.base:start - self.base + n])

    def drop(self, before: int):
        cut = min(before - self.base, len(self.data))
        if cut >= READ_BYTES or (cut > 0 and self.ended):
            del self.data[:cut]
            self.base += cut

    def end(self) -> int:
        return self.base + len(self.data)


class Damaged(Exception):
    """Why a record at some place can't be read."""


def parse_record(get, have) -> tuple[dict, bytes, int]:
    """(fields, block, length) of a record; get(a, n) gives bytes, have(n) whether n bytes are there."""
    size, sep = 1 << 10, -1
    while True:
        head = get(0, size)
        if not _VERSION_LINE.match(head):
            raise Damaged("no version line")
        sep = head.find(b"\r\n\r\n")
        if sep >= 0 or len(head) < size or size > MAX_HEADER_BYTES:
            break
        size *= 4
    if sep < 0:
        raise Damaged("header block without end")
    fields = {}
    for line in head[:sep].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        fields[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("content length is no number")
    n = int(length)
    if not have(sep + 4 + n + 4):
        raise Damaged("record ends early")
    block = get(sep + 4, n)
    if get(sep + 4 + n, 4) != b"\r\n\r\n":
        raise Damaged("content length does not meet the record end")
    want = fields.get("warc-payload-digest", "")
    if want.startswith("sha1:") and fields.get("warc-type") != "revisit" \
            and sha1_header(hashlib.sha1(block).digest()) != want:
        raise Damaged("payload digest differs")
    return fields, block, sep + 4 + n + 4


def _gzip_record(w: Window, at: int) -> tuple[dict, bytes, int]:
    """The record of the gzip member at an offset and the member's length."""
    z, out, pos, limit = zlib.decompressobj(31), bytearray(), at, None
    try:
        while not z.eof:
            piece = w.at(pos, 1 << 16)
            if not piece:
                raise Damaged("member ends early")
            out += z.decompress(piece)
            pos += len(piece)
            if limit is None:  # a member is as long as its header says
                sep = out.find(b"\r\n\r\n", 0, MAX_HEADER_BYTES)
                length = _LENGTH.search(out, 0, sep) if sep >= 0 else None
                limit = sep + 8 + int(length.group(1)) if length else MAX_HEADER_BYTES if sep < 0 else sep
                if sep < 0 and len(out) <= MAX_HEADER_BYTES:
                    limit = None
            if limit is not None and len(out) > limit:
                raise Damaged("member holds more than its record")
    except zlib.error as e:
        raise Damaged(f"member is damaged: {e}") from e
    fields, block, n = parse_record(lambda a, k: bytes(out[a:a + k]), lambda k: len(out) >= k)
    if n != len(out):
        raise Damaged("member holds more than its record")
    return fields, block, pos - len(z.unused_data) - at


def _plain_record(w: Window, at: int) -> tuple[dict, bytes, int]:
    return parse_record(lambda a, k: w.at(at + a, k), lambda k: w.fill(at + k))


def _candidate(w: Window, at: int) -> int:
    """Next offset >= at where a member or a version line may start; the end of the stream if none."""
    while True:
        found = [p for p in (w.data.find(GZIP_MAGIC, at - w.base), w.data.find(b"WARC/1.", at - w.base)) if p >= 0]
        if found:
            return w.base + min(found)
        at = max(at, w.end() - 8)
        w.drop(at)
        if not w.fill(w.end() + 1):
            return w.end()


def salvage(stream, size: int | None = None) -> Iterator[tuple[str, int, int, dict | None, bytes | None, str | None]]:
    """('record', start, end, fields, block, None) and ('gap', start, end, None, None, reason) in file order. size: bytes of
    the stream, if known."""
    w, at, bad, reason = Window(stream, size), 0, None, None
    while w.fill(at + 1):
        try:
            gz = w.at(at, 3) == GZIP_MAGIC
            fields, block, n = (_gzip_record if gz else _plain_record)(w, at)
        except Damaged as e:
            if bad is None:
                bad, reason = at, str(e)
            at = _candidate(w, at + 1)
            continue
        if bad is not None:
            yield "gap", bad, at, None, None, reason
            bad = None
        yield "record", at, at + n, fields, block, None
        at += n
        w.drop(at)
    if bad is not None:
        yield "gap", bad, w.end(), None, None, reason


ARCHIVE_SCHEMA = ("path string, kind string, start long, end long, reason string, record_id string, record_type string, "
                  "target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary")


def _row(path, kind, start, end, fields, block, reason, with_payload) -> tuple:
    if kind == "gap":
        return path, kind, start, end, reason, None, None, None, None, None, None, None
    digest = fields.get("warc-payload-digest", "")
    revisit = fields.get("warc-type") == "revisit"
    size = fields.get("x-payload-length", "") if revisit else str(len(block))
    sha = base64.b32decode(digest[5:]).hex() if revisit and digest.startswith("sha1:") \
        else hashlib.sha1(block).hexdigest()
    return (path, kind, start, end, None, fields.get("warc-record-id", "").strip("<>"), fields.get("warc-type"),
            fields.get("warc-target-uri"), fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
            int(size) if size.isdigit() else None, sha, block if with_payload else None)


def read_archives(spark: SparkSession, manifest: DataFrame, with_payload: bool = True, complete: bool = False) -> DataFrame:
    """Records and quarantined gaps of the archives named in manifest.path (see ARCHIVE_SCHEMA). With `complete`, the job
    fails unless every archive gives the number of records that manifest.records names."""
    schema = pa.schema([("path", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                        ("reason", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()),
                        ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("payload", pa.binary())])

    def read(batches):
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, inner = file_system(path)
                rows, held, n, gaps = [], 0, 0, []
                with fs.open_input_stream(inner, compression=None) as f:
                    for found in salvage(f, fs.get_file_info(inner).size):
                        rows.append(_row(path, *found, with_payload))
                        n += found[0] == "record"
                        if found[0] == "gap" and len(gaps) < 5:
                            gaps.append(f"{found[1]}-{found[2]} {found[5]}")
                        held += len(found[4] or b"") if with_payload else 0
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
                if complete and n != expected:
                    raise ValueError(f"{path}: {n} of {expected} records could be read; first gaps: {gaps}")

    # one archive a task, dealt evenly (a hash of the paths would put several into one)
    names = manifest.select("path", F.col("records") if complete else F.lit(None).cast("long").alias("records"))
    return names.repartition(max(1, manifest.count())).mapInArrow(read, ARCHIVE_SCHEMA)


def round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html", min_revisit_bytes: int = 1000) -> DataFrame:
    """Write the pages as archives in the shared folder, read them back: key, payload_bytes, payload_digest,
    record_type, refers_to. Fails if a record written can't be read again."""
    spark = pages.sparkSession
    manifest = write_archives(pages, shared_path(spark, "warc"), key, payload, min_revisit_bytes=min_revisit_bytes)
    kind = pages.schema[key].dataType
    page = lambda c: F.when(F.col(c) != "urn:page:null", F.url_decode(F.expr(f"substring({c}, 10)"))).cast(kind)
    return read_archives(spark, manifest, with_payload=False, complete=True).where("kind = 'record'").select(
        page("record_id").alias(key), "payload_bytes", "payload_digest", "record_type",
        page("refers_to").alias("refers_to"))
