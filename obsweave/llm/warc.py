"""WARC archives as a Spark data source: `spark.read.format("warc")` and `df.write.format("warc")`.

Writing makes one archive per task and rotation size, every record in a gzip member of its own whose header says how
long the member is, so that readers can step over it. Reading plans one partition per archive. A record's header is
inflated and parsed first; a record that the pushed filters on `record_type` and the other header columns refuse is
stepped over, and payloads are inflated and decoded only where the payload columns are asked for.

Columns: record_id, record_type, target_uri, date, refers_to, payload_digest, payload_bytes (long, the full payload's
length also for a revisit), payload (binary; null for a revisit and where option `payload` is "false"), archive,
offset (long). Missing headers give null. Members without a length are inflated to find their end; plain archives
are stepped over by Content-Length. An empty folder gives no rows.

Folders may lie in any store that pyarrow's file systems open.
"""

from __future__ import annotations

import struct
import uuid
import zlib

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, IsNotNull, IsNull, StringStartsWith, WriterCommitMessage

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, "
    "payload_bytes long, payload binary, archive string, offset long"
)

# Fixed values of the format: header names, and the extra field that holds a member's length.
_HEADERS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EXTRA = b"SL"

# An archive is closed beyond so many compressed bytes.
ROTATE = 256 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def member(record: bytes, level: int = 3) -> bytes:
    """A gzip member with its own length in the extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    total = 10 + 2 + 4 + 8 + len(body) + 8
    extra = _EXTRA + struct.pack("<HII", 8, total, len(record) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + b"\0\0\0\0" + b"\x04\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(row) -> bytes:
    """A response with its payload, or a revisit that has only the response's HTTP header."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else bytes(row["payload"] or b"")
    size = row["payload_bytes"] if revisit else len(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    lines = ["WARC/1.1"]
    for column, header in _HEADERS.items():
        if row[column] is not None:
            value = f"sha256:{row[column]}" if column == "payload_digest" else str(row[column]).replace("\r", "%0D").replace("\n", "%0A")
            lines.append(f"{header}: {value}")
    if revisit:
        lines.append(f"WARC-Profile: {_PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Done(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class Writer(DataSourceWriter):
    """Each attempt of a task writes files of its own; those of attempts that do not count are removed at commit."""

    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    def write(self, rows):
        where, folder = store(self.path)
        where.create_dir(folder, recursive=True)
        attempt, files, out, size = uuid.uuid4().hex, [], None, 0
        for row in rows:
            if out is None or size > ROTATE:
                if out is not None:
                    out.close()
                files.append(f"{folder}/{self.job}-{attempt}-{len(files):05d}.warc.gz")
                out, size = where.open_output_stream(files[-1], compression=None), 0
            data = member(record_bytes(row))
            out.write(data)
            size += len(data)
        if out is not None:
            out.close()
        return Done(files)

    def commit(self, messages):
        where, folder = store(self.path)
        good = {f for m in messages if m for f in m.files}
        for x in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if x.base_name.startswith(self.job) and x.path not in good and f"/{x.path.lstrip('/')}" not in good:
                where.delete_file(x.path)

    def abort(self, messages):
        self.commit([])


class Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.filters = path, payload, []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, IsNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in _HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        where, folder = store(self.path)
        found = where.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        return [Archive(x.path) for x in sorted(found, key=lambda x: x.path) if x.is_file and x.path.endswith((".warc", ".warc.gz"))]

    def read(self, partition: Archive | None):
        if partition is None:  # what Spark hands over where there are no partitions
            return
        where, _ = store(self.path)
        with where.open_input_file(partition.path) as f:
            for offset, head, rest in records(f, partition.path.endswith(".gz")):
                values = {c: head.get(h.lower()) for c, h in _HEADERS.items()}
                if values["payload_digest"]:
                    values["payload_digest"] = values["payload_digest"].rpartition(":")[2]
                if all(passes(f, values[f.attribute[0]]) for f in self.filters):
                    size, payload = None, None
                    if values["record_type"] in ("response", "revisit"):
                        size, payload = http_payload(rest(), values["record_type"] == "revisit", self.payload)
                    yield (*values.values(), size, payload, partition.path, offset)


class Warc(DataSource):
    """Options: path (folder of archives), payload ("false" leaves payloads undecoded)."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite):
        return Writer(self.options["path"])


def passes(f, value) -> bool:
    if isinstance(f, EqualTo):
        return value is not None and value == f.value
    if isinstance(f, In):
        return value is not None and value in f.value
    if isinstance(f, StringStartsWith):
        return value is not None and value.startswith(f.value)
    return (value is None) == isinstance(f, IsNull)


def http_payload(block: bytes, revisit: bool, wanted: bool) -> tuple[int | None, bytes | None]:
    """Length of the full payload, and the payload where there is one and it is wanted."""
    head, _, body = block.partition(b"\r\n\r\n")
    if not revisit:
        return len(body), body if wanted else None
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            return int(value), None
    return None, None


def headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def records(f, gzipped: bool):
    """(offset, header, function that gives the block) of each record; the block is read only when asked for."""
    size, at = f.size(), 0
    while at < size:
        if gzipped:
            length, head, rest = _member_at(f, at, size)
        else:
            length, head, rest = _plain_at(f, at, size)
        if head:
            yield at, head, rest
        at += length


def _plain_at(f, at: int, size: int):
    raw = b""
    while b"\r\n\r\n" not in raw and at + len(raw) < size:
        raw += f.read_at(min(8192, size - at - len(raw)), at + len(raw))
    top, _, _ = raw.partition(b"\r\n\r\n")
    head = headers(top)
    start, length = at + len(top) + 4, int(head.get("content-length", 0))
    return len(top) + 4 + length + 4, head, lambda: f.read_at(length, start)


def _member_at(f, at: int, size: int):
    first = f.read_at(min(4096, size - at), at)
    total = None
    if first[3] & 4:  # extra fields
        extra, k = first[12:12 + struct.unpack("<H", first[10:12])[0]], 0
        while k + 4 <= len(extra):
            n = struct.unpack("<H", extra[k + 2:k + 4])[0]
            if extra[k:k + 2] == _EXTRA:
                total = struct.unpack("<I", extra[k + 4:k + 8])[0]
            k += 4 + n
    unpack, top, read = zlib.decompressobj(31), b"", first
    at_in = len(first)
    while b"\r\n\r\n" not in top and not unpack.eof:
        top += unpack.decompress(unpack.unconsumed_tail or read, 2048)
        if not unpack.unconsumed_tail and b"\r\n\r\n" not in top and not unpack.eof:
            if at + at_in >= size:
                break
            read = f.read_at(min(1 << 16, size - at - at_in), at + at_in)
            at_in += len(read)
    raw, _, begun = top.partition(b"\r\n\r\n")
    head = headers(raw) if raw.startswith(b"WARC/") else {}

    def inflate() -> bytes:
        nonlocal at_in
        parts = [begun]
        while not unpack.eof:
            data = unpack.unconsumed_tail
            if not data:
                if at + at_in >= size:
                    break
                data = f.read_at(min(1 << 20, size - at - at_in), at + at_in)
                at_in += len(data)
            parts.append(unpack.decompress(data))
        return b"".join(parts)

    if total is None:  # the end must be found by inflating
        whole = inflate()
        total = at_in - len(unpack.unused_data)
        return total, head, lambda: whole[:int(head.get("content-length", 0))]
    return total, head, lambda: inflate()[:int(head.get("content-length", 0))]


def register(spark: SparkSession) -> None:
    """Makes the format known; filters reach Python sources only where Spark is told so."""
    from pyspark import cloudpickle

    import obsweave.llm.warc as here

    cloudpickle.register_pickle_by_value(here)  # tasks need no installed package
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def archive_pages(pages: DataFrame, path: str, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record per page. Of pages with equal payloads of at least `least` bytes that with the smallest id is the
    response and the others revisit it. A null payload is empty, a null url leaves its header out, rows with one id and
    payload are alike; a null id is never the response that others revisit and is written as an empty id.
    """
    register(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.length("payload").cast("long")})
    same = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    keys = rows.select("id", "payload_digest").where(F.col("payload_bytes") >= least)
    again = keys.join(same.where("n > 1 and first is not null"), "payload_digest").where(~F.col("id").eqNullSafe(F.col("first")))
    again = again.select(F.col("id").alias("of_id"), F.col("payload_digest").alias("of_digest"), "first").distinct()
    on = F.expr("id <=> of_id AND payload_digest = of_digest")
    kinds = rows.join(again, on, "left").select(
        _urn(F.col("id")).alias("record_id"), F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"), "target_uri",
        F.lit("2000-01-01T00:00:00Z").alias("date"), F.when(F.col("first").isNotNull(), _urn(F.col("first"))).alias("refers_to"),
        "payload_digest", "payload_bytes", F.when(F.col("first").isNull(), F.col("payload")).alias("payload"),
        F.lit(None).cast("string").alias("archive"), F.lit(None).cast("long").alias("offset"),
    )
    kinds.write.format("warc").mode("append").save(path)


def _urn(id_col):
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(">"))


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()
