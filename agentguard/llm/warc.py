"""WARC archives as a Python data source: writing, and reading with predicates on the headers.

Each record is a gzip member of its own whose extra field `sl` holds its compressed and plain
length, so a reader can go on to the next record without decompressing this one. The reader
unpacks a record's headers first; record type and header predicates pushed down by Spark are tested on
them, and the payload of an unwanted record is never unpacked.

A writer task rolls its files at ROLL bytes and notes a split point every SPLIT bytes. The
commit writes a manifest per job, which names the files of the tasks that ended well: readers follow
manifests, so files of failed or repeated tasks are never read.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    In,
    InputPartition,
    IsNull,
    WriterCommitMessage,
)

from agentguard.llm.shared import bounded_batches, new_folder, stage

ROLL = 256 << 20
SPLIT = 16 << 20
LEAST_PAYLOAD = 100
_FIELDS = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
_GZIP = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff"
#: Fixed values of the WARC 1.1 format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
            "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length"}


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _member(plain: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = packer.compress(plain) + packer.flush()
    extra = b"sl" + struct.pack("<HII", 8, 0, 0)
    size = len(_GZIP) + 2 + len(extra) + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(plain) & 0xFFFFFFFF)
    return _GZIP + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    """Header values hold no line ends: percent-encode them, and the percent sign."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unclean(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(row: dict) -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    payload = row["payload"] if row["record_type"] == "response" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    head = ["WARC/1.1", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_clean(row['record_id'])}>"]
    if row["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if row["refers_to"] is not None:
        head += [f"WARC-Refers-To: <{_clean(row['refers_to'])}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return _member("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + http + payload + b"\r\n\r\n")


def parse_headers(head: bytes) -> dict:
    """The columns that the headers hold."""
    found = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    out: dict = {}
    for column, name in _HEADERS.items():
        value = found.get(name)
        if value is not None and column in ("record_id", "refers_to"):
            value = value[1:-1]
        out[column] = None if value is None else _unclean(value)
    out["payload_digest"] = (out["payload_digest"] or "").removeprefix("sha256:") or None
    out["payload_bytes"] = None if out["payload_bytes"] is None else int(out["payload_bytes"])
    return out


@dataclass
class FileRange(InputPartition):
    file: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator):
        store, base = _store(self.folder)
        files, out, at, name, splits = [], None, 0, "", []

        def close():
            if out is not None:
                out.close()
                files.append({"file": name, "bytes": at, "splits": splits})

        for batch in iterator:
            for row in batch.to_pylist():
                data = record(row)
                if out is None or at >= ROLL:
                    close()
                    store.create_dir(base, recursive=True)
                    name, at, splits = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
                    out = store.open_output_stream(posixpath.join(base, name), compression=None)
                if at - splits[-1] >= SPLIT:
                    splits.append(at)
                out.write(data)
                at += len(data)
        close()
        return Written(files)

    def commit(self, messages):
        store, base = _store(self.folder)
        store.create_dir(base, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        with store.open_output_stream(posixpath.join(base, f"manifest-{uuid.uuid4().hex}.json"), compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages):
        """Files without a manifest are never read."""


class WarcReader(DataSourceReader):
    def __init__(self, folder: str, payload: bool):
        self.folder, self.payload = folder, payload
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in _HEADERS:
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                if f.value is None and isinstance(f, EqualTo):
                    yield f
                else:
                    self.tests.append((column, (f.value,)))
            elif isinstance(f, In) and None not in f.value:
                self.tests.append((column, tuple(f.value)))
            elif isinstance(f, IsNull):
                self.tests.append((column, (None,)))
            else:
                yield f  # Spark tests the others itself, IsNotNull among them

    def partitions(self):
        from pyarrow import fs

        store, base = _store(self.folder)
        found = store.get_file_info(fs.FileSelector(base, allow_not_found=True))
        out = []
        for info in sorted(found, key=lambda x: x.path):
            if posixpath.basename(info.path).startswith("manifest-"):
                with store.open_input_stream(info.path, compression=None) as f:
                    files = json.loads(f.read())
                for x in files:
                    ends = [*x["splits"][1:], x["bytes"]]
                    out += [FileRange(x["file"], a, b) for a, b in zip(x["splits"], ends, strict=True)]
        return out or [FileRange("", 0, 0)]

    def wanted(self, columns: dict) -> bool:
        return all(columns[c] in values for c, values in self.tests)

    def read(self, partition):
        import pyarrow as pa

        names = [*_HEADERS, "payload"]
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
        if not partition.file:
            return
        store, base = _store(self.folder)
        rows: list[dict] = []
        held = 0
        with store.open_input_file(posixpath.join(base, partition.file)) as f:
            at = partition.start
            while at < partition.end:
                f.seek(at)
                head = f.read(min(4096, partition.end - at))
                size, columns, rest, unpack = _open_member(head) or _open_member(head + f.read(_size(head) - len(head)))
                if self.wanted(columns):
                    payload = None
                    if self.payload and columns["record_type"] == "response":
                        more = f.read(max(0, size - len(head)))
                        payload = _payload(unpack, rest, head, more, size)
                        if hashlib.sha256(payload).hexdigest() != columns["payload_digest"]:
                            raise ValueError(f"payload of {columns['record_id']} does not match its digest")
                    rows.append(columns | {"payload": payload})
                    held += len(payload or b"")
                at += size
                if len(rows) >= 4096 or held >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)


def _size(head: bytes) -> int:
    """Packed size of the member, from its extra field."""
    return struct.unpack_from("<I", head, 16)[0]


def _open_member(head: bytes):
    """(size of the member, header columns, what was unpacked after them, unpacker); None if the headers go on."""
    size = _size(head)
    unpack = zlib.decompressobj(-15)
    start = 12 + struct.unpack_from("<H", head, 10)[0]
    plain = unpack.decompress(head[start:size - 8 if size <= len(head) else len(head)], 8192)
    end = plain.find(b"\r\n\r\n")
    while end < 0 and unpack.unconsumed_tail:
        plain += unpack.decompress(unpack.unconsumed_tail, 8192)
        end = plain.find(b"\r\n\r\n")
    if end < 0:
        return None
    return size, parse_headers(plain[:end]), plain[end + 4:], unpack


def _payload(unpack, rest: bytes, head: bytes, more: bytes, size: int) -> bytes:
    packed = unpack.unconsumed_tail + more
    tail = 8 if size > len(head) else 0
    body = rest + unpack.decompress(packed[: len(packed) - tail])
    return body[body.find(b"\r\n\r\n") + 4:-4]


class WarcSource(DataSource):
    """Format `warc`. Options: path, a folder URI that all executors reach; payload, `false` to leave payloads packed."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return _FIELDS

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true") == "true")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def as_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Records of pages, with revisits of equal payloads.

    Of pages with equal payloads of at least LEAST_PAYLOAD bytes the smallest id is the response and the
    others revisit it; rows that repeat that id are responses too. A null id never is the smallest; a group of null ids only
    is all responses. A null html is an empty payload, a null url gives no target. The record id is
    the page id as text, empty for null.
    """
    made = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("target_uri"),
        F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    made = made.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    shared = stage(
        made.where(F.col("payload_bytes") >= LEAST_PAYLOAD).groupBy("payload_digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "warc-shared")
    joined = made.join(shared, "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(F.col("id").cast("string"), F.lit("")).alias("record_id"), "target_uri",
        F.when(revisit, F.col("first").cast("string")).alias("refers_to"), "payload_digest", "payload_bytes", "payload")


def write_warc(records: DataFrame, folder: str) -> None:
    register(records.sparkSession)
    bounded_batches(records).write.format("warc").mode("append").save(folder)


def archive_and_read(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write pages to archives in the shared folder and read them back: see `as_records`.

    Per page: id, payload_bytes, payload_digest, record_type, refers_to. Figures of responses come
    from the payload read, those of revisits from their headers.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_warc(as_records(pages, id_col, url_col, html_col), folder)
    kind = pages.schema[id_col].dataType
    ref = lambda c: F.when(F.col(c) != "", F.col(c)).cast(kind)
    full = read_warc(spark, folder).where(F.col("record_type") == "response").select(
        ref("record_id").alias(id_col), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type", ref("refers_to").alias("refers_to"))
    heads = read_warc(spark, folder, payload=False).where(F.col("record_type") == "revisit").select(
        ref("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", ref("refers_to").alias("refers_to"))
    return full.unionByName(heads)
