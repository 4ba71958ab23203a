"""WARC archives as a Spark data source: a writer of gzip members and a splittable reader.

Writing: every task writes one file with one gzip member per record; the driver then lists the files of the successful
attempts in a manifest, so files of lost attempts are never read. Reading: files are cut into byte ranges; a task looks in its
range for the gzip magic number, takes a place for a record only if the bytes there decode to a WARC header with a type and
a length that the record has, and owns the records that start inside its range, wherever they end. A record that follows
another must be sound: a damaged one raises an error. As no task can tell a damaged first record of its range from chance
bytes, each task also decodes the record behind its last one. Digest and length of a response are taken from the payload
read back and must equal those in its header. Archives and manifest go through pyarrow's file systems (local, HDFS, S3, GCS).

Of rows with equal payloads of at least `least` bytes that with the smallest id becomes a response, the others revisits of
it; a revisit has the digest and the length of the full payload but not its bytes. Null html is an empty payload, a null
URL an empty target. Ids of any length and with any characters come back whole (percent-encoded in the record's URN); a
null id has a URN of its own. Rows that repeat an id and payload are all responses; a null id is no response if another id
has its payload. Payloads of any length are taken whole. Other columns are not carried over. An empty table gives an archive
without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from paperlens.llm.common import new_path, small, stored

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES, READ_BYTES = 16 << 20, 1 << 20
#: Bytes of a candidate that are decoded first to see a header.
PROBE_BYTES = 512
ID, NO_ID = "urn:paperlens:page:", "urn:paperlens:page"
SCHEMA = "record_id string, record_type string, date string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary, file string, offset long"
IN_SCHEMA = "page_id, url, payload, refers_to"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(page_id) -> str:
    return NO_ID if page_id is None else ID + quote(str(page_id), safe="")


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC record as a gzip member; a revisit if refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{urn(page_id)}>", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{urn(refers_to)}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def header(head: bytes) -> dict | None:
    """Fields of a WARC header, names in lower case; None if it is none: version, a type and a length are needed."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {name.lower(): value.strip() for name, colon, value in (line.partition(":") for line in lines) if colon}
    return fields if first.startswith("WARC/1.") and fields.get("warc-type") and fields.get("content-length", "").isdecimal() else None


def parse(raw: bytes) -> dict | None:
    """Header fields, and the payload (None for a revisit) with its full length; None if this is no whole record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = header(head)
    if fields is None or len(rest) < int(fields["content-length"]):
        return None
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
    return fields | {"payload": None if fields.get("warc-type") == "revisit" else payload, "payload_bytes": size}


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator) -> Written:
        store, base = _open(self.path)
        store.create_dir(base, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            for row in iterator:
                out.write(record(row[0], row[1], bytes(row[2] or b""), row[3], self.date))
        return Written(name)

    def commit(self, messages) -> None:
        store, base = _open(self.path)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/_manifest.json") as out:
            out.write(json.dumps(sorted(m.name for m in messages if m is not None)).encode())


class Range(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


def record_at(source, offset: int, size: int) -> tuple[dict, int] | None:
    """The parsed record of the gzip member at an offset and the member's end; None if no sound WARC record starts there."""
    probe = zlib.decompressobj(31)
    try:
        source.seek(offset)
        data = source.read(min(READ_BYTES, size - offset))
        if not probe.decompress(data, PROBE_BYTES).startswith(b"WARC/1."):
            return None
        whole, out, at = zlib.decompressobj(31), [], offset
        while data and not whole.eof:
            out.append(whole.decompress(data))
            at += len(data)
            data = b"" if whole.eof else source.read(min(READ_BYTES, size - at))
    except zlib.error:
        return None
    fields = parse(b"".join(out)) if whole.eof else None
    if fields is None:
        return None
    told, payload = fields.get("warc-payload-digest"), fields["payload"]
    if payload is not None:
        fields |= {"payload_bytes": len(payload), "digest": digest(payload)}
        if told is not None and told != f"sha1:{fields['digest']}":
            return None
    return fields | {"digest": fields.get("digest") or (told or "").removeprefix("sha1:") or None}, at - len(whole.unused_data)


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split_bytes", SPLIT_BYTES))
        self.payload = options.get("payload", "true").lower() == "true"

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, base = _open(self.path)
        if store.get_file_info(f"{base}/_manifest.json").type == fs.FileType.File:
            with store.open_input_stream(f"{base}/_manifest.json") as manifest:
                names = json.loads(manifest.read())
        else:  # an archive from elsewhere
            names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(base)) if f.base_name.endswith(".warc.gz"))
        sizes = {n: store.get_file_info(f"{base}/{n}").size for n in names}
        return [Range(n, start, min(size, start + self.split)) for n, size in sizes.items() for start in range(0, size, self.split)]

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition is None:
            return
        store, base = _open(self.path)
        with store.open_input_file(f"{base}/{partition.name}") as source:
            size, at = source.size(), partition.start
            sure = at == 0  # a record must start here
            while at < partition.end or sure and at < size:
                if not sure:
                    source.seek(at)
                    window = source.read(min(READ_BYTES, size - at))
                    place = window.find(MAGIC)
                    if place < 0:  # the magic number may lie across the end of the window
                        at += max(1, len(window) - len(MAGIC) + 1)
                        continue
                    at += place
                    if at >= partition.end:
                        return
                found = record_at(source, at, size)
                if found is None and sure:
                    raise ValueError(f"damaged record in {partition.name} at byte {at}")
                if at >= partition.end:
                    return
                if found is None:
                    at += 1
                    continue
                f, end = found
                yield (
                    f.get("warc-record-id", "").strip("<>"), f["warc-type"], f.get("warc-date"), f.get("warc-target-uri"), f["digest"],
                    f["payload_bytes"], f["warc-refers-to"].strip("<>") if "warc-refers-to" in f else None, f["payload"] if self.payload else None, partition.name, at,
                )
                at, sure = end, True


class WarcSource(DataSource):
    """spark.read.format("warc").load(folder); df.write.format("warc") for rows (id, url, payload, refers_to)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite) -> WarcWriter:
        return WarcWriter(self.options)


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to; the last is null for responses. Payloads that occur twice or more are few as a rule and
    are sent to all tasks as digests, so that no payload is shuffled; beyond a counted bound the join shuffles."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha2("payload", 256))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    joined = rows.join(small(stored(groups.select("sha", "first"), "payloads")), "sha", "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    with_revisits(pages, least).write.format("warc").mode("append").option("path", path).save()


def read(spark: SparkSession, path: str, payload: bool = True, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload)).option("split_bytes", split_bytes).load(path)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages to a new archive in the shared folder and read it back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, least)
    back = read(spark, path, payload=False)

    def number(c: str):
        return F.when(F.col(c).startswith(ID), F.url_decode(F.expr(f"substring({c}, {len(ID) + 1})"))).try_cast(pages.schema["page_id"].dataType)

    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
