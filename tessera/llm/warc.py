"""Dictionary-compressed WARC archives.

A Zstandard dictionary is built from a bounded sample of the payloads. Every archive begins with a skippable frame that
holds it, and each record is a frame of its own. Tasks write archives to the shared folder under names of their own
attempt and rename them when whole; the list of archives is what the committed job returns, so a lost executor leaves at
most files that no list names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh_path, hash_share, materialize, maybe_broadcast

#: Magic number of the skippable frame with the dictionary, as public WARC-Zstandard archives have it.
DICTIONARY_FRAME = 0x184D2A5D
#: Bounds of the sample (payloads, bytes of one) and of the dictionary; level; bytes after which a new archive begins.
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL, ARCHIVE_BYTES = 1000, 32_768, 112_640, 3, 1 << 30
#: Payloads with fewer bytes are always archived as responses.
MIN_REVISIT_BYTES = 100
_MANIFEST = "path string, records long, stored_bytes long"
_ROWS = "row_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def build_dictionary(df: DataFrame, payload_col: str) -> bytes:
    """A dictionary from the payloads whose hashes are smallest; empty if they are too few or too alike to build one.

    Rows are counted first, so that each task sorts, and the driver receives, about SAMPLE payloads in all, whatever the
    number of tasks. Copies of a payload count as one row."""
    body = F.col(payload_col).cast("binary")
    rows = df.select(body.alias("p"), F.xxhash64(body).alias("h")).where(F.octet_length("p").between(1, SAMPLE_BYTES))
    n = rows.agg(F.approx_count_distinct("h", 0.02).alias("n")).first()["n"]
    rows = hash_share(rows, F.col("h"), SAMPLE, n).dropDuplicates(["h"]).orderBy("h").limit(SAMPLE).collect()
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [bytes(r["p"]) for r in rows]).as_bytes() if len(rows) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _open(path: str):
    """File system and path for a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _file_system(path: str):
    return _open("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)


def record(row_id: str | None, url: str | None, kind: str, digest: str, size: int, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC record. A revisit has no payload; headers that WARC doesn't define begin with X-."""
    name = lambda row: uuid.uuid5(uuid.NAMESPACE_OID, f"{row}\x00{digest}")
    safe = lambda s: quote(s, safe="!#$%&'()*+,/:;=?@[]~-._")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    body = http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name(row_id)}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {safe(url)}")
        head.append(f"X-Target: {quote(url, safe='')}")
    if row_id is not None:
        head.append(f"X-Row-ID: {quote(row_id, safe='')}")
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head += [f"WARC-Refers-To: <urn:uuid:{name(refers_to)}>", f"X-Refers-To-Row: {quote(refers_to or '', safe='')}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _writer(folder: str, dictionary: bytes, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        system, root = _file_system(folder)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
        out, done, number = None, [], 0

        def close():
            nonlocal out, number
            path, stream, records, size = out
            stream.close()
            system.move(path, whole := path.removesuffix(".part"))
            done.append((f"{folder}/{whole.rpartition('/')[2]}", records, size))
            out, number = None, number + 1

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                row_id, url, kind, digest, size, payload, refers_to = (x.as_py() for x in row)
                if out is None:
                    path = f"{root}/part-{ctx.partitionId():06d}-{ctx.taskAttemptId()}-{number}.warc.zst.part"
                    stream = system.open_output_stream(path, compression=None)
                    stream.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
                    out = [path, stream, 0, 8 + len(dictionary)]
                frame = press.compress(record(row_id, url, kind, digest, size, (payload or b"") if kind == "response" else b"", refers_to, date))
                out[1].write(frame)
                out[2], out[3] = out[2] + 1, out[3] + len(frame)
                if out[3] >= ARCHIVE_BYTES:
                    close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["path", "records", "stored_bytes"])

    return run


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", url_col: str | None = "url", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of df to archives in folder; returns the committed list (path, records, stored_bytes).

    Of rows with equal payloads of 100 bytes or more, those with the smallest id (nulls last; all of them if rows tie)
    become responses and the others revisits of that id; rows with smaller payloads are all responses. Null payloads
    are empty. Digests that occur more than once are found from digests and ids alone, with partial aggregation; their
    list is broadcast if it is within the bound, and joined by a shuffle that Spark can split if not. Rows that repeat
    and null ids are archived like others. An empty df makes no archive. Other columns are ignored.
    """
    spark = df.sparkSession
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    url = F.col(url_col).cast("string") if url_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("__id"), url.alias("url"), F.sha2(body, 256).alias("digest"), F.octet_length(body).cast("long").alias("size"), body.alias("payload"))
    same = rows.where(F.col("size") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("n"))
    same = materialize(same.where("n > 1 and __first is not null").select("digest", "__first"), "digests")
    rows = rows.join(maybe_broadcast(same, same.count()), "digest", "left")
    again = F.col("__first").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__first"))
    rows = rows.select(
        F.col("__id").cast("string").alias("row_id"), "url", F.when(again, "revisit").otherwise("response").alias("kind"), "digest", "size",
        F.when(~again, F.col("payload")).alias("payload"), F.when(again, F.col("__first").cast("string")).alias("refers_to"),
    )
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(where)
    folder = system.makeQualified(where).toString()  # a path without a scheme lies on the default file system
    return materialize(rows.mapInArrow(_writer(folder, build_dictionary(df, payload_col), date), _MANIFEST), "archives")


def read_records(stream, keep_payload: bool = True) -> Iterator[tuple]:
    """(row_id, url, record_type, payload_bytes, payload_digest, refers_to, payload) of an open archive's records.

    Raises ValueError where a payload doesn't have the length and digest that its record states.
    """
    from urllib.parse import unquote

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    dictionary = stream.read(size)
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if size else None)
    text = press.stream_reader(stream, read_across_frames=True)
    held = b""

    def take(n: int) -> bytes:
        nonlocal held
        parts, have = [held], len(held)
        while have < n:
            if not (more := text.read(max(n - have, 1 << 16))):
                raise ValueError("archive ends within a record")
            parts.append(more)
            have += len(more)
        whole = b"".join(parts)
        held = whole[n:]
        return whole[:n]

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not (more := text.read(1 << 16)):
                if held:
                    raise ValueError("archive ends within a header")
                return
            held += more
        head = dict(line.split(": ", 1) for line in take(end + 4).decode().split("\r\n")[1:] if line)
        body = take(int(head["Content-Length"]) + 4)[:-4]
        payload = body.partition(b"\r\n\r\n")[2]
        digest, size = head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
        if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
            raise ValueError(f"record {head['WARC-Record-ID']} is damaged")
        part = lambda name: unquote(head[name]) if name in head else None  # noqa: B023, E731
        yield part("X-Row-ID"), part("X-Target"), head["WARC-Type"], size, digest, part("X-Refers-To-Row"), payload if keep_payload else None


def read_archives(spark: SparkSession, archives: DataFrame, keep_payload: bool = True) -> DataFrame:
    """Records of the archives listed in ``archives`` (path): row_id, url, record_type, payload_bytes, payload_digest,
    refers_to, payload (null for revisits' rows when not kept). Lengths and digests of responses are verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _ROWS.split(", ")]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, at = _file_system(path)
                rows, size = [], 0
                with system.open_input_stream(at, compression=None) as stream:
                    for r in read_records(stream, keep_payload):
                        rows.append(r)
                        size += len(r[-1] or b"") + 200
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return archives.select("path").repartition(n, "path").mapInArrow(run, _ROWS)


def op10_warc_zstd(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = fresh_path(spark, "warc")
    records = read_archives(spark, write_archives(pages, folder), keep_payload=False)
    kind = pages.schema["page_id"].dataType
    out = records.select(F.col("row_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
    out = materialize(out, "records")
    discard(spark, folder)
    return out


ORACLE = """
with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, ''))::bigint as n from pages),
x as (select page_id, n, sha256(h) as d, case when n >= 100 then min(page_id) over (partition by h) end as first from p)
select page_id, n as payload_bytes, d as payload_digest, case when first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when first is not null and page_id is distinct from first then first end as refers_to
from x
"""
