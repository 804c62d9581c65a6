"""Dictionary-compressed WARC writer and reader.

A Zstandard dictionary is built from a bounded sample of records and stands
in a leading skippable frame (magic 0x184D2A5D) of every archive; each WARC
record is a frame of its own, compressed with that dictionary, so that
records can be read one by one.  Records of equal payload are written once
as ``response``; the others are ``revisit`` records that name it.

Which row holds a payload is decided on digests and places alone (partial
aggregation, then a join of one small row per page); rows are written once, bucketed by place,
where the decisions come back to them: payloads are never shuffled.  A task
writes archives of bounded size under a name of its own attempt and lists
them with offsets; only listed archives are read, so lost executors and
repeated attempts do no harm.  The archives are in the cluster's shared folder.

Defined cases: null html is an empty payload; payloads under ``least`` bytes
are all responses; of equal payloads the row(s) with the least id are the
response, null ids come last, and a group without any id is all responses;
null ids and URLs are written as absent;
ids are whole numbers of 64 bits, which is what the reader returns; repeated rows are records of their
own; extra columns are ignored; an empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _util

SKIPPABLE = 0x184D2A5D
_CRLF = b"\r\n"


def record(page_id, url: str | None, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """A WARC/1.1 record as bytes."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}")
    clean = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>")]
    head += [("WARC-Target-URI", clean)] if clean is not None else []
    head += [("X-Page-ID", str(page_id))] if page_id is not None else []
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To", str(refers_to))]
    body = payload if kind == "response" else b""
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1" + _CRLF + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + _CRLF + body + _CRLF * 2


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and body of one record."""
    head, _, rest = data.partition(_CRLF * 2)
    lines = head.split(_CRLF)
    if lines[0] != b"WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(line.decode().split(": ", 1) if b": " in line else (line.decode().rstrip(":"), "") for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != _CRLF * 2:
        raise ValueError("record has another length than it says")
    return fields, rest[:n]


#: Characters of a record that its part in the dictionary's sample has at most.
SEGMENT = 16_384


def skippable(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def build_dictionary(samples: list[bytes], size: int = 32 << 10) -> bytes:
    """A trained dictionary; too few samples give a raw-content one, none an empty one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def _dictionary_object(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None



def decide(pages: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """Every row with payload, digest, ``record_type`` and ``refers_to``.

    Rows are written once, bucketed by place.  Which of them revisit another
    is decided on digests and places, and comes back to where the rows lie:
    payloads are never shuffled, and a digest of very many pages meets the join
    as digests alone, of which Spark splits skewed ones.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    rows = _util.held(_util.places(rows))
    known = rows.where(F.col("bytes") >= least).select("__part", "__at", "page_id", "digest")
    same = known.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    same = _util.materialise(same.select(F.col("digest").alias("d"), "first_id"))  # the planner then knows its size
    revisits = known.join(same, F.col("digest") == F.col("d")).where(~F.col("page_id").eqNullSafe(F.col("first_id")))
    rows = _util.returned(rows, revisits.select("__part", "__at", "first_id"), "first_id")
    kind = F.when(F.col("first_id").isNotNull(), "revisit").otherwise("response")
    return rows.select("page_id", "url", "html", "digest", kind.alias("record_type"), F.col("first_id").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, *, id_col="page_id", url_col="url", html_col="html", least: int = 100, sample: int = 400, archive_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Writes the archives under ``folder``; returns their list ``(path, records, bytes)``.

    The dictionary is built from ``sample`` records at most, a run of up to
    ``SEGMENT`` characters of each that begins anywhere in the payload (by the
    hash of the id); records are written and read back whole.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit(""))
    begin = F.pmod(F.xxhash64(F.col(id_col), F.lit(1)), F.greatest(F.length(html) - SEGMENT, F.lit(0)) + 1) + 1
    parts = pages.select(F.col(id_col).alias("i"), F.substring(html, begin.cast("int"), F.lit(SEGMENT)).alias("h"))
    chosen = _util.least_hashed(parts, "i", sample).select("h")
    samples = [r["h"].encode() for r in chosen.toLocalIterator()]
    samples = [record(i, None, s, hashlib.sha256(s).hexdigest(), "response", None) for i, s in enumerate(samples)]
    shared = spark.sparkContext.broadcast(build_dictionary(samples))
    rows = decide(pages, id_col, url_col, html_col, least)

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get()
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        dictionary = shared.value
        packer = zstandard.ZstdCompressor(level=level, dict_data=_dictionary_object(dictionary), write_content_size=True)
        out, listed, n, size, path = None, [], 0, 0, ""
        for batch in batches:
            for page_id, url, html, digest, kind, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(listed):04d}.warc.zst"
                    out = files.open_output_stream(f"{root}/{path}", compression=None)
                    head = skippable(dictionary)
                    out.write(head)
                    n, size = 0, len(head)
                frame = packer.compress(record(page_id, url, html.encode(), digest, kind, refers_to))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= archive_bytes:
                    out.close()
                    listed.append((path, n, size))
                    out = None
        if out is not None:
            out.close()
            listed.append((path, n, size))
        if listed:
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{p}", "records": a, "bytes": b} for p, a, b in listed], schema=_LIST)

    return _util.materialise(rows.mapInArrow(run, "path string, records long, bytes long"))


_LIST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
)
_READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_frames(stream):
    """Records of one archive, one frame at a time; a whole archive is never held."""
    import zstandard

    magic, n = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive has no leading dictionary frame")
    dictionary = stream.read(n)
    reader = zstandard.ZstdDecompressor(dict_data=_dictionary_object(dictionary))
    pending, frame, parts = b"", reader.decompressobj(), []
    while True:
        data = pending or stream.read(1 << 20)
        pending = b""
        if not data:
            if parts:
                raise ValueError("the archive ends within a record")
            return
        parts.append(frame.decompress(data))
        if frame.eof:
            pending = frame.unused_data
            yield parse(b"".join(parts))
            frame, parts = reader.decompressobj(), []


def read_archives(listed: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the listed archives; revisits have no payload."""
    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, at = _filesystem(path)
                rows, held = [], 0
                with files.open_input_stream(at, compression=None) as stream:
                    for f, body in read_frames(stream):
                        if f["WARC-Type"] == "response" and hashlib.sha256(body).hexdigest() != f["WARC-Payload-Digest"][7:]:
                            raise ValueError(f"a payload of {path} does not have its digest")
                        page, refers = f.get("X-Page-ID"), f.get("X-Refers-To")
                        rows.append((None if page is None else int(page), f.get("WARC-Target-URI"), body if with_payload else None, int(f["X-Payload-Length"]), f["WARC-Payload-Digest"][7:], f["WARC-Type"], None if refers is None else int(refers)))
                        held += len(body) if with_payload else 64
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist([dict(zip(_RECORD.names, r, strict=True)) for r in rows], schema=_RECORD)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(_RECORD.names, r, strict=True)) for r in rows], schema=_RECORD)

    one_each = listed.select("path").repartition(max(1, min(10_000, listed.count())))
    return one_each.mapInArrow(run, _READ)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` and returns what the archives say; the contract's columns."""
    folder = _util.shared_path(pages.sparkSession) + "-warc"
    listed = write_archives(pages, folder, **options)
    _util.delete_at_exit(pages.sparkSession, folder)
    return read_archives(listed, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY d) AS first_id FROM p
)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN b >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
