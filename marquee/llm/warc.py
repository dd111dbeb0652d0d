"""Dictionary-compressed WARC archives.

Each archive is a Zstandard stream: a leading skippable frame that holds a dictionary built
from the archive's own records, then one frame for each record, compressed alone with that
dictionary, so that a record can be read from its offset. An archive ends at ARCHIVE_BYTES of
records, so a task holds no more than that and one record. Archives are written by Spark's text
writer, which commits whole files only and writes to any store: a row is one archive, a file
has FILE_ARCHIVES at most, and the line separator is an empty skippable frame, which decoders
pass over. Files are read back with the binaryFile source.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import scratch_path

#: Fixed values of the format: magic numbers of skippable frames, for a dictionary (0x184D2A5D)
#: and for padding (0x184D2A50, without content; these eight bytes are ASCII).
DICT_MAGIC = 0x184D2A5D
PADDING = "P*M\x18\x00\x00\x00\x00"
#: Bytes of records at which an archive ends, and archives in a file at most.
ARCHIVE_BYTES, FILE_ARCHIVES = 16 << 20, 16
#: A dictionary is built from pieces of an archive's records, in the order of their hashes: so
#: many bytes of a piece and of all pieces at most. It has an eighth of the archive's bytes, and
#: DICT_BYTES at most.
PIECE_BYTES, SAMPLE_BYTES, DICT_BYTES = 16 << 10, 2 << 20, 32 << 10
LEVEL = 3
#: Bytes that are given to the decompressor at a time.
PIECE = 32 << 10
#: Payloads shorter than this are never stored as revisits.
LEAST_REVISIT = 100
EPOCH = "1970-01-01T00:00:00Z"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    """A WARC/1.1 record. Record ids derive from page id and digest, so reruns agree."""
    rid = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{rid}>", f"WARC-Date: {EPOCH}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>", f"X-Refers-To-Page: {refers_to}"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary from pieces of an archive's records, whichever their hashes pick: trained,
    or, where the trainer finds too little in them, the pieces themselves as raw content."""
    import zstandard

    marks = [zlib.crc32(r) for r in records]
    pieces, left = [], SAMPLE_BYTES
    for i in sorted(range(len(records)), key=marks.__getitem__):
        at = marks[i] % (len(records[i]) - PIECE_BYTES + 1) if len(records[i]) > PIECE_BYTES else 0
        pieces.append(records[i][at : at + PIECE_BYTES])
        left -= len(pieces[-1])
        if left <= 0:
            break
    size = min(DICT_BYTES, sum(map(len, records)) // 8)
    try:
        return zstandard.train_dictionary(size, pieces, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[:size]


def _archive(records: list[bytes]) -> bytes:
    import zstandard

    d = build_dictionary(records)
    codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=True)
    return b"".join([struct.pack("<II", DICT_MAGIC, len(d)), d, *map(codec.compress, records)])


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    size = 0
    for b in batches:
        for page_id, url, html, digest, first, copies in zip(*(b.column(k) for k in range(6)), strict=True):
            page_id, payload, first = page_id.as_py(), html.as_py(), first.as_py()
            revisit = len(payload) >= LEAST_REVISIT and copies.as_py() > 1 and page_id != first
            held.append(record(page_id, url.as_py(), payload, digest.as_py(), first, revisit))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array([_archive(held)], pa.binary())], names=["archive"])
                held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([_archive(held)], pa.binary())], names=["archive"])


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes a record for each row of pages to archives in the folder `path`.

    The payload is payload_col in UTF-8 (null: empty). Of records with equal payloads of at
    least LEAST_REVISIT bytes, that with the smallest id is a response, the others revisit
    it; rows that repeat that id are responses, too, and so are rows whose id is null when
    no row of the group has one. Ids of null come last. An empty table gives no archive with
    records. Other columns of pages are not archived."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    planned = rows.join(groups, "digest", "left").select("page_id", "url", "payload", "digest", "first", F.coalesce("copies", F.lit(1)).alias("copies"))
    archives = planned.mapInArrow(_archives, "archive binary")
    archives.select(F.col("archive").cast("string").alias("archive")).write.option("lineSep", PADDING).option("maxRecordsPerFile", FILE_ARCHIVES).text(path)


def frames_of(data: bytes) -> Iterator[tuple[str, bytes]]:
    """('dict', dictionary) and ('record', WARC record), in the archive's order."""
    import zstandard

    codec, at = zstandard.ZstdDecompressor(), 0
    while at < len(data):
        magic, n = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if magic == DICT_MAGIC:
                d = data[at + 8 : at + 8 + n]
                codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d))
                yield "dict", d
            at += 8 + n
            continue
        # In pieces, as what stands behind a frame's end is copied.
        d, out = codec.decompressobj(), []
        while not d.eof:
            piece = data[at : at + PIECE]
            if not piece:
                raise ValueError("an archive ends within a record")
            out.append(d.decompress(piece))
            at += len(piece)
        at -= len(d.unused_data)
        yield "record", b"".join(out)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives in the folder: page_id, url, record_type,
    payload_bytes, payload_digest, refers_to and body (the stored payload; null for a
    revisit). The digest of a stored payload is computed anew and must be the header's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                out: list[tuple] = []
                held = 0
                for kind, data in frames_of(content.as_py()):
                    if kind == "dict":
                        continue
                    f, body = parse(data)
                    digest, stored = f["WARC-Payload-Digest"].removeprefix("sha256:"), f["WARC-Type"] == "response"
                    if stored and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"record {f['WARC-Record-ID']}: its payload doesn't have its digest")
                    number = lambda k: int(f[k]) if k in f else None  # noqa: B023, E731
                    url = f["WARC-Target-URI"].replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%") if "WARC-Target-URI" in f else None
                    out.append((number("X-Page-Id"), url, f["WARC-Type"], number("X-Payload-Length"), digest, number("X-Refers-To-Page"), body if stored else None))
                    held += len(body)
                    if held > 8 << 20:
                        yield batch(out)
                        out, held = [], 0
                if out:
                    yield batch(out)

    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "body"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, body binary")


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    path = path or scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
