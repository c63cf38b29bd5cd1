"""WARC archives in Zstandard frames: a writer and a validating reader.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary of all its
frames, itself compressed or plain, and then has one Zstandard frame for each record, so any record
can be read without the ones before it.  An archive with too little content to train a dictionary
from has no such frame.

Records are ``response`` records, or ``revisit`` records that refer to the response with an equal
payload and carry its HTTP header without the payload.  The response of equal payloads (of at least
a given number of bytes) is the one with the largest page_id.

The writer runs in tasks that each write archives of bounded size into the shared folder, under names
that no other attempt uses; only the archives that successful tasks report are read.  The reader
gets archives as rows of Spark's binary file source and checks magic numbers, frame and content
sizes, header syntax, required fields, Content-Length, record ends and payload digests.

Defined cases: a null payload is empty; repeated rows with one page_id and payload are written as
often as they come, the same way each: as responses if theirs is the largest page_id of the payload;
a null page_id ranks below every other, is written as the id ``null`` and read back as null, and is
given as null where a revisit refers to it; empty tables give no archives and an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import scratch, ship

#: The skippable frame of dictionaries, Zstandard's frames and dictionaries, and the WARC revisit profile.
DICTIONARY_MAGIC, FRAME_MAGIC, ZSTD_DICTIONARY_MAGIC = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes of one archive, and the bounded start of it that its dictionary is trained on.
ARCHIVE_BYTES, TRAIN_BYTES, DICTIONARY_BYTES, LEVEL = 24 << 20, 1 << 20, 16 << 10, 6
EPOCH = "1970-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that does not follow the format."""


def payload_digest(payload: bytes) -> str:
    """Base32 of the SHA-1, upper case, without prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:tessera:page:{'null' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    name = record.removeprefix("<urn:tessera:page:").removesuffix(">")
    if f"<urn:tessera:page:{name}>" != record:
        raise WarcError(f"unknown record id {record!r}")
    return None if name == "null" else int(name)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers: bool, refers_to: int | None) -> bytes:
    """One uncompressed record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers else http + payload
    uri = quote(url or "about:blank", safe="%/:?#[]@!$&'()*+,;=-._~")
    fields = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", EPOCH), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + payload_digest(payload))]
    if refers:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def build_archive(records: list[bytes]) -> bytes:
    """Dictionary frame and one frame for each record."""
    samples, held = [], 0
    for record in records:
        if held >= TRAIN_BYTES:
            break
        samples.append(record[: 64 << 10])
        held += len(samples[-1])
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples) if len(samples) >= 16 else None
    except zstandard.ZstdError:
        trained = None  # too little content
    out = []
    if trained is not None:
        plain = zstandard.ZstdCompressor(level=LEVEL).compress(trained.as_bytes())
        out.append(struct.pack("<II", DICTIONARY_MAGIC, len(plain)) + plain)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True)
    out += [compressor.compress(r) for r in records]
    return b"".join(out)


def frame_end(data: memoryview, at: int) -> int:
    """End of the Zstandard frame that begins at ``at``, from its header and block headers."""
    if at + 5 > len(data) or struct.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
        raise WarcError(f"no frame at byte {at}")
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if at + 3 > len(data):
            raise WarcError("a frame is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        kind, size = head >> 1 & 3, head >> 3
        if kind == 3:
            raise WarcError("reserved block type")
        at += 3 + (1 if kind == 1 else size)
        if head & 1:
            at += 4 * (flags >> 2 & 1)
            if at > len(data):
                raise WarcError("a frame is cut off")
            return at


def frames(archive: bytes) -> Iterator[bytes]:
    """Decoded records of an archive, one for each frame."""
    data, at, dictionary = memoryview(archive), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        raw = bytes(data[8 : 8 + size])
        if len(raw) != size:
            raise WarcError("the dictionary is cut off")
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        if raw[:4] != struct.pack("<I", ZSTD_DICTIONARY_MAGIC):
            raise WarcError("the leading frame holds no dictionary")
        dictionary, at = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT), 8 + size
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        if at + 8 <= len(data) and 0x184D2A50 <= struct.unpack_from("<I", data, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]  # another skippable frame
            continue
        end = frame_end(data, at)
        frame = data[at:end]
        size = zstandard.frame_content_size(frame)
        try:
            record = decompressor.decompress(frame, max_output_size=0 if size >= 0 else 1 << 30)
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at byte {at}: {e}") from e
        if size >= 0 and len(record) != size:
            raise WarcError(f"frame at byte {at} has {len(record)} bytes, its header says {size}")
        yield record
        at = end


def _fields(head: bytes, what: str) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad {what} line {line[:80]!r}")
        out[name.decode("ascii").lower()] = value.strip().decode()
    return out


def parse_record(record: bytes) -> tuple[dict[str, str], bytes, int]:
    """Header fields (lower-case names), payload, and the payload length that its HTTP header states."""
    head, mark, rest = record.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not mark or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError(f"not a WARC record: {version[:40]!r}")
    fields = _fields(lines, "WARC header")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"{name} is missing")
    length = int(fields["content-length"]) if fields["content-length"].isdigit() else -1
    if length < 0 or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length is {fields['content-length']}, the record holds {len(rest) - 4}")
    block = rest[:length]
    http, mark, payload = block.partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not mark or not status.startswith(b"HTTP/"):
        raise WarcError("the block is no HTTP message")
    stated = int(_fields(lines, "HTTP header").get("content-length", len(payload)))
    if fields["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in fields or fields.get("warc-profile") != PROFILE:
            raise WarcError("a revisit record with a payload, or without profile or target")
    elif stated != len(payload):
        raise WarcError(f"HTTP Content-Length is {stated}, the payload has {len(payload)}")
    elif "sha1:" + payload_digest(payload) != fields.get("warc-payload-digest", "sha1:" + payload_digest(payload)):
        raise WarcError("the payload does not have its digest")
    return fields, payload, stated


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    records: list[bytes] = []
    held = 0

    def close() -> pa.RecordBatch:
        name = f"{root}/{uuid.uuid4().hex}.warc.zst"
        data = build_archive(records)
        with fs.open_output_stream(name, compression=None) as out:
            out.write(data)
        n = len(records)
        records.clear()
        return pa.RecordBatch.from_arrays([pa.array([name.rpartition("/")[2]]), pa.array([n], pa.int64()), pa.array([len(data)], pa.int64())], names=["archive", "records", "bytes"])

    for batch in batches:
        for page, url, payload, refers, target in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "revisit", "refers_to"))):
            records.append(build_record(page, url, payload, refers, target))
            held += len(records[-1])
            if held >= ARCHIVE_BYTES:
                yield close()
                held = 0
    if records:
        yield close()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            out: list[tuple] = []
            for record in frames(content.as_py()):
                fields, payload, stated = parse_record(record)
                revisit = fields["warc-type"] == "revisit"
                target = page_of(fields["warc-refers-to"]) if revisit else None
                out.append((page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), stated, fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], target, None if revisit else payload))
            cols = list(zip(*out)) or [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write one record for each row into archives below ``folder``; the manifest: archive, records, bytes."""
    spark = pages.sparkSession
    ship.ensure(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload")).withColumn("key", F.sha2("payload", 256))
    # Only payloads that come more than once are joined back; the aggregate combines copies in each task.
    copies = rows.where(F.length("payload") >= least).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("target")).where("n > 1").select("key", "target")
    copies = scratch.table(copies, "copies")
    joined = rows.join(copies.withColumn("copied", F.lit(True)), "key", "left")
    marked = joined.select("page_id", "url", "payload", (F.coalesce("copied", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("target"))).alias("revisit"), F.col("target").alias("refers_to"))
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)
    return scratch.table(marked.mapInArrow(lambda it: _write(it, folder), "archive string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of the archives that a manifest lists."""
    spark = manifest.sparkSession
    ship.ensure(spark)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    listed = found.join(manifest.select("archive"), "archive", "left_semi").select("content")
    return listed.mapInArrow(_read, READ_SCHEMA)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write archives into the shared folder and read them back."""
    folder = scratch.fresh(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, id_col, url_col, html_col, least)
    if manifest.isEmpty():
        return pages.sparkSession.createDataFrame([], READ_SCHEMA)
    return read_archives(manifest, folder)
