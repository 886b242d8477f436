"""WARC archives in zstandard: written with one frame a record and the dictionary in a leading skippable frame,
read back frame by frame with headers and lengths validated."""
import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.common import scratch_folder
from foldwise.session import materialize, size_checked_broadcast

SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_PAGES = 512
DICTIONARY_PAGE_BYTES = 1 << 16
DICTIONARY_BYTES = 32 << 10
ARCHIVE_BYTES = 16 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FEED = 1 << 14
_BARE = re.compile(r"[\x00-\x20\x7f]")

MANIFEST = "file string, records long, bytes long"
RECORDS = ("archive string, record_offset long, record_id string, page_id long, record_type string, target_uri string, refers_to long, "
           "payload binary, payload_bytes long, payload_digest string, error string")


def filesystem(uri: str):
    """The file system of a URI and the path in it; Hadoop writes local ones as file:/path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP header alone."""
    digest = sha1_base32(payload)
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}",
            "WARC-Target-URI: " + (_BARE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else name), f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def skippable_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of the samples; too few or too small samples give an empty one."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _write(target: str, dictionary: bytes, level: int, archive_bytes: int):
    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches):
        import zstandard

        files, root = filesystem(target)
        press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None).compress
        # an attempt's own names: files of lost attempts are in no manifest
        prefix = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, made, n, size = None, [], 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                made.append((name, n, size))
                out = None

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(k) for k in range(4))):
                if out is None:
                    name, n, size = f"{prefix}-{len(made):05d}.warc.zst", 0, 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(skippable_frame(dictionary))
                frame = press(record_bytes(page_id.as_py(), url.as_py(), payload.as_py() or b"", refers_to.as_py()))
                out.write(frame)
                n, size = n + 1, size + len(frame)
                if size >= archive_bytes:
                    close()
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made), schema)], schema=schema)

    return run


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is the smallest page_id among records of an equal payload of at
    least ``min_bytes``, null for that record itself.  Null ids are never referred to and stay responses; rows that
    repeat the smallest id are responses too."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    same = rows.filter(F.col("page_id").isNotNull() & (F.octet_length("payload") >= min_bytes)).select("page_id", "sha")
    first = same.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    later = same.join(first, "sha").filter("page_id > refers_to").select("page_id", "sha", "refers_to").distinct()
    return rows.join(later, ["page_id", "sha"], "left").select("page_id", "url", "payload", "refers_to")


def write_archives(pages: DataFrame, *, min_bytes: int = 0, level: int = 3, archive_bytes: int = ARCHIVE_BYTES, directory: str | None = None) -> tuple[str, DataFrame]:
    """Writes a record for each row of ``pages`` (page_id, url, html) into archives of about ``archive_bytes`` in
    ``directory`` (default: a new folder in the session's checkpoint directory); returns it and the manifest of
    archives.  The dictionary is trained on those of DICTIONARY_PAGES pages, the smallest by a hash of their id, that
    hold at most DICTIONARY_PAGE_BYTES.
    Null html is an empty payload; an empty table writes nothing."""
    spark = pages.sparkSession
    directory = directory or scratch_folder(spark, "warc")
    files, root = filesystem(directory)
    files.create_dir(root, recursive=True)
    ids = pages.select("page_id").filter("page_id is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(DICTIONARY_PAGES)
    sample = pages.join(F.broadcast(ids.distinct()), "page_id", "left_semi").select(F.col("html").cast("binary").alias("html"))
    sample = sample.filter(F.octet_length("html").between(1, DICTIONARY_PAGE_BYTES)).limit(2 * DICTIONARY_PAGES)
    dictionary = train_dictionary([bytes(r.html) for r in sample.collect()])
    manifest = mark_revisits(pages, min_bytes).mapInArrow(_write(directory, dictionary, level, archive_bytes), MANIFEST)
    return directory, materialize(manifest)


def read_dictionary(data: bytes) -> tuple[bytes, int]:
    """The dictionary of the leading skippable frame (itself compressed or not) and where the records begin."""
    import zstandard

    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        return b"", 0
    size = struct.unpack_from("<I", data, 4)[0]
    if 8 + size > len(data):
        raise ValueError("the dictionary frame is cut off")
    held = bytes(data[8:8 + size])
    return (zstandard.ZstdDecompressor().decompressobj().decompress(held) if held[:4] == ZSTD_MAGIC else held), 8 + size


def frames(data: bytes):
    """(offset, record bytes or None, error) of every frame after the dictionary."""
    import zstandard

    dictionary, at = read_dictionary(data)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    view = memoryview(data)
    while at < len(data):
        start, frame, parts = at, reader.decompressobj(), []
        try:
            while not frame.eof and at < len(data):
                piece = view[at:at + _FEED]
                parts.append(frame.decompress(piece))
                at += len(piece)
            at -= len(frame.unused_data) if frame.eof else 0
        except zstandard.ZstdError as e:
            yield start, None, f"bad frame: {e}"
            return
        if not frame.eof:
            yield start, None, "the frame is cut off"
            return
        yield start, b"".join(parts), None


def _header(head: bytes) -> tuple[str, dict[str, str]]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    pairs = (x.partition(":") for x in lines[1:])
    return lines[0], {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse_record(data: bytes) -> dict:
    """Fields of a record; ``error`` says what is wrong with its headers, lengths or digest."""
    out = dict.fromkeys(("record_id", "page_id", "record_type", "target_uri", "refers_to", "payload", "payload_bytes", "payload_digest", "error"))
    head, cut, rest = data.partition(b"\r\n\r\n")
    version, fields = _header(head)
    out |= {"record_id": fields.get("warc-record-id", "").strip("<>"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri")}
    number = re.fullmatch(r"urn:page:(-?\d+)", out["record_id"])
    out["page_id"] = int(number[1]) if number else None
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if not fields.get(k)]
    if not cut or not re.fullmatch(r"WARC/1\.[01]", version) or missing or not fields["content-length"].isdigit():
        return out | {"error": f"bad header {' '.join(missing)}".strip()}
    size = int(fields["content-length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        return out | {"error": "the block's length differs from Content-Length"}
    if fields["warc-type"] not in ("response", "revisit"):
        return out
    http, cut, payload = block.partition(b"\r\n\r\n")
    status, http_fields = _header(http)
    length = http_fields.get("content-length", "")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if not cut or not status.startswith("HTTP/") or not length.isdigit():
        return out | {"error": "bad HTTP header"}
    out |= {"payload_bytes": int(length), "payload_digest": digest}
    if fields["warc-type"] == "revisit":
        target = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("warc-refers-to", ""))
        return out | {"refers_to": int(target[1]) if target else None, "error": None if target and not payload else "bad revisit"}
    if len(payload) != int(length) or sha1_base32(payload) != digest:
        return out | {"error": "the payload's length or digest differs from its header"}
    return out | {"payload": payload}


def _read(batches):
    schema = pa.schema([("archive", pa.string()), ("record_offset", pa.int64()), ("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()),
                        ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string())])
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows, held = [], 0
            for offset, data, error in frames(content.as_buffer()):
                row = parse_record(data) if error is None else {"error": error}
                rows.append({"archive": name, "record_offset": offset, **row})
                held += len(data or b"")
                if held >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)


def read_archives(spark: SparkSession, directory: str, manifest: DataFrame | None = None) -> DataFrame:
    """One row per record of the archives in ``directory`` (those of the manifest, where one is given).  A damaged
    record or frame gives a row whose ``error`` says what is wrong."""
    if manifest is not None and manifest.isEmpty():
        return spark.createDataFrame([], RECORDS)
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(directory)
    content = content.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    if manifest is not None:
        names, _ = size_checked_broadcast(manifest.select("file"))
        content = content.join(names, "file", "left_semi").select("file", "content")
    return content.mapInArrow(_read, RECORDS)
