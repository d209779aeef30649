"""WARC archives compressed with Zstandard: one frame per record, the dictionary in front.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself
compressed; every record is one frame.  The reader takes the dictionary from there, walks the frames
by their block headers, decodes one record at a time and validates the version line, the required
fields, the content length, the end of the record, and block and payload digests.

Archives are rows (name, content) of at most about ``ARCHIVE_BYTES`` of records each, so any store
Spark can write holds them; files of that format come in by ``spark.read.format("binaryFile")``
(``from_files``), and ``write_files`` writes them as files where pyarrow can open the folder.

Records with equal payloads (same SHA-256 and length) of at least ``least_bytes``: the one with the
largest page_id is the response, the others revisit it.  Smaller payloads are all responses.  Rows
that repeat the largest page_id are all responses; a group without any page_id has only responses.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrierbook.llm.common import map_rows, text_or_empty

ARCHIVE_BYTES = 4_000_000
DICTIONARY_BYTES = 16_384
SAMPLE_BYTES = 1_000_000     # records at an archive's beginning that its dictionary is trained on
SKIPPABLE = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


class WarcError(ValueError):
    pass


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- writing --------------------------------------------------------------------------------------

def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if url:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def archive(records: list[bytes], dictionary_bytes: int = DICTIONARY_BYTES) -> bytes:
    """The bytes of one archive.  Without enough samples for a dictionary the first frame is empty."""
    samples, size = [], 0
    for r in records:
        samples.append(r[:65_536])
        size += len(samples[-1])
        if size > SAMPLE_BYTES:
            break
    try:
        trained = zstandard.train_dictionary(dictionary_bytes, samples, k=256, d=8).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:  # too little to train on
        trained = b""
    front = zstandard.ZstdCompressor().compress(trained) if trained else b""
    known = zstandard.ZstdCompressionDict(trained) if trained else None
    pack = zstandard.ZstdCompressor(level=3, dict_data=known, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(front)), front, *map(pack.compress, records)])


def _archives(slices, archive_bytes):
    part, made = TaskContext.get().partitionId(), 0
    held, size = [], 0

    def close():
        return {"name": [f"part-{part:06d}-{made:05d}.warc.zst"], "content": [archive(held)]}

    for rows in slices:
        for page_id, url, html, refers_to in zip(*(rows.column(k).to_pylist() for k in ("page_id", "url", "html", "refers_to"))):
            payload = html.encode()
            held.append(_record(page_id, url, payload, base32_sha1(payload), refers_to))
            size += len(held[-1])
            if size >= archive_bytes:
                yield close()
                held, size, made = [], 0, made + 1
    if held:
        yield close()


def write(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (name, content) holding one record per row of ``pages`` (page_id, url, html)."""
    rows = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), text_or_empty("html").alias("html"))
            .withColumn("size", F.octet_length("html")).withColumn("sha", F.sha2("html", 256)))
    first = rows.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("response_id"))
    marked = rows.join(first, ["sha", "size"], "left").select(
        "page_id", "url", "html",
        F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id")).alias("refers_to"))
    return map_rows(marked, lambda s: _archives(s, archive_bytes), "name string, content binary")


def write_files(archives: DataFrame, folder: str) -> DataFrame:
    """Write archives as files into a folder that every executor can open (a pyarrow file system URI)."""
    def run(slices):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        for rows in slices:
            for name, content in zip(rows.column("name").to_pylist(), rows.column("content").to_pylist()):
                with store.open_output_stream(f"{top}/.{name}.{attempt}") as out:
                    out.write(content)
                store.move(f"{top}/.{name}.{attempt}", f"{top}/{name}")  # a retry writes the same bytes
            yield {"name": rows.column("name"), "size": [len(c.as_py()) for c in rows.column("content")]}

    return map_rows(archives, run, "name string, size long")


# --- reading --------------------------------------------------------------------------------------

def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, by its block headers."""
    try:
        shape = zstandard.get_frame_parameters(data[at:at + 18])
        place = at + zstandard.frame_header_size(data[at:at + 18])
    except zstandard.ZstdError as e:
        raise WarcError(f"no frame at byte {at}: {e}") from None
    while True:
        head = int.from_bytes(data[place:place + 3], "little")
        if place + 3 > len(data) or (head >> 1) & 3 == 3:
            raise WarcError(f"broken block at byte {place}")
        place += 3 + (1 if (head >> 1) & 3 == 1 else head >> 3)
        if head & 1:
            break
    place += 4 if shape.has_checksum else 0
    if place > len(data):
        raise WarcError("archive ends inside a frame")
    return place


def frames(content: bytes):
    """The decoded frames of an archive, one at a time."""
    data = memoryview(content)
    if len(data) < 8 or struct.unpack("<I", data[:4])[0] != SKIPPABLE:
        raise WarcError("no dictionary frame in front")
    at = 8 + struct.unpack("<I", data[4:8])[0]
    front = bytes(data[8:at])
    if len(front) != at - 8:
        raise WarcError("archive ends inside the dictionary")
    if front[:4] == zstandard.FRAME_HEADER:
        front = zstandard.ZstdDecompressor().decompress(front)
    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(front) if front else None)
    while at < len(data):
        end = _frame_end(data, at)
        try:
            yield unpack.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at byte {at}: {e}") from None
        at = end


def _fields(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"not a header field: {line[:60]!r}")
        found[name.strip().decode().lower()] = value.strip().decode()
    return found


def parse(record: bytes) -> dict:
    """The fields and the payload of one record, validated."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1") or not gap:
        raise WarcError("no WARC version line")
    fields = _fields(lines)
    if missing := [k for k in _REQUIRED if k not in fields]:
        raise WarcError(f"fields missing: {missing}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("content length does not match")
    block = rest[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise WarcError("block digest does not match")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise WarcError("no HTTP header")
    size = int(_fields(http.partition(b"\r\n")[2])["content-length"])
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or fields.get("warc-payload-digest") != f"sha1:{base32_sha1(payload)}"):
        raise WarcError("payload does not match its length or digest")
    page = lambda v: None if v is None or "none" in v else int(v.removeprefix("<urn:page:").removesuffix(">"))
    return {"page_id": page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
            "refers_to": page(fields.get("warc-refers-to")), "payload_bytes": size,
            "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"), "payload": None if revisit else payload.decode()}


_COLUMNS = {"page_id": "long", "url": "string", "record_type": "string", "refers_to": "long", "payload_bytes": "long",
            "payload_digest": "string", "payload": "string"}


def _records(slices, names):
    for rows in slices:
        for content in rows.column("content"):
            out = {k: [] for k in names}
            for frame in frames(content.as_py()):
                found = parse(frame)
                for k in names:
                    out[k].append(found[k])
                if len(out[names[0]]) >= 256:
                    yield out
                    out = {k: [] for k in names}
            yield out


def read(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row per record of archives (content); revisits have no payload of their own.

    A record that does not validate stops the job with a WarcError that says why.
    """
    names = [k for k in _COLUMNS if with_payload or k != "payload"]
    return map_rows(archives.select("content"), lambda s: _records(s, names), ", ".join(f"{k} {_COLUMNS[k]}" for k in names))


def from_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select(F.col("path").alias("name"), "content")


def resolve(records: DataFrame) -> DataFrame:
    """Records whose revisits are checked against the response they refer to (same digest and length)."""
    target = (records.where("record_type = 'response'").groupBy("page_id", "payload_digest", "payload_bytes").agg(F.count(F.lit(1)).alias("__n"))
              .select(F.col("page_id").alias("__page"), F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes")))
    met = records.join(target, (F.col("refers_to") == F.col("__page")) & (F.col("payload_digest") == F.col("__digest"))
                       & (F.col("payload_bytes") == F.col("__bytes")), "left")
    lost = (F.col("record_type") == "revisit") & F.col("__page").isNull()
    checked = F.when(lost, F.raise_error(F.lit("a revisit refers to no response of equal payload")).cast("string")).otherwise(F.col("record_type"))
    return met.withColumn("record_type", checked).drop("__page", "__digest", "__bytes")
