"""WARC archives in Zstandard: one frame per record behind a dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickspark.llm.storage import read_blobs, write_blobs

# fixed values of the formats
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
RAW_DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An empty skippable frame: every archive ends in it, so a cut archive is noticed.
END = struct.pack("<II", 0x184D2A50, 0)

ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES = 16 << 10
DICTIONARY_SAMPLE = 64

READ_SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, "
               "payload_bytes long, payload_digest string, payload binary, problem string")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# -- writing -------------------------------------------------------------------------------------

def _field(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def build_record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """An HTTP response record, or a revisit record that keeps the HTTP head and drops the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to else head + payload
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    if uri is not None:
        fields.append(("WARC-Target-URI", _field(uri)))
    if refers_to:
        fields += [("WARC-Refers-To", f"<{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
    fields += [("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"),
               ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def build_archive(records: list[bytes]) -> bytes:
    """Dictionary frame and record frames. The dictionary is trained on the first DICTIONARY_SAMPLE
    records; where they are too few or too uniform to train on, the archive has none."""
    frames, trained = [], None
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, records[:DICTIONARY_SAMPLE])
    except zstandard.ZstdError:
        pass
    if trained:
        packed = zstandard.ZstdCompressor().compress(trained.as_bytes())
        frames.append(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
    compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, **({"dict_data": trained} if trained else {}))
    return b"".join([*frames, *map(compressor.compress, records)])


def with_revisits(pages: DataFrame, id_col: str, payload: Column, least_bytes: int) -> DataFrame:
    """``pages`` with ``payload`` and ``refers_to``: the largest id of the records with the same payload.

    Null for that record itself, for payloads below ``least_bytes`` and where no record has an id.
    """
    hashed = pages.withColumn("payload", payload).withColumn("payload_key", F.unhex(F.sha1("payload")))
    first = hashed.groupBy("payload_key").agg(F.max(id_col).alias("response_id"))
    own = F.col(id_col).eqNullSafe(F.col("response_id")) | (F.octet_length("payload") < least_bytes)
    return hashed.join(first, "payload_key").withColumn("refers_to", F.when(~own, F.col("response_id")))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", date: str = "2024-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One record per row of ``pages``: of equal payloads the largest id is the response, others revisit it.

    The payload is the whole html in UTF-8; a null html is an empty payload, a null url leaves out the
    target, a null id writes the record id ``urn:page:none``. Repeated rows of the largest id are all
    responses. Payloads below ``least_bytes`` are never revisited. An empty table writes no archive.
    Only the three named columns are read. An archive takes records until ``archive_bytes`` are reached.
    """
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, records = 0, []
        for batch in batches:
            for record_id, url, payload, refers_to in batch.itertuples(index=False):
                records.append(build_record(record_id, url, payload, refers_to, date))
                held += len(records[-1])
                if held >= archive_bytes:
                    yield pd.DataFrame({"blob": [build_archive(records)]})
                    held, records = 0, []
        if records:
            yield pd.DataFrame({"blob": [build_archive(records)]})

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    planned = with_revisits(rows, "id", F.coalesce(F.col("html"), F.lit("")).cast("binary"), least_bytes).select(
        F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none"))).alias("record_id"), "url", "payload",
        F.concat(F.lit("urn:page:"), F.col("refers_to").cast("string")).alias("refers_to"))
    write_blobs(planned.mapInPandas(build, "blob binary"), "blob", path, END)


# -- reading -------------------------------------------------------------------------------------

def frame_end(data: bytes, at: int) -> int:
    """Where the Zstandard or skippable frame at ``at`` ends; ValueError if it is cut or no frame."""
    magic = data[at:at + 4]
    if len(magic) == 4 and 0x184D2A50 <= struct.unpack("<I", magic)[0] <= 0x184D2A5F:
        if len(data) < at + 8:
            raise ValueError("cut frame")
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    elif magic == ZSTD_MAGIC and len(data) > at + 6:
        checksum = 4 * bool(data[at + 4] & 4)
        end, last = at + zstandard.frame_header_size(data[at:at + 18]), False
        while not last:
            if len(data) < end + 3:
                raise ValueError("cut frame")
            block = int.from_bytes(data[end:end + 3], "little")
            last = bool(block & 1)
            end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        end += checksum
    else:
        raise ValueError("no frame")
    if end > len(data):
        raise ValueError("cut frame")
    return end


def load_dictionary(data: bytes) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """(dictionary, offset of the first frame after it); no dictionary where the archive begins otherwise."""
    if data[:4] != struct.pack("<I", DICTIONARY_MAGIC):
        return None, 0
    end = frame_end(data, 0)
    content = data[8:end]
    if content[:4] == ZSTD_MAGIC:
        content = zstandard.ZstdDecompressor().decompress(content)
    if content[:4] != RAW_DICTIONARY_MAGIC:
        raise ValueError("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(content), end


def parse_record(record: bytes) -> dict:
    """Fields of one record; ``problem`` says what is wrong with its header, length or digests."""
    head, blank, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not blank or version not in VERSIONS:
        return {"problem": "no WARC header"}
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            return {"problem": f"header line without a colon: {name[:80]}"}
        fields.setdefault(name.strip().lower(), value.strip())
    missing = [x for x in REQUIRED if x not in fields]
    if missing:
        return {"problem": f"missing {', '.join(missing)}"}
    out = {"record_id": fields["warc-record-id"].strip("<>"), "record_type": fields["warc-type"],
           "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to", "").strip("<>") or None}
    length = fields["content-length"]
    if not (length.isascii() and length.isdigit()) or int(length) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        return out | {"problem": f"Content-Length {length[:20]}, but the frame holds {len(rest) - 4} bytes of block"}
    block = rest[:-4]
    if fields.get("warc-block-digest", "sha1:").partition(":")[2] not in ("", digest(block)):
        return out | {"problem": "block digest"}
    payload, size = block, len(block)
    declared = fields.get("warc-payload-digest", "").partition(":")[2] or None
    if fields.get("content-type", "").startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        stated = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", http)
        size = int(stated[1]) if stated else len(payload)
        if not blank:
            return out | {"problem": "no HTTP head"}
    if out["record_type"] != "revisit":
        if size != len(payload):
            return out | {"problem": f"HTTP length {size}, but {len(payload)} bytes of payload"}
        if declared and declared != digest(payload):
            return out | {"problem": "payload digest"}
        declared = digest(payload)
    return out | {"payload_bytes": size, "payload_digest": declared, "payload": payload, "problem": None}


def parse_archive(data: bytes) -> Iterator[dict]:
    """One entry per frame that holds a record. What can't be read becomes an entry with a ``problem``."""
    try:
        trained, at = load_dictionary(data)
    except (ValueError, zstandard.ZstdError) as fault:
        yield {"problem": f"dictionary: {fault}"}
        return
    reader = zstandard.ZstdDecompressor(**({"dict_data": trained} if trained else {}))
    while at < len(data):
        try:
            end = frame_end(data, at)
        except (ValueError, zstandard.ZstdError) as fault:
            yield {"problem": f"byte {at}: {fault}"}
            return
        if data[at:at + 4] == ZSTD_MAGIC:
            try:
                yield parse_record(reader.decompressobj().decompress(data[at:end]))
            except zstandard.ZstdError as fault:
                yield {"problem": f"byte {at}: {fault}"}
        at = end
    if data[-len(END):] != END:
        yield {"problem": "the archive has no end mark"}


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Every record of the archives under ``path`` (READ_SCHEMA; no ``payload`` column if not wanted).

    A broken record keeps the columns that could be read and says why in ``problem``; the frames
    after it are read on. Revisit records have the digest and length of the payload they leave out.
    """
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    kept = [n for n in names if with_payload or n != "payload"]
    schema = ", ".join(x for x in READ_SCHEMA.split(", ") if x.split()[0] in kept)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[dict]) -> pd.DataFrame:
            out = pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in kept})
            return out.astype({"payload_bytes": "Int64"})

        for batch in batches:
            for content in batch["content"]:
                rows: list[dict] = []
                for row in parse_archive(content):
                    rows.append(row)
                    if len(rows) == 500:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    return read_blobs(spark, path).select("content").mapInPandas(parse, schema)
