"""WARC archives in Zstandard, written and read.

An archive is a skippable frame that holds a dictionary, then one frame per record, each compressed with
that dictionary. Archives are rows (path, content): a reader takes them from a table as from Spark's
``binaryFile`` source. The writer deals records to tasks; a task trains a dictionary on its first
records (a bounded sample) and closes an archive at a size limit, so neither side holds more than one.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumeset.llm.common import materialise

#: Fixed values of the formats
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX, NO_ID = "urn:page:", "none"

LEAST_REVISIT = 100  # bytes; smaller payloads are always kept
ARCHIVE_BYTES = 4 << 20  # of compressed records, after which an archive is closed
SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 1 << 20, 32 << 10, 3
ARCHIVE_SCHEMA = "path string, content binary"
RECORD_SCHEMA = "path string, frame int, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, error string"


def record_bytes(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit carries the response's header block but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID_PREFIX}{NO_ID if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join(url.split())}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(sample: list[bytes]) -> bytes:
    """A dictionary from a sample; its raw bytes if there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICTIONARY_BYTES:] or b"\r\n"


def write_archives(batches: Iterator[pd.DataFrame], archive_bytes: int = ARCHIVE_BYTES) -> Iterator[pd.DataFrame]:
    """mapInPandas body: rows (page_id, url, html, digest, refers_to) to archives."""
    records = (record_bytes(None if pd.isna(i) else int(i), u or "", (h or "").encode(), d, None if pd.isna(r) else int(r)) for b in batches for i, u, h, d, r in b.itertuples(index=False))
    sample, size = [], 0
    for r in records:
        sample.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    if not sample:
        return
    raw = train_dictionary(sample)
    head = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
    head = struct.pack("<II", SKIPPABLE, len(head)) + head
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True, write_content_size=True)
    parts, size = [head], 0

    def closed() -> pd.DataFrame:
        content = b"".join(parts)
        return pd.DataFrame({"path": [f"part-{hashlib.sha256(content).hexdigest()[:24]}.warc.zst"], "content": [content]})

    for r in itertools.chain(sample, records):
        parts.append(packer.compress(r))
        size += len(parts[-1])
        if size >= archive_bytes:
            yield closed()
            parts, size = [head], 0
    if size:
        yield closed()


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends; raises ValueError if it is cut short."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
    while True:
        if end + 3 > len(data):
            raise ValueError("frame cut short")
        block = int.from_bytes(data[end : end + 3], "little")
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    end += 4 * (flags >> 2 & 1)
    if end > len(data):
        raise ValueError("frame cut short")
    return end


def parse_record(raw: bytes) -> dict:
    """Fields of a record; raises ValueError if a header, a length or the digest is not as it must be."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError("bad header line")
        fields[name.strip().lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in fields:
            raise ValueError(f"no {need}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("content length differs")
    number = lambda x: None if (name := x.strip("<>").removeprefix(ID_PREFIX)) == NO_ID else int(name)
    out = {"page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri", ""), "record_type": fields["warc-type"], "refers_to": None, "payload_bytes": None}
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    http, found, payload = rest[:-4].partition(b"\r\n\r\n")
    stated = next((x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if not found or stated is None:
        raise ValueError("no HTTP header block")
    if out["record_type"] == "revisit":
        out["refers_to"] = number(fields.get("warc-refers-to", ""))
        if payload:
            raise ValueError("a revisit with a payload")
    else:
        out["payload_bytes"] = len(payload)
        if int(stated) != len(payload):
            raise ValueError("HTTP content length differs")
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("payload digest differs")
    return out | {"payload_digest": digest, "payload": payload}


def frames_of(content: bytes) -> Iterator[tuple[int, dict]]:
    """(number, fields) of each record; a faulty record has ``error``. An archive that is cut short ends with one."""
    data, at, unpack = memoryview(content), 0, zstandard.ZstdDecompressor()
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == SKIPPABLE:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        raw = bytes(data[8:at])
        if raw[:4] == struct.pack("<I", FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    n = 0
    while at < len(data):
        try:
            if len(data) - at < 9 or struct.unpack_from("<I", data, at)[0] != FRAME:
                raise ValueError("no frame where one must start")
            end = frame_end(data, at)
        except ValueError as e:
            yield n, {"error": str(e)}
            return
        try:
            yield n, parse_record(unpack.decompress(data[at:end]))
        except (ValueError, zstandard.ZstdError) as e:
            yield n, {"error": str(e)}
        at, n = end, n + 1


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of archives (path, content), one row per frame with RECORD_SCHEMA.

    A revisit has null payload_bytes: its payload is in the record it refers to. A faulty record has ``error`` and
    nulls; the records after it are still read. Empty archives give no rows.
    """
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

    def read(batches):
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = ([path, n, *(f.get(c) for c in names[2:])] for n, f in frames_of(content))
                while part := list(itertools.islice(rows, 2000)):
                    yield pd.DataFrame(part, columns=names).astype({c: "Int64" for c in ("page_id", "refers_to", "payload_bytes")})

    return archives.select("path", "content").mapInPandas(read, RECORD_SCHEMA)


def with_digests(pages: DataFrame) -> DataFrame:
    """Add digest (lower-case hex SHA-256 of the payload) and refers_to (smallest page_id of an equal earlier payload, else null)."""
    html = F.coalesce("html", F.lit(""))
    made = pages.select("page_id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("n"))
    first = made.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").select("digest", "first")
    # only digests that repeat go on to the join; the payload itself is not shuffled for it
    keys = made.where(F.col("n") >= LEAST_REVISIT).select("page_id", "digest").join(first, "digest").where("page_id is null or page_id > first")
    # a page_id may stand in rows of several payloads, so a row is named by both
    keys = keys.select(F.col("page_id").alias("again"), F.col("digest").alias("again_digest"), "first").distinct()
    return made.join(keys, made["page_id"].eqNullSafe(keys["again"]) & (made["digest"] == keys["again_digest"]), "left").select("page_id", "url", "html", "digest", F.col("first").alias("refers_to"))


def pages_to_archives(pages: DataFrame) -> DataFrame:
    """Archives of pages (page_id, url, html); other columns are ignored.

    Null html is an empty payload, a null url an empty one. A row of null page_id gets a record without a number; it is a revisit if its payload is that
    of a numbered page, and no record refers to it. Repeated rows get a record each.
    """
    return with_digests(pages.select("page_id", "url", "html")).mapInPandas(write_archives, ARCHIVE_SCHEMA)


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to archives in the shared folder, read them back, and tell what each record holds."""
    archives = materialise(pages_to_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")), "archives", **{"parquet.block.size": 16 << 20, "compression": "none"})
    records = read_archives(archives)
    records = materialise(records.withColumn("page_id", F.when(F.col("error").isNull(), F.col("page_id")).otherwise(F.raise_error(F.concat_ws(": ", "path", "error")))), "records")
    # a response is named by id and digest; repeated rows of one are the same payload
    whole = records.where("record_type = 'response'").select(F.col("page_id").alias("first"), F.col("payload_digest").alias("whole_digest"), F.col("payload_bytes").alias("whole_bytes"))
    wanted = records.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    whole = whole.join(wanted, (F.col("first") == F.col("refers_to")) & (F.col("whole_digest") == F.col("payload_digest")), "left_semi").dropDuplicates(["first", "whole_digest"])
    found = records.join(whole, (F.col("refers_to") == F.col("first")) & (F.col("payload_digest") == F.col("whole_digest")), "left")
    return found.select("page_id", F.coalesce("payload_bytes", "whole_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")



ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
        min(page_id) OVER (PARTITION BY sha256(h)) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND coalesce(page_id > first, first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND coalesce(page_id > first, first IS NOT NULL) THEN first END AS refers_to
FROM m
"""
