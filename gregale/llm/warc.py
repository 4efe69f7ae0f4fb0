"""WARC archives compressed with Zstandard, one frame per record, with a dictionary in a leading skippable frame.

Writer: each task packs its pages into archives of bounded size; a page whose payload has been archived under a smaller id is written
as a revisit of that page. Archives are rows of a stored table (name, content), as each is small and only Spark's storage is shared
by all executors; the reader takes such rows, and so the binary files of real archives too.

Reader: loads the dictionary, decodes frame by frame, and checks of every record that its frame ends with it, that its header and
length fields hold, and that a response's payload has the digest that it states.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gregale.llm.common import Scratch, read, small_batches

# As the formats fix them.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Uncompressed bytes after which a task closes an archive.
ARCHIVE_BYTES = 8_000_000
DICTIONARY_BYTES = 16_384
RECORD = "urn:page:"


class BadWarc(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit of refers_to, which keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{RECORD}{'none' if page_id is None else page_id}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join((url or "about:blank").split())),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{RECORD}{refers_to}>"), ("WARC-Profile", PROFILE)]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary learned from some records' beginnings; where they are too few or too alike to learn from, the beginnings themselves."""
    samples = [s[:4096] for s in samples[:: max(1, len(samples) // 200)]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def pack(records: list[bytes]) -> bytes:
    words = train(records)
    coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
    return struct.pack("<II", DICTIONARY_MAGIC, len(words)) + words + b"".join(map(coder.compress, records))


def frames(archive: bytes) -> Iterator[bytes]:
    """Each frame's content. The dictionary may itself be a Zstandard frame; other skippable frames are passed over."""
    at, words = 0, None
    view = memoryview(archive)
    if len(archive) >= 8 and struct.unpack_from("<I", archive)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", archive, 4)[0]
        raw = archive[8 : 8 + size]
        if len(raw) < size:
            raise BadWarc("the dictionary is cut off")
        if raw[:4] == FRAME_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 26)
        words, at = zstandard.ZstdCompressionDict(raw), 8 + size
    decoder = zstandard.ZstdDecompressor(dict_data=words)
    while at < len(archive):
        if at + 8 <= len(archive) and 0x184D2A50 <= struct.unpack_from("<I", archive, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", archive, at + 4)[0]
            continue
        frame, out = decoder.decompressobj(), []
        while not frame.eof:
            if at >= len(archive):
                raise BadWarc("the last frame is cut off")
            part = view[at : at + 16_384]
            try:
                out.append(frame.decompress(part))
            except zstandard.ZstdError as e:
                raise BadWarc(str(e)) from e
            at += len(part)
        at -= len(frame.unused_data)
        yield b"".join(out)


def parse(frame: bytes) -> tuple[str | None, int, str, str, str | None]:
    """(page id, payload bytes, digest, type, refers to) of a record that fills its frame."""
    head, gap, rest = frame.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (VERSION, b"WARC/1.0"):
        raise BadWarc("no WARC header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadWarc("a header field has no colon")
        fields[name.decode().lower()] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise BadWarc(f"{name} is missing")
    if not fields["content-length"].isdigit() or rest[int(fields["content-length"]) :] != b"\r\n\r\n":
        raise BadWarc("the block isn't as long as stated")
    block = rest[:-4]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    sha = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if stated != len(payload) or digest(payload) != sha:
            raise BadWarc("the payload isn't what its length and digest say")
    elif fields["warc-type"] != "revisit" or "warc-refers-to" not in fields or stated is None:
        raise BadWarc("neither a response nor a whole revisit")
    own = fields["warc-record-id"].strip("<>").removeprefix(RECORD)
    to = fields["warc-refers-to"].strip("<>").removeprefix(RECORD) if fields["warc-type"] == "revisit" else None
    return None if own == "none" else own, stated, sha, fields["warc-type"], to


def write_archives(pages: DataFrame, least: int = 0) -> DataFrame:
    """(name, content): archives of all pages (page_id, url, html).

    Of pages with equal payloads of at least `least` bytes, the one with the smallest page_id is a response and the others revisit
    it. Null html is an empty payload, a null url is about:blank. Pages with a null id are always responses, and none revisits them;
    repeated rows of the smallest id are responses each. Other columns are left behind. Equal payloads are found by SHA-1 and length.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload")})
    firsts = pages.where(F.col("size") >= least).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("sha", "size", "first")
    rows = pages.join(firsts, ["sha", "size"], "left").select("page_id", "url", "payload", F.when(F.col("first") < F.col("page_id"), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0

        def close() -> pa.RecordBatch:
            content = pack(records)
            return pa.RecordBatch.from_pydict({"name": [f"{hashlib.sha256(content).hexdigest()[:24]}.warc.zst"], "content": [content]})

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                records.append(record(*row))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    records, size = [], 0
        if records:
            yield close()

    small_batches(pages.sparkSession)
    return rows.mapInArrow(run, "name string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, error), one row per record of (content, ...).

    A fault gives one row that names it, after which the rest of its archive is left, as frames can't be found without the ones before.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = []
                try:
                    for frame in frames(content or b""):
                        page, size, sha, kind, to = parse(frame)
                        rows.append((None if page is None else int(page), size, sha, kind, None if to is None else int(to), None))
                except ValueError as e:
                    rows.append((None, None, None, None, None, str(e)))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error"])

    small_batches(archives.sparkSession)
    return archives.select("content").mapInArrow(run, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = Scratch(spark, "warc").keep(write_archives(read(spark, sf_dir, "pages")), "archives")
    out = read_archives(archives)
    faulty = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("long"))
    return out.select(F.coalesce(faulty, F.col("page_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST(('0x' || substr(h, {5 * i + 1}, 5)) AS BIGINT) // {1 << shift}) % 32, 1)" for i in range(8) for shift in (15, 10, 5, 0))
SQL7 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
d AS (SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes, sha1(x) AS h, min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""
