"""TIFF columns: a writer for payloads and a reader that emits one row per page.

The reader walks the chain of image directories of either byte order, decodes strips or tiles (stored plainly, PackBits, LZW or
deflate), undoes the horizontal predictor and crops tiles. The writer makes files of several pages that use each of these forms.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gregale.llm.common import Scratch, read, small_batches

# Tags, field types and compressions as the format fixes them.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 322, 323, 324, 325
FIELD = {1: "B", 3: "H", 4: "I"}
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
CLEAR, END = 256, 257

UNIT = 576
#: A payload unit is a block of COLUMNS x 12 samples.
COLUMNS = 48
#: Units that a page holds at most.
PAGE_UNITS = 2048
RUN = re.compile(rb"(.)\1{2,127}", re.S)


class BadTiff(ValueError):
    pass


def packbits_encode(data: bytes) -> bytes:
    out, at = [], 0

    def literal(stop: int) -> None:
        for i in range(at, stop, 128):
            part = data[i : min(i + 128, stop)]
            out.append(bytes([len(part) - 1]) + part)

    for m in RUN.finditer(data):
        literal(m.start())
        out.append(bytes([257 - (m.end() - m.start())]) + m[1])
        at = m.end()
    literal(len(data))
    return b"".join(out)


def packbits_decode(data: bytes) -> bytes:
    out, i, n = [], 0, len(data)
    while i < n:
        head = data[i]
        if head < 128:
            out.append(data[i + 1 : i + 2 + head])
            i += 2 + head
        elif head > 128:
            out.append(data[i + 1 : i + 2] * (257 - head))
            i += 2
        else:
            i += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes from 9 to 12 bits, high bits first; the width grows with entries 511, 1023 and 2047, of which the reader is one behind."""
    singles = {bytes([i]): i for i in range(256)}
    table, free, width, prefix = dict(singles), 258, 9, b""
    bits, n, parts = CLEAR, 9, []
    for i in range(len(data)):
        byte = data[i : i + 1]
        grown = prefix + byte
        if grown in table:
            prefix = grown
            continue
        bits, n = bits << width | table[prefix], n + width
        table[grown] = free
        free += 1
        prefix = byte
        if free == 4095:
            bits, n = bits << width | CLEAR, n + width
            table, free, width = dict(singles), 258, 9
        elif free == 1 << width:
            width += 1
        if n >= 1 << 12:  # keeps the number that gathers bits short
            rest = n & 7
            parts.append((bits >> rest).to_bytes(n >> 3, "big"))
            bits, n = bits & ((1 << rest) - 1), rest
    if prefix:
        bits, n = bits << width | table[prefix], n + width
        if free + 1 == 1 << width and width < 12:
            width += 1
    bits, n = bits << width | END, n + width
    pad = -n % 8
    return b"".join([*parts, (bits << pad).to_bytes((n + pad) // 8, "big")])


def lzw_decode(data: bytes) -> bytes:
    """Stops at the end code or where the data end."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, out, before = list(first), 9, [], b""
    hold, held, at, n = 0, 0, 0, len(data)
    while True:
        while held < width:
            if at >= n:
                return b"".join(out)
            more = data[at : at + 4]
            hold, held, at = (hold & ((1 << held) - 1)) << (8 * len(more)) | int.from_bytes(more, "big"), held + 8 * len(more), at + 4
        held -= width
        code = hold >> held & ((1 << width) - 1)
        if code == END:
            return b"".join(out)
        if code == CLEAR:
            table, width, before = list(first), 9, b""
            continue
        if not before:
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = before + before[:1]
            else:
                raise BadTiff(f"LZW code {code} before {len(table)}")
            table.append(before + entry[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(entry)
        before = entry


def _decode(data: bytes, compression: int) -> bytes:
    if compression == PLAIN:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if compression == PACKBITS:
        return packbits_decode(data)
    if compression == LZW:
        return lzw_decode(data)
    raise BadTiff(f"compression {compression} isn't supported")


ENCODE = {PLAIN: bytes, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: packbits_encode, LZW: lzw_encode}


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    tiled: bool
    data: bytes


def read_pages(file: bytes) -> Iterator[Page]:
    order = {b"II": "<", b"MM": ">"}.get(file[:2])
    if order is None or struct.unpack(order + "H", file[2:4])[0] != 42:
        raise BadTiff("no TIFF header")
    (at,) = struct.unpack(order + "I", file[4:8])
    seen: set[int] = set()
    while at:
        if at in seen:
            raise BadTiff("the directories form a ring")
        seen.add(at)
        try:
            (n,) = struct.unpack_from(order + "H", file, at)
            tags = {}
            for k in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", file, at + 2 + 12 * k)
                if kind in FIELD:
                    size = struct.calcsize(FIELD[kind]) * count
                    where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", file, at + 10 + 12 * k)[0]
                    tags[tag] = struct.unpack_from(f"{order}{count}{FIELD[kind]}", file, where)
            (following,) = struct.unpack_from(order + "I", file, at + 2 + 12 * n)
        except struct.error as e:
            raise BadTiff("a directory is cut off") from e
        yield _page(file, tags, len(seen) - 1, order)
        at = following


def _page(file: bytes, tags: dict[int, tuple[int, ...]], number: int, order: str) -> Page:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    compression, predictor, tiled = one(COMPRESSION, PLAIN), one(PREDICTOR, 1), TILES in tags
    if not width or not height or bits not in (8, 16) or one(PLANAR, 1) != 1 or predictor not in (1, 2):
        raise BadTiff("only chunky pages of 8 or 16 bits, with no predictor or the horizontal one, are supported")
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    kind = np.dtype(np.uint8 if bits == 8 else order + "u2")
    across, down = -(-width // w), -(-height // h)
    offsets, sizes = (tags.get(TILES), tags.get(TILE_BYTES)) if tiled else (tags.get(STRIPS), tags.get(STRIP_BYTES))
    if not offsets or not sizes or len(offsets) != across * down or len(sizes) != len(offsets):
        raise BadTiff("strips or tiles don't cover the page")
    image = np.empty((height, width, samples), kind)
    for k, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        top, left = k // across * h, k % across * w
        rows = h if tiled else min(h, height - top)
        if offset + size > len(file):
            raise BadTiff("a strip or tile is cut off")
        raw = _decode(file[offset : offset + size], compression)
        if len(raw) < rows * w * samples * kind.itemsize:
            raise BadTiff("a strip or tile is too short")
        block = np.frombuffer(raw, kind, rows * w * samples).reshape(rows, w, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        image[top : top + rows, left : left + w] = block[: height - top, : width - left]
    return Page(number, width, height, samples, bits, compression, predictor, tiled, image.tobytes())


def write_tiff(pages: list[tuple[np.ndarray, int, int, tuple[int, int] | int]]) -> bytes:
    """pages: 8-bit gray image, compression, predictor (1 or 2), and rows per strip or (width, height) of tiles."""
    out = [b"II*\0\0\0\0\0"]
    size, link = 8, 4
    links: list[tuple[int, int]] = []
    for image, compression, predictor, cut in pages:
        height, width = image.shape
        tiled = isinstance(cut, tuple)
        w, h = cut if tiled else (width, cut)
        offsets, sizes = [], []
        for top in range(0, height, h):
            for left in range(0, width, w):
                block = image[top : top + h, left : left + w]
                if tiled and block.shape != (h, w):
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1])))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.uint8(0))
                data = ENCODE[compression](block.tobytes())
                data += b"\0" * (len(data) & 1)
                offsets.append(size)
                sizes.append(len(data))
                out.append(data)
                size += len(data)
        fields = {WIDTH: [width], HEIGHT: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PLANAR: [1], PREDICTOR: [predictor]}
        fields |= {TILE_WIDTH: [w], TILE_HEIGHT: [h], TILES: offsets, TILE_BYTES: sizes} if tiled else {STRIP_ROWS: [h], STRIPS: offsets, STRIP_BYTES: sizes}
        entries = b""
        for tag in sorted(fields):
            values = fields[tag]
            if len(values) > 1:
                out.append(struct.pack(f"<{len(values)}I", *values))
                entries += struct.pack("<HHII", tag, 4, len(values), size)
                size += 4 * len(values)
            else:
                entries += struct.pack("<HHII", tag, 4, 1, values[0])
        links.append((link, size))
        out.append(struct.pack("<H", len(fields)) + entries + b"\0\0\0\0")
        link = size + 2 + len(entries)
        size = link + 4
    file = bytearray(b"".join(out))
    for at, to in links:
        file[at : at + 4] = struct.pack("<I", to)
    return bytes(file)


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (UNIT * max(1, -(-len(raw) // UNIT)) - len(raw))


def store(payload: bytes) -> bytes:
    """A TIFF of the payload in some eight pages, of at least a unit and at most PAGE_UNITS each.

    Of every eight pages in a row one is LZW, two are PackBits and five deflate, so that each has its part of every text of eight
    units or more. Every third page is tiled, the others are in two strips; every second deflate page and every other LZW page has
    the predictor.
    """
    image = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS)
    unit = UNIT // COLUMNS
    height = unit * min(PAGE_UNITS, max(1, len(image) // unit // 8))
    pages = []
    for k, top in enumerate(range(0, len(image), height)):
        block = image[top : top + height]
        codec = LZW if k % 8 == 0 else PACKBITS if k % 4 == 1 else DEFLATE
        predictor = 2 if k % 16 == 8 or codec == DEFLATE and k % 2 == 0 else 1
        tile = (COLUMNS, max(16, len(block) // 64 * 16))
        pages.append((block, codec, predictor, tile if k % 3 == 1 else max(unit, len(block) // 2)))
    return write_tiff(pages)


@dataclass
class Digest:
    """What is told of a payload whose pages come one after another; no more than its last bytes are kept."""

    n: int = 0
    pages: int = 0
    tail: bytes = b""
    steps: int = 0

    def __post_init__(self):
        self.sha, self.counts = hashlib.sha256(), np.zeros(256, np.int64)

    def add(self, samples: bytes) -> None:
        a = np.frombuffer(samples, np.uint8)
        self.sha.update(samples)
        self.counts += np.bincount(a, minlength=256)
        self.steps += int(np.abs(np.diff(np.frombuffer(self.tail[-1:] + samples, np.uint8).astype(np.int16))).sum())
        self.n, self.pages, self.tail = self.n + len(samples), self.pages + 1, (self.tail + samples[-32:])[-32:]

    def feature(self) -> str:
        """Number of pages, mean, variance and mean step between neighbours of all samples, from whole-number sums."""
        values, n = np.arange(256), max(self.n, 1)
        mean, squares = int(self.counts @ values) / n, int(self.counts @ (values * values)) / n
        return f"pages={self.pages};mean={mean:.4f};variance={squares - mean * mean:.4f};step={self.steps / n:.4f}"


def store_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each whole text as a TIFF. Null and empty texts are a payload of one unit of padding."""
    schema = T.StructType([*docs.select(id_col).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [payload_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([store(p) for _, p in rows], pa.binary())], names=schema.names)

    small_batches(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def explode_pages(files: DataFrame, id_col: str = "doc_id", media_col: str = "media", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carry..., page, width, height, samples, bits, compression, predictor, tiled, data, error): one row per page of each file.

    A null file has no rows. A file that can't be read has the pages before the fault and one row that names it. Repeated rows give
    their pages each. A file's pages follow each other in one partition, in their order. carry: columns of files that go along.
    """
    before = [id_col, *carry]
    schema = T.StructType([*files.select(*before).schema.fields, *[T.StructField(n, T.IntegerType()) for n in ("page", "width", "height", "samples", "bits", "compression", "predictor")], T.StructField("tiled", T.BooleanType()), T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, kinds = [], 0, []

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=schema.names)
            rows.clear()
            return out

        for batch in batches:
            kinds = [*batch.schema.types[: len(before)], *[pa.int32()] * 7, pa.bool_(), pa.binary(), pa.string()]
            columns = [c.to_pylist() for c in batch.columns[: len(before)]]
            for row, file in zip(zip(*columns, strict=True), batch.column(len(before)).to_pylist(), strict=True):
                try:
                    for p in read_pages(file) if file is not None else ():
                        rows.append((*row, p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.tiled, p.data, None))
                except (BadTiff, zlib.error, struct.error, ValueError) as e:
                    rows.append((*row, *[None] * 9, str(e)))
                held += len(file or b"")
                if held >= 1 << 21:
                    held = 0
                    yield given()
        if rows:
            yield given()

    small_batches(files.sparkSession)
    return files.select(*before, media_col).mapInArrow(run, schema)


def digest_pages(pages: DataFrame, carry: tuple[str, ...], id_col: str = "doc_id") -> DataFrame:
    """(id, carry..., payload_bytes, payload_sha256, tail_crc32, feature, error) of each file from its pages, as explode_pages gives them.

    Pages of a file follow each other, so that they are told as they come, without a shuffle. error: the fault, if a file has one.
    """
    before = [id_col, *carry]
    schema = T.StructType([*pages.select(*before).schema.fields, *[T.StructField(n, t) for n, t in (("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("feature", T.StringType()), ("error", T.StringType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, told, fault, done, kinds = None, None, None, [], []

        def end() -> None:
            if row is not None:
                done.append((*row, told.n, told.sha.hexdigest(), zlib.crc32(told.tail), told.feature(), fault))

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names=schema.names)
            done.clear()
            return out

        for batch in batches:
            kinds = [*batch.schema.types[: len(before)], pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            *of, number, data, error = (c.to_pylist() for c in batch.columns)
            for own, page, samples, message in zip(zip(*of, strict=True), number, data, error, strict=True):
                if page == 0 or page is None and row != own:
                    end()
                    row, told, fault = own, Digest(), None
                if page is None:
                    fault = message
                else:
                    told.add(samples)
            if len(done) >= 512:
                yield given()
        end()
        if done:
            yield given()

    small_batches(pages.sparkSession)
    return pages.select(*before, "page", "data", "error").mapInArrow(run, schema)


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), all but n_bytes and media of what the reader gives back.

    The files are a stored table; their pages, a row each, are read from it. A file that the reader can't read is an error.
    """
    stored = Scratch(docs.sparkSession, "tiff").keep(store_documents(docs, id_col, text_col), "files")
    carry = ("n_bytes", "media_bytes", "media_sha256")
    files = stored.select(id_col, "media", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"))
    told = digest_pages(explode_pages(files, id_col, "media", carry), carry, id_col)
    sound = F.assert_true(F.col("error").isNull(), F.col("error")).isNull()
    return told.where(sound).select(id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op6_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_and_read(read(spark, sf_dir, "documents"))
