"""TIFF columns: write samples as a page, read files page by page.

Reading walks the chain of image directories in either byte order, decodes plain, PackBits, LZW or deflate strips and
tiles, undoes horizontal differencing and gives one row per page.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from warden.llm import common

# Fixed values of the format: tags, field sizes, compression schemes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR \
    = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, FILL_ORDER, SAMPLE_FORMAT = 322, 323, 324, 325, 266, 339
FIELD = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i")}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946

SIDE = 64
STRIP = 64 << 10
#: Pages of one file, at most; a longer chain is an endless one.
PAGES = 65_535


# --- codecs ---------------------------------------------------------------------------------------------------------

def unpack_bits(data: bytes) -> bytes:
    """PackBits: a count byte, then that many bytes, or one byte that many times."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1:at + 2 + n])
            at += n + 2
        else:
            if n > 128:
                out.append(data[at + 1:at + 2] * (257 - n))
            at += 1 + (n > 128)
    return b"".join(out)


def pack_bits(data: bytes) -> bytes:
    """The writer's side of PackBits: repeats of three or more as runs."""
    out, plain, at = bytearray(), bytearray(), 0

    def flush():
        for k in range(0, len(plain), 128):
            part = plain[k:k + 128]
            out.extend(bytes([len(part) - 1]) + part)
        plain.clear()

    while at < len(data):
        end = at + 1
        while end < len(data) and end - at < 128 and data[end] == data[at]:
            end += 1
        if end - at >= 3:
            flush()
            out.extend((257 - (end - at), data[at]))
        else:
            plain.extend(data[at:end])
        at = end
    flush()
    return bytes(out)


def _lzw_width(entries: int) -> int:
    """Bits of the next code, from the writer's number of entries; the reader is one behind."""
    return min(12, max(9, entries.bit_length()))


def lzw_decode(data: bytes) -> bytes:
    """LZW of this format: codes of 9 to 12 bits from the highest bit on, 256 starts anew, 257 ends."""
    out: list[bytes] = []
    table: list[bytes] = []
    last, held, bits, at = b"", 0, 0, 0
    while True:
        width = _lzw_width(len(table) + 1)
        while bits < width and at < len(data):
            held, bits, at = (held << 8 | data[at]) & 0xFFFFFFFF, bits + 8, at + 1
        if bits < width:
            return b"".join(out)
        code = held >> (bits - width) & ((1 << width) - 1)
        bits -= width
        held &= (1 << bits) - 1
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, last = [bytes([i]) for i in range(256)] + [b"", b""], b""
            continue
        if not table:
            raise ValueError("LZW data does not begin with a clear code")
        if code < len(table):
            word = table[code]
        elif code == len(table) and last:
            word = last + last[:1]
        else:
            raise ValueError("LZW code out of range")
        if last and len(table) < 4096:
            table.append(last + word[:1])
        out.append(word)
        last = word


def lzw_encode(data: bytes) -> bytes:
    """The writer's side: greedy longest match, a clear code whenever the table is full."""
    held, bits, out = 0, 0, bytearray()

    def put(code, width):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    table, entries = {bytes([i]): i for i in range(256)}, 258
    put(256, 9)
    word = b""
    for at in range(len(data)):
        longer = word + data[at:at + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], _lzw_width(entries))
        table[longer] = entries
        entries += 1
        if entries == 4094:
            put(256, 12)
            table, entries = {bytes([i]): i for i in range(256)}, 258
        word = data[at:at + 1]
    if word:
        put(table[word], _lzw_width(entries))
        entries += 1
    put(257, _lzw_width(entries))
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def decompress(data: bytes, scheme: int) -> bytes:
    if scheme == NONE:
        return data
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(data)
    if scheme == PACKBITS:
        return unpack_bits(data)
    if scheme == LZW:
        return lzw_decode(data)
    raise ValueError(f"compression {scheme} is not supported")


def compress(data: bytes, scheme: int) -> bytes:
    return {NONE: lambda d: d, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: pack_bits, LZW: lzw_encode}[scheme](data)


# --- files ----------------------------------------------------------------------------------------------------------

def write(pages: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 2, tile: int = 0, order: str = "<",
          strip: int = STRIP) -> bytes:
    """A file of pages of 8- or 16-bit samples (rows, columns[, samples]); `tile` > 0 writes square tiles, else strips."""
    out = bytearray(b"II*\0\0\0\0\0" if order == "<" else b"MM\0*\0\0\0\0")
    link = 4
    for page in pages:
        page = page if page.ndim == 3 else page[:, :, None]
        rows, columns, samples = page.shape
        bits = page.dtype.itemsize * 8
        if tile:
            parts = [page[y:y + tile, x:x + tile] for y in range(0, rows, tile) for x in range(0, columns, tile)]
            parts = [np.pad(p, ((0, tile - p.shape[0]), (0, tile - p.shape[1]), (0, 0))) for p in parts]
            high = tile
        else:
            high = max(1, strip // max(1, columns * samples * bits // 8))
            parts = [page[y:y + high] for y in range(0, rows, high)]
        offsets, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
            data = compress(part.astype(part.dtype.newbyteorder(order)).tobytes(), scheme)
            offsets.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) & 1)
        fields = {WIDTH: (4, [columns]), LENGTH: (4, [rows]), BITS: (3, [bits] * samples), COMPRESSION: (3, [scheme]),
                  PHOTOMETRIC: (3, [2 if samples == 3 else 1]), SAMPLES: (3, [samples]), PLANAR: (3, [1]),
                  PREDICTOR: (3, [predictor])}
        fields |= ({TILE_WIDTH: (4, [tile]), TILE_LENGTH: (4, [tile]), TILE_OFFSETS: (4, offsets), TILE_BYTES: (4, sizes)}
                   if tile else {STRIP_OFFSETS: (4, offsets), ROWS_PER_STRIP: (4, [high]), STRIP_BYTES: (4, sizes)})
        entries = b""
        for tag, (kind, values) in sorted(fields.items()):
            data = struct.pack(f"{order}{len(values)}{FIELD[kind][1]}", *values)
            if len(data) > 4:
                at = len(out)
                out += data + b"\0" * (len(data) & 1)
                data = struct.pack(f"{order}I", at)
            entries += struct.pack(f"{order}HHI", tag, kind, len(values)) + data.ljust(4, b"\0")
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    """Fields of the directory at a place, and the place of the next."""
    n, = struct.unpack_from(f"{order}H", data, at)
    fields = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        if kind not in FIELD:
            continue
        size, code = FIELD[kind]
        place = at + 10 + 12 * k
        if size * count > 4:
            place, = struct.unpack_from(f"{order}I", data, place)
        if place + size * count > len(data):
            raise ValueError(f"tag {tag} points beyond the file")
        fields[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
    return fields, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, f: dict[int, tuple], order: str) -> np.ndarray:
    """Samples of one page (rows, columns, samples)."""
    one = lambda tag, default=None: f[tag][0] if tag in f else default
    columns, rows, samples = f[WIDTH][0], f[LENGTH][0], one(SAMPLES, 1)
    bits = set(f.get(BITS, (1,)))
    if bits not in ({8}, {16}) or one(FILL_ORDER, 1) != 1 or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError("only 8- and 16-bit samples, plain or with horizontal differencing")
    kind = np.dtype(f"u{bits.pop() // 8}").newbyteorder(order)
    tiled = TILE_OFFSETS in f
    wide, high = (f[TILE_WIDTH][0], f[TILE_LENGTH][0]) if tiled else (columns, min(one(ROWS_PER_STRIP, rows), rows))
    offsets, sizes = (f[TILE_OFFSETS], f[TILE_BYTES]) if tiled else (f[STRIP_OFFSETS], f[STRIP_BYTES])
    planes = samples if one(PLANAR, 1) == 2 else 1
    each = samples // planes
    out = np.zeros((rows, columns, samples), kind.newbyteorder("="))
    grid = [(plane, y, x) for plane in range(planes) for y in range(0, rows, max(1, high))
            for x in range(0, columns, max(1, wide))]
    if len(grid) != len(offsets) or len(sizes) != len(offsets):
        raise ValueError("number of strips or tiles does not fit the page")
    for (plane, y, x), at, size in zip(grid, offsets, sizes):
        if at + size > len(data):
            raise ValueError("a strip or tile lies beyond the file")
        lines = high if tiled else min(high, rows - y)
        raw = decompress(data[at:at + size], one(COMPRESSION, NONE))
        need = lines * wide * each * kind.itemsize
        if len(raw) < need:
            raise ValueError("a strip or tile is too short")
        part = np.frombuffer(raw[:need], kind).reshape(lines, wide, each).astype(kind.newbyteorder("="))
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype)
        out[y:y + lines, x:x + wide, plane * each:plane * each + each] = part[:rows - y, :columns - x]
    return out


def read(data: bytes) -> Iterator[tuple[dict[int, tuple], np.ndarray | None, str | None]]:
    """(fields, samples, error) of each page; a broken directory ends the file with an error row."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4]))
    if order is None or len(data) < 8:
        yield {}, None, "not a TIFF file"
        return
    at, seen = struct.unpack_from(f"{order}I", data, 4)[0], set()
    while at:
        if at in seen or len(seen) >= PAGES:
            yield {}, None, "the chain of directories has no end"
            return
        seen.add(at)
        try:
            fields, following = _directory(data, at, order)
        except (struct.error, ValueError) as broken:
            yield {}, None, f"broken directory: {broken}"
            return
        try:
            yield fields, _page(data, fields, order), None
        except (KeyError, ValueError, zlib.error, IndexError) as broken:
            yield fields, None, f"broken page: {broken}"
        at = following


def feature(samples: np.ndarray) -> str:
    """Size, mean, spread and a 64-bit sketch: which of 64 column bands are brighter than the page."""
    flat = samples.reshape(samples.shape[0], -1)
    if not flat.size:
        return "0x0"
    bands = [b.mean() if b.size else 0.0 for b in np.array_split(flat.sum(axis=0, dtype=np.int64) / len(flat), 64)]
    bits = "".join("1" if b > flat.mean() else "0" for b in bands)
    return f"{samples.shape[1]}x{samples.shape[0]}x{samples.shape[2]};{flat.mean():.3f};{flat.std():.3f};{int(bits, 2):016x}"


_PAGE = ("page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, "
         "feature string, error string")


def pages(files: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """One row per page of each file: key, page (from 0), its sizes, pixels in row order and native byte order, feature.

    A null or empty file, one that is no TIFF file and a broken directory give one row with `error` and null pixels; a
    broken page gives such a row and the walk goes on. Other columns are not read; repeated files give repeated rows.
    """
    names = [n.split()[0] for n in _PAGE.split(", ")]

    def rows(data):
        for number, (f, samples, error) in enumerate(read(data or b"")):
            one = lambda tag: int(f[tag][0]) if tag in f and f[tag] else None
            yield (number, one(WIDTH), one(LENGTH), one(SAMPLES) or (1 if f else None), one(BITS),
                   one(COMPRESSION) or (NONE if f else None), one(PREDICTOR) or (1 if f else None),
                   None if samples is None else samples.tobytes(), None if samples is None else feature(samples), error)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] * 7 + [pa.binary(), pa.string(), pa.string()]
        for batch in batches:
            keys, made = [], []
            for at, data in enumerate(batch.column(1).to_pylist()):
                for row in rows(data):
                    keys.append(at)
                    made.append(row)
            columns = [pa.array([r[i] for r in made], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *columns], [key, *names])

    kind = files.schema[key].dataType.simpleString()
    return common.map_arrow(files.select(key, F.col(media).cast("binary").alias("media")), work, f"{key} {kind}, {_PAGE}")


def from_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's UTF-8, zero-padded to a positive multiple of 64, as the 8-bit samples
    of a page 64 wide: deflate strips with horizontal differencing. Null texts count as empty."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for raw in batch.column(1).to_pylist():
                raw = raw.ljust(max(SIDE, -(-len(raw) // SIDE) * SIDE), b"\0")
                files.append(write([np.frombuffer(raw, np.uint8).reshape(-1, SIDE)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(files, pa.binary())],
                                             ["doc_id", "n_bytes", "media"])

    raw = common.text_bytes(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), raw.alias("raw"),
                       F.octet_length(raw).cast("long").alias("n_bytes"))
    return common.map_arrow(rows, work, "doc_id long, n_bytes long, media binary")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts stored as files and read back: sizes, checksums and features per document; equal texts, equal values."""
    stored = from_texts(docs, doc_id, text).withColumn("key", F.struct(
        "doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256")))
    back = pages(stored, "media", "key")
    return back.select(
        "key.doc_id", "key.n_bytes", F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(F.expr("substring(pixels, -64, 64)")).alias("tail_crc32"),
        "key.media_bytes", "key.media_sha256", "feature")
