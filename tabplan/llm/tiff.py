"""TIFF: a reader that walks image directories and emits one row per page, and a small writer."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, slices, without

# Fixed values of the TIFF 6.0 specification and its supplements: tags, compressions, bytes per field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
FILL_ORDER = 266
COMPRESSIONS = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits"}
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "c", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}

#: Bytes with their bits the other way round, for FILL_ORDER 2.
_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class TiffError(ValueError):
    pass


#: What a file or page that can't be decoded raises.
FAULTS = (TiffError, struct.error, zlib.error, ValueError, OverflowError, MemoryError)
#: Bytes that a value of a row, and so a page, can't reach.
ROW_LIMIT = 1 << 31


class Page(NamedTuple):
    page: int
    width: int
    height: int
    samples: int
    bits: int
    compression: str
    predictor: int
    tiled: bool
    pixels: bytes  # rows from the top, samples side by side, little-endian; a byte each for samples of under 8 bits


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at, end, made = [], 0, len(data), 0
    while at < end and made < size:
        n = data[at]
        at += 1
        if n < 128:
            out.append(data[at : at + n + 1])
            at += n + 1
        elif n > 128:
            out.append(data[at : at + 1] * (257 - n))
            at += 1
        else:
            continue
        made += len(out[-1])
    return b"".join(out)


def pack_bits(row: bytes) -> bytes:
    """Runs of three or more as runs, the rest as literals of up to 128 bytes."""
    out, at, literal = bytearray(), 0, 0

    def put(upto: int) -> None:
        for k in range(literal, upto, 128):
            part = row[k : min(upto, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    while at < len(row):
        run = 1
        while run < 128 and at + run < len(row) and row[at + run] == row[at]:
            run += 1
        if run >= 3:
            put(at)
            out.extend((257 - run, row[at]))
            literal = at + run
        at += run
    put(len(row))
    return bytes(out)


_CLEAR, _END = 256, 257


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits that grow one code early."""
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    known, width, last = list(start), 9, b""
    out, made, held, bits = [], 0, 0, 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == _CLEAR:
            known, width, last = list(start), 9, b""
            continue
        if code == _END or made >= size:
            break
        if not last:
            if code >= 256:
                raise TiffError("LZW: no literal after a clear code")
            text = known[code]
        else:
            if code < len(known):
                text = known[code]
            elif code == len(known):
                text = last + last[:1]
            else:
                raise TiffError("LZW: a code ahead of the table")
            if len(known) < 4096:
                known.append(last + text[:1])
        out.append(text)
        made += len(text)
        last = text
        if len(known) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    table: dict[bytes, int] = {}
    out, held, bits, width, following = bytearray(), 0, 0, 9, 258

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(_CLEAR)
    now = b""
    for i in range(len(data)):
        more = now + data[i : i + 1]
        if len(more) == 1 or more in table:
            now = more
            continue
        put(table[now] if len(now) > 1 else now[0])
        table[more] = following
        following += 1
        if following == 4094:
            put(_CLEAR)
            table, width, following = {}, 9, 258
        elif following + 1 > 1 << width:
            width += 1
        now = data[i : i + 1]
    if now:
        put(table[now] if len(now) > 1 else now[0])
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    put(_END)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def _unpack(raw: bytes, compression: int, size: int) -> bytes:
    if compression == 1:
        out = raw
    elif compression in (8, 32946):
        out = zlib.decompressobj().decompress(raw, size)
    elif compression == 5:
        out = unpack_lzw(raw, size)
    elif compression == 32773:
        out = unpack_bits(raw, size)
    else:
        raise TiffError(f"compression {compression} is not supported")
    if len(out) < size:
        raise TiffError(f"{len(out)} of {size} bytes in a strip or tile")
    return out[:size]


def _spread(block: bytes, bits: int, height: int, width: int, samples: int) -> np.ndarray:
    """An array (height, width, samples) of samples of 1, 2 or 4 bits, whose rows begin with a byte, the highest bits first."""
    rows = np.frombuffer(block, np.uint8).reshape(height, -1, 1)
    found = rows >> np.arange(8 - bits, -1, -bits, dtype=np.uint8) & np.uint8((1 << bits) - 1)
    return found.reshape(height, -1)[:, : width * samples].reshape(height, width, samples)


def _undo_predictor(block: bytes, predictor: int, height: int, width: int, samples: int, dtype: np.dtype) -> np.ndarray:
    """An array (height, width, samples) in native order."""
    if predictor == 3:
        # rows hold the bytes of all samples by significance, differenced with a step of `samples`
        flat = np.frombuffer(block, np.uint8).reshape(height, -1, samples)
        flat = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(height, dtype.itemsize, width * samples)
        return np.ascontiguousarray(flat.transpose(0, 2, 1)).view(dtype.newbyteorder(">")).reshape(height, width, samples).astype(dtype.newbyteorder("<"))
    found = np.frombuffer(block, dtype).reshape(height, width, samples)
    if predictor == 1:
        return found.astype(dtype.newbyteorder("<"), copy=False)
    if predictor != 2 or dtype.kind == "f":
        raise TiffError(f"predictor {predictor} is not supported here")
    return np.cumsum(found, axis=1, dtype=dtype.newbyteorder("="))


class _Reader:
    def __init__(self, data: bytes):
        self.data = data
        if data[:2] not in (b"II", b"MM"):
            raise TiffError("no byte order mark")
        self.order = "<" if data[:2] == b"II" else ">"
        version = self._read("H", 2)[0]
        if version not in (42, 43):
            raise TiffError(f"version {version}")
        self.big = version == 43
        self.first = self._read("Q", 8)[0] if self.big else self._read("I", 4)[0]

    def _read(self, form: str, at: int, count: int = 1) -> tuple:
        form = f"{self.order}{form * count if len(form) > 1 else f'{count}{form}'}"
        if at < 0 or at + struct.calcsize(form) > len(self.data):
            raise TiffError("an offset is outside the file")
        return struct.unpack_from(form, self.data, at)

    def directories(self) -> Iterator[dict[int, tuple] | Exception]:
        """Each directory's fields, or what is wrong with them where the next one can be found nonetheless."""
        at, seen = self.first, set()
        while at:
            if at in seen:
                raise TiffError("directories form a loop")
            seen.add(at)
            count, at = (self._read("Q", at)[0], at + 8) if self.big else (self._read("H", at)[0], at + 2)
            step, inline, place = (20, 8, "Q") if self.big else (12, 4, "I")
            try:
                tags = self._fields(range(at, at + count * step, step), inline, place)
            except FAULTS as e:
                self._read(place, at + count * step)
                tags = e
            yield tags
            at = self._read(place, at + count * step)[0]

    def _fields(self, entries: range, inline: int, place: str) -> dict[int, tuple]:
        tags = {}
        for k in entries:
            tag, kind = self._read("H", k, 2)
            n = self._read(place, k + 4)[0]
            form = TYPES.get(kind)
            if form is None:
                continue  # fields of unknown types are to be passed over
            if n > len(self.data):
                raise TiffError("a field is longer than the file")
            value = k + entries.step - inline
            if struct.calcsize(f"={form}") * n > inline:
                value = self._read(place, value)[0]
            tags[tag] = self._read(form, value, n) if n else ()
        return tags

    def page(self, number: int, tags: dict[int, tuple] | Exception) -> Page:
        if isinstance(tags, Exception):
            raise tags

        def one(tag: int, default: Any = None) -> Any:
            got = tags.get(tag) or ((default,) if default is not None else None)
            if got is None:
                raise TiffError(f"tag {tag} is missing")
            if not all(isinstance(x, int) and x >= 0 for x in got):
                raise TiffError(f"tag {tag} holds what is no count")
            return got[0]

        width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        bits, compression, predictor, planes = one(BITS, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
        kind = {1: "u", 2: "i", 3: "f"}.get(one(SAMPLE_FORMAT, 1))
        narrow = bits in (1, 2, 4)
        if kind is None or not narrow and bits not in (8, 16, 32, 64) or len({*tags.get(BITS, (bits,))}) > 1 or kind == "f" and bits == 8 or narrow and kind != "u":
            raise TiffError(f"samples of {tags.get(BITS, (1,))} bits are not supported")
        if narrow and predictor != 1:
            raise TiffError(f"predictor {predictor} is not supported here")
        dtype = np.dtype(f"{self.order}{kind}{-(-bits // 8)}")
        tiled = TILE_OFFSETS in tags
        across, down = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
        offsets, counts = tags.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()), tags.get(TILE_COUNTS if tiled else STRIP_COUNTS, ())
        if not (width and height and across and down and samples):
            raise TiffError("an empty image")
        columns, rows = -(-width // across), -(-height // down)
        apart, tall = planes == 2, down
        if len(offsets) < columns * rows * (samples if apart else 1) or len(counts) < len(offsets):
            raise TiffError("strips or tiles are missing")
        if not all(isinstance(x, int) and x >= 0 for x in (*offsets, *counts)):
            raise TiffError("places of strips or tiles are no counts")
        if max(width * height * samples, tall * across * (1 if apart else samples)) * dtype.itemsize >= ROW_LIMIT:
            raise TiffError(f"{width} x {height} x {samples} samples of {bits} bits are more than a row can hold")
        image = np.empty((height, width, samples), dtype.newbyteorder("<"))
        for i in range(columns * rows * (samples if apart else 1)):
            plane, place = divmod(i, columns * rows)
            top, left = place // columns * down, place % columns * across
            tall, deep = down if tiled else min(down, height - top), 1 if apart else samples
            if offsets[i] + counts[i] > len(self.data):
                raise TiffError("a strip or tile is outside the file")
            raw = self.data[offsets[i] : offsets[i] + counts[i]]
            if narrow:
                raw = raw.translate(_REVERSED) if one(FILL_ORDER, 1) == 2 else raw
                block = _spread(_unpack(raw, compression, tall * -(-across * deep * bits // 8)), bits, tall, across, deep)
            else:
                block = _undo_predictor(_unpack(raw, compression, tall * across * deep * dtype.itemsize), predictor, tall, across, deep, dtype)
            part = image[top : top + tall, left : left + across, plane : plane + 1] if apart else image[top : top + tall, left : left + across]
            part[...] = block[: part.shape[0], : part.shape[1]]
        return Page(number, width, height, samples, bits, COMPRESSIONS[compression], predictor, tiled, image.tobytes())


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF or BigTIFF file in the order of its directories; TiffError where it isn't one."""
    reader = _Reader(data)
    for number, tags in enumerate(reader.directories()):
        yield reader.page(number, tags)


def pages_or_faults(data: bytes) -> Iterator[Page | str]:
    """As read_pages, with what is wrong in the place of a page that can't be decoded, and last where the walk can't go on."""
    try:
        reader = _Reader(data)
        for number, tags in enumerate(reader.directories()):
            try:
                found = reader.page(number, tags)
            except FAULTS as e:
                found = f"page {number}: {e}"
            yield found
    except FAULTS as e:
        yield str(e)


def write_tiff(pages: list[np.ndarray], compression: str = "deflate", predictor: int = 2, rows: int = 1024, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file of grey (height, width) or (height, width, samples) pages of 8- or 16-bit samples."""
    code = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}[compression]
    out, link = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0)), 4
    for image in pages:
        image = image[:, :, None] if image.ndim == 2 else image
        height, width, samples = image.shape
        dtype = image.dtype.newbyteorder(order)
        down, across = tile or (min(rows, height), width)
        blocks = []
        for top in range(0, height, down):
            for left in range(0, width, across):
                block = image[top : top + down, left : left + across]
                if tile:
                    block = np.pad(block, ((0, down - block.shape[0]), (0, across - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                lines = np.ascontiguousarray(block.astype(dtype))
                raw = lines.tobytes()
                if code == 32773:
                    raw = b"".join(pack_bits(line.tobytes()) for line in lines)
                blocks.append({1: bytes, 5: pack_lzw, 8: lambda x: zlib.compress(x, 1), 32773: bytes}[code](raw))
        offsets = []
        for block in blocks:
            offsets.append(len(out))
            out += block + b"\0" * (len(block) % 2)
        lengths = [len(b) for b in blocks]
        fields = [(WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [image.dtype.itemsize * 8] * samples), (COMPRESSION, "H", [code]), (PHOTOMETRIC, "H", [1]), (SAMPLES, "H", [samples]), (PLANAR, "H", [1]), (PREDICTOR, "H", [predictor])]
        fields += [(TILE_WIDTH, "I", [across]), (TILE_HEIGHT, "I", [down]), (TILE_OFFSETS, "I", offsets), (TILE_COUNTS, "I", lengths)] if tile else [(STRIP_OFFSETS, "I", offsets), (ROWS_PER_STRIP, "I", [down]), (STRIP_COUNTS, "I", lengths)]
        fields.sort()
        entries = bytearray(struct.pack(f"{order}H", len(fields)))
        for tag, form, values in fields:
            packed = struct.pack(f"{order}{len(values)}{form}", *values)
            if len(packed) > 4:
                place = len(out)
                out += packed + b"\0" * (len(packed) % 2)
                packed = struct.pack(f"{order}I", place)
            entries += struct.pack(f"{order}HHI", tag, {"H": 3, "I": 4}[form], len(values)) + packed.ljust(4, b"\0")
        struct.pack_into(f"{order}I", out, link, len(out))
        link = len(out) + len(entries)
        out += entries + b"\0\0\0\0"
    return bytes(out)


#: Samples in a row of a stored text.
COLUMNS = 64


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) of each row of docs: its whole text as a TIFF file of one grey page.

    The text's UTF-8 bytes, with zeros up to a positive multiple of 64, are the samples, 64 to
    a row, in deflated strips with the horizontal predictor; null counts as empty. Equal texts
    make equal files, repeated rows as many rows, an empty table none. Other columns of docs
    play no part.
    """
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows(schema)
        for part in slices(batches):
            for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                raw = (text or "").encode()
                image = np.frombuffer(raw + bytes(-len(raw) % COLUMNS or (0 if raw else COLUMNS)), np.uint8).reshape(-1, COLUMNS)
                media = write_tiff([image])
                if out.add((name, len(raw), media), len(media)):
                    yield from out.flush()
        yield from out.flush()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_bytes long, media binary")


def tiff_pages(files: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page of each file: the other columns of files, the media, and the page's.

    page counts from 0; pixels are the decoded samples, rows from the top, little-endian;
    mean is that of the samples as unsigned integers. A page that can't be decoded gives a row in its place with
    its number and the reason in `error` and null in the rest, and the walk goes on, also after fields of a wrong
    type and after a page of 2 GB and more, which no row can hold; a file whose directories can't be
    walked further, null and empty ones too, gives such a row after those of its pages. Columns of files
    that bear a name of a page's column, in any case, are replaced. An empty table gives an
    empty one.
    """
    made = [("page", "int"), ("width", "long"), ("height", "long"), ("samples", "int"), ("bits", "int"), ("compression", "string"), ("predictor", "int"), ("tiled", "boolean"), ("pixels", "binary"), ("mean", "double"), ("error", "string")]
    kept = files.select(*without(files, *(n for n, _ in made if n.lower() != media_col.lower())))
    place = [c.lower() for c in kept.columns].index(media_col.lower())
    empty = kept.limit(0).select("*", *(F.lit(None).cast(t).alias(n) for n, t in made))
    names = [n for n, _ in made]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 32):
            at: list[int] = []
            out = Rows(pa.schema(list(zip(names, kinds, strict=True))))

            def give(part: pa.RecordBatch = part, at: list[int] = at, out: Rows = out) -> Iterator[pa.RecordBatch]:
                for found in out.flush():
                    source = part.take(pa.array(at, pa.int64()))
                    at.clear()
                    yield pa.RecordBatch.from_arrays([*source.columns, *found.columns], names=[*part.schema.names, *names])

            for i, media in enumerate(part.column(place)):
                for p in pages_or_faults(media.as_py() or b""):
                    at.append(i)
                    if isinstance(p, str):
                        full = out.add((*[None] * 10, p))
                    else:
                        form = np.uint8 if p.bits <= 8 else np.dtype(f"<u{p.bits // 8}")
                        full = out.add((*p, float(np.frombuffer(p.pixels, form).mean()), None), 2 * len(p.pixels))
                    if full:
                        yield from give()
            yield from give()

    return kept.mapInArrow(run, empty.schema)
