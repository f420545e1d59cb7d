"""GIF media columns: texts stored losslessly as indexed images, read back by a GIF decoder, with timed frames and
colour-histogram columns.

Writing: the payload becomes frames of 64 columns and at most 64 rows, one 8-bit sample a pixel, under a palette of 256
colours; each frame's samples are an LZW code stream whose table grows up to 4096 entries. Byte 0 is the transparent
colour, and the frames take the three disposal methods in turn. Reading is general: code streams of any width with
deferred clears, global and local palettes, interlacing, transparency, the four disposal methods, delays. The codes of a
stream are cut apart by whole-array operations, since their widths follow from their places after the last clear; the
table is then walked code by code.

`decode_media` takes any GIFs; each frame has its start and delay in hundredths of a second, the number of its pixels
that are seen, and their histogram: BINS equal ranges of red, then of green, then of blue. `store_texts` gives the same
frames of the GIFs that it writes, and a feature string made from them.

Null text: as an empty one. The payload is the UTF-8 text and bytes 0 up to a positive multiple of 64. Equal texts give
equal values. Null media: no frames. Rows that repeat stay; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_texts, read_table

WIDTH, ROWS, DELAY = 64, 64, 4
KEEP, LEAVE, BACKGROUND, PREVIOUS = range(4)
BINS = 8
LARGEST = 4096
_ALL = np.arange(256)
#: A palette of 256 different colours: odd multiples of the sample.
PALETTE = np.stack([_ALL * 73 % 256, _ALL * 151 % 256, _ALL * 29 % 256], 1).astype(np.uint8)
FRAMES = "array<struct<start: long, delay: int, pixels: long, histogram: array<long>>>"


@functools.cache
def _first_widths(bits: int) -> np.ndarray:
    """The widths of the first codes after a clear: the table has grown by all but the first. Later ones stay as the last."""
    grown = np.minimum((1 << bits) + 1 + np.arange(2 * LARGEST), LARGEST - 1)
    return np.maximum(bits + 1, np.frexp(grown.astype(np.float64))[1]).astype(np.int64)


def _widths(n: int, bits: int, begin: int = 0) -> np.ndarray:
    """The width of each of n <= LARGEST + 1 codes after a clear, from number `begin` on."""
    begin = min(begin, LARGEST - 1)
    return _first_widths(bits)[begin : begin + n]


@functools.cache
def _roots(bits: int) -> tuple[bytes, ...]:
    return (*[bytes([i]) for i in range(1 << bits)], b"", b"")


def lzw_encode(samples: bytes, bits: int = 8) -> bytes:
    """The code stream of samples: a clear, codes from a growing table, a clear whenever it is full, a stop."""
    clear = 1 << bits
    runs: list[list[int]] = []
    table: dict[int, int] = {}
    get, codes, entry = table.get, [], clear + 2
    prefix = -1
    for c in samples:
        key = prefix << 8 | c
        code = get(key)
        if code is not None:
            prefix = code
            continue
        if prefix < 0:
            prefix = c
            continue
        codes.append(prefix)
        prefix = c
        if entry < LARGEST:
            table[key] = entry
            entry += 1
        else:
            runs.append(codes)
            table.clear()
            codes, entry = [], clear + 2
    if prefix >= 0:
        codes.append(prefix)
    runs.append(codes)
    values, widths, width = [], [], bits + 1
    for codes in runs:
        own = _widths(len(codes) + 1, bits)
        values.append([clear, *codes])
        widths.append([width, *own[:-1].tolist()])
        width = int(own[-1])
    values.append([clear + 1])
    widths.append([width])
    return _packed(np.concatenate(values), np.concatenate(widths))


def _packed(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes laid end to end, low bits first."""
    ends = np.cumsum(widths)
    at = ends - widths
    moved, total = values.astype(np.int64) << (at & 7), int(-(-ends[-1] // 8))
    out = np.zeros(total + 2, np.int64)
    for k in range(3):  # bits of different codes never meet, so sums are unions
        out += np.bincount((at >> 3) + k, moved >> (8 * k) & 255, total + 2).astype(np.int64)
    return out[:total].astype(np.uint8).tobytes()


def _blocks(data: bytes) -> bytes:
    """Data sub-blocks of at most 255 bytes, each after its length, and the closing empty one."""
    whole = len(data) // 255
    head = np.empty((whole, 256), np.uint8)
    head[:, 0] = 255
    head[:, 1:] = np.frombuffer(data, np.uint8)[: whole * 255].reshape(whole, 255)
    rest = data[whole * 255 :]
    return head.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(payload: bytes) -> bytes:
    """A GIF whose samples, frame after frame, are the payload's bytes; its length must be a multiple of WIDTH."""
    size = WIDTH * ROWS
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(ROWS, len(payload) // WIDTH), 0xF7, 0, 0), PALETTE.tobytes()]
    for number, begin in enumerate(range(0, len(payload), size)):
        part = payload[begin : begin + size]
        disposal = (LEAVE, BACKGROUND, PREVIOUS)[number % 3]
        control = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | 1, DELAY, 0, 0)
        out += [control, struct.pack("<BHHHHB", 0x2C, 0, 0, WIDTH, len(part) // WIDTH, 0), b"\x08", _blocks(lzw_encode(part))]
    return b"".join([*out, b";"])


def _codes(raw: np.ndarray, at: int, bits: int, begin: int, most: int) -> tuple[list[int], int]:
    """The codes from bit `at` on, of numbers begin, begin + 1, ... after a clear, and the bit after the last; up to the
    first clear or stop, at most `most`."""
    widths = _widths(most, bits, begin)
    ends = at + np.cumsum(widths)
    n = int(np.searchsorted(ends, (len(raw) - 3) * 8, "right"))
    widths, ends = widths[:n], ends[:n]
    place = ends - widths
    first = place >> 3
    values = (raw[first] | raw[first + 1] << 8 | raw[first + 2] << 16) >> (place & 7) & ((1 << widths) - 1)
    special = np.flatnonzero((values == 1 << bits) | (values == (1 << bits) + 1))
    if len(special):
        n = int(special[0]) + 1
    return values[:n].tolist(), int(ends[n - 1]) if n else at


def lzw_decode(data: bytes, bits: int, pixels: int) -> np.ndarray:
    """The samples of a code stream: at most `pixels`, the missing ones 0."""
    clear, stop = 1 << bits, (1 << bits) + 1
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.int64)
    table, last, number, at = list(_roots(bits)), b"", 0, 0
    out, made = [], 0
    while made < pixels:
        codes, at = _codes(raw, at, bits, number, min(LARGEST, pixels - made + 2))
        if not codes:
            break
        ended = codes[-1] if codes[-1] in (clear, stop) else None
        begin = len(out)
        for code in codes if ended is None else codes[:-1]:
            try:
                entry = table[code]
            except IndexError:
                if not last:
                    raise ValueError("a code before its table entry") from None
                entry = last + last[:1]
            if last and len(table) < LARGEST:
                table.append(last + entry[:1])
            out.append(entry)
            last = entry
        made += sum(map(len, out[begin:]))
        number += len(codes)
        if ended == stop:
            break
        if ended == clear:
            table, last, number = list(_roots(bits)), b"", 0
    samples = np.frombuffer(b"".join(out)[:pixels], np.uint8)
    return np.concatenate([samples, np.zeros(pixels - len(samples), np.uint8)])


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    samples: np.ndarray


@dataclass
class Image:
    width: int
    height: int
    background: int
    frames: list[Frame] = field(default_factory=list)

    def canvases(self) -> Iterator[tuple[np.ndarray, int]]:
        """(height x width x 4 colours with alpha, delay) of each frame as shown."""
        canvas = np.zeros((self.height, self.width, 4), np.uint8)
        for f in self.frames:
            before = canvas.copy() if f.disposal == PREVIOUS else None
            high, wide = max(0, min(f.height, self.height - f.top)), max(0, min(f.width, self.width - f.left))
            index = f.samples[:high, :wide]
            colours = np.full((high, wide, 4), 255, np.uint8)
            colours[..., :3] = f.palette[np.minimum(index, len(f.palette) - 1)]
            place = canvas[f.top : f.top + high, f.left : f.left + wide]
            place[:] = colours if f.transparent is None else np.where((index == f.transparent)[..., None], place, colours)
            yield canvas.copy(), f.delay
            if f.disposal == BACKGROUND:
                place[:] = 0
            elif before is not None:
                canvas = before


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while n := data[at]:
        out.append(data[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(out), at + 1


def decode(data: bytes) -> Image:
    """The frames of a GIF."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, np.zeros((0, 3), np.uint8)
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared, at = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3), at + n * 3
    image, control = Image(width, height, background), (0, 0, None)
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9:
                packed, delay, transparent = struct.unpack_from("<BHB", body)
                control = (packed >> 2 & 7, delay, transparent if packed & 1 else None)
            continue
        if data[at] != 0x2C:
            raise ValueError("an unknown block")
        left, top, wide, high, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at, palette = at + 10, shared
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette, at = np.frombuffer(data, np.uint8, n * 3, at).reshape(n, 3), at + n * 3
        bits = data[at]
        body, at = _sub_blocks(data, at + 1)
        rows = lzw_decode(body, bits, wide * high).reshape(high, wide)
        if flags & 0x40:  # the four passes of an interlaced image
            order = np.concatenate([np.arange(a, high, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(rows)
            straight[order] = rows
            rows = straight
        disposal, delay, transparent = control
        image.frames.append(Frame(left, top, wide, high, delay, min(disposal, 3), transparent, palette, rows))
        control = (0, 0, None)
    return image


def frame_features(image: Image) -> list[dict]:
    """Of each frame as shown: start and delay, the number of pixels that are seen and their histogram."""
    out, start = [], 0
    for canvas, delay in image.canvases():
        seen = canvas[canvas[..., 3] > 0][:, :3]
        bins = (seen >> 5) + np.arange(0, 3 * BINS, BINS, dtype=np.uint8)
        out.append({"start": start, "delay": delay, "pixels": len(seen), "histogram": np.bincount(bins.ravel(), minlength=3 * BINS).tolist()})
        start += delay
    return out


def _frame_type():
    import pyarrow as pa

    return pa.list_(pa.struct([("start", pa.int64()), ("delay", pa.int32()), ("pixels", pa.int64()), ("histogram", pa.list_(pa.int64()))]))


def decode_media(media: DataFrame, id_column: str = "id", media_column: str = "media") -> DataFrame:
    """id, width, height and frames of each GIF of media(id, media)."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                image = decode(data.as_py()) if data.is_valid else Image(0, 0, 0)
                columns = [pa.array([key], pa.int64()), pa.array([image.width], pa.int32()), pa.array([image.height], pa.int32()), pa.array([frame_features(image)], _frame_type())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "width", "height", "frames"])

    picked = media.select(media[id_column].cast("long").alias("id"), media[media_column].alias("media"))
    return picked.mapInArrow(run, f"id long, width int, height int, frames {FRAMES}")


def feature_of(image: Image, frames: list[dict]) -> str:
    """One line on an image's frames: their number, size, time, pixels seen and summed histogram."""
    total = np.sum([f["histogram"] for f in frames], axis=0).tolist()
    time = frames[-1]["start"] + frames[-1]["delay"]
    return f"frames={len(frames)};size={image.width}x{image.height};time={time};seen={sum(f['pixels'] for f in frames)};hist={','.join(map(str, total))}"


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\0" * (-len(raw) % 64 if raw else 64)


def store_texts(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Each text of docs(doc_id, text) stored as a GIF, read back and described; keep_media adds the GIF itself."""
    import pyarrow as pa

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), _frame_type()]
    names, types = names + ["media"] * keep_media, types + [pa.binary()] * keep_media

    def run(batches: Iterator) -> Iterator:
        for keys, texts in arrow_texts(batches):
            rows = []
            for key, text in zip(keys, texts, strict=True):
                n, payload = payload_of(text)
                media = encode(payload)
                image = decode(media)
                back = b"".join(f.samples.tobytes() for f in image.frames)
                frames = frame_features(image)
                digests = (hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest())
                rows.append((key, n, len(back), *digests, feature_of(image, frames), frames) + ((media,) if keep_media else ()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    schema += f", feature string, frames {FRAMES}" + ", media binary" * keep_media
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, schema)


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(read_table(spark, sf_dir, "documents"))
