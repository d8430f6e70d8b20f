"""GIF media columns: timed frames with colour histograms.

Each row's bytes are decoded in one narrow pass: blocks are parsed, LZW code
streams decoded, palettes applied, interlaced rows put in place, and frames
drawn on the canvas under the rules of transparency and disposal.

A canvas is drawn and stored in stripes: runs of its lines with ``stripe_pixels``
pixels at most, a line at least. A frame has a row for each stripe, with its first
line (``top``), its number of lines (``lines``), the pixels as they are shown, 4 bytes (red,
green, blue, alpha) each, and a histogram of ``levels`` ** 3 colours of the opaque
ones; a canvas that is no larger than a stripe has one row a frame. A stripe
without an opaque pixel has null pixels. So no size is refused: what a task holds
is one stripe, whatever the header says, and a large canvas costs a
decoding of its streams for each stripe.

Rules: disposal 2 clears the frame's rectangle to transparent, 3 restores what
lay below it, all others leave it. Frames are cut to the canvas. A delay of n
means n / 100 seconds. A frame without a palette of its own or a global one is drawn in
shades of grey. Indexes beyond the palette are transparent.

Defined cases: null bytes, bytes that aren't GIF, and files without a frame give one row with frame
null and the reason in ``error``. A file that breaks off gives its frames up to there, what's
missing of the last being transparent, and ``error`` in the rows of the last frame. A frame whose
stream ends early or is no code stream (roots have 1 to 8 bits) is as
transparent where nothing came, and its rows say "frame broken". A canvas without
pixels has one stripe without lines. Repeated rows are decoded one by one. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRIPE_PIXELS = 1 << 22
FRAMES = "frame int, start_ms bigint, delay_ms int, width int, height int, disposal int, top int, lines int, pixels binary, histogram array<int>, n_transparent int, error string"
BATCH_FRAME_BYTES = 16 << 20
PART_BYTES = 1 << 18


def lzw_parts(data: bytes, root: int, most: int) -> Iterator[bytes]:
    """At most ``most`` palette indexes of a code stream whose roots have ``root`` bits, in parts; stops quietly where it's broken."""
    if not 1 <= root <= 8:
        return
    clear, end = 1 << root, (1 << root) + 1
    roots = [bytes((i,)) for i in range(clear)] + [b"", b""]
    table, width, before = roots[:], root + 1, b""
    out, held_back, left = [], 0, most
    acc = held = 0
    limit = 1 << width
    for byte in data:
        acc |= byte << held
        held += 8
        while held >= width:
            code = acc & (limit - 1)
            acc >>= width
            held -= width
            if code == clear:
                table, width, before = roots[:], root + 1, b""
                limit = 1 << width
                continue
            now = b""
            if code < len(table):
                now = table[code]
                if before and now and len(table) < 4096:
                    table.append(before + now[:1])
            elif code == len(table) and before and code < 4096:
                now = before + before[:1]
                table.append(now)
            if not now:  # the end, or a code that means nothing yet
                yield b"".join(out)[:left]
                return
            if len(table) == limit and width < 12:
                width += 1
                limit <<= 1
            out.append(now)
            held_back += len(now)
            if held_back >= left:
                yield b"".join(out)[:left]
                return
            if held_back >= PART_BYTES:
                yield b"".join(out)
                left -= held_back
                out, held_back = [], 0
            before = now
    yield b"".join(out)[:left]


def lzw_decode(data: bytes, root: int, most: int) -> bytes:
    return b"".join(lzw_parts(data, root, most))


def lzw_encode(pixels: bytes, root: int) -> bytes:
    """The code stream of palette indexes."""
    clear, end = 1 << root, (1 << root) + 1
    roots = {bytes((i,)): i for i in range(clear)}
    table, width, following = dict(roots), root + 1, clear + 2
    acc, held = clear, width
    out = bytearray()
    now = b""

    def put(code: int) -> None:
        nonlocal acc, held
        acc |= code << held
        held += width
        while held >= 8:
            out.append(acc & 255)
            acc >>= 8
            held -= 8

    for value in pixels:
        one = bytes((value,))
        if now + one in table:
            now += one
            continue
        put(table[now])
        if following < 4096:
            table[now + one] = following
            if following == 1 << width:
                width += 1
            following += 1
        else:
            put(clear)
            table, width, following = dict(roots), root + 1, clear + 2
        now = one
    if now:
        put(table[now])
        if following == 1 << width and width < 12:
            width += 1
    put(end)
    if held:
        out.append(acc & 255)
    return bytes(out)


def _interlaced(height: int) -> np.ndarray:
    return np.concatenate([np.arange(a, height, step) for a, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise EOFError
        self.at += n
        return self.data[self.at - n : self.at]

    def blocks(self) -> tuple[bytes, bool]:
        """Sub-blocks as one, and whether they end as they should."""
        out = []
        while True:
            if self.at >= len(self.data):
                return b"".join(out), False
            n = self.data[self.at]
            part = self.data[self.at + 1 : self.at + 1 + n]
            self.at += 1 + n
            if not n:
                return b"".join(out), True
            out.append(part)
            if len(part) < n:
                return b"".join(out), False


GREY = bytes(v for i in range(256) for v in (i, i, i))


@lru_cache(maxsize=1024)
def _looks(palette: bytes, clear: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each index (256 stands for none): whether it is drawn, its pixel, its cell of the histogram."""
    colours = np.zeros((257, 4), np.uint8)
    n = len(palette) // 3
    colours[:n, :3] = np.frombuffer(palette, np.uint8).reshape(-1, 3)
    colours[:, 3] = 255
    drawn = np.arange(257) < n
    if clear >= 0:
        drawn[clear] = False
    level = colours[:, :3].astype(np.int64) * levels >> 8
    return drawn, colours.view("<u4").ravel(), ((level[:, 0] * levels + level[:, 1]) * levels + level[:, 2]).astype(np.uint16)


@dataclass
class _Image:
    x: int
    y: int
    w: int
    h: int
    interlaced: bool
    palette: bytes
    root: int
    body: bytes
    whole: bool
    delay: int
    disposal: int
    clear: int
    got: int = -1  # indexes that its stream has, once it was decoded to its end

    @property
    def broken(self) -> bool:
        return not self.whole or self.got < self.w * self.h

    def lines(self, low: int, high: int) -> np.ndarray:
        """Indexes of the lines ``low`` to ``high``; 256 where the stream has none."""
        out = np.full((high - low) * self.w, 256, np.uint16)
        if self.interlaced:
            lines = _interlaced(self.h)
            at = np.flatnonzero((lines >= low) & (lines < high))
            wanted = [(p * self.w, (p + 1) * self.w, (int(lines[p]) - low) * self.w) for p in at.tolist()]
        else:
            wanted = [(low * self.w, high * self.w, 0)] if high > low else []
        seen = k = 0
        for part in lzw_parts(self.body, self.root, self.w * self.h):
            upto = seen + len(part)
            while k < len(wanted) and wanted[k][0] < upto:
                first, last, to = wanted[k]
                a, b = max(first, seen), min(last, upto)
                out[to + a - first : to + b - first] = np.frombuffer(part, np.uint8, b - a, a - seen)
                if last > upto:
                    break
                k += 1
            seen = upto
            if k == len(wanted) and self.got >= 0:
                break  # its end is known already
        self.got = max(self.got, seen)
        return out.reshape(high - low, self.w)


def _parse(data: bytes) -> tuple[int | None, int | None, list[_Image], str | None]:
    """Width, height, images and what's wrong with a file."""
    reader = _Reader(data)
    reader.at = 6
    images: list[_Image] = []
    width = height = shared = None
    delay, disposal, clear = 0, 0, -1
    try:
        screen = reader.take(7)
        width, height = int.from_bytes(screen[:2], "little"), int.from_bytes(screen[2:4], "little")
        if screen[4] & 0x80:
            shared = reader.take(3 << (screen[4] & 7) + 1)
        while True:
            kind = reader.take(1)[0]
            if kind == 0x3B:
                return width, height, images, None
            if kind == 0x21:
                label = reader.take(1)[0]
                body, whole = reader.blocks()
                if label == 0xF9 and len(body) >= 4:
                    disposal = body[0] >> 2 & 7
                    delay = int.from_bytes(body[1:3], "little") * 10
                    clear = body[3] if body[0] & 1 else -1
                elif label == 0x01:
                    delay, disposal, clear = 0, 0, -1
                if not whole:
                    raise EOFError
                continue
            if kind != 0x2C:
                return width, height, images, "unknown block"
            place = reader.take(9)
            x, y, w, h = (int.from_bytes(place[i : i + 2], "little") for i in (0, 2, 4, 6))
            palette = reader.take(3 << (place[8] & 7) + 1) if place[8] & 0x80 else shared or GREY
            root = reader.take(1)[0]
            body, whole = reader.blocks()
            images.append(_Image(x, y, w, h, bool(place[8] & 0x40), palette, root, body, whole, delay, disposal, clear))
            delay, disposal, clear = 0, 0, -1
            if not whole:
                raise EOFError
    except EOFError:
        return width, height, images, "ends early"


def frames(data: bytes | None, levels: int = 4, stripe_pixels: int = STRIPE_PIXELS) -> Iterator[tuple]:
    """The result rows of one file, without its id, stripe by stripe; see FRAMES. Histograms are arrays."""

    def nothing(error: str, width: int | None = None, height: int | None = None) -> tuple:
        return (None, None, None, width, height, None, None, None, None, None, None, error)

    if data is None:
        yield nothing("null")
        return
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        yield nothing("not a GIF")
        return
    width, height, images, error = _parse(data)
    if not images:
        yield nothing(error or "no frame", width, height)
        return
    most = max(1, stripe_pixels // max(width, 1))
    none = levels**3
    for top in range(0, max(height, 1), most):
        lines = min(most, height - top)
        canvas = cells = None
        time = 0
        for number, image in enumerate(images):
            low, high = max(image.y, top) - image.y, min(image.y + image.h, top + lines) - image.y
            wide = min(image.w, width - image.x)
            inside = high > low and wide > 0
            area = below = None
            if inside or image.got < 0:
                index = image.lines(low, high) if inside else image.lines(0, 0)
            if inside:
                if canvas is None:
                    canvas, cells = np.zeros((lines, width), "<u4"), np.full((lines, width), none, np.uint16)
                area = (slice(image.y + low - top, image.y + high - top), slice(image.x, image.x + wide))
                drawn, pixel, cell = _looks(image.palette, image.clear, levels)
                index = index[:, :wide]
                if image.disposal == 3:
                    below = canvas[area].copy(), cells[area].copy()
                seen = drawn[index]
                np.copyto(canvas[area], pixel[index], where=seen)
                np.copyto(cells[area], cell[index], where=seen)
            counts = np.zeros(none + 1, np.int64) if canvas is None else np.bincount(cells.ravel(), minlength=none + 1)
            clear = lines * width if canvas is None else int(counts[none])
            pixels = canvas.tobytes() if canvas is not None and clear < lines * width else None
            said = error if number == len(images) - 1 and error else "frame broken" if image.broken else None
            yield (number, time, image.delay, width, height, image.disposal, top, lines, pixels, counts[:none].astype(np.int32), clear, said)
            time += image.delay
            if inside and image.disposal == 2:
                canvas[area], cells[area] = 0, none
            elif inside and image.disposal == 3:
                canvas[area], cells[area] = below


def encode(width: int, height: int, palette: bytes, images: list[dict]) -> bytes:
    """A GIF of images (x, y, w, h, pixels, and maybe delay, disposal, clear, palette, interlaced)."""

    def bits(colours: bytes) -> int:
        return max(1, (len(colours) // 3 - 1).bit_length())

    def padded(colours: bytes) -> bytes:
        return colours.ljust(3 << bits(colours), b"\0")

    out = bytearray(b"GIF89a")
    out += width.to_bytes(2, "little") + height.to_bytes(2, "little") + bytes((0x80 | bits(palette) - 1, 0, 0)) + padded(palette)
    for image in images:
        clear = image.get("clear")
        out += bytes((0x21, 0xF9, 4, image.get("disposal", 0) << 2 | (clear is not None))) + image.get("delay", 0).to_bytes(2, "little") + bytes((clear or 0, 0))
        own = image.get("palette")
        flags = (0x80 | bits(own) - 1 if own else 0) | (0x40 if image.get("interlaced") else 0)
        out += b"\x2c" + b"".join(image[k].to_bytes(2, "little") for k in "xywh") + bytes((flags,))
        if own:
            out += padded(own)
        pixels = np.frombuffer(image["pixels"], np.uint8).reshape(image["h"], image["w"])
        if image.get("interlaced"):
            pixels = pixels[_interlaced(image["h"])]
        root = max(2, bits(own or palette))
        body = lzw_encode(pixels.tobytes(), root)
        out.append(root)
        for a in range(0, len(body), 255):
            part = body[a : a + 255]
            out += bytes((len(part),)) + part
        out.append(0)
    return bytes(out + b";")


def decode_frames(media: DataFrame, *, id_column: str = "media_id", bytes_column: str = "gif", levels: int = 4, stripe_pixels: int = STRIPE_PIXELS) -> DataFrame:
    """(id, frame, start_ms, delay_ms, width, height, disposal, top, lines, pixels, histogram, n_transparent, error)."""
    mine = media.select(F.col(f"`{id_column}`").alias("media_id"), F.col(f"`{bytes_column}`").alias("gif"))
    kind = mine.schema["media_id"].dataType
    names = ["media_id", *(f.split()[0] for f in FRAMES.split(", "))]
    types = {"start_ms": pa.int64(), "pixels": pa.binary(), "error": pa.string()}
    size = levels**3

    def table(ids: pa.Array, owner: list[int], rows: list[tuple]) -> pa.RecordBatch:
        columns = []
        for k, name in enumerate(names[1:]):
            values = [r[k] for r in rows]
            if name == "histogram":
                there = np.array([v is not None for v in values])
                edge = np.concatenate([[0], np.cumsum(there)]).astype(np.int32) * size
                flat = np.concatenate([np.zeros(0, np.int32), *(v for v in values if v is not None)])
                columns.append(pa.ListArray.from_arrays(pa.array(edge, mask=np.append(~there, False)), pa.array(flat)))
            else:
                columns.append(pa.array(values, types.get(name, pa.int32())))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(owner, pa.int32())), *columns], names)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner: list[int] = []
            rows: list[tuple] = []
            held = 0
            for i in range(batch.num_rows):
                for row in frames(batch.column("gif")[i].as_py(), levels, stripe_pixels):
                    owner.append(i)
                    rows.append(row)
                    held += len(row[8] or b"") + 300
                    if held > BATCH_FRAME_BYTES:
                        yield table(batch.column("media_id"), owner, rows)
                        owner, rows, held = [], [], 0
            if rows:
                yield table(batch.column("media_id"), owner, rows)

    return mine.mapInArrow(decode, f"media_id {kind.simpleString()}, {FRAMES}").withColumnRenamed("media_id", id_column)


def render(values: np.ndarray, scale: int = 3) -> bytes:
    """A GIF of a vector as a square picture: whole, a patch with holes, an interlaced half, and a line of it again.

    A value is a square of ``scale`` by ``scale`` pixels, shaded like a woven cloth, so that streams are of more than one block.
    """
    side = int(np.ceil(np.sqrt(len(values))))
    low, high = float(values.min()), float(values.max())
    shade = np.zeros(side * side, np.uint8)
    shade[: len(values)] = np.clip((values - low) / max(high - low, 1e-9) * 16, 0, 15).astype(np.uint8)
    picture = np.repeat(np.repeat(shade.reshape(side, side), scale, axis=0), scale, axis=1)
    side *= scale
    picture = np.minimum(picture + (np.add.outer(np.arange(side) * 7, np.arange(side) * 3) % 5 < 2), 15).astype(np.uint8)
    warm = bytes(v for i in range(16) for v in (i * 17, 255 - i * 17, 128))
    cold = bytes(v for i in range(16) for v in (0, i * 17, 255))
    half = max(1, side // 2)
    patch, line = picture[:half, :half].tobytes(), picture[-1:].tobytes()
    return encode(side, side, warm, [
        {"x": 0, "y": 0, "w": side, "h": side, "pixels": picture.tobytes(), "delay": 10, "disposal": 1},
        {"x": side - half, "y": side - half, "w": half, "h": half, "pixels": patch, "delay": 5, "disposal": 2, "clear": int(picture[0, 0]), "palette": cold},
        {"x": 0, "y": 0, "w": side, "h": half, "pixels": picture[:half].tobytes(), "delay": 20, "disposal": 3, "interlaced": True, "palette": cold},
        {"x": 0, "y": 0, "w": side, "h": 1, "pixels": line, "delay": 7},
    ])


def rendered(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, gif) of each vector; null and empty vectors have no file."""
    mine = vectors.select(F.col(f"`{id_column}`"), F.col(f"`{vector_column}`").cast("array<float>").alias("vector"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [None if x is None else np.array([0.0 if v is None else v for v in x]) for x in batch.column("vector").to_pylist()]
            gifs = [None if v is None or not len(v) else render(np.nan_to_num(v, posinf=0.0, neginf=0.0)) for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gifs, pa.binary())], [id_column, "gif"])

    return mine.mapInArrow(draw, f"`{id_column}` {mine.schema[0].dataType.simpleString()}, gif binary")
