from __future__ import annotations

import numpy as np
import pytest
from batchloom.llm import gif
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.common import empty

PALETTE = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 8), st.data())
def test_lzw_round_trip(root, data):
    pixels = bytes(data.draw(st.lists(st.integers(0, (1 << root) - 1), max_size=400))) * data.draw(st.integers(1, 30))
    assert gif.lzw_decode(gif.lzw_encode(pixels, root), root, len(pixels)) == pixels


def test_lzw_with_a_full_table():
    pixels = np.random.default_rng(1).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert gif.lzw_decode(gif.lzw_encode(pixels, 8), 8, len(pixels)) == pixels


def plain(width: int, height: int, images: list[dict]) -> list[np.ndarray]:
    """The canvas of each frame, a pixel at a time."""
    canvas, out = np.zeros((height, width, 4), int), []
    for image in images:
        before = canvas.copy()
        colours = image.get("palette", PALETTE)
        for k, index in enumerate(image["pixels"]):
            x, y = image["x"] + k % image["w"], image["y"] + k // image["w"]
            if x < width and y < height and index != image.get("clear") and index * 3 < len(colours):
                canvas[y, x] = [*colours[index * 3 : index * 3 + 3], 255]
        out.append(canvas.copy())
        if image.get("disposal") == 2:
            canvas[image["y"] : image["y"] + image["h"], image["x"] : image["x"] + image["w"]] = 0
        elif image.get("disposal") == 3:
            canvas = before
    return out


image = st.builds(
    lambda x, y, w, h, seed, delay, disposal, clear, own, interlaced: {"x": x, "y": y, "w": w, "h": h, "pixels": np.random.default_rng(seed).integers(0, 4, w * h).astype(np.uint8).tobytes(), "delay": delay, "disposal": disposal, "interlaced": interlaced} | ({"clear": clear} if clear is not None else {}) | ({"palette": PALETTE[::-1]} if own else {}),
    st.integers(0, 5), st.integers(0, 5), st.integers(1, 12), st.integers(1, 12), st.integers(0, 99), st.integers(0, 500), st.integers(0, 3), st.one_of(st.none(), st.integers(0, 3)), st.booleans(), st.booleans(),
)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.lists(image, min_size=1, max_size=5))
def test_frames_equal_plain_drawing(width, height, images):
    got = list(gif.frames(gif.encode(width, height, PALETTE, images), levels=4))
    time = 0
    assert len(got) == len(images)
    for k, (row, canvas) in enumerate(zip(got, plain(width, height, images))):
        number, start, delay, w, h, disposal, top, lines, pixels, histogram, n_clear, error = row
        assert (number, start, delay, w, h, disposal, top, lines, error) == (k, time, images[k]["delay"] * 10, width, height, images[k]["disposal"], 0, height, None)
        assert pixels == (canvas.astype(np.uint8).tobytes() if canvas[:, :, 3].any() else None)
        expected = [0] * 64
        for p in canvas.reshape(-1, 4):
            if p[3]:
                expected[(p[0] // 64 * 4 + p[1] // 64) * 4 + p[2] // 64] += 1
        assert histogram.tolist() == expected and n_clear == sum(p[3] == 0 for p in canvas.reshape(-1, 4))
        time += delay


def test_broken_files():
    one = {"x": 0, "y": 0, "w": 4, "h": 4, "pixels": bytes(range(4)) * 4, "delay": 1}
    whole = gif.encode(4, 4, PALETTE, [one, one])
    for n in range(len(whole)):
        rows = list(gif.frames(whole[:n]))
        assert rows and rows[-1][-1]
    assert [r[-1] for r in gif.frames(None)] == ["null"]
    assert [r[-1] for r in gif.frames(b"")] == ["not a GIF"]
    assert [r[-1] for r in gif.frames(b"PNG")] == ["not a GIF"]
    assert [r[-1] for r in gif.frames(gif.encode(4, 4, PALETTE, []))] == ["no frame"]
    assert [r[-1] for r in gif.frames(whole[:-1] + b"\x77")] == [None, "unknown block"]


def test_without_any_palette():
    data = bytearray(gif.encode(1, 1, PALETTE, [{"x": 0, "y": 0, "w": 1, "h": 1, "pixels": b"\x02"}]))
    data[10] &= 0x7F
    del data[13 : 13 + 12]
    assert next(gif.frames(bytes(data)))[8] == bytes([2, 2, 2, 255])


def test_rendered_vectors_round_trip(spark):
    vectors = spark.createDataFrame([(1, [float(i) for i in range(64)]), (2, None), (3, []), (4, [1.0]), (4, [1.0]), (None, [0.5, None, float("nan")])], "vec_id bigint, embedding array<float>").withColumns({"gif": F.lit(1), "frame": F.lit(2)})
    got = gif.decode_frames(gif.rendered(vectors), id_column="vec_id").collect()
    assert sum(r.vec_id == 1 for r in got) == 4 and sum(r.vec_id == 4 for r in got) == 8
    assert {(r.vec_id, r.error) for r in got if r.frame is None} == {(2, "null"), (3, "null")}
    first = next(r for r in got if r.vec_id == 1 and r.frame == 0)
    cloth = [(x * 7 + y * 3) % 5 < 2 for x in range(24) for y in range(24)]
    assert [first.pixels[4 * i] for i in range(576)] == [min(15, min(15, int((i // 72 * 8 + i % 24 // 3) / 63 * 16)) + cloth[i]) * 17 for i in range(576)]
    assert sum(first.histogram) == 576 and first.n_transparent == 0 and len(gif.render(np.arange(64.0))) > 600  # several blocks to a stream
    assert gif.decode_frames(empty(spark, "media_id string, gif binary")).count() == 0


@pytest.mark.parametrize("root", range(16))
def test_every_code_size(spark, root):
    data = bytearray(gif.encode(2, 1, PALETTE, [{"x": 0, "y": 0, "w": 2, "h": 1, "pixels": b"\1\1"}]))
    at = data.index(b"\x2c", 13 + 12 + 8) + 10
    data[at] = root
    if root != 2:
        assert next(gif.frames(bytes(data)))[-1] == "frame broken" or 1 <= root <= 8
    assert gif.decode_frames(spark.createDataFrame([(1, bytes(data))], "media_id int, gif binary")).count() == 1


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=80), st.integers(0, 255), st.integers(0, 40))
def test_no_file_ends_a_task(noise, root, most):
    gif.lzw_decode(noise, root, most)
    head = gif.encode(3, 2, PALETTE, [])[:-1]
    assert list(gif.frames(head + noise)) and list(gif.frames(head + b"\x2c" + bytes(4) + b"\3\0\2\0\0" + bytes((root,)) + noise))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.lists(image, min_size=1, max_size=5), st.integers(1, 40))
def test_stripes_are_cuts_of_the_canvas(width, height, images, stripe_pixels):
    data = gif.encode(width, height, PALETTE, images)
    for k, canvas in enumerate(plain(width, height, images)):
        mine = [r for r in gif.frames(data, stripe_pixels=stripe_pixels) if r[0] == k]
        assert [r[6] for r in mine] == list(np.cumsum([0, *(r[7] for r in mine)])[:-1]) and sum(r[7] for r in mine) == height
        assert b"".join(r[8] or bytes(4 * width * r[7]) for r in mine) == canvas.astype(np.uint8).tobytes()
        assert sum(int(r[9].sum()) for r in mine) == (canvas[:, :, 3] > 0).sum() and all(r[-1] is None for r in mine)


def test_a_large_canvas_in_stripes():
    w, h = 5000, 3600  # more than 2**24 pixels
    pixels = np.repeat(np.arange(h) % 4, w).astype(np.uint8)
    rows = list(gif.frames(gif.encode(w, h, PALETTE, [{"x": 0, "y": 0, "w": w, "h": h, "pixels": pixels.tobytes()}])))
    assert len(rows) == 5 and sum(r[7] for r in rows) == h and all(r[-1] is None for r in rows)
    assert b"".join(r[8][:: 4 * w] for r in rows) == bytes(PALETTE[3 * (y % 4)] for y in range(h))
    assert sum(int(r[9].sum()) for r in rows) == w * h


def test_a_forged_header_costs_no_memory():
    data = gif.encode(65535, 65535, PALETTE, [{"x": 7, "y": 65000, "w": 2, "h": 2, "pixels": b"\1\2\3\1"}])
    seen = [r for r in gif.frames(data) if r[8] is not None]
    assert len(seen) == 1 and seen[0][6] <= 65000 < seen[0][6] + seen[0][7] and seen[0][9].sum() == 4


def test_a_file_of_another_encoder():
    # the well-known picture of ten by ten pixels, as drawn by a common program
    raw = "474946383961" "0a000a00910000" "ffffffff00000000ff000000" "21f90400000000002c000000000a000a000002168c2d99872a1cdc33a00275ec95faa8de608c04914c01003b"
    white, red, blue = b"\xff\xff\xff\xff", b"\xff\0\0\xff", b"\0\0\xff\xff"
    outer, inner = red * 5 + blue * 5, red * 3 + white * 4 + blue * 3
    back = [blue * 3 + white * 4 + red * 3] * 2 + [blue * 5 + red * 5] * 3
    row = next(gif.frames(bytes.fromhex(raw)))
    assert row[8] == b"".join([outer] * 3 + [inner] * 2 + back) and row[-1] is None
