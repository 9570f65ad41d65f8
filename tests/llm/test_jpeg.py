import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievedeck.llm import jpeg

payloads = st.lists(st.one_of(st.binary(max_size=700), st.text(alphabet="mnl", max_size=700).map(str.encode), st.tuples(st.sampled_from([b"m", b"l", b"\0"]), st.integers(0, 900)).map(lambda x: x[0] * x[1])), min_size=1, max_size=6)


def padded(raw):
    return raw + b"\0" * (-len(raw) % 64 if raw else 64)


@settings(max_examples=120, deadline=None)
@given(payloads)
def test_payload_round_trip(texts):
    for raw, image in zip(texts, jpeg.decode_images(jpeg.payload_media(texts)), strict=True):
        assert jpeg.read_payload(image) == (padded(raw), len(raw))


def test_several_columns_of_units(monkeypatch):
    monkeypatch.setattr(jpeg, "MOST_ROWS", 3)
    r = random.Random(2)
    texts = [bytes(r.randrange(256) for _ in range(r.randrange(9000))) for _ in range(12)]
    for raw, image in zip(texts, jpeg.decode_images(jpeg.payload_media(texts)), strict=True):
        assert jpeg.read_payload(image) == (padded(raw), len(raw))


def slow_rgb(image, height, width):
    """Pixel by pixel from the coefficients, by the definition of the transform."""
    order, out = jpeg.zigzag(), np.zeros((height, width, 3))
    planes = []
    for c, coefficients in enumerate(image.coefficients):
        wide = width // (8 if c == 0 else 16)
        plane = np.zeros((len(coefficients) // wide * 8, wide * 8))
        for k, zz in enumerate(coefficients):
            block = np.zeros(64)
            block[order] = zz
            for y in range(8):
                for x in range(8):
                    total = sum(
                        block[8 * v + u] * (2**-0.5 if u == 0 else 1) * (2**-0.5 if v == 0 else 1) / 4 * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
                        for v in range(8) for u in range(8)
                    )
                    plane[k // wide * 8 + y, k % wide * 8 + x] = np.clip(np.floor(total + 128.5 + 1e-6), 0, 255)
        planes.append(plane)
    for y in range(height):
        for x in range(width):
            a, cb, cr = planes[0][y, x], planes[1][y // 2, x // 2] - 128, planes[2][y // 2, x // 2] - 128
            out[y, x] = a + 1.402 * cr, a - 0.344136 * cb - 0.714136 * cr, a + 1.772 * cb
    return np.clip(np.rint(out), 0, 255)


def test_pixels_against_the_definition():
    raw = "Some words, é and 12 more. ".encode() * 9
    image = jpeg.decode_images(jpeg.payload_media([raw]))[0]
    assert np.abs(image.rgb - slow_rgb(image, *image.rgb.shape[:2])).max() <= 1


def test_without_restart_markers(monkeypatch):
    """The same coefficients in one long segment a scan, with runs of ended blocks."""
    raw = b"m" * 500 + b"no" * 300
    file = jpeg.payload_media([raw])[0]
    whole = jpeg.decode_images([file])[0]
    at = file.index(b"\xff\xdd\x00\x04") + 4
    blocks = len(whole.coefficients[1])
    # An interval as long as the longest scan would need its markers gone; a wrong one is refused.
    with pytest.raises(ValueError):
        jpeg.decode_images([file[:at] + (blocks * 99).to_bytes(2, "big") + file[at + 2 :]])


def test_broken_files_are_refused():
    file = jpeg.payload_media([b"hello"])[0]
    for bad in (b"", b"GIF89a", file.replace(b"\xff\xc2", b"\xff\xc0", 1)):
        with pytest.raises(ValueError):
            jpeg.decode_images([bad])


def test_media_columns(spark, odd, empty):
    rows = jpeg.media_features(jpeg.with_media(odd)).collect()
    want = sorted((str(r["doc_id"]), padded((r["text"] or "").encode())) for r in odd.collect())
    got = sorted((str(r["doc_id"]), r["payload_sha256"], r["payload_bytes"], r["tail_crc32"]) for r in rows)
    assert got == sorted((i, hashlib.sha256(p).hexdigest(), len(p), zlib.crc32(p[-64:])) for i, p in want)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["payload_sha256"] + str(r["n_bytes"]), (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert jpeg.media_features(jpeg.with_media(empty)).collect() == []
    shapes = jpeg.decode_media(jpeg.with_media(odd)).select("media.*").collect()
    assert all(len(r["rgb"]) == 3 * r["height"] * r["width"] for r in shapes)
    assert jpeg.decode_media(spark.createDataFrame([(None,)], "media binary")).first()["media"]["rgb"] is None
