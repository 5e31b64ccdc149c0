import struct
import zlib

import numpy as np
import pytest

from millrace.llm import jpeg
from millrace.llm.jpeg import decode, encode, op9_media_columns


@pytest.mark.parametrize("n", [64, 128, 6400, 64 * jpeg.ROWS, 64 * jpeg.ROWS + 64])
def test_payload_comes_back(n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    images = decode(encode(payload))
    assert b"".join(t.tobytes() for _, _, t in images) == payload
    assert sum(h for _, h, _ in images) == n // 8


def test_slow_and_fast_way_agree(monkeypatch):
    payload = np.random.default_rng(1).integers(0, 256, 64 * 40, dtype=np.uint8).tobytes()
    media = encode(payload)
    monkeypatch.setattr(jpeg, "_uniform", lambda *a: None)
    assert decode(media)[0][2].tobytes() == payload


def _bits(text):
    text += "1" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\0")


def _general(restart):
    """2x2-sampled luminance and one chroma component, AC terms, 20x17 pixels, written symbol by symbol."""
    dc = {c: format(c, "04b") for c in range(12)}  # codes of 4 bits
    ac = {0x00: "00", 0x01: "01", 0xF0: "100", 0x35: "101"}
    rng, out, runs, last, luma = np.random.default_rng(3), "", [], [0, 0], np.zeros((4, 4), int)
    for m in range(4):
        if restart and m and m % restart == 0:
            runs.append(_bits(out))
            out, last = "", [0, 0]
        for c, n in ((0, 4), (1, 1)):
            for b in range(n):
                v = int(rng.integers(-60, 60))
                if c == 0:
                    luma[m // 2 * 2 + b // 2, m % 2 * 2 + b % 2] = v
                d, last[c] = v - last[c], v
                size = abs(d).bit_length()
                out += dc[size] + (format(d if d > 0 else d + (1 << size) - 1, f"0{size}b") if size else "")
                out += (ac[0x01] + "1" + ac[0xF0] + ac[0x35] + "10101" if b == 1 else "") + ac[0x00]
    runs.append(_bits(out))
    scan = b"".join(r + (bytes([0xFF, 0xD0 + i]) if i < len(runs) - 1 else b"") for i, r in enumerate(runs))
    seg = jpeg._segment
    media = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, b"\0" + bytes([16] * 64)) + seg(0xC0, struct.pack(">BHHB6B", 8, 17, 20, 2, 1, 0x22, 0, 2, 0x11, 0))
    media += seg(0xC4, b"\0" + bytes([0, 0, 0, 12] + [0] * 12 + [*range(12)])) + seg(0xC4, b"\x10" + bytes([0, 2, 2] + [0] * 13) + bytes([0x00, 0x01, 0xF0, 0x35]))
    media += (seg(0xDD, struct.pack(">H", restart)) if restart else b"") + seg(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    return media, np.clip(np.floor(luma * 2 + 128.5), 0, 255).astype(np.uint8)[:3, :3]


@pytest.mark.parametrize("restart", [0, 1, 3])
def test_general_scan(restart):
    media, thumb = _general(restart)
    ((w, h, got),) = decode(media)
    assert (w, h) == (20, 17) and (got == thumb).all()


def test_what_is_no_baseline_image_is_refused():
    media = encode(b"x" * 64)
    for bad in (b"abc", media[:-10], media.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(ValueError):
            decode(bad)


def test_query(spark, tmp_path):
    texts = ["héllo", None, "", "x" * 64, "y" * 600_000, "héllo"]
    spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op9_media_columns(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].tail_crc32) == (len(data), len(padded), zlib.crc32(padded[-64:]))
        import hashlib

        assert got[i].payload_sha256 == hashlib.sha256(padded).hexdigest() and got[i].media_sha256 == hashlib.sha256(encode(padded)).hexdigest()
    assert got[0].feature == got[5].feature and got[4].feature.startswith("512x75000x2:")
    assert op9_media_columns(spark, str(tmp_path)).limit(0).count() == 0
