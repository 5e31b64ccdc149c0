"""Media columns: bytes kept as baseline JPEG images, and thumbnails read from the DC terms.

A JPEG block's DC term over a quantiser of 8 is its mean sample, so one payload byte is stored
losslessly as one flat 8x8 block. Images are 64 blocks wide; a payload of more than 8,191 rows of
blocks (the format's limit of 65,535 lines) becomes several images, one after the other.

The reader is a general baseline one: it parses the markers, Huffman-decodes the scan (any number
of components, sampling factors, AC terms, restart intervals) and rebuilds the DC-only luminance
thumbnail in numpy. A scan of one component in which every block takes the same 16 bits, which is
verified word by word, is decoded all at once.

Edge cases: a null or empty text is a payload of 64 zero bytes; repeated rows give repeated results;
an empty table gives an empty one; other columns are not read, so they can have any name; bytes that
are no baseline JPEG raise ``ValueError``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table, text_or_empty

WIDTH, ROWS = 64, 8191
_ZEROS = bytes([8] * 64)


@lru_cache
def _codes() -> tuple[bytes, np.ndarray]:
    """The DC table's counts and symbols, and the 16 bits of a flat block for each difference.

    Category c has a code of 15 - c bits, so code, c magnitude bits and the one-bit end of block
    make 16 bits; the last bit is 0 and the first seven are too, so no byte is 0xFF.
    """
    counts, symbols, code, length, codes = [0] * 16, [], 0, 7, {}
    for c in range(8, -1, -1):
        if c < 8:
            code, length = (code + 1) << 1, length + 1
        counts[length - 1] = 1
        symbols.append(c)
        codes[c] = code
    words = np.zeros(511, ">u2")
    for d in range(-255, 256):
        c = abs(d).bit_length()
        words[d + 255] = codes[c] << (c + 1) | (d if d >= 0 else d + (1 << c) - 1) << 1
    return bytes(counts + symbols), words


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(payload: bytes) -> bytes:
    """Baseline images whose blocks' DC terms are the payload, of a positive multiple of 64 bytes."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("a payload has a positive multiple of 64 bytes")
    table_, words = _codes()
    out = []
    for at in range(0, len(payload), WIDTH * ROWS):
        samples = np.frombuffer(payload[at : at + WIDTH * ROWS], np.uint8).astype(np.int16)
        scan = words[np.diff(samples, prepend=np.int16(128)) + 255].tobytes()
        out += [
            b"\xff\xd8", _segment(0xDB, b"\0" + _ZEROS), _segment(0xC0, struct.pack(">BHHB3B", 8, len(samples) // WIDTH * 8, WIDTH * 8, 1, 1, 0x11, 0)),
            _segment(0xC4, b"\0" + table_), _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0"), _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])), scan, b"\xff\xd9",
        ]
    return b"".join(out)


@lru_cache(maxsize=64)
def _lookup(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Length and symbol of the code that a 16-bit word starts with; length 0: none."""
    lengths, symbols, code, at = np.zeros(65536, np.uint8), np.zeros(65536, np.uint8), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            low, high = code << (16 - n), (code + 1) << (16 - n)
            lengths[low:high], symbols[low:high] = n, body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return lengths, symbols


class _Bits:
    """The bits of entropy-coded data; ones follow its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\xff" * 8, 0, len(data) * 8

    def peek16(self) -> int:
        i, off = self.at >> 3, self.at & 7
        return (int.from_bytes(self.data[i : i + 3], "big") >> (8 - off)) & 0xFFFF

    def take(self, n: int) -> int:
        out = self.peek16() >> (16 - n) if n else 0
        self.at += n
        return out

    def symbol(self, lookup) -> int:
        word = self.peek16()
        if not (n := int(lookup[0][word])) or self.at + n > self.end:
            raise ValueError("the scan has a code that its table lacks, or ends early")
        self.at += n
        return int(lookup[1][word])

    def value(self, size: int) -> int:
        bits = self.take(size)
        return bits if not size or bits >> (size - 1) else bits - (1 << size) + 1


def _uniform(data: bytes, blocks: int, dc, ac) -> np.ndarray | None:
    """DC differences if each block is 16 bits with nothing but a DC term, which holds for all or None."""
    if len(data) != 2 * blocks:
        return None
    words = np.frombuffer(data, ">u2").astype(np.int32)
    size = dc[1][words].astype(np.int32)
    used = dc[0][words].astype(np.int32) + size
    if not dc[0][words].all() or (used >= 16).any():
        return None
    rest = (words << used) & 0xFFFF
    if ac[1][rest].any() or not (ac[0][rest] == 16 - used).all():
        return None
    bits = (words >> (16 - used)) & ((1 << size) - 1)
    return np.where((size > 0) & (bits >> np.maximum(size - 1, 0) == 0), bits - (1 << size) + 1, bits)


def _scan(data: bytes, frame: dict, order: list, tables: dict, restart: int) -> np.ndarray:
    """DC terms of the first component's blocks, in rows."""
    parts = data.split(b"\xff")
    runs, current = [], bytearray(parts[0])
    for p in parts[1:]:
        if p[:1] == b"\0":
            current += b"\xff" + p[1:]
        elif p[:1] and 0xD0 <= p[0] <= 0xD7:
            runs.append(bytes(current))
            current = bytearray(p[1:])
        else:
            current += p  # fill bytes
    runs.append(bytes(current))
    comps = frame["comps"]
    most_h, most_v = max(c[1] for c in comps), max(c[2] for c in comps)
    luma = order[0][0]
    if len(order) == 1:
        _, h, v, _ = comps[luma]
        across, down = -(-frame["width"] * h // (8 * most_h)), -(-frame["height"] * v // (8 * most_v))
        units, per = across * down, [(order[0], 1, 1)]
    else:
        mcus = -(-frame["width"] // (8 * most_h)), -(-frame["height"] // (8 * most_v))
        units, per = mcus[0] * mcus[1], [(o, comps[o[0]][1], comps[o[0]][2]) for o in order]
    _, dc0, ac0 = order[0]
    if len(order) == 1 and not restart and (d := _uniform(runs[0], units, tables[0, dc0], tables[1, ac0])) is not None:
        return np.cumsum(d).reshape(down, across)
    found, step, unit = [], restart or units, 0
    for run in runs:
        bits, last = _Bits(run), [0] * len(comps)
        for _ in range(min(step, units - unit)):
            unit += 1
            for (c, dc, ac), h, v in per:
                for _ in range(h * v):
                    last[c] += bits.value(bits.symbol(tables[0, dc]))
                    k = 1
                    while k < 64:
                        rs = bits.symbol(tables[1, ac])
                        if rs & 15:
                            bits.take(rs & 15)
                        elif rs != 0xF0:
                            break
                        k += (rs >> 4) + 1
                    if c == luma:
                        found.append(last[c])
    if unit < units:
        raise ValueError("the scan ends early")
    if len(order) == 1:
        return np.array(found).reshape(down, across)
    (_, h, v) = per[0]
    grid = np.array(found).reshape(mcus[1], mcus[0], v, h).swapaxes(1, 2).reshape(mcus[1] * v, mcus[0] * h)
    return grid[: -(-frame["height"] * v // (8 * most_v)), : -(-frame["width"] * h // (8 * most_h))]


def decode(media: bytes) -> list[tuple[int, int, np.ndarray]]:
    """For each image its width, its height and its luminance thumbnail of one sample a block."""
    out, at = [], 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at, quant, tables, restart, frame, thumb = at + 2, {}, {}, 0, None, None
        while True:
            if at + 2 > len(media) or media[at] != 0xFF:
                raise ValueError("no marker where one should be")
            marker = media[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            at += 2
            if marker == 0xD9:
                break
            size = int.from_bytes(media[at : at + 2], "big")
            body = media[at + 2 : at + size]
            at += size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = 16 + sum(body[1:17])
                    tables[body[0] >> 4, body[0] & 15] = _lookup(bytes(body[1 : 1 + n]))
                    body = body[1 + n :]
            elif marker == 0xDD:
                restart = int.from_bytes(body, "big")
            elif marker in (0xC0, 0xC1):
                _, height, width, n = struct.unpack(">BHHB", body[:6])
                frame = {"width": width, "height": height, "comps": [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]}
            elif 0xC2 <= marker <= 0xCF:
                raise ValueError("not a baseline image")
            elif marker == 0xDA:
                if frame is None:
                    raise ValueError("a scan before its frame")
                ids = [c[0] for c in frame["comps"]]
                order = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
                end = at
                while True:
                    end = media.find(b"\xff", end)
                    if end < 0:
                        raise ValueError("no end of image")
                    if media[end + 1] != 0 and not 0xD0 <= media[end + 1] <= 0xD7 and media[end + 1] != 0xFF:
                        break
                    end += 1 + (media[end + 1] != 0xFF)
                if order[0][0] == 0:
                    terms = _scan(media[at:end], frame, order, tables, restart)
                    scaled = np.floor(terms * quant[frame["comps"][0][3]] / 8 + 128.5)
                    thumb = np.clip(scaled, 0, 255).astype(np.uint8)
                at = end
        if frame is None or thumb is None:
            raise ValueError("an image without luminance")
        out.append((frame["width"], frame["height"], thumb))
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """16 hex digits: which of 8x8 cells are brighter than their mean."""
    rows, cols = (np.arange(8) * n // 8 for n in thumb.shape)
    size = np.outer(np.maximum(np.diff(rows, append=thumb.shape[0]), 1), np.maximum(np.diff(cols, append=thumb.shape[1]), 1))
    cells = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), rows, axis=0), cols, axis=1) / size
    return np.packbits(cells > cells.mean()).tobytes().hex()


def store(rows: DataFrame, payload: Column, keep: list[str]) -> DataFrame:
    """The columns ``keep``, and ``media``: the payload, padded with zero bytes to a multiple of 64, as JPEG."""
    source = rows.select(*keep, payload.alias("_payload"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                media = [encode(p.ljust(max(64, -(-len(p) // 64) * 64), b"\0")) for p in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(media, pa.binary())], [*keep, "media"])

    return source.mapInArrow(run, f"{kept}, media binary")


def read(rows: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """The columns ``keep``, and of the images in ``media``: ``width``, ``height`` (of all together), ``images``, ``thumbnail`` (its samples, row by row) and ``thumbnail_hash``."""
    source = rows.select(*keep, F.col(media).alias("_media"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    names = ["width", "height", "images", "thumbnail", "thumbnail_hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = []
                for m in part.column(len(keep)).to_pylist():
                    images = decode(m)
                    width = images[0][0]
                    if any(w != width for w, _, _ in images):
                        raise ValueError("images of different widths in one column")
                    thumb = np.concatenate([t for _, _, t in images])
                    found.append((width, sum(h for _, h, _ in images), len(images), thumb.tobytes(), thumbnail_hash(thumb)))
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True))], [*keep, *names])

    return source.mapInArrow(run, f"{kept}, width int, height bigint, images int, thumbnail binary, thumbnail_hash string")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().cast("binary").alias("payload"))
    stored = store(docs.withColumn("n_bytes", F.octet_length("payload").cast("long")), F.col("payload"), ["doc_id", "n_bytes"])
    digests = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    back = read(digests, ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    return back.select(
        "doc_id", "n_bytes", F.octet_length("thumbnail").cast("long").alias("payload_bytes"), F.sha2("thumbnail", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(thumbnail, -64, 64)")).alias("tail_crc32"), "media_bytes", "media_sha256",
        F.format_string("%dx%dx%d:%s", "width", "height", "images", "thumbnail_hash").alias("feature"),
    )
