"""Media columns: motion-JPEG in AVI files, one file for each row.

A payload of bytes becomes 8x8 blocks, one byte a coefficient. The Huffman tables have a single symbol each (category 8, no run), so that a
coefficient is one code bit and eight value bits: a byte is the value -255..-128 or 128..255 that these bits
mean, every block is 72 bytes long, and whole files are coded and decoded as arrays. The predictor of the first
coefficient restarts at each block. Quantisation is by one, so the frames are intra-coded, baseline and lossless.
Files made elsewhere are read too: baseline frames of any Huffman and quantisation tables, sampling and restarts, bit by bit. Shots go by luma.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread, texts_of

FPS = 25
ROW_BLOCKS = 8
FRAME_BLOCKS = 64
BINS = 16
#: A cut is where the histogram difference passes the mean of the last ``LOOK_BACK`` ones by ``SIGMAS`` deviations, and ``LEAST_CUT``;
#: ``FIRST_CUT`` where there are none yet.
LOOK_BACK, SIGMAS, LEAST_CUT, FIRST_CUT = 8, 3.0, 0.05, 0.4
SCALE_BITS = 11


def zigzag() -> list[int]:
    """Row-major places of the 64 coefficients in scan order."""
    order = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return [8 * i + j for i, j in order]


ZIGZAG = np.array(zigzag())


def inverse_dct() -> np.ndarray:
    """Pixels of a block from its 64 coefficients in scan order, as integers of ``SCALE_BITS`` fraction bits: sums stay
    exact in single precision, so results do not depend on how a batch is cut."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.round(np.kron(c, c)[ZIGZAG] * (1 << SCALE_BITS)).astype(np.float32)


INVERSE = inverse_dct()


def chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def segment(marker: int, data: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(data) + 2) + data


def jpeg_head(height: int, width: int) -> bytes:
    one_code = bytes([1] + [0] * 15)
    return (
        b"\xff\xd8"
        + segment(0xDB, b"\0" + b"\1" * 64)
        + segment(0xC0, struct.pack(">BHHB3B", 8, height, width, 1, 1, 0x11, 0))
        + segment(0xC4, b"\x00" + one_code + b"\x08")
        + segment(0xC4, b"\x10" + one_code + b"\x08")
        + segment(0xDD, struct.pack(">H", 1))
        + segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def padded(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 64 or (0 if data else 64))


def write_avi(data: bytes) -> bytes:
    """An AVI file whose frames hold ``data``, zero-padded to a positive multiple of 64 bytes."""
    payload = padded(data)
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    per_frame = min(FRAME_BLOCKS, -(-len(blocks) // ROW_BLOCKS) * ROW_BLOCKS)
    frames = -(-len(blocks) // per_frame)
    n = frames * per_frame
    bits = np.zeros((n, 64, 9), np.uint8)
    bits[: len(blocks), :, 1:] = np.unpackbits(blocks, axis=1).reshape(len(blocks), 64, 8)
    coded = np.empty((n, 74), np.uint8)
    coded[:, :72] = np.packbits(bits.reshape(n, 576), axis=1)
    coded[:, 72] = 0xFF
    coded[:, 73] = 0xD0 + np.arange(n) % per_frame % 8
    stuffed = coded == 0xFF
    stuffed[:, 72:] = False
    ends = np.cumsum(stuffed.sum(axis=1) + 74).tolist()
    at = np.flatnonzero(stuffed)
    flat = np.insert(coded.reshape(-1), at + 1, 0) if len(at) else coded.reshape(-1)
    scans = flat.tobytes()
    height, width = 8 * per_frame // ROW_BLOCKS, 8 * ROW_BLOCKS
    head = jpeg_head(height, width)
    movi, index, start = [b"movi"], [], 0
    offset = 4
    for f in range(frames):
        end = ends[(f + 1) * per_frame - 1]
        jpeg = head + scans[start : end - 2] + b"\xff\xd9"  # no restart after the last block
        movi.append(chunk(b"00dc", jpeg))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, offset, len(jpeg)))
        offset += len(movi[-1])
        start = end
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, frames, 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    strl = b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf) + chunk(b"strd", struct.pack("<QQ", len(data), len(payload)))
    body = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", strl)) + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


def chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, end) of the chunks in a span; of a LIST, the name is its kind."""
    while start + 8 <= end:
        name, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        if name == b"LIST":
            yield data[start + 8 : start + 12], start + 12, start + 8 + size
        else:
            yield name, start + 8, start + 8 + size
        start += 8 + size + size % 2


class Frame:
    """The headers of one baseline JPEG picture, and where its coded data lie."""

    def __init__(self, media: bytes, at: int, size: int):
        end = at + size
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("a frame is not a JPEG picture")
        self.quantisers: dict[int, np.ndarray] = {}
        self.huffman: dict[int, tuple[bytes, bytes]] = {}
        self.restart = 0
        self.components: list[tuple[int, int, int, int]] = []
        self.height = self.width = 0
        at += 2
        while True:
            if at + 4 > end or media[at] != 0xFF:
                raise ValueError("a frame's headers are damaged")
            marker, length = media[at + 1], struct.unpack_from(">H", media, at + 2)[0]
            body = media[at + 4 : at + 2 + length]
            if marker == 0xC0:
                bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                self.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if bits != 8 or not self.width or not self.height or any(not h or not v for _, h, v, _ in self.components):
                    raise ValueError("a frame's size or sampling is damaged")
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline frames are read")
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.huffman[body[0]] = body[1:17], body[17 : 17 + n]
                    body = body[17 + n :]
            elif marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            at += 2 + length
            if marker == 0xDA:
                if not self.components:
                    raise ValueError("a frame has no size")
                self.tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        self.data = media[at:end]
        # a block has two bits at least, so no damaged size asks for memory that its data do not
        if -(-self.width // 8) * -(-self.height // 8) > 4 * len(self.data):
            raise ValueError("a frame's data are too short for its size")
        if self.data[-2:] == b"\xff\xd9":
            self.data = self.data[:-2]

    def plain(self) -> bool:
        """Whether it is coded as ``write_avi`` does."""
        one = bytes([1] + [0] * 15), b"\x08"
        return len(self.components) == 1 and self.restart == 1 and self.huffman == {0x00: one, 0x10: one} and (self.quantisers[self.components[0][3]] == 1).all() and self.width % 8 == 0 == self.height % 8

    def luma(self) -> tuple[np.ndarray, int]:
        """Coefficients of the blocks of the first component, dequantised, in scan order, row by row; and the blocks in a row."""
        codes = {}
        for name, (counts, symbols) in self.huffman.items():
            code, at, table = 0, 0, {}
            for length, n in enumerate(counts, 1):
                for symbol in symbols[at : at + n]:
                    table[length, code] = symbol
                    code += 1
                at += n
                code <<= 1
            codes[name] = table
        most_h, most_v = max(h for _, h, _, _ in self.components), max(v for _, _, v, _ in self.components)
        if len(self.components) == 1:  # not interleaved: a unit is one block
            most_h = most_v = 1
            parts = [(self.components[0][0], 1, 1)]
        else:
            parts = [(c, h, v) for c, h, v, _ in self.components]
        across, down = -(-self.width // (8 * most_h)), -(-self.height // (8 * most_v))
        first, wide, high = parts[0]
        out = np.zeros((down * high, across * wide, 64), np.int64)
        runs = re.split(rb"\xff[\xd0-\xd7]", self.data)
        place = 0
        for run in runs:
            bits = np.unpackbits(np.frombuffer(run.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
            at = 0
            before = {c: 0 for c, _, _ in parts}

            def symbol(table: dict[tuple[int, int], int]) -> int:
                nonlocal at
                code = 0
                for length in range(1, 17):
                    code = code << 1 | bits[at]
                    at += 1
                    if (found := table.get((length, code))) is not None:
                        return found
                raise ValueError("a frame's code is damaged")

            def value(size: int) -> int:
                nonlocal at
                v = 0
                for bit in bits[at : at + size]:
                    v = v << 1 | bit
                at += size
                return v if not size or v >> (size - 1) else v - (1 << size) + 1

            for _ in range(min(self.restart or across * down, across * down - place)):
                for c, h, v in parts:
                    dc, ac = codes[self.tables[c] >> 4], codes[0x10 | self.tables[c] & 15]
                    for i in range(h * v):
                        block = np.zeros(64, np.int64)
                        before[c] += value(symbol(dc))
                        block[0] = before[c]
                        k = 1
                        while k < 64:
                            s = symbol(ac)
                            if s == 0:
                                break
                            k += s >> 4
                            if s & 15:
                                block[k] = value(s & 15)
                            k += 1
                        if c == first:
                            out[place // across * high + i // h, place % across * wide + i % h] = block
                place += 1
        if place < across * down:
            raise ValueError("a frame's data are cut short")
        return out.reshape(-1, 64) * self.quantisers[self.components[0][3]], across * wide

    def pixels(self) -> np.ndarray:
        """Luma of the picture, at the first component's own resolution."""
        blocks, across = self.luma()
        shown = shade(blocks.astype(np.float32)).reshape(-1, across, 8, 8).transpose(0, 2, 1, 3).reshape(-1, 8 * across)
        h, v = self.components[0][1] / max(c[1] for c in self.components), self.components[0][2] / max(c[2] for c in self.components)
        return shown[: -int(-self.height * v // 1), : -int(-self.width * h // 1)]


#: What reading a damaged file raises.
DAMAGE = (ValueError, KeyError, IndexError, OverflowError, struct.error)


def shade(coefficients: np.ndarray) -> np.ndarray:
    return np.clip((coefficients @ INVERSE) / (1 << SCALE_BITS) + 128, 0, 255).astype(np.uint8)


class Avi:
    """A parsed file: its frames by the index, or in their order where there is none, and the stream's own data."""

    def __init__(self, media: bytes):
        if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
            raise ValueError("not an AVI file")
        try:
            self.read(media)
        except (KeyError, IndexError, OverflowError, struct.error) as e:
            raise ValueError(f"the file is damaged: {e!r}") from e

    def read(self, media: bytes) -> None:
        top = {name: (a, b) for name, a, b in chunks(media, 12, len(media))}
        heads = {name: (a, b) for name, a, b in chunks(media, *top[b"hdrl"])}
        stream = {name: (a, b) for name, a, b in chunks(media, *heads[b"strl"])}
        scale, rate = struct.unpack_from("<II", media, stream[b"strh"][0] + 20)
        if not scale or not rate:
            raise ValueError("the stream has no frame rate")
        self.fps = rate / scale
        self.n_bytes, self.payload_bytes = struct.unpack_from("<QQ", media, stream[b"strd"][0]) if b"strd" in stream else (None, 0)
        if self.n_bytes is not None and not self.n_bytes <= self.payload_bytes <= len(media):
            raise ValueError("the stream's own lengths are damaged")
        frames = [Frame(media, at, size) for at, size in self.places(media, top)]
        if not frames:
            raise ValueError("the file has no frame")
        self.frames, self.width, self.height = len(frames), frames[0].width, frames[0].height
        self.values, self.others = None, frames
        if all(f.plain() and (f.width, f.height) == (self.width, self.height) for f in frames):
            data = np.frombuffer(b"".join(f.data + b"\xff\xd7" for f in frames), np.uint8)  # so that frames can be joined
            drop = np.zeros(len(data), bool)
            after = np.flatnonzero(data[:-1] == 0xFF) + 1
            drop[after] = True  # a stuffed zero, or the code of a restart marker
            drop[after[data[after] >= 0xD0] - 1] = True  # and the marker's first byte
            kept = data[~drop]
            if len(kept) != self.frames * self.width * self.height // 64 * 72:
                raise ValueError("a frame's data are damaged")
            bits = np.unpackbits(kept.reshape(-1, 72), axis=1).reshape(-1, 64, 9)
            self.values = np.packbits(bits[:, :, 1:].reshape(-1, 512), axis=1)
            self.others = []

    @staticmethod
    def places(media: bytes, top: dict[bytes, tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Where the frames of the first stream are, and their sizes. Index entries count from the list's name or from the file's beginning."""
        start, end = top[b"movi"]
        if b"idx1" not in top:
            yield from ((a, b - a) for name, a, b in chunks(media, start, end) if name in (b"00dc", b"00db"))
            return
        for at in range(*top[b"idx1"], 16):
            name, flags, offset, size = struct.unpack_from("<4sIII", media, at)
            if name not in (b"00dc", b"00db"):
                continue
            if not flags & 0x10:
                raise ValueError("a frame is not intra-coded")
            base = start - 4 if media[start - 4 + offset : start + offset] == name else 0
            yield base + offset + 8, size

    def payload(self) -> bytes:
        """The bytes that ``write_avi`` has stored."""
        if self.values is None or self.n_bytes is None or self.payload_bytes > self.values.size:
            raise ValueError("the file holds no payload")
        return self.values.reshape(-1)[: self.payload_bytes].tobytes()

    def histograms(self) -> np.ndarray:
        """Counts of luma in ``BINS`` steps for each frame, of the decoded pixels."""
        if self.values is None:
            return np.stack([np.bincount(f.pixels().reshape(-1) >> 4, minlength=BINS) for f in self.others])
        per_frame = len(self.values) // self.frames
        counts = np.zeros((self.frames, BINS), np.int64)
        step = max(1, 4096 // per_frame)
        for f in range(0, self.frames, step):
            v = self.values[f * per_frame : (f + step) * per_frame].astype(np.float32)
            pixels = shade(np.where(v < 128, v - 255, v))
            frame = np.repeat(np.arange(len(v) // per_frame) * BINS, per_frame * 64)
            n = len(v) // per_frame
            counts[f : f + n] = np.bincount(frame + (pixels.reshape(-1) >> 4), minlength=n * BINS).reshape(n, BINS)
        return counts

    def clips(self) -> list[tuple[int, int]]:
        """First and end frame of each shot."""
        h = self.histograms()
        share = h / np.maximum(h.sum(axis=1, keepdims=True), 1)
        change = np.abs(np.diff(share, axis=0)).sum(axis=1) / 2
        cuts = [0]
        for i, d in enumerate(change.tolist()):
            past = change[max(0, i - LOOK_BACK) : i]
            level = past.mean() + SIGMAS * past.std() if len(past) else FIRST_CUT
            if d > max(level, LEAST_CUT):
                cuts.append(i + 1)
        return list(zip(cuts, [*cuts[1:], self.frames]))


def to_avi(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, media binary): the UTF-8 of each text as an AVI file. Null and empty texts become 64 zero bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(write_avi, texts_of(batch, 1)), pa.binary())], ["doc_id", "media"])

    small_batches(docs.sparkSession)
    return spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(rows, "doc_id long, media binary")


CLIP = "doc_id long, clip int, start_s double, end_s double, frames long, error string"


def clip_rows(media: DataFrame) -> DataFrame:
    """(doc_id, clip, start_s, end_s, frames, error): a timed row for each shot of each file (doc_id, media), in any baseline motion JPEG. A file that is null
    or damaged has one row with an error and nulls. Repeated rows come out repeated; other columns take no part."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("doc_id", pa.int64()), ("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int64()), ("error", pa.string())])
        for batch in batches:
            out = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    avi = Avi(data or b"")
                    out += [{"doc_id": doc_id, "clip": k, "start_s": a / avi.fps, "end_s": b / avi.fps, "frames": b - a} for k, (a, b) in enumerate(avi.clips())]
                except DAMAGE as e:
                    out.append({"doc_id": doc_id, "error": str(e)})
            yield pa.RecordBatch.from_pylist(out, kinds)

    small_batches(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(rows, CLIP)


def describe(media: DataFrame) -> DataFrame:
    """Sizes, digests and a feature string of each file of ``to_avi`` (doc_id, media), all from what its frames hold when read back. A file that is null, damaged
    or made elsewhere has an error, and nulls for what it does not tell. Repeated rows come out repeated; other columns take no part."""

    def one(data: bytes | None) -> list:
        if data is None:
            return [None] * 7 + ["no file"]
        try:
            avi = Avi(data)
            payload = avi.payload()
            shots = ",".join(f"{a / avi.fps:.2f}-{b / avi.fps:.2f}" for a, b in avi.clips())
            return [avi.n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), f"{avi.width}x{avi.height};frames={avi.frames};clips={shots}", None]
        except DAMAGE as e:
            return [None] * 4 + [len(data), hashlib.sha256(data).hexdigest(), None, str(e)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
        for batch in batches:
            out = list(zip(*map(one, batch.column(1).to_pylist()))) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, k) for o, k in zip(out, kinds))], DESCRIBED)

    small_batches(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


DESCRIBED = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
