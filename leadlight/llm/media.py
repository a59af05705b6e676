"""Media columns: motion-JPEG in AVI. Lossless storage, frame reading through the index, shots as timed clips.

Storage: each byte is one 8-bit sample, kept as the DC term of one 8x8 block of a baseline grey JPEG with
DC quantizer 8 and no AC terms, so any JPEG decoder gives a block of exactly that grey. The frames carry
their own Huffman tables: a difference of category s has a code of 9 - s bits, so every block takes ten
bits and a whole column of frames is coded and decoded with array arithmetic. Frames with other or no tables (then those
of the standard hold), AC terms, several components or restarts are decoded bit by bit to the pixels of their first
component.

Shots are cut where the difference of neighbouring frames' histograms stands out from its surroundings.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlight.llm.common import as_bytes, bounded

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
BINS = 16
#: Frames on each side that give the level from which a cut must stand out, by so many deviations and at least so much.
AROUND, DEVIATIONS, LEAST = 8, 2.5, 0.08


class MediaError(ValueError):
    """Bytes that are no AVI of JPEG frames that this reader takes."""


# ---- Huffman tables -------------------------------------------------------------------------------


def canonical(counts: bytes, values: bytes) -> dict[tuple[int, int], int]:
    """{(length, code): value} of a JPEG table given as 16 counts and the values."""
    codes, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[length, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return codes


#: Ours: category 8 has one bit, ... category 0 nine; the only AC symbol is the end of the block, one bit.
DC_COUNTS, DC_VALUES = bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))
AC_COUNTS, AC_VALUES = bytes([1] + [0] * 15), b"\0"


def _standard(counts: list[int], head: str) -> dict[tuple[int, int], int]:
    """An AC table of the JPEG standard: its values are ``head``, then all other (run, size) in ascending order."""
    first = list(bytes.fromhex(head))
    every = [0, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    return canonical(bytes(counts), bytes(first + sorted(set(every).difference(first))))


# Fixed values of the JPEG standard, Annex K: tables of frames that bring none, luminance and chrominance.
STANDARD_DC = [
    canonical(bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))),
    canonical(bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12))),
]
STANDARD_AC = [
    _standard([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282"),
    _standard([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f1"),
]
#: Row and column of the k-th term of a block: diagonals, every other one upwards.
ZIGZAG = np.array(sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1])))
#: The cosine transform of eight values.
COSINE = np.array([[np.sqrt((1 if u else 0.5) / 4) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
#: Blocks of a component beyond which a frame is taken for broken.
LARGEST = 1 << 20


def block_table(dc: dict[tuple[int, int], int], ac: dict[tuple[int, int], int]) -> tuple[int, np.ndarray] | None:
    """Bits of a block and the DC difference of each code, if all blocks have as many bits; else None."""
    if set(ac.values()) != {0} or len(ac) != 1 or len({length + s for (length, _), s in dc.items()}) != 1:
        return None
    ((end_bits, end_code),) = ac
    width = next(length + s for (length, _), s in dc.items()) + end_bits
    if 8 // gcd(8, width) * width > 64 or width > 16:
        return None
    differences = np.full(1 << width, -(1 << 20), np.int32)
    for (_, code), s in dc.items():
        for extra in range(1 << s):
            value = extra if s == 0 or extra >> (s - 1) else extra - (1 << s) + 1
            differences[((code << s | extra) << end_bits) | end_code] = value
    return width, differences


WIDTH, DIFFERENCES = block_table(canonical(DC_COUNTS, DC_VALUES), canonical(AC_COUNTS, AC_VALUES))
CODES = np.zeros(511, np.uint64)
CODES[DIFFERENCES[DIFFERENCES > -(1 << 20)] + 255] = np.flatnonzero(DIFFERENCES > -(1 << 20))


# ---- writing --------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=4)
def _frame_head(side: int) -> bytes:
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, b"\0" + bytes([8]) * 64),
            _segment(0xC0, struct.pack(">BHHB", 8, side * 8, side * 8, 1) + bytes([1, 0x11, 0])),
            _segment(0xC4, b"\x00" + DC_COUNTS + DC_VALUES),
            _segment(0xC4, b"\x10" + AC_COUNTS + AC_VALUES),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG frames of a payload whose size is a multiple of FRAME."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, FRAME).astype(np.int16)
    codes = CODES[np.diff(samples, axis=1, prepend=np.int16(128)) + 255].reshape(-1, 4)
    words = codes[:, 0] << np.uint64(30) | codes[:, 1] << np.uint64(20) | codes[:, 2] << np.uint64(10) | codes[:, 3]
    scans = words.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    size, head = FRAME * WIDTH // 8, _frame_head(SIDE)
    return [head + scans[i : i + size].replace(b"\xff", b"\xff\0") + b"\xff\xd9" for i in range(0, len(scans), size)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], side: int = SIDE * 8, fps: int = FPS) -> bytes:
    """An AVI 1.0 file with one MJPG stream and an index."""
    largest = max(map(len, frames))
    head = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, side, side, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, side, side)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", side * side * 3, 0, 0, 0, 0)
    headers = b"hdrl" + _chunk(b"avih", head) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", bitmap))
    chunks = [_chunk(b"00dc", f) for f in frames]
    sizes = np.array([len(c) for c in chunks], np.int64)
    index = np.empty((len(frames), 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1], index[:, 2], index[:, 3] = 0x10, 4 + np.cumsum(sizes) - sizes, [len(f) for f in frames]
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", headers) + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", index.tobytes()))


# ---- reading --------------------------------------------------------------------------------------


def _chunks(data: bytes, start: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, stop) of the chunks in a span."""
    while start + 8 <= stop:
        name, size = data[start : start + 4], int.from_bytes(data[start + 4 : start + 8], "little")
        yield name, start + 8, min(start + 8 + size, stop)
        start += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second and the frames, found through the index, or by walking the movie list where there is none."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise MediaError("no AVI file")
    fps, movie, index = float(FPS), None, b""
    for name, a, b in _chunks(data, 12, len(data)):
        if name == b"LIST" and data[a : a + 4] == b"hdrl":
            for inner, c, _ in _chunks(data, a + 4, b):
                if inner == b"avih":
                    fps = 1e6 / (struct.unpack_from("<I", data, c)[0] or 1)
        elif name == b"LIST" and data[a : a + 4] == b"movi":
            movie = (a, b)
        elif name == b"idx1":
            index = data[a:b]
    if movie is None:
        raise MediaError("no movie list")
    if not index:
        return fps, [data[c:d] for name, c, d in _chunks(data, movie[0] + 4, movie[1]) if name[2:] in (b"dc", b"db")]
    table = np.frombuffer(index[: len(index) // 16 * 16], "<u4").reshape(-1, 4)
    table = table[np.isin(table[:, 0] >> 16, [int.from_bytes(b"dc", "little"), int.from_bytes(b"db", "little")])].astype(np.int64)
    # offsets count from the list's name; some writers count from the file's start
    base = movie[0] if not len(table) or table[0, 1] < movie[0] else 0
    return fps, [data[base + at + 8 : base + at + 8 + size] for _, _, at, size in table.tolist()]


class FrameFormat:
    """What a frame's headers say: geometry, components, Huffman tables, restart interval, DC quantizers."""

    def __init__(self, head: bytes) -> None:
        self.dc, self.ac = dict(enumerate(STANDARD_DC)), dict(enumerate(STANDARD_AC))
        self.quant, self.restart = {}, 0
        at = 2
        while at + 4 <= len(head):
            marker, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
            body = head[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * (1 + wide)], ">u2" if wide else "u1").astype(np.int64)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    (self.ac if body[0] >> 4 else self.dc)[body[0] & 15] = canonical(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC0:
                self.height, self.width = struct.unpack_from(">HH", body, 1)
                self.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif marker in (0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
                raise MediaError(f"frame type {marker:#x}")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                self.order = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
        self.wide = [max(c[1] for c in self.components), max(c[2] for c in self.components)]
        first = self.components[0]
        # pixels and blocks of the first component, which may be smaller than the frame
        self.pixels = -(-self.width * first[1] // self.wide[0]), -(-self.height * first[2] // self.wide[1])
        self.blocks = -(-self.pixels[0] // 8), -(-self.pixels[1] // 8)
        if not 0 < self.blocks[0] * self.blocks[1] <= LARGEST:
            raise MediaError("no frame, or too large a one")
        one = len(self.components) == 1
        self.fast = block_table(self.dc[self.order[0][1]], self.ac[self.order[0][2]]) if one and not self.restart else None
        self.scale = self.quant[first[3]][0] / 8

    def grey(self, terms: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(terms * self.scale + 128), 0, 255).astype(np.uint8)

    def read(self, scans: list[bytes]) -> np.ndarray:
        """Samples (frames, n) of the first component: a grey of each block if all hold nothing else, or all pixels."""
        n = self.blocks[0] * self.blocks[1]
        size = self.fast and -(-n * self.fast[0] // 8)
        plain = [s.replace(b"\xff\0", b"\xff") for s in scans] if self.fast else []
        if not self.fast or any(len(s) != size for s in plain):
            return np.stack([self.slow(s).reshape(-1) for s in scans])
        width, differences = self.fast
        group = 8 // gcd(8, width)
        step = group * width // 8
        data = np.frombuffer(b"".join(s + b"\0" * (-len(s) % step) for s in plain), np.uint8).reshape(-1, step)
        words = np.zeros((len(data), 8), np.uint8)
        words[:, 8 - step :] = data
        words = words.view(">u8")[:, 0].astype(np.uint64)
        codes = np.empty((len(words), group), np.uint64)
        for i in range(group):
            codes[:, i] = words >> np.uint64(width * (group - 1 - i)) & np.uint64((1 << width) - 1)
        terms = differences[codes.reshape(len(scans), -1)[:, :n]]
        if (terms == -(1 << 20)).any():
            raise MediaError("a code outside the table")
        return self.grey(np.cumsum(terms, axis=1))

    def slow(self, scan: bytes) -> np.ndarray:
        """The pixels of the first component, term by term, for any baseline frame."""
        parts, start = [], 0
        for at in range(len(scan) - 1):
            if scan[at] == 0xFF and 0xD0 <= scan[at + 1] <= 0xD7:
                parts.append(scan[start:at])
                start = at + 2
        parts.append(scan[start:])
        one = len(self.components) == 1
        first = self.components[0]
        shape = (1, 1) if one else (first[1], first[2])
        units = self.blocks if one else (-(-self.width // (8 * self.wide[0])), -(-self.height // (8 * self.wide[1])))
        terms = np.zeros((units[1] * shape[1], units[0] * shape[0], 64), np.int64)
        quant = self.quant[first[3]]
        sampling = {c[0]: (c[1], c[2]) for c in self.components}
        unit, total = 0, units[0] * units[1]
        for part in parts:
            bits = np.unpackbits(np.frombuffer(part.replace(b"\xff\0", b"\xff"), np.uint8)).tolist()
            at, last = 0, dict.fromkeys(sampling, 0)

            def extra(size: int) -> int:
                nonlocal at
                value, at = int("".join(map(str, bits[at : at + size])) or "0", 2), at + size
                return value if size == 0 or value >> (size - 1) else value - (1 << size) + 1

            def symbol(codes: dict[tuple[int, int], int]) -> int:
                nonlocal at
                code = 0
                for length in range(1, 17):
                    if at >= len(bits):
                        break
                    code, at = code << 1 | bits[at], at + 1
                    if (length, code) in codes:
                        return codes[length, code]
                raise MediaError("a code outside the table")

            for _ in range(min(self.restart or total, total - unit)):
                for c, dc, ac in self.order:
                    h, v = (1, 1) if one else sampling[c]
                    for k in range(h * v):
                        last[c] += extra(symbol(self.dc[dc]))
                        block = terms[unit // units[0] * shape[1] + k // h, unit % units[0] * shape[0] + k % h] if c == first[0] else np.zeros(64, np.int64)
                        block[0], filled = last[c], 1
                        while filled < 64:
                            run = symbol(self.ac[ac])
                            if run == 0:
                                break
                            filled += run >> 4
                            if filled > 63:
                                raise MediaError("a run beyond its block")
                            block[filled] = extra(run & 15)
                            filled += 1
                unit += 1
        square = np.zeros((*terms.shape[:2], 8, 8))
        square[..., ZIGZAG[:, 0], ZIGZAG[:, 1]] = terms * quant
        plane = np.swapaxes(COSINE.T @ square @ COSINE, 1, 2).reshape(terms.shape[0] * 8, terms.shape[1] * 8)
        return np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)[: self.pixels[1], : self.pixels[0]]


@lru_cache(maxsize=64)
def frame_format(head: bytes) -> FrameFormat:
    return FrameFormat(head)


def _head(frame: bytes) -> bytes:
    at = 2
    while frame[at + 1] != 0xDA:
        at += 2 + int.from_bytes(frame[at + 2 : at + 4], "big")
    return frame[: at + 2 + int.from_bytes(frame[at + 2 : at + 4], "big")]


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Samples of JPEG frames: arrays (frames, n) of neighbours with the same headers. An empty frame repeats the one before."""
    out: list[np.ndarray] = []
    start = 0
    while start < len(frames):
        if not frames[start]:
            if out:
                out.append(out[-1][-1:])
            start += 1
            continue
        head, stop = _head(frames[start]), start + 1
        while stop < len(frames) and frames[stop].startswith(head):
            stop += 1
        scans = [f[len(head) : end if (end := f.rfind(b"\xff\xd9")) >= len(head) else len(f)] for f in frames[start:stop]]
        out.append(frame_format(head).read(scans))
        start = stop
    return out


# ---- shots ----------------------------------------------------------------------------------------


def histograms(samples: np.ndarray) -> np.ndarray:
    """The share of each of BINS greys in every frame (frames, n)."""
    n = len(samples)
    bins = (samples >> 4).astype(np.int64) + BINS * np.arange(n)[:, None]
    return np.bincount(bins.ravel(), minlength=BINS * n).reshape(n, BINS) / samples.shape[1]


def shots(shares: np.ndarray) -> tuple[list[int], np.ndarray]:
    """First frames of the shots, and each frame's histogram difference to the one before (0 for the first).

    A cut is at a frame whose difference is at least LEAST, the largest of its neighbours', and above the mean of up to
    AROUND differences on each side by DEVIATIONS standard deviations.
    """
    n = len(shares)
    if n < 2:
        return [0] * n, np.zeros(n)
    change = np.zeros(n)
    change[1:] = np.abs(np.diff(shares, axis=0)).sum(1) / 2
    sums, squares = np.concatenate([[0], np.cumsum(change)]), np.concatenate([[0], np.cumsum(change**2)])
    t = np.arange(1, n)
    low, high = np.maximum(t - AROUND, 1), np.minimum(t + AROUND + 1, n)
    others = np.maximum(high - low - 1, 1)
    mean = (sums[high] - sums[low] - change[t]) / others
    spread = np.sqrt(np.maximum((squares[high] - squares[low] - change[t] ** 2) / others - mean**2, 0))
    after = np.append(change[2:], 0)
    cut = (change[t] >= LEAST) & (change[t] >= change[t - 1]) & (change[t] > after) & (change[t] > mean + DEVIATIONS * spread)
    return [0, *t[cut].tolist()], change


def clips(media: bytes) -> tuple[list[np.ndarray], list[dict]]:
    """Samples of a media value and its clips: number, first frame, frames, start and end in seconds, strength of the cut."""
    fps, frames = read_avi(media)
    samples = decode_frames(frames)
    if not samples:
        return samples, []
    n = sum(map(len, samples))
    starts, change = shots(np.concatenate([histograms(x) for x in samples]))
    rows = [{"clip": k, "first_frame": a, "frames": b - a, "start_s": a / fps, "end_s": b / fps, "change": round(float(change[a]), 6)} for k, (a, b) in enumerate(zip(starts, [*starts[1:], n], strict=True))]
    return samples, rows


CLIP = "array<struct<clip:int,first_frame:int,frames:int,start_s:double,end_s:double,change:double>>"
CLIP_TYPE = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("change", pa.float64())]))


def store(data: bytes) -> bytes:
    """The AVI of some bytes, filled up with bytes 255 to a positive multiple of FRAME."""
    return write_avi(encode_frames(data + b"\xff" * ((-len(data) % FRAME) or (0 if data else FRAME))))


def media_columns(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns (id, n_bytes long, media binary, payload binary, clips array) of every row.

    media is the text's UTF-8 bytes as AVI, payload what is read back from it, clips the shots found in it. A null
    text is empty; an empty one fills one frame; a text of megabytes is one row, held alone. Repeated rows give repeated rows, an empty table an empty result; other columns are not read. One
    narrow stage without a shuffle; a few megabytes are held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "data", 1 << 20):
            data = batch.column(1).to_pylist()
            media = [store(x) for x in data]
            read = [clips(m) for m in media]
            arrays = [batch.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array(media, pa.binary()), pa.array([b"".join(x.tobytes() for x in s) for s, _ in read], pa.binary()), pa.array([c for _, c in read], CLIP_TYPE)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_bytes", "media", "payload", "clips"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), as_bytes(text_column).alias("data")).mapInArrow(run, f"id {kind}, n_bytes long, media binary, payload binary, clips {CLIP}")
    return rows.withColumnRenamed("id", id_column)


def clip_rows(media: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """One row for each clip of each media value, whatever wrote it: (id, clip, first_frame, frames, start_s, end_s, change).

    A null value has no rows, nor has an AVI without frames; any other value that is no AVI of baseline JPEG frames gives one
    row with null columns besides the id; so does a frame of more than LARGEST blocks (67 million pixels), as a bound of memory. Frames
    may differ in size and headers. Repeated rows give repeated rows, an empty table none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "media"):
            found = []
            for m in batch.column(1).to_pylist():
                try:
                    found.append(clips(m)[1])
                except (ValueError, struct.error, LookupError, AttributeError, ArithmeticError):  # what broken bytes lead to
                    found.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, CLIP_TYPE)], ["id", "clips"])

    kind = media.schema[id_column].dataType.simpleString()
    rows = media.where(F.col(media_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(media_column).alias("media"))
    return rows.mapInArrow(run, f"id {kind}, clips {CLIP}").where("clips is null or size(clips) > 0").select(F.col("id").alias(id_column), F.expr("inline_outer(clips)"))
