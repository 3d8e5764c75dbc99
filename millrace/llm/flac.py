"""FLAC media columns: bytes as 8-bit mono samples, coded without loss and read back.

Frames have 192 samples each, so that all frames of many texts are coded and decoded side by side as arrays: one step
of the decoder reads the next Rice code of every frame. Frames are found by their headers (sync, CRC-8, running number)
and accepted by their CRC-16. A seek table gives the place of every 64th frame: the reader decodes from point to point,
each stretch by itself, into PCM blocks that carry their sample offset, and can start at any of them.

The reader takes what such a stream may hold: constant, verbatim, fixed and LPC subframes, Rice codes with partitions.
It refuses other block sizes and sample formats, wasted bits and escaped partitions.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from millrace.llm.shared import new_names, pieces, written

BLOCK, SEEK_EVERY, PRECISION, SHIFT = 192, 64, 12, 9
#: Frames that are worked on at a time.
AT_ONCE = 4096


def _crc_table(width: int, poly: int) -> np.ndarray:
    table = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        table = ((table << 1) ^ np.where(table >> (width - 1) & 1, poly, 0)) & ((1 << width) - 1)
    return table


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)
_ZEROS = np.array([16 - int(i).bit_length() for i in range(1 << 16)], np.int64)


def _crcs(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of data[begin:end] of each frame; zeros before a frame don't count, so frames are lined up at their ends."""
    crc = np.zeros(len(begin), np.int64)
    for back in range(int((end - begin).max(initial=0)), 0, -1):
        at = end - back
        byte = np.where(at >= begin, data[np.maximum(at, 0)], 0)
        crc = (crc << 8 & 0xFFFF) ^ CRC16[crc >> 8 ^ byte]
    return crc


def _number(n: np.ndarray) -> list[np.ndarray]:
    """Bytes of frame numbers in the format's extended UTF-8, and how many each has, last."""
    size = np.select([n < 1 << 7, n < 1 << 11, n < 1 << 16, n < 1 << 21, n < 1 << 26], [1, 2, 3, 4, 5], 6)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC])[size]
    out = [np.where(size == 1, n, lead | n >> 6 * (size - 1))]
    out += [0x80 | n >> 6 * np.maximum(size - 1 - i, 0) & 0x3F for i in range(1, 6)]
    return [*out, size]


def _code(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the frames of samples x (frames by 192), and where each frame begins and ends."""
    count = len(x)
    # candidates: fixed predictors of order 0 to 2, and LPC of order 2 from the autocorrelation
    energy = (x * x).sum(1).astype(float)
    r1, r2 = (x[:, 1:] * x[:, :-1]).sum(1).astype(float), (x[:, 2:] * x[:, :-2]).sum(1).astype(float)
    det = np.maximum(energy * energy - r1 * r1, 1.0)
    most = (1 << PRECISION - 1) - 1
    c1 = np.clip(np.rint((r1 * energy - r1 * r2) / det * (1 << SHIFT)), -most, most).astype(np.int64)
    c2 = np.clip(np.rint((energy * r2 - r1 * r1) / det * (1 << SHIFT)), -most, most).astype(np.int64)
    residuals = [x, np.diff(x, axis=1, prepend=0), np.zeros_like(x), np.zeros_like(x)]
    residuals[2][:, 2:] = x[:, 2:] - 2 * x[:, 1:-1] + x[:, :-2]
    residuals[3][:, 2:] = x[:, 2:] - (c1[:, None] * x[:, 1:-1] + c2[:, None] * x[:, :-2] >> SHIFT)
    residuals[1][:, 0] = 0
    order = np.array([0, 1, 2, 2])
    choice = np.argmin(np.stack([np.abs(r).sum(1) for r in residuals]), 0)
    e = np.select([(choice == i)[:, None] for i in range(4)], residuals)
    u = np.where(e < 0, -2 * e - 1, 2 * e)
    mean = u.sum(1) / BLOCK
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 14).astype(np.int64)
    # fields: 8 of subframe head, warm-up and coefficients, one of the residual's head, then the codes; a width of 0 leaves a field out
    warm = order[choice]
    lpc = choice == 3
    value, bits, width = (np.zeros((count, 9 + BLOCK), np.int64) for _ in range(3))

    def field(i: int, v, n) -> None:
        value[:, i], bits[:, i], width[:, i] = v, n, n

    constant = (x == x[:, :1]).all(1)
    field(0, np.where(lpc, 0x42, 0x10 | choice << 1), 8)  # 1ooooo with order - 1, or 001ooo, each before the wasted-bits flag
    value[lpc, 0] = (0x20 | 1) << 1
    field(1, x[:, 0] & 0xFF, np.where(warm > 0, 8, 0))
    field(2, x[:, 1] & 0xFF, np.where(warm > 1, 8, 0))
    field(3, PRECISION - 1, np.where(lpc, 4, 0))
    field(4, SHIFT, np.where(lpc, 5, 0))
    field(5, c1 & (1 << PRECISION) - 1, np.where(lpc, PRECISION, 0))
    field(6, c2 & (1 << PRECISION) - 1, np.where(lpc, PRECISION, 0))
    field(7, k, 10)  # method 0, one partition, its parameter
    kk = k[:, None]
    value[:, 9:], bits[:, 9:], width[:, 9:] = 1 << kk | u & (1 << kk) - 1, kk + 1, (u >> kk) + 1 + kk
    skip = np.arange(BLOCK) < warm[:, None]
    bits[:, 9:][skip] = width[:, 9:][skip] = value[:, 9:][skip] = 0
    # what takes no less than plain samples is stored plain; equal samples as one
    plain = (width.sum(1) >= 8 + 8 * BLOCK) | constant
    value[plain, 0] = np.where(constant[plain], 0, 1 << 1)
    bits[plain, 1:] = width[plain, 1:] = value[plain, 1:] = 0
    value[plain, 9:], bits[plain, 9:], width[plain, 9:] = x[plain] & 0xFF, 8, 8
    bits[constant, 10:] = width[constant, 10:] = value[constant, 10:] = 0

    *number, sized = _number(numbers)
    head = [np.full(count, b) for b in (0xFF, 0xF8, 0x10, 0x02)]
    crc = np.zeros(count, np.int64)
    for b in head:
        crc = CRC8[crc ^ b]
    for i, b in enumerate(number):
        crc = np.where(i < sized, CRC8[crc ^ b], crc)
    first = 5 + sized
    length = first + -(-width.sum(1) // 8) + 2
    end = np.cumsum(length)
    begin = end - length
    last = np.cumsum(width, 1) + ((begin + first) * 8)[:, None]
    used = bits > 0
    at, n, v = (last - bits)[used], bits[used], value[used]
    # each field lies in two 32-bit words at most; sums are unions, as no bits overlap
    word, off = at >> 5, at & 31
    wide = v << 48 - off - n
    words = int(end[-1]) // 4 + 3
    high, low = wide >> 16, (wide & 0xFFFF) << 16
    total = np.bincount(word, high, words) + np.bincount(word + 1, low, words)
    data = total.astype(np.uint32).byteswap().view(np.uint8)[: int(end[-1])].copy()
    for i, b in enumerate(head):
        data[begin + i] = b
    for i, b in enumerate(number):
        has = i < sized
        data[begin[has] + 4 + i] = b[has]
    data[begin + 4 + sized] = crc
    check = _crcs(data, begin, end - 2)
    data[end - 2], data[end - 1] = check >> 8, check & 0xFF
    return data, np.stack([begin, end])


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A FLAC file for each payload; lengths are positive multiples of 192."""
    frames = np.array([len(p) // BLOCK for p in payloads])
    x = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int64).reshape(-1, BLOCK) - 128
    numbers = np.arange(len(x)) - np.repeat(np.cumsum(frames) - frames, frames)
    parts, sizes = [], []
    for i in range(0, len(x), AT_ONCE):
        data, (begin, end) = _code(x[i : i + AT_ONCE], numbers[i : i + AT_ONCE])
        parts.append(data.tobytes())
        sizes.append(end - begin)
    body, sizes = b"".join(parts), np.concatenate(sizes)
    ends = np.cumsum(sizes)
    out, done = [], 0
    for p, n in zip(payloads, frames.tolist(), strict=True):
        own = sizes[done : done + n]
        begin = int(ends[done] - own[0])
        offsets = ends[done : done + n] - own - begin
        points = b"".join(struct.pack(">QQH", i * BLOCK, int(offsets[i]), BLOCK) for i in range(0, n, SEEK_EVERY))
        # rate 8000, 1 channel, 8 bits, number of samples
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big") + (8000 << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big")
        info += hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes(), usedforsecurity=False).digest()
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points + body[begin : int(ends[done + n - 1])])
        done += n
    return out


def _info(media: bytes) -> tuple[int, bytes, list[tuple[int, int]]]:
    """How many samples there are, their MD5, and the points to seek: sample and place in the file, the beginning first."""
    if media[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, table = 4, b"", b""
    while True:
        kind, n = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        if kind & 127 == 0:
            info = media[at + 4 : at + 4 + n]
        elif kind & 127 == 3:
            table = media[at + 4 : at + 4 + n]
        at += 4 + n
        if kind & 128:
            break
    packed = int.from_bytes(info[10:18], "big")
    if info[:4] != struct.pack(">HH", BLOCK, BLOCK) or packed >> 36 & 0xFF != 7:
        raise ValueError("only mono streams of 8 bits in blocks of 192 are read")
    samples = packed & (1 << 36) - 1
    points = [(sample, at + place) for sample, place, _ in struct.iter_unpack(">QQH", table) if sample != 2**64 - 1]
    if not points or points[0][0]:
        points.insert(0, (0, at))
    ends = [*points[1:], (samples, len(media))]
    if any(x[0] % BLOCK or x[0] >= y[0] or x[1] >= y[1] for x, y in zip(points, ends, strict=True)):
        raise ValueError("the seek table is wrong")
    return samples, info[18:34], points


def _find(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every frame of all stretches in data[starts:ends], which hold `counts` frames each, from frame `numbers` on."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.int64)
    at = np.flatnonzero((padded[:-16] == 0xFF) & (padded[1:-15] == 0xF8) & (padded[2:-14] == 0x10) & (padded[3:-13] == 0x02))
    stream = np.searchsorted(starts, at, "right") - 1
    at, stream = (z[(stream >= 0) & (at < ends[np.maximum(stream, 0)])] for z in (at, stream))
    lead = padded[at + 4]
    size = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [1, 2, 3, 4, 5], 6)
    number = np.where(size == 1, lead, lead & (0x7F >> size))
    crc = np.zeros(len(at), np.int64)
    for i in range(4):
        crc = CRC8[crc ^ padded[at + i]]
    for i in range(6):
        byte = padded[at + 4 + i]
        number = np.where((i > 0) & (i < size), number << 6 | byte & 0x3F, number)
        crc = np.where(i < size, CRC8[crc ^ byte], crc)
    good = crc == padded[at + 4 + size]
    at, stream, number = at[good], stream[good], number[good]
    first = np.cumsum(counts) - counts
    if len(at) != counts.sum() or (number != np.arange(len(at)) - first[stream] + numbers[stream]).any():
        at = _chained(padded, at, stream, number - numbers[stream], counts)
        stream = np.repeat(np.arange(len(counts)), counts)
    end = np.append(at[1:], 0)
    final = np.cumsum(counts) - 1
    end[final] = ends
    if (_crcs(padded, at, end - 2) != (padded[end - 2] << 8 | padded[end - 1])).any():
        raise ValueError("a frame's checksum is wrong")
    return at, end


def _chained(data, at, stream, number, counts) -> np.ndarray:
    """Bytes inside a frame may look like a header: of such candidates, those in whose row every frame's checksum holds."""
    out = []
    for s, count in enumerate(counts.tolist()):
        mine = stream == s
        row, name = at[mine].tolist(), number[mine].tolist()
        own = [row[0]] if row and name[0] == 0 else []
        for a, n in zip(row[1:], name[1:], strict=True):
            if own and n == len(own):
                crc = int(_crcs(data, np.array([own[-1]]), np.array([a - 2]))[0])
                if crc == int(data[a - 2]) << 8 | int(data[a - 1]):
                    own.append(a)
        if len(own) != count:
            raise ValueError("frames are missing")
        out += own
    return np.array(out)


class _Bits:
    """Reads of a few bits at many places of one buffer."""

    def __init__(self, data: np.ndarray) -> None:
        d = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint32)
        self.words = d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]

    def top(self, at: np.ndarray) -> np.ndarray:
        """32 bits from each place; the last 7 may be missing."""
        return self.words[at >> 3] << (at & 7).astype(np.uint32)

    def take(self, at: np.ndarray, n) -> np.ndarray:
        """Numbers of n bits, at most 25."""
        return (self.top(at) >> np.uint32(1) >> (31 - np.asarray(n)).astype(np.uint32)).astype(np.int64)

    def unary(self, at: np.ndarray) -> np.ndarray:
        zeros = _ZEROS[self.top(at) >> np.uint32(16)]
        more = np.flatnonzero(zeros == 16)
        while len(more):
            again = _ZEROS[self.top(at[more] + zeros[more]) >> np.uint32(16)]
            zeros[more] += again
            more = more[again == 16]
        return zeros


def _signed(v: np.ndarray, n: int) -> np.ndarray:
    return v - (v >> n - 1 << n)


def _samples(bits: _Bits, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Samples of the frames that begin at these bytes, whose headers have been verified."""
    lead = data[begin + 4].astype(np.int64)
    sized = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [1, 2, 3, 4, 5], 6)
    head = data[begin + 5 + sized].astype(np.int64)
    at = (begin + 6 + sized).astype(np.int64) * 8
    kind = head >> 1
    if (head & 0x81).any():
        raise ValueError("wasted bits or a broken subframe")
    out = np.zeros((len(begin), BLOCK), np.int64)
    plain = np.flatnonzero(kind <= 1)
    if len(plain):
        byte = (at[plain] >> 3)[:, None] + np.where(kind[plain] == 1, 1, 0)[:, None] * np.arange(BLOCK)
        out[plain] = (data[byte] ^ 0x80).astype(np.int64) - 128
    lanes = np.flatnonzero(kind > 1)
    if not len(lanes):
        return out
    kind, at = kind[lanes], at[lanes]
    lpc = kind >= 32
    order = np.where(lpc, kind - 31, kind - 8)
    if (~lpc & ((order < 0) | (order > 4))).any():
        raise ValueError("reserved subframe type")
    # lanes in ascending order of their predictors, so that those that have begun are a prefix
    sort = np.argsort(order, kind="stable")
    lanes, at, lpc, order = lanes[sort], at[sort], lpc[sort], order[sort]
    e = np.zeros((BLOCK, len(lanes)), np.int64)
    top = int(order.max())
    for t in range(top):
        on = order > t
        e[t, on] = _signed(bits.take(at[on], 8), 8)
        at[on] += 8
    coefs, shift = np.zeros((32, len(lanes)), np.int64), np.zeros(len(lanes), np.int64)
    if lpc.any():
        precision = np.where(lpc, bits.take(at, 4) + 1, 1)
        at += np.where(lpc, 4, 0)
        shift = np.where(lpc, _signed(bits.take(at, 5), 5), 0)
        at += np.where(lpc, 5, 0)
        for j in range(top):
            on = lpc & (order > j)
            v = bits.take(at[on], precision[on])
            coefs[j, on] = v - (v >> precision[on] - 1 << precision[on])
            at[on] += precision[on]
    method, split = bits.take(at, 2), bits.take(at + 2, 4)
    at += 6
    if (method > 1).any() or (BLOCK % (1 << split)).any():
        raise ValueError("reserved residual coding")
    wide = 4 + method
    each = BLOCK >> split
    k = np.zeros(len(lanes), np.int64)
    begun = np.searchsorted(order, np.arange(BLOCK), "right")
    uniform = not split.any()
    for t in range(BLOCK):
        n = begun[t]
        if t <= top or not uniform:
            fresh = np.flatnonzero((order[:n] == t) | (t > order[:n]) & (t % each[:n] == 0))
            if len(fresh):
                k[fresh] = bits.take(at[fresh], wide[fresh])
                at[fresh] += wide[fresh]
                if (k[fresh] == (1 << wide[fresh]) - 1).any():
                    raise ValueError("escaped partition")
        if not n:
            continue
        place, low = at[:n], k[:n]
        zeros = bits.unary(place)
        place += zeros + 1
        u = zeros << low | bits.take(place, low)
        place += low
        e[t, :n] = u >> 1 ^ -(u & 1)
    for o in range(1, min(4, top) + 1):
        cols = np.flatnonzero(~lpc & (order == o))
        if len(cols):
            x = e[:, cols]
            seeds = [x[:o]]
            for _ in range(o):
                seeds.append(np.diff(seeds[-1], axis=0))
            for level in range(o - 1, -1, -1):
                x[level] = seeds[level][0]
                x[level:] = np.cumsum(x[level:], axis=0)
            e[:, cols] = x
    for o in np.unique(order[lpc]).tolist():
        cols = np.flatnonzero(lpc & (order == o))
        x, c, s = e[:, cols], coefs[:o, cols], shift[cols]
        for t in range(o, BLOCK):
            x[t] += sum(c[j] * x[t - 1 - j] for j in range(o)) >> s
        e[:, cols] = x
    out[lanes] = e.T
    return out


def _stretches(parts: list[tuple[bytes, int, int, int, int]]) -> list[bytes]:
    """PCM of stretches (file, begin, end, first sample, samples), each from a point to seek to the next."""
    data = np.frombuffer(b"".join(m[a:b] for m, a, b, _, _ in parts), np.uint8)
    ends = np.cumsum([b - a for _, a, b, _, _ in parts])
    counts = np.array([n // BLOCK for *_, n in parts])
    begin, _ = _find(data, ends - [b - a for _, a, b, _, _ in parts], ends, counts, np.array([first // BLOCK for *_, first, _ in parts]))
    bits = _Bits(data)
    raw = b"".join((_samples(bits, data, begin[i : i + AT_ONCE]) + 128).astype(np.uint8).tobytes() for i in range(0, len(begin), AT_ONCE))
    upto = np.cumsum(counts * BLOCK).tolist()
    return [raw[a:b] for a, b in zip([0, *upto[:-1]], upto, strict=True)]


def decode_blocks(media: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """The PCM blocks of FLAC files as (sample offset, unsigned samples), from seek point to seek point; raises if a checksum or the MD5 of the samples is wrong."""
    infos = [_info(m) for m in media]
    parts = []
    for m, (samples, _, points) in zip(media, infos, strict=True):
        for (first, at), (after, end) in zip(points, [*points[1:], (samples, len(m))], strict=True):
            parts.append((m, at, end, first, after - first))
    pcm = iter(_stretches(parts) if parts else ())
    out = []
    for _, md5, points in infos:
        out.append([(first, next(pcm)) for first, _ in points])
        if hashlib.md5((np.frombuffer(b"".join(b for _, b in out[-1]), np.uint8) ^ 0x80).tobytes(), usedforsecurity=False).digest() != md5:
            raise ValueError("the samples' MD5 is wrong")
    return out


def decode_media(media: list[bytes]) -> list[bytes]:
    """The payloads of FLAC files."""
    return [b"".join(b for _, b in blocks) for blocks in decode_blocks(media)]


def seeks(wanted: list[tuple[bytes, int, int]]) -> list[bytes]:
    """For each (file, sample, count) the samples from there on, by the seek tables: only the stretches that hold them are read; fewer at the end."""
    parts, each = [], []
    for media, sample, count in wanted:
        samples, _, points = _info(media)
        ends = [*points[1:], (samples, len(media))]
        own = [(media, x[1], y[1], x[0], y[0] - x[0]) for x, y in zip(points, ends, strict=True) if x[0] < sample + count and y[0] > sample]
        parts += own
        each.append((len(own), sample - own[0][3] if own else 0, count))
    pcm = iter(_stretches(parts) if parts else ())
    return [b"".join(next(pcm) for _ in range(n))[begin:][:count] for n, begin, count in each]


def seek(media: bytes, sample: int, count: int) -> bytes:
    return seeks([(media, sample, count)])[0]


def padded(content: bytes) -> bytes:
    return content + b" " * (-len(content) % BLOCK if content else BLOCK)


def to_flac(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with all its columns, n_bytes of the UTF-8 text, and `media`, its bytes padded with blanks to whole frames as a FLAC file. Null counts as empty; empty gives one frame of blanks; equal texts give equal files."""
    docs = docs.drop("n_bytes", "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, 1 << 20):
            contents = [(t or "").encode() for t in batch.column(text_col).to_pylist()]
            media = encode_payloads([padded(c) for c in contents])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(len, contents), pa.int64()), pa.array(media, pa.binary())], names=[*batch.schema.names, "n_bytes", "media"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("n_bytes", LongType()), StructField("media", BinaryType())]))


def features(payload: bytes) -> str:
    """Loudness, zero crossings and peak of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int32) - 128
    return f"rms={np.sqrt((x * x).mean()):.4f};zero_crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};peak={int(np.abs(x).max())}"


#: PCM blocks as from_flac() gives them.
PCM = "array<struct<sample_offset:bigint,pcm:binary>>"


def from_flac(rows: DataFrame, media_col: str = "media", keep_pcm: bool = True) -> DataFrame:
    """rows without the media, and payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_blocks, seek_offset, seek_crc32 and, if wanted, pcm.

    All come from the decoded media. pcm holds the blocks with their sample offsets; seek_crc32 is that of the samples
    from seek_offset on, the last point to seek, read by the seek table alone. Null media give nulls. Columns of these
    names are replaced. A file is held whole by the task that reads it.
    """
    made = StructType.fromDDL("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_blocks long, seek_offset long, seek_crc32 long" + f", pcm {PCM}" * keep_pcm)
    others = [f for f in rows.schema.fields if f.name != media_col and f.name not in made.names]
    arrow = rows.sparkSession.createDataFrame([], made).toArrow().schema

    def values(m: bytes, blocks: list[tuple[int, bytes]], end: bytes) -> tuple:
        p = b"".join(b for _, b in blocks)
        found = (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), features(p), len(blocks), blocks[-1][0], zlib.crc32(end))
        return found + ([{"sample_offset": at, "pcm": b} for at, b in blocks],) * keep_pcm

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, media_col, 1 << 20):
            media = batch.column(media_col).to_pylist()
            there = [m for m in media if m is not None]
            decoded = decode_blocks(there)
            # a file of one block has no other point to seek to
            ends = iter(seeks([(m, blocks[-1][0], BLOCK * SEEK_EVERY) for m, blocks in zip(there, decoded, strict=True) if len(blocks) > 1]))
            rows = iter([values(m, blocks, next(ends) if len(blocks) > 1 else blocks[0][1]) for m, blocks in zip(there, decoded, strict=True)])
            found = [(None,) * len(made) if m is None else next(rows) for m in media]
            columns = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), *columns], names=[*(f.name for f in others), *made.names])

    return rows.mapInArrow(run, StructType([*others, *made.fields]))


def stored_pcm(decoded: DataFrame) -> DataFrame:
    """Rows of from_flac() with their PCM blocks, written to the shared folder and read from there."""
    return written(decoded, "pcm", compression="zstd")


def from_pcm(rows: DataFrame) -> DataFrame:
    """rows without pcm; payload_bytes, payload_sha256, tail_crc32, feature, n_blocks and seek_crc32 are those of the blocks.

    Blocks must stand at the sums of the lengths before them, else it is an error; seek_crc32 is that of the block found
    at seek_offset by its sample offset. Rows without blocks (null) have nulls.
    """
    made = ["payload_bytes", "payload_sha256", "tail_crc32", "feature", "n_blocks", "seek_crc32"]
    others = [f for f in rows.schema.fields if f.name not in (*made, "pcm")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def values(blocks: list[dict] | None, seek_offset: int) -> tuple:
        if blocks is None:
            return (None,) * len(made)
        offsets, pcm = [b["sample_offset"] for b in blocks], [b["pcm"] for b in blocks]
        if offsets != [0, *itertools.accumulate(map(len, pcm[:-1]))]:
            raise ValueError("PCM blocks are not where their offsets say")
        payload = b"".join(pcm)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), features(payload), len(pcm), zlib.crc32(pcm[bisect.bisect_right(offsets, seek_offset) - 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [values(b, o) for b, o in zip(part.column("pcm").to_pylist(), part.column("seek_offset").to_pylist(), strict=True)]
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in others), *columns], names=[*(f.name for f in others), *made])

    schema = StructType([*others, *StructType.fromDDL("payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, n_blocks long, seek_crc32 long").fields])
    return rows.mapInArrow(run, schema)


def pcm_blocks(decoded: DataFrame) -> DataFrame:
    """Rows of from_flac() by block: all columns but pcm, and block (its number), sample_offset, pcm (unsigned samples)."""
    (inner,) = new_names(decoded, "inner")
    rows = decoded.select(*(F.col(f"`{c}`") for c in decoded.columns if c != "pcm"), F.posexplode("pcm").alias("block", inner))
    return rows.select("*", f"{inner}.sample_offset", f"{inner}.pcm").drop(inner)
