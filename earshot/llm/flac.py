"""FLAC streams as columns: lossless storage, checked decoding, PCM blocks with seekable offsets.

Streams hold one channel of 8-bit samples (a byte b is the sample b - 128) in
frames of 576 samples, with a seek point for every frame. Encoding and decoding
work on the frames of many streams at once: arrays run over frames, loops over
the samples of a frame. Frames are decoded independently of each other from the
seek table; a stream without a full table is walked frame by frame.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm.common import chunks, schema_with, table, with_columns

BLOCK = 576
RATE = 8000
#: Frames that are coded together; bounds the memory of the bit arrays.
FRAMES = 3000

# The format's two checksums, by polynomial and width.
CRC8, CRC16 = (0x07, 8), (0x8005, 16)


@cache
def _crc_table(poly: int, width: int) -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        crc = np.where(crc >> (width - 1) & 1, crc << 1 ^ poly, crc << 1) & ((1 << width) - 1)
    return crc.astype(np.uint16)


_by_distance: dict[tuple[int, int], np.ndarray] = {}


def _distance_tables(kind: tuple[int, int], length: int) -> np.ndarray:
    """Row d: what a byte with d bytes after it adds to the checksum."""
    have = _by_distance.get(kind)
    if have is None or len(have) < length:
        one = _crc_table(*kind)
        width = kind[1]
        out = np.empty((max(length, 1024), 256), np.uint16)
        out[0] = one
        for d in range(1, len(out)):
            now = out[d - 1].astype(np.uint32)
            out[d] = (now << 8 & ((1 << width) - 1)) ^ one[now >> (width - 8)]
        _by_distance[kind] = have = out
    return have


def crc_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: tuple[int, int]) -> np.ndarray:
    """Checksums of many byte ranges: a CRC is linear, so each byte's share follows from its distance to the end."""
    lengths = ends - starts
    if not len(lengths):
        return np.zeros(0, np.uint16)
    first = np.cumsum(lengths) - lengths
    inside = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    shares = _distance_tables(kind, int(lengths.max())).ravel()[(np.repeat(lengths - 1, lengths) - inside) * 256 + data[np.repeat(starts, lengths) + inside]]
    return np.bitwise_xor.reduceat(shares, first)


# ---------------------------------------------------------------- encoding


def _coded_number(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers in the format's variable-length code: bytes (n x 7) and their count."""
    limits = np.array([1 << 7, 1 << 11, 1 << 16, 1 << 21, 1 << 26, 1 << 31])
    size = 1 + np.searchsorted(limits, n, side="right")
    out = np.zeros((len(n), 7), np.uint8)
    for k in np.unique(size):
        at = np.flatnonzero(size == k)
        if k == 1:
            out[at, 0] = n[at]
            continue
        for j in range(int(k)):
            part = n[at] >> (6 * (int(k) - 1 - j))
            out[at, j] = (part & 0x3F | 0x80) if j else part | (0xFF << (8 - int(k)) & 0xFF)
    return out, size


def _predict(x: np.ndarray, order: int) -> np.ndarray:
    for _ in range(order):
        x = np.diff(x, axis=1)
    return x


def _encode_frames(samples: np.ndarray, numbers: np.ndarray, max_order: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all frames, one after the other, and their starts (with the end)."""
    n = len(samples)
    options = [_predict(samples, p) for p in range(max_order + 1)]
    order = np.argmin([np.abs(r).sum(axis=1) + 8 * p for p, r in enumerate(options)], axis=0)
    folded = np.zeros((n, BLOCK), np.int32)
    live = np.arange(BLOCK)[None, :] >= order[:, None]
    for p, r in enumerate(options):
        at = order == p
        folded[at, p:] = (r[at] << 1) ^ (r[at] >> 31)
    costs = np.stack([(folded >> k).sum(axis=1) + k * (BLOCK - order) for k in range(14)])
    rice = np.argmin(costs, axis=0)
    number, number_size = _coded_number(numbers)
    header = 4 + number_size + 1
    width = np.where(live, (folded >> rice[:, None]) + 1 + rice[:, None], 8)  # warm-up samples take eight bits
    code_start = 8 * header + 8  # the subframe's own header
    warm = 8 * order
    # warm-up samples come first, then ten bits of coding method, partition order and parameter
    ends = np.cumsum(width, axis=1)
    size = header + (8 + ends[:, -1] + 10 + 7) // 8 + 2
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(size, out=starts[1:])
    bits = np.zeros(8 * int(starts[-1]), np.uint8)
    base = 8 * starts[:-1] + code_start
    # residual codes
    where = base[:, None] + 10 + ends - width
    stop = (where + (folded >> rice[:, None]))[live]
    bits[stop] = 1
    value, k_of = folded[live], np.broadcast_to(rice[:, None], folded.shape)[live]
    for j in range(int(rice.max())):
        some = k_of > j
        bits[stop[some] + 1 + j] = value[some] >> (k_of[some] - 1 - j) & 1
    # warm-up samples
    for p in range(int(order.max())):
        at = np.flatnonzero(order > p)
        for j in range(8):
            bits[base[at] + 8 * p + j] = (samples[at, p] & 0xFF) >> (7 - j) & 1
    for j in range(4):
        bits[base + warm + 6 + j] = rice >> (3 - j) & 1
    out = np.packbits(bits)
    # fixed values of the frame header: sync, 576 samples, rate from the stream's header, one channel of 8 bits
    for j, b in enumerate((0xFF, 0xF8, 0x20, 0x02)):
        out[starts[:-1] + j] = b
    for j in range(7):
        at = np.flatnonzero(number_size > j)
        out[starts[at] + 4 + j] = number[at, j]
    out[starts[:-1] + header - 1] = crc_of(out, starts[:-1], starts[:-1] + header - 1, CRC8)
    out[starts[:-1] + header] = (0x08 | order) << 1
    check = crc_of(out, starts[:-1], starts[1:] - 2, CRC16)
    out[starts[1:] - 2], out[starts[1:] - 1] = check >> 8, check & 0xFF
    return out, starts


def encode(payloads: list[bytes], max_order: int = 2) -> list[bytes]:
    """A stream for each payload, whose length is a positive multiple of 576."""
    counts = np.array([len(p) // BLOCK for p in payloads], np.int64)
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK).astype(np.int32) - 128
    numbers = np.arange(len(samples)) - np.repeat(np.cumsum(counts) - counts, counts)
    parts = [_encode_frames(samples[i : i + FRAMES], numbers[i : i + FRAMES], max_order) for i in range(0, len(samples), FRAMES)]
    data = np.concatenate([p for p, _ in parts]) if len(parts) > 1 else parts[0][0]
    sizes = np.concatenate([np.diff(s) for _, s in parts])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out, at = [], 0
    signed = (samples & 0xFF).astype(np.uint8)
    for n in counts:
        own, mine = sizes[at : at + n], starts[at : at + n]
        total = int(n) * BLOCK
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | total).to_bytes(8, "big") + hashlib.md5(signed[at : at + n]).digest()
        seek = np.zeros(int(n), np.dtype([("sample", ">u8"), ("byte", ">u8"), ("samples", ">u2")]))
        seek["sample"], seek["byte"], seek["samples"] = np.arange(n) * BLOCK, mine - mine[0], BLOCK
        table_bytes = seek.tobytes()
        # a block's size has 24 bits; a longer table is left out and such a stream is walked
        blocks = b"\x00\x00\x00\x22" + info + b"\x83" + len(table_bytes).to_bytes(3, "big") + table_bytes if len(table_bytes) < 1 << 24 else b"\x80\x00\x00\x22" + info
        out.append(b"fLaC" + blocks + data[mine[0] : mine[0] + int(own.sum())].tobytes())
        at += int(n)
    return out


# ---------------------------------------------------------------- decoding


class BadStream(ValueError):
    """A stream that breaks the format or fails a checksum."""


def _header(stream: bytes) -> tuple[int, int, bytes, np.ndarray | None, int]:
    """Total samples, bits, MD5, seek points and the first frame's place."""
    if stream[:4] != b"fLaC":
        raise BadStream("no stream marker")
    at, info, seek, last = 4, b"", None, False
    while not last:
        if at + 4 > len(stream):
            raise BadStream("cut off in its metadata")
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            info = body
        elif kind == 3:
            seek = np.frombuffer(body[: size // 18 * 18], np.dtype([("sample", ">u8"), ("byte", ">u8"), ("samples", ">u2")]))
        at += 4 + size
    if len(info) < 34:
        raise BadStream("no stream info")
    packed = int.from_bytes(info[10:18], "big")
    if packed >> 41 & 7:
        raise BadStream("more than one channel")
    return packed & ((1 << 36) - 1), (packed >> 36 & 31) + 1, info[18:34], seek, at


class _Bits:
    """Bits of a byte buffer: the next one at or after a place, and short unsigned values at a place."""

    def __init__(self, data: np.ndarray):
        bits = np.unpackbits(data)
        n = len(bits)
        place = np.where(bits, np.arange(n, dtype=np.int32), np.int32(n))
        self.next_one = np.append(np.minimum.accumulate(place[::-1])[::-1], np.int32(n)).astype(np.int32)
        padded = np.append(data, np.zeros(8, np.uint8)).astype(np.uint64)
        self.words = padded[:-4] << 32 | padded[1:-3] << 24 | padded[2:-2] << 16 | padded[3:-1] << 8 | padded[4:]

    def value(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """``width`` bits (up to 32) from ``at`` on."""
        window = self.words[at >> 3] << (at & 7).astype(np.uint64) & np.uint64(0xFFFFFFFFFF)
        return (window >> (np.uint64(40) - np.asarray(width).astype(np.uint64))).astype(np.int64)

    def signed(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        raw = self.value(at, width)
        return raw - ((raw >> (np.asarray(width) - 1) & 1) << np.asarray(width))


# The format's codes for block sizes; 6 and 7 give the size in the header itself.
BLOCK_CODES = np.array([0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768])


def _decode_frames(data: np.ndarray, starts: np.ndarray, ends: np.ndarray | None, bits_of: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Samples of each frame, the frames' ends, and each frame's predictor order and first Rice parameter.

    ``ends`` may be unknown; the checksum then covers what was read.
    """
    n = len(starts)
    if not n:
        return [], starts, starts, starts
    if int(starts.max()) + 6 > len(data):
        raise BadStream("cut off in a frame's header")
    if ((data[starts] != 0xFF) | (data[starts + 1] & 0xFE != 0xF8)).any():
        raise BadStream("no frame where one should begin")
    size_code, rate_code = data[starts + 2] >> 4, data[starts + 2] & 15
    first = data[starts + 4]
    extra = np.where(first < 0x80, 0, np.argmin(np.unpackbits(first[:, None], axis=1), axis=1) - 1)
    at = starts + 5 + extra
    blocks = BLOCK_CODES[size_code].copy()
    padded = np.append(data, np.zeros(4, np.uint8)).astype(np.int64)
    blocks = np.where(size_code == 6, padded[at] + 1, np.where(size_code == 7, (padded[at] << 8 | padded[at + 1]) + 1, blocks))
    at = at + (size_code == 6) + 2 * (size_code == 7) + (rate_code == 12) + 2 * ((rate_code == 13) | (rate_code == 14))
    if (padded[at] != crc_of(data, starts, at, CRC8)).any():
        raise BadStream("a frame header's checksum is wrong")
    subframe = padded[at + 1]
    kind = subframe >> 1 & 0x3F
    if (subframe & 1).any():
        raise BadStream("wasted bits are not supported")
    reader = _Bits(data)
    place = 8 * (at + 2)
    out: list[np.ndarray] = [np.zeros(0)] * n
    order = np.where(kind >= 32, kind - 31, np.where(kind >= 8, kind - 8, 0))
    rice = np.zeros(n, np.int64)
    finish = np.zeros(n, np.int64)
    for key in {(int(k), int(b)) for k, b in zip(kind, blocks, strict=True)}:
        some = np.flatnonzero((kind == key[0]) & (blocks == key[1]))
        values, stop, param = _subframes(reader, place[some], key[0], key[1], bits_of)
        finish[some], rice[some] = stop, param
        for i, row in zip(some, values, strict=True):
            out[i] = row
    over = (finish + 7) // 8 + 2
    if int(over.max()) > len(data) or (ends is not None and (over != ends).any()):
        raise BadStream("a frame's length is wrong")
    if (crc_of(data, starts, over - 2, CRC16) != (padded[over - 2] << 8 | padded[over - 1])).any():
        raise BadStream("a frame's checksum is wrong")
    return out, over, order, rice


def _subframes(reader: _Bits, at: np.ndarray, kind: int, block: int, bits_of: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples of subframes of one kind and block size, their ends, and their first Rice parameter."""
    n = len(at)
    values = np.zeros((n, block), np.int64)
    none = np.zeros(n, np.int64)
    if kind == 0:
        values[:] = reader.signed(at, bits_of)[:, None]
        return values, at + bits_of, none
    if kind == 1:
        for i in range(block):
            values[:, i] = reader.signed(at + i * bits_of, bits_of)
        return values, at + block * bits_of, none
    if not (8 <= kind <= 12 or kind >= 32):
        raise BadStream("a reserved kind of subframe")
    order = kind - 8 if kind < 32 else kind - 31
    for i in range(order):
        values[:, i] = reader.signed(at, bits_of)
        at = at + bits_of
    weights = shift = None
    if kind >= 32:
        precision = reader.value(at, 4) + 1
        shift = reader.signed(at + 4, 5)
        at = at + 9
        weights = np.zeros((n, order), np.int64)
        for i in range(order):
            weights[:, i] = reader.signed(at, precision)
            at = at + precision
    method, parts = reader.value(at, 2), reader.value(at + 2, 4)
    if (method > 1).any():
        raise BadStream("a reserved coding method")
    at = at + 6
    wide = np.where(method == 0, 4, 5)
    part_size = block >> parts
    param, escaped, first = none, np.zeros(n, bool), none
    last = len(reader.next_one) - 1
    same = bool((parts == 0).all())
    for i in range(order, block):
        if i == order or not same:
            begins = (i % part_size == 0) | (i == order)
            if begins.any():
                read = reader.value(at, wide)
                escape = begins & (read == (1 << wide) - 1)
                at = at + np.where(begins, wide, 0)
                raw = reader.value(at, 5)
                param = np.where(escape, raw, np.where(begins, read, param))
                escaped = np.where(begins, escape, escaped)
                at = at + np.where(escape, 5, 0)
                first = param if i == order else first
                plain = not escaped.any()
        one = reader.next_one[np.minimum(at, last)].astype(np.int64)
        if plain:
            high, at = one - at, one + 1
            if int(at.max()) > last:
                raise BadStream("cut off in a residual")
            code = high << param | reader.value(at, param)
            values[:, i] = code >> 1 ^ -(code & 1)
        else:
            high, at = np.where(escaped, 0, one - at), np.where(escaped, at, one + 1)
            if int(at.max()) > last:
                raise BadStream("cut off in a residual")
            code = high << param | reader.value(at, param)
            raw = np.where(param > 0, code - ((code >> np.maximum(param - 1, 0) & 1) << param), 0)
            values[:, i] = np.where(escaped, raw, code >> 1 ^ -(code & 1))
        at = at + param
    if weights is not None:
        for i in range(order, block):
            guess = (weights * values[:, i - order : i][:, ::-1]).sum(axis=1)
            values[:, i] += guess >> np.maximum(shift, 0)
    else:
        # undo the differences one order at a time, each from the last warm-up difference on
        for p in range(order, 0, -1):
            seed = _predict(values[:, :order], p - 1)[:, -1:] if p > 1 else values[:, order - 1 : order]
            values[:, order:] = np.cumsum(np.concatenate([seed, values[:, order:]], axis=1), axis=1)[:, 1:]
    return values, at, first


def decode(streams: list[bytes | None]) -> list[list[tuple[int, int, int, int, bytes]] | None]:
    """For each stream its PCM blocks: sample offset, samples, predictor order, Rice parameter, bytes.

    Samples come back as the bytes sample + 128. A null stream gives null. A
    stream that is cut off or fails a checksum raises ``BadStream``.
    """
    heads = [None if s is None else _header(s) for s in streams]
    out: list = [None] * len(streams)
    group: list[int] = []
    frames = 0

    def run() -> None:
        starts, ends, parts, base = [], [], [], 0
        for i in group:
            total, _, _, seek, at = heads[i]
            own = seek["byte"].astype(np.int64)
            starts.append(base + own)
            ends.append(base + np.append(own[1:], len(streams[i]) - at))
            parts.append(np.frombuffer(streams[i], np.uint8)[at:])
            base += len(parts[-1])
        # long streams are cut between frames, so that the bit arrays stay small
        data, begin, finish = np.concatenate(parts), np.concatenate(starts), np.concatenate(ends)
        values, orders, rices = [], [], []
        for j in range(0, len(begin), FRAMES):
            lo, hi = int(begin[j]), int(finish[min(j + FRAMES, len(begin)) - 1])
            v, _, o, r = _decode_frames(data[lo:hi], begin[j : j + FRAMES] - lo, finish[j : j + FRAMES] - lo, 8)
            values += v
            orders.append(o)
            rices.append(r)
        orders, rices = np.concatenate(orders), np.concatenate(rices)
        at = 0
        for i, own in zip(group, starts, strict=True):
            out[i] = _blocks(values[at : at + len(own)], orders[at : at + len(own)], rices[at : at + len(own)], heads[i])
            at += len(own)
        group.clear()

    for i, head in enumerate(heads):
        if head is None:
            continue
        total, bits_of, _, seek, at = head
        if bits_of != 8:
            raise BadStream("samples of other than eight bits")
        full = seek is not None and len(seek) > 0 and int(seek["samples"].sum()) == total and int(seek["byte"][-1]) < len(streams[i]) - at
        if full:
            group.append(i)
            frames += len(seek)
            if frames >= FRAMES:
                run()
                frames = 0
            continue
        data, place, values, orders, rices = np.frombuffer(streams[i], np.uint8), at, [], [], []
        while place < len(data):
            window = data[place : place + (1 << 18)]
            v, over, o, r = _decode_frames(window, np.zeros(1, np.int64), None, 8)
            place += int(over[0])
            values += v
            orders.append(int(o[0]))
            rices.append(int(r[0]))
        out[i] = _blocks(values, np.array(orders), np.array(rices), head)
    if group:
        run()
    return out


def _blocks(values: list[np.ndarray], orders: np.ndarray, rices: np.ndarray, head: tuple) -> list[tuple[int, int, int, int, bytes]]:
    total, _, md5, _, _ = head
    signed = [v.astype(np.uint8) for v in values]
    if sum(map(len, signed)) != total or hashlib.md5(b"".join(signed)).digest() != md5:
        raise BadStream("the samples do not match the stream's header")
    out, at = [], 0
    for v, o, r in zip(signed, orders, rices, strict=True):
        out.append((at, len(v), int(o), int(r), (v ^ 0x80).tobytes()))
        at += len(v)
    return out


# ---------------------------------------------------------------- operators

BLOCKS = "array<struct<sample_offset:bigint,samples:int,predictor:int,rice:int,pcm:binary>>"


def payload_of(text: str | None) -> bytes:
    """UTF-8 of a text (null: empty) with bytes 255 up to a positive multiple of the block."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def store_flac(df: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """``df`` without its text and with the text's payload as a FLAC stream in ``media_col``.

    Null and empty texts give one block of 255s; equal texts give equal streams.
    Other columns pass through; a column already named ``media_col`` is an error.
    """
    rest = df.drop(text_col)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            others = pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != at], names=[n for i, n in enumerate(batch.schema.names) if i != at])
            for first, some in chunks(texts):
                media = encode([payload_of(t) for t in some])
                yield with_columns(others.slice(first, len(some)), {media_col: pa.array(media, pa.binary())})

    return df.mapInArrow(run, schema_with(rest, f"{media_col} binary"))


def read_flac(df: DataFrame, media_col: str = "media", blocks_col: str = "blocks") -> DataFrame:
    """``df`` with the PCM blocks of its streams: sample offset, samples, predictor order, Rice parameter and bytes.

    Explode ``blocks_col`` for a row per block; a sample s lies in the block
    whose sample_offset is the greatest not above s. A null stream gives null
    blocks; a damaged one fails with ``BadStream``.
    """
    at = df.columns.index(media_col)
    kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("samples", pa.int32()), ("predictor", pa.int32()), ("rice", pa.int32()), ("pcm", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in kind.value_type]
        for batch in batches:
            sizes, first = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), 0
            while first < batch.num_rows:
                reach = int(np.searchsorted(np.cumsum(sizes[first:]), 1 << 20)) + 1
                part = batch.slice(first, reach)
                found = decode(part.column(at).to_pylist())
                flat = [b for blocks in found for b in blocks or ()]
                fields = [pa.array([b[j] for b in flat], kind.value_type.field(j).type) for j in range(5)]
                offsets, total = [], 0
                for blocks in found:
                    offsets.append(None if blocks is None else total)
                    total += len(blocks or ())
                lists = pa.ListArray.from_arrays(pa.array([*offsets, total], pa.int32()), pa.StructArray.from_arrays(fields, names=names))
                yield with_columns(part, {blocks_col: lists})
                first += reach

    return df.mapInArrow(run, schema_with(df, f"{blocks_col} {BLOCKS}"))


def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    read = read_flac(store_flac(docs))
    payload = F.unhex(F.array_join(F.transform("blocks", lambda b: F.hex(b["pcm"])), ""))
    total = lambda field: F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b[field])
    read = read.withColumn("payload", payload)
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("blocks"), total("predictor"), total("rice"), F.length("media")).alias("feature"),
    )
