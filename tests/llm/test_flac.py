import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from earshot.llm import flac


def back(streams):
    return [b"".join(b[4] for b in blocks) for blocks in flac.decode(streams)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=1500), min_size=1, max_size=4), st.integers(0, 4))
def test_round_trip(raws, order):
    payloads = [r + b"\xff" * (-len(r) % flac.BLOCK) for r in raws]
    assert back(flac.encode(payloads, order)) == payloads


def test_equal_payloads_equal_streams_whatever_stands_beside():
    one, two = b"a" * flac.BLOCK, bytes(range(256)) * 9
    alone = flac.encode([one])[0]
    assert flac.encode([two, one, two])[1] == alone


def test_long_streams_have_long_frame_numbers():
    payload = (np.arange(flac.BLOCK * 2500) % 251).astype(np.uint8).tobytes()
    assert back(flac.encode([payload])) == [payload]


def test_blocks_seek():
    blocks = flac.decode(flac.encode([bytes(flac.BLOCK * 3)]))[0]
    assert [b[0] for b in blocks] == [0, 576, 1152]


def test_stream_without_seek_table():
    payload = bytes(np.random.default_rng(0).integers(60, 90, flac.BLOCK * 4, dtype=np.uint8))
    stream = flac.encode([payload])[0]
    size = int.from_bytes(stream[43:46], "big")
    bare = stream[:4] + b"\x80" + stream[5:42] + stream[46 + size :]
    assert back([bare]) == [payload]


@pytest.mark.parametrize("place", [60, 200, -3, -1, 30])
def test_damage_is_found(place):
    stream = bytearray(flac.encode([(b"some text that is long enough" * 100)[:2880]])[0])
    stream[place] ^= 4
    with pytest.raises((flac.BadStream, IndexError)):
        flac.decode([bytes(stream)])


def bits_of(*fields):
    text = "".join(format(v & ((1 << n) - 1), f"0{n}b") for v, n in fields if n)
    return text


def frame_of(body: str, block: int) -> bytes:
    """A frame with the given subframe, its block size in the header."""
    head = bytes([0xFF, 0xF8, 0x70, 0x02, 0]) + (block - 1).to_bytes(2, "big")
    one = np.frombuffer(head, np.uint8)
    at = np.array([0]), np.array([len(one)])
    head += bytes([int(flac.crc_of(one, *at, flac.CRC8)[0])])
    body += "0" * (-len(body) % 8)
    data = head + int(body, 2).to_bytes(len(body) // 8, "big")
    whole = np.frombuffer(data, np.uint8)
    return data + int(flac.crc_of(whole, np.array([0]), np.array([len(whole)]), flac.CRC16)[0]).to_bytes(2, "big")


def rice(values, k):
    out = ""
    for v in values:
        u = v << 1 if v >= 0 else (-v << 1) - 1
        out += "0" * (u >> k) + "1" + (format(u & ((1 << k) - 1), f"0{k}b") if k else "")
    return out


def test_linear_predictor_with_partitions_and_escape():
    """x[n] = (3 x[n-1] - x[n-2]) >> 1 plus a residual; second partition escaped to raw bits."""
    rng = np.random.default_rng(4)
    residual = rng.integers(-3, 4, 16).tolist()
    x = [5, -2]
    for n in range(2, 16):
        x.append(((3 * x[n - 1] - x[n - 2]) >> 1) + residual[n])
        if not -128 <= x[-1] < 128:
            residual[n] -= x[-1]
            x[-1] = 0
    body = bits_of((0, 1), (33, 6), (0, 1), (x[0], 8), (x[1], 8), (3, 4), (1, 5), (3, 4), (-1, 4), (0, 2), (1, 4), (1, 4))
    body += rice(residual[2:8], 1) + bits_of((15, 4), (9, 5)) + bits_of(*[(v, 9) for v in residual[8:]])
    data = np.frombuffer(frame_of(body, 16), np.uint8)
    values, over, order, _ = flac._decode_frames(data, np.zeros(1, np.int64), None, 8)
    assert values[0].tolist() == x and over[0] == len(data) and order[0] == 2


@pytest.mark.parametrize("kind, body, wanted", [(0, [(7, 8)], [7] * 16), (1, [(i - 8, 8) for i in range(16)], [i - 8 for i in range(16)])])
def test_constant_and_verbatim(kind, body, wanted):
    data = np.frombuffer(frame_of(bits_of((0, 1), (kind, 6), (0, 1), *body), 16), np.uint8)
    assert flac._decode_frames(data, np.zeros(1, np.int64), None, 8)[0][0].tolist() == wanted


def test_query_digests(spark, edges, tmp_path):
    edges.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.payload_sha256, r.tail_crc32, r.n_bytes, r.payload_bytes) for r in flac.op9_flac(spark, str(tmp_path)).collect()}
    wanted = set()
    for r in edges.collect():
        p = flac.payload_of(r.text)
        wanted.add((r.doc_id, hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len((r.text or "").encode()), len(p)))
    assert got == wanted


def test_nulls_and_no_rows(spark, none):
    assert flac.read_flac(flac.store_flac(none)).collect() == []
    one = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert flac.read_flac(one).first().blocks is None
    with pytest.raises(ValueError):
        flac.store_flac(spark.createDataFrame([(1, "a", "b")], "doc_id long, text string, media string"))
