"""Near-duplicate classes by improved consistent weighted sampling of TF-IDF word shingles.

1. Document frequencies of frequent shingles are counted exactly: a sketch of all
   documents names the shingles that may be frequent, a second pass counts them.
2. Each text gets ``bands * rows`` consistent samples of its weighted shingles;
   two texts agree on a sample with the probability of their weighted Jaccard
   similarity. Equal texts meet by a digest and count as one from here on.
3. Texts with an equal band meet in a bucket. The weighted shingles of those that
   meet another are stored once. A bucket proposes links from hubs to its
   members, never all pairs; links are verified by the exact weighted Jaccard
   similarity of the two texts. Large buckets are dealt to several tasks.
4. Connected components of verified links are classes. Buckets that still hold
   several classes propose links between one member of each from another hub, if
   there is much left to compare: this only makes the rest small.
5. In buckets that hold several classes then, the samples of all members are
   compared, block by block, with those of the other classes; every pair that
   agrees often enough and was not tried is verified, unless sums of weights by
   parts of the shingles rule out that it is a link. No link is left out.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import textvec as tv
from earshot.llm.common import checkpointed, chunks, fresh_names, hot_parts, join_by_parts, ragged, release, salted_join, table, with_parts

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 12, 3
#: Counters of the frequency sketch, and of it the part that a task hands on at once.
SKETCH_BITS, PART_BITS = 20, 14
#: Most shingles whose document frequency is told from the least. A shingle in fewer documents than the number of all
#: (document, shingle) pairs over this counts as one in just as many.
FREQUENT = 1 << 18
#: Hubs of a bucket in the first round.
HUBS = 3
#: Most rounds with other hubs; there is one only if buckets hold more than ``CROSSING`` pairs of different classes for
#: each text. What they leave is compared in full.
ROUNDS, CROSSING = 1, 100
#: Members of a bucket that are compared with as many others at once, and rows of a comparison in memory.
BLOCK, TILE = 8192, 128
#: Bytes of weighted shingles that the pairs verified at once hold, at least; as many as those of all texts in buckets, if that is more.
PART_BYTES = 1 << 27
#: Links whose components a task finds by itself before components of all are sought.
CHUNK_LINKS = 1 << 16
#: How much a rare shingle outweighs one of all documents. Large groups of near copies make what they share frequent: the more
#: that counts, the more copies fall below 0.8 of each other (README).
IDF_SPREAD = 0.25
#: Links whose samples agree less often than this share are not looked at further: 6 standard deviations below 0.8.
LEAST_AGREEMENT = 0.42
#: Parts of a profile of a text, a byte each.
PROFILE = 256
#: Most bits (as a power of two) of the filter that keeps other texts from being read for verification.
FILTER_BITS = 30
#: Tasks that put the filter's parts together, 8 MB each at most.
FILTER_TASKS = 16


# ---------------------------------------------------------------- shingles


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, and each text's first (with the end).

    Words are runs of letters and digits, case folded. A text of fewer words than
    a shingle has is one shingle; a text without words has none.
    """
    arrays = tv.code_points([t.lower() for t in texts])
    w = tv.words(arrays, tv.letters_digits(arrays.points))
    count = np.diff(w.first)
    h, n = w.hashes, len(w.hashes)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(words, n)):
        rolled[: n - j] = rolled[: n - j] * np.uint64(0x100000001B3) + h[j:]
    many = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(many, out=first[1:])
    at = np.arange(first[-1]) - np.repeat(first[:-1], many) + np.repeat(w.first[:-1], many)
    out = rolled[at]
    for i in np.flatnonzero((count > 0) & (count < words)):
        short = np.uint64(count[i])
        for x in h[w.first[i] : w.first[i + 1]]:
            short = tv.mixed(np.array([short ^ x]))[0]
        out[first[i]] = short
    return tv.mixed(out), first


def _digest(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def digest(text: Column) -> Column:
    """The key of a text."""
    return F.unhex(F.md5(text))


def _by_text(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, rising, the texts that they belong to, and how often they occur there."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.argsort(text.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20))
    h, t = hashes[at], text[at]
    if ((h[1:] < h[:-1]) & (t[1:] == t[:-1])).any():  # hashes of a text that differ in their last bits alone
        at = np.lexsort((hashes, text))
        h, t = hashes[at], text[at]
    start = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))[: len(h)])
    return h[start], t[start], np.diff(np.append(start, len(h)))


def _distinct(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[np.ndarray, int]]:
    """Distinct shingles of each text, those of a chunk together, and how many texts have any."""
    for batch in batches:
        for _, texts in chunks(batch.column(0).to_pylist()):
            hashes, first = shingles(texts, words)
            yield _by_text(hashes, first)[0], int((np.diff(first) > 0).sum())


@dataclass(frozen=True)
class Idf:
    """Weights of shingles: ``weights`` of the frequent ones ``hashes`` (rising), ``rest`` of all others."""

    hashes: np.ndarray
    weights: np.ndarray
    rest: float

    def of(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(shingles), self.rest, np.float32)
        at = np.minimum(np.searchsorted(self.hashes, shingles), len(self.hashes) - 1)
        return np.where(self.hashes[at] == shingles, self.weights[at], np.float32(self.rest))


@dataclass(frozen=True)
class Frequencies:
    """Exact document ``counts`` of all shingles ``hashes`` (rising) of ``floor`` documents or more, among ``documents``."""

    hashes: np.ndarray
    counts: np.ndarray
    floor: int
    documents: int

    def idf(self, spread: float = IDF_SPREAD) -> Idf:
        """From 1 (in every document) to 1 + ``spread`` (in ``floor`` or fewer), by the logarithm of documents over frequency."""
        scale = np.log(self.documents / self.floor) if self.documents > self.floor else 1.0
        share = np.log(self.documents / self.counts) / scale if len(self.counts) else np.zeros(0)
        return Idf(self.hashes, (1 + spread * np.clip(share, 0, 1)).astype(np.float32), float(np.float32(1 + spread)))


def document_frequencies(docs: DataFrame, text_col: str = "text", words: int = WORDS, most: int | None = None, sketch_bits: int | None = None) -> Frequencies:
    """Frequencies of at most ``most`` shingles, over all documents with words; texts are read twice.

    ``floor`` is the number of all pairs of a document and a shingle of it over
    ``most``, so no more than ``most`` shingles can reach it. A counter of the
    sketch is the sum of the frequencies of its shingles: a shingle of ``floor``
    documents lies in a counter of as much, and only such shingles are counted
    one by one. In a corpus of up to ``most`` pairs that is all of them.
    """
    most, bits = most or FREQUENT, sketch_bits or SKETCH_BITS
    part = 1 << min(PART_BITS, bits)
    slot = lambda hashes: (hashes >> np.uint64(64 - bits)).astype(np.int64)
    texts = docs.select(F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())

    def parts_of(held: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(held.reshape(-1, part).any(axis=1))
        rows = [zlib.compress(held[i * part : (i + 1) * part].tobytes(), 1) for i in some]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(rows, pa.binary())], names=["part", "held"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents = np.zeros(1 << bits, np.int64), 0
        for distinct, n in _distinct(batches, words):
            held += np.bincount(slot(distinct), minlength=1 << bits)
            documents += n
        yield parts_of(held)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([zlib.compress(np.array([documents]).tobytes())], pa.binary())], names=["part", "held"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                more = np.frombuffer(zlib.decompress(held), np.int64)
                sums[i] = sums[i] + more if i in sums else more
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["part", "held"])

    schema = "part int, held binary"
    merged = texts.mapInArrow(tally, schema).repartition("part").mapInArrow(merge, schema).toArrow()  # the sketch: a fixed size
    sketch, documents = np.zeros(1 << bits, np.int64), 0
    for i, held in zip(merged.column(0).to_pylist(), merged.column(1).to_pylist(), strict=True):
        got = np.frombuffer(zlib.decompress(held), np.int64)
        if i < 0:
            documents = int(got[0])
        else:
            sketch[i * part : (i + 1) * part] = got
    floor = max(1, -(-int(sketch.sum()) // most))
    may_be = docs.sparkSession.sparkContext.broadcast(sketch >= floor)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            hashes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64)), pa.array(n)], names=["h", "n"])

        for distinct, _ in _distinct(batches, words):
            held.append(distinct[may_be.value[slot(distinct)]])
            size += len(held[-1])
            if size >= 1 << 21:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    # at most `most` rows reach the floor
    got = texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= floor).toArrow()
    hashes = got.column(0).to_numpy().astype(np.uint64)
    at = np.argsort(hashes)
    return Frequencies(hashes[at], got.column(1).to_numpy()[at], floor, documents)


def weighted(hashes: np.ndarray, first: np.ndarray, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text, rising, their weights (count times inverse document frequency), and each text's first (with the end)."""
    distinct, text, counts = _by_text(hashes, first)
    return distinct, counts.astype(np.float32) * idf.of(distinct), np.searchsorted(text, np.arange(len(first)))


def profiles(distinct: np.ndarray, weights: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Of each text the sum of its weights, a unit, and sums of weights by ``PROFILE`` parts of the shingles, rounded up to whole units.

    What two texts share is at most the sum of the lesser of their parts, which
    bounds their similarity from above.
    """
    texts, text = len(first) - 1, np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = text * PROFILE + (distinct >> np.uint64(32)).astype(np.int64) % PROFILE
    sums = np.bincount(place, weights, minlength=texts * PROFILE).reshape(texts, PROFILE)
    unit = np.maximum(sums.max(axis=1, initial=0), 1e-30).astype(np.float32) * np.float32(1.00001 / 255)
    parts = np.ceil(sums / unit[:, None].astype(float)).astype(np.uint8)
    total = sums.sum(axis=1).astype("<f4")
    return [total[i].tobytes() + unit[i].astype("<f4").tobytes() + parts[i].tobytes() for i in range(texts)]


def may_reach(one: list[bytes], two: list[bytes], least: float, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """Whether the similarity of texts with these profiles can be ``least`` or more, pair by pair, or by the pairs of indices given."""
    heads, parts = zip(*((np.frombuffer(b"".join(p[:8] for p in some), "<f4").reshape(-1, 2).astype(float), np.frombuffer(b"".join(p[8:] for p in some), np.uint8).reshape(-1, PROFILE)) for some in (one, two)), strict=True)
    i, j = pairs or (np.arange(len(one)), np.arange(len(two)))
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 14):
        x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        shared = np.minimum(parts[0][x] * heads[0][x, 1:].astype(np.float32), parts[1][y] * heads[1][y, 1:].astype(np.float32)).sum(axis=1, dtype=float)
        # shared / (all - shared) >= least, with room for rounding
        out[at : at + len(x)] = shared * (1 + least) * 1.0001 >= least * (heads[0][x, 0] + heads[1][y, 0])
    return out


# ---------------------------------------------------------------- samples

_DRAWS = 1 << 16


@cache
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of the sampling's random variables: gamma(2, 1), log of gamma(2, 1), uniform."""
    rng = np.random.Generator(np.random.PCG64(20_10))
    return rng.gamma(2, 1, _DRAWS).astype(np.float32), np.log(rng.gamma(2, 1, _DRAWS)).astype(np.float32), rng.random(_DRAWS).astype(np.float32)


def samples(distinct: np.ndarray, log_weights: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Consistent samples (texts x ``size``) of texts that have shingles.

    A shingle of weight w draws r, c ~ gamma(2, 1) and b ~ uniform by its hash;
    t = floor(ln w / r + b), y = exp(r (t - b)), and the shingle of least
    c / (y e^r) is the sample, together with t.
    """
    r_of, c_of, b_of = _draws()
    seeds = np.array([int.from_bytes(hashlib.blake2b(bytes([k]), digest_size=8).digest(), "little") for k in range(size)], np.uint64)
    out = np.zeros((len(first) - 1, size), np.uint64)
    n_of = np.diff(first)
    for k in range(size):
        z = (distinct ^ seeds[k]) * np.uint64(0x9E3779B97F4A7C15)
        z ^= z >> np.uint64(29)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        r = r_of[z >> np.uint64(48)]
        b = b_of[z >> np.uint64(32) & np.uint64(0xFFFF)]
        c = c_of[z >> np.uint64(16) & np.uint64(0xFFFF)]
        t = np.floor(log_weights / r + b)
        a = c - r * (t - b + np.float32(1))
        least = np.minimum.reduceat(a, first[:-1])
        at = np.flatnonzero(a == np.repeat(least, n_of))
        # of equal ones the smallest hash: shingles rise within a text
        text = np.searchsorted(first, at, side="right") - 1
        one = at[np.flatnonzero(np.append(True, text[1:] != text[:-1]))]
        out[:, k] = tv.mixed(distinct[one] + tv.mixed(t[one].astype(np.int64).astype(np.uint64) + seeds[k]))
    return out


def _tickets(keys: list[bytes | None], ids: pa.Array) -> np.ndarray:
    """A number for each digest and id; rows of equal texts differ in it."""
    words = np.array([0 if k is None else int.from_bytes(k[:8], "little") for k in keys], np.uint64)
    numbers = ids.fill_null(-1).to_numpy().astype(np.uint64)
    return (words ^ tv.mixed(numbers + np.uint64(1) + ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint64))).astype(np.int64)


def signatures(docs: DataFrame, idf: Broadcast, *, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """id, ``key`` (digest of the text; null for a null text), ``ticket`` (of digest and id), ``bands`` and ``sig`` (32 bits of each sample; both null without shingles)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(1).to_pylist()
            for at, texts in chunks(every):
                keys = [None if raw is None else _digest(t) for raw, t in zip(every[at : at + len(texts)], texts, strict=True)]
                ids = batch.column(0).slice(at, len(texts))
                distinct, weights, first = weighted(*shingles(texts, words), idf.value)
                has = np.flatnonzero(np.diff(first) > 0)
                band_rows, sigs = [None] * len(texts), [None] * len(texts)
                if len(has):
                    got = samples(distinct, np.log(weights), np.append(first[has], first[-1]), bands * rows)
                    joined = np.zeros((len(has), bands), np.uint64)
                    for j in range(rows):
                        joined = tv.mixed(joined * np.uint64(31) + got[:, j::rows] + np.arange(bands, dtype=np.uint64))
                    short = (got >> np.uint64(32)).astype("<u4")
                    for j, i in enumerate(has):
                        band_rows[i], sigs[i] = joined[j].astype(np.int64), short[j].tobytes()
                counts = np.array([0 if b is None else bands for b in band_rows])
                flat = np.concatenate([b for b in band_rows if b is not None]) if len(has) else np.zeros(0, np.int64)
                columns = [ids, pa.array(keys, pa.binary()), pa.array(_tickets(keys, ids)), ragged(flat, counts, pa.int64()), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "key", "ticket", "bands", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string")).mapInArrow(sign, "id long, key binary, ticket long, bands array<long>, sig binary")


def vectors(docs: DataFrame, tickets: DataFrame, idf: Broadcast, *, id_col: str, text_col: str, words: int) -> DataFrame:
    """``key``, ``vec`` (weighted shingles) and ``profile`` of the texts whose rows have the given tickets, and of a few others.

    One pass over the texts. The tickets are sent as a filter of 16 bits each, up
    to ``2**FILTER_BITS``; with more tickets it lets more of the other texts pass.
    """
    bits = min(FILTER_BITS, max(16, int(16 * tickets.count()).bit_length()))
    place = F.pmod(F.col("ticket"), F.lit(1 << bits)) + 1  # bitmaps count from 1
    parts = tickets.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    held = np.zeros((1 << bits) // 8, np.uint8)
    for part, some in parts.coalesce(FILTER_TASKS).toLocalIterator():  # a fixed size: 4 KB for each 2**15 bits; a job for each task
        held[(part - 1) * 4096 :][:4096] = np.frombuffer(some, np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks(batch.column(1).to_pylist()):
                keys = [_digest(t) for t in texts]
                bit = _tickets(keys, batch.column(0).slice(at, len(texts))) & ((1 << bits) - 1)
                some = np.flatnonzero(sent.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                if len(some):
                    d, w, first = weighted(*shingles([texts[i] for i in some], words), idf.value)
                    vec = [d[a:b].astype("<u8").tobytes() + w[a:b].astype("<f4").tobytes() for a, b in pairwise(first)]
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in some], pa.binary()), pa.array(vec, pa.binary()), pa.array(profiles(d, w, first), pa.binary())], names=["key", "vec", "profile"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    return texts.mapInArrow(make, "key binary, vec binary, profile binary").groupBy("key").agg(F.first("vec").alias("vec"), F.first("profile").alias("profile"))


# ---------------------------------------------------------------- links


def _least_by(order: Column, value: str) -> Column:
    return F.min(F.struct(order.alias("o"), F.col(value).alias("k")))["k"]


def _salted(rows: DataFrame) -> DataFrame:
    """Rows of buckets with the part of theirs that they fall into."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))


def _in_every_part(by_bucket: DataFrame) -> DataFrame:
    """A row for each part of each bucket."""
    return by_bucket.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def proposed(buckets: DataFrame, turns: range) -> DataFrame:
    """Links a, b (a < b) from hubs of each bucket to its other members, and from hubs of each part of it.

    ``buckets`` has a row per bucket, member and the member's next band, with the
    number of tasks that share the bucket (``parts``); members that share the next
    band too are texts more alike. There is a hub for each turn.
    """
    orders = [_least_by(F.xxhash64("key", F.lit(turn)), "key") for turn in turns]
    out, members = None, _salted(buckets)
    for by in (["bucket"], ["bucket", "next"]):
        hubs = buckets.groupBy(*by).agg(F.array_distinct(F.array(*orders)).alias("hubs"), F.count(F.lit(1)).alias("n"), F.max("parts").alias("parts")).where("n > 1").drop("n")
        pairs = members.join(_in_every_part(hubs), [*by, "salt"]).select("key", F.explode("hubs").alias("hub")).where("key <> hub")
        pairs = pairs.select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b"))
        out = pairs if out is None else out.unionAll(pairs)
    return out.distinct()


def _likely(links: DataFrame, marks: DataFrame, agreement: float, least: float) -> DataFrame:
    """Links whose texts agree on at least that share of samples, and whose profiles allow a similarity of ``least``."""
    left, right = (marks.select(F.col("key").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("profile").alias(f"profile_{x}")) for x in ("a", "b"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(batch.num_rows, -1) for i in (2, 3))
                good = (one == two).mean(axis=1) >= agreement
                some = np.flatnonzero(good)
                good[some] = may_reach(*(batch.column(i).take(pa.array(some)).to_pylist() for i in (4, 5)), least) if len(some) else False
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    both = salted_join(salted_join(links, left, "a", "b"), right, "b", "a")
    return both.select("a", "b", "sig_a", "sig_b", "profile_a", "profile_b").mapInArrow(keep, "a binary, b binary")


def remaining(buckets: DataFrame, roots: DataFrame, marks: DataFrame, *, bands: int, rows: int, agreement: float, least: float, block: int | None = None) -> DataFrame:
    """All links a, b (a < b) between different classes of a bucket that are likely, as ``_likely`` has it, and the ``bytes`` of their texts' weighted shingles.

    A large bucket is dealt into blocks of about ``block`` members; a task holds
    two of them at a time. A pair comes from the first band that it shares.
    """
    block = block or BLOCK
    held = buckets.join(roots, "key", "left").select("bucket", "band", "parts", "key", F.coalesce("root", "key").alias("root"))
    several = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("parts").alias("parts")).where("lo <> hi")
    several = _in_every_part(several.select("bucket", "parts", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    members = _salted(held).join(several, ["bucket", "salt"])
    dealt = (
        members.join(marks, "key")
        .withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "band", (F.col("mine") > F.col("other")).alias("second"), "key", "root", "sig", "profile", "size")
    )

    def pairs(group: pa.Table) -> Iterator[pa.RecordBatch]:
        alone, band = group.column("i")[0] == group.column("j")[0], group.column("band")[0].as_py()
        seen: dict[bytes, int] = {}
        root = np.array([seen.setdefault(r, len(seen)) for r in group.column("root").to_pylist()])
        second = group.column("second").to_numpy()
        if len(seen) < 2 or not alone and second.all() | ~second.any():
            return
        keys, profile, size = group.column("key").combine_chunks(), group.column("profile").to_pylist(), group.column("size").to_numpy()
        sig = np.ascontiguousarray(np.frombuffer(b"".join(group.column("sig").to_pylist()), "<u4").reshape(len(root), -1).T)
        ordered = np.argsort(root, kind="stable")
        left, right = (ordered, ordered) if alone else (ordered[~second[ordered]], ordered[second[ordered]])
        for s in range(0, len(left), TILE):
            one, two = left[s : s + TILE], right[s:] if alone else right
            if root[one[0]] == root[one[-1]]:
                two = two[root[two] != root[one[0]]]
            if not len(two):
                continue
            same = np.zeros((len(one), len(two)), np.uint8)
            fit = root[one][:, None] != root[two]
            for b in range(bands):
                whole = np.ones(same.shape, bool)
                for x in sig[b * rows : (b + 1) * rows]:
                    equal = x[one][:, None] == x[two]
                    same += equal
                    whole &= equal
                if b < band:
                    fit &= ~whole
            at, to = np.nonzero(fit & (same >= agreement * len(sig)))
            if len(at):
                good = may_reach([profile[i] for i in one], [profile[i] for i in two], least, (at, to))
                at, to = at[good], to[good]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(one[at])), keys.take(pa.array(two[to])), pa.array(size[one[at]] + size[two[to]])], names=["x", "y", "bytes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, mark = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1
            for start, end in pairwise([0, *cuts.tolist(), batch.num_rows]):
                now = tuple(place[:, start].tolist())
                if now != mark and group:
                    yield from pairs(pa.Table.from_batches(group))
                    group = []
                mark = now
                group.append(batch.slice(start, end - start))
        if group:
            yield from pairs(pa.Table.from_batches(group))

    by = ["bucket", "i", "j"]
    found = dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, "x binary, y binary, bytes long")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "bytes").distinct()


def verified(links: DataFrame, vecs: DataFrame, least: float) -> DataFrame:
    """Links whose texts have a weighted Jaccard similarity of ``least`` or more, exactly."""
    vecs = vecs.select("key", "vec")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_similarity(x, y) >= least for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = vecs.withColumnsRenamed({"key": "a", "vec": "vec_a"}), vecs.withColumnsRenamed({"key": "b", "vec": "vec_b"})
    both = salted_join(salted_join(links, left, "a", "b"), right, "b", "a")
    return both.select("a", "b", "vec_a", "vec_b").mapInArrow(keep, "a binary, b binary")


def _similarity(one: bytes, two: bytes) -> float:
    (d1, w1), (d2, w2) = ((np.frombuffer(v, "<u8", len(v) // 12), np.frombuffer(v, "<f4", len(v) // 12, len(v) // 12 * 8).astype(float)) for v in (one, two))
    at = np.minimum(np.searchsorted(d2, d1), len(d2) - 1)
    both = d2[at] == d1
    shared = np.minimum(w1[both], w2[at[both]]).sum()
    return float(shared / (w1.sum() + w2.sum() - shared))


# ---------------------------------------------------------------- classes


def _stars(a: pa.Array, b: pa.Array) -> pa.RecordBatch:
    """For each component of the links a, b one link (a < b) from its least key to every other."""
    names = pa.concat_arrays([a, b]).dictionary_encode()
    keys = names.dictionary.take(pc.sort_indices(names.dictionary))  # a smaller number is a smaller key
    at = pc.index_in(pa.concat_arrays([a, b]), keys).to_numpy().astype(np.int64)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(keys))
    while True:
        one, two = root[x], root[y]
        if (one == two).all():
            break
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root != root[root]).any():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(keys)))
    return pa.RecordBatch.from_arrays([keys.take(pa.array(root[other])), keys.take(pa.array(other))], names=["a", "b"])


def contracted(links: DataFrame, chunk: int | None = None) -> DataFrame:
    """Fewer links (a < b) with the same components as stored ``links``: each run of about ``chunk`` of them as stars around its components' least keys."""
    chunk = chunk or CHUNK_LINKS

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= chunk:
                yield _stars(*pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns)
                held, size = [], 0
        if size:
            yield _stars(*pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns)

    return links.select("a", "b").coalesce(max(1, -(-links.count() // chunk))).mapInArrow(stars, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """key and ``root`` (the least key of its component) for every end of a link.

    Runs of links become stars first. Then every key takes the least root among
    its own and its neighbours', then its root's root, until nothing changes.
    """
    fewer = checkpointed(contracted(links))
    both = checkpointed(fewer.unionAll(fewer.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    hot = hot_parts(both, "b")
    roots = checkpointed(both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select("key", F.least("key", "m").alias("root")))
    while True:
        near = join_by_parts(both, roots.withColumnRenamed("key", "b"), hot, "b", "a").select(F.col("a").alias("key"), F.col("root").alias("next"), F.lit(None).cast("binary").alias("root"))
        every = near.unionAll(roots.select("key", F.col("root").alias("next"), "root"))
        step = checkpointed(every.groupBy("key").agg(F.max("root").alias("root"), F.min("next").alias("next")))
        if step.where("next <> root").isEmpty():
            return roots
        release(links.sparkSession)  # rounds follow each other fast: their shuffles are not left to pile up
        jump = step.select(F.col("key").alias("next"), F.col("next").alias("beyond"))
        roots = checkpointed(salted_join(step, jump, "next", "key").select("key", F.least("next", "beyond").alias("root")))


def with_more(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``components`` of the links that ``roots`` came from and of more ``links``."""
    return components(checkpointed(roots.where("key <> root").select(F.col("root").alias("a"), F.col("key").alias("b")).unionAll(links.select("a", "b"))))


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST, bands: int = BANDS, rows: int = ROWS, spread: float = IDF_SPREAD
) -> DataFrame:
    """A row per row of ``docs``: ``id``, ``key`` (digest of the text), ``class_id`` (the least id of its class) ``class_size`` (rows)
    and ``kept`` (true for one id and text of each class; repeated rows of those share it).

    Texts that are equal, or linked by similarities of ``least`` or more, share a
    class. Texts without words share a class with equal texts only; a null text
    is a class of its own, whose class_id is its id. Null ids never name a class
    unless it has no other. Repeated rows each have a row. ``spread`` is how much
    more a rare shingle weighs than one of all documents (0: all alike).
    """
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(document_frequencies(docs, text_col, words).idf(spread))
    signed = checkpointed(signatures(docs, idf, id_col=id_col, text_col=text_col, words=words, bands=bands, rows=rows))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("ticket"))).alias("first")
    exact = signed.where("key is not null").groupBy("key").agg(first, F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    exact = checkpointed(exact.select("key", "first.id", "first.ticket", "n", "bands", "sig"))
    texts = exact.where("sig is not null")
    places = F.transform("bands", lambda x, i: F.struct(F.xxhash64(i, x).alias("bucket"), F.element_at("bands", (i + 1) % bands + 1).alias("next"), i.cast("byte").alias("band")))
    buckets = texts.select("key", "ticket", F.inline(places))
    hot = hot_parts(buckets, "bucket")
    sizes = with_parts(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), hot, "bucket").withColumnRenamed("_parts", "parts")
    dealt = _salted(with_parts(buckets, hot, "bucket").withColumnRenamed("_parts", "parts"))
    buckets = checkpointed(dealt.join(_in_every_part(sizes), ["bucket", "salt"]).drop("salt"))
    vecs = checkpointed(vectors(docs, buckets.select("ticket").distinct(), idf, id_col=id_col, text_col=text_col, words=words))
    exactly = lambda links: checkpointed(verified(links, vecs, least))
    marks = checkpointed(texts.select("key", "sig").join(vecs.select("key", "profile", F.length("vec").cast("long").alias("size")), "key"))
    check = lambda links: exactly(checkpointed(_likely(links, marks, LEAST_AGREEMENT, least)))
    release(spark)
    tried = checkpointed(proposed(buckets, range(HUBS)))
    roots = components(check(tried))
    documents = exact.count()
    for turn in range(HUBS, HUBS + ROUNDS):
        release(spark)
        # one member of each class in a bucket; those of one class only are settled
        held = buckets.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
        of_class = held.groupBy("bucket", "root").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("bucket")
        crossing = of_class.agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("n")).agg(F.sum("n") / 2).first()[0]
        if (crossing or 0) <= CROSSING * documents:
            break
        one = held.groupBy("bucket", "root").agg(_least_by(F.xxhash64("key", F.lit(turn)), "key").alias("key"), F.min("next").alias("next"), F.max("parts").alias("parts")).drop("root")
        fresh = checkpointed(proposed(one, range(turn, turn + 1)).join(tried, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            break
        more = check(fresh)
        tried = checkpointed(tried.unionAll(fresh))
        if more.isEmpty():
            break
        roots = with_more(roots, more)
    release(spark)
    rest = checkpointed(remaining(buckets, roots, marks, bands=bands, rows=rows, agreement=LEAST_AGREEMENT, least=least).join(tried, ["a", "b"], "left_anti"))
    most = max(PART_BYTES, marks.agg(F.sum("size")).first()[0] or 0)
    parts = -(-(rest.agg(F.sum("bytes")).first()[0] or 0) // most)
    rest, more = rest.drop("bytes"), None
    for part in range(parts):
        release(spark)
        found = exactly(rest.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == part))
        more = found if more is None else more.unionAll(found)
    if more is not None and not more.isEmpty():
        release(spark)
        roots = with_more(roots, more)
    grouped = exact.join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"), "id", "n")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("key")))
    classes = grouped.groupBy("root").agg(first.alias("first"), F.sum("n").alias("class_size"))
    by_key = salted_join(grouped, classes, "root", "key").select("key", F.col("first.id").alias("class_id"), F.col("first.key").alias("first_key"), "class_size")
    out = salted_join(signed.select("id", "key", "ticket"), by_key, "key", "ticket", "left")
    alone = F.col("key").isNull()
    return out.select(
        "id",
        "key",
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (alone | ((F.col("key") == F.col("first_key")) & F.col("id").eqNullSafe(F.col("class_id")))).alias("kept"),
    )


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, and every row without a text. Columns of any name pass through."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **how)
    kept = checkpointed(found.where("kept and key is not null").groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")))
    key, id_, keep_key, keep_id = fresh_names(docs, "key", "id", "keep_key", "keep_id")
    rows = docs.withColumns({key: digest(F.col(text_col).cast("string")), id_: F.col(id_col).cast("long")})
    held = kept.select(F.col("id").alias(keep_id), F.col("key").alias(keep_key))
    # equal texts differ in their ids, so that no task holds all copies
    stays = rows.join(held, (F.col(key) == F.col(keep_key)) & F.col(id_).eqNullSafe(F.col(keep_id)), "left_semi")
    if kept.where("n > 1").limit(1).count():
        stays = stays.dropDuplicates([id_, key])
    return stays.drop(key, id_).unionByName(docs.where(F.col(text_col).isNull()))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "class_size")
