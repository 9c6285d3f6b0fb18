"""Packing of tokenised documents into sequences by cutting-stock column generation.

Documents are cut at multiples of the sequence length. Whole pieces are
sequences already; the rest form a histogram of lengths, in classes of
``unit`` tokens. A linear program over patterns (how many pieces of each class
share a sequence) is solved by column generation: a knapsack dynamic program
prices new columns. The solution's patterns are rounded down, what is left is
packed best-fit over the same histogram, and pieces are assigned to patterns
by their rank in their class. The driver sees only the histogram, whose size
is fixed by ``capacity / unit``.
"""

from __future__ import annotations

import os
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from earshot.llm.common import checkpointed, chunks, fresh_names, local_table, table, trim

CAPACITY = 2048
UNIT = 16
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Ranks are counted in parts of each class; there is a part for so many rows, and no task holds a class.
SHARD_ROWS = 500_000

# ---------------------------------------------------------------- tokens

#: Words, and white-space-separated chunks, of one generation that a worker remembers; it holds two.
CACHE_WORDS = 400_000


#: Chunks with code points from here on go to the tokeniser as they are: libraries differ in which of those are letters.
BEYOND = "\u0530"


def _encoded(tokenizer, text: str) -> bytes:
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


class _Remembered(dict):
    """Values by key, made when first asked for. When full, it keeps its entries as an older generation, from which those asked for again come back."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most, {}

    def made(self, key: str) -> bytes:
        raise NotImplementedError

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.made(key)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class _Words(_Remembered):
    """Word of the pre-tokeniser -> bytes of its ids."""

    def __init__(self, tokenizer, most: int):
        super().__init__(most)
        self.model = tokenizer.model
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.packed = [struct.pack("<I", i) for i in range(tokenizer.get_vocab_size())]

    def made(self, word: str) -> bytes:
        # a letter for each byte; those of ASCII letters are themselves
        mapped = word if word.isascii() and word.isalnum() else word.encode("utf-8").decode("latin-1").translate(self.letters)
        return b"".join([self.packed[token.id] for token in self.model.tokenize(mapped)])


class _Chunks(_Remembered):
    """Text between white space -> bytes of its ids."""

    def __init__(self, tokenizer, words: _Words, most: int):
        import regex

        super().__init__(most)
        self.tokenizer, self.words = tokenizer, words
        added = [regex.escape(token.content) for token in tokenizer.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(added) or r"(?!)").search
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall

    def made(self, chunk: str) -> bytes:
        plain = chunk.isascii()
        if not (plain or max(chunk) < BEYOND) or self.added(chunk):
            return _encoded(self.tokenizer, chunk)
        lower = chunk.lower() if plain else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        if lower.isalpha():
            return self.words[lower]
        return b"".join(map(self.words.__getitem__, self.find(lower)))


class Encoder:
    """Ids of the word-level byte-pair tokeniser, remembered by word.

    The tokeniser's normaliser and pre-tokeniser never join text across white
    space, so the ids of a text are those of its chunks, one after the other.
    Chunks that spell a token added to the vocabulary go to the tokeniser, which
    gives them that token's id. Texts with the four separators that Python counts as white space and the
    tokeniser does not go through the tokeniser whole.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.chunks = _Chunks(self.tokenizer, _Words(self.tokenizer, cache_words), cache_words)

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return _encoded(self.tokenizer, text)
        return b"".join(map(self.chunks.__getitem__, text.split()))


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, cache_words: int = CACHE_WORDS) -> Encoder:
    if (path, cache_words) not in _encoders:
        _encoders[path, cache_words] = Encoder(path, cache_words)
    return _encoders[path, cache_words]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, cache_words: int = CACHE_WORDS, keep_words: bool = True) -> DataFrame:
    """Every document's ids and ``end_id``, cut at multiples of ``capacity``.

    A worker remembers words from task to task; without ``keep_words`` it gives
    tokeniser and words back after each.

    Columns: doc_id, start (ids before the piece), length, doc_tokens, ids
    (little-endian unsigned 32-bit). A null or empty text gives one piece, the
    end id alone. Repeated rows are cut each; null ids stay null.
    """
    path = path or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, cache_words).ids, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            owners = batch.column(0).to_pylist()
            for at, texts in chunks(batch.column(1).to_pylist()):
                rows: list[tuple] = []
                for owner, text in zip(owners[at:], texts, strict=False):
                    ids = encode(text) + end
                    total = len(ids) // 4
                    rows += [(owner, s, min(capacity, total - s), total, ids[4 * s : 4 * (s + capacity)]) for s in range(0, total, capacity)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.binary())], names=PIECES.names)
        if not keep_words:
            del encode
            _encoders.clear()
            trim()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(cut, PIECES)


# ---------------------------------------------------------------- patterns


def _knapsack(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best worth, and the pattern (count of each class; class i takes i + 1 units), of an unbounded knapsack."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        worth = best[room - 1 :: -1][: len(values)] + values[:room]
        i = int(np.argmax(worth))
        if worth[i] > best[room - 1] + 1e-12:
            best[room], choice[room] = worth[i], i
        else:
            best[room] = best[room - 1]
    pattern, room = np.zeros(len(values), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= choice[room] + 1
    return float(best[capacity]), pattern


def _inverse(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivoting; small enough to do without LAPACK's threads, which can stall in a driver that has forked."""
    n = len(matrix)
    work = np.concatenate([matrix.astype(float), np.eye(n)], axis=1)
    for i in range(n):
        row = i + int(np.argmax(np.abs(work[i:, i])))
        work[[i, row]] = work[[row, i]]
        work[i] /= work[i, i]
        factors = work[:, i].copy()
        factors[i] = 0
        work -= factors[:, None] * work[i]
    return work[:, n:]


def solve_patterns(demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, meeting ``demand`` exactly.

    ``demand[i]`` pieces take ``i + 1`` of a sequence's ``capacity`` units. The
    linear program starts from patterns of one class each and takes in the
    column of least reduced cost until none is below zero; ``rounds`` only ends
    a solution that no longer gains. Floors of the solution are used whole, and
    what is left is packed best-fit in falling order. No demand: no patterns.
    """
    classes = np.flatnonzero(demand)
    if not len(classes):
        return []
    need, n = demand[classes].astype(float), len(classes)
    columns = np.zeros((n, n))
    columns[np.arange(n), np.arange(n)] = capacity // (classes + 1)
    inverse = np.diag(1 / np.diag(columns))
    uses, last, still = inverse @ need, np.inf, 0
    for at in range(rounds):
        if at % 64 == 63:
            inverse = _inverse(columns)
            uses = inverse @ need
        values = np.zeros(capacity)
        values[classes] = inverse.sum(axis=0)
        worth, pattern = _knapsack(values, capacity)
        if worth <= 1 + 1e-9:
            break
        entering = pattern[classes].astype(float)
        step = inverse @ entering
        ratios = np.where(step > 1e-12, uses / np.where(step > 1e-12, step, 1), np.inf)
        leaving = int(np.argmin(ratios))
        columns[:, leaving] = entering
        pivot = inverse[leaving] / step[leaving]
        inverse = inverse - np.outer(step, pivot)
        inverse[leaving] = pivot
        uses = np.maximum(inverse @ need, 0)
        total = uses.sum()
        still = still + 1 if total > last * (1 - 1e-7) else 0
        last = total
        if still >= 300:
            break
    left = demand.astype(np.int64).copy()
    found: list[tuple[np.ndarray, int]] = []
    for j in np.argsort(-uses, kind="stable"):
        pattern = np.zeros(len(demand), np.int64)
        pattern[classes] = np.rint(columns[:, j]).astype(np.int64)
        some = pattern > 0
        times = min(int(uses[j]), int((left[some] // pattern[some]).min())) if some.any() else 0
        if times > 0:
            found.append((pattern, times))
            left -= times * pattern
    while left.any():
        pattern, room = np.zeros(len(demand), np.int64), capacity
        for i in range(len(demand) - 1, -1, -1):
            taken = min(int(left[i] - pattern[i]), room // (i + 1))
            pattern[i] += taken
            room -= taken * (i + 1)
        some = pattern > 0
        times = int((left[some] // pattern[some]).min())
        found.append((pattern, times))
        left -= times * pattern
    return found


def pack(rows: DataFrame, *, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "start"), capacity: int = CAPACITY, unit: int = UNIT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset`` (long) in sequences of at most ``capacity`` tokens.

    Lengths lie in 1 to ``capacity``. The rows of a sequence lie one after the
    other from offset 0. Ties and repeated rows get places of their own; extra
    columns pass through; an empty table gives an empty table. ``rows`` should
    be cheap to read again (checkpointed): it is read three times.
    """
    spark, classes = rows.sparkSession, -(-capacity // unit)
    kept = [f"`{c}`" for c in rows.columns if c not in ("sequence_id", "offset")]
    class_, shard, in_shard, before, rank, slots_, slot_, count = fresh_names(rows, "_class", "_shard", "_in_shard", "_before", "_rank", "_slots", "_slot", "_n")
    rows = rows.select(*kept).withColumn(class_, F.ceil(F.col(length_col) / unit).cast("int"))
    demand = np.zeros(classes, np.int64)
    for c, n in rows.groupBy(class_).count().collect():  # a row for each class
        demand[c - 1] = n
    # pieces of the last class fill a sequence: their only pattern is themselves
    alone = [(np.eye(1, classes, classes - 1, dtype=np.int64)[0], int(demand[-1]))] if demand[-1] else []
    patterns = alone + solve_patterns(np.where(np.arange(classes) == classes - 1, 0, demand), classes)
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used, base = np.zeros(classes, np.int64), 0
    for pattern, times in patterns:
        for c in np.flatnonzero(pattern):
            slots.setdefault(int(c) + 1, []).append((int(used[c]), int(used[c] + times * pattern[c]), int(pattern[c]), base))
        used += times * pattern
        base += times
    # bounded by classes and patterns, not by rows
    slot_kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "end", "each", "seq")]))
    listed = [[dict(zip(("first", "end", "each", "seq"), x, strict=True)) for x in some] for some in slots.values()]
    slots_df = F.broadcast(local_table(spark, {class_: pa.array(list(slots), pa.int32()), slots_: pa.array(listed, slot_kind)}))
    shards = max(64, int(demand.sum()) // shard_rows)
    dealt = rows.withColumn(shard, F.pmod(F.xxhash64(*order, F.lit(unit)), F.lit(shards)).cast("int"))
    counts = dealt.groupBy(class_, shard).agg(F.count(F.lit(1)).alias(count))
    earlier = Window.partitionBy(class_).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(class_, shard, F.coalesce(F.sum(count).over(earlier), F.lit(0)).alias(before))
    here = Window.partitionBy(class_, shard).orderBy(*order, length_col)
    ranked = dealt.withColumn(in_shard, F.row_number().over(here)).join(starts, [class_, shard])
    ranked = ranked.withColumn(rank, F.col(before) + F.col(in_shard) - 1)
    slot = F.filter(slots_, lambda x: (x["first"] <= F.col(rank)) & (F.col(rank) < x["end"]))[0]
    placed = ranked.join(slots_df, class_).withColumn(slot_, slot)
    placed = placed.withColumn("sequence_id", (F.col(f"{slot_}.seq") + F.floor((F.col(rank) - F.col(f"{slot_}.first")) / F.col(f"{slot_}.each"))).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy(F.col(class_).desc(), rank).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum(length_col).over(inside), F.lit(0)).cast("long")).select(*kept, "sequence_id", "offset")


def packed_documents(docs: DataFrame, *, cache_words: int = CACHE_WORDS, keep_words: bool = True) -> DataFrame:
    """The pieces of ``docs`` with their checksums and places."""
    cut = pieces(docs, cache_words=cache_words, keep_words=keep_words).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(checkpointed(cut), order=("doc_id", "start", "ids_crc32", "doc_tokens")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
