"""Exact top-k inner products by distributed histogram selection.

Queries and candidates are packed into blocks, a row each. Every block of queries
meets every block of candidates in each pass, all of them in one job: passes
build global histograms of the scores, which narrow the interval of each query's
kth value down to one integer. A last pass keeps scores above it, and of the
scores equal to it as many as could be needed, smallest id first. Histograms,
intervals and results stay in DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.llm.common import checkpointed, table

#: Queries and candidates of a block, most numbers in one, and candidates of a partition that meet a block in one task.
QUERIES, CANDIDATES, NUMBERS, PARTITION = 2048, 4096, 1 << 20, 1 << 16
#: Bins of a histogram.
BINS = 256
#: Scores are longs; those outside count as its ends. The least long of all marks a pair that is none.
LARGEST, HALF = 2**63 - 1, np.uint64(2**63)
PACKED = "block long, n int, ids binary, vectors binary"


def quantised(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, x as double, as whole doubles; null for a vector that takes no part."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(vector.isNotNull() & good, F.transform(as_double, lambda x: F.floor(x * F.lit(float(scale))).cast("double")))


def _pack(rows: DataFrame, most: int) -> DataFrame:
    """Rows (id, v) as blocks of up to ``most``: ids and vectors, of the block's greatest width, as bytes of whole floats or doubles."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, column, at = batch.column(0).to_numpy(), batch.column(1), 0
            lengths = column.value_lengths().to_numpy()
            while at < len(ids):
                widest = np.maximum.accumulate(lengths[at : at + most])
                n = max(1, int((widest * np.arange(1, len(widest) + 1) <= NUMBERS).sum()))
                part = column.slice(at, n)
                matrix = np.zeros((n, int(widest[n - 1])))
                matrix[np.arange(matrix.shape[1])[None, :] < lengths[at : at + n, None]] = part.flatten().to_numpy(zero_copy_only=False)
                kind = "<f4" if not matrix.size or np.abs(matrix).max() < 2**24 else "<f8"
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([n], pa.int32()), pa.array([ids[at : at + n].astype("<i8").tobytes()]), pa.array([(kind[-1].encode() + matrix.astype(kind).tobytes())])], names=["block", "n", "ids", "vectors"])
                at, block = at + n, block + 1

    return rows.select("id", "v").mapInArrow(pack, PACKED)


def _unpacked(n: int, ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    matrix = np.frombuffer(vectors, "<f4" if vectors[:1] == b"4" else "<f8", offset=1)
    return np.frombuffer(ids, "<i8"), matrix.reshape(n, -1)


def _integers(matrix: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in matrix.tolist()], object).reshape(matrix.shape)


def inner_products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices of whole numbers, as longs, exact; sums beyond a long are its ends.

    No partial sum exceeds the product of two rows' lengths, which tells whether
    floats, doubles or longs hold it; numbers beyond go through Python's integers.
    """
    width = min(one.shape[1], two.shape[1])
    one, two = one[:, :width], two[:, :width]
    with np.errstate(over="ignore"):
        a, b = (np.sqrt((x.astype(float) ** 2).sum(axis=1)) for x in (one, two))
    out = np.zeros((len(one), len(two)), np.int64)
    if not out.size or not a.max() or not b.max():
        return out
    margin = 1 + 1e-9
    if a.max() * b.max() * margin < 2.0**24:
        return (one.astype(np.float32, copy=False) @ two.astype(np.float32, copy=False).T).astype(np.int64)
    for low, high in ((0, 2.0**26), (2.0**26, 2.0**31), (2.0**31, np.inf)):
        rows = np.flatnonzero((a > low) & (a <= high))  # rows of length 0 score 0
        if not len(rows):
            continue
        bound = np.where(b > 0, b, 0) * a[rows].max() * margin
        for kind, some in ((float, bound < 2.0**53), (np.int64, (bound >= 2.0**53) & (bound < 2.0**63)), (object, ~(bound < 2.0**63))):
            columns = np.flatnonzero(some)
            if not len(columns):
                continue
            if kind is object:
                got = _integers(one[rows]).dot(_integers(two[columns]).T)
                got = np.minimum(np.maximum(got, -LARGEST), LARGEST)
            else:
                got = one[rows].astype(kind) @ two[columns].astype(kind).T
            out[np.ix_(rows, columns)] = got.astype(np.int64)
    return out


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids, and scores in unsigned numbers of the same order; 0 for a candidate of the query's own id."""
    ids, one = _unpacked(row["n"], row["ids"], row["vectors"])
    others, two = _unpacked(row["c_n"], row["c_ids"], row["c_vectors"])
    scores = inner_products(one, two).view(np.uint64) + HALF
    sort = np.argsort(others, kind="stable")
    first, last = (np.searchsorted(others[sort], ids, side=side) for side in ("left", "right"))
    for i in np.flatnonzero(last > first):
        scores[i, sort[first[i] : last[i]]] = 0
    return ids, others, scores


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def _state(low: np.ndarray, span: np.ndarray, above: np.ndarray, enough: np.ndarray) -> bytes:
    """The kth values lie in [low, low + span); ``above`` scores are beyond; ``enough`` is false once there are fewer than k."""
    return np.stack([x.astype(np.uint64) for x in (low, span, above, enough)]).tobytes()


def _read_state(state: bytes) -> np.ndarray:
    return np.frombuffer(state, np.uint64).reshape(4, -1)


def _width(span: np.ndarray, bins: int) -> np.ndarray:
    return (span - np.uint64(1)) // np.uint64(bins) + np.uint64(1)


def _histograms(pairs: DataFrame, k: int, bins: int) -> DataFrame:
    """How many scores fall into each of the bins of each query's interval, those left out that cannot be among the first ``k``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, least = None, None, None

        def done() -> pa.RecordBatch:
            q, bin_ = np.nonzero(held)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), block)), pa.array(q.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(held[q, bin_])], names=["block", "q", "bin", "n"])

        for row in _rows(batches):
            low, span, _, _ = _read_state(row["state"])
            if row["block"] != block:
                if held is not None:
                    yield done()
                block, held, least = row["block"], np.zeros((row["n"], bins), np.int64), None
            _, others, scores = _scores(row)
            if least is None and len(others) > 4 * k:
                least = np.partition(scores, -k, axis=1)[:, -k]  # a lower bound of the kth value
            floor = np.maximum(low, np.uint64(1)) if least is None else np.maximum(np.maximum(low, least), np.uint64(1))
            q, c = np.nonzero(scores >= floor[:, None])
            place = scores[q, c] - low[q]
            inside = place < span[q]
            bin_ = place[inside] // _width(span, bins)[q[inside]]
            held += np.bincount(q[inside] * bins + bin_.astype(np.int64), minlength=held.size).reshape(held.shape)
        if held is not None:
            yield done()

    return pairs.mapInArrow(count, "block long, q int, bin int, n long").groupBy("block", "q", "bin").agg(F.sum("n").alias("n"))


def _narrowed(blocks: DataFrame, counted: DataFrame, k: int, bins: int) -> DataFrame:
    """Blocks whose intervals are the bins that hold the kth values."""

    def narrow(left: pa.Table, right: pa.Table) -> pa.Table:
        low, span, above, enough = _read_state(left.column("state")[0].as_py())
        width = _width(span, bins)
        total = np.zeros((len(low), bins), np.int64)
        total[right.column("q").to_numpy(), right.column("bin").to_numpy()] = right.column("n").to_numpy()
        down = np.cumsum(total[:, ::-1], axis=1) + above.astype(np.int64)[:, None]  # scores at or above each bin, from the top
        hit = down >= k
        enough = enough.astype(bool) & hit[:, -1]
        place = np.where(hit[:, -1], np.argmax(hit, axis=1), bins - 1)
        before = np.where(place > 0, down[np.arange(len(low)), np.maximum(place - 1, 0)], above.astype(np.int64))
        found = np.minimum(low + (np.uint64(bins - 1) - place.astype(np.uint64)) * width, low + span - np.uint64(1))
        state = _state(found, np.minimum(width, low + span - found), before, enough)
        return left.set_column(left.schema.get_field_index("state"), "state", pa.array([state]))

    both = blocks.groupBy("block").cogroup(counted.groupBy("block"))
    return both.applyInArrow(narrow, f"{PACKED}, state binary")


def top_k(vectors: DataFrame, queries: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, block: int = QUERIES, bins: int = BINS) -> DataFrame:
    """Each query row's ``k`` highest integer inner products with the rows of other ids, ties to the smaller id.

    ``queries`` is a condition on the rows of ``vectors``. Columns: query_id,
    rank (from 1), the id, score. Fewer candidates give fewer rows. Vectors that
    are null or hold null or non-finite components, and rows without an id, take
    no part; a shorter vector counts as filled with zeros. A repeated id is one
    item: its rows do not answer each other, and its query is asked once for
    each distinct vector under it. Scores are exact; one that a long does not
    hold is the nearest long, and is ranked as that.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), queries.alias("q")).where("id is not null and v is not null")
    rows = checkpointed(rows)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    everything, longest, asked, longest_asked = rows.agg(F.count(F.lit(1)), F.max(length), F.sum(F.col("q").cast("long")), F.max(F.when(F.col("q"), length))).first()
    result = "query_id long, rank int, id long, score long"
    if not asked:
        return vectors.sparkSession.createDataFrame([], result).withColumnRenamed("id", id_col)
    parts = lambda n, size: max(1, -(-n // size))
    few = max(2 * vectors.sparkSession.sparkContext.defaultParallelism, parts(everything, PARTITION))
    chunks = checkpointed(_pack(rows.coalesce(few), CANDIDATES)).select(F.col("n").alias("c_n"), F.col("ids").alias("c_ids"), F.col("vectors").alias("c_vectors"))
    wanted = rows.where("q").select("id", "v").dropDuplicates()

    def interval(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = []
            for row in _rows([batch]):
                _, matrix = _unpacked(row["n"], row["ids"], row["vectors"])
                with np.errstate(over="ignore"):
                    bound = np.sqrt((matrix.astype(float) ** 2).sum(axis=1)) * longest * (1 + 1e-9) + 1
                bound = np.array([min(int(x), LARGEST) if np.isfinite(x) else LARGEST for x in bound.tolist()], np.uint64)
                states.append(_state(HALF - bound, bound + bound + np.uint64(1), np.zeros(row["n"]), np.ones(row["n"])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(states, pa.binary())], names=[*batch.schema.names, "state"])

    count = parts(asked, block)
    blocks = checkpointed(_pack(wanted.coalesce(count), block).mapInArrow(interval, f"{PACKED}, state binary"))
    # a row of a block and a row of candidates each: the stated queries against all rows, nothing is broadcast
    pairs = lambda: blocks.coalesce(count).hint("shuffle_replicate_nl").crossJoin(chunks)
    greatest = min(float(longest) * float(longest_asked) * (1 + 1e-9) + 1, float(LARGEST))
    span = int(2 * greatest) + 1  # the widest interval of all
    while span > 1:
        counted = _histograms(pairs(), k, bins)
        blocks = checkpointed(_narrowed(blocks, counted, k, bins))
        span = -(-span // bins)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            low, _, _, enough = _read_state(row["state"])
            limit = np.where(enough.astype(bool), low, np.uint64(0))[:, None]
            ids, others, scores = _scores(row)
            q, c = np.nonzero(scores > limit)
            # equal scores: the k smallest ids of these candidates hold all that the result can use
            tie_q, tie_c = np.nonzero((scores == limit) & (scores > 0))
            sort = np.lexsort((others[tie_c], tie_q))
            tie_q, tie_c = tie_q[sort], tie_c[sort]
            rank = np.arange(len(tie_q)) - np.searchsorted(tie_q, tie_q)
            q, c = np.concatenate([q, tie_q[rank < k]]), np.concatenate([c, tie_c[rank < k]])
            score = (scores[q, c] - HALF).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), row["block"])), pa.array(q.astype(np.int32)), pa.array(ids[q]), pa.array(others[c]), pa.array(score)], names=["block", "q", "query_id", "id", "score"])

    best = Window.partitionBy("block", "q").orderBy(F.col("score").desc(), "id")
    kept = pairs().mapInArrow(keep, "block long, q int, query_id long, id long, score long")
    ranked = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), F.col("id").alias(id_col), "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: The same by brute force: every query against every candidate.
OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
