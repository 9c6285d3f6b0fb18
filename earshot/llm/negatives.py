"""Hard negatives by a two-dimensional block product.

Rows are cut into blocks and their dimensions into chunks. Blocks of anchors and
blocks of candidates are dealt to the cells of a grid, a copy to each cell of
their row or column; a cell multiplies what it holds of one chunk of dimensions.
Products of one pair of blocks are added over the chunks by a shuffle, as tiles of
whole scores, and a tile is at once reduced to the rows that its anchors could
use: their best of the same label in a first pass, their best of other labels
within each positive's window of scores in a second one.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from earshot.llm.common import checkpointed, table
from earshot.llm.topk import LARGEST, quantised

#: Anchors and candidates of a block, the least dimensions of a chunk and the most chunks.
ANCHORS, CANDIDATES, DIMENSIONS, CHUNKS = 128, 4096, 32, 8
#: Blocks that a row or column of the grid holds, and the most rows and columns; beyond, each holds more.
CELL, MOST_CELLS = 16, 64
#: A block's rows come once for each chunk of dimensions, ids and labels with the first chunk only.
BLOCK = "block long, n int, low long, high long, norm double, chunk int, vectors binary, ids binary, labels binary"


def _blocks(rows: DataFrame, most: int, dimensions: int) -> DataFrame:
    """Rows (id, label, v) as blocks of neighbours, with the range of their labels and the length of their longest vector."""
    schema = pa.schema([("block", pa.int64()), ("n", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("norm", pa.float64()), ("chunk", pa.int32()), ("vectors", pa.binary()), ("ids", pa.binary()), ("labels", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                some = batch.slice(at, most)
                ids, labels, column = some.column(0).to_numpy(), some.column(1).to_numpy(), some.column(2)
                lengths = column.value_lengths().to_numpy()
                matrix = np.zeros((len(ids), max(1, int(lengths.max()))))
                matrix[np.arange(matrix.shape[1])[None, :] < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
                sort = np.argsort(ids, kind="stable")  # in a tile, equal scores come by id
                with np.errstate(over="ignore"):
                    norm = float(np.sqrt((matrix**2).sum(axis=1)).max())
                kind = "<f4" if np.abs(matrix).max() < 2**24 else "<f8"
                for chunk in range(-(-matrix.shape[1] // dimensions)):
                    part = matrix[sort, chunk * dimensions : (chunk + 1) * dimensions].astype(kind)
                    row = {"block": block, "n": len(ids), "low": int(labels.min()), "high": int(labels.max()), "norm": norm, "chunk": chunk, "vectors": kind[-1].encode() + part.tobytes()}
                    if not chunk:
                        row |= {"ids": ids[sort].astype("<i8").tobytes(), "labels": labels[sort].astype("<i8").tobytes()}
                    yield pa.RecordBatch.from_pylist([row], schema=schema)
                block += 1

    return rows.select("id", "label", "v").mapInArrow(cut, BLOCK)


def _vectors(n: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f4" if data[:1] == b"4" else "<f8", offset=1).reshape(n, -1)


def product(one: np.ndarray, two: np.ndarray, bound: float) -> bytes:
    """Inner products of all rows of two matrices of whole numbers as a tile, exact.

    No sum over any of the dimensions exceeds ``bound``. Where floats, doubles or
    longs hold it, the tile is one of integers, else of Python's.
    """
    width = min(one.shape[1], two.shape[1])
    one, two = one[:, :width], two[:, :width]
    if bound < 2.0**53:
        kind = np.float32 if bound < 2.0**24 else np.float64
        out = one.astype(kind, copy=False) @ two.astype(kind, copy=False).T
        return b"4" + out.astype("<i4").tobytes() if bound < 2.0**31 else b"8" + out.astype("<i8").tobytes()
    if bound < 2.0**63:
        return b"8" + (one.astype(np.int64) @ two.astype(np.int64).T).astype("<i8").tobytes()
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    return b"o" + pickle.dumps(whole(one).dot(whole(two).T).tolist())


def added(tiles: list[bytes], n: int, m: int) -> np.ndarray:
    """The sum of the tiles of one pair of blocks as longs; scores beyond a long are its ends."""
    if any(t[:1] == b"o" for t in tiles):
        total = np.zeros((n, m), object)
        for t in tiles:
            total = total + np.array(pickle.loads(t[1:]), object).reshape(n, m)
        return np.minimum(np.maximum(total, -LARGEST), LARGEST).astype(np.int64)
    total = np.zeros((n, m), np.int64)
    for t in tiles:
        total += np.frombuffer(t, "<i4" if t[:1] == b"4" else "<i8", offset=1).reshape(n, m)
    return total


def _best(scores: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` greatest scores among those that fit in each row, of equal ones the first columns."""
    worst = np.iinfo(np.int64).min
    masked = np.where(fits, scores, worst)
    least = np.partition(masked, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), worst)
    row, column = np.nonzero(fits & (scores > least[:, None]))
    tie_row, tie_column = np.nonzero(fits & (scores == least[:, None]))
    rank = np.arange(len(tie_row)) - np.searchsorted(tie_row, tie_row)
    missing = k - np.bincount(row, minlength=len(scores))
    some = rank < missing[tie_row]
    return np.concatenate([row, tie_row[some]]), np.concatenate([column, tie_column[some]])


def _tiles(anchors: DataFrame, candidates: DataFrame, condition: Column, grid: tuple[int, int]) -> DataFrame:
    """Partial tiles of all pairs of blocks that meet ``condition``; those of the first chunk bring ids, labels and windows."""
    high, wide = grid
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    named = lambda df, side: [F.col(c).alias(f"{side}_{c}") for c in df.columns if c != "chunk"]
    left = anchors.select("chunk", place(high).alias("i"), copies(wide).alias("j"), *named(anchors, "a"))
    right = candidates.select("chunk", copies(high).alias("i"), place(wide).alias("j"), *named(candidates, "c"))
    brought = ["a_block", "c_block", "a_n", "c_n", "a_ids", "a_labels", "a_windows", "c_ids", "c_labels"]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                one, two, bound = (row.column(c)[0].as_py() for c in ("a_vectors", "c_vectors", "bound"))
                tile = product(_vectors(row.column("a_n")[0].as_py(), one), _vectors(row.column("c_n")[0].as_py(), two), bound)
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in brought), pa.array([tile])], names=[*brought, "tile"])

    met = left.hint("merge").join(right, ["chunk", "i", "j"]).where(condition).withColumn("bound", F.col("a_norm") * F.col("c_norm") * (1 + 1e-9))
    kinds = "a_block long, c_block long, a_n int, c_n int, a_ids binary, a_labels binary, a_windows binary, c_ids binary, c_labels binary, tile binary"
    return met.select(*brought, "a_vectors", "c_vectors", "bound").mapInArrow(multiply, kinds)


def _reduced(tiles: DataFrame, pick: Callable[[np.ndarray, dict], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """``pick`` of each pair of blocks: its scores, the sum of its partial tiles, and what the first of them brought."""

    def reduce(part: pa.Table) -> pa.Table:
        row = next(r for r in part.drop_columns(["tile"]).to_pylist() if r["a_ids"] is not None)
        head = {c: np.frombuffer(v, "<i8") if isinstance(v, bytes) else v for c, v in row.items()}
        got = pick(added(part.column("tile").to_pylist(), row["a_n"], row["c_n"]), head)
        return pa.table({c: pa.array(v) for c, v in got.items()})

    return tiles.groupBy("a_block", "c_block").applyInArrow(reduce, schema)


def _first(found: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` of each group with their ``rank``; cut in each task before they are shuffled."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def mined(vectors: DataFrame, anchors: Column, *, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """Hard negatives for each anchor row (``anchors``, a condition on the rows) and each of its positives.

    A score is the integer inner product with the anchor. Positives are the
    anchor's ``positives`` best rows of its label; for each, the ``negatives``
    best rows of other labels whose score is within ``window`` hundredths of the
    positive's. Ties go to the smaller id. Columns: anchor_id, positive_id, rank
    (from 1), negative_id, positive_score, negative_score.

    Rows without an id or a label (a whole number), and vectors that are null or
    hold null or non-finite components, take no part; a shorter vector counts as
    filled with zeros. Rows of the anchor's own id are not its candidates; each
    row of a repeated id is an anchor and a candidate by itself. Scores are
    exact; one beyond a long is its end. Other columns are not read; an empty
    table, an anchor without positives and an empty window give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), quantised(F.col(vector_col), scale).alias("v"), anchors.alias("q")).where("id is not null and label is not null and v is not null")
    # a hot label is cut by id; blocks then hold few labels, and most pairs of blocks matter to one of the passes only
    rows = checkpointed(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "label", "id").sortWithinPartitions("label", "id"))
    n, asked, width = rows.agg(F.count(F.lit(1)), F.sum(F.col("q").cast("long")), F.max(F.size("v"))).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not asked:
        return spark.createDataFrame([], result)
    dimensions = max(DIMENSIONS, -(-width // CHUNKS))
    up = lambda a, b: -(-a // b)
    few = lambda n, size: max(1, min(rows.rdd.getNumPartitions(), up(n, size)))
    cores = spark.sparkContext.defaultParallelism
    whole = checkpointed(_blocks(rows.coalesce(max(few(n, 4 * CANDIDATES), min(cores, few(n, CANDIDATES)))), CANDIDATES, dimensions))
    queries = checkpointed(_blocks(rows.where("q").coalesce(few(asked, 4 * ANCHORS)), ANCHORS, dimensions))
    high = min(MOST_CELLS, up(up(asked, ANCHORS), CELL))
    wide = min(MOST_CELLS, max(up(up(n, CANDIDATES), CELL), min(2 * cores, up(n, CANDIDATES))))
    grid = high, wide

    def same(scores: np.ndarray, head: dict) -> dict[str, np.ndarray]:
        fits = (head["a_labels"][:, None] == head["c_labels"][None, :]) & (head["a_ids"][:, None] != head["c_ids"][None, :])
        row, column = _best(scores, fits, positives)
        return {"a_block": np.full(len(row), head["a_block"]), "a_row": row.astype(np.int32), "id": head["c_ids"][column], "score": scores[row, column]}

    overlap = (F.col("a_low") <= F.col("c_high")) & (F.col("c_low") <= F.col("a_high"))
    likes = _reduced(_tiles(queries.withColumn("windows", F.lit(None).cast("binary")), whole, overlap, grid), same, "a_block long, a_row int, id long, score long")
    likes = _first(likes, ["a_block", "a_row"], [F.desc("score"), F.asc("id")], positives)

    def spans(part: pa.Table) -> pa.Table:
        """Least and greatest score, id and score of each positive, by the block's rows."""
        at, rank, ids, scores = (part.column(c).to_pylist() for c in ("a_row", "rank", "id", "score"))
        out = np.zeros((max(at) + 1, positives, 4), "<i8")
        out[:, :, 0] = 1  # an empty window
        for a, r, i, s in zip(at, rank, ids, scores, strict=True):
            out[a, r - 1] = (-(-window[0] * s // 100), window[1] * s // 100, i, s)
        return pa.table({"block": pa.array([part.column("a_block")[0].as_py()]), "windows": pa.array([out.tobytes()])})

    windows = checkpointed(likes.groupBy("a_block").applyInArrow(spans, "block long, windows binary"))
    heads = queries.where("chunk = 0").join(windows, "block").select(*queries.columns, "windows")
    rest = queries.where("chunk > 0").join(windows.select("block"), "block", "left_semi").withColumn("windows", F.lit(None).cast("binary"))

    def other(scores: np.ndarray, head: dict) -> dict[str, np.ndarray]:
        at = head["a_windows"].reshape(-1, positives, 4)
        scores, differ = scores[: len(at)], head["a_labels"][: len(at), None] != head["c_labels"][None, :]
        differ &= head["a_ids"][: len(at), None] != head["c_ids"][None, :]
        found = []
        for p in range(positives):
            row, column = _best(scores, differ & (scores >= at[:, p, 0, None]) & (scores <= at[:, p, 1, None]), negatives)
            found.append((row, np.full(len(row), p), head["c_ids"][column], at[row, p, 2], at[row, p, 3], scores[row, column]))
        row, place, ids, positive, positive_score, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return {"a_block": np.full(len(row), head["a_block"]), "a_row": row.astype(np.int32), "place": place.astype(np.int32), "anchor_id": head["a_ids"][row], "positive_id": positive, "negative_id": ids, "positive_score": positive_score, "negative_score": score}

    mixed = (F.col("a_low") != F.col("a_high")) | (F.col("c_low") != F.col("c_high")) | (F.col("a_low") != F.col("c_low"))
    hard = _reduced(_tiles(heads.unionByName(rest), whole, mixed, grid), other, "a_block long, a_row int, place int, anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    hard = _first(hard, ["a_block", "a_row", "place"], [F.desc("negative_score"), F.asc("negative_id")], negatives)
    return hard.select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


#: The same by brute force: every anchor against every row.
OP12_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
