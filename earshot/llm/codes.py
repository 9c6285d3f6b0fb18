"""Vector codes: product quantisation by weighted Lloyd rounds over distinct integer parts.

A vector's components become integers and are cut into parts. Equal parts of one
position are one row with a weight, so copies and often-seen values are compared
with a codebook once. A round assigns the distinct parts to the entries of their
position's codebook and sums them by entry, first within each task, then over
all; only these sums, as many as a codebook has numbers, reach the driver. Codes
and errors of distinct parts are joined back to the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm.common import checkpointed, hot_among, join_by_parts, salted_join, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Distinct parts that one task compares with its codebooks, and those whose distances are held at once.
TASK_PARTS, BLOCK = 1 << 16, 1 << 12
LARGEST = 2**63 - 1
SUM = pa.decimal128(38, 0)


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double, as longs (those beyond are a long's ends); null for a vector that takes no part."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    good = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.when(vector.isNotNull() & good, F.transform(as_double, lambda x: F.floor(x * F.lit(float(scale)))))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the first of equally near ones, and the squared distance (a long's end if greater); exact.

    Doubles hold every sum up to 2^53; greater numbers go through Python's integers.
    """
    index, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    greatest = max((np.abs(m.astype(float)).max(initial=0.0) for m in (x, entries)), default=0.0)
    if x.shape[1] * (2 * greatest) ** 2 < 2.0**53:
        c = entries.astype(float)
        for at in range(0, len(x), BLOCK):
            part = x[at : at + BLOCK].astype(float)
            far = (part**2).sum(axis=1)[:, None] - 2 * (part @ c.T) + (c**2).sum(axis=1)[None, :]
            index[at : at + BLOCK] = far.argmin(axis=1)
            error[at : at + BLOCK] = far.min(axis=1).astype(np.int64)
        return index, error
    wide = [[int(v) for v in c] for c in entries.tolist()]
    for i, row in enumerate(x.tolist()):
        far = [sum((a - b) ** 2 for a, b in zip(row, c, strict=True)) for c in wide]
        index[i] = min(range(len(far)), key=far.__getitem__)
        error[i] = min(far[index[i]], LARGEST)
    return index, error


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _assigned(key: pa.ListArray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Position, numbers, nearest entry and distance of each part of a batch."""
    numbers = _matrix(key)
    position, x = numbers[:, 0], numbers[:, 1:]
    index, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for p in np.unique(position).tolist():
        here = np.flatnonzero(position == p)
        index[here], error[here] = nearest(x[here], books[p])
    return position, x, index, error


def _sums(distinct: DataFrame, books: list[np.ndarray]) -> pa.Table:
    """Weighted sums of the parts nearest to each entry: position, entry, component (-1: their number), sum."""
    held = distinct.sparkSession.sparkContext.broadcast(books)
    rows, width = max(len(b) for b in books), books[0].shape[1] + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, used = np.zeros((len(held.value) * rows, width), object), np.zeros(len(held.value) * rows, bool)
        for batch in batches:
            position, x, index, _ = _assigned(batch.column(0), held.value)
            weight, at = batch.column(1).to_numpy(), position * rows + index
            used[at] = True
            # numbers that longs hold are added as such, others as Python's
            small = np.abs(x.astype(float)).max(initial=1.0) * float(weight.sum()) < 2.0**62
            kind = np.int64 if small else object
            here, place = np.unique(at, return_inverse=True)
            some = np.zeros((len(here), width), kind)
            np.add.at(some, place, np.column_stack([weight, x * weight[:, None] if small else x.astype(object) * weight.astype(object)[:, None]]).astype(kind))
            total[here] += some.astype(object)
        at = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(at // rows, width), pa.int32()), pa.array(np.repeat(at % rows, width), pa.int32()), pa.array(np.tile(np.arange(-1, width - 1), len(at)), pa.int32()), pa.array([Decimal(int(v)) for v in total[at].ravel()], SUM)],
            names=["position", "entry", "component", "total"],
        )

    told = distinct.mapInArrow(add, "position int, entry int, component int, total decimal(38,0)")
    out = told.groupBy("position", "entry", "component").agg(F.sum("total").cast("decimal(38,0)").alias("total")).toArrow()  # as many rows as codebooks have numbers
    held.unpersist()
    return out


def _moved(books: list[np.ndarray], sums: pa.Table) -> list[np.ndarray]:
    """Codebooks whose used entries are the whole means (rounded down) of their parts."""
    totals = {(p, e, c): int(t) for p, e, c, t in zip(*[sums.column(n).to_pylist() for n in ("position", "entry", "component", "total")], strict=True)}
    out = [b.copy() for b in books]
    for (p, e, c), total in totals.items():
        if c >= 0:
            out[p][e, c] = total // totals[p, e, -1]
    return out


def codebooks(distinct: DataFrame, start: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """``start`` after ``rounds`` rounds over the weighted parts (key: position and components, n); books that no longer move are final."""
    books = start
    for _ in range(rounds):
        moved = _moved(books, _sums(distinct, books))
        if all(np.array_equal(a, b) for a, b in zip(books, moved, strict=True)):
            break
        books = moved
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all numbers of all codebooks, in order, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors, and the codebooks: for each position, entries by components.

    Columns: the id, ``code`` (an entry's number as two hex digits for each part),
    ``error`` (squared distances summed over parts), ``label_error`` (errors summed
    over rows of equal label, null labels together); a sum beyond a long is its
    end. Vectors that are null or hold null or non-finite components have no row.
    A shorter vector counts as filled with zeros, and so does the width up to a
    multiple of ``parts``. Rows with equal or null ids are coded each; codebooks
    start from the least ids, then the least vectors, null ids last. Other columns
    are not read. An empty table has no codes and empty codebooks.
    """
    spark = vectors.sparkSession
    if not 1 <= entries <= 256:
        raise ValueError("a code of two hex digits names 1 to 256 entries")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit("")).alias("label"), whole(F.col(vector_col), scale).alias("v")).where("v is not null")
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    widest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-widest // parts)
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width * parts) - F.size("v")))
    rows = rows.withColumn("v", filled)
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()  # the codebooks themselves
    keys = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.concat(F.array(p.cast("long")), F.slice("v", p * width + 1, F.lit(width))))
    pieces = rows.select("row", "id", "label", F.explode(keys).alias("key"))
    distinct = checkpointed(pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    few = max(spark.sparkContext.defaultParallelism, -(-distinct.count() // TASK_PARTS))
    start = np.array([r[0] for r in first], np.int64).reshape(len(first), parts, width)
    books = [np.ascontiguousarray(start[:, p]) for p in range(parts)]
    if first:
        books = codebooks(distinct.coalesce(few), books, rounds)
    held = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, index, error = _assigned(batch.column(0), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(index.astype(np.int32)), pa.array(error)], names=["key", "entry", "error"])

    coded = distinct.select("key", "n").coalesce(few).mapInArrow(assign, "key array<long>, entry int, error long")
    met = join_by_parts(pieces, coded, hot_among(distinct, "key"), "key", "row")
    most = lambda total: F.least(total, F.lit(Decimal(LARGEST))).cast("long")
    code = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.element_at("key", 1).alias("p"), "entry"))), lambda s: F.lower(F.lpad(F.hex(s["entry"]), 2, "0"))), "")
    codes = checkpointed(met.groupBy("row", "id", "label").agg(code.alias("code"), most(F.sum(F.col("error").cast("decimal(20,0)"))).alias("error")))
    by_label = codes.groupBy("label").agg(most(F.sum(F.col("error").cast("decimal(20,0)"))).alias("label_error"))
    return salted_join(codes, by_label, "label", "row").select(F.col("id").alias(id_col), "code", "error", "label_error"), books


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compressed(table(spark, sf_dir, "embeddings"))
    return codes.withColumn("codebooks_sha256", F.lit(digest(books)))


def _rounds_sql() -> str:
    out = []
    for r in range(ROUNDS + 1):
        out.append(f"""a{r} AS MATERIALIZED (
  SELECT row, p, any_value(x) AS x, min(CAST(list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c) AS BIGINT) * 256 + e) AS best
  FROM parts JOIN c{r} USING (p) GROUP BY row, p
)""")
        if r < ROUNDS:
            out.append(f"""m{r} AS MATERIALIZED (
  SELECT p, e, list(mean ORDER BY i) AS c
  FROM (SELECT p, best % 256 AS e, i, floor(sum(x[i]) / count(*)) AS mean FROM a{r}, (SELECT unnest(range(1, (SELECT width FROM size) + 1)) AS i) GROUP BY ALL)
  GROUP BY p, e
), c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (p, e))""")
    return ",\n".join(out)


#: The same by brute force, a step for each round.
OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), size AS (SELECT max(len(v)) // 4 AS width FROM kept
), parts AS MATERIALIZED (
  SELECT row, vec_id, p, v[p * width + 1 : (p + 1) * width] AS x FROM kept, size, (SELECT unnest(range(4)) AS p)
), c0 AS MATERIALIZED (
  SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 256
),
{_rounds_sql()},
codes AS (
  SELECT row, string_agg(lpad(lower(hex(best % 256)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best // 256) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY row
), book AS (
  SELECT sha256(string_agg(numbers, ',' ORDER BY p, e)) AS codebooks_sha256
  FROM (SELECT p, e, array_to_string(list_transform(c, lambda x: x::BIGINT), ',') AS numbers FROM c{ROUNDS})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes USING (row), book
"""
