"""A bounded sample of labelled texts, on which a classifier is fitted."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts longer than this are left out of a sample (they are scored whole all the same).
LONGEST = 200_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, *, per_class: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 5) -> tuple[pa.Table, dict[int, int]]:
    """About ``per_class`` texts of each label (all, if fewer), and how many rows have each label.

    ``learn`` is a condition on the id. The sample is drawn by a hash of the id
    from the labels alone; only the texts of the sample leave their files. Null
    ids, labels and texts are not drawn; a document labelled twice counts once
    with its greater label.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & learn).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    counts = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    ticket = F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 20))
    wanted = F.lit(False)
    for y, n in counts.items():
        wanted = wanted | ((F.col("_y") == y) & (ticket < int(min(1.0, per_class / n) * (1 << 20))))
    chosen = F.broadcast(known.where(wanted))  # about 2 * per_class ids
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(chosen, "_id").where(F.length("_text") <= LONGEST)
    return texts.orderBy("_id", "_text").toArrow(), counts
