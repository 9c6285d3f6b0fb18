"""Results that must not be worked out twice, stored where all executors can read them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` stored in the cluster's shared checkpoint folder, its lineage cut.

    The folder is the session's ``spark.checkpoint.dir``. A folder of our own is
    made only where none is set and Spark runs in one process.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="earshot-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
