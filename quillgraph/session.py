"""Session defaults, and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Runtime re-planning carries most of the skew handling; these are the
# settings the library expects.  A cluster may set its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Hash instead of sort-merge joins, but only where every partition is known to be small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: str | int = "*", memory: str = "12g", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillgraph")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
    )
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a
    cluster without it is an error, because a node's own disk would not survive
    the node.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = os.path.join(tempfile.gettempdir(), "quillgraph-checkpoints")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame, schema: StructType | None = None, plain: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    A written table survives the loss of any executor, ends the lineage, and
    tells the optimiser its true size: the size estimates of a plan that joins
    round after round grow without bound, those of a file do not.  ``schema``
    reads the same fields back under other types.

    Ids packed as Parquet does it take a fraction of their memory, and a join
    would broadcast a million of them as a small table.  A ``plain`` table, for
    a few numbers a row, is as large as it counts.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4()}"
    packing = {"compression": "none", "parquet.enable.dictionary": "false"} if plain else {}
    df.write.options(**packing).parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """Persist a table that one operator reads several times (recomputed if lost)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
