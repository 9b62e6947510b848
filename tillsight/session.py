"""Spark session settings and the shared checkpoint folder.

Operators are ``DataFrame -> DataFrame`` functions (a few write a stage to the shared folder
while they are called and say so); the only knobs that matter at scale are set here: AQE (runtime coalescing, skew-join
splitting), shuffle partition count, scan split size and the UTC session zone.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # CPU-heavy text stages should not be coalesced into one task on small
    # inputs; at large scale partitions are far above this floor anyway
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a JSON object that repeats a key parses, the last one wins, as Python's parser does
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "tillsight", extra: dict | None = None) -> SparkSession:
    """Build (or fetch) a session with the package defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; size
    ``shuffle_partitions`` so one shuffle partition holds ~128-256 MB.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, snapshots and staged files.

    The cluster names it in ``spark.checkpoint.dir``; it is read from the session.  Only on a
    local master, where driver and executors are one process, may it be unset: then a
    fresh folder is made and registered.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="tillsight-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once into the shared folder and read back: cuts lineage, is computed once,
    and branches read it with column pruning."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


#: Shuffle files of a query go when it ends; else when the driver happens to collect its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_lean(df: DataFrame, path: str, by: Sequence[str] = (), mode: str = "error") -> None:
    """``df`` written as closely packed parquet; the shuffle files of the write go with its end, so steps that are
    written one after the other need the disk of one of them at a time."""
    conf = df.sparkSession.conf
    before = conf.get(DROP_SHUFFLES, "false")
    conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        conf.set(DROP_SHUFFLES, before)


def stored_lean(df: DataFrame, name: str) -> DataFrame:
    """As ``stored``, by ``write_lean``: for tables as large as the input."""
    path = scratch_path(df.sparkSession, name)
    write_lean(df, path)
    return df.sparkSession.read.parquet(path)


#: Bytes of input files from which groups are worked off in more slices than one, and the most slices.
SLICE_BYTES = 512 << 20
MAX_SLICES = 8


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads; rows that are no files have no known size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def slice_count(df: DataFrame) -> int:
    """In how many slices ``df`` is best worked off, by the size of the files that it reads."""
    return min(MAX_SLICES, 1 + input_bytes(df) // SLICE_BYTES)


def few_tasks(spark: SparkSession) -> int:
    """Tasks that are enough for work that is many small pieces."""
    return 4 * spark.sparkContext.defaultParallelism


def slice_of(df: DataFrame, keys: Sequence[str], n: int, k: int) -> DataFrame:
    """The groups of slice ``k``; rows with the same keys, nulls too, are in the same slice."""
    return df.filter(F.pmod(F.xxhash64(*[F.col(c) for c in keys]), F.lit(n)) == k) if n > 1 else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """The path of a sub-folder of the shared folder that does not exist yet; Spark's writers make it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
