"""Reading tables, spreading work and cutting lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the data directory, as Parquet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is `spark.checkpoint.dir` of the session. Only where that is unset (local
    tests) a temporary folder of this machine is made, and only on a local master.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("gradeloom.shared.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="gradeloom-")
    spark.conf.set("gradeloom.shared.dir", made)
    return made


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


#: Intermediate tables that are still there, with their sessions.
_WRITTEN: dict[str, SparkSession] = {}


def release() -> int:
    """Deletes all intermediate tables; DataFrames that still read them can't be used any more. Returns their number."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path, spark = _WRITTEN.popitem()
        _remove(spark, path)
    return n


atexit.register(release)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which is deleted with the intermediate tables."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _WRITTEN[path] = spark
    return path


def is_kept(path: str) -> bool:
    """Whether an intermediate path hasn't been released."""
    return path in _WRITTEN


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Writes `df` as a table into the shared folder and reads it again.

    This cuts the lineage: later stages survive the loss of any executor without
    recomputing what came before, and sizes of the written table are known to the planner.
    The tables are deleted when the program ends, or by `release` once results are consumed.
    """
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame, at_least: int | None = None) -> DataFrame:
    """Shuffles only where the input has fewer splits than the cluster has cores.

    Costly Python work over one small file would else run in one task; large inputs
    have more splits than cores and pass unchanged.
    """
    want = at_least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keep_latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One row per key: the latest by `by`, as a hash aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in by], *[F.col(c) for c in rest if c not in by])
    best = df.groupBy(*keys).agg(F.max(order).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.{c}").alias(c) for c in rest])


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session, unless their path has it already."""
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parent
    if str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    sc = spark.sparkContext
    if getattr(sc, "_gradeloom_shipped", False):
        return
    base = Path(tempfile.mkdtemp(prefix="gradeloom-code-"))
    shutil.copytree(root, base / "code" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(str(base / "gradeloom_code"), "zip", base / "code"))
    sc._gradeloom_shipped = True
