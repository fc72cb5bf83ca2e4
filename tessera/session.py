"""Session helpers shared by the whole library."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tessera", master: str = "local[8]", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder stands in, but only on a local master, whose
    driver and executors are one process.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = getattr(spark.sparkContext, "_tessera_dir", None)
    if folder is None:
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext._tessera_dir = folder
    return folder


#: Folders written inside each open ``scratch``, the outermost first.
_scratches: list[list[str]] = []


def materialise(df: DataFrame, label: str, outlives: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it back.

    Everything built on the returned frame sees the same rows even if an executor is lost, because
    the rows come from files and not from a recomputation. ``outlives``: the files are kept when the
    innermost ``scratch`` is left.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    open_ = _scratches[: len(_scratches) - outlives]
    if open_:
        open_[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was materialised inside: for work whose result is written, too, before."""
    _scratches.append([])
    try:
        yield
    finally:
        for path in _scratches.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
