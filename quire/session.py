"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table ``name`` of the data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests, notebooks) a temporary folder is used;
    on a cluster each executor would write to its own disk, so that is refused.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or (
        sc._jsc.sc().getCheckpointDir().get() if sc._jsc.sc().getCheckpointDir().isDefined() else None
    )
    if folder is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quire-")
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a table into the shared folder and go on from its files.

    The files survive the loss of executors, are compressed by column, and are removed when the
    driver ends.
    """
    return cut_all(iter([df]), codec)


def cut_all(parts: Iterator[DataFrame], codec: str = "zstd") -> DataFrame:
    """Write frames of one schema as one table, each before the next is asked for."""
    path = None
    for df in parts:
        if path is None:
            path = f"{shared_folder(df.sparkSession).rstrip('/')}/quire-{uuid.uuid4().hex}"
            if not _written:
                atexit.register(_remove)
            _written.append((df.sparkSession, path))
        df.write.mode("append").option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quire_path = path
    return out


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows over all cores before costly Python work, those that are equal ``by`` these columns together.

    Adaptive execution joins small partitions to one, which is right for the JVM's work but not for
    a function that takes a millisecond a row.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *by)


def discard(df: DataFrame) -> None:
    """Remove the files of a table that ``cut`` wrote and nothing reads any more."""
    _delete(df.sparkSession, df._quire_path)
    _written.remove((df.sparkSession, df._quire_path))


_written: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _remove() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended; what is left lies in the temporary folder
            return


def local_session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the benchmark."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    b = (
        SparkSession.builder.master(f"local[{n}]")
        .appName("quire")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
