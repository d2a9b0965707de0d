"""Session helpers shared by every module: scratch folders and shipping this package to executors."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parent


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset and the master is local (tests, a
    single machine) a temporary folder is made and set as the checkpoint folder of the session.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="veilframe-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        sc.setCheckpointDir(f"file://{local}")
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/veilframe-{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as Parquet, with a folder for each value of ``by``, and read it back. The table goes when the application ends, if nothing deletes it before."""
    spark = df.sparkSession
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    made = spark.read.schema(df.schema).parquet(path)
    made._scratch_path = path
    return made


def size(df: DataFrame) -> int:
    """Bytes of a written table, without a job."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder for files that are written under it; it goes when the application ends."""
    path = scratch_path(spark, name)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """``values`` as settings of the session for what runs inside; those before it come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    return _written(df, scratch_path(df.sparkSession, name))


class Scratch:
    """Tables of one run, which go together when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
        """``materialize``, remembered."""
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        return _written(df, path, by)

    def size(self, df: DataFrame) -> int:
        """Bytes of a table of this run, without a job."""
        return size(df)

    def drop(self, df: DataFrame, part: str = "") -> None:
        """Delete a table, or a folder of it, before the run's end."""
        drop_path(self.spark, f"{df._scratch_path}/{part}" if part else df._scratch_path)
        if not part:
            self.paths.remove(df._scratch_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A ``Scratch`` whose tables are deleted at the end; what is returned must be materialized outside of it."""
    made = Scratch(spark)
    try:
        yield made
    finally:
        for path in made.paths:
            drop_path(spark, path)
        release(spark)


def release(spark: SparkSession, settle: float = 0.0) -> None:
    """Let Spark delete the shuffle files of DataFrames that nothing refers to any more.

    A job's own bookkeeping refers to its shuffles for a moment after its end. Where the shuffle of the last job matters,
    ``settle`` seconds are waited for it, and for what the first collection has let go of.
    """
    for wait in (settle, settle) if settle else (0.0,):
        time.sleep(wait)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Bounds of an Arrow batch on its way to Python: whole texts can be long, and each worker holds a few batches.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session and make this package importable in Python workers, once per application."""
    for name, value in ARROW_BATCH.items():
        spark.conf.set(name, value)
    sc = spark.sparkContext
    if getattr(sc, "_veilframe_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="veilframe-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "veilframe-src.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(archive))
    sc._veilframe_shipped = True


def dealt_anew(df: DataFrame, column: str) -> DataFrame:
    """``df`` with an equal ``column`` (long or binary) that Spark doesn't know to be dealt out already.

    An aggregate that is joined on its own key goes into the join as it is dealt, and Spark doesn't split a hot key there:
    it splits joins between two shuffles only. Of an aggregate dealt anew the join is one.
    """
    c = F.col(column)
    same = F.substring(c, 1, (1 << 31) - 1) if dict(df.dtypes)[column] == "binary" else c.bitwiseXOR(F.lit(0))
    return df.withColumn(column, same)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
