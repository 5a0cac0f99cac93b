"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent (a local test session) is a folder of
    this machine taken.
    """
    sc = spark.sparkContext
    if getattr(sc, "_weftline_folder", None):
        return sc._weftline_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = named or tempfile.mkdtemp(prefix="weftline-")
    sc._weftline_folder = f"{root.rstrip('/')}/weftline-{uuid.uuid4().hex}"
    path = sc._jvm.org.apache.hadoop.fs.Path(sc._weftline_folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return sc._weftline_folder


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, which cuts its lineage.

    Survives the loss of executors, unlike a cache of one copy; runs the plan
    once; and the optimizer knows the table's size.  The folder goes when the
    driver's JVM ends; ``discard`` drops a table that is needed no more.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a ``durable`` table that nothing will read again."""
    if path := getattr(df, "_weftline_path", None):
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of the plan's rows as the optimizer estimates them; nothing is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly to all cores before a Python-bound step, where the scan would leave cores idle.

    A table of more bytes than two splits a core stays as it is read, so no
    texts cross the network.  A smaller one is dealt in turn, whatever its
    keys, to one task a core or to as many of 32 MB.
    """
    spark = df.sparkSession
    cores, size = spark.sparkContext.defaultParallelism, estimated_bytes(df)
    if size >= 2 * cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        return df
    return df.repartition(max(cores, size >> 25))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_safe_text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per Spark context.

    A driver may have the package on its own path alone; workers then find it
    in the archive that Spark hands out.
    """
    sc = spark.sparkContext
    if getattr(sc, "_weftline_shipped", False):
        return
    here = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="weftline-")) / "weftline.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(archive))
    sc._weftline_shipped = True
