"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of a text, as the contracts define it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor and the driver see: spark.checkpoint.dir, or in local tests one of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="veinlode-")
        sc.setCheckpointDir(found)
    return found


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now; it does so when the driver collects its garbage. What
    Python lets go of reaches the JVM a moment later, so there are two rounds."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.4)


def trimmed(run):
    """``run`` over the batches of a task; after the last one what Python has freed goes back to the system, as workers
    are used again by other steps."""

    def own(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries do without
            if trim is not None:
                trim(0)

    return own


def folder(spark: SparkSession, path: str):
    """Hadoop file system and path object of ``path``."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete a stashed table once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        fs, p = folder(spark, path)
        fs.delete(p, True)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for an operator's own columns that ``df`` doesn't have yet, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def undotted(df: DataFrame) -> DataFrame:
    """``df`` with other names for columns that have a dot in theirs, which mapInArrow doesn't take."""
    return df.toDF(*[f"column_{i}" if "." in c else c for i, c in enumerate(df.columns)])
