"""Work tables: intermediate results written once to the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where that is unset and the master is local (tests) a folder of this process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir: executors share no local folders")
    return base or _own.setdefault("dir", tempfile.mkdtemp(prefix="siftline-"))


def _delete(spark: SparkSession, path: str, at_exit: bool) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(p) if at_exit else fs.delete(p, True)


def work_path(spark: SparkSession) -> str:
    """A new folder below shared_dir(), deleted when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/siftline-{uuid.uuid4().hex}"
    _delete(spark, path, at_exit=True)
    return path


def lasting_path(spark: SparkSession, name: str) -> str:
    """A new folder for files that outlive the application: below spark.siftline.output.dir, else below shared_dir()."""
    base = spark.conf.get("spark.siftline.output.dir", None) or shared_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def work_table(df: DataFrame, **options: str) -> DataFrame:
    """Writes df as Parquet and reads it again: lineage ends here, and a lost executor costs no recomputation.

    Afterwards the shuffle files of what made df are garbage; the JVM is asked to collect them now, since they would
    otherwise stay on the executors' disks for as long as the driver has heap to spare.
    """
    spark = df.sparkSession
    path = work_path(spark)
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    schema = df.schema
    del df
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def bucketed_table(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """A work table in as many buckets by key as there are shuffle partitions, and its name in the session's catalog.

    Joins on the key read it where it lies, without a shuffle. If df is dealt by the key already (by a join on it), a task writes its own buckets only.
    """
    spark = df.sparkSession
    name = f"siftline_{uuid.uuid4().hex}"
    df.write.bucketBy(shuffle_parts(spark), key).option("compression", "zstd").option("path", work_path(spark)).saveAsTable(name)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.table(name), name


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a work table that no later step reads."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path, at_exit=False)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
