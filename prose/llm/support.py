"""Small shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than these.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's ``spark.checkpoint.dir``.

    Only where that is unset (tests on one machine) a temporary folder is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: ends its lineage and outlives lost executors.

    The files go when the application ends, or with ``discard``. What the write has shuffled is
    garbage by then; asking for its collection frees that disk before the next step fills more.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_on_exit(spark, path)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    files, target = _file_system(spark, path)
    files.delete(target, True)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the application ends."""
    files, target = _file_system(spark, path)
    files.deleteOnExit(target)


def discard(df: DataFrame) -> None:
    """Delete the files of a cut that nothing will read any more."""
    delete(df.sparkSession, df.cut_path)


def words_of(text) -> "F.Column":
    """Array of the words of a text column; null or blank text: empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), lambda w: w != "")
