"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigflow.session import ensure_checkpoint_dir

# The white space that the text contracts name: [\x20\x09-\x0D].
ASCII_SPACES = " \t\n\x0b\x0c\r"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder. Spark deletes it when
    the driver ends; until then lazily evaluated results may still read it."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/sigflow-llm/{name}-{uuid.uuid4().hex[:12]}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jpath)
    fs.deleteOnExit(jpath)
    return path


def materialise(df: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts
    the lineage, survives executor loss and keeps column statistics. For rows of
    megabytes: ``group_bytes`` of a row group, which a task holds whole when it
    writes and when it reads (by default as much as a file's block, 128 MB)."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    w = df.write.mode("overwrite")
    if group_bytes:                                   # looked at after every row, else after a hundred
        w = w.options(**{"parquet.block.size": group_bytes, "parquet.page.size.row.check.min": 1,
                         "parquet.page.size.row.check.max": 1})
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table written by ``materialise`` that nothing
    will read again."""
    spark = df.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/sigflow-llm/" in f}
    for folder in folders:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def fix_splits(spark: SparkSession) -> None:
    """Let scans cut files alike for the rest of the session. Spark's default
    depends on the number of cores just now, so that losing executors between
    two scans would number rows differently."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def text_of(col: str) -> Column:
    """The text, with NULL counted as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def strip_spaces(c: Column) -> Column:
    """Delete every character of ``ASCII_SPACES``. One ``replace`` per
    character scans bytes, which is much faster than a regular expression."""
    for ch in ASCII_SPACES:
        c = F.replace(c, F.lit(ch), F.lit(""))
    return c


def crc32_mod(col: str, m: int) -> Column:
    """crc32 of the value as text, modulo ``m``; NULL counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % m
