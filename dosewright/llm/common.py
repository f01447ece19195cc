"""Shared folder, written intermediate tables and column-name helpers for the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import scratch_path, shared_dir, written  # noqa: F401  (the corpus operators take them from here)

#: Words are runs of anything but ASCII white space, as a Java and as a Python pattern.
WORD = r"[^\x20\x09-\x0D]+"


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written`, once nothing will read it again."""
    spark, path = df.sparkSession, getattr(df, "_written_path", None)
    if path:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name close to ``name`` that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def unsigned_crc32(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def n_words(text: Column) -> Column:
    """Number of words in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
