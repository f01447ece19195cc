"""Weighted rendezvous hashing of stable record keys.

Each record goes to the shard with the greatest score -weight / ln(u), where u in (0, 1) comes from the
MD5 of the key and the shard's name. A shard's scores do not depend on the other shards, so one more
shard takes records only into itself, and one removed shard gives up only its own.

Everything is built-in expressions. The key is the text form of doc_id ('' for null); rows of one key
share a shard, whatever their number. Slots number the rows of a shard without gaps: rows are counted
per (shard, bucket) before any row is numbered, so that no task holds a whole shard, and equal rows are
counted first and numbered together, so that a hot key costs one row. Null texts have no bytes; an empty
table gives no rows. Columns of the input other than doc_id and text are not read by :func:`sharded`;
:func:`with_shard` keeps them all and adds one column under the name given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, unsigned_crc32


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of ``key``: an int from 0, below the number of weights."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("every shard needs a weight above 0")
    name = F.coalesce(key.cast("string"), F.lit(""))

    def score(k: int, weight: float) -> Column:
        # 52 bits of the digest, put in the middle of their cells: never 0, never 1.
        u = (F.conv(F.substring(F.md5(F.concat(name, F.lit(f"#{k}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
        return -F.lit(float(weight)) / F.log(u)

    scored = [F.struct(score(k, w).alias("score"), F.lit(-k).alias("shard")) for k, w in enumerate(weights)]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["shard"]).cast("int")


def with_shard(df: DataFrame, key: str, weights: Sequence[float], name: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; no shuffle."""
    return df.withColumn(fresh(df, name), rendezvous(F.col(key), weights))


def sharded(docs: DataFrame, weights: Sequence[float], grown: Sequence[float], buckets: int = 4096, run: int = 4096) -> DataFrame:
    """Size, checksum, shard, slot and grown shard of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        unsigned_crc32(F.col("text")).alias("text_crc32"),
    )
    same = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    same = same.withColumn("shard", rendezvous(F.col("doc_id"), weights)).withColumn("grown_shard", rendezvous(F.col("doc_id"), grown))
    same = same.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).cast("int"))
    counts = same.groupBy("shard", "bucket").agg(F.sum("n").alias("n_bucket"))  # shards x buckets rows
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("shard", "bucket", F.coalesce(F.sum("n_bucket").over(ahead), F.lit(0)).alias("begin"))
    within = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = same.withColumn("past", F.coalesce(F.sum("n").over(within), F.lit(0))).join(begins, ["shard", "bucket"])
    # A row repeated n times takes n slots, dealt out in runs so that no array grows with n.
    placed = placed.withColumn("first", F.col("begin") + F.col("past")).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / run))))
    low = F.col("first") + F.col("run") * run
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(low, F.least(low + run, F.col("first") + F.col("n")) - 1)).alias("slot"),
        "grown_shard",
    )


def write_shards(docs: DataFrame, path: str, weights: Sequence[float], files: int = 1) -> None:
    """All columns of ``docs`` as Parquet, a folder per shard with about ``files`` files in each."""
    name = fresh(docs, "shard")
    out = with_shard(docs, "doc_id", weights, name)
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(files))
    out.repartition(len(weights) * files, name, part).write.partitionBy(name).parquet(path)
