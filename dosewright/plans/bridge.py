"""Engine inputs derived from the driver's tables by integer rules that SQL can state too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """partkey, contig, pos, ref, alt of each part."""
    k = F.col("p_partkey")
    base = lambda n: F.substr(F.lit("ACGT"), (n % 4 + 1).cast("int"), F.lit(1))
    return table(spark, sf_dir, "part").select(k.alias("partkey"), (k % 22 + 1).cast("int").alias("contig"), (k * 10 + 1).cast("long").alias("pos"), base(k).alias("ref"), base(k + 1 + k % 3).alias("alt"), "p_size")


def terms(spark: SparkSession, sf_dir: str, by_part: bool = False) -> DataFrame:
    """Terms of eight scores; weights in hundredths. ``by_part``: rows are dealt by part once, and what follows by part needs no other shuffle."""
    own = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8).alias("score"), F.col("l_partkey").alias("partkey"), "l_returnflag", (F.col("l_suppkey") % 2 == 0).alias("effect_is_alt"), F.round(F.col("l_discount") * 100).cast("long").alias("w"))
    own = (own.repartition("partkey") if by_part else own).groupBy("score", "partkey", "l_returnflag", "effect_is_alt").agg((F.min("w") - 5).alias("w"))
    kind = F.when(F.col("l_returnflag") == "A", "additive").when(F.col("l_returnflag") == "N", "dominant").otherwise("recessive")
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    ordinal = F.col("partkey") * 6 + code * 2 + F.col("effect_is_alt").cast("int")
    own = own.select(F.concat(F.lit("S"), F.col("score")).alias("pgs_id"), ordinal.alias("ordinal"), "partkey", "effect_is_alt", kind.alias("model"), F.array(exact.from_int(F.col("w"), -2)).alias("weights"), "w", (F.col("partkey") % 13 == 0).alias("review"), (F.col("partkey") % 11 != 0).alias("resolved"))
    return own.join(sites(spark, sf_dir).drop("p_size"), "partkey")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per line item: sample, partkey, depth, quality and ALT dosage."""
    return _records(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


def _records(lines: DataFrame, orders: DataFrame) -> DataFrame:
    own = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return own.select((F.col("o_custkey") % 50).alias("sample"), F.col("l_partkey").alias("partkey"), F.col("l_quantity").cast("int").alias("depth"), (F.round(F.col("l_tax") * 100).cast("int") * 10).alias("quality"), (F.col("l_linenumber") % 3).alias("dosage"), "l_linestatus", F.col("l_linenumber"), "l_orderkey")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("sample").distinct()


def part_calls(spark: SparkSession, sf_dir: str, parts: DataFrame | None = None) -> DataFrame:
    """:func:`simple_calls` by part, dealt by part once; ``parts``: only of those (partkey)."""
    lines = table(spark, sf_dir, "lineitem")
    lines = lines if parts is None else lines.join(parts.select(F.col("partkey").alias("l_partkey")), "l_partkey", "left_semi")
    own = _records(lines, table(spark, sf_dir, "orders")).select("sample", "partkey", "depth", "dosage").repartition("partkey")
    return _stated(own)


def simple_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call for each sample and site with a record: ambiguous, low quality or observed."""
    own = _stated(records(spark, sf_dir))
    return own.join(sites(spark, sf_dir).drop("p_size"), "partkey").select("sample", "partkey", "contig", "pos", "ref", "alt", "state", "alt_dosage")


def _stated(records: DataFrame) -> DataFrame:
    own = records.groupBy("sample", "partkey").agg(F.count(F.lit(1)).alias("n"), F.min("depth").alias("depth"), F.min("dosage").alias("dosage"))
    state = F.when(F.col("n") > 1, "ambiguous_overlapping_records").when(F.col("depth") < 10, "low_quality").when(F.col("dosage") > 0, "observed_variant").otherwise("observed_reference")
    own = own.withColumn("state", state).withColumn("alt_dosage", F.when(F.col("state").startswith("observed"), F.col("dosage")))
    return own.select("sample", "partkey", "state", "alt_dosage")


def frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = sites(spark, sf_dir).where("partkey % 5 <> 0")
    return own.select("contig", "pos", "ref", "alt", exact.from_int(F.col("p_size") % 100, -2).alias("freq"), (F.col("partkey") % 7 == 0).alias("multiallelic"))
