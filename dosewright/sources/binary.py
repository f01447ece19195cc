"""Reference bases and PLINK 1 filesets as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import intervals, terms
from .text import numbered_lines


def fasta_chunks(spark: SparkSession, path: str, width: int = 1 << 14, margin: int = 1 << 10) -> DataFrame:
    """(contig, name, chunk, first, bases): upper-case bases of a FASTA file in chunks, each with ``margin`` more on both sides.

    Position p lies in chunk (p - 1) div width; ``first`` is the position of a chunk's first base. Sequence lines of a
    contig have one length but for the last, as an index of the file demands; other lengths and letters are errors.
    """
    lines = numbered_lines(spark, path, "trim(line) <> ''")
    heads = lines.where(F.col("line").startswith(">")).withColumn("name", F.regexp_extract("line", r"^>(\S+)", 1))
    after = F.lead("n").over(Window.partitionBy("file").orderBy("n"))  # a row for each contig
    heads = heads.select("file", "name", (F.col("n") + 1).alias("__from"), F.coalesce(after - 1, F.lit((1 << 62) - 1)).alias("__to"))
    rows = lines.where(~F.col("line").startswith(">")).withColumn("line", F.upper(F.trim("line")))
    rows = rows.withColumn("__n2", F.col("n"))
    total = lines.groupBy("file").agg(F.max("n").alias("__last"))
    heads = heads.join(total, "file").withColumn("__to", F.least("__to", "__last")).drop("__last")
    rows = intervals.range_join(rows, heads, ["file"], ("n", "__n2"), ("__from", "__to"), 1 << 16)
    step = rows.where("n = __from").select("file", "name", F.length("line").alias("step"))
    rows = rows.join(step, ["file", "name"]).withColumn("at", (F.col("n") - F.col("__from")) * F.col("step"))
    wrong = (F.length("line") > F.col("step")) | ((F.length("line") < F.col("step")) & (F.col("n") < F.col("__to"))) | F.col("line").rlike("[^ACGTN]")
    rows = rows.withColumn("line", F.when(wrong, F.raise_error(F.concat(F.lit("sequence line of another length or with other letters in "), "name"))).otherwise(F.col("line")))
    low, high = F.col("at") - margin, F.col("at") + F.length("line") - 1 + margin
    parts = rows.withColumn("chunk", F.explode(F.sequence(F.greatest(F.lit(0), F.floor(low / width)).cast("long"), F.floor(high / width).cast("long"))))
    begin, end = F.greatest(F.col("at"), F.col("chunk") * width - margin), F.least(F.col("at") + F.length("line"), (F.col("chunk") + 1) * width + margin)
    piece = F.substr("line", (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int"))
    own = parts.where(end > begin).select(terms.contig_code(F.col("name")).cast("int").alias("contig"), "name", "chunk", begin.alias("begin"), piece.alias("piece"))
    bases = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "piece"))), lambda x: x["piece"]), "")
    return own.groupBy("contig", "name", "chunk").agg((F.min("begin") + 1).alias("first"), bases.alias("bases"))


def contig_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("contig").agg(F.max(F.col("first") + F.length("bases") - 1).alias("length"))


def with_span(rows: DataFrame, chunks: DataFrame, start: Column, end: Column, name: str, width: int = 1 << 14) -> DataFrame:
    """``rows`` with the reference bases from ``start`` to ``end`` around their pos (both within a chunk's margin); null where the reference lacks any of them."""
    own = rows.withColumn("__c", F.floor((F.col("pos") - 1) / width))
    bases = chunks.select(F.col("contig").alias("__contig"), F.col("chunk").alias("__chunk"), F.col("first").alias("__first"), F.col("bases").alias("__bases"))
    joined = own.join(bases, (F.col("contig") == F.col("__contig")) & (F.col("__c") == F.col("__chunk")), "left")
    size = (end - start + 1).cast("int")
    found = F.substr("__bases", (start - F.col("__first") + 1).cast("int"), size)
    return joined.withColumn(name, F.when((F.length(found) == size) & (start >= F.col("__first")), found)).drop("__c", "__contig", "__chunk", "__first", "__bases")


def with_bases(rows: DataFrame, chunks: DataFrame, name: str = "base", width: int = 1 << 14) -> DataFrame:
    """``rows`` with the reference base at (contig, pos); null outside the reference."""
    return with_span(rows, chunks, F.col("pos"), F.col("pos"), name, width)


def plink_dosages(spark: SparkSession, prefix: str) -> DataFrame:
    """(line, contig, pos, ref, alt, sample, dosage) of a PLINK 1 fileset; dosage counts A1 and is null where missing."""
    table = lambda end, names: spark.read.text(f"{prefix}.{end}").select(F.monotonically_increasing_id().alias("k"), F.split("value", r"[ \t]+").alias("f")).select((F.row_number().over(Window.orderBy("k")) - 1).alias("k"), *(F.get("f", F.lit(i)).alias(n) for i, n in names.items()))
    samples = table("fam", {1: "sample"})
    variants = table("bim", {0: "chrom", 3: "pos", 4: "alt", 5: "ref"})
    count = samples.count()
    row = (count + 3) // 4
    codes = np.array([2, -1, 1, 0], np.int8)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                if content[:3] != b"\x6c\x1b\x01":
                    raise ValueError("not a SNP-major .bed file")
                for line, at in enumerate(range(3, len(content), row)):
                    raw = np.frombuffer(content[at : at + row], np.uint8)
                    two = (raw[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
                    own = codes[two.ravel()[:count]]
                    yield pd.DataFrame({"k": np.int64(line), "s": np.arange(count, dtype=np.int64), "dosage": own.astype(np.int32)})

    cells = spark.read.format("binaryFile").load(f"{prefix}.bed").select("content").mapInPandas(unpack, "k long, s long, dosage int")
    cells = cells.withColumn("dosage", F.when(F.col("dosage") >= 0, F.col("dosage")))
    chrom = F.when(F.col("chrom").isin("25", "XY", "PAR1", "PAR2", "23"), "X").when(F.col("chrom") == "24", "Y").when(F.col("chrom") == "26", "MT").otherwise(F.col("chrom"))
    own = variants.select(F.col("k").cast("long").alias("k"), terms.contig_code(chrom).cast("int").alias("contig"), F.col("pos").cast("int").alias("pos"), "ref", "alt")
    return cells.join(own, "k").join(samples.select(F.col("k").cast("long").alias("s"), "sample"), "s").select(F.col("k").alias("line"), "contig", "pos", "ref", "alt", "sample", "dosage")
