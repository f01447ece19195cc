"""The queries of the ten corpus operators and of the pipeline, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linededup, mixing, neighbours, packing, pages, passages, quality, sharding, simhash, tokenfile
from .tokens import public_vocabulary

END, CAPACITY, SHARDS = 0, 2048, 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_vocabulary(), CAPACITY, END)


def op2_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(_table(spark, sf_dir, "documents"), public_vocabulary(), END)


def op3_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op4_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op6_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(_table(spark, sf_dir, "pages"))


def op7_line_first_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assessed(_table(spark, sf_dir, "documents"))


def op8_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_table(spark, sf_dir, "documents"))


def op9_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), "passes", "taken")


def op10_collinear_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_pattern_packing, op2_bit_packed_tokens, op3_projected_neighbours, op4_rendezvous_shards, op5_simhash_components, op6_page_differencing, op7_line_first_quality, op8_line_alignment, op9_curriculum_mix, op10_collinear_passages, pipeline)
    return {f.__name__: f for f in own}


#: The mix in SQL: limits by rounds of one sorted pass, and documents by running sums over each whole source.
MIX = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3.0 * source_size AS most FROM s),
r AS (SELECT *, ((SELECT sum(source_size) FROM s) - coalesce(sum(most) OVER a, 0)) / sum(weight) OVER b AS share FROM w
  WINDOW a AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT arg_min(share, most / weight) AS share FROM r WHERE most >= share * weight),
t AS (SELECT r.source, r.source_size, CAST(CASE WHEN r.most < r.share * r.weight THEN r.most ELSE level.share * r.weight END AS DOUBLE) AS target FROM r, level),
d AS (SELECT z.doc_id, z.source, z.size, source_size, target, coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY k, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized z JOIN t ON z.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CAST(CASE WHEN size = 0 THEN 0 ELSE least(3, greatest(0, ceil((target - start) / source_size))) END AS INTEGER) AS passes FROM d)
SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target, passes, CAST(passes * size AS BIGINT) AS taken FROM p
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_curriculum_mix": MIX}
