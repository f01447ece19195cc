"""Scores of samples whose calls arrive as files: a static join and exact sums per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import score

CALLS = "contig int, pos long, ref string, alt string, sample long, state string, alt_dosage int"


def score_arriving(spark: SparkSession, source: str, terms: DataFrame, sink: str, checkpoint: str, absent: str = "error") -> StreamingQuery:
    """Score each batch of new call files under ``source`` and add the rows to ``sink``.

    A sample's calls arrive in one batch, for every target unless ``absent`` names a status for those without. A batch that is run again after a failure replaces its own folder.
    """
    arriving = spark.readStream.schema(CALLS).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        score.cohort(terms, batch, absent=absent).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
