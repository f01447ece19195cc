"""Mixing sources to target weights with a time-varying curriculum.

Targets: sources weigh 1, 2, 3, repeating by code point (null last), and share 100 % of all words; a
target stops at ``most`` times its source's words and the excess is shared again by weight until no
target is above (solved at once from the sources in order of limit over weight).

Positions: training time runs from 0 to 1. A source's weight at time x is its target times a straight
line of mean 1, from 1 - ``slope`` to 1 + ``slope``; slopes alternate in sign by source, so that the mix
shifts over time while each source still gets its whole target. The words of a source wanted up to x,
D(x) = target (x + slope (x^2 - x)), are the integral of that schedule. A source's documents follow each
other in a fixed pseudo-random order (MD5 of doc_id), again and again; a pass of a document that starts after
c words has the position D^-1(c). The passes whose position lies before the end of training are taken, and
nothing else decides what is: a target of at most three times the source means three passes at most.

Running sums need no task that holds a source: words are summed for (source, first digits of the MD5)
first, and only documents that share both are sorted together. Rows of one doc_id in a source are
taken in order of size and text hash; equal rows may swap places, which changes no result.

Null texts and texts without words have size 0 and are taken 0 words (position null). Null sources are
one source, null doc_ids order as ''. Empty tables give no rows. Extra columns are kept by :func:`mixed`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, n_words, written


def targets(totals: DataFrame, most: float = 3.0) -> DataFrame:
    """source, source_size, weight, target and slope sign of each source of ``totals`` (source, source_size).

    One row per source throughout; all sources meet in one window because a target depends on them all.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    own = totals.withColumn("place", F.row_number().over(by_name) - 1).withColumn("weight", F.col("place") % 3 + 1)
    full = (F.col("source_size") * F.lit(most)).alias("full")
    own = own.withColumn("full", full)
    by_limit = Window.orderBy(F.col("full") / F.col("weight"), "place")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    behind = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = own.withColumn("share", (F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(behind))
    own = own.withColumn("stops", F.col("full") < F.col("share") * F.col("weight"))
    # A source that stops leaves more for the others; the first that does not stop in this order has the final share.
    level = F.min(F.when(~F.col("stops"), F.struct(F.col("full") / F.col("weight"), "place", "share"))).over(everything)["share"]
    own = own.withColumn("level", level)
    target = F.when(F.col("stops"), F.col("full")).otherwise(F.col("level") * F.col("weight"))
    return own.select("source", "source_size", "weight", target.cast("double").alias("target"), F.when(F.col("place") % 2 == 0, 1.0).otherwise(-1.0).alias("turn"))


def _inverse(c, target, slope):
    """The time x at which target (x + slope (x^2 - x)) reaches c, in a form without cancellation."""
    share = c / target
    # At a share of 1 the root is 1 + slope, so the target itself is never reached before time 1 for any rounding; NaN is what no time reaches.
    return 2 * share / ((1 - slope) + F.sqrt((1 + slope) * (1 + slope) - 4 * slope * (1 - share)))


def mix(docs: DataFrame, most: float = 3.0, slope: float = 0.5, digits: int = 3) -> DataFrame:
    """doc_id, th, source, size, source_size, target, passes, taken and positions of every row of ``docs`` (doc_id, text, source)."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), key.alias("key"))
    sized = written(sized.withColumn("bucket", F.substring("key", 1, digits)), "sizes")
    buckets = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n"))  # 16^digits rows a source at most
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = buckets.select("source", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("begin"))
    goals = targets(buckets.groupBy("source").agg(F.sum("n").alias("source_size")), most)
    begins = begins.alias("b").join(goals.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select("b.source", "bucket", "begin", "source_size", "target", "turn")
    within = Window.partitionBy("source", "bucket").orderBy("key", "size", "th").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("past", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.alias("d").join(begins.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.bucket") == F.col("b.bucket")))
    start = (F.col("begin") + F.col("past")).alias("start")
    out = joined.select("doc_id", "th", "d.source", "size", "source_size", "target", F.col("turn") * slope, start).toDF("doc_id", "th", "source", "size", "source_size", "target", "slope", "start")
    # Pass p of a document starts after p whole sources and start words.
    each = F.transform(F.array(*(F.lit(p) for p in range(max(1, math.ceil(most))))), lambda p: _inverse((p * F.col("source_size") + F.col("start")).cast("double"), F.col("target"), F.col("slope")))
    wanted = (F.col("size") > 0) & (F.col("target") > 0)
    out = out.withColumn("positions", F.when(wanted, F.filter(each, lambda x: x < 1)).otherwise(F.array().cast("array<double>")))
    out = out.withColumn("passes", F.size("positions"))
    out = out.withColumn("taken", F.col("passes") * F.col("size"))
    return out.select("doc_id", "th", "source", "size", "source_size", "target", "passes", "positions", "taken")


def mixed(docs: DataFrame, most: float = 3.0, slope: float = 0.5) -> DataFrame:
    """The training order: each row of ``docs`` as often as it is taken, range-sorted by position; all its columns."""
    i, t, s, n, z, p = (fresh(docs, x) for x in ("mix_id", "mix_text", "mix_source", "mix_turn", "mix_plan", "mix_position"))

    def keyed(rows: DataFrame, text) -> DataFrame:
        """Rows that share doc_id, text and source are numbered in any order, so that each meets one plan."""
        out = rows.withColumns({i: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), t: text, s: F.coalesce(F.col("source").cast("string"), F.lit(""))})
        return out.withColumn(n, F.row_number().over(Window.partitionBy(i, t, s).orderBy(i)))

    plan = keyed(mix(docs, most, slope), F.col("th")).select(i, t, s, n, F.col("positions").alias(z))
    own = keyed(docs, F.xxhash64("text")).join(plan, [i, t, s, n]).withColumn(p, F.explode(z))
    return own.repartitionByRange(p, i).sortWithinPartitions(p, i).select(*docs.columns)
