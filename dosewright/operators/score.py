"""Scores: what each term contributes, and the exact sums, coverage and states per score and sample.

Every term counts for every sample. A term that needs review or has no orientation needs no call; any other needs
one for each sample, and a sample without one is an error, or ``unknown_no_record`` where that is asked for.

Sums are sparse: only calls that are there are joined with their terms, and what is the same for all samples of a
score (its terms, the ones that cannot be scored, its whole weight) is counted once per score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact
from .calls import OBSERVED

SCORABLE, REVIEW, UNRESOLVED, ABSENT = "scorable_observation", "model_term_requires_review", "unresolved_orientation", "unknown_no_record"
SITE = ["contig", "pos", "ref", "alt"]
#: Positions of chrX outside the pseudo-autosomal regions: (after, up to) of both regions within.
PAR = ((10_000, 2_781_479), (155_701_382, 156_030_895))


def in_par(pos: Column) -> Column:
    (a, b), (c, d) = PAR
    return ((pos > a) & (pos <= b)) | ((pos > c) & (pos <= d))


def withheld() -> Column:
    """Why a term of columns review and resolved cannot be scored for any sample; null for the others."""
    return F.when(F.coalesce("review", F.lit(False)), REVIEW).when(~F.coalesce("resolved", F.lit(False)), UNRESOLVED)


def _scored(joined: DataFrame, status: Column) -> DataFrame:
    """Adds effect_dosage, weight, times and the final status to terms with a state and alt_dosage."""
    d = F.when(F.col("effect_is_alt"), F.col("alt_dosage")).otherwise(2 - F.col("alt_dosage"))
    out = joined.withColumn("status", status)
    out = out.withColumn("effect_dosage", F.when(F.col("status") == SCORABLE, d))
    d = F.col("effect_dosage")
    out = out.withColumn("weight", F.when(F.col("model") == "dosage_weights", F.get("weights", d)).otherwise(F.get("weights", F.lit(0))))
    out = out.withColumn("status", F.when((F.col("status") == SCORABLE) & F.col("weight").isNull(), REVIEW).otherwise(F.col("status")))
    times = F.when(F.col("model") == "additive", d).when(F.col("model") == "dominant", (d > 0).cast("int"))
    times = times.when(F.col("model") == "recessive", (d == 2).cast("int")).otherwise(F.lit(1))
    return out.withColumn("times", F.when(F.col("status") == SCORABLE, times))


def samples_of(calls: DataFrame) -> DataFrame:
    return calls.select("sample").distinct()


def _absence(absent: str) -> Column:
    if absent == "error":
        return F.raise_error(F.concat(F.lit("no call for a target of "), F.col("pgs_id").cast("string"), F.lit(" at "), F.coalesce(F.col("contig").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("pos").cast("string"), F.lit(""))))
    return F.lit(absent)


def outcomes(terms: DataFrame, calls: DataFrame, samples: DataFrame | None = None, absent: str = "error", site: list[str] = SITE) -> DataFrame:
    """Each term for each sample: status, effect dosage, and the weight that counts and how often.

    ``terms``: pgs_id, ordinal, contig, pos, ref, alt, effect_is_alt, model, weights (array of exact),
    review (boolean), resolved (boolean). ``calls``: contig, pos, ref, alt, sample, state, alt_dosage, one row for
    a target and sample. ``absent``: the status of a term without a call, or 'error'. ``samples`` with a pgs_id:
    only those of the term's score. ``site``: the columns of a target in both tables.
    """
    samples = samples if samples is not None else samples_of(calls)
    rows = terms.join(samples, "pgs_id") if "pgs_id" in samples.columns else terms.crossJoin(samples)  # the result has a row for each pair
    joined = rows.join(calls.select(*site, "sample", "state", "alt_dosage"), [*site, "sample"], "left")
    status = F.coalesce(withheld(), F.when(F.col("state").isin(*OBSERVED), SCORABLE), F.col("state"), _absence(absent))
    return _scored(joined, status)


def called(terms: DataFrame, calls: DataFrame) -> DataFrame:
    """The rows of :func:`outcomes` that have a call and may count: terms that are not withheld, for samples with a call."""
    joined = terms.where(withheld().isNull()).join(calls.select(*SITE, "sample", "state", "alt_dosage"), SITE)
    return _scored(joined, F.when(F.col("state").isin(*OBSERVED), SCORABLE).otherwise(F.col("state")))


def hemizygous(rows: DataFrame, karyotype: str = "XY") -> DataFrame:
    """``outcomes`` with chrX outside the pseudo-autosomal regions counted once for XY samples."""
    if karyotype != "XY":
        return rows
    single = (F.col("contig") == 23) & ~in_par(F.col("pos")) & (F.col("status") == SCORABLE)
    out = rows.withColumn("__single", F.coalesce(single, F.lit(False))).withColumn("__mixed", F.col("__single") & (F.col("effect_dosage") == 1))
    half = F.col("__single") & (F.col("model") == "additive")
    times = F.when(F.col("__mixed"), None).when(half, (F.col("times") / 2).cast("int")).otherwise(F.col("times"))
    dosage = F.when(F.col("__mixed"), None).when(F.col("__single"), (F.col("effect_dosage") / 2).cast("int")).otherwise(F.col("effect_dosage"))
    status = F.when(F.col("__mixed"), "heterozygous_call_in_hemizygous_region").otherwise(F.col("status"))
    return out.withColumns({"times": times, "effect_dosage": dosage, "status": status}).drop("__single", "__mixed")


def effect_size(weights: Column, model: Column) -> Column:
    """What a term can change, as a double: its weight's size, or the larger step from dosage 0; null without a valid weight."""
    w = lambda k: exact.to_double(F.get(weights, F.lit(k)))
    steps = F.when(w(0).isNotNull() & w(1).isNotNull() & w(2).isNotNull(), F.greatest(F.abs(w(1) - w(0)), F.abs(w(2) - w(0))))
    return F.when(model == "dosage_weights", steps).otherwise(F.abs(w(0)))


def summary(rows: DataFrame, keys: tuple[str, ...] = ("pgs_id", "sample")) -> DataFrame:
    """Per score and sample, in one pass over the rows that count: scorable terms, their exact sum (``total``) and their ``used`` size."""
    k, ok = list(keys), F.col("status") == SCORABLE
    own = rows.where(ok).select(*k, F.col("weight.exp").alias("__low"), "times", effect_size(F.col("weights"), F.col("model")).alias("__size"), F.posexplode(exact.limbs(F.col("weight"))).alias("__k", "__l"))
    first = F.col("__k") == 0
    sums = own.groupBy(*k, F.col("__l.exp").alias("exp")).agg(*exact.limb_sums(F.col("__l.limb"), F.col("times")), F.min("__low").alias("__low"), F.count_if(first).alias("__n"), F.sum(F.when(first, F.col("__size"))).alias("__used"))
    grouped = sums.groupBy(*k).agg(F.collect_list(F.struct("exp", "high", "low")).alias("__parts"), F.min("__low").alias("__low"), F.sum("__n").alias("scorable"), F.coalesce(F.sum("__used"), F.lit(0.0)).alias("used"))
    return grouped.select(*k, "scorable", "used", exact.joined("__parts", "__low").alias("total"))


def _grid(terms: DataFrame, samples: DataFrame) -> DataFrame:
    """A row for each score and sample: the score's terms, those that need a call, those without a valid weight, and its whole size."""
    size = effect_size(F.col("weights"), F.col("model"))
    own = terms.groupBy("pgs_id").agg(F.count(F.lit(1)).alias("terms"), F.count_if(withheld().isNull()).alias("needed"), F.count_if(size.isNull()).alias("terms_without_weight"), F.coalesce(F.sum(size), F.lit(0.0)).alias("whole"))
    return own.crossJoin(samples)  # scores x samples rows, as many as the result


def cohort(terms: DataFrame, calls: DataFrame, samples: DataFrame | None = None, absent: str = "error", karyotype: str | None = None, least: float = 0.99) -> DataFrame:
    """Scores and coverage of every sample for every score.

    pgs_id, sample, terms, scorable, partial_score, complete_score (null unless every term counts),
    terms_without_weight, term_coverage, weight_coverage (null for a score of no weight) and covered: both reach ``least``.
    """
    samples = samples if samples is not None else samples_of(calls)
    rows = called(terms, calls)
    if karyotype:
        rows = hemizygous(rows, karyotype)
    met = rows.groupBy("pgs_id", "sample").agg(F.count(F.lit(1)).alias("met")) if absent == "error" else None
    out = _grid(terms, samples).join(summary(rows), ["pgs_id", "sample"], "left")
    if met is not None:
        out = out.join(met, ["pgs_id", "sample"], "left")
        out = out.withColumn("needed", F.when(F.col("needed") != F.coalesce("met", F.lit(0)), F.raise_error(F.concat(F.lit("a term of "), "pgs_id", F.lit(" has no call, or two, for sample "), F.col("sample").cast("string")))).otherwise(F.col("needed"))).where("needed is not null")
    zero = F.struct(F.lit(False).alias("neg"), F.lit("0").alias("digits"), F.lit(0).alias("exp"))
    out = out.withColumns({"scorable": F.coalesce("scorable", F.lit(0)), "used": F.coalesce("used", F.lit(0.0)), "total": F.coalesce("total", zero)})
    out = out.withColumn("partial_score", exact.text(F.col("total")))
    out = out.withColumn("complete_score", F.when(F.col("scorable") == F.col("terms"), F.col("partial_score")))
    out = out.withColumn("term_coverage", F.col("scorable") / F.col("terms")).withColumn("weight_coverage", F.when(F.col("whole") > 0, F.col("used") / F.col("whole")))
    out = out.withColumn("covered", (F.col("term_coverage") >= least) & (F.coalesce("weight_coverage", F.lit(0.0)) >= least) & (F.col("terms_without_weight") == 0))
    return out.select("pgs_id", "sample", "terms", "scorable", "partial_score", "complete_score", "terms_without_weight", "term_coverage", "weight_coverage", "covered")


def scores(rows: DataFrame, keys: tuple[str, ...] = ("pgs_id", "sample")) -> DataFrame:
    """Partial and complete scores of rows of :func:`outcomes`, which hold every term of a score and sample."""
    k = list(keys)
    counts = rows.groupBy(*k).agg(F.count(F.lit(1)).alias("terms"))
    out = counts.join(summary(rows, keys), k, "left").withColumn("scorable", F.coalesce("scorable", F.lit(0)))
    out = out.withColumn("partial_score", F.coalesce(exact.text(F.col("total")), F.lit("0")))
    return out.withColumn("complete_score", F.when(F.col("scorable") == F.col("terms"), F.col("partial_score"))).drop("total", "used")


def states(terms: DataFrame, calls: DataFrame, samples: DataFrame | None = None, absent: str = "error") -> DataFrame:
    """Terms by status per score and sample."""
    samples = samples if samples is not None else samples_of(calls)
    met = called(terms, calls).groupBy("pgs_id", "sample", "status").agg(F.count(F.lit(1)).alias("n"))
    same = terms.withColumn("status", withheld()).groupBy("pgs_id", "status").agg(F.count(F.lit(1)).alias("n"))
    grid = same.crossJoin(samples)  # a row for each score, sample and status, as in the result
    taken = met.groupBy("pgs_id", "sample").agg(F.sum("n").alias("taken"))
    left = grid.where("status is null").join(taken, ["pgs_id", "sample"], "left").withColumn("n", F.col("n") - F.coalesce("taken", F.lit(0)))
    if absent == "error":
        left = left.withColumn("n", F.when(F.col("n") != 0, F.raise_error(F.concat(F.lit("a term of "), "pgs_id", F.lit(" has no call for sample "), F.col("sample").cast("string")))).otherwise(F.col("n")))
    left = left.where("n > 0").select("pgs_id", "sample", F.lit(absent).alias("status"), "n")
    out = met.unionByName(grid.where("status is not null").select("pgs_id", "sample", "status", "n")).unionByName(left)
    return out.groupBy("pgs_id", "sample", "status").agg(F.sum("n").alias("n"))


def unscorable_terms(terms: DataFrame, calls: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """``terms`` with ``missing``: for how many of the samples each cannot be scored."""
    samples = samples if samples is not None else samples_of(calls)
    counts = called(terms, calls).where(F.col("status") == SCORABLE).groupBy("pgs_id", "ordinal").agg(F.count(F.lit(1)).alias("__ok"))
    total = samples.agg(F.count(F.lit(1)).alias("__all"))  # one row
    return terms.join(counts, ["pgs_id", "ordinal"], "left").crossJoin(total).withColumn("missing", F.col("__all") - F.coalesce("__ok", F.lit(0))).drop("__ok", "__all")
