"""Extracting calls: the targets of all scores meet the records that overlap them, and the rules decide for each sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import binary
from . import calls, compiled, dosage, intervals, score, splits

TARGET = ["contig", "pos", "ref", "alt", "sequence"]
RECORD = ["pos", "end_", "ref", "alts", "filters", "gt", "ft", "depth", "quality", "anchor_ok", "ds", "gp", "normal"]


def normal_alts(records: DataFrame, chunks: DataFrame, left: int = 512) -> DataFrame:
    """``records`` with ``normal``, each ALT in normal form as pos:ref:alt (null where it has none)."""
    rows = records.withColumn("__id", F.monotonically_increasing_id())
    rows = binary.with_span(rows, chunks, F.greatest(F.lit(1), F.col("pos") - left), F.col("pos") - 1, "__left")

    plain = F.col("ref").rlike("^[ACGT]+$")
    longest = F.array_max(F.transform("alts", lambda a: F.length(a)))
    # A single base against single bases is in normal form already, so only other records are unfolded.
    simple = (F.length("ref") == 1) & (longest == 1)
    own = rows.withColumn("normal", F.when(simple & plain, F.transform("alts", lambda a: F.when(a.rlike("^[ACGT]$"), F.concat_ws(":", F.col("pos"), F.col("ref"), a)))).otherwise(F.lit(None)))
    wide = own.where(~F.coalesce(simple & plain, F.lit(False))).select(*[c for c in own.columns if c != "normal"], F.posexplode("alts").alias("__k", "__alt"))
    made = wide.withColumn("__n", dosage.normalised(F.col("pos"), F.when(plain & F.col("__alt").rlike("^[ACGT]+$"), F.col("ref")), F.col("__alt"), F.col("__left")))
    one = F.when(F.col("__n.pos").isNotNull(), F.concat_ws(":", F.col("__n.pos"), F.col("__n.ref"), F.col("__n.alt")))
    keys = [c for c in records.columns]
    many = made.groupBy("__id").agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", one.alias("x")))), lambda x: x["x"]).alias("normal"), *(F.first(c).alias(c) for c in keys))
    return own.where(simple & plain).select(*keys, "normal").unionByName(many.select(*keys, "normal"))


def extract(targets: DataFrame, records: DataFrame, chunks: DataFrame, samples: DataFrame | None = None, skip_structural: bool = False, merge_split: bool = False, field: str = "gt", **options) -> DataFrame:
    """Calls (contig, pos, ref, alt, sample, state, alt_dosage, record_ordinals) of every target for every sample.

    ``targets``: rows of ``compiled.targets``; ``records``: rows of ``rule_records``; ``chunks``: the reference. A
    record is parsed once and meets only targets that it overlaps; a target without any is ``unknown_no_record``.
    ``options`` go to :func:`calls.classify`. ``skip_structural`` leaves out records whose ALTs are all structural.
    """
    if skip_structural:
        records = records.where(~F.coalesce(calls.is_structural(F.col("alts")), F.lit(False)))
    if merge_split and field != "gt":
        raise ValueError("split records are merged for genotypes only")
    samples = samples if samples is not None else records.select("sample").distinct()
    own = targets.withColumn("last", F.col("pos") + F.length("ref") - 1)
    own = binary.with_span(own, chunks, F.col("pos"), F.col("last"), "__found")
    own = own.withColumn("reference_ok", F.coalesce(F.col("__found") == F.col("ref"), F.lit(False))).drop("__found")
    near = own.select(*[F.col(c).alias(f"t_{c}") for c in TARGET], F.col("contig"), "last")
    met = intervals.range_join(near.withColumn("t_first", F.col("t_pos")), records.where("contig is not null and pos is not null"), ["contig"], ("t_first", "last"), ("pos", "end_"))
    # Only records that meet a target are compared with the reference.
    met = binary.with_bases(met, chunks, "__base").withColumn("anchor_ok", F.coalesce(F.substr("ref", F.lit(1), F.lit(1)) == F.col("__base"), F.lit(False))).drop("__base")
    met = normal_alts(met, chunks)
    record = F.struct(F.col("record_ordinal"), F.struct(*[F.col(c) for c in RECORD]).alias("r"))
    grouped = met.groupBy(*[f"t_{c}" for c in TARGET], "sample").agg(F.array_sort(F.collect_list(F.struct("record_ordinal", F.col("file"), F.struct(*[F.col(c) for c in RECORD]).alias("r")))).alias("x")) if "file" in met.columns else met.groupBy(*[f"t_{c}" for c in TARGET], "sample").agg(F.array_sort(F.collect_list(record)).alias("x"))
    pairs = own.crossJoin(samples)  # a call for each target and sample is the result
    same = F.col("sample") == F.col("s_sample")
    for c in TARGET:
        same = same & F.col(c).eqNullSafe(F.col(f"t_{c}"))
    joined = pairs.join(grouped.withColumnRenamed("sample", "s_sample"), same, "left")
    groups = joined.select(*TARGET, "sample", "reference_ok", F.coalesce(F.col("x.r"), F.filter("x.r", lambda r: F.lit(False))).alias("records"), F.coalesce("x.record_ordinal", F.array().cast("array<bigint>")).alias("record_ordinals"))
    if merge_split:
        single, wide = groups.where(~F.col("sequence")), groups.where("sequence")
        groups = splits.merged(single).unionByName(splits.merged(wide, sequence=True))
    out = calls.classify(groups, field=field, **options)
    return out.select(*TARGET, "sample", "state", "alt_dosage", *(["measurement"] if field != "gt" else []), "record_ordinals", "records")


def prepared(done: DataFrame, accept: dict | None = None) -> DataFrame:
    """Compiled terms under opt-ins (see :func:`dosage.accepted`), as :func:`score.cohort` takes them; 'any ALT' is the text '*'."""
    own = dosage.accepted(done, **(accept or {}))
    return own.withColumn("alt", F.when(F.col("resolved"), F.coalesce("alt", F.lit("*"))))


def score_calls(done: DataFrame, found: DataFrame, accept: dict | None = None) -> DataFrame:
    """Scores of compiled terms from extracted calls; under DS and GP from expected contributions."""
    terms_ = prepared(done, accept)
    own = found.withColumn("alt", F.coalesce("alt", F.lit("*")))
    if "measurement" not in found.columns:
        return score.cohort(terms_, own, own.select("sample").distinct())
    return expected_scores(terms_, own)


def expected_scores(terms_: DataFrame, found: DataFrame) -> DataFrame:
    """Scores under DS or GP: a term's contribution is its mean over the measurement; DS serves additive terms only."""
    from ..functions import exact

    rows = terms_.crossJoin(found.select("sample").distinct()).join(found.select(*score.SITE, "sample", "state", "alt_dosage", "measurement"), [*score.SITE, "sample"], "left")
    observed = F.col("state").isin(*calls.OBSERVED)
    whole = lambda d: F.struct(F.lit(False).alias("neg"), d.cast("string").alias("digits"), F.lit(0).alias("exp"))
    chance = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: whole((k == F.col("alt_dosage")).cast("int")))
    # A reference block is a certain genotype.
    certain = observed & F.col("alt_dosage").isNotNull()
    ds, gp = F.col("measurement.ds"), F.when(certain, chance).otherwise(F.col("measurement.gp"))
    value = dosage.expected(F.col("weights"), F.col("model"), F.col("effect_is_alt"), ds, gp)
    status = F.coalesce(score.withheld(), F.when(~observed, F.col("state")), F.when(F.col("state").isNull(), score._absence("error")))
    rows = rows.withColumn("__v", F.when(observed & score.withheld().isNull(), value))
    lacking = F.when(ds.isNotNull() & (F.col("model") != "additive"), "genotype_probabilities_required").otherwise(score.REVIEW)
    rows = rows.withColumn("status", F.coalesce(status, F.when(F.col("__v").isNull(), lacking), F.lit(score.SCORABLE)))
    sums = exact.exact_sum(rows, ["pgs_id", "sample"], F.when(F.col("status") == score.SCORABLE, F.col("__v")))
    counts = rows.groupBy("pgs_id", "sample").agg(F.count(F.lit(1)).alias("terms"), F.count_if(F.col("status") == score.SCORABLE).alias("scorable"))
    out = counts.join(sums, ["pgs_id", "sample"]).withColumn("partial_score", exact.text(F.col("total"))).drop("total")
    return out.withColumn("complete_score", F.when(F.col("scorable") == F.col("terms"), F.col("partial_score")))
