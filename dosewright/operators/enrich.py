"""What is added to scores: frequency fills, reference distributions, placement windows and missing-term bounds."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exact
from . import score
from .calls import OBSERVED

# Frequency fills


@F.pandas_udf(exact.EXACT)
def _fill(weight: pd.DataFrame, frequency: pd.DataFrame, alt: pd.Series) -> pd.DataFrame:
    """weight * 2 * f, or weight * 2 * (1 - f) where the effect allele is REF; exponents add up."""
    rows = []
    for neg, digits, exp, fdigits, fexp, is_alt in zip(weight["neg"], weight["digits"], weight["exp"], frequency["digits"], frequency["exp"], alt, strict=True):
        if not isinstance(digits, str) or not isinstance(fdigits, str):
            rows.append((None, None, None))
            continue
        f, low = int(fdigits), int(fexp)
        if not is_alt:
            f, low = 10 ** max(0, -low) - f * 10 ** max(0, low), min(0, low)
        rows.append((bool(neg), str(int(digits) * 2 * f), int(exp) + low))
    return pd.DataFrame(rows, columns=["neg", "digits", "exp"])


def fill_decisions(terms: DataFrame, freq: DataFrame, last_contig: int = 22) -> DataFrame:
    """Adds ``reason`` (null: can be filled) and ``fill`` (exact) to each term, once whatever the number of samples.

    ``freq``: contig, pos, ref, alt, freq (exact), multiallelic; several records may share a position. A term's
    alleles are those of its orientation, else the published ones (effect_allele, other_allele) where the term has
    them and they are no palindrome. A record of several ALTs is an error.
    """
    grouped = freq.groupBy("contig", "pos").agg(F.collect_list(F.struct("ref", "alt", "freq", "multiallelic")).alias("at"))
    own = terms.join(grouped, ["contig", "pos"], "left")
    resolved = F.coalesce("resolved", F.lit(False))
    effect, other = F.when(F.col("effect_is_alt"), F.col("alt")).otherwise(F.col("ref")), F.when(F.col("effect_is_alt"), F.col("ref")).otherwise(F.col("alt"))
    palindrome = F.lit(False)
    if {"effect_allele", "other_allele"} <= set(terms.columns):
        published = F.col("effect_allele").rlike("^[ACGT]+$") & F.col("other_allele").rlike("^[ACGT]+$") & (F.col("effect_allele") != F.col("other_allele"))
        palindrome = F.col("effect_allele") == F.translate("other_allele", "ACGT", "TGCA")
        effect, other = (F.when(resolved, x).when(F.coalesce(published & ~palindrome, F.lit(False)), F.col(c)) for x, c in ((effect, "effect_allele"), (other, "other_allele")))
    else:
        effect, other = F.when(resolved, effect), F.when(resolved, other)
    pair = F.array_sort(F.array(effect, other))
    several = F.exists("at", lambda x: x["alt"].contains(","))
    hits = F.when(F.coalesce(several, F.lit(False)), F.raise_error(F.lit("a frequency record has several ALTs"))).otherwise(F.filter("at", lambda x: F.array_sort(F.array(x["ref"], x["alt"])) == pair))
    own = own.withColumn("hits", hits)
    hit = F.get("hits", F.lit(0))
    known = (~hit["freq"]["neg"] | (hit["freq"]["digits"] == "0")) & (exact.to_double(hit["freq"]) <= 1)
    review = F.col("review")
    if "reasons" in terms.columns:
        review = F.size(F.array_remove("reasons", "unresolved_harmonized_position")) > 0
    reason = (
        F.when(F.col("pos").isNull() | F.col("contig").isNull(), "no_position")
        .when(review, "requires_review")
        .when(F.col("model") != "additive", "non_additive_model")
        .when(F.col("contig") > last_contig, "no_frequency_source_for_contig")
        .when(~resolved & F.coalesce(palindrome, F.lit(False)), "palindrome_orientation_unresolved")
        .when(effect.isNull() | other.isNull(), "source_alleles_unresolved")
        .when(F.col("at").isNull(), "site_absent")
        .when(F.size("hits") == 0, "alleles_differ")
        .when(F.size("hits") > 1, "multiple_matching_records")
        .when(~F.coalesce(known, F.lit(False)), "frequency_missing_or_invalid")
        .when((effect == hit["ref"]) & (hit["multiallelic"] | (F.size("at") > 1)), "multiallelic_reference_effect_allele")
    )
    own = own.withColumn("reason", reason)
    filled = F.col("reason").isNull()
    fill = _fill(F.when(filled, F.get("weights", F.lit(0))), F.when(filled, hit["freq"]), effect == hit["alt"])
    return own.withColumn("fill", F.when(filled, fill)).drop("at", "hits")


def fill_report(decided: DataFrame) -> DataFrame:
    """Per score and reason ('filled' for none): rows and the exact sum of their fills, of terms with ``missing`` samples."""
    rows = decided.where("missing > 0").withColumn("reason", F.coalesce("reason", F.lit("filled")))
    sums = exact.exact_sum(rows, ["pgs_id", "reason"], F.col("fill"), F.col("missing"))
    return rows.groupBy("pgs_id", "reason").agg(F.sum("missing").alias("n")).join(sums, ["pgs_id", "reason"])


def filled_scores(rows: DataFrame, decided: DataFrame, keys: tuple[str, ...] = ("pgs_id", "sample")) -> DataFrame:
    """Scores of rows of ``outcomes`` with the fills of ``decided`` in place of what could not be scored."""
    fills = decided.where("fill is not null").select("pgs_id", "ordinal", "fill")
    own = rows.join(fills, ["pgs_id", "ordinal"], "left")
    ok = F.col("status") == "scorable_observation"
    value, times = F.when(ok, F.col("weight")).otherwise(F.col("fill")), F.when(ok, F.col("times")).otherwise(1)
    total = exact.exact_sum(own, list(keys), value, times)
    counts = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("terms"), F.count_if(ok).alias("scorable"), F.count_if(~ok & F.col("fill").isNotNull()).alias("filled"))
    out = counts.join(total, list(keys)).withColumn("filled_score", exact.text(F.col("total"))).drop("total")
    return out.withColumn("enough", F.col("scorable") * 100 >= F.col("terms") * 99)


# Reference distributions


def mid_rank_percentiles(values: DataFrame, reference: DataFrame, keys: list[str], value: str, other: str) -> DataFrame:
    """Adds n, below, equal, percentile, mean, sd and z of ``value`` against the ``other`` values of its keys.

    The reference is sorted once: counts come from cumulative counts of its distinct values.
    """
    base = reference.groupBy(*keys).agg(F.count(other).alias("n"), F.avg(other).alias("mean"), F.when(F.count(other) > 1, F.stddev_samp(other)).alias("sd"))
    steps = reference.where(F.col(other).isNotNull()).groupBy(*keys, F.col(other).alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    wanted = values.select(*keys, F.col(value).alias("__x")).distinct().withColumn("__c", F.lit(0).cast("long"))
    by = Window.partitionBy(*keys).orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    both = steps.unionByName(wanted).groupBy(*keys, "__x").agg(F.sum("__c").alias("equal"))
    ranked = both.withColumn("below", F.coalesce(F.sum("equal").over(by), F.lit(0)))
    out = values.join(ranked.withColumnRenamed("__x", value), [*keys, value]).join(base, keys)
    out = out.withColumn("percentile", 100 * (F.col("below") + F.col("equal") / 2) / F.col("n"))
    return out.withColumn("z", F.when(F.col("sd") > 0, (F.col(value) - F.col("mean")) / F.col("sd")))


def group_frequencies(calls: DataFrame, groups: DataFrame, sites: list[str]) -> DataFrame:
    """ALT frequency of each site in each group that has calls there, and over all groups."""
    own = calls.where("alt_dosage is not null").join(groups, "sample")
    sums = own.groupBy(*sites, "grp").agg(F.sum("alt_dosage").alias("alts"), F.count(F.lit(1)).alias("called"))
    every = sums.groupBy(*sites).agg(F.sum("alts").alias("all_alts"), F.sum("called").alias("all_called"))
    return sums.join(every, sites).withColumn("frequency", F.col("alts") / (2 * F.col("called"))).withColumn("all_frequency", F.col("all_alts") / (2 * F.col("all_called")))


def hardy_weinberg(p: Column, c0: Column, c1: Column, c2: Column) -> Column:
    """Expected contribution of a missing genotype at allele frequency p."""
    return (1 - p) * (1 - p) * c0 + 2 * p * (1 - p) * c1 + p * p * c2


def log_likelihoods(calls: DataFrame, frequencies: DataFrame, sites: list[str], stride: int = 20) -> DataFrame:
    """Hardy-Weinberg log likelihood of each sample in each group over every ``stride``-th site, and the sites used."""
    order = frequencies.select(*sites).distinct()
    numbered = order.withColumn("__k", F.row_number().over(Window.partitionBy(sites[0]).orderBy(*sites[1:])) - 1).where(F.col("__k") % stride == 0)
    p = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), F.col("frequency")))
    d = F.col("alt_dosage")
    ln = F.when(d == 0, 2 * F.log(1 - p)).when(d == 1, F.log(2 * p * (1 - p))).otherwise(2 * F.log(p))
    own = calls.where("alt_dosage is not null").join(frequencies.join(numbered, sites, "left_semi"), sites)
    return own.groupBy("sample", "grp").agg(F.sum(ln).alias("log_likelihood"), F.count(F.lit(1)).alias("sites"))


def nearest_group(likelihoods: DataFrame) -> DataFrame:
    """The group of greatest likelihood; of equals, the last by name."""
    return likelihoods.groupBy("sample").agg(F.max_by("grp", F.struct("log_likelihood", "grp")).alias("grp"))


@F.pandas_udf(T.DoubleType())
def fsum(values: pd.Series) -> float:
    """Correctly rounded sum of doubles."""
    return math.fsum(v for v in values if v == v)


def windows(deviations: DataFrame, keys: list[str], width: int = 1_000_000) -> DataFrame:
    """Sum of ``deviation`` per key and window of positions, and the window that deviates most in the key's direction."""
    sums = deviations.groupBy(*keys, "contig", (F.col("pos") / width).cast("long").alias("window")).agg(F.sum("deviation").alias("deviation"))
    total = sums.groupBy(*keys).agg(F.sum("deviation").alias("total"))
    own = sums.join(total, keys)
    lead = F.when(F.col("total") < 0, -F.col("deviation")).otherwise(F.col("deviation"))
    best = F.max(F.struct(lead.alias("lead"), "contig", "window", "deviation"))
    return own.groupBy(*keys).agg(F.first("total").alias("total"), best.alias("top")).select(*keys, "total", "top.contig", "top.window", "top.deviation")


def panel_placement(rows: DataFrame, panel: DataFrame, groups: DataFrame, least: float = 0.99) -> DataFrame:
    """Percentile of each sample's score among each group of a panel, over the terms that both can score.

    ``rows``: pgs_id, sample, ordinal, c0, c1, c2 (contributions at effect dosage 0, 1 and 2) and d, the sample's
    effect dosage (null: not scored). ``panel``: pgs_id, ordinal, member, d (null: no call), a row for each member.
    ``groups``: member, grp. A term called in fewer than ``least`` of the panel counts on neither side; a member
    without a call gets the Hardy-Weinberg expectation at its group's frequency, or the panel's if the group has none.
    """
    calls = panel.join(groups, "member")
    per_group = calls.groupBy("pgs_id", "ordinal", "grp").agg(F.count(F.lit(1)).alias("n"), F.count("d").alias("called"), F.sum("d").alias("alleles"))
    every = per_group.groupBy("pgs_id", "ordinal").agg(F.sum("n").alias("all_n"), F.sum("called").alias("all_called"), F.sum("alleles").alias("all_alleles"))
    every = every.where((F.col("all_called") > 0) & (F.col("all_called") >= least * F.col("all_n")))
    p = F.coalesce(F.col("alleles") / (2 * F.col("called")), F.col("all_alleles") / (2 * F.col("all_called")))
    rates = per_group.join(every, ["pgs_id", "ordinal"]).select("pgs_id", "ordinal", "grp", F.when(F.col("called") > 0, p).otherwise(F.col("all_alleles") / (2 * F.col("all_called"))).alias("p"))
    at = lambda d: F.when(d == 0, F.col("c0")).when(d == 1, F.col("c1")).when(d == 2, F.col("c2"))
    matched = rows.where("d is not null and c0 is not null and c1 is not null and c2 is not null").join(every.select("pgs_id", "ordinal"), ["pgs_id", "ordinal"], "left_semi")
    own = matched.groupBy("pgs_id", "sample").agg(F.sum(at(F.col("d"))).alias("value"), F.count(F.lit(1)).alias("matched"))
    terms = matched.select("pgs_id", "sample", "ordinal", "c0", "c1", "c2").join(calls.join(rates, ["pgs_id", "ordinal", "grp"]), ["pgs_id", "ordinal"])
    value = F.when(F.col("d").isNull(), hardy_weinberg(F.col("p"), F.col("c0"), F.col("c1"), F.col("c2"))).otherwise(at(F.col("d")))
    members = terms.groupBy("pgs_id", "sample", "grp", "member").agg(F.sum(value).alias("other"))
    pairs = members.join(own, ["pgs_id", "sample"])
    below, equal = F.count_if(F.col("other") < F.col("value")), F.count_if(F.col("other") == F.col("value"))
    out = pairs.groupBy("pgs_id", "sample", "grp", "value", "matched").agg(F.count(F.lit(1)).alias("n"), (100 * (below + equal / 2) / F.count(F.lit(1))).alias("percentile"), F.avg("other").alias("mean"), F.when(F.count(F.lit(1)) > 1, F.stddev_samp("other")).alias("sd"))
    return out.withColumn("z", F.when(F.col("sd") > 0, (F.col("value") - F.col("mean")) / F.col("sd")))


# Missing terms

#: Fixed reasons that concern matching alone, not what a term contributes.
MATCHING = ("unresolved_harmonized_position", "harmonization_mismatch:hm_match_chr", "harmonization_mismatch:hm_match_pos", "invalid_harmonization_flag:hm_match_chr", "invalid_harmonization_flag:hm_match_pos", "author_other_allele_missing")


#: States of a call for which a missing term has no bounds.
VOID = ("unsupported_ploidy", "missing_reason_not_retained")


def _extremes(terms: DataFrame, most: int, single: Column) -> DataFrame:
    """Adds ``__x``: least and greatest contribution of a term over its possible dosages, and the larger of their sizes; null without valid weights."""
    kind = F.col("model")
    times = F.when(kind == "additive", F.when(single, most).otherwise(2)).when(kind == "dominant", F.when(single, int(most > 0)).otherwise(1)).when(kind == "recessive", F.when(single, int(most == 2)).otherwise(1))
    own = terms.withColumn("__w", F.get("weights", F.lit(0))).withColumn("__d", exact.times_digits(F.col("__w.digits"), times))
    w, digits = F.col("__w"), F.col("__d")
    value = lambda neg, d, exp: F.struct(neg.alias("neg"), d.alias("digits"), exp.alias("exp"))
    three = lambda a, b, c: F.struct(a.alias("lower"), b.alias("upper"), c.alias("impact"))
    no, zero = F.lit(False), value(F.lit(False), F.lit("0"), w["exp"])
    below = w["neg"] & (digits != "0")
    whole = value(below, digits, w["exp"])
    linear = three(F.when(below, whole).otherwise(zero), F.when(below, zero).otherwise(whole), value(no, digits, w["exp"]))

    ws = F.when(single, F.array(w, F.get("weights", F.lit(most)))).otherwise(F.array(w, *(F.get("weights", F.lit(d)) for d in (1, 2))))
    keyed = F.transform(ws, lambda x, k: F.struct(exact.value_key(x).alias("key"), k.alias("k"), value(x["neg"] & (x["digits"] != "0"), x["digits"], x["exp"]).alias("value")))
    low, high = F.array_min(keyed)["value"], F.array_max(keyed)["value"]  # of equal ones the first, and the last
    size = F.when(exact.magnitude_key(high) > exact.magnitude_key(low), high).otherwise(low)
    free = F.when(~F.exists(ws, lambda x: x.isNull()), three(low, high, value(no, size["digits"], size["exp"])))
    x = F.when(w.isNull(), None).when(kind == "dosage_weights", free).when(kind.isin("additive", "dominant", "recessive"), linear)
    return own.withColumn("__x", x.otherwise(F.raise_error(F.concat(F.lit("no such model: "), F.coalesce(kind, F.lit("null")))))).drop("__w", "__d")


def bounds(terms: DataFrame, single: Column | None = None, most: int = 2) -> DataFrame:
    """Adds lower, upper and impact (exact; null: unbounded) and ``unbounded``, why a term has no bounds, once for each term.

    ``reasons``, where there, must concern matching alone (an informational description also does no harm). ``single``
    says which terms are counted once (chrX outside the pseudo-autosomal regions in XY); those take the dosages 0 and ``most``.
    """
    single = F.lit(False) if single is None else single
    own = _extremes(terms, most, single)
    barred = F.lit(False)
    if "reasons" in terms.columns:
        allowed = F.array(*map(F.lit, MATCHING))
        if "informational" in terms.columns:
            allowed = F.when(F.col("informational"), F.concat(allowed, F.array(F.lit("variant_description_requires_review")))).otherwise(allowed)
        barred = F.size(F.array_except("reasons", allowed)) > 0
    why = F.when(barred, "ambiguous_or_unsupported_contribution_model").when(F.col("__x.lower").isNull(), "invalid_or_missing_weights")
    out = own.withColumn("unbounded", why)
    return out.withColumns({c: F.when(F.col("unbounded").isNull(), F.col(f"__x.{c}")) for c in ("lower", "upper", "impact")}).drop("__x")


def missing(rows: DataFrame, bounded: DataFrame) -> DataFrame:
    """The unscorable rows of ``outcomes`` with their terms' bounds; a call of unsupported ploidy has none."""
    own = bounded.select("pgs_id", "ordinal", "lower", "upper", "impact", "unbounded")
    out = rows.where("status <> 'scorable_observation'").join(own, ["pgs_id", "ordinal"])
    why = F.coalesce("unbounded", F.when(F.col("status").isin(*VOID), F.col("status")))
    out = out.withColumn("unbounded", why)
    return out.withColumns({c: F.when(F.col("unbounded").isNull(), F.col(c)) for c in ("lower", "upper", "impact")})


def ranked(rows: DataFrame, keys: list[str], k: int = 20) -> DataFrame:
    """The k bounded rows of :func:`missing` of greatest possible contribution, by exact size, then by ordinal."""
    own = rows.where("impact is not null").withColumn("__size", exact.magnitude_key(F.col("impact")))
    return _first_k(own, keys, k).drop("__size")


def earliest_unbounded(rows: DataFrame, keys: list[str], k: int = 20) -> DataFrame:
    """The first k rows of :func:`missing` without bounds, by ordinal."""
    by = Window.partitionBy(*keys).orderBy("ordinal")
    return rows.where("impact is null").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def envelope(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Exact sums of the lower and upper bounds of rows of :func:`missing`, and how many there are with and without bounds."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("missing"), F.count("unbounded").alias("unbounded"))
    lower, upper = (exact.exact_sum(rows, keys, F.col(c), name=c) for c in ("lower", "upper"))
    return counts.join(lower, keys).join(upper, keys)


def _entries() -> Column:
    """Of a bounded term: for each exponent of its limbs the limbs of both bounds, how many bounds have the exponent ``low``, and the term itself, counted once.

    A term without bounds has one entry, without a bound to sum.
    """
    fields = ("low", "exp", "lower", "upper", "lowers", "uppers", "terms", "bounded")
    entry = lambda *x: F.struct(*(c.cast("int" if f in fields[:2] else "long").alias(f) for c, f in zip(x, fields, strict=True)))
    no, zero, one = F.col("unbounded").isNotNull(), F.lit(0), F.lit(1)
    lower, upper = F.col("lower"), F.col("upper")

    def of(a: Column, b: Column, exp: Column, has_a: Column, has_b: Column, first: Column) -> Column:
        """Entries of the limbs a and b, which start at the same exponent."""
        limb = lambda x, k: F.coalesce(F.get(x, k)["limb"], zero)
        flag = lambda has, k: F.when(k == 0, has).otherwise(0)
        return F.transform(F.sequence(zero, F.greatest(F.size(a), F.size(b)) - 1), lambda k: entry(exp, exp + k * exact.LIMB, limb(a, k), limb(b, k), flag(has_a, k), flag(has_b, k), flag(first, k), flag(first, k)))

    a, b = exact.limbs(lower), exact.limbs(upper)
    none = F.array().cast("array<struct<exp:int,limb:bigint>>")
    apart = F.concat(of(a, none, lower["exp"], one, zero, one), of(none, b, upper["exp"], zero, one, zero))
    return F.when(no, F.array(entry(zero, zero, zero, zero, zero, zero, one, zero))).when(lower["exp"] == upper["exp"], of(a, b, lower["exp"], one, one, one)).otherwise(apart)


def sparse_envelope(bounded: DataFrame, calls: DataFrame, samples: DataFrame, site: list[str] = score.SITE) -> DataFrame:
    """:func:`envelope` per score and sample of all that :func:`missing` has, without a row for each term and sample.

    The sums over all terms of a score, less those of the terms that count for a sample; only terms and calls of one
    ``site`` meet, terms added up before. A term without a call is missing.
    """
    keys, sums = ["pgs_id", "low", "exp"], ["lower", "upper", "lowers", "uppers", "terms", "bounded"]
    index = lambda k: F.when(F.col("effect_is_alt"), k).otherwise(2 - k)
    by_dose = F.filter(F.transform("weights", lambda w, k: F.when(w.isNotNull(), index(k))), lambda k: k.isNotNull())
    nothing = F.array().cast("array<int>")
    #: ALT dosages at which a call of the term counts; null: at any.
    doses = F.when(score.withheld().isNotNull(), nothing).when(F.col("model") == "dosage_weights", F.coalesce(by_dose, nothing)).when(F.get("weights", F.lit(0)).isNull(), nothing)
    cut = bounded.select(*site, "pgs_id", score.withheld().isNull().alias("__open"), doses.alias("__doses"), F.explode(_entries()).alias("__e")).select("*", "__e.*").drop("__e")
    at = cut.groupBy(*site, "__open", "__doses", *keys).agg(*(F.sum(c).alias(c) for c in sums))
    known = calls.select(*site, F.struct("sample", F.col("alt_dosage").cast("int").alias("dose"), F.col("state").isin(*VOID).alias("void"), F.lit(False).alias("all")).alias("__c"))
    known = known.where(F.col("__c.void") | F.col("state").isin(*OBSERVED)).groupBy(*site).agg(F.collect_list("__c").alias("__calls"))

    #: Beside its calls each site is met once for all samples together, so that terms are read once.
    everyone = F.struct(F.lit(None).cast(calls.schema["sample"].dataType).alias("sample"), F.lit(None).cast("int").alias("dose"), F.lit(False).alias("void"), F.lit(True).alias("all"))
    rows = at.join(known, site, "left").withColumn("__c", F.explode(F.array_append(F.coalesce("__calls", F.array()), everyone))).select("__open", "__doses", *keys, *sums, "__c.*")
    counts = F.col("all") | (~F.col("void") & (F.col("__doses").isNull() | F.coalesce(F.array_contains("__doses", F.col("dose")), F.lit(False))))
    rows = rows.where(F.col("all") | F.col("__open")).withColumn("__counts", counts).where("__counts or void")
    off = [*(F.sum(c).alias(c) for c in sums[:4]), F.sum(F.when(F.col("__counts"), F.col("terms")).otherwise(0)).alias("terms"), F.sum("bounded").alias("bounded")]
    #: Filters on the maxima stay above the shuffle, so that both uses share it.
    both = rows.groupBy(*keys, F.col("sample").alias("__s"), F.col("all").alias("__a")).agg(*off, F.max("sample").alias("sample"), F.max("all").alias("__all"))
    whole = both.where("__all and sample is null").select(*keys, *sums).crossJoin(samples)  # scores x samples rows for each exponent
    taken = both.where("not __all and sample is not null").select(*keys, *((-F.col(c)).alias(c) for c in sums), "sample")
    left = whole.unionByName(taken).groupBy(*keys, "sample").agg(*(F.sum(c).alias(c) for c in sums))
    part = lambda c: F.collect_list(F.when(F.col(c) != 0, F.struct("exp", F.lit(0).cast("long").alias("high"), F.col(c).alias("low"))))
    least = lambda c: F.min(F.when(F.col(c) > 0, F.col("low")))
    out = left.groupBy("pgs_id", "sample").agg(F.sum("terms").alias("missing"), F.sum("bounded").alias("__bounded"), part("lower").alias("__l"), least("lowers").alias("__a"), part("upper").alias("__u"), least("uppers").alias("__b"))
    return out.where("missing > 0").select("pgs_id", "sample", "missing", (F.col("missing") - F.col("__bounded")).alias("unbounded"), exact.joined("__l", "__a").alias("lower"), exact.joined("__u", "__b").alias("upper"))


#: Terms of a score that are looked at first; Spark cuts each partition to as many before its shuffle.
HEAD = 1000


def sparse_ranked(bounded: DataFrame, calls: Callable[[DataFrame], DataFrame], samples: DataFrame, written: Callable[[DataFrame, str], DataFrame], absent: str = "error", k: int = 20, head: int = HEAD, site: list[str] = score.SITE) -> DataFrame:
    """:func:`ranked` per score and sample of all that :func:`missing` has, without a row for each term and sample where the terms of greatest contribution suffice.

    First only the ``head`` terms of greatest contribution of each score are met with the samples. Only where a sample
    misses less than k of those, and the score has more terms, are all its others met too. ``calls`` gives the calls at
    the sites of a table, ``written`` writes a small table and reads it back.
    """
    keys = ["pgs_id", "sample"]
    own = bounded.where("impact is not null").withColumn("__size", exact.magnitude_key(F.col("impact")))
    by = Window.partitionBy("pgs_id").orderBy(F.desc("__size"), "ordinal")
    top = written(own.withColumn("__place", F.row_number().over(by)).where(F.col("__place") <= head).drop("__place"), "head_terms")
    sites = top.select(*site).distinct()

    def first(terms: DataFrame, pairs: DataFrame, found: DataFrame) -> DataFrame:
        rows = score.outcomes(terms, found, pairs, absent, site).where(F.col("status") != score.SCORABLE)
        return _first_k(rows.where(~F.col("status").isin(*VOID)), keys, k)

    rows = written(first(top, samples, calls(sites)), "first_missing")
    more = top.groupBy("pgs_id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= head).select("pgs_id")
    enough = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= k)
    pairs = written(more.crossJoin(samples).join(enough, keys, "left_anti").select(*keys), "open_pairs")
    if pairs.isEmpty():
        return rows
    rest = own.join(top.select("pgs_id", "ordinal"), ["pgs_id", "ordinal"], "left_anti")
    further = first(rest, pairs, calls(rest.join(pairs.select("pgs_id").distinct(), "pgs_id", "left_semi").select(*site).distinct()))
    return _first_k(rows.drop("rank").unionByName(further.select([c for c in rows.columns if c != "rank"])), keys, k)


def _first_k(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.desc("__size"), "ordinal")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def completion(enveloped: DataFrame, partial: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the least and greatest complete score (texts) to an envelope; null where a term has no bounds."""
    own = enveloped.join(partial.select(*keys, exact.parse(F.col("partial_score")).alias("__p")), keys)
    parts = [own.select(*keys, F.col(c).alias("__v"), F.lit(c).alias("side")) for c in ("lower", "upper")]
    parts += [own.select(*keys, F.col("__p").alias("__v"), F.lit(c).alias("side")) for c in ("lower", "upper")]
    both = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    sums = exact.exact_sum(both, [*keys, "side"], F.col("__v")).groupBy(*keys).agg(*(F.first(F.when(F.col("side") == c, exact.text(F.col("total"))), True).alias(f"complete_{c}") for c in ("lower", "upper")))
    out = own.drop("__p").join(sums, keys)
    return out.withColumns({f"complete_{c}": F.when(F.col("unbounded") == 0, F.col(f"complete_{c}")) for c in ("lower", "upper")})
