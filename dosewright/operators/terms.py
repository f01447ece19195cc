"""Terms of a scoring file: contigs, alleles, orientation and whole-score inferences, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exact

COMPLEMENT = ("ACGT", "TGCA")
#: Fixed names of review reasons.
INVALID_FLAGS = ("", ".", "NA")


def contig_code(name: Column) -> Column:
    """1 to 22, 23 for X, 24 for Y, 25 for M or MT, with or without 'chr'; null for any other name."""
    bare = F.regexp_replace(name, "^chr", "")
    number = F.when(bare.rlike("^([1-9]|1[0-9]|2[0-2])$"), bare.try_cast("int"))
    return F.coalesce(number, F.when(bare == "X", 23).when(bare == "Y", 24).when(bare.isin("M", "MT"), 25)).cast("byte")


def position(value: Column) -> Column:
    """A position of 1 to 10 digits without leading zero, below 2^31; else null."""
    number = F.when(value.rlike("^[1-9][0-9]{0,9}$"), value.try_cast("long"))
    return F.when(number < 2**31, number.cast("int"))


def complement(allele: Column) -> Column:
    return F.translate(allele, *COMPLEMENT)


def is_palindromic(a: Column, b: Column) -> Column:
    return (F.length(a) == 1) & (F.length(b) == 1) & (a == complement(b))


def is_public_id(score: Column) -> Column:
    return score.rlike("^PGS[0-9]{6}$")


def is_custom_id(score: Column) -> Column:
    return score.rlike("^[A-Za-z0-9_.-]{1,64}$") & ~is_public_id(score)


def flag(value: Column) -> Column:
    """True or false for TRUE and FALSE in any case, false for empty marks, null for anything else."""
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.when(low == "true", True).when(low.isin("false", "", ".", "na"), False)


def model(dominant: Column, recessive: Column, dosage_weights: Column) -> Column:
    return F.when(dosage_weights, "dosage_weights").when(dominant, "dominant").when(recessive, "recessive").otherwise("additive")


def reasons(conditions: dict[str, Column]) -> Column:
    """The sorted names of the review reasons whose condition holds."""
    return F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items()))))


def restates(description: Column, chr_name: Column, chr_position: Column, effect: Column, other: Column) -> Column:
    """Whether a description only names the row's own variant: its chromosome, position and both alleles in either order."""
    part = lambda k: F.regexp_extract(description, r"^FinnGen_VariantID=chr([0-9]{1,2}|X|Y)_([0-9]+)_([ACGT]+)_([ACGT]+)$", k)
    same = F.array_sort(F.array(part(3), part(4))) == F.array_sort(F.array(F.trim(effect), F.trim(other)))
    return (part(1) != "") & (part(1) == F.regexp_replace(F.trim(chr_name), "^chr", "")) & (part(2) == F.trim(chr_position)) & same


#: Fixed keys, notes and a prefix of descriptions that tell nothing about how a term is scored.
INFORMATIONAL_KEYS = ("PIP", "BETAlast", "SE", "LastSampleEff", "P", "N", "FinnGen_VariantID", "ID", "variant_id", "VARIANT_ID")
INFORMATIONAL_NOTES = ("Variant info (UK Biobank)", "Score calculated as product of dosage times weight across all variants")
INFORMATIONAL_PREFIX = "Beta, estimated per allele log odds ratio adjusted for winner"


def informational(description: Column, known: tuple[str, ...] = INFORMATIONAL_KEYS) -> Column:
    """Whether a description changes nothing: key=value parts with known keys (or a1, a2, ...) and values, a known note, or a proxy's name."""
    def harmless(item: Column) -> Column:
        key, value = F.trim(F.regexp_extract(item, "^([^=]*)=", 1)), F.trim(F.regexp_extract(item, "^[^=]*=(.*)$", 1))
        return item.contains("=") & (value != "") & (key.isin(*known) | key.rlike("^a[0-9]+$"))

    parts = F.forall(F.split(description, ";", -1), harmless)
    return parts | description.rlike("^proxy SNP: rs[0-9]+$") | description.isin(*INFORMATIONAL_NOTES) | description.startswith(INFORMATIONAL_PREFIX)


def centre(description: Column) -> Column:
    """<weight_type, centre> of a description that centres its weight at a number from 0 to 2, else null."""
    kind, text = (F.regexp_extract(description, r"^weight_type=(beta|OR|HR|NR);centre=([0-9.][0-9.eE+-]*)$", k) for k in (1, 2))
    value = exact.parse(text)
    fits = (kind != "") & value.isNotNull() & (exact.to_double(value) <= 2)
    return F.when(fits, F.struct(kind.alias("weight_type"), text.alias("centre")))


def orient(terms: DataFrame, base: str = "base", effect: str = "effect_allele", other: str = "other_allele") -> DataFrame:
    """Adds status, method, ref, alt and effect_is_alt: exactly one of both strands must hold the reference base."""
    e, o, r = F.col(effect), F.col(other), F.col(base)
    literal = e.rlike("^[ACGT]+$") & o.rlike("^[ACGT]+$") & (e != o)
    single = (F.length(e) == 1) & (F.length(o) == 1)
    direct = (e == r) | (o == r)
    turned = (complement(e) == r) | (complement(o) == r)
    status = (
        F.when(F.col("pos").isNull() | F.col("contig").isNull(), "unresolved_position")
        .when(~F.coalesce(literal, F.lit(False)), "unresolved_source_alleles")
        .when(r.isNull(), "outside_reference")
        .when(~single, "sequence_reference_evidence_required")
        .when(direct != turned, "resolved")
        .when(is_palindromic(e, o), "palindromic_orientation_unresolved")
        .otherwise("allele_representation_unresolved")
    )
    out = terms.withColumn("status", status)
    done = F.col("status") == "resolved"
    forward = F.when(direct, e).otherwise(complement(e))
    backward = F.when(direct, o).otherwise(complement(o))
    out = out.withColumn("method", F.when(done, F.when(direct, "direct").otherwise("complement")))
    out = out.withColumn("effect_is_alt", F.when(done, forward != r))
    out = out.withColumn("ref", F.when(done, r))
    return out.withColumn("alt", F.when(done, F.when(forward == r, backward).otherwise(forward)))


def mark_duplicates(rows: DataFrame, score: str, line: str, name: str = "duplicate") -> DataFrame:
    """Marks every copy of a line found more than once in a score."""
    counts = rows.groupBy(score, line).agg((F.count(F.lit(1)) > 1).alias(name))
    return rows.join(counts, [score, line])


def strand_evidence(oriented: DataFrame, score: str, least: int = 100, share: float = 0.999) -> DataFrame:
    """Per score: resolved single bases read forward and complemented, and whether forward reading is established."""
    single = (F.col("status") == "resolved") & (F.length("ref") == 1) & (F.length("alt") == 1)
    own = oriented.groupBy(score).agg(F.count_if(single & (F.col("method") == "direct")).alias("forward"), F.count_if(single & (F.col("method") == "complement")).alias("turned"))
    total = F.col("forward") + F.col("turned")
    return own.withColumn("consistent", (total >= least) & (F.col("forward") >= share * total))


def convention(terms: DataFrame, score: str, base: str, effect: str, other: str, share: float = 0.99) -> DataFrame:
    """Per score: whether effect alleles without another allele are ALT (or REF) in nearly every eligible term."""
    eligible = F.col(other).isNull() & F.col(effect).rlike("^[ACGT]$") & F.col(base).rlike("^[ACGT]$")
    own = terms.where(eligible).groupBy(score).agg(F.count(F.lit(1)).alias("eligible"), F.count_if(F.col(effect) != F.col(base)).alias("alts"))
    kind = F.when(F.col("alts") >= share * F.col("eligible"), "effect_is_alt").when(F.col("eligible") - F.col("alts") >= share * F.col("eligible"), "effect_is_ref")
    return own.withColumn("convention", kind)


def exactly_one(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows whose key occurs once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *(F.first(v).alias(v) for v in values)).where("__n = 1").drop("__n")


def ordinals(rows: DataFrame, group: str, order: list[str], name: str = "ordinal") -> DataFrame:
    """1-based ordinals in source order within a group (a file)."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def targets(*term_tables: DataFrame) -> DataFrame:
    """Distinct sites over all scores."""
    out = None
    for t in term_tables:
        own = t.where("contig is not null and pos is not null").select("contig", "pos", "ref", "alt")
        out = own if out is None else out.unionByName(own)
    return out.distinct()
