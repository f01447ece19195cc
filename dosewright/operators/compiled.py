"""Compiling scores: described terms are oriented against the reference, duplicates marked, and what can be inferred is kept beside.

An inference never replaces a term's own orientation here: columns inf_kind, inf_ref, inf_alt, inf_effect_is_alt and
inf_pos hold it, and :func:`dosage.accepted` puts it in place where its opt-in is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import binary
from . import dosage, terms

ANCHORED, CATALOG, FORWARD, FITS, PUBLIC = "reference_anchored", "catalog_other_allele", "palindrome_forward_strand", "reference_fit_sequence", "public_sequence_pair"
KEY = ["pgs_id", "ordinal"]


def compile_terms(described: DataFrame, chunks: DataFrame, public: DataFrame | None = None, left: int = 512) -> DataFrame:
    """``described`` (rows of ``scoring_terms``) with status, method, ref, alt, effect_is_alt and the columns of inferences.

    ``chunks`` is the reference, ``public`` a variant list (contig, pos, ref, alt) for indels that the reference alone
    cannot read. Indels move at most ``left`` bases. A score whose (pgs_id, ordinal) repeats is an error.
    """
    longest = F.greatest(F.length("effect_allele"), F.coalesce(F.length("other_allele"), F.lit(1)), F.lit(1))
    own = terms.mark_duplicates(described, "pgs_id", "line")
    own = own.withColumn("reasons", F.when(F.col("duplicate"), F.array_sort(F.array_append("reasons", F.lit("exact_duplicate_source_term")))).otherwise(F.col("reasons"))).drop("duplicate")
    own = binary.with_bases(own, chunks)
    own = binary.with_span(own, chunks, F.col("pos"), F.col("pos") + longest - 1, "span")
    inside = F.when(F.col("span").isNotNull(), F.col("base"))  # a term that runs off its contig has no reference
    out = terms.orient(own.withColumn("base", inside)).withColumn("effect_length", longest)
    out = _alleles(out)
    out = _palindromes(out)
    out = _sequences(out, chunks, public, left)
    kind = F.coalesce("__allele", "__palindrome", "__sequence")
    out = out.select(*[c for c in out.columns if not c.startswith("__")], kind["kind"].alias("inf_kind"), kind["ref"].alias("inf_ref"), kind["alt"].alias("inf_alt"), kind["effect_is_alt"].alias("inf_effect_is_alt"), F.coalesce(kind["pos"], F.col("pos")).alias("inf_pos"))
    return out.drop("base", "span", "effect_length")


def _found(kind: str, ref: Column, alt: Column, effect_is_alt: Column, pos: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), ref.alias("ref"), alt.alias("alt"), effect_is_alt.alias("effect_is_alt"), pos.cast("int").alias("pos"))


def _alleles(oriented: DataFrame) -> DataFrame:
    """Other alleles that the author left out: by the score's convention, else by the one that the catalog inferred."""
    missing = F.col("other_allele").isNull() & F.col("effect_allele").rlike("^[ACGT]$") & F.col("span").isNotNull()
    eligible = missing & F.col("base").rlike("^[ACGT]$")
    rows = oriented.withColumn("__missing", F.coalesce(missing, F.lit(False))).withColumn("__eligible", F.coalesce(eligible, F.lit(False)))
    counts = rows.where("__eligible").groupBy("pgs_id").agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("effect_allele") != F.col("base")).alias("__alts"))
    rows = rows.join(counts, "pgs_id", "left")
    alt, e, b, pos = F.col("effect_allele") != F.col("base"), F.col("effect_allele"), F.col("base"), F.col("pos")
    by_alt = F.col("__eligible") & (F.col("__alts") >= 0.99 * F.col("__n")) & alt
    by_ref = F.col("__eligible") & ~(F.col("__alts") >= 0.99 * F.col("__n")) & (F.col("__n") - F.col("__alts") >= 0.99 * F.col("__n")) & ~alt
    anchored = F.when(by_alt, _found(ANCHORED, b, e, F.lit(True), pos)).when(by_ref, _found(ANCHORED, b, F.lit(None).cast("string"), F.lit(False), pos))
    other = F.when(F.col("catalog_other").rlike("^[ACGT]$"), F.col("catalog_other")) if "catalog_other" in oriented.columns else F.lit(None).cast("string")
    direct, turned = (e == b) | (other == b), (terms.complement(e) == b) | (terms.complement(other) == b)
    x, y = F.when(direct, e).otherwise(terms.complement(e)), F.when(direct, other).otherwise(terms.complement(other))
    fits = F.coalesce(F.col("__missing") & other.isNotNull() & (e != other) & (direct != turned), F.lit(False))
    by_catalog = F.when(fits, _found(CATALOG, b, F.when(x == b, y).otherwise(x), x != b, pos))
    return rows.withColumn("__allele", F.coalesce(anchored, by_catalog)).drop("__n", "__alts", "__missing", "__eligible")


def _palindromes(oriented: DataFrame) -> DataFrame:
    """Palindromes read forward where nearly all other single bases of the score are."""
    evidence = terms.strand_evidence(oriented, "pgs_id").where("consistent").select("pgs_id", F.lit(True).alias("__forward"))
    rows = oriented.join(evidence, "pgs_id", "left")
    e, o, b = F.col("effect_allele"), F.col("other_allele"), F.col("base")
    reads = (F.col("status") == "palindromic_orientation_unresolved") & F.coalesce("__forward", F.lit(False)) & ((e == b) | (o == b))
    return rows.withColumn("__palindrome", F.when(reads, _found(FORWARD, b, F.when(e == b, o).otherwise(e), e != b, F.col("pos")))).drop("__forward")


def _sequences(oriented: DataFrame, chunks: DataFrame, public: DataFrame | None, left: int) -> DataFrame:
    """Indels and other terms of several bases: the reading that fits the reference alone, else the only public record of the pair; in normal form."""
    e, o = F.col("effect_allele"), F.col("other_allele")
    wanted = F.col("status") == "sequence_reference_evidence_required"
    fits = lambda x: F.coalesce(F.substr("span", F.lit(1), F.length(x)) == x, F.lit(False))
    rows = oriented.withColumn("__pair", F.when(wanted & (fits(e) != fits(o)), F.struct(F.lit(FITS).alias("kind"), F.when(fits(e), e).otherwise(o).alias("ref"), F.when(fits(e), o).otherwise(e).alias("alt"))))
    if public is not None:
        pairs = public.withColumn("__alleles", F.array_sort(F.array("ref", "alt")))
        pairs = terms.exactly_one(pairs, ["contig", "pos", "__alleles"], ["ref", "alt"]).select("contig", "pos", "__alleles", F.struct(F.lit(PUBLIC).alias("kind"), "ref", "alt").alias("__public"))
        rows = rows.withColumn("__alleles", F.array_sort(F.array(e, o))).join(pairs, ["contig", "pos", "__alleles"], "left")
        rows = rows.withColumn("__pair", F.coalesce("__pair", F.when(wanted, F.col("__public")))).drop("__alleles", "__public")
    rows = binary.with_span(rows, chunks, F.greatest(F.lit(1), F.col("pos") - left), F.col("pos") - 1, "__left")
    normal = dosage.normalised(F.col("pos"), F.col("__pair.ref"), F.col("__pair.alt"), F.col("__left"))
    rows = rows.withColumn("__normal", normal)
    found = F.struct(F.col("__pair.kind").alias("kind"), F.col("__normal.ref").alias("ref"), F.col("__normal.alt").alias("alt"), (e == F.col("__pair.alt")).alias("effect_is_alt"), F.col("__normal.pos").alias("pos"))
    return rows.withColumn("__sequence", F.when(F.col("__pair").isNotNull() & F.col("__normal.pos").isNotNull(), found)).drop("__pair", "__left", "__normal")


def counts(compiled: DataFrame) -> DataFrame:
    """Terms of each score by what was counted ('status', 'reason', 'model' or 'inference') and its name."""
    kinds = F.array(F.struct(F.lit("status").alias("what"), F.col("status").alias("name")), F.struct(F.lit("model").alias("what"), F.col("model").alias("name")), F.struct(F.lit("inference").alias("what"), F.col("inf_kind").alias("name")))
    reasons = F.transform("reasons", lambda x: F.struct(F.lit("reason").alias("what"), x.alias("name")))
    rows = compiled.select("pgs_id", F.inline(F.concat(kinds, reasons))).where("name is not null")
    return rows.groupBy("pgs_id", "what", "name").agg(F.count(F.lit(1)).alias("n"))


def targets(compiled: DataFrame) -> DataFrame:
    """Distinct targets of compiled scores with every inference: contig, pos, ref, alt (null: any ALT) and sequence. Opt-ins never need another extraction."""
    own = compiled.where("status = 'resolved'").select("contig", "pos", "ref", "alt")
    inferred = compiled.where("inf_kind is not null").select("contig", F.col("inf_pos").alias("pos"), F.col("inf_ref").alias("ref"), F.col("inf_alt").alias("alt"))
    out = own.unionByName(inferred).where("contig is not null").distinct()
    return out.withColumn("sequence", (F.length("ref") > 1) | (F.coalesce(F.length("alt"), F.lit(1)) > 1))
