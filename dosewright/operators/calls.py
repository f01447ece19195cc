"""Genotype rules: one ordered case over the records that overlap a target of a sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed names of call states that carry a dosage.
OBSERVED = ("observed_reference", "observed_variant")
BLOCK_ALTS = ("<NON_REF>", "<*>", ".")


def is_block(alts: Column) -> Column:
    """Whether a record states reference over a range: all its ALTs are symbols for any other allele."""
    return F.forall(alts, lambda x: x.isin(*BLOCK_ALTS))


def is_structural(alts: Column) -> Column:
    """Whether a record has ALTs and all of them are symbols or breakends, none of which stands for any other allele."""
    return (F.size(alts) > 0) & F.forall(alts, lambda x: (x.startswith("<") & ~x.isin(*BLOCK_ALTS)) | x.contains("[") | x.contains("]"))


def number(value: Column) -> Column:
    """A finite number of 0 or more; anything else counts as missing."""
    x = value.try_cast("double")
    return F.when((x >= 0) & (x < float("inf")), x)


def genotype(gt: Column) -> Column:
    """Allele numbers of a GT text; null for a missing allele."""
    return F.transform(F.split(gt, "[/|]"), lambda x: x.try_cast("int"))


def _plain(filters: Column) -> Column:
    return F.forall(filters, lambda x: x.isin("PASS", "."))


def _holds(condition: Column) -> Column:
    """A condition that counts as false where it cannot be told."""
    return F.coalesce(condition, F.lit(False))


def covered_by_blocks(records: Column, pos: Column, last: Column, least_depth: int, least_quality: int) -> Column:
    """Whether passing diploid reference blocks, in file order, cover [pos, last] without a gap."""
    def fits(r: Column) -> Column:
        called = (F.size(r["gt"]) == 2) & F.forall(r["gt"], lambda g: _holds(g == 0))
        return is_block(r["alts"]) & called & _plain(r["filters"]) & _holds((r["depth"] >= least_depth) & (r["quality"] >= least_quality))

    # The next place to cover, or null after a record that does not go on from there.
    reach = F.aggregate(records, pos.cast("long"), lambda at, r: F.when(_holds(fits(r) & (r["pos"] <= at)), F.greatest(at, r["end_"].cast("long") + 1)))
    return _holds(reach > last)


def classify(groups: DataFrame, haploid_as_diploid: bool = False, accept_missing_quality: bool = False, field: str = "gt", least_depth: int = 10, least_quality: int = 20) -> DataFrame:
    """Adds state and alt_dosage to ``groups``: target columns and ``records``, its overlapping records in file order.

    A target is contig, pos, ref, alt (null: any ALT counts) and reference_ok, with ``sequence`` true for one of
    more than a base. A record is a struct <pos, end_, ref, alts, filters, gt, ft, depth, quality, anchor_ok>; for
    sequence targets it also has ``normal``, its ALTs in normal form as pos:ref:alt, and under ``field`` 'ds' or
    'gp' that field's text. The first rule that holds decides; a null GT has no alleles. Under 'ds' and 'gp' the
    column ``measurement`` <ds, gp> holds the dosage and alt_dosage is null for records that are no blocks.
    """
    from .dosage import ds, gp

    recs = F.col("records")
    shape = groups.schema["records"].dataType.elementType.names
    first = F.get(recs, F.lit(0))
    n = F.coalesce(F.size(recs), F.lit(0))
    sequence = _holds(F.col("sequence")) if "sequence" in groups.columns else F.lit(False)
    block = _holds(is_block(first["alts"]))
    gt = F.coalesce(first["gt"], F.array().cast("array<int>"))
    if haploid_as_diploid:
        gt = F.when((F.size(gt) == 1) & F.col("contig").isin(23, 24), F.concat(gt, gt)).otherwise(gt)
    missing = F.size(F.filter(gt, lambda x: x.isNull()))
    refcall = (F.array_join(first["filters"], ";") == "RefCall") & (F.array_join(gt, "/") == "0/0")
    passes = _holds(_plain(first["filters"]) | refcall)
    depth, quality = first["depth"], first["quality"]
    # What bars a target whatever else it has, record by record.
    barred = F.transform(recs, lambda r: F.when(_holds(~r["ft"].isin("PASS", ".")), "genotype_filtered").when(_holds(is_block(r["alts"]) & ~r["anchor_ok"]), "reference_anchor_mismatch"))
    barred = F.get(F.array_compact(barred), F.lit(0))
    accepted = F.lit(accept_missing_quality) & depth.isNull() & quality.isNull() & ~block
    called = F.filter(gt, lambda x: x > 0)
    last = F.col("pos") + F.length("ref") - 1
    any_alt = F.col("alt").isNull()
    out_of_list = F.exists(called, lambda x: x > F.size(first["alts"]))
    target_index = F.array_position(first["alts"], F.col("alt")).cast("int")
    other = _holds(out_of_list) | _holds(~any_alt & F.exists(called, lambda x: ~x.eqNullSafe(target_index)))
    dosage = F.size(called)
    place = ~(first["pos"].eqNullSafe(F.col("pos")) & first["ref"].eqNullSafe(F.col("ref")))
    measured = F.lit(field != "gt") & ~block
    if "normal" in shape:
        wanted = F.concat_ws(":", F.col("pos"), F.col("ref"), F.col("alt"))
        other = F.when(sequence, F.exists(called, lambda x: ~F.get(first["normal"], x - 1).eqNullSafe(wanted))).otherwise(other)
        short = (F.size(called) < F.size(gt)) & ((first["pos"] > F.col("pos")) | (first["end_"] < last))
        place = F.when(sequence, _holds(short)).otherwise(place)
    state = (
        F.when(barred.isNotNull(), barred)
        .when(~_holds(F.col("reference_ok")), "reference_mismatch")
        .when(n == 0, "unknown_no_record")
        .when((n > 1) & sequence & covered_by_blocks(recs, F.col("pos"), last, least_depth, least_quality), "observed_reference")
        .when(n > 1, "ambiguous_overlapping_records")
        .when(~measured & (F.size(gt) != 2), "unsupported_ploidy")
        .when(~measured & (missing == 2), "no_call")
        .when(~measured & (missing == 1), "partial_no_call")
        .when(~passes, "filtered")
        .when(_holds((depth < least_depth) | (quality < least_quality)) & depth.isNotNull() & quality.isNotNull(), "low_quality")
        .when((depth.isNull() | quality.isNull()) & ~accepted, "quality_missing")
    )
    if field != "gt":
        text = first[field]
        value = {"ds": ds, "gp": gp}[field](text)
        alone = (F.size(first["alts"]) == 1) & ~F.get(first["alts"], F.lit(0)).startswith("<") & (F.get(first["alts"], F.lit(0)) != "*") & ~place
        alone = alone & (any_alt | (F.get(first["alts"], F.lit(0)) == F.col("alt")))
        zero = value["digits"] == "0" if field == "ds" else (value[1]["digits"] == "0") & (value[2]["digits"] == "0")
        state = state.when(measured & ~_holds(alone), "unsupported_allele_representation")
        state = state.when(measured & (F.size(gt) != 2) & ~((F.size(gt) == 1) & (missing == 1)) & (F.size(gt) != 0), "unsupported_ploidy")
        state = state.when(measured & _holds(F.coalesce(text, F.lit(".")) == "."), "dosage_missing").when(measured & value.isNull(), "invalid_dosage")
        state = state.when(measured & _holds(zero), "observed_reference").when(measured, "observed_variant")
    state = (
        state.when(block & (F.size(called) > 0), "unsupported_symbolic_genotype")
        .when(block & ((first["end_"] < last) | (first["pos"] > F.col("pos"))), "incomplete_reference_span")
        .when(block, "observed_reference")
        .when(place, "unsupported_allele_representation")
        .when(other, "other_called_allele")
        .when(dosage > 0, "observed_variant")
        .when(dosage == 0, "observed_reference")
        .otherwise(F.raise_error(F.lit("no genotype rule applies")))
    )
    out = groups.withColumn("state", state)
    observed = F.col("state").isin(*OBSERVED)
    alt_dosage = F.when(F.col("state") == "observed_variant", dosage).when(F.col("state") == "observed_reference", F.lit(0))
    if field != "gt":
        none = F.lit(None)
        own = F.struct((value if field == "ds" else none.cast(_exact())).alias("ds"), (value if field == "gp" else none.cast(f"array<{_exact()}>")).alias("gp"))
        out = out.withColumn("measurement", F.when(observed & measured, own))
        alt_dosage = F.when(block, alt_dosage)
    return out.withColumn("alt_dosage", alt_dosage.cast("int"))


def _exact() -> str:
    return "struct<neg:boolean,digits:string,exp:int>"


def grouped(targets: DataFrame, overlaps: DataFrame, keys: list[str], record: list[str], order: str) -> DataFrame:
    """``targets`` with the records of ``overlaps`` that share ``keys``, in file order; a target without any keeps an empty list.

    A target of one sample overlaps few records, so the list is bounded by the file, not by the corpus.
    """
    own = overlaps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *record))).alias("records"))
    return targets.join(own, keys, "left").withColumn("records", F.coalesce("records", F.filter("records", lambda x: F.lit(False))))
