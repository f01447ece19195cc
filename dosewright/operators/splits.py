"""Records split from one site with several ALTs, read as that site again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calls import is_block


def only_after_first_base(r: Column) -> Column:
    """Whether a record holds nothing but indels that keep its first base, and so says nothing about that base."""
    return (F.size(r["alts"]) > 0) & F.forall(
        r["alts"], lambda a: (F.length(a) != F.length(r["ref"])) & ~a.startswith("<") & (F.left(a, F.lit(1)) == F.left(r["ref"], F.lit(1)))
    )


def _least(records: Column, field: str) -> Column:
    """The smallest value of a field that every record has, else null."""
    return F.when(F.forall(records, lambda r: r[field].isNotNull()), F.array_min(F.transform(records, lambda r: r[field])))


def merged(groups: DataFrame, sequence: bool = False) -> DataFrame:
    """``groups`` with the split records of each target put together, without a shuffle.

    ``groups`` is as for :func:`calls.classify`. Of two or more records, those that start at the target
    become one: its REF is the longest, its ALTs are extended to it, and a haplotype with different ALTs in
    two records is not called. For a single base (not ``sequence``), records there with only indels after it
    are set aside. Records that start elsewhere stay, and nothing is merged if ploidies differ, a REF is not
    the beginning of the longest, or one is a block or symbolic. Fields not named here come from the first
    record. Groups of one record or none are left alone; a null REF or GT merges nothing.
    """
    recs = F.col("records")
    apart = F.filter(recs, lambda r: ~r["pos"].eqNullSafe(F.col("pos")))
    here = F.filter(recs, lambda r: r["pos"].eqNullSafe(F.col("pos")) & (F.lit(sequence) | ~F.coalesce(only_after_first_base(r), F.lit(False))))
    steps = groups.withColumns({"_apart": apart, "_here": here})
    own = F.col("_here")
    steps = steps.withColumn("_longest", F.array_max(F.transform(own, lambda r: F.struct(F.length(r["ref"]).alias("n"), r["ref"].alias("ref"))))["ref"])
    longest, first = F.col("_longest"), F.get(own, F.lit(0))

    def extended(r: Column, alt: Column) -> Column:
        return F.concat(alt, F.substring(longest, F.length(r["ref"]) + 1, F.length(longest)))

    def fits(r: Column) -> Column:
        symbolic = F.exists(r["alts"], lambda a: a.startswith("<"))
        return longest.startswith(r["ref"]) & (F.size(r["gt"]) == F.size(first["gt"])) & ~is_block(r["alts"]) & ~symbolic

    steps = steps.withColumn("_alts", F.array_distinct(F.flatten(F.transform(own, lambda r: F.transform(r["alts"], lambda a: extended(r, a))))))

    def allele(h: Column) -> Column:
        def code(r: Column) -> Column:
            k = F.get(r["gt"], h)
            return F.when(k == 0, 0).otherwise(F.array_position(F.col("_alts"), extended(r, F.get(r["alts"], k - 1))).cast("int"))

        codes = F.transform(own, code)
        carried = F.array_distinct(F.filter(codes, lambda c: c > 0))
        return F.when(~F.exists(codes, lambda c: c.isNull()) & (F.size(carried) < 2), F.coalesce(F.get(carried, F.lit(0)), F.lit(0)))

    failing = F.filter(F.flatten(F.transform(own, lambda r: r["filters"])), lambda x: ~x.isin("PASS", "."))
    failed = F.filter(F.transform(own, lambda r: r["ft"]), lambda x: ~x.isin("PASS", "."))
    haplotypes = F.when(F.size(first["gt"]) > 0, F.sequence(F.lit(0), F.size(first["gt"]) - 1)).otherwise(F.array().cast("array<int>"))
    fields = {
        "pos": F.col("pos"),
        "end_": F.col("pos") + F.length(longest) - 1,
        "ref": longest,
        "alts": F.col("_alts"),
        "filters": F.when(F.size(failing) > 0, failing).otherwise(first["filters"]),
        "gt": F.transform(haplotypes, allele),
        "ft": F.coalesce(F.get(failed, F.lit(0)), first["ft"]),
        "depth": _least(own, "depth"),
        "quality": _least(own, "quality"),
        "anchor_ok": F.forall(own, lambda r: r["anchor_ok"]),
    }
    shape = groups.schema["records"].dataType.elementType
    one = F.struct(*[fields.get(f.name, first[f.name]).cast(f.dataType).alias(f.name) for f in shape])
    together = (F.size(own) > 1) & F.coalesce(F.forall(own, fits), F.lit(False))
    out = F.when(F.size(recs) < 2, recs).when(together, F.concat("_apart", F.array(one))).otherwise(F.concat("_apart", "_here"))
    return steps.withColumn("records", F.when(recs.isNotNull(), out)).drop("_apart", "_here", "_longest", "_alts")
