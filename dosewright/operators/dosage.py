"""DS and GP measurements, variant normalisation and the waivers of review reasons."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exact


def _within(x: Column, most: int) -> Column:
    """Whether an exact value lies in [0, most]."""
    value = exact.to_double(x)
    return (~x["neg"] | (x["digits"] == "0")) & (value <= most)


def ds(text: Column) -> Column:
    """The dosage of a DS text: an exact value in [0, 2], else null."""
    x = exact.parse(text)
    return F.when(_within(x, 2), x)


def _sums_to_one(xs: Column) -> Column:
    """Whether exact values in [0, 1] with exponents of 0 or less sum to 1, at any number of decimals.

    Decimals are cut into groups of 15, summed from the last group with what each group carries.
    """
    places = F.array_max(F.transform(xs, lambda x: -x["exp"]))
    n = F.ceil(places / F.lit(15)).cast("int")
    unit = 10**15

    def digits(x: Column) -> Column:
        """The whole number 0 or 1 and all decimals, padded to whole groups."""
        return F.rpad(F.lpad(x["digits"], F.greatest(F.length(x["digits"]), 1 - x["exp"]), "0"), 1 + n * 15, "0")

    texts = F.transform(xs, digits)
    group = lambda k: F.aggregate(texts, F.lit(0).cast("long"), lambda s, t: s + F.substr(t, 2 + k * 15, F.lit(15)).cast("long"))
    whole = F.aggregate(texts, F.lit(0).cast("long"), lambda s, t: s + F.substr(t, F.lit(1), F.lit(1)).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("carry"), F.lit(True).alias("even"))
    step = lambda s, k: F.struct(F.call_function("div", s["carry"] + group(k), F.lit(unit)).alias("carry"), (s["even"] & ((s["carry"] + group(k)) % unit == 0)).alias("even"))
    ends = F.when(n > 0, F.reverse(F.sequence(F.lit(0), n - 1))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(ends, start, step)
    return total["even"] & (whole + total["carry"] == 1)


def gp(text: Column) -> Column:
    """The three probabilities of a GP text as exact values; null unless they lie in [0, 1] and sum to 1 exactly."""
    xs = F.transform(F.split(text, ",", -1), exact.parse)
    fits = (F.size(xs) == 3) & F.forall(xs, lambda x: x.isNotNull()) & F.forall(xs, lambda x: _within(x, 1))
    # 1E0 and 0E5 are 1 and 0: exponents above 0 become 0.
    level = F.transform(xs, lambda x: F.when(x["exp"] > 0, F.struct(x["neg"].alias("neg"), F.when(x["digits"] == "0", F.lit("0")).otherwise(F.concat(x["digits"], F.repeat(F.lit("0"), x["exp"]))).alias("digits"), F.lit(0).alias("exp"))).otherwise(x))
    return F.when(F.coalesce(fits, F.lit(False)), F.when(_sums_to_one(level), xs))


@F.pandas_udf(exact.EXACT)
def expected(weight: pd.Series, model: pd.Series, effect_is_alt: pd.Series, dosage: pd.DataFrame, probabilities: pd.Series) -> pd.DataFrame:
    """Expected contribution of a term: weight times effect dosage under DS, the mean over genotypes under GP.

    ``weight`` is the term's weights array. Null where neither measurement serves the model.
    """
    def add(terms: list[tuple[int, int]]) -> tuple:
        low = min(0, *(e for _, e in terms))
        total = sum(c * 10 ** (e - low) for c, e in terms)
        return total < 0, str(abs(total)), low

    def signed(x: dict) -> tuple[int, int]:
        return (-1 if x["neg"] else 1) * int(x["digits"]), int(x["exp"])

    rows = []
    for ws, kind, alt, (neg, digits, exp), ps in zip(weight, model, effect_is_alt, dosage[["neg", "digits", "exp"]].itertuples(index=False, name=None), probabilities, strict=True):
        if ps is not None and all(w is not None for w in ws):
            terms = []
            for k, p in enumerate(ps):
                d = k if alt else 2 - k
                w = ws[d] if kind == "dosage_weights" else ws[0]
                times = {"additive": d, "dominant": int(d > 0), "recessive": int(d == 2)}.get(kind, 1)
                (a, e), (b, f) = signed(w), signed(p)
                terms.append((a * b * times, e + f))
            rows.append(add(terms))
        elif isinstance(digits, str) and kind == "additive" and ws[0] is not None:
            (a, e), (b, f) = signed(ws[0]), (int(digits), int(exp))
            rows.append(add([(a * b, e + f)] if alt else [(2 * a, e), (-a * b, e + f)]))
        else:
            rows.append((None, None, None))
    return pd.DataFrame(rows, columns=["neg", "digits", "exp"])


_BASES = frozenset("ACGT")


def normalise(pos: int, ref: str, alt: str, base: Callable[[int], str | None]) -> tuple[int, str, str] | None:
    """The shortest form of a variant, as far to the left as its bases allow; ``base`` reads the reference.

    None if the alleles are equal, hold other letters than ACGT, or the variant runs off the reference.
    """
    if not ref or not alt or ref == alt or not _BASES.issuperset(ref + alt):
        return None
    while ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
        if not ref or not alt:
            pos -= 1
            before = base(pos) if pos >= 1 else None
            if not before:
                return None
            ref, alt = before + ref, before + alt
    shared = next((k for k, (x, y) in enumerate(zip(ref, alt, strict=False)) if x != y), min(len(ref), len(alt)))
    shared = min(shared, len(ref) - 1, len(alt) - 1)
    return pos + shared, ref[shared:], alt[shared:]


VARIANT = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("ref", T.StringType()), T.StructField("alt", T.StringType())])


@F.pandas_udf(VARIANT)
def normalised(pos: pd.Series, ref: pd.Series, alt: pd.Series, left: pd.Series) -> pd.DataFrame:
    """``normalise`` with the reference bases just before each position (``left`` ends at pos - 1); null where they do not reach."""
    rows = []
    for p, r, a, before in zip(pos, ref, alt, left, strict=True):
        first, own = int(p) - len(before or ""), before or ""
        found = normalise(int(p), r, a, lambda q, s=own, f=first: s[q - f] if q >= f else None) if r and a else None
        rows.append(found or (None, None, None))
    return pd.DataFrame(rows, columns=["pos", "ref", "alt"])


#: Kinds of inference, and the opt-in that each needs.
INFERRED = {"reference_anchored": "alleles", "catalog_other_allele": "alleles", "palindrome_forward_strand": "palindromes", "reference_fit_sequence": "indels", "public_sequence_pair": "indels"}


def accepted(rows: DataFrame, informational: bool = False, alleles: bool = False, palindromes: bool = False, indels: bool = False, reasons: str = "reasons") -> DataFrame:
    """Adds ``review`` and ``resolved`` and puts an accepted inference in place of the orientation (ref, alt, effect_is_alt, pos).

    An informational description waives its own reason. An inferred palindrome or indel counts where no other reason
    is left, an inferred other allele where the missing one is the only reason left.
    """
    left = F.col(reasons)
    if informational:
        left = F.when(F.col("informational"), F.array_remove(left, "variant_description_requires_review")).otherwise(left)
    allowed = [k for k, needs in INFERRED.items() if {"alleles": alleles, "palindromes": palindromes, "indels": indels}[needs]]
    kind = F.col("inf_kind")
    lacking = F.when(F.coalesce(kind.isin("reference_anchored", "catalog_other_allele"), F.lit(False)), F.array(F.lit("author_other_allele_missing"))).otherwise(F.array().cast("array<string>"))
    taken = F.coalesce(kind.isin(*allowed) if allowed else F.lit(False), F.lit(False)) & (left == lacking)
    out = rows.withColumn("__taken", taken).withColumn("review", (F.size(left) > 0) & ~F.col("__taken")).withColumn("resolved", (F.col("status") == "resolved") | F.col("__taken"))
    moved = {"ref": "inf_ref", "alt": "inf_alt", "effect_is_alt": "inf_effect_is_alt", "pos": "inf_pos"}
    return out.withColumns({k: F.when(F.col("__taken"), F.col(v)).otherwise(F.col(k)) for k, v in moved.items()}).drop("__taken")


def waived(rows: DataFrame, reasons: str = "reasons", informational: bool = False, inferred_alleles: bool = False) -> DataFrame:
    """Adds ``review``: whether a term still needs review under the opt-ins given.

    An informational description waives its own reason alone; an inferred other allele waives a term whose
    only reason is the missing one (column ``inferred`` says that one was found).
    """
    left = F.col(reasons)
    if informational:
        left = F.when(F.col("informational"), F.array_remove(left, "variant_description_requires_review")).otherwise(left)
    review = F.size(left) > 0
    if inferred_alleles:
        review = review & ~(F.col("inferred") & (left == F.array(F.lit("author_other_allele_missing"))))
    return rows.withColumn("review", review)
