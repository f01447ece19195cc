"""Comparison of two score tables, and of two term tables, by full outer joins on exact numbers."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed texts that mean no value.
NULLS = ("", "NA", "N/A", ".", "nan", "NaN")
_NUMBER = re.compile(r"([+-]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]+))?")
#: Most digits of a number, and the largest exponent.
DIGITS, EXPONENT = 32_768, 16_384


def number(text: str | None) -> tuple[int, int] | None:
    """(whole number, exponent) of a decimal text; None for a text that means no value, an error for any other."""
    if text is None or (text := text.strip()) in NULLS:
        return None
    m = _NUMBER.fullmatch(text)
    if not m or not (m[2] or m[3]) or len(m[4] or "") > 7:
        raise ValueError(f"not a number: {text[:40]!r}")
    digits, exp = (m[2] + (m[3] or "")).lstrip("0") or "0", int(m[4] or 0) - len(m[3] or "")
    if len(digits) > DIGITS or abs(exp) > EXPONENT:
        raise ValueError(f"number out of range: {text[:40]!r}")
    value = 0
    for at in range(0, len(digits), 4000):  # Python refuses longer texts at once
        part = digits[at : at + 4000]
        value = value * 10 ** len(part) + int(part)
    return (-value if m[1] == "-" else value), exp


def compact(value: int, exp: int) -> str:
    """A number as its shortest digits and exponent: 1e-2, 25, -3e4; 0 for zero."""
    if not value:
        return "0"
    while value % 10 == 0:
        value, exp = value // 10, exp + 1
    sign, value = ("-" if value < 0 else ""), abs(value)
    parts = []
    while value:
        value, part = divmod(value, 10**4000)
        parts.append(str(part).rjust(4000, "0") if value else str(part))
    return sign + "".join(parts[::-1]) + (f"e{exp}" if exp else "")


def _judged(left: str | None, right: str | None, absolute: tuple[int, int], relative: tuple[int, int]) -> tuple[str, str | None]:
    a, b = number(left), number(right)
    if a is None or b is None:
        return "unavailable", None
    low = min(a[1], b[1])
    x, y = a[0] * 10 ** (a[1] - low), b[0] * 10 ** (b[1] - low)
    delta = compact(y - x, low)
    if x == y:
        return "exact", delta
    # |y - x| 10^low <= abs + rel max(|x|, |y|) 10^low, at the least exponent of all.
    least = min(low, absolute[1], low + relative[1])
    bound = absolute[0] * 10 ** (absolute[1] - least) + relative[0] * max(abs(x), abs(y)) * 10 ** (low + relative[1] - least)
    return ("within_tolerance" if abs(y - x) * 10 ** (low - least) <= bound else "different"), delta


def compare_scores(left: DataFrame, right: DataFrame, absolute: str = "0", relative: str = "0", keys: tuple[str, ...] = ("sample", "pgs_id"), value: str = "score", identity: tuple[str, ...] = ()) -> DataFrame:
    """A row per key with both values (texts), their exact difference and a status.

    A key found twice on one side is an error. Where both sides have a value in a column of ``identity`` and they
    differ, the status is identity_mismatch. Texts that are no numbers, and negative tolerances, are errors.
    """
    tolerances = [number(str(x)) for x in (absolute, relative)]
    if any(x is None or x[0] < 0 for x in tolerances):
        raise ValueError("tolerances must be numbers of 0 or more")
    k = list(keys)

    @F.pandas_udf("status string, delta string")
    def judged(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_judged(x, y, *tolerances) for x, y in zip(a, b, strict=True)], columns=["status", "delta"])

    def side(table: DataFrame, name: str) -> DataFrame:
        own = table.groupBy(*k).agg(F.count(F.lit(1)).alias(f"__{name}"), F.first(F.col(value).cast("string")).alias(f"{name}_score"), *(F.first(c).alias(f"__{name}_{c}") for c in identity))
        twice = F.raise_error(F.concat(F.lit("key found twice: "), F.concat_ws(", ", *(F.col(c).cast("string") for c in k))))
        return own.withColumn(f"__{name}", F.when(F.col(f"__{name}") > 1, twice).otherwise(F.lit(True)))

    out = side(left, "left").join(side(right, "right"), k, "full_outer").withColumn("__j", judged("left_score", "right_score"))
    differs = F.lit(False)
    for c in identity:
        differs = differs | F.coalesce(F.col(f"__left_{c}") != F.col(f"__right_{c}"), F.lit(False))
    status = F.when(F.col("__right").isNull(), "left_only").when(F.col("__left").isNull(), "right_only").when(differs, "identity_mismatch").otherwise(F.col("__j.status"))
    return out.select(*k, "left_score", "right_score", F.when(F.col("__left").isNotNull() & F.col("__right").isNotNull(), F.col("__j.delta")).alias("delta"), status.alias("status"))


def one_sampleset(table: DataFrame, wanted: str | None = None, column: str = "sampleset") -> DataFrame:
    """The rows of one sample set; a table of several is an error unless one is named."""
    if wanted is not None:
        return table.where(F.col(column) == wanted)
    names = [r[0] for r in table.select(column).distinct().limit(2).collect()]
    if len(names) > 1:
        raise ValueError(f"several sample sets: {names}")
    return table


def status_counts(compared: DataFrame) -> DataFrame:
    return compared.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def agrees(compared: DataFrame) -> DataFrame:
    """One row: whether every key is exact or within tolerance."""
    return compared.agg((F.count_if(~F.col("status").isin("exact", "within_tolerance")) == 0).alias("agrees"))


def repeated_keys(table: DataFrame, keys: tuple[str, ...] = ("sample", "pgs_id")) -> DataFrame:
    """Keys found more than once, which make a table unfit for comparison."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def compare_terms(left: DataFrame, right: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """A row per term that differs: the names of the fields that changed, or the side it is on."""
    a = left.select(*key, *(F.col(f).alias(f"l_{f}") for f in fields), F.lit(True).alias("__l"))
    b = right.select(*key, *(F.col(f).alias(f"r_{f}") for f in fields), F.lit(True).alias("__r"))
    changed = F.array_compact(F.array(*(F.when(~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}")), F.lit(f)) for f in fields)))
    side = F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only").otherwise("both")
    out = a.join(b, key, "full_outer").select(*key, side.alias("side"), changed.alias("changed_fields"))
    return out.where((F.col("side") != "both") | (F.size("changed_fields") > 0))


def page(rows: DataFrame, after: int, limit: int, key: str = "ordinal") -> DataFrame:
    """The ``limit`` rows that follow ``after`` in order of ``key``."""
    return rows.where(F.col(key) > after).orderBy(key).limit(limit)


def batches(rows: DataFrame, keys: list[str], size: int = 2000) -> DataFrame:
    """Digest of each batch of ``size`` ordinals: SHA-256 over its rows' digests in order; a batch has ``size`` rows at most."""
    own = rows.withColumn("batch", ((F.col("ordinal") - 1) / size).cast("long"))
    line = F.sha2(F.to_json(F.struct("*")), 256)
    own = own.withColumn("__h", line)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "__h"))), lambda x: x["__h"]), "\n")
    return own.groupBy(*keys, "batch").agg(F.count(F.lit(1)).alias("n"), F.concat(F.lit("sha256:"), F.sha2(joined, 256)).alias("digest"))


def sorted_and_contiguous(records: DataFrame, group: str, order: str) -> DataFrame:
    """Per group: records out of order within a contig, and contigs met again after another one."""
    by = Window.partitionBy(group).orderBy(order)
    own = records.withColumn("__c", F.lag("contig").over(by)).withColumn("__p", F.lag("pos").over(by))
    changes = F.count_if(F.col("__c").isNull() | (F.col("__c") != F.col("contig")))
    return own.groupBy(group).agg(F.count_if((F.col("__c") == F.col("contig")) & (F.col("pos") < F.col("__p"))).alias("unsorted"), (changes - F.count_distinct("contig")).alias("reopened"))
