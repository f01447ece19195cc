"""Exact decimals of any length, as a struct <neg, digits, exp>: (-1)^neg * digits * 10^exp.

A value keeps its exponent and its sign even when it is zero. Sums are exact and need no wide type: the
digits are cut into limbs of 9, each limb is summed for its own exponent in two whole numbers that hold it, with
partial aggregation, and only the few limb sums of a key are put together as big integers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT = T.StructType([T.StructField("neg", T.BooleanType()), T.StructField("digits", T.StringType()), T.StructField("exp", T.IntegerType())])
GRAMMAR = r"^([+-]?)(?:([0-9]+)(?:\.([0-9]*))?|\.([0-9]+))(?:[eE]([+-]?[0-9]+))?$"
LIMB = 9


def parse(text: Column) -> Column:
    """The exact value of a decimal text of at most 128 bytes; null for any other text."""
    part = lambda k: F.regexp_extract(text, GRAMMAR, k)
    fraction = F.concat(part(3), part(4))
    digits = F.regexp_replace(F.concat(part(2), fraction), "^0+", "")
    digits = F.when(digits == "", F.lit("0")).otherwise(digits)
    power = F.when(part(5) == "", F.lit(0)).otherwise(part(5).try_cast("int"))
    exp = power - F.length(fraction)
    high = exp + F.length(digits) - 1
    value = F.struct((part(1) == "-").alias("neg"), digits.alias("digits"), exp.cast("int").alias("exp"))
    return F.when(text.rlike(GRAMMAR) & (F.octet_length(text) <= 128) & high.between(-1000, 100), value)


def from_int(number: Column, exp: int) -> Column:
    """The exact value number * 10^exp of an integer column."""
    return F.when(number.isNotNull(), F.struct((number < 0).alias("neg"), F.abs(number).cast("string").alias("digits"), F.lit(exp).alias("exp")))


def adjusted(x: Column) -> Column:
    """Exponent of the first digit."""
    return x["exp"] + F.length(x["digits"]) - 1


def plain(x: Column) -> Column:
    """Positional text, without an exponent."""
    digits, exp = x["digits"], x["exp"]
    point = F.greatest(F.length(digits), 1 - exp)
    wide = F.lpad(digits, point, "0")
    low = F.concat(F.substr(wide, F.lit(1), point + exp), F.lit("."), F.substr(wide, point + exp + 1))
    high = F.when(digits == "0", F.lit("0")).otherwise(F.concat(digits, F.repeat(F.lit("0"), exp)))
    return F.concat(F.when(x["neg"], F.lit("-")).otherwise(F.lit("")), F.when(exp < 0, low).otherwise(high))


def text(x: Column) -> Column:
    """Positional text where the exponent is 0 or less and the value not too small, else scientific."""
    digits, high = x["digits"], adjusted(x)
    rest = F.substr(digits, F.lit(2))
    science = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")), F.lit("E"), F.when(high < 0, F.lit("-")).otherwise(F.lit("+")), F.abs(high).cast("string"))
    sign = F.when(x["neg"], F.lit("-")).otherwise(F.lit(""))
    return F.when((x["exp"] <= 0) & (high >= -6), plain(x)).otherwise(F.concat(sign, science))


def rescaled(x: Column, exp: Column) -> Column:
    """The value of ``x`` at a smaller exponent; null where digits other than 0 would be lost."""
    more = x["exp"] - exp
    digits = F.when(x["digits"] == "0", F.lit("0")).when(more >= 0, F.concat(x["digits"], F.repeat(F.lit("0"), more)))
    return F.when(digits.isNotNull(), F.struct(x["neg"].alias("neg"), digits.alias("digits"), exp.cast("int").alias("exp")))


def magnitude_key(x: Column) -> Column:
    """Sorts as the absolute value does, without floats and at any length: zero first, then first places, then digits."""
    zero = x["digits"] == "0"
    return F.struct((~zero).alias("some"), F.when(zero, F.lit(0)).otherwise(adjusted(x)).alias("high"), F.rtrim(x["digits"], F.lit("0")).alias("digits"))


def value_key(x: Column) -> Column:
    """Sorts as the value does: a sign, and for negatives the reversed magnitude, whose end sorts after every digit."""
    m = magnitude_key(x)
    turned = F.concat(F.translate(m["digits"], "0123456789", "9876543210"), F.lit(":"))
    sign = F.when(~m["some"], 0).when(x["neg"], -1).otherwise(1)
    return F.struct(sign.alias("sign"), (m["high"] * sign).alias("high"), F.when(sign < 0, turned).otherwise(m["digits"]).alias("digits"))


def magnitude(x: Column) -> Column:
    """The absolute value."""
    return F.when(x.isNotNull(), F.struct(F.lit(False).alias("neg"), x["digits"].alias("digits"), x["exp"].alias("exp")))


def times_digits(digits: Column, times: Column) -> Column:
    """The digits of a product with a whole number from 0 to 9, at any length."""
    width = 17
    n = F.ceil(F.length(digits) / F.lit(width)).cast("int")
    padded, unit = F.lpad(digits, n * width, "0"), F.lit(10**width)

    def step(acc: Column, k: Column) -> Column:
        value = F.substr(padded, (n - 1 - k) * width + 1, F.lit(width)).cast("long") * times + acc["carry"]
        return F.struct(F.concat(F.lpad(F.pmod(value, unit).cast("string"), width, "0"), acc["out"]).alias("out"), F.call_function("div", value, unit).alias("carry"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("carry"))
    long = F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda acc: F.regexp_replace(F.concat(acc["carry"].cast("string"), acc["out"]), "^0+(?=.)", ""))
    short = (F.when(F.length(digits) <= width, digits).cast("long") * times).cast("string")
    return F.when(times == 0, "0").when(times == 1, digits).when(F.length(digits) <= width, short).otherwise(long)


def to_double(x: Column) -> Column:
    return F.concat(F.when(x["neg"], F.lit("-")).otherwise(F.lit("")), x["digits"], F.lit("E"), x["exp"].cast("string")).cast("double")


def limbs(x: Column) -> Column:
    """array<struct<exp, limb>>: the digits in groups of 9, as signed whole numbers at their own exponents."""
    n = F.ceil(F.length(x["digits"]) / F.lit(LIMB)).cast("int")
    padded = F.lpad(x["digits"], n * LIMB, "0")

    def limb(k: Column) -> Column:
        own = F.substr(padded, (n - 1 - k) * LIMB + 1, F.lit(LIMB)).cast("long")
        return F.struct((x["exp"] + k * LIMB).cast("int").alias("exp"), F.when(x["neg"], -own).otherwise(own).alias("limb"))

    return F.transform(F.sequence(F.lit(0), n - 1), limb)


@F.pandas_udf(EXACT)
def joined(parts: pd.Series, least: pd.Series) -> pd.DataFrame:
    """The exact value of limb sums <exp, high, low> (high counts 10^9), at the exponent ``least`` or 0."""
    rows = []
    for own, low in zip(parts, least, strict=True):
        low = min(0, int(low)) if low is not None and low == low else 0
        total = sum((int(p["high"]) * 10**LIMB + int(p["low"])) * 10 ** (int(p["exp"]) - low) for p in own) if own is not None else 0
        rows.append((total < 0, str(abs(total)), low))
    return pd.DataFrame(rows, columns=["neg", "digits", "exp"])


def limb_sums(limb: Column, times: Column) -> list[Column]:
    """Aggregates ``high`` and ``low`` of limb * times (below 9 * 10^9 in size): neither overflows below 9 * 10^9 rows."""
    value = limb * times.cast("long")
    unit = 10**LIMB
    return [F.sum(F.call_function("div", value - F.pmod(value, F.lit(unit)), F.lit(unit))).alias("high"), F.sum(F.pmod(value, F.lit(unit))).alias("low")]


def exact_sum(df: DataFrame, keys: list[str], value: Column, times: Column | None = None, name: str = "total") -> DataFrame:
    """One row per key with the exact sum of value * times (null values do not count).

    Its exponent is the least of the values' exponents and 0, zeros included; a zero sum has no sign.
    """
    times = F.lit(1) if times is None else times
    own = df.select(*keys, value.alias("__v"), times.cast("long").alias("__n"))
    one = F.explode_outer(F.when(F.col("__v").isNotNull(), limbs(F.col("__v"))))
    cut = own.select(*keys, F.col("__v.exp").alias("__low"), "__n", one.alias("__l"))
    sums = cut.groupBy(*keys, F.col("__l.exp").alias("exp")).agg(*limb_sums(F.col("__l.limb"), F.col("__n")), F.min("__low").alias("__low"))
    part = F.when(F.col("exp").isNotNull(), F.struct("exp", "high", "low"))
    grouped = sums.groupBy(*keys).agg(F.collect_list(part).alias("__parts"), F.min("__low").alias("__low"))  # a row per exponent met
    return grouped.select(*keys, joined("__parts", "__low").alias(name))


@F.pandas_udf(EXACT)
def product(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
    """Exact product; null if a factor is null. Exponents add up, signs multiply."""
    rows = []
    for a, da, ea, b, db, eb in zip(x["neg"], x["digits"], x["exp"], y["neg"], y["digits"], y["exp"], strict=True):
        rows.append((None, None, None) if da is None or db is None else (bool(a) != bool(b), str(int(da) * int(db)), int(ea) + int(eb)))
    return pd.DataFrame(rows, columns=["neg", "digits", "exp"])


@F.pandas_udf(EXACT)
def one_minus(x: pd.DataFrame) -> pd.DataFrame:
    """1 - x at the exponent min(0, that of x)."""
    rows = []
    for neg, digits, exp in zip(x["neg"], x["digits"], x["exp"], strict=True):
        if digits is None:
            rows.append((None, None, None))
            continue
        low = min(0, int(exp))
        value = 10**-low - (-1 if neg else 1) * int(digits) * 10 ** (int(exp) - low)
        rows.append((value < 0, str(abs(value)), low))
    return pd.DataFrame(rows, columns=["neg", "digits", "exp"])


@F.pandas_udf(EXACT)
def difference(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
    """x - y at the smaller exponent of both."""
    rows = []
    for a, da, ea, b, db, eb in zip(x["neg"], x["digits"], x["exp"], y["neg"], y["digits"], y["exp"], strict=True):
        if da is None or db is None:
            rows.append((None, None, None))
            continue
        low = min(int(ea), int(eb))
        value = (-1 if a else 1) * int(da) * 10 ** (int(ea) - low) - (-1 if b else 1) * int(db) * 10 ** (int(eb) - low)
        rows.append((value < 0, str(abs(value)), low))
    return pd.DataFrame(rows, columns=["neg", "digits", "exp"])
