"""Measurements, normalisation and waivers."""

import random

import pytest
from pyspark.sql import functions as F

from dosewright.functions import exact
from dosewright.operators import dosage


def test_measurements(spark):
    rows = [("0.125", "0.2,0.3,0.5"), ("2", "0,0,1"), ("2.01", "0.2,0.3,0.4"), ("-0.1", "0.5,0.5"), (".", "."), (None, None), ("-0", "0.50,0.5,0e0"), ("1", "0.3333333333333333333333333333333333333333333,0.3333333333333333333333333333333333333333333,0.3333333333333333333333333333333333333333334"), ("1", "0.33333333333333333333,0.33333333333333333333,0.33333333333333333333")]
    found = spark.createDataFrame(rows, "d string, p string").select(exact.text(dosage.ds(F.col("d"))).alias("d"), F.transform(dosage.gp(F.col("p")), exact.text).alias("p")).collect()
    assert [r["d"] for r in found] == ["0.125", "2", None, None, None, None, "-0", "1", "1"]
    assert [r["p"] for r in found] == [["0.2", "0.3", "0.5"], ["0", "0", "1"], None, None, None, None, ["0.50", "0.5", "0"], ["0." + "3" * 43, "0." + "3" * 43, "0." + "3" * 42 + "4"], None]


def test_expected_contributions(spark):
    rows = [(["0.2"], "additive", True, "0.125", None), (["-0.5"], "additive", False, "1.25", None), (["0.2"], "additive", True, None, "0.2,0.3,0.5"), (["-0.5"], "additive", False, None, "0.5,0.3,0.2"), (["1"], "dominant", True, "1", None), (["3"], "recessive", True, None, "0.2,0.3,0.5"), (["1", "2", "4"], "dosage_weights", True, None, "0.2,0.3,0.5")]
    table = spark.createDataFrame(rows, "w array<string>, m string, a boolean, d string, p string")
    own = table.select(dosage.expected(F.transform("w", exact.parse), "m", "a", dosage.ds(F.col("d")), dosage.gp(F.col("p"))).alias("x"))
    own = spark.createDataFrame([(r["x"],) for r in own.collect()], "x struct<neg:boolean,digits:string,exp:int>")
    assert [r["x"] for r in own.select(exact.text(F.col("x")).alias("x")).collect()] == ["0.0250", "-0.375", "0.26", "-0.65", None, "1.5", "2.8"]


@pytest.mark.parametrize("seed", range(40))
def test_normalised_variants_make_the_same_sequence(seed):
    rng = random.Random(seed)
    reference = "".join(rng.choice("AC") for _ in range(40))
    start, n = rng.randint(2, 30), rng.randint(1, 4)
    ref = reference[start - 1 : start - 1 + n]
    alt = ref[0] + "".join(rng.choice("AC") for _ in range(rng.randint(0, 4)))
    if ref == alt:
        return
    make = lambda p, r, a: reference[: p - 1] + a + reference[p - 1 + len(r) :]
    found = dosage.normalise(start, ref, alt, lambda q: reference[q - 1])
    if found is None:  # it could go on beyond the first base
        return
    pos, r, a = found
    assert make(pos, r, a) == make(start, ref, alt) and reference[pos - 1 : pos - 1 + len(r)] == r and r and a
    assert len(r) == 1 or len(a) == 1 or r[0] != a[0] or r[-1] != a[-1]
    if len(r) != len(a) and pos > 1:  # no form further to the left makes the same sequence with as few bases
        assert all(make(q, reference[q - 1 : q - 1 + len(r)], x) != make(pos, r, a) or q >= pos for q in range(1, pos) for x in ([reference[q - 1] + s for s in _strings(len(a) - 1)] if len(a) < 4 else []))


def _strings(n):
    return [""] if n == 0 else [x + y for x in "AC" for y in _strings(n - 1)]


def test_variants_without_a_normal_form():
    base = lambda p: "GCATTTTGAC"[p - 1]
    for pos, ref, alt in ((1, "AC", "C"), (5, "AC", "AC"), (5, "N", "A"), (5, "", "A"), (5, "a", "A")):
        assert dosage.normalise(pos, ref, alt, base) is None
    assert dosage.normalise(6, "TT", "T", base) == (3, "AT", "A") and dosage.normalise(4, "TTT", "TTG", base) == (6, "T", "G")


def test_normalised_column(spark):
    rows = [(5, "AA", "A", "CAAA"), (3, "G", "GT", "AC"), (2, "A", "AA", "")]
    found = spark.createDataFrame(rows, "pos int, ref string, alt string, left string").select(dosage.normalised("pos", "ref", "alt", "left").alias("x")).collect()
    assert [tuple(r["x"]) if r["x"]["pos"] else None for r in found] == [(1, "CA", "C"), (3, "G", "GT"), None]


def test_waivers(spark):
    rows = [(["variant_description_requires_review"], True, False), (["variant_description_requires_review", "invalid_weight"], True, False), (["author_other_allele_missing"], False, True), (["author_other_allele_missing", "invalid_weight"], False, True), ([], False, False)]
    table = spark.createDataFrame(rows, "reasons array<string>, informational boolean, inferred boolean")
    review = lambda **o: [r["review"] for r in dosage.waived(table, **o).collect()]
    assert review() == [True, True, True, True, False]
    assert review(informational=True) == [False, True, True, True, False]
    assert review(inferred_alleles=True) == [True, True, False, True, False]
