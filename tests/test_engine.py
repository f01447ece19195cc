"""The scoring engine against Python decimals, hand calculation and small files."""

import gzip
import random
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from dosewright.functions import exact
from dosewright.operators import calls, compare, enrich, intervals, score, sinks, terms
from dosewright.plans import bridge
from dosewright.sources import binary, text
from dosewright.streaming import incremental

TEXTS = ["0", "-0", "0.00", "-0.50", "1e2", "1.5", "-2.25E-3", "0.0000001", "123456789012345678901234567890.5", "+.5", "5.", "1E+100", "1e-1000", "00012.30", "-0E-23"]


def exact_rows(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("x", exact.parse(F.col("t")))


def test_text_is_that_of_decimal(spark):
    rows = exact_rows(spark, TEXTS).select("t", exact.text(F.col("x")).alias("s"), exact.plain(F.col("x")).alias("p")).collect()
    for r in rows:
        assert r["s"] == str(Decimal(r["t"])), r["t"]
        assert r["p"] == format(Decimal(r["t"]), "f"), r["t"]


def test_parse_rejects(spark):
    bad = ["", " 1", "NaN", "1_0", "1e", ".", "1.2.3", "1e101", "1e-1001", "9" * 129, "e5", "--1"]
    assert exact_rows(spark, bad).where("x is not null").count() == 0


def test_exact_sums(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for k in range(40):
        own = [f"{'-' if rng.random() < 0.5 else ''}{rng.randint(0, 10 ** rng.randint(1, 40))}E{rng.randint(-60, 5)}" for _ in range(rng.randint(1, 8))]
        times = [rng.randint(0, 2) for _ in own]
        rows += [(k, t, n) for t, n in zip(own, times, strict=True)]
        with localcontext() as c:
            c.prec = 400
            low = min(0, *(Decimal(t).as_tuple().exponent for t in own))
            total = sum((Decimal(t) * n for t, n in zip(own, times, strict=True)), Decimal(0))
            want[k] = str((abs(total) if total == 0 else total).quantize(Decimal(1).scaleb(low)))
    rows.append((99, None, 1))
    table = spark.createDataFrame(rows, "k int, t string, n int")
    for parts in (1, 7):
        found = exact.exact_sum(table.repartition(parts), ["k"], exact.parse(F.col("t")), F.col("n")).select("k", exact.text(F.col("total")).alias("s")).collect()
        assert {r["k"]: r["s"] for r in found} == want | {99: "0"}


def test_order_of_values(spark):
    own = [t for t in TEXTS if Decimal(t) != 0]
    found = [r["t"] for r in exact_rows(spark, own).orderBy(exact.value_key(F.col("x"))).collect()]
    assert [Decimal(t) for t in found] == sorted(map(Decimal, own))


def test_algebra(spark):
    row = exact_rows(spark, ["0.25"]).select(exact.text(exact.one_minus("x")).alias("m"), exact.text(exact.product("x", "x")).alias("p"), exact.text(exact.difference("x", exact.from_int(F.lit(3), 0))).alias("d")).first()
    assert tuple(row) == ("0.75", "0.0625", "-2.75")


@pytest.mark.parametrize("width", [7, 64, 5000])
def test_range_join(spark, width):
    rng = random.Random(2)
    points = [(k, k % 2, p := rng.randint(1, 3000), p + rng.randint(0, 4)) for k in range(200)]
    spans = [(k, k % 2, s := rng.randint(1, 3000), s + rng.choice([0, 3, 50, 2500])) for k in range(200)]
    found = intervals.range_join(spark.createDataFrame(points, "i int, c int, a int, b int"), spark.createDataFrame(spans, "j int, c int, s int, e int"), ["c"], ("a", "b"), ("s", "e"), width)
    want = sorted((i, j) for i, c, a, b in points for j, d, s, e in spans if c == d and s <= b and e >= a)
    assert sorted((r["i"], r["j"]) for r in found.collect()) == want


def test_contigs_and_positions(spark):
    names = ["1", "chr22", "X", "chrY", "MT", "chrM", "01", "+1", "chrchr1", "23", "", None]
    table = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in table.select(terms.contig_code(F.col("n"))).collect()] == [1, 22, 23, 24, 25, 25] + [None] * 6
    table = spark.createDataFrame([(n,) for n in ("1", "2147483647", "2147483648", "01", "0", "12345678901", "x")], "n string")
    assert [r[0] for r in table.select(terms.position(F.col("n"))).collect()] == [1, 2147483647] + [None] * 5


def rule(spark, record=None, more=(), **options):
    base = {"pos": 5, "end_": 5, "ref": "A", "alts": ["G"], "filters": ["PASS"], "gt": [0, 1], "ft": None, "depth": 30.0, "quality": 40.0, "anchor_ok": True}
    shape = "struct<pos:int,end_:int,ref:string,alts:array<string>,filters:array<string>,gt:array<int>,ft:string,depth:double,quality:double,anchor_ok:boolean>"
    records = [] if record is None else [base | record, *(base | m for m in more)]
    row = (options.pop("contig", 1), 5, "A", "G", options.pop("reference_ok", True), [tuple(r.values()) for r in records])
    table = spark.createDataFrame([row], f"contig int, pos int, ref string, alt string, reference_ok boolean, records array<{shape}>")
    out = calls.classify(table, **options).first()
    return out["state"], out["alt_dosage"]


BLOCK = {"alts": ["<*>"], "gt": [0, 0], "end_": 9}


@pytest.mark.parametrize(
    ("record", "want"),
    [
        (None, ("unknown_no_record", None)),
        ({}, ("observed_variant", 1)),
        ({"gt": [1, 1]}, ("observed_variant", 2)),
        ({"gt": [0, 0]}, ("observed_reference", 0)),
        ({"gt": [0, 0], "filters": ["RefCall"]}, ("observed_reference", 0)),
        ({"filters": ["LowQual"]}, ("filtered", None)),
        ({"filters": ["."]}, ("observed_variant", 1)),
        ({"ft": "LowGQ"}, ("genotype_filtered", None)),
        ({"quality": 15.0}, ("low_quality", None)),
        ({"depth": 9.0}, ("low_quality", None)),
        ({"quality": None}, ("quality_missing", None)),
        ({"gt": [None, None]}, ("no_call", None)),
        ({"gt": [None, 1]}, ("partial_no_call", None)),
        ({"gt": [1]}, ("unsupported_ploidy", None)),
        ({"alts": ["C", "G"], "gt": [0, 1]}, ("other_called_allele", None)),
        ({"alts": ["C", "G"], "gt": [0, 2]}, ("observed_variant", 1)),
        ({"ref": "AC"}, ("unsupported_allele_representation", None)),
        ({"gt": None}, ("unsupported_ploidy", None)),
        ({"gt": []}, ("unsupported_ploidy", None)),
        ({"filters": None}, ("filtered", None)),
        ({"alts": ["G"], "gt": [0, 3]}, ("other_called_allele", None)),
        (BLOCK, ("observed_reference", 0)),
        (BLOCK | {"anchor_ok": False}, ("reference_anchor_mismatch", None)),
        (BLOCK | {"gt": [0, 1]}, ("unsupported_symbolic_genotype", None)),
        (BLOCK | {"end_": 4, "pos": 1}, ("incomplete_reference_span", None)),
    ],
)
def test_genotype_rules(spark, record, want):
    assert rule(spark, record) == want


def test_genotype_options(spark):
    assert rule(spark, {}, more=[{}]) == ("ambiguous_overlapping_records", None)
    assert rule(spark, {}, reference_ok=False) == ("reference_mismatch", None)
    assert rule(spark, {"gt": [1]}, contig=23, haploid_as_diploid=True) == ("observed_variant", 2)
    assert rule(spark, {"quality": None, "depth": None}, accept_missing_quality=True) == ("observed_variant", 1)


def make_terms(spark, rows):
    """rows: (ordinal, effect_is_alt, model, [weights])."""
    table = spark.createDataFrame([("P", n, 1, n, "A", "G", e, m, w, False, True) for n, e, m, w in rows], "pgs_id string, ordinal int, contig int, pos int, ref string, alt string, effect_is_alt boolean, model string, w array<string>, review boolean, resolved boolean")
    return table.withColumn("weights", F.transform("w", exact.parse)).drop("w")


def make_calls(spark, dosages):
    rows = [(1, n, "A", "G", 7, "observed_variant" if d else "observed_reference" if d == 0 else "no_call", d) for n, d in dosages.items()]
    return spark.createDataFrame(rows, "contig int, pos int, ref string, alt string, sample long, state string, alt_dosage int")


def test_models(spark):
    rows = [(1, True, "additive", ["0.50"]), (2, False, "additive", ["-1"]), (3, True, "dominant", ["3"]), (4, True, "recessive", ["-1.0"]), (5, True, "dosage_weights", ["-3", "7", "1.25"])]
    own = score.outcomes(make_terms(spark, rows), make_calls(spark, {1: 2, 2: 0, 3: 1, 4: 1, 5: 2}))
    (out,) = score.scores(own).collect()
    assert out["partial_score"] == out["complete_score"] == "3.25" and out["scorable"] == 5


def test_missing_terms(spark):
    rows = [(1, True, "additive", ["-2"]), (2, True, "additive", ["5"]), (3, True, "dominant", ["3"]), (4, True, "recessive", ["-1"]), (5, True, "additive", ["1"])]
    made = make_terms(spark, rows)
    own = score.outcomes(made, make_calls(spark, {1: None, 2: None, 3: None, 4: None, 5: 1}))
    (out,) = score.scores(own).collect()
    assert out["partial_score"] == "1" and out["complete_score"] is None
    bounded = enrich.missing(own, enrich.bounds(made))
    enveloped = enrich.envelope(bounded, ["pgs_id", "sample"])
    (env,) = enveloped.select(exact.text(F.col("lower")).alias("lower"), exact.text(F.col("upper")).alias("upper"), "missing", "unbounded").collect()
    assert tuple(env) == ("-5", "13", 4, 0)
    (whole,) = enrich.completion(enveloped, score.scores(own), ["pgs_id", "sample"]).collect()
    assert (whole["complete_lower"], whole["complete_upper"]) == ("-4", "14")
    assert [r["ordinal"] for r in enrich.ranked(bounded, ["pgs_id", "sample"]).orderBy("rank").collect()] == [2, 1, 3, 4]


def test_bounds_of_mixed_exponents(spark):
    """Weights of other exponents and of many digits: exact sums, and the greater size ranks first."""
    long = "0." + "1" * 60
    rows = [(1, True, "additive", ["5"]), (2, True, "additive", ["0.500"]), (3, True, "dosage_weights", ["3", "7", "1e1"]), (4, True, "dominant", [long]), (5, True, "recessive", ["-7E-3"])]
    made = make_terms(spark, rows)
    own = enrich.missing(score.outcomes(made, make_calls(spark, dict.fromkeys(range(1, 6)))), enrich.bounds(made))
    (env,) = enrich.envelope(own, ["pgs_id", "sample"]).select(exact.text(F.col("lower")).alias("lower"), exact.text(F.col("upper")).alias("upper")).collect()
    with localcontext() as c:
        c.prec = 200
        assert Decimal(env["lower"]) == Decimal("2.993") and Decimal(env["upper"]) == Decimal("21.000") + Decimal(long)
    assert [r["ordinal"] for r in enrich.ranked(own, ["pgs_id", "sample"]).orderBy("rank").collect()] == [1, 3, 2, 4, 5]


def odd_terms(spark):
    """Two scores of every model with short, long, zero and invalid weights, terms for review and without orientation; calls of every kind for four samples."""
    rng = random.Random(5)
    texts = ["0", "-0.00", "1.5", "-2.25E-3", "7E+2", "5E-30", "-" + "9" * 40, "0." + "5" * 61, "12345678901234567.8", None]
    terms_, calls_ = [], []
    for n in range(1, 81):
        model = rng.choice(["additive", "dominant", "recessive", "dosage_weights"])
        terms_.append((rng.choice("PPPQ"), n, 1, n // 2, "A", "G", rng.random() < 0.5, model, [rng.choice(texts) for _ in range(3 if model == "dosage_weights" else 1)][: rng.choice([2, 3, 3, 3, 3])], n % 13 == 0, n % 11 != 0))
    for at in range(0, 41):
        for sample in range(4):
            state = rng.choice(["observed_variant", "observed_reference", "observed_variant", "unsupported_ploidy", "low_quality", "missing_reason_not_retained", None])
            if state and sample < 3:
                calls_.append((1, at, "A", "G", sample, state, rng.choice([1, 2]) if state == "observed_variant" else 0 if state == "observed_reference" else None))
    made = spark.createDataFrame(terms_, "pgs_id string, ordinal int, contig int, pos int, ref string, alt string, effect_is_alt boolean, model string, w array<string>, review boolean, resolved boolean")
    found = spark.createDataFrame(calls_, "contig int, pos int, ref string, alt string, sample long, state string, alt_dosage int")
    return made.withColumn("weights", F.transform("w", exact.parse)).drop("w"), found, spark.createDataFrame([(k,) for k in range(4)], "sample long")


def test_sparse_missing_terms(spark):
    """Without a row for each term and sample: as from all of them, whether the first terms suffice or not."""
    made, found, samples = odd_terms(spark)
    own, keys = enrich.bounds(made).cache(), ["pgs_id", "sample"]
    rows = enrich.missing(score.outcomes(made, found, samples, score.ABSENT), own)
    text = lambda out: sorted(map(tuple, out.select(*keys, exact.text(F.col("lower")), exact.text(F.col("upper")), "missing", "unbounded").collect()))
    want = text(enrich.envelope(rows, keys))
    assert len(want) == 8 and text(enrich.sparse_envelope(own, found, samples)) == want
    cols = [*keys, "ordinal", "status", "rank"]
    want = sorted(map(tuple, enrich.ranked(rows, keys, 5).select(*cols).collect()))
    assert 30 < len(want) < 40  # some pairs miss less than five
    for head in (2, 8, 1000):
        out = enrich.sparse_ranked(own, lambda at: found.join(at, score.SITE, "left_semi"), samples, lambda df, name: df.cache(), score.ABSENT, 5, head)
        assert sorted(map(tuple, out.select(*cols).collect())) == want


def test_bounds_of_odd_terms(spark):
    """Bounds by expressions against whole numbers of Python."""
    made, _, _ = odd_terms(spark)
    number = lambda x: x and Decimal(f"{'-' if x['neg'] else ''}{x['digits']}E{x['exp']}")
    for most, single in ((2, F.lit(False)), (1, F.col("ordinal") % 2 == 0), (2, F.col("ordinal") % 2 == 0)):
        for r in enrich.bounds(made, single, most).collect():
            ws = [*map(number, r["weights"]), None, None, None]
            doses = [0, most] if r["ordinal"] % 2 == 0 and str(single) != str(F.lit(False)) else [0, 1, 2]
            with localcontext() as c:
                c.prec = 200
                if r["model"] == "dosage_weights":
                    values = [ws[d] for d in doses]
                else:
                    values = [None if ws[0] is None else ws[0] * {"additive": d, "dominant": d > 0, "recessive": d == 2}[r["model"]] for d in doses]
                want = None if None in values else (min(values), max(values), max(map(abs, values)) if r["model"] != "dosage_weights" else max(abs(min(values)), abs(max(values))))
                found = tuple(number(r[c]) for c in ("lower", "upper", "impact"))
            assert found == (want or (None, None, None)) and (r["unbounded"] is None) == (want is not None), r
            assert all(r[c] is None or r[c]["digits"] != "0" or not r[c]["neg"] for c in ("lower", "upper", "impact"))


@pytest.mark.parametrize("name", ["missing_envelope", "missing_top_terms"])
def test_missing_terms_send_no_row_for_each_term_and_sample(spark, name):
    """No more rows are shuffled than there are pairs of terms and samples; before, those alone went through three shuffles."""
    data, sc = "/root/testdata/sf0.01", spark.sparkContext
    pairs = bridge.terms(spark, data).count() * bridge.samples(spark, data).count()
    sc.setJobGroup(f"sent-{name}", name)
    __spark_entry__.queries()[name](spark, data).write.format("noop").mode("overwrite").save()
    sc.setJobGroup("", "")
    tracker, store = sc.statusTracker(), sc._jsc.sc().statusStore()
    stages = {k for job in tracker.getJobIdsForGroup(f"sent-{name}") for k in tracker.getJobInfo(job).stageIds}
    sent = sum(store.lastStageAttempt(k).shuffleWriteRecords() for k in stages)
    assert 0 < sent < pairs


def test_every_term_counts_for_every_sample(spark):
    """One term called, one without a call, one without an orientation: none vanishes."""
    made = make_terms(spark, [(1, True, "additive", ["0.5"]), (2, True, "additive", ["0.25"]), (3, True, "additive", ["1"])])
    made = made.withColumns({c: F.when(F.col("ordinal") != 3, F.col(c)) for c in ("ref", "alt")}).withColumn("resolved", F.col("ordinal") != 3)
    found = make_calls(spark, {1: 1})
    (out,) = score.cohort(made, found, absent=score.ABSENT).collect()
    assert (out["terms"], out["scorable"], out["partial_score"], out["complete_score"]) == (3, 1, "0.5", None)
    assert abs(out["weight_coverage"] - 0.5 / 1.75) < 1e-12 and not out["covered"]
    assert {r["status"]: r["n"] for r in score.states(made, found, absent=score.ABSENT).collect()} == {"scorable_observation": 1, "unknown_no_record": 1, "unresolved_orientation": 1}
    assert {r["ordinal"]: r["status"] for r in score.outcomes(made, found, absent=score.ABSENT).collect()} == {1: "scorable_observation", 2: "unknown_no_record", 3: "unresolved_orientation"}
    for f in (lambda: score.cohort(made, found), lambda: score.states(made, found), lambda: score.outcomes(made, found)):
        with pytest.raises(Exception, match="no call"):
            f().collect()
    both = found.unionByName(make_calls(spark, {2: 2}))
    (out,) = score.cohort(made, both).collect()
    assert (out["terms"], out["scorable"], out["partial_score"]) == (3, 2, "1.00")


def test_hemizygous(spark):
    own = make_terms(spark, [(1, True, "additive", ["2"]), (2, True, "additive", ["3"])]).withColumn("contig", F.lit(23))
    called = make_calls(spark, {1: 2, 2: 1}).withColumn("contig", F.lit(23))
    out = {r["ordinal"]: (r["status"], r["times"]) for r in score.hemizygous(score.outcomes(own, called)).collect()}
    assert out == {1: ("scorable_observation", 1), 2: ("heterozygous_call_in_hemizygous_region", None)}


def test_fsum(spark):
    table = spark.createDataFrame([(1e16,), (1.0,), (-1e16,)], "x double")
    assert table.agg(enrich.fsum("x")).first()[0] == 1.0


def test_comparison(spark):
    left = spark.createDataFrame([("a", "P", "1.0"), ("b", "P", "2"), ("c", "P", "NA"), ("d", "P", "4")], "sample string, pgs_id string, s string").withColumnRenamed("s", "score")
    right = spark.createDataFrame([("a", "P", "1.00"), ("b", "P", "2.005"), ("c", "P", "3"), ("e", "P", "4")], "sample string, pgs_id string, s string").withColumnRenamed("s", "score")
    out = compare.compare_scores(left, right, "0.01")
    assert {r["sample"]: r["status"] for r in out.collect()} == {"a": "exact", "b": "within_tolerance", "c": "unavailable", "d": "left_only", "e": "right_only"}
    assert not compare.agrees(out).first()["agrees"]
    with pytest.raises(ValueError):
        compare.compare_scores(left, right, "-1")
    with pytest.raises(Exception, match="key found twice"):
        compare.compare_scores(left.unionAll(left), right).collect()


def test_comparison_is_exact(spark):
    """Differences far below a float's or a short decimal's reach count, and so does the tolerance's own boundary."""
    pairs = {"a": ("0.0000000000001", "0.0000000000002", "different"), "b": ("1e300", "1E+300", "exact"), "c": ("0.1", "0.11", "within_tolerance"), "d": ("0.1", "0.110000000000000000000000000001", "different"), "e": (None, "1", "unavailable"), "f": ("5", "5.0", "identity_mismatch")}
    shape = "sample string, pgs_id string, score string, fid string"
    left = spark.createDataFrame([(k, "P", a, "x") for k, (a, _, _) in pairs.items()], shape)
    right = spark.createDataFrame([(k, "P", b, "y" if k == "f" else None) for k, (_, b, _) in pairs.items()], shape)
    found = {r["sample"]: r for r in compare.compare_scores(left, right, "0.01" if False else "0", "0", identity=("fid",)).collect()}
    assert found["a"]["status"] == "different" and found["a"]["delta"] == "1e-13" and found["b"]["status"] == "exact" and found["f"]["status"] == "identity_mismatch"
    near = {r["sample"]: r["status"] for r in compare.compare_scores(left, right, "0.01", identity=("fid",)).collect()}
    assert {k: near[k] for k in "cde"} == {k: pairs[k][2] for k in "cde"}

def test_batches_do_not_depend_on_partitions(spark):
    own = spark.range(1, 5001).select(F.lit("P").alias("pgs_id"), F.col("id").alias("ordinal"))
    a, b = ({(r["batch"], r["n"], r["digest"]) for r in compare.batches(x, ["pgs_id"]).collect()} for x in (own.repartition(1), own.repartition(17)))
    assert a == b and {x[1] for x in a} == {2000, 1000}


VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2
chr1\t3\t.\tG\t<*>\t.\tPASS\tEND=4\tGT:GQ:MIN_DP\t0/0:50:30\t0/0:50
chr1\t5\t.\tA\tG\t50\tPASS\t.\tGT:GQ:DP\t0/1:40:30\t./.:1:2
chrUn\t5\t.\tA\tG\t50\tPASS\t.\tGT\t0/1\t0|1
"""
SCORE = """#pgs_id=MY_SCORE
#genome_build=GRCh38
chr_name\tchr_position\teffect_allele\tother_allele\teffect_weight\tis_dominant
chr1\t5\tG\tA\t0.50\tFALSE
1\t6\tG\t\t1e-3\tTRUE
1\t0\tG\tG\tx\tmaybe
"""


def test_sources(spark, tmp_path):
    with gzip.open(tmp_path / "a.vcf.gz", "wt") as f:
        f.write(VCF)
    rows = text.rule_records(text.vcf_records(spark, str(tmp_path / "a.vcf.gz"))).orderBy("record_ordinal", "sample").collect()
    assert [(r["record_ordinal"], r["sample"], r["contig"], r["end_"], r["gt"], r["depth"], r["quality"]) for r in rows[:4]] == [(1, "S1", 1, 4, [0, 0], 30.0, 50.0), (1, "S2", 1, 4, [0, 0], None, 50.0), (2, "S1", 1, 5, [0, 1], 30.0, 40.0), (2, "S2", 1, 5, [None, None], 2.0, 1.0)]
    assert len(rows) == 6 and text.vcf_records(spark, str(tmp_path / "a.vcf.gz"), "S2").count() == 3
    (tmp_path / "s.tsv").write_text(SCORE)
    own = text.scoring_terms(spark, str(tmp_path / "s.tsv")).orderBy("ordinal").collect()
    assert [(r["pgs_id"], r["contig"], r["pos"], r["model"], r["reasons"]) for r in own] == [
        ("MY_SCORE", 1, 5, "additive", []),
        ("MY_SCORE", 1, 6, "dominant", ["author_other_allele_missing"]),
        ("MY_SCORE", 1, None, "additive", ["identical_effect_other_alleles", "invalid_effect_weight", "invalid_model_flag:is_dominant", "unresolved_harmonized_position"]),
    ]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:  # lines keep their numbers when a file is read in many splits
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        (tmp_path / "long.txt").write_text("".join(f"line {k} {'x' * (k % 37)}\n" for k in range(1, 1001)))
        rows = text.numbered_lines(spark, str(tmp_path / "long.txt"), "line NOT LIKE 'line 7 %'")
        assert rows.rdd.getNumPartitions() > 3
        found = {r["n"]: r["line"].split()[1] for r in rows.collect()}
        assert [found[n] for n in range(1, 1000)] == [str(k) for k in range(1, 1001) if k != 7]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "r.fa").write_text(">chr1 x\nACGTTGCAAC\nNNacgttgca\nACG\n>chrX\nGATTACA\n")
    chunks = binary.fasta_chunks(spark, str(tmp_path / "r.fa"), 8, 3)
    want = "ACGTTGCAACNNACGTTGCAACG"
    points = spark.createDataFrame([(1, p) for p in range(1, 25)] + [(23, 7)], "contig int, pos int")
    found = {(r["contig"], r["pos"]): r["base"] for r in binary.with_bases(points, chunks, width=8).collect()}
    assert found == {(1, p): want[p - 1] if p <= len(want) else None for p in range(1, 25)} | {(23, 7): "A"}
    (tmp_path / "x.bed").write_text("chr1\t0\t10\tone\nchr2\t5\t6\n")
    assert sorted(map(tuple, text.regions(spark, str(tmp_path / "x.bed")).collect())) == [("one", 1, 0, 10), ("x", 2, 5, 6)]
    (tmp_path / "g.tsv").write_text("sample\tpop\nS1\t EUR \nS2\tAFR\n")
    assert sorted(map(tuple, text.groups(spark, str(tmp_path / "g.tsv"), "pop").collect())) == [("S1", "EUR"), ("S2", "AFR")]
    (tmp_path / "f.vcf").write_text("#h\n1\t5\t.\tA\tG\t.\t.\tAF=0.25;MULTI_ALLELIC\n1\t6\t.\tA\tG\t.\t.\tAF\n")
    rows = text.frequency_records(spark, str(tmp_path / "f.vcf"), "AF").orderBy("src_ord").collect()
    assert [(r["pos"], r["freq_text"], r["multiallelic"]) for r in rows] == [(5, "0.25", True), (6, None, False)]
    (tmp_path / "p.sscore").write_text("#FID IID A_SUM NAMED_ALLELE_DOSAGE_SUM B_SUM\n0 S1 1.5 3 NA\n")
    assert sorted((r["pgs_id"], r["score"]) for r in text.score_table(spark, str(tmp_path / "p.sscore"), "plink").collect()) == [("A", "1.5"), ("B", "NA")]


def test_plink(spark, tmp_path):
    (tmp_path / "p.fam").write_text("".join(f"f s{k} 0 0 0 -9\n" for k in range(5)))
    (tmp_path / "p.bim").write_text("1\tv1\t0\t5\tG\tA\nX\tv2\t0\t9\tC\tT\n")
    (tmp_path / "p.bed").write_bytes(b"\x6c\x1b\x01" + bytes([0b11100100, 0b00]) + bytes([0b00000000, 0b11]))
    found = {(r["line"], r["sample"]): r["dosage"] for r in binary.plink_dosages(spark, str(tmp_path / "p")).collect()}
    assert found == {(0, "s0"): 2, (0, "s1"): None, (0, "s2"): 1, (0, "s3"): 0, (0, "s4"): 2, (1, "s0"): 2, (1, "s1"): 2, (1, "s2"): 2, (1, "s3"): 2, (1, "s4"): 0}


def test_sample_sheet(spark, tmp_path):
    (tmp_path / "ok.tsv").write_text("sample_id\tinput\na\tx.vcf\nb\ty.vcf\n")
    assert [r["sample_id"] for r in text.sample_sheet(spark, str(tmp_path / "ok.tsv"))] == ["a", "b"]
    (tmp_path / "bad.tsv").write_text("sample_id\tinput\n../a\tx.vcf\n")
    with pytest.raises(ValueError):
        text.sample_sheet(spark, str(tmp_path / "bad.tsv"))


def test_streaming_equals_batch(spark, tmp_path):
    own = make_terms(spark, [(1, True, "additive", ["0.5"]), (2, True, "additive", ["1"])])
    called = make_calls(spark, {1: 2, 2: 1}).select(F.col("contig"), F.col("pos").cast("long").alias("pos"), "ref", "alt", "sample", "state", "alt_dosage")
    called.write.parquet(str(tmp_path / "in"))
    incremental.score_arriving(spark, str(tmp_path / "in"), own, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out")).select("sample", "partial_score").collect()
    assert [tuple(r) for r in found] == [(7, "2.0")]


def test_runs_are_resumed(spark, tmp_path):
    own = spark.range(3)
    path = str(tmp_path / "run")
    assert sinks.run_once(own, path, {"a": 1}).count() == 3
    assert sinks.run_once(spark.range(9), path, {"a": 1}).count() == 3
    assert sinks.run_once(spark.range(9), path, {"a": 2}).count() == 9


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
