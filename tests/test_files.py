"""From files to scores: a scoring file, a reference and a VCF, against states and sums worked out by hand."""

import pytest

from dosewright.operators import compiled, extract
from dosewright.sources import binary, text

BASES = "ACGTTGCAACNNACGTTGCA" + "ACGTTGCAAC" * 4
VARIANT, BLOCK = "GT:GQ:DP", "GT:GQ:MIN_DP"


def record(pos, ref, alt, sample, form=VARIANT, end=None, filters="PASS", contig="chr1"):
    return f"{contig}\t{pos}\t.\t{ref}\t{alt}\t50\t{filters}\t{f'END={end}' if end else '.'}\t{form}\t{sample}"


RECORDS = [
    record(1, "A", "<*>", "0/0:50:30", BLOCK, 3),
    record(4, "T", "C", "0/1:40:30"),
    record(5, "T", "G", "1/1:40:30"),
    record(6, "G", "A", "0/0:40:30", filters="RefCall"),
    record(7, "C", "T", "0/1:40:30:LowGQ", VARIANT + ":FT"),
    record(8, "A", "G", "0/1:15:30"),
    record(9, "A", "G", "./.:40:30"),
    record(10, "C", "T", "./1:40:30"),
    record(13, "A", "G", "1:40:30"),
    record(14, "C", "T", "0/1:40:30", filters="LowQual"),
    record(15, "G", "<*>", "0/0:50", "GT:GQ", 15),
    record(16, "T", "C,G", "0/1:40:30"),
    record(17, "T", "G,C", "0/2:40:30"),
    record(18, "GC", "G", "0/1:40:30"),
    record(20, "AA", "A", "0/1:40:30"),
    record(21, "A", "<*>", "0/0:50:30", BLOCK, 22),
    record(23, "T", "<*>", "0/0:50:30", BLOCK, 23),
    record(24, "T", "G", "0|1:40:30"),
    record(26, "G", "<*>", "0/1:50:30", BLOCK, 26),
    record(27, "C", "<*>", "0/0:.:30", BLOCK, 27),
    record(28, "A", "G", "0/1:40:30", filters="."),
    record(5, "A", "G", "0/1:40:30", contig="chrUn_test"),
]
#: position, ALT of the term and the state it gets.
STATES = {
    1: ("G", "observed_reference"), 2: ("T", "observed_reference"), 3: ("A", "observed_reference"), 4: ("C", "observed_variant"), 5: ("G", "observed_variant"),
    6: ("A", "observed_reference"), 7: ("T", "genotype_filtered"), 8: ("G", "low_quality"), 9: ("G", "no_call"), 10: ("T", "partial_no_call"), 13: ("G", "unsupported_ploidy"),
    14: ("T", "filtered"), 15: ("A", "quality_missing"), 16: ("G", "other_called_allele"), 17: ("C", "observed_variant"), 18: ("A", "unsupported_allele_representation"),
    21: ("G", "ambiguous_overlapping_records"), 22: ("T", "observed_reference"), 23: ("A", "reference_anchor_mismatch"), 24: ("G", "observed_variant"), 25: ("G", "unknown_no_record"),
    26: ("A", "unsupported_symbolic_genotype"), 27: ("T", "quality_missing"), 28: ("G", "observed_variant"),
}


def written(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder / name)


@pytest.fixture(scope="module")
def chunks(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("reference")
    return stored(binary.fasta_chunks(spark, written(folder, "r.fa", [">chr1", *(BASES[k : k + 20] for k in range(0, 60, 20)), ">chrX", "GATTACAGATGATTACAGAT", "GATTACAGAT"])), folder, "chunks")


def stored(table, folder, name):
    """A step's table as a later step meets it: written and read again."""
    table.write.mode("overwrite").parquet(str(folder / name))
    return table.sparkSession.read.parquet(str(folder / name))


def vcf(spark, folder, records, samples="S"):
    head = ["##fileformat=VCFv4.2", "##contig=<ID=chr1,length=60>", '##FILTER=<ID=RefCall,Description="x">', f"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{samples}"]
    return text.rule_records(text.vcf_records(spark, written(folder, "a.vcf", head + records)))


def scoring(spark, folder, rows, header=("#pgs_id=MINE",), columns="chr_name\tchr_position\teffect_allele\tother_allele\teffect_weight"):
    return stored(text.scoring_terms(spark, written(folder, "s.tsv", [*header, columns, *rows])), folder, "described")


def test_states_and_score(spark, tmp_path, chunks):
    terms = scoring(spark, tmp_path, [f"chr1\t{p}\t{alt}\t{BASES[p - 1]}\t0.50" for p, (alt, _) in STATES.items()])
    done = stored(compiled.compile_terms(terms, chunks), tmp_path, "terms")
    assert {r["status"] for r in done.collect()} == {"resolved"}
    found = stored(extract.extract(compiled.targets(done), vcf(spark, tmp_path, RECORDS), chunks), tmp_path, "calls")
    assert {r["pos"]: r["state"] for r in found.collect()} == {p: s for p, (_, s) in STATES.items()}
    (out,) = extract.score_calls(done, found).collect()
    assert (out["terms"], out["scorable"], out["partial_score"], out["complete_score"]) == (24, 10, "3.00", None)


def test_indels(spark, tmp_path, chunks):
    """Terms of several bases are read by the reference or a public pair, and records are compared in normal form."""
    terms = scoring(spark, tmp_path, ["1\t33\tG\tGT\t.5", "1\t43\tGT\tG\t.25", "1\t51\tA\tACG\t2", "1\t56\tGA\tG\t1.5", "1\t36\tG\tGC\t3"])
    records = [record(a, BASES[a - 1], "<*>", "0/0:50:30", BLOCK, b) for a, b in ((31, 32), (35, 42), (46, 50), (51, 52), (53, 55), (56, 60))]
    records += [record(33, "GT", "G", "0/1:40:30"), record(43, "GTT", "GT", "0/1:40:30")]
    public = text.public_variants(spark, written(tmp_path, "p.tsv", ["#CHROM\tPOS\tREF\tALT", "1\t33\tGT\tG", "1\t43\tGT\tG", "1\t51\tACG\tA"]))
    done = stored(compiled.compile_terms(terms, chunks, public), tmp_path, "terms")
    assert {r["pos"]: r["inf_kind"] for r in done.collect()} == {33: "public_sequence_pair", 43: "public_sequence_pair", 51: "public_sequence_pair", 56: "reference_fit_sequence", 36: None}
    found = stored(extract.extract(compiled.targets(done), vcf(spark, tmp_path, records), chunks), tmp_path, "calls")
    assert {r["pos"]: (r["state"], r["alt_dosage"]) for r in found.collect()} == {33: ("observed_variant", 1), 43: ("observed_variant", 1), 51: ("observed_reference", 0), 56: ("observed_reference", 0)}
    (out,) = extract.score_calls(done, found, {"indels": True}).collect()
    assert (out["terms"], out["scorable"], out["partial_score"]) == (5, 4, "0.75")
    (out,) = extract.score_calls(done, found).collect()
    assert (out["scorable"], out["partial_score"]) == (0, "0")


@pytest.mark.parametrize(("field", "want"), [("gt", "-0.6"), ("ds", "-0.3500"), ("gp", "-0.39")])
def test_measurements(spark, tmp_path, chunks, field, want):
    form = "GT:GQ:DP:DS:GP"
    records = [record(2, "C", "T", "1/1:40:30:0.125:0.2,0.3,0.5", form), record(3, "G", "T", "0/0:40:30:1.25:0.5,0.3,0.2", form)]
    terms = scoring(spark, tmp_path, ["1\t2\tT\tC\t0.2", "1\t3\tG\tT\t-0.5"])
    done = stored(compiled.compile_terms(terms, chunks), tmp_path, "terms")
    found = stored(extract.extract(compiled.targets(done), vcf(spark, tmp_path, records), chunks, field=field), tmp_path, "calls")
    (out,) = extract.score_calls(done, found).collect()
    assert (out["scorable"], out["partial_score"]) == (2, want)


def test_inferred_other_alleles(spark, tmp_path, chunks):
    terms = scoring(spark, tmp_path, [f"1\t{p}\t{e}\t\t1" for p, e in ((1, "G"), (2, "T"), (3, "A"), (4, "C"))])
    done = stored(compiled.compile_terms(terms, chunks), tmp_path, "terms")
    assert {r["inf_kind"] for r in done.collect()} == {"reference_anchored"} and all(r["reasons"] == ["author_other_allele_missing"] for r in done.collect())
    found = stored(extract.extract(compiled.targets(done), vcf(spark, tmp_path, RECORDS[:2]), chunks), tmp_path, "calls")
    (out,) = extract.score_calls(done, found, {"alleles": True}).collect()
    assert (out["scorable"], out["complete_score"]) == (4, "1")
    (out,) = extract.score_calls(done, found).collect()
    assert out["scorable"] == 0


def test_reasons(spark, tmp_path):
    columns = "chr_name\tchr_position\teffect_allele\tother_allele\teffect_weight\tvariant_description\tis_haplotype\tinclusion_criteria"
    rows = ["1\t4\tC\tT\t1\tPIP=0.5;a1=x\t\t", "1\t4\tC\tT\t1\tPIP=;N=3\t\t", "1\t4\tC\tT\t1\tweight_type=beta;centre=1.5\tNA\t", "1\t4\tC\tT\t1\tproxy SNP: rs12\t\t", "1\t4\tC\tT\t1\tFinnGen_VariantID=chr1_4_T_C\t\t", "1\t4\tC\tT\t1\t\tTRUE\tyes", "01\t4\tC\tT\t1\tHomozygote correction\tmaybe\t"]
    own = scoring(spark, tmp_path, rows, ("#pgs_id=MINE", "#weight_type=beta"), columns).orderBy("ordinal").collect()
    noted = "variant_description_requires_review"
    assert [(r["reasons"], r["informational"]) for r in own] == [([noted], True), ([noted], False), ([], False), ([noted], True), ([], False), (["conditional_inclusion_requires_review", "requires_special_model:is_haplotype"], False), (["invalid_model_flag:is_haplotype", "unresolved_harmonized_position", noted], False)]
    with pytest.raises(Exception, match="centred weight"):
        scoring(spark, tmp_path, rows[2:3], ("#pgs_id=MINE", "#weight_type=OR"), columns).collect()


def test_files_that_are_refused(spark, tmp_path, chunks):
    for bad in (record(4, "T", "C", "0/2:40:30"), record(4, "T", "C", "0/1:40:30", "GT:GQ:GQ"), record(4, "T", "C", "0/1:40:30").replace("\t.\tGT", "\tEND=\tGT")):
        with pytest.raises(Exception, match="GT names|FORMAT key|END without"):
            vcf(spark, tmp_path, [bad]).collect()
    (tmp_path / "x.vcf").write_text("##contig=<ID=chr1,length=61>\n#CHROM\tPOS\n")
    facts = text.header_facts(spark, str(tmp_path / "x.vcf"))
    with pytest.raises(Exception, match="another assembly"):
        text.check_assembly(facts, binary.contig_lengths(chunks)).collect()
