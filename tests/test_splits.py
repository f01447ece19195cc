import pytest

from dosewright.operators import calls, splits

SHAPE = "struct<pos:int,end_:int,ref:string,alts:array<string>,filters:array<string>,gt:array<int>,ft:string,depth:double,quality:double,anchor_ok:boolean>"
BASE = {"pos": 5, "end_": 5, "ref": "A", "alts": ["G"], "filters": ["PASS"], "gt": [0, 1], "ft": None, "depth": 30.0, "quality": 40.0, "anchor_ok": True}


def read(spark, *records, sequence=False):
    rows = None if records == (None,) else [tuple((BASE | r).values()) for r in records]
    table = spark.createDataFrame([(1, 5, "A", "G", True, rows)], f"contig int, pos int, ref string, alt string, reference_ok boolean, records array<{SHAPE}>")
    out = splits.merged(table, sequence)
    assert out.schema == table.schema
    return out


def one(spark, *records, **options):
    (found,) = read(spark, *records, **options).first()["records"]
    return found


def test_alleles_are_put_together(spark):
    found = one(spark, {"gt": [0, 1]}, {"ref": "AC", "alts": ["T", "AG"], "gt": [2, 0], "quality": 21.0}, sequence=True)
    assert (found["ref"], found["alts"], found["gt"], found["end_"], found["quality"], found["depth"]) == ("AC", ["GC", "T", "AG"], [3, 1], 6, 21.0, 30.0)


@pytest.mark.parametrize(
    ("records", "want"),
    [
        ([{"gt": [0, 1]}, {"alts": ["C"], "gt": [0, 0]}], ("observed_variant", 1)),
        ([{"gt": [0, 1]}, {"alts": ["C"], "gt": [1, 0]}], ("other_called_allele", None)),
        ([{"gt": [0, 1]}, {"alts": ["C"], "gt": [0, 1]}], ("partial_no_call", None)),
        ([{"gt": [1, 1]}, {"gt": [1, 1]}], ("observed_variant", 2)),
        ([{"gt": [0, 1]}, {"alts": ["C"], "gt": [None, 0]}], ("partial_no_call", None)),
        ([{"gt": [0, 1]}, {"alts": ["C"], "gt": [0, 2]}], ("partial_no_call", None)),
        ([{"gt": [0, 1]}, {"alts": ["C"], "gt": [0, 0], "filters": ["LowQual"]}], ("filtered", None)),
        ([{"gt": [0, 1]}, {"alts": ["C"], "gt": [0, 0], "ft": "LowGQ"}], ("genotype_filtered", None)),
        ([{"gt": [0, 1]}, {"alts": ["C"], "gt": [0, 0], "quality": 15.0}], ("low_quality", None)),
        ([{"gt": [0, 1]}, {"alts": ["C"], "gt": [0, 0], "quality": None}], ("quality_missing", None)),
        ([{"gt": [0, 1]}, {"alts": ["AT", "ATT"], "gt": [1, 2]}], ("observed_variant", 1)),
        ([{"gt": [0, 1]}, {"pos": 4, "ref": "CA", "alts": ["C"], "end_": 5}], ("ambiguous_overlapping_records", None)),
        ([{"gt": [0, 1]}, {"alts": ["C"], "gt": [0]}], ("ambiguous_overlapping_records", None)),
        ([{"gt": [0, 1]}, {"alts": ["<DEL>"], "gt": [0, 0]}], ("ambiguous_overlapping_records", None)),
        ([{"gt": [0, 1]}, {"ref": "C", "alts": ["T"], "gt": [0, 0]}], ("ambiguous_overlapping_records", None)),
        ([{"gt": [0, 1]}, {"ref": None, "alts": ["T"], "gt": [0, 0]}], ("ambiguous_overlapping_records", None)),
        ([{"gt": [0, 1]}], ("observed_variant", 1)),
        ([], ("unknown_no_record", None)),
        ([None], ("unknown_no_record", None)),
    ],
)
def test_states(spark, records, want):
    out = calls.classify(read(spark, *records)).first()
    assert (out["state"], out["alt_dosage"]) == want


def test_lone_indel_stays(spark):
    assert one(spark, {"alts": ["AT"]})["alts"] == ["AT"]
