"""The pipeline's stages one by one on the smallest scale, each against what its operator decides."""

import corpus_pipeline
from dosewright.llm import linededup, mixing, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert seen[name][1].columns == columns
    before, after = seen["quality_rules"]
    assert ids(after) == ids(quality.assessed(before).where("kept"))
    before, after = seen["line_dedup"]
    left = {r["doc_id"]: r["text"] for r in linededup.report(before).collect()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == {d: t for d, t in left.items() if t.strip()}
    before, after = seen["near_dedup"]
    assert ids(after) == sorted({r["component_id"] for r in simhash.near_duplicates(before).collect()})
    before, after = seen["mix_sources"]
    assert ids(after) == sorted(r["doc_id"] for r in mixing.mix(before).collect() for _ in range(r["passes"]))
    before, after = seen["pack_sequences"]
    assert ids(after.where("piece = 0")) == ids(before)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
