"""Whole runs over files: compile, extract and score, each step a written table that a later run of the same inputs reads again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import compiled, extract, sinks
from ..sources import binary, text


def compile_scores(spark: SparkSession, scoring: str, fasta: str, out: str, public: str | None = None) -> DataFrame:
    """Compiled terms of the scoring files under ``scoring``, written once under ``out``/terms."""
    chunks = binary.fasta_chunks(spark, fasta)
    variants = text.public_variants(spark, public) if public else None
    described = sinks.run_once(text.scoring_terms(spark, scoring), f"{out}/described", {"step": "describe", "scoring": scoring})
    done = compiled.compile_terms(described, chunks, variants)
    return sinks.run_once(done, f"{out}/terms", {"step": "compile", "scoring": scoring, "fasta": fasta, "public": public})


def extract_calls(spark: SparkSession, terms: DataFrame, vcf: str, fasta: str, out: str, sample: str | None = None, **options) -> DataFrame:
    """Calls of every sample of the VCF files under ``vcf`` (or of one) at the targets of ``terms``, written once under ``out``/calls.

    A file whose header states other contig lengths than the reference's is refused.
    """
    chunks = binary.fasta_chunks(spark, fasta)
    text.check_assembly(text.header_facts(spark, vcf), binary.contig_lengths(chunks)).collect()  # a row for each file
    records = text.rule_records(text.vcf_records(spark, vcf, sample))
    names = text.sample_names(spark, vcf).selectExpr("explode(samples) AS sample").distinct()
    names = names if sample is None else names.where(names["sample"] == sample)
    found = extract.extract(compiled.targets(terms), records, chunks, names, **options)
    return sinks.run_once(found, f"{out}/calls", {"step": "extract", "vcf": vcf, "fasta": fasta, "sample": sample, **options})


def run(spark: SparkSession, scoring: str, vcf: str, fasta: str, out: str, public: str | None = None, accept: dict | None = None, **options) -> DataFrame:
    """Scores of the samples of ``vcf``; ``accept`` holds the opt-ins of scoring, ``options`` those of extraction."""
    terms = compile_scores(spark, scoring, fasta, out, public)
    found = extract_calls(spark, terms, vcf, fasta, out, **options)
    inputs = {"step": "score", "scoring": scoring, "vcf": vcf, "fasta": fasta, "public": public, "accept": accept, **options}
    return sinks.run_once(extract.score_calls(terms, found, accept), f"{out}/scores", inputs)
