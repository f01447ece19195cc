"""Text sources: scoring files, VCF records, frequency VCFs, regions, groups and score tables.

Plain and gzip files (bgzip included) are read by Spark itself. Lines are numbered by their place in their split
and the lines of the file's earlier splits, so large plain files are read by many tasks and keep their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exact
from ..operators import calls, terms


def numbered_lines(spark: SparkSession, path: str, keep: str = "true") -> DataFrame:
    """file, n (from 1) and line of the lines under ``path`` that ``keep`` (SQL over ``line``) holds for; no line is shuffled."""
    own = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__split"), F.col("value").alias("line")).where(keep)
    # Ids follow each other within a task, so a line's place in its split is its id less the split's least.
    own = own.withColumn("__at", F.monotonically_increasing_id())
    splits = own.groupBy("file", "__split").agg(F.min("__at").alias("__least"), F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy("file").orderBy("__split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split of a file
    splits = splits.withColumn("__begin", F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
    return own.join(splits, ["file", "__split"]).select("file", (F.col("__begin") + F.col("__at") - F.col("__least") + 1).alias("n"), "line")


STRICT = ("pgs_id", "genome_build", "variants_number", "weight_type", "HmPOS_build")


def header_values(lines: DataFrame, strict: tuple[str, ...] = STRICT) -> DataFrame:
    """file and a map of the '#key=value' header lines; of a key given twice the last counts, and is an error for a strict one."""
    pair = F.regexp_extract(F.col("line"), r"^#+([A-Za-z_]+)=(.*)$", 1), F.regexp_extract(F.col("line"), r"^#+([A-Za-z_]+)=(.*)$", 2)
    own = lines.where(F.col("line").rlike(r"^#+[A-Za-z_]+=")).select("file", "n", pair[0].alias("k"), F.trim(pair[1]).alias("v"))
    own = own.groupBy("file", "k").agg(F.max_by("v", "n").alias("v"), F.count(F.lit(1)).alias("times"))
    twice = (F.col("times") > 1) & F.col("k").isin(*strict)
    own = own.withColumn("v", F.when(twice, F.raise_error(F.concat(F.lit("header key given twice: "), "k"))).otherwise(F.col("v")))
    return own.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("header"))


def named_columns(spark: SparkSession, path: str, wanted: list[str], comment: str = "#", separator: str = "\t") -> DataFrame:
    """file, ordinal, line and one string column per ``wanted`` name (null where a file lacks it).

    The first line that is no comment names the columns, each file for itself; names that repeat are an error.
    """
    rows = numbered_lines(spark, path, f"NOT startswith(line, '{comment}') AND trim(line) <> ''")
    heads = rows.where("n = 1").select("file", F.split("line", separator, -1).alias("__names"))
    heads = heads.withColumn("__names", F.when(F.size(F.array_distinct("__names")) != F.size("__names"), F.raise_error(F.lit("a column name repeats"))).otherwise(F.col("__names")))
    rows = rows.where("n > 1").withColumn("__v", F.split("line", separator, -1)).join(heads, "file")
    uneven = F.size("__v") != F.size("__names")
    rows = rows.withColumn("__v", F.when(uneven, F.raise_error(F.concat(F.lit("row does not match its header: "), "line"))).otherwise(F.col("__v")))
    at = lambda name: F.array_position("__names", F.lit(name)).cast("int")
    own = [F.when(at(x) > 0, F.get("__v", at(x) - 1)).alias(x) for x in wanted]
    return rows.select("file", (F.col("n") - 1).cast("long").alias("ordinal"), "line", *own)


SCORING = ["rsID", "chr_name", "chr_position", "effect_allele", "other_allele", "effect_weight", "dosage_0_weight", "dosage_1_weight", "dosage_2_weight", "is_dominant", "is_recessive", "hm_source", "hm_chr", "hm_pos", "hm_inferOtherAllele", "hm_match_chr", "hm_match_pos", "variant_description", "is_haplotype", "is_diplotype", "is_interaction", "inclusion_criteria", "imputation_method"]


def scoring_terms(spark: SparkSession, path: str) -> DataFrame:
    """Terms of the scoring files under ``path``, with their review reasons: harmonised columns where a file has them.

    Centred weights must have the weight_type of their file's header.
    """
    lines = numbered_lines(spark, path, "startswith(line, '#')")
    rows = named_columns(spark, path, SCORING).join(header_values(lines), "file", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    catalog = F.col("hm_chr").isNotNull()
    chrom = F.when(catalog, F.col("hm_chr")).otherwise(F.regexp_replace(text("chr_name"), "^chr", ""))
    contig = F.when(~F.coalesce(catalog, F.lit(False)) | ~chrom.startswith("chr"), terms.contig_code(chrom))
    pos = terms.position(F.when(catalog, text("hm_pos")).otherwise(text("chr_position")))
    flags = {c: terms.flag(F.col(f"is_{c}")) for c in ("haplotype", "diplotype", "interaction", "dominant", "recessive")}
    true = lambda c: F.coalesce(flags[c], F.lit(False))
    given = [text(f"dosage_{k}_weight") for k in range(3)]
    explicit = (given[0] != "") | (given[1] != "") | (given[2] != "")
    weights = F.when(explicit, F.array(*(exact.parse(x) for x in given))).otherwise(F.array(exact.parse(text("effect_weight"))))
    effect, other = text("effect_allele"), text("other_allele")
    description = F.trim(text("variant_description"))
    centred = terms.centre(description)
    identifier = F.coalesce(terms.restates(description, text("chr_name"), text("chr_position"), effect, other), F.lit(False))
    noted = (description != "") & centred.isNull() & ~identifier
    match = {c: F.lower(text(f"hm_match_{c}")) for c in ("chr", "pos")}
    acgt = lambda x: x.rlike("^[ACGT]+$")
    review = terms.reasons(
        {f"invalid_model_flag:is_{c}": flags[c].isNull() for c in flags}
        | {f"requires_special_model:is_{c}": true(c) for c in ("haplotype", "diplotype", "interaction")}
        | {
            "conditional_inclusion_requires_review": F.trim(text("inclusion_criteria")) != "",
            "variant_description_requires_review": noted,
            "specific_imputation_method_requires_review": F.trim(text("imputation_method")) != "",
            "conflicting_weight_models": (true("dominant") & true("recessive")) | (explicit & (true("dominant") | true("recessive"))),
            "invalid_dosage_weights": explicit & F.exists(weights, lambda w: w.isNull()),
            "invalid_effect_weight": ~explicit & F.exists(weights, lambda w: w.isNull()),
            "unresolved_harmonized_position": contig.isNull() | pos.isNull(),
            "author_other_allele_missing": other == "",
            "nonliteral_alleles": ~acgt(effect) | ((other != "") & ~acgt(other)),
            "identical_effect_other_alleles": effect == other,
        }
        | {f"harmonization_mismatch:hm_match_{c}": match[c] == "false" for c in match}
        | {f"invalid_harmonization_flag:hm_match_{c}": ~match[c].isin("", "false", "true", "na", ".") for c in match}
    )
    kind = F.when(acgt(effect) & acgt(other) & (effect != other), F.when((F.length(effect) == 1) & (F.length(other) == 1), "literal_snv").otherwise("literal_sequence")).otherwise("unresolved")
    declared = F.col("header")["weight_type"]
    out = rows.withColumn("__centred", centred)
    wrong = F.col("__centred").isNotNull() & ~F.coalesce(F.col("__centred.weight_type") == declared, F.lit(False))
    out = out.withColumn("line", F.when(wrong, F.raise_error(F.concat(F.lit("centred weight of another type than the header's: "), "line"))).otherwise(F.col("line")))
    return out.select("file", F.coalesce(F.col("header")["pgs_id"], F.regexp_extract("file", r"([^/]+?)(?:\.(?:txt|tsv))?(?:\.gz)?$", 1)).alias("pgs_id"), "ordinal", "line", contig.cast("int").alias("contig"), pos.alias("pos"), effect.alias("effect_allele"), F.when(other != "", other).alias("other_allele"), text("hm_inferOtherAllele").alias("catalog_other"), kind.alias("allele_kind"), terms.model(true("dominant"), true("recessive"), explicit).alias("model"), weights.alias("weights"), review.alias("reasons"), (noted & terms.informational(description)).alias("informational"), F.col("__centred").alias("centred"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Per file: pgs_id, declared and actual number of variants, and whether they agree (custom files: where declared)."""
    heads = header_values(numbered_lines(spark, path, "startswith(line, '#')"))
    own = named_columns(spark, path, ["effect_allele"]).groupBy("file").agg(F.count(F.lit(1)).alias("actual"))
    declared = F.col("header")["variants_number"].try_cast("long")
    out = own.join(heads, "file", "left").select("file", F.col("header")["pgs_id"].alias("pgs_id"), declared.alias("declared"), "actual")
    return out.withColumn("consistent", F.coalesce(F.col("declared") == F.col("actual"), ~F.coalesce(terms.is_public_id(F.col("pgs_id")), F.lit(False))))


# VCF


def _info(info: Column, key: str) -> Column:
    """The last value of an INFO key; null if it is absent or a flag."""
    return F.try_element_at(F.regexp_extract_all(info, F.lit(f"(?:^|;){key}=([^;]*)"), F.lit(1)), F.lit(-1))


def sample_names(spark: SparkSession, path: str) -> DataFrame:
    """file and samples (in order) of VCF files."""
    heads = spark.read.text(path).where(F.col("value").startswith("#CHROM"))
    return heads.select(F.col("_metadata.file_path").alias("file"), F.slice(F.split("value", "\t"), 10, 1_000_000).alias("samples"))


def header_facts(spark: SparkSession, path: str) -> DataFrame:
    """Per file: contigs (name to length), whether FILTER RefCall is defined, and the caller's version."""
    lines = spark.read.text(path).where(F.col("value").startswith("##")).select(F.col("_metadata.file_path").alias("file"), "value")
    name, length = F.regexp_extract("value", r"^##contig=<.*?\bID=([^,>]+)", 1), F.regexp_extract("value", r"^##contig=<.*?\blength=([0-9]+)", 1).try_cast("long")
    contig = F.when(F.col("value").startswith("##contig="), F.struct(name.alias("k"), length.alias("v")))
    version = F.regexp_extract("value", r"^##DeepVariant_version=(.*)$", 1)
    return lines.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_set(contig))).alias("contigs"), F.bool_or(F.col("value").rlike(r"^##FILTER=<ID=RefCall[,>]")).alias("refcall_defined"), F.max(F.when(version != "", version)).alias("version"))


def check_assembly(facts: DataFrame, lengths: DataFrame) -> DataFrame:
    """``facts`` of files whose contig lengths equal those of ``lengths`` (contig, length); a file that states another length is an error."""
    stated = facts.select("file", F.explode("contigs").alias("name", "stated")).withColumn("contig", terms.contig_code(F.col("name")).cast("int"))
    wrong = stated.join(lengths, "contig").where("stated <> length").groupBy("file").agg(F.min("name").alias("__wrong"))
    bad = F.raise_error(F.concat("file", F.lit(": another assembly, by the length of "), F.col("__wrong")))
    return facts.join(wrong, "file", "left").withColumn("refcall_defined", F.when(F.col("__wrong").isNotNull(), bad).otherwise(F.col("refcall_defined"))).drop("__wrong")


def vcf_records(spark: SparkSession, path: str, sample: str | None = None) -> DataFrame:
    """One row per record and sample: file, record_ordinal, contig, pos, end_, ref, alts, filters, sample, gt and fmt.

    ``sample`` keeps one sample; a file without it gives no rows. Only the kept fields are parsed. An END without
    a number, a FORMAT key that repeats, and a GT that names an ALT which is not there are errors.
    """
    heads = sample_names(spark, path).withColumnRenamed("samples", "__samples")
    rows = numbered_lines(spark, path, "NOT startswith(line, '#') AND line <> ''").join(heads, "file").withColumn("__f", F.split("line", "\t"))
    f = lambda k: F.get("__f", F.lit(k))
    stated = _info(f(7), "END")
    bad_end = f(7).rlike("(?:^|;)END(?:;|$)") | (stated.isNotNull() & stated.try_cast("int").isNull())
    end = F.when(bad_end, F.raise_error(F.concat(F.lit("END without a number: "), f(0), F.lit(":"), f(1)))).otherwise(F.coalesce(stated.try_cast("int"), f(1).try_cast("int") + F.length(f(3)) - 1))
    alts = F.filter(F.split(f(4), ","), lambda x: (x != ".") | F.lit(False))
    alts = F.when(f(4) == ".", F.array(F.lit("."))).otherwise(alts)
    rows = rows.select("file", F.col("n").alias("record_ordinal"), terms.contig_code(f(0)).cast("int").alias("contig"), f(1).try_cast("int").alias("pos"), end.alias("end_"), F.upper(f(3)).alias("ref"), alts.alias("alts"), F.split(f(6), ";").alias("filters"), f(7).alias("info"), F.split(f(8), ":").alias("__k"), F.posexplode(F.col("__samples")).alias("__i", "sample"), "__f")
    if sample is not None:
        rows = rows.where(F.col("sample") == sample)
    values = F.split(F.get("__f", F.col("__i") + 9), ":")
    padded = F.transform("__k", lambda _, i: F.get(values, i))
    twice = F.size(F.array_distinct("__k")) != F.size("__k")
    place = F.concat_ws(":", F.col("contig"), F.col("pos"))
    fmt = F.when(twice, F.raise_error(F.concat(F.lit("FORMAT key repeats at "), place))).otherwise(F.map_from_arrays("__k", padded))
    out = rows.withColumn("fmt", fmt).withColumn("gt", calls.genotype(F.col("fmt")["GT"]))
    beyond = F.exists("gt", lambda x: x > F.when(F.get("alts", F.lit(0)) == ".", 0).otherwise(F.size("alts")))
    out = out.withColumn("gt", F.when(F.coalesce(beyond, F.lit(False)), F.raise_error(F.concat(F.lit("GT names an ALT that is not there at "), place))).otherwise(F.col("gt")))
    return out.drop("__k", "__i", "__f")


def rule_records(records: DataFrame) -> DataFrame:
    """``vcf_records`` with the fields that the genotype rules read: ft, depth, quality, ds and gp."""
    fmt = F.col("fmt")
    depth = F.when(calls.is_block(F.col("alts")), fmt["MIN_DP"]).otherwise(fmt["DP"])
    return records.withColumns({"ft": fmt["FT"], "depth": calls.number(depth), "quality": calls.number(fmt["GQ"]), "ds": fmt["DS"], "gp": fmt["GP"], "phased": F.coalesce(fmt["GT"].contains("|"), F.lit(False))})


def frequency_records(spark: SparkSession, path: str, field: str, flag: str = "MULTI_ALLELIC") -> DataFrame:
    """Allele frequencies of a population VCF, in file order."""
    rows = numbered_lines(spark, path, "NOT startswith(line, '#')").withColumn("__f", F.split("line", "\t"))
    f = lambda k: F.get("__f", F.lit(k))
    text = _info(f(7), field)
    return rows.select("file", F.col("n").alias("src_ord"), terms.contig_code(f(0)).cast("int").alias("contig"), f(1).try_cast("int").alias("pos"), f(3).alias("ref"), f(4).alias("alt"), text.alias("freq_text"), exact.parse(text).alias("freq"), F.array_contains(F.split(f(7), ";"), flag).alias("multiallelic"))


def public_variants(spark: SparkSession, path: str) -> DataFrame:
    """contig, pos, ref and alt of a variant list; rows with several ALTs are left out."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).withColumn("__f", F.split("value", "\t"))
    f = lambda k: F.get("__f", F.lit(k))
    return rows.select(terms.contig_code(f(0)).cast("int").alias("contig"), f(1).try_cast("int").alias("pos"), f(2).alias("ref"), f(3).alias("alt")).where("contig is not null and pos is not null and not contains(alt, ',')")


def regions(spark: SparkSession, path: str) -> DataFrame:
    """name, contig, start0 and end_ of BED lines; the file's stem names lines without a name."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", "\t").alias("f")).where("size(f) >= 3")
    stem = F.regexp_extract("file", r"([^/]+?)(?:\.bed)?(?:\.gz)?$", 1)
    f = lambda k: F.get("f", F.lit(k))
    return rows.select(F.coalesce(f(3), stem).alias("name"), terms.contig_code(f(0)).cast("int").alias("contig"), f(1).try_cast("long").alias("start0"), f(2).try_cast("long").alias("end_")).where("contig is not null and start0 is not null and end_ is not null")


def groups(spark: SparkSession, path: str, column: str) -> DataFrame:
    """sample and grp of a table with a header that names ``sample`` and ``column``."""
    own = named_columns(spark, path, ["sample", column])
    return own.select(F.trim("sample").alias("sample"), F.trim(column).alias("grp")).where("sample <> '' and grp <> ''")


def sample_sheet(spark: SparkSession, path: str) -> list[dict]:
    """Rows of a sample sheet; repeated ids and ids that leave their folder are errors."""
    rows = [r.asDict() for r in named_columns(spark, path, ["sample_id", "input", "sample"]).orderBy("ordinal").collect()]
    seen = set()
    for r in rows:
        name = r["sample_id"] or ""
        if not name or name in seen or "/" in name or "\\" in name or name in (".", ".."):
            raise ValueError(f"sample_id {name!r} is empty, repeated or not a plain name")
        seen.add(name)
    return [{k: r[k] for k in ("sample_id", "input", "sample")} for r in rows]


def score_table(spark: SparkSession, path: str, kind: str = "native") -> DataFrame:
    """sample, pgs_id, score (text) and the identity columns of a score table: 'native', 'plink' (<id>_SUM columns, FID) or 'sums' (sampleset, FID, IID, PGS, SUM).

    Columns of the latter two are parted by tabs or blanks. Files compressed with zstd are read through Arrow.
    """
    if path.endswith(".zst"):
        path = _inflated(spark, path)
    if kind == "native":
        own = named_columns(spark, path, ["sample", "pgs_id", "partial_raw_score"], "##")
        return own.select("sample", "pgs_id", F.trim("partial_raw_score").alias("score"))
    blanks = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), "^#", ""), r"[ \t]+", "\t")
    lines = numbered_lines(spark, path, "NOT startswith(line, '##') AND trim(line) <> ''").withColumn("line", blanks(F.col("line")))
    head = lines.where("n = 1").first()["line"].split("\t")
    rows = lines.where("n > 1").withColumn("v", F.split("line", "\t", -1))
    at = lambda name: F.get("v", F.lit(head.index(name))) if name in head else F.lit(None).cast("string")
    if kind == "sums":
        return rows.select(at("IID").alias("sample"), at("PGS").alias("pgs_id"), at("SUM").alias("score"), at("sampleset").alias("sampleset"), at("FID").alias("fid"))
    wanted = [c for c in head if c.endswith("_SUM") and c != "NAMED_ALLELE_DOSAGE_SUM"]
    if not wanted:
        raise ValueError("no score column ends in _SUM")
    pairs = F.explode(F.array(*(F.struct(F.lit(c[:-4]).alias("pgs_id"), at(c).alias("score")) for c in wanted)))
    return rows.select(at("IID").alias("sample"), at("FID").alias("fid"), at("SID").alias("sid"), pairs.alias("x")).select("sample", "x.*", "fid", "sid")


def _inflated(spark: SparkSession, path: str) -> str:
    """A plain copy of a zstd file beside it; score tables are small."""
    import pyarrow as pa

    content = spark.read.format("binaryFile").load(path).first()["content"]
    text = pa.CompressedInputStream(pa.BufferReader(bytes(content)), "zstd").read().decode()
    out = f"{path.removesuffix('.zst')}.plain"
    spark.createDataFrame([(x,) for x in text.splitlines()], "value string").coalesce(1).write.mode("overwrite").text(out)
    return out
