"""Readers and writers of the text formats: bins, segments, sites, intervals, records and metrics.

All are headerless tab-separated files unless said otherwise; compression follows the file name. The
line order of a file is not kept by Spark, so readers add no order; operators sort by position.
"""

from __future__ import annotations

import json
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import vcf
from helixframe.operators import intervals as iv
from helixframe.operators import segments as sg

BINS = "chrom string, start_pos long, end_pos long, cnt double, gc int"
PARTITIONED = "chrom string, start_pos long, end_pos long, cnt double, seg_id string"
SITES = "chrom string, pos long, ref string, alt string, ref_count int, alt_count int"
SPANS = "chrom string, start_pos long, end_pos long"


def _csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=schema, **options)


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """Binned counts: chrom, start, end, count, GC percent."""
    return _csv(spark, path, BINS)


def read_coverage(spark: SparkSession, path: str, excluded: DataFrame | None = None) -> DataFrame:
    """Binned counts without the bins that touch an excluded interval."""
    bins = read_bins(spark, path)
    return bins if excluded is None else iv.overlap_anti(bins, excluded).select(bins.columns)


def read_bed(spark: SparkSession, path: str, gc: bool = False) -> DataFrame:
    """Intervals; a negative start, or an end not beyond it, is an error at run time."""
    rows = _csv(spark, path, SPANS + (", gc int" if gc else ""), comment="#")
    bad = (F.col("start_pos") < 0) | (F.col("start_pos") >= F.col("end_pos"))
    return rows.withColumn("start_pos", F.when(bad, F.raise_error("bad interval")).otherwise(F.col("start_pos")).cast("long"))


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """Bins with segment ids, as segments with extent, counts and confidence intervals."""
    rows = _csv(spark, path, PARTITIONED)
    w = Window.partitionBy("chrom").orderBy("start_pos")
    new = ~F.coalesce(F.lag("seg_id").over(w).eqNullSafe(F.col("seg_id")), F.lit(False))
    new = new | F.lag("start_pos").over(w).isNull()
    bins = rows.withColumn("__new", new.cast("int")).withColumn("seg_idx", F.sum("__new").over(w) - 1)
    summary = sg.summarize(bins)
    return summary.join(sg.with_confidence(bins).drop("start_pos", "end_pos"), ["chrom", "seg_idx"])


def read_sites(spark: SparkSession, path: str, min_depth: int = 10) -> DataFrame:
    """Allele counts at sites of a least depth; lines from # are left out."""
    return _csv(spark, path, SITES, comment="#").filter(F.col("ref_count") + F.col("alt_count") >= min_depth)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """Target regions, 1-based with both ends inside, as half-open intervals."""
    rows = _csv(spark, path, "name string, chrom string, first long, last long", comment="#")
    return rows.select("name", "chrom", (F.col("first") - 1).alias("start_pos"), F.col("last").alias("end_pos"))


def read_common_regions(spark: SparkSession, path: str) -> DataFrame:
    """Common variants; overlapping ones are an error at run time."""
    return iv.assert_disjoint(read_bed(spark, path), ["chrom"])


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """Contigs in order: chrom, length, kind (autosome, allosome or other), with ord."""
    return _csv(spark, path, "ord int, chrom string, length long, kind string", comment="#")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Records with INFO and the first sample's FORMAT as maps."""
    return vcf.parse_info(spark.read.text(path))


def _number(value: Column) -> Column:
    return F.when(value.isNull() | (value == "."), None).otherwise(value).cast("int")


def read_ploidy(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Reference ploidy by interval from CN and END; '.' means 2. With ``strict`` intervals must not
    overlap, adjacent equal ones become one, and ploidy 2 is left out."""
    rows = read_vcf(spark, path)
    symbolic = F.col("alt").startswith("<")
    spans = rows.select(
        "chrom", F.when(symbolic, F.col("pos")).otherwise(F.col("pos") - 1).alias("start_pos"), F.col("info")["END"].cast("long").alias("end_pos"),
        F.coalesce(_number(F.col("sample")["CN"]), F.lit(2)).alias("cn"),
    )
    if not strict:
        return spans
    return iv.merge_equal(iv.assert_disjoint(spans, ["chrom"]), ["cn"]).filter("cn != 2").select("chrom", "start_pos", "end_pos", "cn")


def read_truth_bed(spark: SparkSession, path: str, least_clonality: float = 0.0) -> DataFrame:
    """Truth with the copy numbers of both alleles and an optional clonality."""
    rows = _csv(spark, path, SPANS + ", cn_a int, cn_b int, clonality double", comment="#")
    return rows.filter(F.coalesce("clonality", F.lit(1.0)) >= least_clonality).select(
        "chrom", "start_pos", "end_pos", (F.col("cn_a") + F.col("cn_b")).alias("cn")
    )


def read_truth_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Truth from INFO CN and END; halves round upwards."""
    rows = read_vcf(spark, path)
    return rows.select(
        "chrom", (F.col("pos") - 1).alias("start_pos"), F.col("info")["END"].cast("long").alias("end_pos"),
        F.floor(F.col("info")["CN"].cast("double") + 0.5).cast("int").alias("cn"),
    )


def read_calls(spark: SparkSession, path: str, least_dq: float | None = None) -> DataFrame:
    """Calls: copy number (of the sample before INFO), alleles of the genotype as reference ploidy."""
    rows = read_vcf(spark, path)
    gt = F.col("sample")["GT"]
    out = rows.select(
        "chrom", F.when(F.col("alt").startswith("<"), F.col("pos")).otherwise(F.col("pos") - 1).alias("start_pos"),
        F.col("info")["END"].cast("long").alias("end_pos"), F.coalesce(_number(F.col("sample")["CN"]), _number(F.col("info")["CN"])).alias("cn"),
        F.when(gt.isNotNull() & (gt != "."), F.size(F.split(gt, r"[/|]"))).alias("ref_ploidy"), (F.col("filter") == "PASS").alias("is_pass"),
        "alt", F.col("sample")["DQ"].cast("double").alias("dq"),
    )
    out = out.filter("end_pos is not null and cn is not null")
    return out if least_dq is None else out.filter((F.col("dq") >= least_dq) & (F.col("alt") != "."))


def read_pca_model(spark: SparkSession, path: str, axes: int) -> DataFrame:
    """Model bins with mean and axes of norm 1; axes that are not orthogonal to 1e-4 are an error."""
    names = [f"axis_{k}" for k in range(1, axes + 1)]
    rows = _csv(spark, path, SPANS + ", mean double, " + ", ".join(f"{n} double" for n in names))
    sums = rows.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}/{b}") for k, a in enumerate(names) for b in names[k:]]).first()
    norms = {a: sums[f"{a}/{a}"] ** 0.5 for a in names}
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            if abs(sums[f"{a}/{b}"]) > 1e-4 * norms[a] * norms[b]:
                raise ValueError(f"{a} and {b} are not orthogonal")
    return rows.select("chrom", "start_pos", "end_pos", "mean", *[(F.col(a) / norms[a]).alias(a) for a in names])


def read_metric(spark: SparkSession, path: str, name: str) -> float:
    """The one value of a metric file's line '#name<tab>value'."""
    rows = spark.read.text(path).filter(F.col("value").startswith(f"#{name}\t")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{len(rows)} lines for {name}")
    return float(rows[0]["value"].split("\t")[1])


def read_parameters(spark: SparkSession, path: str, kind: type):
    """A JSON file as a dataclass; names that it lacks are left out."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    known = {f.name for f in fields(kind)}
    return kind(**{k: v for k, v in json.loads(text).items() if k in known})


def _write(df: DataFrame, path: str, **options) -> None:
    df.write.csv(path, sep="\t", compression="gzip", mode="overwrite", **options)


def write_bins(df: DataFrame, path: str) -> None:
    """Bins with counts of two decimals, in the order of contigs and positions."""
    two = F.format_string("%.2f", F.col("cnt").cast("double"))
    _write(df.select("chrom", "start_pos", "end_pos", two, "gc").sort("chrom", "start_pos"), path)


def write_partitioned(df: DataFrame, path: str) -> None:
    two = F.format_string("%.2f", F.col("cnt").cast("double"))
    _write(df.select("chrom", "start_pos", "end_pos", two, F.col("seg_idx").cast("string")).sort("chrom", "start_pos"), path)


def write_sites(df: DataFrame, path: str) -> None:
    _write(df.select("chrom", "pos", "ref", "alt", "ref_count", "alt_count").sort("chrom", "pos"), path)


def write_frequencies(df: DataFrame, path: str) -> None:
    """Comma-separated Chromosome, Position, BAF with a header."""
    out = df.select(F.col("chrom").alias("Chromosome"), F.col("pos").alias("Position"), F.col("baf").alias("BAF"))
    out.sort("Chromosome", "Position").write.csv(path, header=True, mode="overwrite")


def frequency_track(df: DataFrame) -> DataFrame:
    """B-allele frequencies as track rows of one base."""
    return df.select("chrom", (F.col("pos") - 1).alias("start_pos"), F.col("pos").alias("end_pos"), F.col("baf").alias("value"))


def write_track(df: DataFrame, path: str, digits: int | None = None) -> None:
    """Track rows (chrom, start_pos, end_pos, value), rounded away from zero to ``digits``."""
    value = F.col("value") if digits is None else F.round("value", digits)
    _write(df.select("chrom", "start_pos", "end_pos", value.alias("value")).sort("chrom", "start_pos"), path)


def write_ratios(sample: DataFrame, control: DataFrame, ratio: DataFrame, path: str) -> None:
    """Counts of the sample and its control with their log2 ratio, for the bins of all three."""
    key = ["chrom", "start_pos", "end_pos"]
    both = sample.select(*key, F.col("cnt").alias("Fragment Count")).join(control.select(*key, F.col("cnt").alias("Reference Count")), key)
    both = both.join(ratio.select(*key, F.log2("ratio").alias("Unsmoothed Log Ratio")), key)
    out = both.select("Fragment Count", "Reference Count", F.col("chrom").alias("Chromosome"), F.col("start_pos").alias("Start"), F.col("end_pos").alias("End"), "Unsmoothed Log Ratio")
    out.sort("Chromosome", "Start").write.csv(path, header=True, mode="overwrite")


def write_vcf(records: DataFrame, header: list[str], path: str, order: str = "chrom_ord") -> None:
    """Records (chrom, pos, id, ref, alt, qual, filter, info, format and sample columns) behind a header.

    Lines are range-sorted, so parts are in order; the header is a part of its own, the first one.
    """
    spark = records.sparkSession
    names = [c for c in records.columns if c != order]
    lines = records.select(F.col(order).alias("o"), F.col("pos").alias("p"), F.concat_ws("\t", *[F.col(c).cast("string") for c in names]).alias("value"))
    head = spark.createDataFrame([(-1, k, line) for k, line in enumerate(header)], "o int, p long, value string")
    head.withColumn("p", F.col("p").cast("long")).unionByName(lines).sort("o", "p").select("value").write.mode("overwrite").text(path)


def write_metrics(values: dict[str, float], spark: SparkSession, path: str) -> None:
    """A small file of lines '#name<tab>value'."""
    spark.createDataFrame([(f"#{k}\t{v}",) for k, v in values.items()], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_pedigree(rows: list[tuple[str, str, str, str]], spark: SparkSession, path: str) -> None:
    """A pedigree file: family, sample, father, mother; sex and status unknown."""
    lines = [("\t".join([*r, "0", "-9"]),) for r in rows]
    spark.createDataFrame(lines, "value string").coalesce(1).write.mode("overwrite").text(path)
