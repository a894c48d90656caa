"""Columns of variant records, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for an allele of unknown, high copy number.
MAX_ALLELE = 2**31 - 1
#: Names of the kinds of variants.
KINDS = {"gain": ("GAIN", "CNV"), "loss": ("LOSS", "CNV"), "loh": ("LOH", "CNV"), "reference": ("REF", "CNV"), "complex": ("COMPLEXCNV", "CNV")}


def cnv_type(cn: Column, mcc: Column, ref: Column) -> Column:
    """reference, gain, loss or loh; a reference copy number above 2 is an error at run time."""
    kind = (
        F.when(cn < ref, "loss").when(cn > ref, "gain").when((ref == 2) & (cn == 2) & (mcc == 2), "loh").otherwise("reference")
    )
    return F.when(ref > 2, F.raise_error(F.lit("reference copy number above 2"))).otherwise(kind)


def allele_numbers(cn: Column, mcc: Column, ref: Column) -> Column:
    """Copy numbers of the alleles: the major one known gives both, else the higher one stays open.

    -1 stands for an unknown allele, MAX_ALLELE for any number above the reference.
    """
    one = F.array(cn)
    known = F.array(F.least(mcc, cn - mcc), F.greatest(mcc, cn - mcc))
    open_ = (
        F.when(cn == 0, F.array(F.lit(0), F.lit(0))).when(cn == 1, F.array(F.lit(0), F.lit(1))).when(cn == 2, F.array(F.lit(1), F.lit(1)))
        .otherwise(F.array(F.lit(-1), F.lit(MAX_ALLELE)))
    )
    return F.when(ref == 1, one).when(ref == 0, F.array(cn)).when(mcc.isNotNull(), known).otherwise(open_)


def record_type(kinds: Column) -> Column:
    """Of the samples' types: none but reference -> reference, one other -> it, several -> complex."""
    others = F.array_distinct(F.filter(kinds, lambda k: k != "reference"))
    return F.when(F.size(others) == 0, "reference").when(F.size(others) == 1, F.get(others, F.lit(0))).otherwise("complex")


def alt_alleles(alleles: Column) -> Column:
    """Sorted distinct alternate alleles of all samples (array of arrays): <CNn>, and <DUP> last."""
    numbers = F.array_sort(F.array_distinct(F.filter(F.flatten(alleles), lambda a: (a != 1) & (a != -1))))
    return F.transform(numbers, lambda a: F.when(a == MAX_ALLELE, "<DUP>").otherwise(F.concat(F.lit("<CN"), a.cast("string"), F.lit(">"))))


def genotype(alleles: Column, alts: Column) -> Column:
    """GT string: 0 for one copy, . for unknown, else the place among the alternates."""
    def one(a: Column) -> Column:
        name = F.when(a == MAX_ALLELE, "<DUP>").otherwise(F.concat(F.lit("<CN"), a.cast("string"), F.lit(">")))
        return F.when(a == 1, "0").when(a == -1, ".").otherwise(F.array_position(alts, name).cast("string"))

    return F.array_join(F.transform(alleles, one), "/")


def info_column(end: Column, length: Column, ci_pos: Column | None = None, ci_end: Column | None = None, subclonal: Column | None = None, common: Column | None = None) -> Column:
    """INFO as text; parts that are null are left out."""
    parts = [F.lit("SVTYPE=CNV"), F.concat(F.lit("END="), end.cast("string")), F.concat(F.lit("CNVLEN="), length.cast("string"))]
    if ci_pos is not None:
        parts.append(F.concat(F.lit("CIPOS="), ci_pos))
    if ci_end is not None:
        parts.append(F.concat(F.lit("CIEND="), ci_end))
    if subclonal is not None:
        parts.append(F.when(subclonal, F.lit("SUBCLONAL")))
    if common is not None:
        parts.append(F.when(common, F.lit("COMMONCNV")))
    return F.concat_ws(";", *parts)


def position_column(start: Column, alts: Column) -> Column:
    """1-based POS; with a symbolic alternate it is the base before the event, at least 1."""
    return F.when(F.size(alts) > 0, F.greatest(start, F.lit(1))).otherwise(start + 1)


def header(contigs: list[tuple[str, int]], samples: list[str], filters: dict[str, str], extra: dict[str, str] | None = None) -> list[str]:
    """Lines of a VCF 4.1 header."""
    lines = ["##fileformat=VCFv4.1", *[f"##{k}={v}" for k, v in (extra or {}).items()]]
    lines += [f"##contig=<ID={name},length={length}>" for name, length in contigs]
    lines += [f'##ALT=<ID=CN{n},Description="Copy number allele: {n} copies">' for n in (0, 2, 3, 4, 5)]
    lines += [f'##FILTER=<ID={k},Description="{v}">' for k, v in filters.items()]
    for name, number, kind, text in (
        ("END", 1, "Integer", "End position"), ("SVTYPE", 1, "String", "Type of structural variant"), ("CNVLEN", 1, "Integer", "Number of reference positions spanned"),
        ("CIPOS", 2, "Integer", "Confidence interval around POS"), ("CIEND", 2, "Integer", "Confidence interval around END"),
        ("SUBCLONAL", 0, "Flag", "Subclonal variant"), ("COMMONCNV", 0, "Flag", "Common copy number variant"),
    ):
        lines.append(f'##INFO=<ID={name},Number={number},Type={kind},Description="{text}">')
    for name, kind, text in (("GT", "String", "Genotype"), ("RC", "Float", "Mean count of a bin"), ("BC", "Integer", "Number of bins"), ("CN", "Integer", "Copy number"), ("MCC", "Integer", "Major chromosome count"), ("DQ", "Float", "De novo quality"), ("FT", "String", "Sample filter")):
        lines.append(f'##FORMAT=<ID={name},Number=1,Type={kind},Description="{text}">')
    return [*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def parse_info(lines: DataFrame) -> DataFrame:
    """Text lines of a VCF body to columns, with INFO and the first sample's FORMAT as maps."""
    rows = lines.filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f"))
    names = ["chrom", "pos", "id", "ref", "alt", "qual", "filter"]
    columns = [F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)]
    info = F.str_to_map(F.get("f", F.lit(7)), F.lit(";"), F.lit("="))
    fmt, sample = F.get("f", F.lit(8)), F.get("f", F.lit(9))
    keys, values = F.split(fmt, ":"), F.split(sample, ":")
    pairs = F.map_from_arrays(keys, F.transform(keys, lambda k, i: F.get(values, i)))
    return rows.select(*columns, info.alias("info"), F.when(fmt.isNotNull() & sample.isNotNull(), pairs).alias("sample")).withColumn("pos", F.col("pos").cast("long"))
