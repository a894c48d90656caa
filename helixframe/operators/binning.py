"""From aligned reads to counts in bins, and allele counts at sites.

Positions are sparse rows (chrom, pos, hits); no array of a contig's bases is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals as iv

#: Fixed value: the preference of nucleotides for the reference side of a site.
BASE_ORDER = ["A", "T", "G", "C"]


def usable_starts(reads: DataFrame, min_mapq: int = 3) -> DataFrame:
    """Forward reads that are no duplicates and map well (a quality of 255 means that it is missing)."""
    return reads.filter(F.col("is_forward") & ~F.col("is_dup") & (F.col("mapq") >= min_mapq) & (F.col("mapq") != 255))


def position_hits(reads: DataFrame, cap: int = 255, binary: bool = False) -> DataFrame:
    """Reads that start at each position, at most ``cap`` (1 where ``binary``)."""
    hits = F.least(F.lit(1 if binary else cap), F.count(F.lit(1)))
    return reads.groupBy("chrom", "pos").agg(hits.cast("int").alias("hits"))


def fragments(reads: DataFrame, key: list[str], min_mapq: int = 3) -> DataFrame:
    """One row per read name of which every mate passes; it starts at the leftmost mate."""
    good = ~F.col("is_dup") & (F.col("mapq") >= min_mapq) & (F.col("mapq") != 255)
    grouped = reads.groupBy(*key, "chrom").agg(
        F.bool_and(good).alias("ok"), F.min("pos").alias("start_pos"), F.max("frag_len").alias("frag_len")
    )
    return grouped.filter("ok").select(
        *key, "chrom", "start_pos", (F.col("start_pos") + F.col("frag_len")).alias("end_pos")
    )


def counted(bins: DataFrame, hits: DataFrame, cap: int | None = None) -> DataFrame:
    """Bins with the sum of hits inside, each position's hits at most ``cap``."""
    value = F.col("hits") if cap is None else F.least(F.lit(cap), F.col("hits"))
    inside = iv.points_in(hits.withColumn("hits", value), bins.select("chrom", "start_pos", "end_pos"))
    sums = inside.groupBy("chrom", F.col("start_pos_r").alias("start_pos"), F.col("end_pos_r").alias("end_pos")).agg(
        F.sum("hits").alias("count")
    )
    return bins.join(sums, ["chrom", "start_pos", "end_pos"], "left").fillna(0, ["count"])


def weighted_counts(bins: DataFrame, hits: DataFrame, expected: DataFrame, cap: int = 10) -> DataFrame:
    """Bins with round-half-even(sum of min(cap, hits / expected hits of the bin's GC class))."""
    inside = iv.points_in(hits, bins.select("chrom", "start_pos", "end_pos", "gc"))
    inside = inside.join(F.broadcast(expected.select(F.col("gc").alias("gc_r"), "expected")), "gc_r")  # a row for each percent
    sums = inside.groupBy("chrom", F.col("start_pos_r").alias("start_pos")).agg(
        F.bround(F.sum(F.least(F.lit(float(cap)), F.col("hits") / F.col("expected"))), 0).alias("count")
    )
    return bins.join(sums, ["chrom", "start_pos"], "left").fillna(0.0, ["count"])


def fixed_possible_bins(mappable: DataFrame, hits: DataFrame, size: int, cap: int = 10) -> DataFrame:
    """Bins of ``size`` mappable bases each, with counts of hits at mappable positions.

    ``mappable`` has disjoint runs. A bin begins where the one before ends; the unfilled last bin of
    a contig is left out. Runs carry their rank of bases before them, so a base's bin number follows
    from its run; bases are never listed.
    """
    runs = mappable.withColumn("len", F.col("end_pos") - F.col("start_pos"))
    order = Window.partitionBy("chrom").orderBy("start_pos")
    runs = runs.withColumn("before", F.coalesce(F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    first, last = F.floor(F.col("before") / size), F.floor((F.col("before") + F.col("len")) / size)
    ends = runs.filter(last > first).withColumn("bin", F.explode(F.sequence(first + 1, last)))
    ends = ends.select("chrom", (F.col("bin") - 1).alias("bin"), (F.col("start_pos") + F.col("bin") * size - F.col("before")).alias("end_pos"))
    order_bins = Window.partitionBy("chrom").orderBy("bin")
    spans = ends.withColumn("start_pos", F.coalesce(F.lag("end_pos").over(order_bins), F.lit(0)).cast("long"))
    at = iv.points_in(hits, runs.select("chrom", "start_pos", "end_pos", "before"))
    numbered = at.withColumn("bin", F.floor((F.col("before_r") + F.col("pos") - F.col("start_pos_r")) / size))
    sums = numbered.groupBy("chrom", "bin").agg(F.sum(F.least(F.lit(cap), F.col("hits"))).alias("count"))
    return spans.join(sums, ["chrom", "bin"], "left").fillna(0, ["count"]).select("chrom", "start_pos", "end_pos", "count")


def gc_percent(sequences: DataFrame, width: int) -> DataFrame:
    """GC percent in windows of ``width`` letters of each sequence; letters other than ACGT do not count."""
    windows = F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(width))
    cut = sequences.withColumn("start_pos", F.explode(windows)).withColumn("w", F.substr("seq", F.col("start_pos") + 1, F.lit(width)))
    known = F.length(F.regexp_replace("w", "[^ACGTacgt]", ""))
    gc = F.length(F.regexp_replace("w", "[^GCgc]", ""))
    return cut.filter(known > 0).select("seq_id", "start_pos", F.floor(100 * gc / known).cast("int").alias("gc"))


def start_read(longest_clip: int = 35) -> Column:
    """Whether a read counts by its start: passed, not duplicate, forward, primary, its first block matched
    over ``longest_clip`` letters or more, and well paired if it is paired."""
    first = F.get("cigar", F.lit(0))
    return (
        F.col("is_pass") & ~F.col("is_dup") & F.col("is_forward") & F.col("is_primary") & (first["op"] == "M")
        & (first["len"] >= longest_clip) & (~F.col("is_paired") | F.col("is_proper"))
    )


def fragment_read(least_mapq: int = 3, missing: int = 255) -> Column:
    """Whether a read's fragment counts: passed, not duplicate, primary, well paired, of known quality."""
    return F.col("is_pass") & ~F.col("is_dup") & F.col("is_primary") & F.col("is_proper") & (F.col("mapq") >= least_mapq) & (F.col("mapq") != missing)


def pileup_base(mapq: int, base_q: int = 20) -> Column:
    """Whether a base counts in a pileup."""
    return ~F.col("is_dup") & F.col("is_primary") & (F.col("mapq") > mapq) & (F.col("base_q") >= base_q)


def observed_vs_expected(bins: DataFrame) -> DataFrame:
    """Per GC class: share of hits over share of bins; a class without hits counts one hit."""
    classes = bins.groupBy("gc").agg(F.count(F.lit(1)).alias("bins"), F.greatest(F.sum("cnt"), F.lit(1.0)).alias("hits"))
    totals = classes.agg(F.sum("bins").alias("all_bins"), F.sum("hits").alias("all_hits"))
    joined = classes.join(F.broadcast(totals))  # one row
    return joined.select("gc", ((F.col("hits") / F.col("all_hits")) / (F.col("bins") / F.col("all_bins"))).alias("ratio"))


def hit_rates(hits: DataFrame, possible: DataFrame, by: list[str]) -> DataFrame:
    """Positions hit over possible positions, by contig (and sample); ``possible`` has chrom, bases."""
    seen = hits.groupBy(*by).agg(F.count(F.lit(1)).alias("seen"))
    return seen.join(possible, "chrom").withColumn("rate", F.col("seen") / F.col("bases"))


def bin_size(rates: DataFrame, target: int = 100) -> DataFrame:
    """floor(target / median rate) over all contigs and samples: one row."""
    return rates.agg(F.floor(target / F.median("rate")).cast("int").alias("bin_size"))


def fragment_mean(reads: DataFrame) -> DataFrame:
    """Mean over contigs of the mean positive fragment length; contigs without any do not count."""
    means = reads.filter("frag_len > 0").groupBy("chrom").agg(F.avg("frag_len").alias("m"))
    return means.agg(F.avg("m").alias("mean_fragment"))


def set_bases(marked: DataFrame, regions: DataFrame) -> DataFrame:
    """Marked positions inside regions by contig, none twice where regions overlap."""
    merged = iv.merge_intervals(regions).select("chrom", "start_pos", "end_pos")
    return iv.points_in(marked, merged).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


def pileup(reads: DataFrame, sites: DataFrame, min_mapq: int = 3) -> DataFrame:
    """Reads over sites through their alignment: blocks (array of op, len) explode to matched stretches.

    M consumes read and reference, S and I the read, D the reference; a read with any other
    operation counts nowhere. Returns the site with the offset of its base in the read.
    """
    zero = F.struct(F.lit(0).alias("q"), F.lit(0).alias("r"), F.array().cast("array<struct<q:int,r:int,len:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        match = x["op"] == "M"
        piece = F.struct(acc["q"].alias("q"), acc["r"].alias("r"), x["len"].alias("len"))
        return F.struct(
            (acc["q"] + F.when(x["op"].isin("M", "S", "I"), x["len"]).otherwise(0)).alias("q"),
            (acc["r"] + F.when(x["op"].isin("M", "D"), x["len"]).otherwise(0)).alias("r"),
            F.when(match, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"),
        )

    plain = F.forall("cigar", lambda x: x["op"].isin("M", "S", "I", "D"))
    good = reads.filter(plain & (F.col("mapq") > min_mapq))
    blocks = good.withColumn("b", F.explode(F.aggregate("cigar", zero, step, lambda a: a["out"])))
    spans = blocks.select(
        "read_id", "chrom", (F.col("pos") + F.col("b.r")).alias("start_pos"),
        (F.col("pos") + F.col("b.r") + F.col("b.len")).alias("end_pos"), F.col("b.q").alias("q"),
    )
    hits = iv.points_in(sites, spans)
    return hits.withColumn("read_offset", F.col("q_r") + F.col("pos") - F.col("start_pos_r")).withColumnRenamed("read_id_r", "read_id")


def b_allele_frequency(ref: Column, alt: Column, ref_count: Column, alt_count: Column) -> Column:
    """Share of the allele that stands later in A, T, G, C; null at depth 0 or where an allele is '.'."""
    order = F.array(*map(F.lit, BASE_ORDER))
    depth = ref_count + alt_count
    first = F.array_position(order, F.upper(ref)) <= F.array_position(order, F.upper(alt))
    share = F.when(first, alt_count / depth).otherwise(ref_count / depth)
    return F.when((depth >= 1) & (ref != ".") & (alt != "."), share)


def minor_frequency(frequency: Column) -> Column:
    """A frequency folded at one half."""
    return F.when(frequency > 0.5, 1 - frequency).otherwise(frequency)
