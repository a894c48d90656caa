"""Copy-number callers: nearest states for one sample, joint likelihoods for a family."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def phred(p: Column, cap: float) -> Column:
    """-10 log10 of a probability, at most ``cap``; 0, not -0, at one."""
    return F.least(F.lit(float(cap)), -10 * F.log10(F.greatest(p, F.lit(10 ** (-cap / 10))))) + F.lit(0.0)


def logistic_q(features: list[Column], weights: list[float], intercept: float, most: int = 60) -> Column:
    """Rounded quality from a logistic model whose weights the caller gives; 1 to ``most``."""
    score = F.lit(float(intercept))
    for f, w in zip(features, weights, strict=True):
        score = score + f * w
    good = 1 / (1 + F.exp(-score))
    return F.greatest(F.lit(1), F.least(F.lit(most), F.round(-10 * F.log10(F.greatest(1 - good, F.lit(1e-6)))))).cast("int")


def transmission(highest: int = 4) -> list[tuple[int, int, float]]:
    """(parent copy number, passed on, probability): Poisson of mean max(cn / 2, 0.1), normed."""
    rows = []
    for cn in range(highest + 1):
        mean = max(cn / 2, 0.1)
        p = [math.exp(-mean) * mean**g / math.factorial(g) for g in range(highest + 1)]
        rows += [(cn, g, x / sum(p)) for g, x in enumerate(p)]
    return rows


def coverage_likelihoods(segments: DataFrame, table: DataFrame, mean_depth: DataFrame) -> DataFrame:
    """(sample, key columns, cn, p): the likelihood of each state at the segment's median, which is
    rounded half to even and capped at three times the sample's mean. A depth beyond ``table`` is an error."""
    capped = segments.join(F.broadcast(mean_depth), "sample").withColumn(
        "depth", F.bround(F.least(F.col("median_cnt"), 3 * F.col("mean_depth")), 0).cast("int")
    )
    known = capped.join(table, ["sample", "depth"], "left")  # its size decides how it is joined
    missing = F.raise_error(F.lit("a segment's depth lies beyond the table of likelihoods"))
    return known.withColumn("p", F.when(F.col("p").isNull(), missing).otherwise(F.col("p")))


def trio_calls(likelihoods: DataFrame, roles: dict[str, str], key: list[str], highest: int = 4, cap: float = 100.0) -> DataFrame:
    """Joint calls of a trio: per key the most likely copy numbers, each with a quality, and dq.

    ``likelihoods`` has sample, cn, p for every key. The likelihood of a triple is
    L(mother) * L(father) * sum over what they pass on of T * T, times L(child). dq is the Phred
    quality, doubled and capped, of the child's new call: for a gain
    1 - G / (T - L), for a loss 1 - L / (T - G), where T is the sum of all triples and G and L sum
    those in which the child alone is above or below two copies.
    """
    t = {}
    for mother, g1, t1 in transmission(highest):
        for father, g2, t2 in transmission(highest):
            if g1 + g2 <= highest:
                t[mother, father, g1 + g2] = t.get((mother, father, g1 + g2), 0.0) + t1 * t2
    named = ("mother", "father", "child")
    triples = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(named, k, strict=True)], F.lit(v).alias("t")) for k, v in t.items()])

    def own(role: str) -> Column:
        return F.map_from_entries(F.collect_list(F.when(F.col("sample") == roles[role], F.struct("cn", "p")))).alias(f"p_{role}")

    wanted = likelihoods.filter(F.col("sample").isin([roles[r] for r in named]) & (F.col("cn") <= highest))
    each = wanted.groupBy(*key).agg(*[own(r) for r in named])
    for r in named:
        each = each.filter(F.size(f"p_{r}") > 0)
    scored = F.transform(triples, lambda x: F.struct(
        (F.col("p_mother")[x["mother"]] * F.col("p_father")[x["father"]] * F.col("p_child")[x["child"]] * x["t"]).alias("l"),
        (-x["mother"]).alias("m"), (-x["father"]).alias("f"), (-x["child"]).alias("c"),
    ))

    def summed(test) -> Column:
        return F.aggregate("scored", F.lit(0.0), lambda a, x: a + F.when(test(x), x["l"]).otherwise(0.0))

    joint = each.withColumn("scored", scored).select(
        *key, *[f"p_{r}" for r in named], F.array_max("scored").alias("top"), summed(lambda x: F.lit(True)).alias("total"),
        summed(lambda x: (x["c"] < -2) & (x["m"] >= -2) & (x["f"] >= -2)).alias("g"),
        summed(lambda x: (x["c"] > -2) & (x["m"] <= -2) & (x["f"] <= -2)).alias("s"),
    )
    joint = joint.select(*key, (-F.col("top.m")).alias("mother"), (-F.col("top.f")).alias("father"), (-F.col("top.c")).alias("child"), "total", "g", "s", "p_mother", "p_father", "p_child")

    def quality(role: str) -> Column:
        p = F.col(f"p_{role}")
        whole = F.aggregate(F.map_values(p), F.lit(0.0), lambda x, y: x + y)
        return phred(1 - p[F.col(role)] / whole, cap)

    new = F.when((F.col("child") > 2) & (F.col("mother") <= 2) & (F.col("father") <= 2), 1 - F.col("g") / (F.col("total") - F.col("s")))
    new = new.when((F.col("child") < 2) & (F.col("mother") >= 2) & (F.col("father") >= 2), 1 - F.col("s") / (F.col("total") - F.col("g")))
    return joint.select(
        *key, "mother", "father", "child", *[quality(r).alias(f"q_{r}") for r in ("mother", "father", "child")],
        F.when(new.isNotNull(), F.least(F.lit(float(cap)), 2 * phred(F.greatest(new, F.lit(1e-6)), 60))).alias("dq"),
    )


def roles_of(samples: dict[str, str]) -> dict[str, str] | None:
    """Role -> sample of a full trio: exactly one mother, father and proband; else None."""
    found: dict[str, list[str]] = {}
    for sample, role in samples.items():
        found.setdefault(role, []).append(sample)
    if all(len(found.get(r, [])) == 1 for r in ("mother", "father", "proband")):
        return {"mother": found["mother"][0], "father": found["father"][0], "child": found["proband"][0]}
    return None


def shared_variant(child: Column, mother: Column, father: Column, ref: Column) -> Column:
    """Whether the child's change from the reference is on the same side as one of a parent's."""
    def same(parent: Column) -> Column:
        return ((child > ref) & (parent > ref)) | ((child < ref) & (parent < ref))

    return same(mother) | same(father)


def site_likelihoods(sites: DataFrame, key: list[str], highest: int = 4, error: float = 0.01) -> DataFrame:
    """Per segment and genotype (cn, b copies of the alternate allele): mean log likelihood of its sites.

    Each site is binomial in its alternate reads with share b / cn, errors mixed in; sites are
    heterozygous for one in three, else homozygous.
    """
    spark = sites.sparkSession
    genotypes = spark.createDataFrame([(cn, b) for cn in range(1, highest + 1) for b in range(cn // 2 + 1)], "cn int, b int")
    pairs = sites.crossJoin(F.broadcast(genotypes))  # a dozen genotypes
    n, k = F.col("ref_count") + F.col("alt_count"), F.col("alt_count")

    def binomial(p: Column) -> Column:
        return F.exp(k * F.ln(p) + (n - k) * F.ln(1 - p))

    share = F.greatest(F.lit(error), F.least(F.lit(1 - error), F.col("b") / F.col("cn")))
    mixed = (binomial(share) + binomial(1 - share)) / 6 + (binomial(F.lit(error)) + binomial(F.lit(1 - error))) / 3
    return pairs.filter(n > 0).groupBy(*key, "cn", "b").agg(F.avg(F.ln(F.greatest(mixed, F.lit(1e-300)))).alias("log_l"), F.count(F.lit(1)).alias("sites"))


def major_count(likelihoods: DataFrame, called: DataFrame, key: list[str], cap: float = 60.0) -> DataFrame:
    """Major chromosome count of each call: the likeliest genotype of its copy number, with a quality."""
    own = called.select(*key, "cn").join(likelihoods, [*key, "cn"])
    w = Window.partitionBy(*key).orderBy(F.desc("log_l"), "b")
    ranked = own.withColumns({"n": F.row_number().over(w), "gap": F.col("log_l") - F.lead("log_l").over(w)})
    best = ranked.filter("n = 1")
    quality = F.least(F.lit(cap), F.coalesce(F.col("gap") * F.col("sites") * 10 / F.ln(F.lit(10.0)), F.lit(cap)))
    return best.select(*key, "cn", (F.col("cn") - F.col("b")).alias("mcc"), F.round(quality, 6).alias("mcc_q"))


def best_alternative(scored: DataFrame, region: list[str]) -> DataFrame:
    """Of alternative sets of segments (column alt) in a region the one of the highest summed log likelihood."""
    sums = scored.groupBy(*region, "alt").agg(F.sum("log_l").alias("log_l"))
    w = Window.partitionBy(*region).orderBy(F.desc("log_l"), "alt")
    return sums.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def snv_purity(sites: DataFrame, least: int = 100) -> DataFrame:
    """Twice the median allele share below one half; null with fewer than ``least`` sites."""
    share = F.col("alt_count") / (F.col("ref_count") + F.col("alt_count"))
    low = sites.filter((F.col("ref_count") + F.col("alt_count") > 0) & (share < 0.5) & (F.col("alt_count") > 0)).select(share.alias("v"))
    return low.agg(F.count(F.lit(1)).alias("sites"), F.when(F.count(F.lit(1)) >= least, 2 * F.median("v")).alias("purity"))
