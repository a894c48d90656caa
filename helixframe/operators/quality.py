"""Quality scores of segments and what they are predicted from; weights are parameters of the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Copy number from which the number of bins counts as a predictor of its own (fixed value).
AMPLIFIED = 15


def predictors(segments: DataFrame) -> DataFrame:
    """``segments`` with the fourteen predictors of their quality.

    Reads counts and freqs (arrays of numbers), cn, mcc (may be null), distance and runner_up. Means and
    coefficients of variation of empty or all-zero arrays are 0; so is a ratio to a runner-up of 0.
    """
    def mean(v: str) -> Column:
        return F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).otherwise(0.0)

    def variation(v: str) -> Column:
        m = mean(v)
        squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
        return F.when((F.size(v) > 1) & (m != 0), F.sqrt(squares / (F.size(v) - 1)) / m).otherwise(0.0)

    cn = F.col("cn").cast("double")
    out = segments.withColumns({"bin_count": F.size("counts").cast("double"), "bin_mean": mean("counts"), "bin_cv": variation("counts")})
    out = out.withColumns({"maf_count": F.size("freqs").cast("double"), "maf_mean": mean("freqs"), "maf_cv": variation("freqs")})
    return out.withColumns({
        "log_bin_count": F.log10(1 + F.col("bin_count")), "log_maf_cv": F.log10(1 + F.col("maf_cv")),
        "amplified_bins": F.when(cn >= AMPLIFIED, F.log10(1 + F.col("bin_count"))).otherwise(0.0),
        "model_distance": F.col("distance") / F.greatest(F.lit(1.0), cn - 4), "runner_up_distance": F.col("runner_up"),
        "distance_ratio": F.when(F.col("runner_up") == 0, 0.0).otherwise(F.col("distance") / F.col("runner_up")),
        "copy_number": cn, "major_count": F.coalesce(F.col("mcc").cast("double"), F.ceil(cn / 2).cast("double")),
    })


def linear(weights: dict[str, float], intercept: float) -> Column:
    """Weighted sum of predictors."""
    score = F.lit(float(intercept))
    for name, w in weights.items():
        score = score + F.col(name) * w
    return score


def _phred(p: Column) -> Column:
    return -10 * F.log10(1 - p)


def logistic_quality(weights: dict[str, float], intercept: float, least: int = 2, most: int = 60) -> Column:
    """Rounded Phred quality of a logistic model; 2 to 60, or to 40 for germline calls."""
    odds = F.exp(linear(weights, intercept))
    return F.greatest(F.lit(least), F.least(F.lit(most), F.bround(_phred(odds / (odds + 1)), 0).cast("int")))


def bin_count_quality(a: float = 0.5532, b: float = 0.147, enough: int = 100, most: int = 61) -> Column:
    """Quality by the number of bins alone, ``most`` from ``enough`` bins on; the defaults are fixed values."""
    n = F.col("bin_count")
    fitted = F.round(_phred(1 / (1 + F.exp(a - n * b))), 0)
    return F.when(n >= enough, F.lit(most)).otherwise(fitted.cast("int"))


def linear_quality(weights: dict[str, float], intercept: float, shift: float = -11.9, slope: float = -11.4) -> Column:
    """Quality of a linear model, scaled to 2 to 61; scale and bounds are fixed values."""
    score = shift + slope * linear(weights, intercept)
    return F.round(F.greatest(F.lit(2.0), F.least(F.lit(61.0), score)), 0).cast("int")


def clonality(weights: dict[str, float], intercept: float) -> Column:
    """Probability that a segment is clonal, from its distance and its cluster's spread."""
    odds = F.exp(linear(weights, intercept))
    return odds / (odds + 1)


def heterogeneous(score: Column) -> Column:
    return F.coalesce(score < 0.5, F.lit(False))


def swap_states(calls: DataFrame, purity: float, ratio: float) -> DataFrame:
    """Calls of cn, second_cn and mcc after the swap of heterogeneous diploid ones, with ``swapped``.

    A heterogeneous call of two copies whose distance is over ``ratio`` of its runner-up's takes its
    second best number, where that is one or three and the purity is over 0.2; two is then its major count.
    """
    near = F.col("distance") / F.col("runner_up") > ratio
    swap = F.coalesce(F.col("heterogeneous") & F.lit(purity > 0.2) & near & (F.col("cn") == 2) & F.col("second_cn").isin(1, 3), F.lit(False))
    return calls.withColumn("swapped", swap).withColumns({
        "cn": F.when(F.col("swapped"), F.col("second_cn")).otherwise(F.col("cn")),
        "second_cn": F.when(F.col("swapped"), F.col("cn")).otherwise(F.col("second_cn")),
        "mcc": F.when(F.col("swapped"), 2).otherwise(F.col("mcc")),
    })


def high_copy_number(mean_count: Column, cn: Column, ref: Column, diploid: float, purity: float, most: int, weighting: float) -> Column:
    """struct(cn, distance) of calls at the greatest state ``most`` whose depth speaks for more, else null.

    Twice the ratio to the diploid depth is purity * cn + (1 - purity) * ref.
    """
    estimate = F.bround((2 * mean_count / diploid - ref * (1 - purity)) / purity, 0).cast("int")
    depth = diploid * ((1 - purity) + purity * estimate / 2)
    more = F.struct(estimate.alias("cn"), (F.abs(mean_count - depth) * weighting).alias("distance"))
    return F.when((cn == most) & (estimate > most), more)


def usable_segments(segments: DataFrame, least_sites: int, overall: float, least_length: int = 5000) -> DataFrame:
    """Segments that a model is fitted to, with coverage, maf and weight.

    Reads counts and freqs. Short ones, and those with over twice the overall median, go; maf is null
    with fewer than ``least_sites`` sites; fewer than ten sites lower the weight, which is the length.
    """
    length, sites = F.col("end_pos") - F.col("start_pos"), F.size("freqs")
    folded = F.array_sort(F.transform("freqs", lambda f: F.when(f > 0.5, 1 - f).otherwise(f)))
    ordered = F.array_sort("counts")
    half = F.floor(F.size("counts") / 2).cast("int")
    median = F.when(F.size("counts") % 2 == 1, F.get(ordered, half)).otherwise((F.get(ordered, half - 1) + F.get(ordered, half)) / 2)
    out = segments.withColumns({
        "coverage": median, "maf": F.when(sites >= least_sites, F.get(folded, F.floor(sites / 2).cast("int"))),
        "weight": length * F.least(F.lit(1.0), sites / 10),
    })
    return out.filter((length >= least_length) & (F.col("coverage") <= 2 * overall))


def pruned_frequencies(freqs: Column, lowest: float = 0.1) -> Column:
    """Folded frequencies above ``lowest`` where a segment shows real signal, else all of them.

    Signal: over a tenth of the frequencies positive, or one of 0.2 and more.
    """
    folded = F.transform(freqs, lambda f: F.when(f > 0.5, 1 - f).otherwise(f))
    positive = F.size(F.filter(folded, lambda f: f > 0))
    signal = (positive > 0.1 * F.size(freqs)) | F.exists(folded, lambda f: f >= 0.2)
    return F.when(signal, F.filter(folded, lambda f: f > lowest)).otherwise(folded)


def expected_diploid_frequency(depth: Column, a: float = 3.352, b: float = 0.4747) -> Column:
    """Expected minor allele share of two copies at a depth; the two numbers are fixed values of a fit."""
    return 0.5 - 1 / (a * F.pow(depth, F.lit(b)))


def folded_frequency(minor_depth: Column, depth: Column) -> Column:
    """Expected share of the lesser of two allele counts, binomial in the whole depth; 0 below depth 1."""
    n = F.floor(depth).cast("int")
    p = minor_depth / depth
    term = lambda i: F.least(i.cast("double"), depth - i) * F.exp(
        _log_factorial(n) - _log_factorial(i) - _log_factorial(n - i) + i * F.ln(p) + (n - i) * F.ln(1 - p)
    )
    summed = F.aggregate(F.sequence(F.lit(0), n), F.lit(0.0), lambda acc, i: acc + term(i))
    return F.when((depth < 1) | (minor_depth == 0), 0.0).otherwise(summed / depth)


def _log_factorial(n: Column) -> Column:
    """Sum of logarithms up to n."""
    return F.when(n < 2, 0.0).otherwise(F.aggregate(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), F.lit(0.0), lambda a, k: a + F.ln(k.cast("double"))))
