"""Phased genotypes: likelihoods of two haplotypes' copies from allele counts and depth, and a trio's joint call."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .callers import phred


def depth_table(spark: SparkSession, mean: float, size: float, highest: int = 4, deepest: int = 200) -> DataFrame:
    """One row: p[copies][depth], negative binomial of ``mean`` reads a copy, and lf, the log factorials.

    Depths run to twice ``deepest``. No copies count as a tenth of one.
    """
    def at(mu: float, k: int) -> float:
        return math.exp(math.lgamma(k + size) - math.lgamma(k + 1) - math.lgamma(size) + size * math.log(size / (size + mu)) + k * math.log(mu / (size + mu)))

    depths = range(2 * deepest + 1)
    p = [[at(max(c, 0.1) * mean, k) for k in depths] for c in range(highest + 1)]
    return spark.createDataFrame([(p, [math.lgamma(k + 1) for k in depths])], "p array<array<double>>, lf array<double>")


def phased_likelihoods(sites: DataFrame, key: list[str], table: DataFrame, highest: int = 4, deepest: int = 200, error: float = 0.01) -> DataFrame:
    """(key, a, b, log_l, sites): summed log likelihood of the sites for a and b copies of two haplotypes.

    A site of two present haplotypes is heterozygous with weight 2/3, in either order, and homozygous
    with 1/6 for either allele; of one it is homozygous. The lesser count of a homozygous site is
    error. Counts beyond ``deepest`` are read at it. Sites without a count do not count.

    All genotypes of a pair of counts are scored once, in a table that goes to the sites. Sites are
    shuffled once, and not at all where they are already dealt by a part of the key.
    """
    spark = sites.sparkSession
    pairs = [(a, b) for a in range(highest + 1) for b in range(highest + 1 - a)]
    genotypes = spark.createDataFrame(pairs, "a int, b int")
    x, y = (F.least(F.col(c), F.lit(deepest)).cast("int") for c in ("ref_count", "alt_count"))
    sized = spark.range((deepest + 1) ** 2).select(F.expr(f"cast(id div {deepest + 1} as int)").alias("x"), F.expr(f"cast(id % {deepest + 1} as int)").alias("y"))
    sized = sized.crossJoin(F.broadcast(genotypes)).crossJoin(F.broadcast(table))  # 15 genotypes, one row
    n = F.col("x") + F.col("y")

    def depth(copies: Column, k: Column) -> Column:
        return F.get(F.get("p", copies), k)

    ways = F.get("lf", n) - F.get("lf", F.col("x")) - F.get("lf", F.col("y"))
    wrong, good = math.log(error), math.log(1 - error)
    one = F.exp(ways + F.col("x") * wrong + F.col("y") * good) + F.exp(ways + F.col("y") * wrong + F.col("x") * good)
    total = depth(F.col("a") + F.col("b"), n)
    mixed = (depth(F.col("a"), F.col("x")) * depth(F.col("b"), F.col("y")) + depth(F.col("a"), F.col("y")) * depth(F.col("b"), F.col("x"))) / 3
    both, none = (F.col("a") > 0) & (F.col("b") > 0), (F.col("a") == 0) & (F.col("b") == 0)
    likelihood = F.when(none, total).when(both, mixed + total * one / 6).otherwise(total * one)
    least = F.lit(1e-300)
    scores = sized.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("a", "b", F.ln(F.greatest(likelihood, least)).alias("l")))).alias("v"))
    scores = scores.select("x", "y", F.transform("v", lambda g: g["l"]).alias("l"))
    rows = sites.filter("ref_count is not null and alt_count is not null").select(*key, x.alias("x"), y.alias("y"))
    rows = rows.join(F.broadcast(scores), ["x", "y"], "left")  # (deepest + 1) squared rows
    sums = rows.groupBy(*key).agg(*[F.sum(F.coalesce(F.get("l", F.lit(i)), F.ln(least))).alias(f"l{i}") for i in range(len(pairs))], F.count(F.lit(1)).alias("sites"))
    each = F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"l{i}").alias("log_l")) for i, (a, b) in enumerate(pairs)]))
    return sums.select(*key, "sites", each).select(*key, "a", "b", "log_l", "sites")


def with_coverage(phased: DataFrame, coverage: DataFrame, key: list[str]) -> DataFrame:
    """(key, a, b, log_l): mean log likelihood of the sites plus that of the depth, from ``coverage`` (key, cn, p).

    Loss of one haplotype with two copies of the other has the least likelihood of all, unless it is
    above that of one copy of each.
    """
    whole = Window.partitionBy(*key)

    def own(a: int, b: int) -> Column:
        return F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("log_l"))).over(whole)

    ends = phased.withColumns({"even": own(1, 1), "lost": F.greatest(own(0, 2), own(2, 0)), "lowest": F.min("log_l").over(whole)})
    single = ((F.col("a") == 0) & (F.col("b") == 2)) | ((F.col("a") == 2) & (F.col("b") == 0))
    rows = ends.withColumn("log_l", F.when(single & (F.col("even") >= F.col("lost")), F.col("lowest")).otherwise(F.col("log_l")))
    depth = coverage.select(*key, "cn", F.ln(F.greatest("p", F.lit(1e-300))).alias("log_p"))
    joined = rows.withColumn("cn", F.col("a") + F.col("b")).join(depth, [*key, "cn"])
    return joined.select(*key, "a", "b", (F.col("log_l") / F.col("sites") + F.col("log_p")).alias("log_l"))


def phased_trio(likelihoods: DataFrame, roles: dict[str, str], key: list[str], best: int = 5, de_novo: float = 1e-5, logs: bool = False, q_limit: float = 7.0, cap: float = 60.0) -> DataFrame:
    """The likeliest phased genotypes of a trio, a quality for each person, and dq of the child's new call.

    ``likelihoods`` has sample, key, a, b, log_l. Each person's ``best`` genotypes are tried. A child
    whose haplotypes both occur in a parent adds 1, any other ``de_novo`` (with ``logs`` their
    logarithms); likelihoods are compared at six decimals, ties go to fewer copies in the order
    mother, father, child. q compares a person's genotype with all of theirs. dq is given where the
    child is off two copies, neither parent is so on the same side, and all qualities reach ``q_limit``.
    """
    named = ("mother", "father", "child")
    rows = likelihoods.filter(F.col("sample").isin([roles[r] for r in named])).withColumn("l", F.round("log_l", 6))

    def own(role: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("sample") == roles[role], F.struct((-F.col("l")).alias("l"), "a", "b")))).alias(f"g_{role}")

    each = rows.groupBy(*key).agg(*[own(r) for r in named])
    for r in named:
        each = each.filter(F.size(f"g_{r}") > 0)
    kept, new = (math.log(x) if logs else x for x in (1.0, de_novo))

    def held(copies: Column, m: Column, f: Column) -> Column:
        return (copies == m["a"]) | (copies == m["b"]) | (copies == f["a"]) | (copies == f["b"])

    def triple(m: Column, f: Column, c: Column) -> Column:
        both = held(c["a"], m, f) & held(c["b"], m, f)
        score = F.round(-m["l"] - f["l"] - c["l"] + F.when(both, kept).otherwise(new), 6)
        return F.struct((-score).alias("l"), m.alias("m"), f.alias("f"), c.alias("c"))

    m, f, c = (F.slice(F.col(f"g_{r}"), 1, best) for r in named)
    triples = F.flatten(F.transform(m, lambda x: F.flatten(F.transform(f, lambda y: F.transform(c, lambda z: triple(x, y, z))))))
    joint = each.withColumn("triples", triples).withColumn("top", F.array_min(F.transform("triples", lambda t: F.struct(
        t["l"].alias("l"), *[F.struct(t[r]["a"].alias("a"), t[r]["b"].alias("b"), t[r]["l"].alias("l")).alias(r) for r in "mfc"]))))

    def copies(g: Column) -> Column:
        return g["a"] + g["b"]

    def quality(role: str, g: Column) -> Column:
        own_best = F.get(f"g_{role}", F.lit(0))["l"]
        whole = F.aggregate(f"g_{role}", F.lit(0.0), lambda s, x: s + F.exp(own_best - x["l"]))
        return phred(1 - F.exp(own_best - g["l"]) / whole, cap)

    def summed(test) -> Column:
        return F.aggregate("triples", F.lit(0.0), lambda s, t: s + F.when(test(t), F.exp(F.col("top.l") - t["l"])).otherwise(0.0))

    joint = joint.withColumns({
        "total": summed(lambda t: F.lit(True)),
        "up": summed(lambda t: (copies(t["c"]) > 2) & (copies(t["m"]) <= 2) & (copies(t["f"]) <= 2)),
        "down": summed(lambda t: (copies(t["c"]) < 2) & (copies(t["m"]) >= 2) & (copies(t["f"]) >= 2)),
    })
    out = [F.col(k) for k in key]
    for r, short in zip(named, "mfc", strict=True):
        g = F.col(f"top.{short}")
        out += [copies(g).alias(r), F.greatest(g["a"], g["b"]).alias(f"{r}_mcc"), quality(r, g).alias(f"q_{r}")]
    called = joint.select(*out, "total", "up", "down")
    gain = (F.col("child") > 2) & (F.col("mother") <= 2) & (F.col("father") <= 2)
    loss = (F.col("child") < 2) & (F.col("mother") >= 2) & (F.col("father") >= 2)
    left = F.when(gain, 1 - F.col("up") / (F.col("total") - F.col("down"))).when(loss, 1 - F.col("down") / (F.col("total") - F.col("up")))
    sure = F.least("q_mother", "q_father", "q_child") >= q_limit
    dq = F.when(sure & left.isNotNull(), F.least(F.lit(cap), 2 * phred(F.greatest(left, F.lit(1e-6)), 60)))
    return called.withColumn("dq", dq).drop("total", "up", "down")


def shared_phased(child: Column, one: Column, other: Column) -> Column:
    """Whether a child's haplotypes (structs of copies a, b) come one from each parent, in either order."""
    def has(copies: Column, parent: Column) -> Column:
        return (copies == parent["a"]) | (copies == parent["b"])

    return (has(child["a"], one) & has(child["b"], other)) | (has(child["a"], other) & has(child["b"], one))


def phased_family(likelihoods: DataFrame, mother: str, father: str, children: list[str], key: list[str], best: int | None = None, de_novo: float = 1e-5, logs: bool = False, q_limit: float = 7.0, cap: float = 60.0, ploidy: int = 2) -> DataFrame:
    """(key, sample, a, b, cn, mcc, q, dq, visited): the likeliest phased genotypes of parents and any number of children.

    ``likelihoods`` has sample, key, a, b, log_l. Each person's ``best`` genotypes are tried (five, or
    three with several children). A child whose haplotypes both occur in a parent adds 1, any other
    ``de_novo`` (with ``logs`` their logarithms). Likelihoods are compared at six decimals, ties go to
    fewer copies in the order mother, father, children.

    Given the parents the children do not depend on each other, so each takes its own best genotype
    and sums over joint states are products of sums. Pairs of parents are tried from the likeliest on;
    one is passed over when it with every child's best genotype would stay below what is found.
    ``visited`` counts the pairs that were not.

    q compares all genotypes of a person's copy number with all of theirs. A child has a dq where it
    is off ``ploidy``, its haplotypes are not one of each parent, all other children have ``ploidy``
    copies, and q is over ``q_limit`` for it and both parents. Keys without a likelihood of each
    person are left out.
    """
    people = [mother, father, *children]
    best = best or (3 if len(children) > 1 else 5)
    rows = likelihoods.filter(F.col("sample").isin(people)).withColumn("l", F.round("log_l", 6))
    each = rows.groupBy(*key).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("sample") == who, F.struct((-F.col("l")).alias("l"), "a", "b")))).alias(f"g{i}") for i, who in enumerate(people)
    ])
    for i in range(len(people)):
        each = each.filter(F.size(f"g{i}") > 0)
    tried = [F.slice(F.col(f"g{i}"), 1, best) for i in range(len(people))]
    kept, new = (math.log(x) if logs else x for x in (1.0, de_novo))

    def held(copies: Column, m: Column, f: Column) -> Column:
        return (copies == m["a"]) | (copies == m["b"]) | (copies == f["a"]) | (copies == f["b"])

    def cost(z: Column, m: Column, f: Column) -> Column:
        """What a child's genotype costs beside its parents': the negative log likelihood."""
        return z["l"] - F.when(held(z["a"], m, f) & held(z["b"], m, f), kept).otherwise(new)

    pairs = F.flatten(F.transform(tried[0], lambda m: F.transform(tried[1], lambda f: F.struct((m["l"] + f["l"]).alias("l"), m.alias("m"), f.alias("f")))))
    each = each.withColumn("pairs", F.array_sort(pairs))
    numbers = range(len(children))

    def answer(p: Column, i: int) -> Column:
        """The i-th child's best genotype for a pair of parents."""
        return F.array_min(F.transform(tried[i + 2], lambda z: F.struct(F.round(cost(z, p["m"], p["f"]), 6).alias("l"), z["a"].alias("a"), z["b"].alias("b"))))

    def plain(g: Column) -> Column:
        return F.struct(g["a"].alias("a"), g["b"].alias("b"))

    def state(p: Column) -> Column:
        found = F.transform(F.array(F.struct(*[answer(p, i).alias(f"c{i}") for i in numbers])), lambda c: F.struct(
            F.round(sum((c[f"c{i}"]["l"] for i in numbers), p["l"]), 6).alias("l"), plain(p["m"]).alias("m"), plain(p["f"]).alias("f"), *[plain(c[f"c{i}"]).alias(f"c{i}") for i in numbers]
        ))
        return F.get(found, F.lit(0))

    least = sum((F.get(f"g{i + 2}", F.lit(0))["l"] for i in numbers), F.lit(-kept * len(children)))
    first = F.struct(state(F.get("pairs", F.lit(0))).alias("top"), F.lit(1).alias("visited"))

    def search(found: Column, p: Column) -> Column:
        hopeless = F.round(p["l"] + least, 6) - 1e-6 > found["top"]["l"]
        return F.when(hopeless, found).otherwise(F.struct(F.least(found["top"], state(p)).alias("top"), (found["visited"] + 1).alias("visited")))

    others = F.slice("pairs", 2, F.greatest(F.size("pairs"), F.lit(1)))
    joint = each.withColumn("found", F.aggregate(others, first, search))

    def weight(i: int, p: Column, test) -> Column:
        """The sum of a child's likelihoods for a pair of parents over the genotypes that pass, against its best one."""
        top = F.get(f"g{i + 2}", F.lit(0))["l"] - kept
        return F.aggregate(tried[i + 2], F.lit(0.0), lambda s, z: s + F.when(test(z), F.exp(top - cost(z, p["m"], p["f"]))).otherwise(0.0))

    def copies(g: Column) -> Column:
        return g["a"] + g["b"]

    def summed(child: int | None, side: int) -> Column:
        """The sum over joint states; with a child those in which it alone is off the ploidy on this side."""
        def off(g: Column) -> Column:
            return copies(g) > ploidy if side > 0 else copies(g) < ploidy

        def one(s: Column, p: Column) -> Column:
            product = F.exp(F.get("pairs", F.lit(0))["l"] - p["l"])
            for i in numbers:
                product = product * weight(i, p, off if i == child else lambda z: F.lit(True))
            return s + (product if child is None else F.when(~off(p["m"]) & ~off(p["f"]), product).otherwise(0.0))

        return F.aggregate("pairs", F.lit(0.0), one)

    def quality(i: int, cn: Column) -> Column:
        top = F.get(f"g{i}", F.lit(0))["l"]

        def total(test) -> Column:
            return F.aggregate(f"g{i}", F.lit(0.0), lambda s, x: s + F.when(test(x), F.exp(top - x["l"])).otherwise(0.0))

        return phred(total(lambda x: copies(x) != cn) / total(lambda x: F.lit(True)), cap)

    chosen = [F.col("found.top.m"), F.col("found.top.f"), *[F.col(f"found.top.c{i}") for i in numbers]]
    sums = {"total": summed(None, 0)} | {f"up{i}": summed(i, 1) for i in numbers} | {f"down{i}": summed(i, -1) for i in numbers}
    scored = joint.withColumns(sums | {f"q{i}": quality(i, copies(g)) for i, g in enumerate(chosen)})

    def fresh(i: int) -> Column:
        g, total, up, down = chosen[i + 2], F.col("total"), F.col(f"up{i}"), F.col(f"down{i}")
        left = F.when(copies(g) > ploidy, 1 - up / (total - down)).otherwise(1 - down / (total - up))
        sure = F.least("q0", "q1", f"q{i + 2}") > q_limit
        alone = [copies(chosen[k + 2]) == ploidy for k in numbers if k != i]
        gate = (copies(g) != ploidy) & ~shared_phased(g, chosen[0], chosen[1]) & sure
        for test in alone:
            gate = gate & test
        return F.when(gate, F.least(F.lit(cap), 2 * phred(F.greatest(left, F.lit(1e-6)), 60)))

    out = [
        F.struct(F.lit(who).alias("sample"), g["a"].alias("a"), g["b"].alias("b"), copies(g).alias("cn"), F.greatest(g["a"], g["b"]).alias("mcc"), F.col(f"q{i}").alias("q"),
                 (fresh(i - 2) if i > 1 else F.lit(None).cast("double")).alias("dq"), F.col("found.visited").alias("visited"))
        for i, (who, g) in enumerate(zip(people, chosen, strict=True))
    ]
    return scored.select(*key, F.inline(F.array(*out)))
