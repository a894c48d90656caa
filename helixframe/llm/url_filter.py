"""URL filtering by host reputation, shrunk from host to registered domain to suffix.

Labelled page outcomes are counted per host. Each level's beta-binomial prior is the posterior mean of
the level above: host <- registered domain <- suffix <- all. The concentration of the priors is
estimated from the hosts by the method of moments. A page is blocked where the lower posterior bound
of its host's rate of bad pages exceeds ``max_bad`` and rests on labelled pages of its host, domain or
suffix; without any such page it is allowed. Stated rules go before the reputation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import heavy_join, materialize

#: The rules that the query applies, longest first wins.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


#: Suffixes of two labels below which domains are registered.
PUBLIC_SUFFIXES = (
    "co.uk", "org.uk", "me.uk", "ltd.uk", "plc.uk", "net.uk", "ac.uk", "gov.uk", "nhs.uk", "sch.uk", "com.au", "net.au", "org.au",
    "edu.au", "gov.au", "id.au", "co.nz", "net.nz", "org.nz", "ac.nz", "govt.nz", "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp", "co.kr",
    "or.kr", "ac.kr", "go.kr", "com.cn", "net.cn", "org.cn", "edu.cn", "gov.cn", "com.tw", "org.tw", "edu.tw", "com.hk", "org.hk",
    "edu.hk", "com.sg", "edu.sg", "com.my", "co.id", "or.id", "ac.id", "co.th", "ac.th", "com.ph", "com.vn", "co.in", "net.in",
    "org.in", "ac.in", "gov.in", "com.pk", "com.bd", "com.tr", "org.tr", "edu.tr", "gov.tr", "co.il", "org.il", "ac.il", "com.sa",
    "com.eg", "co.za", "org.za", "ac.za", "gov.za", "co.ke", "com.ng", "com.br", "net.br", "org.br", "gov.br", "edu.br", "com.ar",
    "org.ar", "edu.ar", "com.mx", "org.mx", "gob.mx", "edu.mx", "com.co", "com.pe", "com.ve", "com.uy", "com.ec", "com.ua", "com.pl",
    "net.pl", "org.pl", "edu.pl", "com.pt", "com.gr", "com.ru", "co.at", "or.at", "ac.at", "com.es", "org.es", "gob.es", "asso.fr",
    "gouv.fr", "com.fr", "co.hu",
)


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z lower-cased; '' without ://."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; '' without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null where none fits."""
    fits = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, _, tail = rule.partition("/")
        test = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(test, value) if fits is None else fits.when(test, value)
    return fits


def suffix_of(host: Column, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> Column:
    """The last two labels of a host where they are in ``suffixes``, else the last one."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(suffixes)), two).otherwise(F.substring_index(host, ".", -1))


def registered_domain(host: Column, suffixes: tuple[str, ...] = PUBLIC_SUFFIXES) -> Column:
    """The suffix of a host and the label before it; the host itself where it has no more."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(suffixes)), F.substring_index(host, ".", -3)).otherwise(two)


def host_reputation(outcomes: DataFrame, hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """Per row of ``hosts`` (host, other columns): posterior mean and bounds of its rate of bad pages.

    evidence is the number of labelled pages of its host, domain and suffix, each level's own.

    ``outcomes`` has host and bad (0/1), one row per labelled page; rows with a null outcome are
    left out. Counts are aggregated before any join. Without any outcome every rate is 1/2 with the
    widest bounds.
    """
    counts = outcomes.filter(F.col("bad").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("bad").cast("double").alias("k")
    )
    counts = materialize(counts, "counts")
    moments = counts.agg(
        F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).cast("double").alias("g"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).first()
    rate, strength = prior_of(moments["n"] or 0.0, moments["k"] or 0.0, moments["g"], moments["kk"] or 0.0, moments["nn"] or 0.0)
    c = F.lit(strength)
    levels = counts.withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix_of(F.col("host"))})
    suffixes = levels.groupBy("suffix").agg(
        ((F.sum("k") + c * rate) / (F.sum("n") + c)).alias("suffix_mean"), F.sum("n").alias("sn")
    )
    domains = levels.groupBy("domain").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    named = hosts.withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix_of(F.col("host"))})
    joined = (
        named.join(counts, "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
        .fillna(0.0, ["n", "k", "dn", "dk", "sn"]).fillna(rate, ["suffix_mean"])
        .withColumn("domain_mean", (F.col("dk") + c * F.col("suffix_mean")) / (F.col("dn") + c))
    )
    mean = (F.col("k") + c * F.col("domain_mean")) / (F.col("n") + c)
    spread = F.sqrt(F.col("bad_mean") * (1 - F.col("bad_mean")) / (F.col("n") + c + 1))
    return joined.withColumn("bad_mean", mean).select(
        *[F.col(x) for x in hosts.columns], (F.col("n") + F.col("dn") + F.col("sn")).alias("evidence"), "n", "k", "domain_mean", "suffix_mean", "bad_mean",
        (F.col("bad_mean") - z * spread).alias("bad_low"), (F.col("bad_mean") + z * spread).alias("bad_high"),
    )


def prior_of(n: float, k: float, groups: float, kk: float, nn: float) -> tuple[float, float]:
    """Overall rate and prior concentration from the hosts' counts, by the method of moments.

    n, k: all labelled and all bad pages; kk: sum of k*k/n; nn: sum of n*n. The concentration is kept
    within 2 to 200 pages.
    """
    rate = (k + 1.0) / (n + 2.0)
    if groups < 2 or n <= groups:
        return rate, 10.0
    p = k / n
    between = kk - k * p
    scale = n - nn / n
    if p <= 0 or p >= 1 or scale <= groups - 1:
        return rate, 10.0
    rho = (between / (p * (1 - p)) - (groups - 1)) / (scale - (groups - 1))
    return rate, min(200.0, max(2.0, 1.0 / rho - 1.0 if rho > 0 else 200.0))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url",
    rules: tuple = RULES, max_bad: float = 0.2, z: float = 1.645,
) -> DataFrame:
    """Per page: id, host, path, rule, verdict, and its host's bad_mean and bad_low.

    ``outcomes`` has the pages' id column and bad (0/1); a page may have none or several. A null url
    or one without :// has an empty host and path; such pages share the reputation of the empty
    host. A page without labelled pages of its host, domain or suffix is allowed where no rule fits. Only id and url are read of ``pages``, so other columns may have any names. Repeated pages
    give repeated rows.
    """
    url = F.col(url_col)
    slim = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    labelled = slim.join(
        outcomes.select(F.col(id_col).alias("id"), F.col("bad").cast("double").alias("bad")), "id"
    ).select("host", "bad")
    reputation = materialize(
        host_reputation(labelled, slim.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), z), "hosts"
    ).select("host", "pages", "evidence", "bad_mean", "bad_low")
    total = reputation.agg(F.sum("pages")).first()[0] or 0
    judged = heavy_join(slim, reputation, "host", "pages", total)
    judged = judged.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules))
    own = F.when((F.col("bad_low") > max_bad) & (F.col("evidence") > 0), "block").otherwise("allow")
    return judged.select(
        F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", own).alias("verdict"), "bad_mean", "bad_low",
    )
