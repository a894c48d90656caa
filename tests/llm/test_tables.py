"""Exact dedup, near dedup, mixing, URL rules and quality rules against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import components, exact_dedup, jaccard_join, mixing, quality_rules, queries, shingles, url_filter

from ..conftest import SMALL, rows_of

SCHEMA = "doc_id long, text string, lang string, source string, digest string, keep_id int, id string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", "d", 1, "x") for i, t in rows], SCHEMA)


DOCS = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (None, "only null"), (5, "b"), (6, "b"), (7, "long " * 20000), (8, "long " * 20000)]


@pytest.mark.parametrize("capacity", [1, 2, 1000])
def test_exact_dedup_of_odd_rows(spark, capacity):
    got = exact_dedup.assign_exact(table(spark, DOCS), capacity=capacity).collect()
    groups = collections.defaultdict(list)
    for i, t in DOCS:
        groups[t or ""].append(i)
    assert len(got) == len(DOCS)
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [i for i in groups[text] if i is not None]
        assert (r.group_size, r.keep_id) == (len(groups[text]), max(ids) if ids else None)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.dedup_exact(table(spark, DOCS), capacity=capacity)
    assert kept.columns == table(spark, []).columns
    assert sorted((r.text or "")[:9] for r in kept.collect()) == sorted(t[:9] for t in groups)
    assert {r.doc_id for r in kept.collect()} == {2, 4, None, 6, 8}


def test_exact_dedup_of_an_empty_table(spark):
    assert exact_dedup.assign_exact(table(spark, [])).count() == 0
    assert exact_dedup.dedup_exact(table(spark, [])).count() == 0


def test_misra_gries_keeps_every_frequent_digest():
    import pandas as pd

    r = random.Random(3)
    rows = [bytes([b]) for b in r.choices(range(200), [40 if b < 5 else 1 for b in range(200)], k=5000)]
    out = pd.concat(exact_dedup.misra_gries((pd.DataFrame({"digest": rows[k : k + 500]}) for k in range(0, 5000, 500)), 20))
    counts = collections.Counter(rows)
    found = dict(zip(out["digest"], out["n"], strict=True))
    assert len(found) <= 20
    assert all(d in found for d, n in counts.items() if n > 5000 / 20)
    assert all(n <= counts[d] for d, n in found.items())


def near_copies(seed=5):
    """Families of near copies of several tightness, exact copies, short and odd texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefgh", k=r.randint(1, 7))) for _ in range(2000)]
    common = [r.choice(vocabulary) for _ in range(30)]
    texts = []
    for size, edits in ((12, 2), (30, 5), (7, 12), (3, 1), (25, 3)):
        base = [r.choice(vocabulary) for _ in range(120)]
        for _ in range(size):
            copy = list(base)
            for _ in range(r.randint(0, edits)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [" ".join(common + [r.choice(vocabulary) for _ in range(90)]) for _ in range(40)]
    texts += [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 60))) for _ in range(40)]
    texts += texts[:6] + ["", None, "  \n ", "one", "one", "one two three", "a b c d e", "a  b c\td e", " ".join(common)] + ["x y z w v u " * 500] * 2
    return texts


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if len(w) >= 5:
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    return frozenset([tuple(w)]) if w else frozenset()


def brute_links(texts):
    sets = [shingle_set(t) for t in texts]
    links, root = [0] * len(texts), list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    # two empty texts of one form are one row each; equal empty texts share a class of their text
    return links, [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("list_block,block", [(2048, 2048), (3, 6), (2, 9)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, list_block, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", list_block)
    texts = near_copies()
    got = {r.id: r for r in jaccard_join.similar_documents(table(spark, list(enumerate(texts))), block=block).collect()}
    links, classes = brute_links(texts)
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        if shingle_set(text):
            assert (got[i].links, got[i].win_id) == (links[i], classes[i]), i
        else:
            assert (got[i].links, got[i].copies, got[i].win_id) == (0, 1, i)


def test_one_of_each_class_stays(spark):
    texts = near_copies(6)
    df = table(spark, [*enumerate(texts), (0, texts[0]), (None, texts[0]), (900, "a lonely text of six words")])
    kept = jaccard_join.drop_similar(df)
    assert kept.columns == df.columns
    _, classes = brute_links(texts)
    ids = sorted(r.doc_id for r in kept.collect())
    want = {c for i, c in enumerate(classes)} | {900}
    assert ids == sorted(want)
    assert jaccard_join.drop_similar(df.filter("false")).count() == 0


def test_posterior_limit_rarely_drops_a_true_pair():
    least = jaccard_join.least_matches(64, 0.8, 1e-6)
    miss = sum(math.comb(64, m) * 0.8**m * 0.2 ** (64 - m) for m in range(least))
    assert least < 0.65 * 64 and miss < 1e-4


def test_shingles_and_minhashes():
    texts = [b"a b c d e f", b"", b"  ", b"a b", b"x" * 9, b"a b c d e a b c d e a b c d e"]
    hashes, bounds = shingles.shingle_sets(texts)
    assert np.diff(bounds).tolist() == [len(shingle_set(t.decode())) for t in texts]
    alone = [shingles.shingle_sets([t])[0].tolist() for t in texts]
    assert [hashes[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == alone
    r = np.random.default_rng(1)
    a = np.unique(r.integers(0, 2**63, 900, dtype=np.uint64))
    b = np.concatenate([a[:800], np.unique(r.integers(0, 2**63, 100, dtype=np.uint64))])
    both = np.concatenate([a, np.sort(b)])
    m = shingles.minhashes(both, np.array([0, len(a), len(both)]), 512)
    assert abs((m[0] == m[1]).mean() - 0.8) < 0.06


def test_words_hash_alike_wherever_they_stand():
    long = b"w" * 300_000
    word, _ = shingles.word_hashes([long])
    texts = [b"a " * 40_000, b"b " + long + b" a", b"", b"x a " + b"y" * (1 << 18) + b" b"]
    hashes, owner = shingles.word_hashes(texts)
    assert len(set(hashes[owner == 0].tolist())) == 1
    assert hashes[owner == 1].tolist() == [hashes[-1], word[0], hashes[0]]
    assert (owner == 2).sum() == 0 and hashes[owner == 3][1] == hashes[0]


def test_components_equal_brute_force(spark):
    r = random.Random(8)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert got == {n: find(n) for n in root}


def poisson_brute(u, mean):
    k, p = 0, math.exp(-mean)
    c = p
    while c <= u:
        k += 1
        p *= mean / k
        c += p
    return k


def test_poisson_counts(spark):
    rows = spark.range(4000).select(F.col("id"), mixing.hash_uniform(F.lit(3), F.col("id")).alias("u"))
    for mean in (0.05, 1.0, 7.5, 90.0):
        got = rows.withColumn("k", mixing.poisson_inverse(F.col("u"), F.lit(mean))).collect()
        assert all(r.k == poisson_brute(r.u, mean) for r in got)
        assert abs(np.mean([r.k for r in got]) - mean) < 5 * math.sqrt(mean / 4000)
    big = [r[0] for r in spark.range(300).select(mixing.poisson_count(1, F.col("id").cast("string"), F.lit(5000.0))).collect()]
    assert abs(np.mean(big) - 5000) < 25 and 40 < np.std(big) < 105


def test_mixture_meets_its_targets(spark):
    rows = [(i, "word " * (1 + i % 7), "a" if i % 10 else "b") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("unknown", 5.0)], "source string, weight double")
    out = mixing.mix_sources(df, targets).groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()
    sizes = {r.source: r.n for r in out}
    assert abs(sizes["a"] / sizes["b"] - 1) < 0.15
    once, again = (sorted(map(tuple, mixing.mix_sources(d, targets).collect())) for d in (df, df.repartition(5)))
    assert once == again


def test_mixture_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a", "x"), (2, "", None, "x"), (3, "abc", None, "x"), (None, "abcd", "b", "x"), (3, "abc", None, "x")], "doc_id long, text string, source string, rate string")
    out = mixing.mix_sources(df, total=100.0, bookkeeping=True)
    assert out.columns[:4] == df.columns
    by = collections.Counter(r.source for r in out.collect())
    assert by["a"] == 0 and by[None] > 3 and by["b"] > 3
    assert mixing.mix_sources(df.filter("false")).count() == 0


@pytest.mark.parametrize(
    "url,host,path,rule,verdict",
    [
        ("http://A.Example.ORG/es/1?x=/de/", "a.example.org", "/es/1", "example.org/es/", "block"),
        ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://example.org/en/2#/en/1", "example.org", "/en/2", "org/", "allow"),
        ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        ("x://a.com/de/1", "a.com", "/de/1", "com/de/", "block"),
        ("x://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
        ("x://com", "com", "", None, "allow"),
        ("x://é.COM?q=://b.org/", "é.com", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://", "", "", None, "allow"),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, "clash")], "page_id long, url string, host string")
    none = spark.createDataFrame([], "page_id long, bad int")
    r = url_filter.judge_urls(pages, none).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_reputation_shrinks_to_the_domain(spark):
    pages = [(i, f"http://{h}/p") for i, h in enumerate(["bad.x.net"] * 30 + ["good.y.net"] * 30 + ["new.x.net", "new.y.net"])]
    outcomes = [(i, 1 if i < 30 else 0) for i in range(60)]
    got = {r.host: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int")).collect()}
    assert got["bad.x.net"].verdict == "block" and got["good.y.net"].verdict == "allow"
    assert got["bad.x.net"].bad_mean > got["new.x.net"].bad_mean > got["new.y.net"].bad_mean > got["good.y.net"].bad_mean


def test_domains_below_public_suffixes_and_repeated_pages(spark):
    hosts = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("co.uk",), ("x.y.com",), ("com",), ("",)], "host string")
    got = hosts.select(url_filter.registered_domain(F.col("host")), url_filter.suffix_of(F.col("host"))).collect()
    assert [tuple(r) for r in got] == [("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("y.com", "com"), ("com", "com"), ("", "")]
    pages = spark.createDataFrame([(1, "http://h.net/a")] * 3000 + [(k, f"http://h{k}.org/") for k in range(2, 40)] + [(None, None)], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    assert url_filter.judge_urls(pages, none).count() == 3039
    assert url_filter.judge_urls(pages.filter("false"), none).count() == 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_brute(text):
    text = text or ""
    w = words_of(text)
    places = collections.defaultdict(list)
    for i in range(len(w) - 7):
        places[tuple(w[i : i + 8])].append(i)
    covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if words_of(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_base_measures_equal_brute_force(spark):
    r = random.Random(9)
    texts = [None, "", " \n\t ", "a " * 40, "x\ny\nx\n \nx ", "é𝄞 # <b> | & $ % *", " ".join(map(str, range(8))) + " " + " ".join(map(str, range(9)))]
    texts += [" ".join(r.choice("abc") for _ in range(r.randint(1, 60))) for _ in range(60)] + ["lorem ipsum dolor sit " * 5000]
    texts += [x.text for x in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = spark.createDataFrame([(i, t, ["en", None, "xx"][i % 3], 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, words int")
    for x in quality_rules.judge_quality(rows).collect():
        want = base_brute(texts[x.doc_id])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want, x.doc_id
        assert x.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (x.base_failed and x.kept)
    assert quality_rules.judge_quality(rows.filter("false")).count() == 0


def test_text_without_common_words_is_rejected(spark):
    r = random.Random(4)
    other = ["".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3)) for _ in range(800)]

    def text(lang, share):
        return " ".join(r.choice(quality_rules.COMMON_WORDS[lang]) if r.random() < share else r.choice(other) for _ in range(300))

    langs = sorted(quality_rules.COMMON_WORDS)
    ordinary = [(k, text(lang, r.uniform(0.17, 0.28)), lang) for k, lang in enumerate(langs * 40)]
    bare = [(1000 + k, text(lang, 0), lang) for k, lang in enumerate(langs * 2)]
    rows = spark.createDataFrame(ordinary + bare, "doc_id long, text string, lang string")
    got = quality_rules.judge_quality(rows).collect()
    assert all(x.kept == (x.doc_id < 1000) and not x.base_failed for x in got)
    assert all(x.kept for x in quality_rules.judge_quality(rows, max_common=0.45).collect())


def test_jensen_shannon(spark):
    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    row = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(
        quality_rules.jensen_shannon(F.col("p"), F.col("q")), quality_rules.jensen_shannon(F.col("p"), F.col("p"))
    ).first()
    assert row[0] == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2)) and row[1] == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SMALL).toPandas(), duck.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
