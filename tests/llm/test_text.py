"""Language ID, HTML extraction and the pipeline: held-out accuracy and defined odd cases."""

import html as html_lib
import itertools
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import crf, dom, html_extract, language_id, queries

from ..conftest import SMALL


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_id.train_text_model(docs.filter("doc_id % 2 = 0"))
    rest = docs.filter("doc_id % 2 = 1").withColumn("none", F.lit(None).cast("string"))
    out = language_id.identify_language(rest, declared_col="none", model=model, columns=["doc_id", "lang"]).collect()
    assert np.mean([r.lang == r.lang_found for r in out]) > 0.97
    assert np.mean([r.lang_kept for r in out]) > 0.97


def test_language_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = [(9001, None, "en", "s"), (9002, "", None, None), (9003, "### 123 %%%", "fr", "s"), (9004, "the of and " * 30000, None, None), (9001, None, "en", "s")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    full = docs.unionByName(odd).withColumns({"host": F.lit(1), "post": F.lit("x")})
    out = language_id.identify_language(full)
    assert out.columns == [*full.columns, "lang_found", "lang_probability", "lang_kept"]
    got = out.filter("doc_id > 9000").orderBy("doc_id").collect()
    assert [(r.doc_id, r.lang_found, r.lang_kept) for r in got] == [(9001, "und", False), (9001, "und", False), (9002, "und", False), (9003, "und", False), (9004, "en", True)]
    assert language_id.identify_language(full.filter("false")).count() == 0
    none = full.withColumn("lang", F.lit(None).cast("string"))
    assert not language_id.identify_language(none).filter("lang_kept").count()


def test_host_and_suffix_decide_a_short_text(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train_text_model(docs)
    rows = [(i, t, f"http://www.site.{s}/x") for i, (t, s) in enumerate([("ne te", "fr"), ("ne te", "de")])]
    pages = spark.createDataFrame(rows, "id long, text string, url string")
    out = language_id.identify_language(pages, declared_col=None, host_col=None, address_col="url", model=model).orderBy("id").collect()
    assert out[0].lang_probability != out[1].lang_probability


def fused(rows, model):
    """Probabilities of the languages of rows (text, declared, address), by plain numpy over all rows."""
    names = [*model.languages, "und"]
    hosts = [re.sub(r"^[^:]*://([^/?#]*).*$", r"\1", a).lower() for _, _, a in rows]
    domains = [".".join(h.split(".")[-2:]) for h in hosts]
    logs = model.evidence([t.encode() for t, _, _ in rows])
    post = np.exp(logs - logs.max(axis=1, keepdims=True))
    post /= post.sum(axis=1, keepdims=True)
    base = (post.sum(axis=0) + 1) / (post.sum() + len(names))
    shrunk = lambda own, above: (own + 20.0 * above) / (own.sum() + 20.0)
    of_domain = {d: shrunk(post[[x == d for x in domains]].sum(axis=0), base) for d in domains}
    of_host = {h: shrunk(post[[x == h for x in hosts]].sum(axis=0), of_domain[".".join(h.split(".")[-2:])]) for h in hosts}
    said = np.full((len(names), len(names)), 5.0)
    np.fill_diagonal(said, 15.0 * (len(names) - 1))
    known = [None if d is None else names.index(d) if d in model.languages else len(names) - 1 for _, d, _ in rows]
    for k, p in zip(known, post, strict=True):
        if k is not None:
            said[k] += p
    said = np.log(said / said.sum(axis=0, keepdims=True))
    out = []
    for k, row in enumerate(logs):
        row = row + np.log(of_host[hosts[k]]) + (0 if known[k] is None else said[known[k]])
        own = language_id.SUFFIX_LANGUAGES.get(hosts[k].split(".")[-1])
        row = row + np.array([np.log(4.0) if n == own else 0.0 for n in names])
        p = np.exp(row - row.max())
        out.append((names[int(p.argmax())], p.max() / p.sum()))
    return out


def test_fusion_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.train_text_model(docs)
    r = np.random.default_rng(3)
    words = [w for t in docs.limit(40).collect() for w in t.text.split() if w.isalpha()]
    hosts = ["A.site.fr", "b.site.fr", "site.de", "x.y.net", "y.net", "z.com"]
    rows = [
        (" ".join(r.choice(words, r.integers(1, 6))), [None, "en", "fr", "xx"][r.integers(4)], f"http://{hosts[r.integers(6)]}/p?q=1")
        for _ in range(300)
    ]
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "id long, text string, declared string, url string").repartition(3)
    out = language_id.identify_language(df, declared_col="declared", host_col=None, address_col="url", model=model).orderBy("id").collect()
    for got, (name, p) in zip(out, fused(rows, model), strict=True):
        assert abs(got.lang_probability - p) < 1e-6
        assert got.lang_found == name and got.lang_kept == (name != "und" and p >= 0.5)


def test_every_labelled_language_has_a_model(spark):
    r = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    rows = [(i, "".join(r.choice(letters[:9], 60)), "big") for i in range(3000)] + [(i, "the same text of ten thousand", "copies") for i in range(3000)]
    rows += [(9000 + i, "".join(r.choice(letters[9:], 60)), "rare") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train_text_model(docs, most_rows=30, most_of_one=5)
    assert model.languages == ("big", "copies", "rare")
    assert all(np.ptp(row) > 1 for row in model.logs[:-1])
    many = [(i, f"word{i % 80} " * 5, f"l{i % 80}") for i in range(160)]
    out = language_id.identify_language(spark.createDataFrame(many, "doc_id long, text string, lang string"), host_col=None)
    assert len({x.lang_found for x in out.collect()} - {"und"}) == 80
    with pytest.raises(ValueError):
        language_id.train_text_model(docs, most_languages=2)


def test_pages_are_judged_with_address_and_declared_language(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    bare = "<html{}><body><nav><a href=x>m</a></nav><article><p>Ne te ra.</p><p>Ne te ra lo.</p></article></body></html>"
    pages += [(9000 + k, f"http://x{k}.site.{s}/", bare.format(lang)) for k, (s, lang) in enumerate([("fr", ""), ("de", ""), ("zz", " lang='fr-CA'"), ("zz", " lang=de")])]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*pages, (9009, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = queries.op3_language_id(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted(r.doc_id for r in docs.collect())
    got = {r.page_id: r for r in out if r.doc_id is None}
    assert sorted(got) == sorted([p[0] for p in pages] + [9009])
    assert (got[9009].language, got[9009].kept) == ("und", False)
    assert len({got[k].probability for k in (9000, 9001)}) == 2
    assert got[9002][2:] != got[9003][2:]
    declared = [(re.search(r'<html lang="(..)"', html)[1], got[i].language) for i, _, html in pages if i < 9000]
    assert np.mean([a == b for a, b in declared]) > 0.97


def test_viterbi_and_training_equal_brute_force():
    r = np.random.default_rng(2)
    field = crf.Crf({"a": 0, "b": 1}, r.normal(size=(2, 2)), r.normal(size=2), r.normal(size=(2, 2)))
    rows = [["a"], ["b"], [], ["a", "b"], ["zzz"]]
    scores = field.scores(rows)

    def score(path):
        s = field.first[path[0]] + scores[0, path[0]]
        return s + sum(field.steps[path[t - 1], path[t]] + scores[t, path[t]] for t in range(1, len(path)))

    assert tuple(field.viterbi(rows)) == max(itertools.product((0, 1), repeat=5), key=score)
    assert field.viterbi([]) == []
    chains = [([["x"], ["y"], ["x"]], [0, 1, 0]), ([["y"], ["y"]], [1, 1])] * 4
    learnt = crf.train(chains, rounds=60)
    assert all(learnt.viterbi(rows) == labels for rows, labels in chains)


def test_field_on_held_out_pages():
    field = html_extract.trained_field()
    wrong = total = 0
    for page, labels in html_extract.labelled_pages(150, seed=77):
        got = field.viterbi(html_extract.describe(dom.leaf_blocks(page)))
        wrong += sum(a != b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert wrong / total < 0.02


@pytest.mark.parametrize(
    "page,texts",
    [
        ("", []),
        ("plain &amp; bare", ["plain & bare"]),
        ("<p>a<p>b<br>c</p>d", ["a", "b c", "d"]),
        ("<script>x='</p>'</script><style>p{}</style><!-- <p>no</p> --><p>y", ["y"]),
        ("<title>t</title><ul><li>1<li>2</ul>", ["1", "2"]),
        ("<p><b>open<br><p>next&nbsp; one</p>", ["open", "next one"]),
        ("<p>1 < 2 and <em>x</em>y</p><p", ["1 < 2 and xy"]),
        ("<div>a<div>b</div>c</div></div>", ["a", "b", "c"]),
        ("<p title='a>b'>q&lt;r</p><script>never closed", ["q<r"]),
    ],
)
def test_leaf_blocks(page, texts):
    assert [b.text for b in dom.leaf_blocks(page)] == texts


@pytest.mark.parametrize(
    "page,texts",
    [
        ("<p>Let <math><mi>x</mi><annotation>x</annotation></math> be.</p>", ["Let x be."]),
        ("<p>See <object data=x><b>this</b></object>.</p>", ["See this."]),
        ("<ul><li><div>a<blockquote>b<li>c</ul>d", ["a", "b", "c", "d"]),
        ("<p><a>x<i>y</a>z</i>", ["xyz"]),
    ],
)
def test_formulas_and_open_elements(page, texts):
    assert [b.text for b in dom.leaf_blocks(page)] == texts


def test_deep_pages_take_time_by_their_length():
    page = "<div class='content'>x" * 60_000 + "</b></q>" * 60_000
    began = time.process_time()
    blocks = dom.leaf_blocks(page, frozenset(html_extract.ROLES), html_extract.NAMES)
    assert len(blocks) == 60_000 and time.process_time() - began < 10
    assert blocks[-1].names == {"content"} and blocks[-1].inner == "div"


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "<i>" * 100_000 + "x" + "</b>" * 100_000, "<b>" * 25_000 + "<code class=content>y</b><hr>" * 25_000])
def test_misnested_pages_take_time_by_their_length(page):
    began = time.process_time()
    blocks = dom.leaf_blocks(page, frozenset(html_extract.ROLES), html_extract.NAMES)
    assert blocks and time.process_time() - began < 2


#: Pages written by hand in layouts of their own, with the article that a reader would keep.
WRITTEN = [
    ("""<!doctype html><html lang=en><head><title>Tides</title></head><body><header><a href=/>Home</a> <a href=/a>About us</a></header>
    <main><h1>How tides work</h1><p>The moon pulls on the sea, and the sea follows it around the world twice a day.</p>
    <p>Where the coast is narrow the water piles up, and the range may reach ten metres or more.</p></main>
    <footer><p>© 2020 The Tide Office. All rights reserved.</p></footer></body></html>""",
     ["How tides work", "The moon pulls on the sea, and the sea follows it around the world twice a day.", "Where the coast is narrow the water piles up, and the range may reach ten metres or more."]),
    ("""<html><body><div id="nav"><ul><li><a href=1>News</a><li><a href=2>Sport</a><li><a href=3>Weather</a></ul></div>
    <div class="post"><h2>A quiet harbour</h2><p>Nobody had seen the boats leave, but in the morning every berth was empty.</p>
    <p>By noon the first of them came back, loaded with herring and followed by gulls.</p></div>
    <div class="comments"><p>Great story! I love it.</p></div><div class="sidebar"><h3>Related</h3><a href=4>More harbours</a></div></body></html>""",
     ["A quiet harbour", "Nobody had seen the boats leave, but in the morning every berth was empty.", "By noon the first of them came back, loaded with herring and followed by gulls."]),
]


@pytest.mark.parametrize("page,want", WRITTEN)
def test_pages_written_by_hand(page, want):
    assert html_extract.extract(page, html_extract.trained_field()) == "\n\n".join(want)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_extract.extract_pages(pages).collect()}
    for row in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", row.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", html_lib.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " ")))).strip() for p in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(p for p in parts if p)
        assert got[row.page_id].text == want and got[row.page_id].n_chars == len(want)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<nav><a href=x>menu</a></nav>"), (3, "u", "<nav><a href=x>menu</a></nav>"), (4, "u", "<article>" + "<p>Some words of text.</p>" * 20000 + "</article>")]
    out = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [(r.page_id, r.url, r.n_chars) for r in out[:4]] == [(1, None, 0), (2, "u", 0), (3, "u", 0), (3, "u", 0)]
    assert out[4].text.count("\n\n") == 19999
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract_pages(none).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    now, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SMALL)
        if name != "bpe":
            assert out.columns == docs.columns
        path = spark.conf.get("spark.checkpoint.dir") + f"/t-{name}-{id(out)}"
        out.write.parquet(path)
        now = spark.read.parquet(path)
        counts.append(now.count())
    texts = docs.select("text").distinct().count()
    assert counts[1] == counts[0] and counts[2] == texts and counts[3] < counts[2]
    assert abs(counts[4] - counts[3]) < 5 * counts[3] ** 0.5 + 10 and counts[5] == counts[4]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(tuple, now.collect()))
