"""Threshold-scaled sketches against brute force and against exact similarities."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from helixframe.llm import fingerprints, queries

from ..conftest import SMALL, rows_of

SCHEMA = "doc_id long, text string, id string, t string, bucket int, row long, fingerprint string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, "z") for i, t in rows], SCHEMA)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(text, fraction=1 / 8):
    hashes = sorted({hashlib.md5(s.encode()).hexdigest()[:16] for s in shingles(text)})
    return [h for h in hashes if int(h, 16) < fraction * 2**64] or hashes[:1]


def like(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        e = t[: len(t) - half] + u[:half]
        s, es, ns = brute(t), brute(e), brute(u)
        share = (lambda a, b: len(set(a) & set(b)) / len(a) if a else 1.0)
        yield (i, len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(s), "".join(es), like(s, es), like(s, ns), share(s, es), share(s, ns))


def found(df):
    return [tuple(r) for r in df.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "kept_in_edited", "kept_in_next").collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple(("" if x is None else f"{x:.12f}" if isinstance(x, float) else str(x)) for x in r))


def odd_rows():
    r = random.Random(2)
    words = ["".join(r.choices("abcdeé😀", k=4)) for _ in range(300)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randint(1, 300))) for i in range(60)]
    rows += [(3, "tie of an id"), (3, "tie of an id"), (3, text(50)), (None, text(90)), (None, None), (200, ""), (201, " \t\n"), (202, "one"), (203, None)]
    return rows + [(300, text(40_000)), (301, rows[5][1]), (302, rows[5][1])] + [(303, rows[7][1])] * 40


def test_pairs_of_odd_rows_equal_brute_force(spark):
    rows = odd_rows()
    assert ordered(found(fingerprints.edited_pairs(frame(spark, rows)))) == ordered(expected(rows))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_pairs_of_few_rows(spark, n):
    rows = [(5, "a b c d e f g"), (4, "x")][:n]
    assert ordered(found(fingerprints.edited_pairs(frame(spark, rows)))) == ordered(expected(rows))


def test_query_equals_sql(spark, duck):
    got = queries.QUERIES["op11_fingerprints"](spark, SMALL).toPandas()
    want = duck.execute(queries.ORACLES["op11_fingerprints"]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_fingerprints_and_unions(spark):
    rows = odd_rows()
    got = fingerprints.fingerprint_documents(frame(spark, rows)).collect()
    assert sorted((r.fingerprint, r.n_kept) for r in got) == sorted(("".join(brute(t)), len(brute(t))) for _, t in rows)
    assert fingerprints.fingerprint_documents(frame(spark, [])).count() == 0
    pair = spark.createDataFrame([("a b c d e f", "x y z"), ("", "one"), ("", ""), ("p q", "p q")], "a string, b string")
    s, t = (fingerprints.sketch(F.col(c)) for c in "ab")
    unions = pair.select("a", "b", fingerprints.merged(s, t).alias("m"), fingerprints.read(fingerprints.written(s)).alias("again"), s.alias("s")).collect()
    for r in unions:
        hashes = sorted({hashlib.md5(x.encode()).hexdigest()[:16] for x in shingles(r.a) | shingles(r.b)})
        low = [h for h in hashes if h < fingerprints.limit_of(1 / 8)]
        stands = sorted({h for x in (r.a, r.b) for h in brute(x)})
        assert r.m == ([h for h in stands if h < fingerprints.limit_of(1 / 8)] or stands[:1]) == (low or hashes[:1])
        assert r.again == r.s
    with pytest.raises(ValueError):
        fingerprints.limit_of(1.5)


def test_a_short_text_inside_a_long_one_is_found(spark):
    r = random.Random(9)
    words = [str(r.randrange(10**6)) for _ in range(20_000)]
    part, half = words[5000:5400], words[900:1100] + [str(-i) for i in range(200)]
    df = spark.createDataFrame([(" ".join(part), " ".join(words)), (" ".join(half), " ".join(words))], "a string, b string")
    a, b = (fingerprints.sketch(F.col(c)) for c in "ab")
    got = df.select(fingerprints.containment(a, b).alias("c"), fingerprints.likeness(a, b).alias("j")).collect()
    assert got[0].c == 1.0 and got[0].j < 0.05
    assert abs(got[1].c - 0.5) < 0.15


def test_main_path_has_no_python(spark):
    plan = queries.QUERIES["op11_fingerprints"](spark, SMALL)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
