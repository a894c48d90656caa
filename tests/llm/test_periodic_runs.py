"""Periodic runs against brute force: the flat search, odd rows, and the registered query."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import periodic_runs, queries

from ..conftest import SMALL

SCHEMA = "doc_id long, text string, n_words long, runs string, start long, id string"


def brute(words, exponent=4, shortest=6):
    """Every maximal stretch of every period, with the least period of equal stretches."""
    least = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            at = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i + q - at >= max(shortest, exponent * q):
                least.setdefault((at, i + q - at), q)
    return sorted((at, n, q) for (at, n), q in least.items())


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(words, runs):
    dropped = {i for at, n, q in runs for i in range(at + q, at + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def repeated(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=4), st.sampled_from([2, 3, 4]), st.sampled_from([1, 6]))
def test_runs_of_several_texts_equal_brute_force(docs, exponent, shortest):
    texts = [" ".join(f"w{x}" for x in d).encode() for d in docs]
    got = list(periodic_runs._search(texts, exponent, shortest))
    for d, (n, runs, stays) in zip(docs, got, strict=True):
        assert n == len(d)
        assert runs == brute(d, exponent, shortest)
        assert stays.decode() == collapsed([f"w{x}" for x in d], runs)


def test_long_periods_and_many_squares():
    r = random.Random(8)
    piece = [r.randrange(50) for _ in range(700)]
    words = [r.randrange(9) for _ in range(300)] + piece * 5 + [r.randrange(3) for _ in range(400)] + [1] * 3000 + [2, 3] * 900
    texts = [" ".join(map(str, words)).encode()]
    assert next(periodic_runs._search(texts, 4, 6))[1] == brute(words)


def test_suffix_array_sorts_what_repeats():
    words = np.array([-1, 0, 1, 0, 1, 0, 2, -1, 3, 3, 3, -1])
    order, inverse, lcp = periodic_runs.suffix_array(words, 1)
    texts = {i: tuple(words[i:].tolist())[: words[i:].tolist().index(-1)] for i in order}
    assert sorted(order.tolist()) == [1, 2, 3, 4, 5, 6, 8, 9, 10]
    assert [texts[i] for i in order] == sorted(texts.values())
    assert all(inverse[i] == k for k, i in enumerate(order))
    for a, b, n in zip(order, order[1:], lcp[1:], strict=False):
        common = next((k for k, (x, y) in enumerate(zip(texts[a], texts[b], strict=False)) if x != y), min(len(texts[a]), len(texts[b])))
        assert n == common


@pytest.mark.parametrize("step", [-1, 1])
@pytest.mark.parametrize("equal", [False, True])
def test_nearest_smaller_values(monkeypatch, step, equal):
    monkeypatch.setattr(periodic_runs, "JUMPS", 2)  # so that the table of minima is used
    r = np.random.default_rng(3)
    for values in (r.integers(0, 9, 300), np.arange(200), np.arange(200)[::-1], np.full(100, 5)):
        lcp = np.r_[0, values, 0]
        at = np.flatnonzero(lcp > 0)
        got = periodic_runs._nearest(lcp, at, step, equal)
        for i, j in zip(at.tolist(), got.tolist(), strict=True):
            k = i + step
            while not (lcp[k] <= lcp[i] if equal else lcp[k] < lcp[i]):
                k += step
            assert j == k


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "x y " * 4), (5, "x y " * 4), (None, "b\x0bb\x0cb b\tb\nb"), (6, "s" * 300_000), (7, "lo ng " * 60_000), (8, "é é é é é é ü")]
    df = spark.createDataFrame([(i, t, 1, "r", 2, "x") for i, t in rows], SCHEMA)
    got = periodic_runs.find_runs(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id)
        w = words_of(text)
        want = [(0, len(w), 2)] if r.doc_id == 7 else brute(w)
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(w), want, collapsed(w, want))
    assert periodic_runs.find_runs(df.filter("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(df, exponent=1)


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.QUERIES["op12_periodic_runs"](spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    checked = 0
    for r in got:
        words = repeated(r.doc_id, words_of(texts[r.doc_id]))
        if len(words) > 2500:
            continue  # too long for brute force
        checked += 1
        runs = brute(words)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, r.n_words) == (len(runs), len(words))
        assert (r.start, r.length, r.period, r.exponent_milli) == (*best, 1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert checked > 0.9 * len(texts)
