"""BPE, token files and unigram counts against the tokenizers library and brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from helixframe.llm import bpe, queries, token_files, unigram_counts, word_store

from ..conftest import SMALL

PATH = public_tokenizers.path(queries.WORD_BPE)
ODD = [
    None, "", "   ", "<|startoftext|>a<|endoftext|>B", "<|ENDOFTEXT|> <|endoftext|>", "it's I'LL we'Re 'd''s", "a" * 3000,
    "ab" * 2000, "é ́e", "ΑΣ ΑΣ.", "İstanbul ẞ", "x\x1cy\x85z q　w", "###...!!", "日本語 한글 🙂", "1²½٣",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark):
    from pyspark.sql import functions as F

    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(3, ODD[3], "clash"), (None, "null id", "clash")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    given_ = spark.read.parquet(f"{SMALL}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("x").alias("ids"))
    return odd.unionByName(given_)


def test_words_in_any_batches(library):
    codec = bpe.WordBpe(PATH)
    r = random.Random(1)
    letters = "abAB zZ'sé́ÉÏSΣσİßẞ  \x1c\x85\x0b1²½٣日🙂.,!?#<|>&\t\n\r　’^ª'll're'd"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(800)]
    store = word_store.WordStore(codec.encode_words, np.uint32, capacity=500)
    got = [[] for _ in texts]
    for number, ids in word_store.encoded_pieces(store, [t.encode() for t in texts], most=700):
        got[number].append(ids)
    for text, parts in zip(texts, got, strict=True):
        ids = np.concatenate(parts)
        want = library.encode(text, add_special_tokens=False).ids
        assert list(ids) == want, repr(text)
        assert codec.decode(ids).decode() == library.decode(want, skip_special_tokens=False)


def test_digests_equal_the_library(spark, docs, library):
    got = sorted(map(tuple, bpe.bpe_digests(docs, PATH).collect()), key=str)
    want = []
    for doc_id, text, _ in docs.collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encode_and_decode_round_trip(spark, docs, library):
    texts = {(r.doc_id, r.text) for r in bpe.bpe_decode(bpe.bpe_encode(docs, PATH), PATH).collect()}
    for doc_id, text, _ in docs.collect():
        assert (doc_id, library.decode(library.encode(text or "", add_special_tokens=False).ids, skip_special_tokens=False)) in texts


def test_empty_tables(spark, docs):
    none = docs.filter("false")
    assert bpe.bpe_digests(none, PATH).count() == 0
    assert unigram_counts.count_tokens(none, public_tokenizers.path(queries.PIECES)).count() == 0
    folder, order = token_files.write_token_files(none, PATH, 2)
    assert order == [] and token_files.read_token_files(spark, folder, order).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 2**16), st.integers(0, 2**32 - 1)), max_size=70))
def test_coding_round_trip(values):
    x = np.array(values, np.uint32)
    control, data = token_files.pack(x)
    assert len(control) == -(-len(x) // 4)
    assert token_files.unpack(control, data, len(x)).tolist() == values
    lengths, read = token_files.read_block(token_files.write_block([len(x)], x))
    assert lengths.tolist() == [len(x)] and read.tolist() == values


def test_broken_blocks_are_refused():
    block = token_files.write_block([3], np.array([1, 2, 3], np.uint32))
    with pytest.raises(ValueError):
        token_files.read_block(block[:-1])
    with pytest.raises(ValueError):
        token_files.read_block(b"XXXX" + block[4:])


def test_token_files_equal_brute_force(spark, docs, library, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 5000)
    unique = docs.filter("doc_id is not null and doc_id != 3")
    folder, order = token_files.write_token_files(unique, PATH, 2)
    got = {r.id: (r.start, r.n, zlib.crc32(r.ids)) for r in token_files.read_token_files(spark, folder, order).collect()}
    start = 0
    for doc_id, text, _ in sorted(unique.collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[doc_id] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    counts = {}
    for _, text, _ in unique.collect():
        for i in [*library.encode(text or "", add_special_tokens=False).ids, 2]:
            counts[i] = counts.get(i, 0) + 1
    assert [counts[t] for t in order] == sorted(counts.values(), reverse=True)


def test_token_files_are_read_from_the_folder_alone(spark, docs, library):
    folder = token_files.write_token_files(docs, PATH, 2)[0]
    want = sorted([*library.encode(text or "", add_special_tokens=False).ids, 2] for _, text, _ in docs.collect())
    read = token_files.read_token_files(spark.newSession(), folder).collect()
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in read) == want
    empty = token_files.write_token_files(docs.filter("false"), PATH, 2)[0]
    assert token_files.read_token_files(spark, empty).count() == 0


def test_repeated_and_null_ids_keep_every_document(spark, docs):
    folder, order = token_files.write_token_files(docs, PATH, 2)
    rows = token_files.read_token_files(spark, folder, order).orderBy("start").collect()
    assert len(rows) == docs.count() and rows[0].id is None
    assert [r.start for r in rows] == np.cumsum([0, *[r.n for r in rows[:-1]]]).tolist()


def brute(scores, text):
    """Best score and count over all segmentations, longest last piece first on ties."""
    lowest, longest = min(scores.values()) - unigram_counts.UNKNOWN, max(map(len, scores))
    best = [(0.0, 0)]
    for e in range(1, len(text) + 1):
        top = None
        for s in range(max(0, e - longest), e):
            piece = text[s:e]
            if piece in scores:
                option = (best[s][0] + scores[piece], best[s][1] + 1)
            elif e - s == 1:
                option = (best[s][0] + lowest, best[s][1] + len(piece.encode()))
            else:
                continue
            if top is None or option[0] > top[0]:
                top = option
        best.append(top)
    return best[-1][1]


def test_unigram_counts_equal_brute_force(spark, docs):
    path = public_tokenizers.path(queries.PIECES)
    scores = unigram_counts.unigram_scores(path)
    got = sorted(map(tuple, unigram_counts.count_tokens(docs, path, scores=scores).collect()), key=str)
    cache, want = {}, []
    for doc_id, text, _ in docs.collect():
        words = [w.decode() for w in (text or "").encode().split()]
        for w in words:
            if w not in cache:
                cache[w] = brute(scores, unigram_counts.MARK + w)
        want.append((doc_id, len(words), sum(cache[w] for w in words)))
    assert got == sorted(want, key=str)


def segmentations(word, known):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in known or n == 1:
            for rest in segmentations(word[n:], known):
                yield [word[:n], *rest]


def test_expected_pieces_equal_all_segmentations():
    probs = {"a": 0.2, "b": 0.1, "ab": 0.3, "ba": 0.15, "aba": 0.25}
    for word in ("a", "abab", "aabba", "abazab", "zz"):
        want, total = {}, 0.0
        for parts in segmentations(word, probs):
            p = float(np.prod([probs.get(x, 1e-3) for x in parts]))
            total += p
            for x in parts:
                want[x] = want.get(x, 0.0) + p
        got = unigram_counts.expected_pieces(word, probs, 3, 1e-3)
        assert got == pytest.approx({x: p / total for x, p in want.items()})


def test_fit_raises_the_likelihood(spark):
    path = public_tokenizers.path(queries.PIECES)
    df = spark.createDataFrame([(i, f"the cat sat on the mat no {i % 7}") for i in range(300)], "doc_id long, text string")
    fitted = {r.piece: r.score for r in unigram_counts.fit_unigram(df, path).collect()}
    start = unigram_counts.unigram_scores(path)
    assert fitted.keys() == start.keys() and abs(sum(np.exp(list(fitted.values()))) - 1) < 1e-6
    assert all(fitted[p] > start[p] for p in ("▁cat", "▁mat") if p in start)
    unchanged = {r.piece: r.score for r in unigram_counts.fit_unigram(df.filter("false"), path).collect()}
    assert unchanged == pytest.approx(start)


def plain_expected(word, scores, unknown):
    """Expected pieces by forward and backward sums of logarithms, a character at a time."""
    longest, size = max(map(len, scores)), len(word)
    forward, backward = [0.0] + [-np.inf] * size, [-np.inf] * size + [0.0]
    steps = []
    for e in range(1, size + 1):
        for s in range(max(0, e - longest), e):
            piece = word[s:e]
            if piece in scores or e - s == 1:
                steps.append((s, e, piece, scores.get(piece, unknown)))
                forward[e] = np.logaddexp(forward[e], forward[s] + steps[-1][3])
    for s, e, _, score in reversed(steps):
        backward[s] = np.logaddexp(backward[s], backward[e] + score)
    out = {}
    for s, e, piece, score in steps:
        out[piece] = out.get(piece, 0.0) + float(np.exp(forward[s] + score + backward[e] - forward[size]))
    return out


def test_fit_takes_every_word_of_every_row(spark):
    path = public_tokenizers.path(queries.PIECES)
    r = random.Random(5)
    known = ["".join(r.choice(["th", "er", "ing", "a", "q", "é", "tion", "zx"]) for _ in range(r.randint(1, 6))) for _ in range(150)]
    known += ["retrieval" * 20, "\U0002f800" * 90, "é▁b"]  # over 64 letters; no piece, so that a product of chances would vanish
    texts = [" ".join(r.choices(known[:-3], k=5)) for _ in range(1500)] + ["\t".join(known), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    times = {}
    for word in " ".join(t or "" for t in texts).split():
        times[word] = times.get(word, 0) + 1
    scores = unigram_counts.unigram_scores(path)
    for _ in range(2):
        unknown, expected = min(scores.values()) - unigram_counts.UNKNOWN, {}
        for word, n in times.items():
            for piece, k in plain_expected(unigram_counts.MARK + word, scores, unknown).items():
                expected[piece] = expected.get(piece, 0.0) + n * k
        counts = {p: max(expected.get(p, 0.0), 0.01) for p in scores}
        total = np.log(sum(counts.values()))
        scores = {p: float(np.log(n) - total) for p, n in counts.items()}
    fitted = {row.piece: row.score for row in unigram_counts.fit_unigram(df, path).collect()}
    assert fitted == pytest.approx(scores, abs=1e-6)
    again = unigram_counts.fit_unigram(df.repartition(7), path).collect()
    assert {row.piece: row.score for row in again} == fitted


def test_expected_pieces_in_blocks(monkeypatch):
    scores = unigram_counts.unigram_scores(public_tokenizers.path(queries.PIECES))
    suffixes, logs = unigram_counts.PieceSuffixes(list(scores)), np.array([*scores.values(), min(scores.values()) - unigram_counts.UNKNOWN])
    r = random.Random(6)
    words = ["▁" + "".join(r.choices("etaoinshé한", k=r.choice([0, 1, 3, 9, 400]))) for _ in range(40)]
    times, totals = np.array([r.randint(1, 1 << 30) for _ in words]), []
    for block in (1, 70, 1 << 17):
        monkeypatch.setattr(unigram_counts, "BLOCK", block)
        totals.append(np.zeros((2, len(logs)), np.int64))
        unigram_counts.add_expected(words, times, suffixes, logs, totals[-1])
    assert (totals[0] == totals[2]).all() and (totals[1] == totals[2]).all()
    spelled = sum(unigram_counts.in_occurrences(*totals[0][:, i]) * len(p) for i, p in enumerate([*scores, "?"]))
    assert spelled == pytest.approx(sum(n * len(w) for w, n in zip(words, times.tolist(), strict=True)), rel=1e-9)


def test_unigram_counts_equal_the_library():
    scores = unigram_counts.unigram_scores(public_tokenizers.path(queries.PIECES))
    vocab = [("<unk>", -99.0), *[(f"<0x{b:02X}>", -99.0) for b in range(256)], *[(p, s) for p, s in scores.items() if not p.startswith("<0x")]]
    library = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=True))
    library.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    counter = unigram_counts.TrieCounter(scores, capacity=50)
    r = random.Random(2)
    words = ["".join(r.choice(["th", "er", "ing", "a", "q", "é", "tion", "zx", "한"]) for _ in range(r.randint(1, 8))) for _ in range(300)]
    differ = 0
    for k in range(0, 300, 60):
        counter.learn({w.encode() for w in words[k : k + 60]})
        for w in words[k : k + 60]:
            differ += counter.counts[w.encode()] != len(library.encode(w).ids)
    assert differ <= 3  # equal scores may be cut in more than one way
