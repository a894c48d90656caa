"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes and its histogram of common words are compared with the
mean histograms of its language by the Jensen-Shannon distance (square root of the divergence in
bits). Short documents have noisy histograms, so either test counts from a minimum length on. Base
measures (words, symbols, repeated lines and repeated 8-word windows) reject before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: Frequent function words of each language that has a reference of its own.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "on"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8
CLASSES = ("upper", "lower", "digit", "space", "symbol", "other")
#: A text is too far from its language's common words beyond this share of the distance that a text
#: without any of them has. Texts with under 2 percent common words reach 0.83 of it and more (sf0.1).
BARE_SHARE = 0.8


def _language_key(lang: Column) -> Column:
    """The language where it has common words here, else 'other': at most five values."""
    return F.when(lang.isin(list(COMMON_WORDS)), lang).otherwise("other")


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words from the column words: those in windows found twice or more in the text.

    Windows are compared by 64-bit hashes. Only rows in which a window repeats sort their windows;
    equal neighbours then give the starting places, and the union of their spans is counted.
    """
    df = df.withColumn("__h", F.transform("words", lambda w: F.xxhash64(w)))
    width = F.size("words") - WINDOW
    window = F.transform(
        F.sequence(F.lit(0), width), lambda i: F.xxhash64(*[F.get(F.col("__h"), i + k) for k in range(WINDOW)])
    )
    df = df.withColumn("__w", F.when(width > 0, window))
    twice = F.size(F.array_distinct("__w")) < F.size("__w")
    df = df.withColumn(
        "__s", F.when(twice, F.sort_array(F.transform("__w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )

    def same(x: Column, i: Column) -> Column:
        before, after = F.get(F.col("__s"), i - 1), F.get(F.col("__s"), i + 1)
        return F.coalesce(before["h"] == x["h"], F.lit(False)) | F.coalesce(after["h"] == x["h"], F.lit(False))

    starts = F.sort_array(F.transform(F.filter("__s", same), lambda x: x["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def cover(acc: Column, at: Column) -> Column:
        return F.struct(
            (at + WINDOW).alias("end"), (acc["n"] + at + WINDOW - F.greatest(acc["end"], at)).alias("n")
        )

    covered = F.aggregate(starts, zero, cover, lambda acc: acc["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__h", "__w", "__s")


def text_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, language key, the base measures, and both histograms as arrays of counts."""
    slim = df.select(
        F.col(id_col).alias("id"), _language_key(F.col(lang_col)).alias("key"), text_or_empty(text_col).alias("t")
    )
    slim = slim.withColumns(
        {
            "words": F.array_remove(F.split("t", SPACE), ""),
            "lines": F.filter(F.split("t", "\n"), lambda s: F.trim(s, F.lit(" \t\n\x0b\x0c\r")) != ""),
            "plain": F.trim(F.regexp_replace(F.lower("t"), r"[^\p{L}]+", " ")),
        }
    )
    slim = _repeat_words(slim)
    slim = slim.withColumns(
        {
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.regexp_replace("t", SPACE, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
            "n_chars": F.length("t").cast("long"),
            "__upper": F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("long"),
            "__lower": F.length(F.regexp_replace("t", r"[^\p{Ll}]+", "")).cast("long"),
            "__digit": F.length(F.regexp_replace("t", r"[^\p{Nd}]+", "")).cast("long"),
            "__gaps": F.replace(F.col("plain"), F.lit(" "), F.lit("  ")),
        }
    )
    space = F.col("n_chars") - F.col("word_chars")
    named = F.col("__upper") + F.col("__lower") + F.col("__digit") + space + F.col("n_symbols")
    classes = F.array(
        F.col("__upper"), F.col("__lower"), F.col("__digit"), space, F.col("n_symbols"), F.col("n_chars") - named
    )
    spaced = F.concat(F.lit(" "), F.col("__gaps"), F.lit(" "))
    slim = slim.withColumns(
        {
            "classes": classes,
            "__spaced": spaced,
            "n_plain": F.when(F.col("plain") == "", 0).otherwise(F.length("__gaps") - F.length("plain") + 1).cast("long"),
        }
    )

    def occurrences(word: str) -> Column:
        rest = F.length(F.replace(F.col("__spaced"), F.lit(f" {word} "), F.lit("")))
        return ((F.length("__spaced") - rest) / F.lit(len(word) + 2)).cast("long")

    counts = None
    for lang, words in COMMON_WORDS.items():
        value = F.array(*[occurrences(w) for w in words])
        test = F.col("key") == lang
        counts = F.when(test, value) if counts is None else counts.when(test, value)
    counts = counts.otherwise(F.array_repeat(F.lit(0).cast("long"), len(COMMON_WORDS["en"])))
    slim = slim.withColumn("common", counts)
    rest = F.col("n_plain") - F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x)
    return slim.select(
        "id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_plain",
        "classes", F.concat("common", F.array(rest)).alias("common"),
    )


def shares(counts: Column) -> Column:
    """Counts to shares; zeros where there is nothing."""
    total = F.greatest(F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1))
    return F.transform(counts, lambda x: x / total)


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two share arrays, 0 to 1."""

    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y)) / 2).otherwise(0.0)

    parts = F.zip_with(p, q, lambda x, y: term(x, y) + term(y, x))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


def judge_quality(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    max_classes: float = 0.3, max_common: float | None = None, min_chars: int = 200, min_plain: int = 100,
) -> DataFrame:
    """Per document: id, base measures, base_failed, kept, js_classes and js_common.

    Words are ``[^\\x20\\x09-\\x0D]+``. A null or empty text has no words and fails the base rule of
    20 words. A null or unlisted language is judged by the reference of all such documents, without
    the common-word test. References are means over every document that passes the base rules and
    reaches both minimum lengths; without any such document of a language its tests pass. The references
    are thus those of the judged table: a table that is mostly junk would be judged by junk, so give
    the whole corpus, not a part picked for its faults. Without
    ``max_common`` each language's limit is BARE_SHARE of the distance between its reference and a
    text of other words only. Only the three named columns are read. An empty table gives an empty
    result.
    """
    rows = materialize(text_features(df, id_col, text_col, lang_col), "quality").withColumn(
        "base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    )
    able = rows.filter(~F.col("base_failed") & (F.col("n_chars") >= min_chars) & (F.col("n_plain") >= min_plain))
    able = able.select("key", shares(F.col("classes")).alias("c"), shares(F.col("common")).alias("w"))
    n_common = len(COMMON_WORDS["en"]) + 1
    means = able.groupBy("key").agg(
        F.array(*[F.avg(F.get("c", F.lit(i))) for i in range(len(CLASSES))]).alias("ref_c"),
        F.array(*[F.avg(F.get("w", F.lit(i))) for i in range(n_common)]).alias("ref_w"),
    )
    bare = F.array(*[F.lit(float(i == n_common - 1)) for i in range(n_common)])
    limit = BARE_SHARE * jensen_shannon(bare, F.col("ref_w")) if max_common is None else F.lit(max_common)
    means = means.withColumn("limit", limit)
    # at most one row for each of the five language keys
    judged = rows.join(F.broadcast(means), "key", "left").withColumns(
        {
            "js_classes": F.when(F.col("n_chars") >= min_chars, jensen_shannon(shares(F.col("classes")), F.col("ref_c"))),
            "js_common": F.when(
                (F.col("n_plain") >= min_plain) & (F.col("key") != "other"),
                jensen_shannon(shares(F.col("common")), F.col("ref_w")),
            ),
        }
    )
    far = F.coalesce(F.col("js_classes") > max_classes, F.lit(False)) | F.coalesce(
        F.col("js_common") > F.col("limit"), F.lit(False)
    )
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "js_classes", "js_common",
    )
