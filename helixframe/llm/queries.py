"""The registered queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fingerprints, html_extract, jaccard_join, language_id, mixing, periodic_runs, quality_rules, token_files, unigram_counts, url_filter, whitening
from .common import materialize, table
from .oracles import ORACLES  # noqa: F401  the SQL of these queries

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
END_ID = 2


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = [zlib.crc32(row.as_buffer()) for row in batch.column("ids")]
        columns = [batch.column("id"), batch.column("start"), batch.column("n"), pa.array(sums, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder, _ = token_files.write_token_files(docs, public_tokenizers.path(WORD_BPE), END_ID)
    read = token_files.read_token_files(spark, folder)
    return read.mapInArrow(_crc, f"doc_id {dict(docs.dtypes)['doc_id']}, start long, n_tokens long, ids_crc32 long")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = language_id.train_text_model(docs)
    of_docs = language_id.identify_language(docs, model=model, columns=["doc_id"])
    # the language that a page declares goes along with its address through the extraction
    declared = F.lower(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    about = F.struct("url", F.when(declared != "", declared).alias("declared")).alias("about")
    texts = html_extract.extract_pages(pages.select("page_id", "html", about), url_col="about")
    texts = materialize(texts.select("page_id", "about.url", "about.declared", "text"), "page-texts")
    of_pages = language_id.identify_language(
        texts, declared_col="declared", host_col=None, address_col="url", model=model, columns=["page_id"]
    )
    return of_docs.unionByName(of_pages, allowMissingColumns=True).select(
        "doc_id", "page_id", F.col("lang_found").alias("language"), F.col("lang_probability").alias("probability"),
        F.col("lang_kept").alias("kept"),
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), bookkeeping=True).drop("mix_rate")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.similar_documents(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("win_id").alias("class_id"), "class", "links", "copies")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), outcomes).drop("bad_mean", "bad_low")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, sf_dir, "documents")).drop("js_classes", "js_common")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign_exact(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def _repeating(id_col: str, text_col: str) -> Column:
    """The text; of one id in ten the words from some place on repeat a piece, as the query's contract lays down."""
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)

    def again(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        moved = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))
        return F.when(n > 0, F.array_join(moved, " ")).otherwise("")

    split = F.array_remove(F.split(F.col(text_col), quality_rules.SPACE), "")
    return F.when(h % 10 == 0, F.get(F.transform(F.array(split), again), F.lit(0))).otherwise(F.col(text_col))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs.find_runs(docs.select("doc_id", _repeating("doc_id", "text").alias("text")))
    first, others = F.get("runs", F.lit(0)), F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1)))
    # the greatest exponent, compared as a product of longs; runs come by start, then period
    best = F.aggregate(others, first, lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files, op2_html_extract, op3_language_id, op4_mix_sources, op5_jaccard_join, op6_url_filter,
        op7_quality_rules, op8_bpe, op9_exact_dedup, op10_token_counts, op11_fingerprints, op12_periodic_runs, op13_whitening,
    )
}
