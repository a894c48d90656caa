"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

A text's shingles of five words are hashed, and every hash below a fixed fraction of the range is
kept. So a sketch grows with its text, the sketch of a union is the union of sketches, and what share
of a short text lies in a long one can be estimated from both sketches, which sketches of fixed size
cannot. A text of which no hash is that low keeps its least hash, so that only texts without words
have an empty sketch; a union drops such a stand-in when it has a proper hash.

Hashes are the first 16 hexadecimal digits of an MD5 digest, which compare as text, so that any SQL
engine gives the same sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shuffle_width, text_or_empty

SPACE = r"[\x20\x09-\x0D]+"
#: Words of a shingle, the share of hashes that is kept, and the digits of a hash.
SHINGLE, FRACTION, DIGITS = 5, 1 / 8, 16


def limit_of(fraction: float) -> str:
    """Hashes less than this text are kept."""
    if not 0 < fraction < 1:
        raise ValueError("a fraction between 0 and 1 is kept")
    return f"{int(fraction * 16**DIGITS):0{DIGITS}x}"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` made once for all its uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _proper(hashes: Column, limit: str) -> Column:
    """Distinct hashes in order without those at or over the limit, but the least where all are."""

    def choose(every: Column) -> Column:
        low = F.filter(every, lambda h: h < limit)
        return F.when(F.size(low) > 0, F.sort_array(F.array_distinct(low))).when(
            F.size(every) > 0, F.array(F.array_min(every))
        ).otherwise(low)

    return _bound(hashes, choose)


def sketch(text: Column, fraction: float = FRACTION, words: int = SHINGLE) -> Column:
    """The sketch of a text, an array of hashes in order. Texts of fewer words are one shingle."""

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (words - 1), F.lit(1)))
        each = F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, words), " ")), 1, DIGITS))
        return F.when(F.size(w) > 0, each).otherwise(F.array().cast("array<string>"))

    return _proper(_bound(F.array_remove(F.split(text, SPACE), ""), hashes), limit_of(fraction))


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return _proper(F.array_union(a, b), limit_of(fraction))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two texts' shingles; 1 where both have none."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(1.0))


def containment(a: Column, b: Column) -> Column:
    """The estimated share of a's shingles that b has; 1 where a has none."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(1.0))


def written(hashes: Column) -> Column:
    """The fingerprint as text."""
    return F.array_join(hashes, "")


def read(fingerprint: Column) -> Column:
    """The sketch of a fingerprint that :func:`written` gave."""
    n = (F.length(fingerprint) / DIGITS).cast("int")
    every = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(fingerprint, (i - 1) * DIGITS + 1, F.lit(DIGITS)))
    return F.when(n > 0, every).otherwise(F.array().cast("array<string>"))


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Per row: id, n_chars (code points), n_kept and fingerprint.

    A null text counts as empty and has an empty fingerprint, as has a text of white space only.
    Rows are taken apart, so repeated rows and ids give repeated results, and equal texts have equal
    fingerprints. An empty table gives an empty result; other columns are not read.
    """
    slim = df.select(F.col(id_col), text_or_empty(text_col).alias("__t"))
    slim = slim.select(id_col, F.length("__t").cast("long").alias("n_chars"), sketch(F.col("__t"), fraction).alias("__s"))
    return slim.select(id_col, "n_chars", F.size("__s").cast("long").alias("n_kept"), written(F.col("__s")).alias("fingerprint"))


def _ordered(slim: DataFrame) -> DataFrame:
    """``slim`` with the number of each row's bucket.

    Buckets are ranges of (id, h, row): their bounds are taken from a range partitioning of these
    three columns alone. The row's number only keeps equal rows of one id from sharing a bucket.
    """
    key = F.struct("id", "h", "row")
    dealt = slim.select("id", "h", "row").repartitionByRange(4 * shuffle_width(slim.sparkSession), "id", "h", "row")
    firsts = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.min(key).alias("first"))
    bounds = materialize(firsts.agg(F.sort_array(F.collect_list("first")).alias("bounds")), "bounds")  # four for each partition
    steps = F.array(*[F.lit(1 << k) for k in range(30, -1, -1)])

    def descend(at: Column, step: Column) -> Column:
        return F.when(F.get("bounds", at + step - 1) <= key, at + step).otherwise(at)

    # one row is broadcast
    return slim.crossJoin(F.broadcast(bounds)).withColumn("bucket", F.aggregate(steps, F.lit(0), descend)).drop("bounds")


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Per row: its fingerprint, that of an edit of its text, and how like they and the next row's are.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next text. Rows follow each other by id, nulls first, then by the MD5 digest of the
    text; after the last comes the first, and a single row follows itself. Columns: id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (estimated Jaccard
    similarities), kept_in_edited, kept_in_next (estimated shares of the text's shingles found
    there). Nulls, empty texts, repeated rows and empty tables as in :func:`fingerprint_documents`;
    other columns are not read.

    Texts are shuffled once, into buckets by range. Neighbours across buckets meet by a join of each
    bucket's last row with the first one of the next.
    """
    slim = df.select(
        F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"), F.md5(text_or_empty(text_col)).alias("h"),
        F.monotonically_increasing_id().alias("row"),
    )
    numbered = _ordered(slim)
    # sketches are made behind the shuffle, which carries texts only
    own = numbered.repartition("bucket").select("id", "h", "row", "bucket", "t", sketch(F.col("t"), fraction).alias("s"))
    order = Window.partitionBy("bucket").orderBy("id", "h", "row")
    paired = own.select(
        "id", "bucket", "t", "s", F.lag(F.lit(1)).over(order).isNull().alias("opens"),
        F.lead("t").over(order).alias("next_t"), F.lead("s").over(order).alias("next_s"),
    )
    closes = F.col("next_t").isNull()
    half = F.floor(F.length("t") / 2).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), F.length("t") - half), F.substring(F.col("next_t"), F.lit(1), half))

    def results(rows: DataFrame, *more: str) -> DataFrame:
        rows = rows.select("id", F.length("t").cast("long").alias("n_chars"), "s", edited.alias("e"), "next_s", *more)
        rows = rows.select("id", "n_chars", "s", "next_s", F.sha2("e", 256).alias("edited_sha256"), sketch(F.col("e"), fraction).alias("es"), *more)
        return rows.select(
            F.col("id").alias(id_col), "n_chars", "edited_sha256", written(F.col("s")).alias("fingerprint"), written(F.col("es")).alias("edited_fingerprint"),
            likeness(F.col("s"), F.col("es")).alias("near_edited"), likeness(F.col("s"), F.col("next_s")).alias("near_next"),
            containment(F.col("s"), F.col("es")).alias("kept_in_edited"), containment(F.col("s"), F.col("next_s")).alias("kept_in_next"), *more,
        )

    # the texts of each bucket's first and last row stay, to be paired with those of other buckets
    edge = F.when(F.col("opens") | closes, F.struct("t", "s"))
    kept = materialize(results(paired.withColumns({"edge": edge, "closes": closes}), "bucket", "opens", "closes", "edge"), "pairs")
    firsts = kept.filter("opens").select("bucket", F.col("edge.t").alias("next_t"), F.col("edge.s").alias("next_s"))
    lasts = kept.filter("closes").select(F.col(id_col).alias("id"), "bucket", "edge.t", "edge.s")
    # one row of numbers for each bucket goes through one window
    around = Window.orderBy("bucket")
    follows = firsts.select("bucket").select(
        "bucket", F.coalesce(F.lead("bucket").over(around), F.min("bucket").over(Window.partitionBy())).alias("then")
    )
    met = lasts.join(follows, "bucket").drop("bucket").join(firsts.withColumnRenamed("bucket", "then"), "then")
    whole = results(met)
    return kept.filter(~F.col("closes")).select(whole.columns).unionByName(whole)
