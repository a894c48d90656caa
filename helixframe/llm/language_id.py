"""Language identification by Bayesian fusion of evidence.

Four kinds of evidence are multiplied: the likelihood of the text under byte trigram models, the
likelihood of the language that the markup declares, the likelihood of the address's suffix, and a
prior of the host. Host priors are shrunk to their registered domain and on to all rows; they come
from grouped sums of the text posteriors over every row. The trigram models are trained on a bounded
sample of each labelled language's rows, spread over the table by a hash; everything else covers all
rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, narrow_batches, text_or_empty

#: Trigram hash cells, and the most trigrams whose evidence counts in full.
CELLS, FULL = 1 << 14, 300
UNKNOWN = "und"
#: Languages that a country suffix of an address speaks for.
SUFFIX_LANGUAGES = {
    "fr": "fr", "de": "de", "at": "de", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "ie": "en",
    "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl", "ru": "ru", "jp": "ja", "cn": "zh", "kr": "ko",
}

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def trigram_cells(text: bytes) -> np.ndarray:
    """The cell of each byte trigram of a text, A-Z lower-cased, white space as blanks."""
    raw = _LOWER[np.frombuffer(b" " + text + b" ", np.uint8)]
    code = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(18)


@dataclass(frozen=True)
class TextModel:
    """Log probabilities of the cells: one row for each language, the last one for no language."""

    languages: tuple[str, ...]
    logs: np.ndarray

    def evidence(self, texts: list[bytes], stretch: int = 1 << 22) -> np.ndarray:
        """Log likelihoods; beyond FULL trigrams their mean counts FULL times.

        Neighbouring trigrams are dependent, so more of them would only feign certainty.
        """
        out = np.zeros((len(texts), len(self.languages) + 1))
        step = (1 << 24) // (len(self.languages) + 1)
        for k, text in enumerate(texts):
            n = 0
            for at in range(0, len(text), stretch):
                cells = trigram_cells(text[at : at + stretch])
                for part in range(0, len(cells), step):
                    out[k] += self.logs[:, cells[part : part + step]].sum(axis=1)
                n += len(cells)
            if n > FULL:
                out[k] *= FULL / n
        return out


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, np.ndarray] = {}
    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = counts.setdefault(row, np.zeros(CELLS, np.int64))
            for at in range(0, len(text), 1 << 22):
                own += np.bincount(trigram_cells(text[at : at + (1 << 22)]), minlength=CELLS)
    for row, own in counts.items():
        cell = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(cell), row)), pa.array(cell), pa.array(own[cell])], ["row", "cell", "n"]
        )


def train_text_model(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most_rows: int = 20_000,
    most_languages: int = 1000, most_of_one: int = 200,
) -> TextModel:
    """Fit the trigram models on a bounded sample of the labelled rows (all rows of smaller tables).

    Languages are counted over all rows, and each has its model at every size of the table. A
    language gives up to about an equal share of ``most_rows``, but never less than ``most_of_one``
    rows where it has them: those whose hash of id and text is low, the row of the lowest one
    always. A table without ``id_col`` is sampled by its texts. A model takes 64 KB, so more than
    ``most_languages`` languages are an error; none is left out.
    """
    spark = df.sparkSession
    labelled = df.filter(F.col(lang_col).isNotNull() & (F.length(text_or_empty(text_col)) > 0))
    seed = [c for c in (id_col, text_col) if c in df.columns]
    rows = labelled.select(
        F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text"),
        F.pmod(F.xxhash64(*seed), F.lit(1 << 40)).alias("h"),
    )
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("first"))
    found = sorted(found.limit(most_languages + 1).collect(), key=lambda r: r["lang"])
    if len(found) > most_languages:
        raise ValueError(f"more than {most_languages} languages in {lang_col}")
    languages = tuple(r["lang"] for r in found)
    counts = np.zeros((len(languages) + 1, CELLS))
    if languages:
        most = max(most_rows // len(languages), most_of_one)
        below = [(r["lang"], k, max(int(min(1.0, most / r["n"]) * (1 << 40)), r["first"] + 1)) for k, r in enumerate(found)]
        limits = F.broadcast(spark.createDataFrame(below, "lang string, row long, below long"))  # a row for each language
        sample = rows.join(limits, "lang").filter(F.col("h") < F.col("below")).select("row", "text")
        cells = sample.mapInArrow(_count_cells, "row long, cell long, n long")
        with narrow_batches(spark):
            got = cells.groupBy("row", "cell").agg(F.sum("n").alias("n")).toPandas()  # languages x CELLS at most
        counts[got["row"], got["cell"]] = got["n"]
    counts[:-1] += 0.05 * counts[:-1].sum(axis=1, keepdims=True) / CELLS + 1e-9
    counts[-1] = 1.0
    probs = counts / counts.sum(axis=1, keepdims=True)
    return TextModel(languages, np.log(probs).astype(np.float32))


def softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(weights, lambda x: x / F.aggregate(weights, F.lit(0.0), lambda a, y: a + y))


def host_priors(scored: DataFrame, size: int, strength: float = 20.0) -> DataFrame:
    """Per host: log prior array, shrunk to the registered domain and on to all rows.

    ``scored`` has host and post, the text posteriors of a row. Sums are grouped by host first; the
    domain's and the overall sums come from the hosts' table.
    """
    each = [F.get("post", F.lit(i)) for i in range(size)]
    hosts = scored.groupBy("host").agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(each)])
    hosts = materialize(hosts.withColumn("domain", F.substring_index("host", ".", -2)), "host-sums")
    sums = [F.sum(f"s{i}").alias(f"t{i}") for i in range(size)]
    overall = hosts.agg(*sums).first()
    total = sum((overall[f"t{i}"] or 0.0) + 1.0 for i in range(size))
    base = [((overall[f"t{i}"] or 0.0) + 1.0) / total for i in range(size)]
    domains = hosts.groupBy("domain").agg(*[F.sum(f"s{i}").alias(f"d{i}") for i in range(size)])

    def shrunk(prefix: str, above: list[Column]) -> Column:
        own = F.array(*[F.col(f"{prefix}{i}") for i in range(size)])
        n = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, F.array(*above), lambda x, p: (x + strength * p) / (n + strength))

    of_domain = domains.select("domain", shrunk("d", [F.lit(b) for b in base]).alias("p"))
    joined = hosts.join(of_domain, "domain")
    of_host = shrunk("s", [F.get("p", F.lit(i)) for i in range(size)])
    return materialize(joined.select("host", F.transform(of_host, lambda x: F.log(x)).alias("prior")), "host-priors")


def declared_table(scored: DataFrame, languages: tuple[str, ...]) -> np.ndarray:
    """Log likelihood of each declared value (rows; the last one is any other) for each language.

    A missing declaration is no evidence. Counts are soft sums over all rows, smoothed towards
    declaring the right language three times in four.
    """
    size = len(languages) + 1
    known = said_as(F.col("declared"), languages)
    sums = scored.filter(F.col("declared").isNotNull()).groupBy(known.alias("d")).agg(
        *[F.sum(F.get("post", F.lit(i))).alias(f"s{i}") for i in range(size)]
    ).collect()  # one row for each language and one more
    counts = np.full((size, size), 5.0)
    counts[np.arange(size), np.arange(size)] = 15.0 * max(size - 1, 1)
    names = [*languages, UNKNOWN]
    for row in sums:
        counts[names.index(row["d"])] += [row[f"s{i}"] or 0.0 for i in range(size)]
    return np.log(counts / counts.sum(axis=0, keepdims=True))


def said_as(declared: Column, languages: tuple[str, ...]) -> Column:
    """The row of the table of declared values that a declaration reads; null where there is none."""
    known = F.when(declared.isin(list(languages)), declared).otherwise(UNKNOWN) if languages else F.lit(UNKNOWN)
    return F.when(declared.isNotNull(), known)


def suffix_evidence(suffix: Column, languages: tuple[str, ...], boost: float = 4.0) -> list[Column]:
    """Log likelihood ratio of a country suffix: ``boost`` times likelier under its own language."""
    out = []
    for lang in [*languages, UNKNOWN]:
        own = [s for s, spoken in SUFFIX_LANGUAGES.items() if spoken == lang]
        out.append(F.when(suffix.isin(own), float(np.log(boost))).otherwise(0.0) if own else F.lit(0.0))
    return out


def _scorer(model: TextModel, spark):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.evidence([bytes(t) for t in texts])))

    return score


def identify_language(
    df: DataFrame, text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source",
    address_col: str | None = None, model: TextModel | None = None, least: float = 0.5, columns: list[str] | None = None,
) -> DataFrame:
    """``df`` (or its ``columns``) with lang_found, lang_probability and lang_kept.

    Without ``model`` the texts are labelled by ``declared_col``. The host is ``host_col``, or what
    follows :// in ``address_col``, whose last label is then the suffix. A row is kept where a
    language, not 'und', reaches the probability ``least``. Texts without any letter are 'und' with
    probability 1 and not kept: null, empty, blank, and those of signs or digits alone. Rows without
    a declaration or host have neither evidence; without labelled rows all rows are 'und'. Repeated
    rows get the same result. An empty table gives an empty result.
    """
    spark = df.sparkSession
    model = model or train_text_model(df, text_col, declared_col)
    score = _scorer(model, spark)
    names = [*model.languages, UNKNOWN]
    none = F.lit(None).cast("string")
    declared = F.col(declared_col).cast("string") if declared_col else none
    host = F.col(host_col).cast("string") if host_col else none
    suffix = none
    if address_col:
        host = F.lower(F.regexp_extract(F.col(address_col), r"(?s)^.*?://([^/?#]*)", 1))
        suffix = F.substring_index(host, ".", -1)
    text = text_or_empty(text_col)
    bare = {
        "declared": declared, "host": F.coalesce(host, F.lit("")), "suffix": suffix,
        "worded": text.rlike(r"\p{L}"), "logs": score(text.cast("binary")),
    }
    wanted = columns or df.columns
    hidden = {c: f"__{c}" for c in (*bare, "prior", "post", "best", "said", "of_said")}
    with narrow_batches(spark):  # each text is scored once; what follows reads the written scores
        full = materialize(df.select(*[F.col(f"`{c}`") for c in wanted], *[c.alias(hidden[n]) for n, c in bare.items()]), "scored")
    scored = full.select([F.col(hidden[n]).alias(n) for n in bare]).withColumn("post", softmax(F.col("logs"))).filter("worded")
    priors = host_priors(scored, len(names)).withColumnsRenamed({"host": hidden["host"], "prior": hidden["prior"]})
    table = declared_table(scored, model.languages)

    full = full.join(priors, hidden["host"], "left")
    said = [(d, [float(x) for x in table[k]]) for k, d in reversed(list(enumerate(names)))]
    said = spark.createDataFrame(list(dict(said).items()), f"`{hidden['said']}` string, `{hidden['of_said']}` array<double>")
    full = full.withColumn(hidden["said"], said_as(F.col(hidden["declared"]), model.languages))
    full = full.join(F.broadcast(said), hidden["said"], "left")  # a row for each language and one more
    spoken = F.array(*suffix_evidence(F.col(hidden["suffix"]), model.languages))
    post = F.col(hidden["logs"])
    for more in (F.col(hidden["of_said"]), spoken, F.col(hidden["prior"])):
        post = F.when(more.isNull(), post).otherwise(F.zip_with(post, more, lambda x, y: x + y))
    full = full.withColumn(hidden["post"], post)
    full = full.withColumn(hidden["best"], F.array_position(F.col(hidden["post"]), F.array_max(hidden["post"])).cast("int"))
    worded = F.col(hidden["worded"])
    top = F.array_max(hidden["post"])
    share = 1 / F.aggregate(F.col(hidden["post"]), F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max(hidden["post"])))
    found = F.when(worded, F.element_at(F.array(*map(F.lit, names)), F.col(hidden["best"]))).otherwise(UNKNOWN)
    probability = F.when(worded & top.isNotNull(), share).otherwise(1.0)
    return full.select(
        *[F.col(f"`{c}`") for c in wanted], found.alias("lang_found"), probability.alias("lang_probability"),
        ((found != UNKNOWN) & (probability >= least)).alias("lang_kept"),
    )
