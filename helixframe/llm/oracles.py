"""DuckDB SQL of the registered text queries, where SQL can express them."""

from __future__ import annotations

from .fingerprints import FRACTION, limit_of
from .quality_rules import BARE_SHARE, COMMON_WORDS
from .url_filter import PUBLIC_SUFFIXES, RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rules() -> str:
    tests = []
    for verdict, rule in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        host, _, tail = rule.partition("/")
        tests.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{tail}') THEN {{'rule': '{rule}', 'verdict': '{verdict}'}}")
    return "CASE " + "\n        ".join(tests) + " END"


_TWO = "array_to_string((string_split(host, '.'))[-2:], '.')"
_PUBLIC = f"{_TWO} IN ({', '.join(map(repr, PUBLIC_SUFFIXES))})"

URL_FILTER = f"""
WITH slim AS (
    SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
parts AS (
    SELECT DISTINCT host, CASE WHEN {_PUBLIC} THEN array_to_string((string_split(host, '.'))[-3:], '.') ELSE {_TWO} END AS domain,
           CASE WHEN {_PUBLIC} THEN {_TWO} ELSE (string_split(host, '.'))[-1] END AS suffix FROM slim),
counts AS (
    SELECT s.host, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS k
    FROM slim s JOIN labels l ON s.page_id = l.doc_id WHERE (l.quality = 0 OR l.toxic = 1) IS NOT NULL GROUP BY 1),
m AS (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(k), 0) AS k, count(*) AS g, coalesce(sum(k * k / n), 0) AS kk, coalesce(sum(n * n), 0) AS nn FROM counts),
r AS (SELECT *, CASE WHEN k > 0 AND k < n AND n - nn / n > g - 1 THEN
    ((kk - k * k / n) / (k / n * (1 - k / n)) - (g - 1)) / ((n - nn / n) - (g - 1)) END AS rho FROM m),
prior AS (SELECT (k + 1.0) / (n + 2.0) AS rate, CASE WHEN g < 2 OR n <= g OR rho IS NULL THEN 10.0
    ELSE least(200.0, greatest(2.0, CASE WHEN rho > 0 THEN 1 / rho - 1 ELSE 200.0 END)) END AS c FROM r),
levels AS (SELECT p.*, coalesce(n, 0) AS n, coalesce(k, 0) AS k FROM parts p LEFT JOIN counts USING (host)),
suffixes AS (SELECT suffix, (sum(k) + any_value(c) * any_value(rate)) / (sum(n) + any_value(c)) AS sm, sum(n) AS sn FROM levels, prior GROUP BY 1),
domains AS (SELECT domain, sum(n) AS dn, sum(k) AS dk FROM levels GROUP BY 1),
means AS (SELECT host, n, c, (dk + c * sm) / (dn + c) AS dm, k, n + dn + sn AS evidence FROM levels JOIN domains USING (domain) JOIN suffixes USING (suffix), prior),
hosts AS (SELECT host, evidence, b - 1.645 * sqrt(b * (1 - b) / (n + c + 1)) AS low FROM (SELECT *, (k + c * dm) / (n + c) AS b FROM means)),
judged AS (SELECT s.*, h.low, h.evidence, {_rules()} AS fit FROM slim s JOIN hosts h USING (host))
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.verdict, CASE WHEN low > 0.2 AND evidence > 0 THEN 'block' ELSE 'allow' END) AS verdict FROM judged
"""

MIXING = """
WITH sizes AS (SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS size FROM documents GROUP BY 1),
rates AS (SELECT source, sqrt(size) * (SELECT sum(size) / sum(sqrt(size)) FROM sizes) / size AS rate FROM sizes WHERE size > 0),
pmf AS (SELECT source, j, exp(-rate + j * ln(rate) - lgamma(j + 1)) AS p FROM rates, range(0, 200) t(j)),
cdf AS (SELECT source, j, sum(p) OVER (PARTITION BY source ORDER BY j) AS c FROM pmf),
drawn AS (SELECT row_number() OVER () AS row, d.*, CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, '')) || '|1'), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents d),
counted AS (SELECT d.row, count(c.j) AS mix_copies FROM drawn d LEFT JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u GROUP BY 1)
SELECT doc_id, text, lang, source, n_chars, CAST(mix_copies AS INT) AS mix_copies, CAST(unnest(range(1, mix_copies + 1)) AS INT) AS mix_copy
FROM drawn JOIN counted USING (row) WHERE source IN (SELECT source FROM rates)
"""


def _quality() -> str:
    n = len(COMMON_WORDS["en"])
    lists = " ".join(f"WHEN '{lang}' THEN [{', '.join(repr(w) for w in words)}]" for lang, words in COMMON_WORDS.items())
    known = ", ".join(f"'{lang}'" for lang in COMMON_WORDS)

    def divergence(p: str, q: str, size: int) -> str:
        terms = [
            f"(CASE WHEN {p}[{i}] > 0 THEN {p}[{i}] * log2(2 * {p}[{i}] / ({p}[{i}] + {q}[{i}])) / 2 ELSE 0 END"
            f" + CASE WHEN {q}[{i}] > 0 THEN {q}[{i}] * log2(2 * {q}[{i}] / ({p}[{i}] + {q}[{i}])) / 2 ELSE 0 END)"
            for i in range(1, size + 1)
        ]
        return f"sqrt(greatest(0, {' + '.join(terms)}))"

    mean_c = ", ".join(f"avg(c[{i}])" for i in range(1, 7))
    mean_w = ", ".join(f"avg(w[{i}])" for i in range(1, n + 2))
    bare = ", ".join(["0.0"] * n + ["1.0"])  # a text without any of the words
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, CASE WHEN lang IN ({known}) THEN lang ELSE 'other' END AS key, coalesce(text, '') AS t FROM documents),
e AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines,
    trim(regexp_replace(lower(t), '[^\p{{L}}]+', ' ', 'g')) AS plain FROM d),
win AS (SELECT row, i, array_to_string(words[i:i + 7], ' ') AS w FROM (SELECT row, words, unnest(range(1, len(words) - 6)) AS i FROM e WHERE len(words) >= 8)),
twice AS (SELECT row, i FROM win WHERE (row, w) IN (SELECT (row, w) FROM win GROUP BY row, w HAVING count(*) > 1)),
rep AS (SELECT row, count(DISTINCT i + k) AS n FROM twice, range(0, 8) r(k) GROUP BY 1),
f AS (SELECT e.row, doc_id, key, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, length(t) AS n_chars, length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS up, length(regexp_replace(t, '[^\p{{Ll}}]+', '', 'g')) AS lo,
    length(regexp_replace(t, '[^\p{{Nd}}]+', '', 'g')) AS dig, plain, CASE WHEN plain = '' THEN 0 ELSE len(string_split(plain, ' ')) END AS n_plain,
    ' ' || replace(plain, ' ', '  ') || ' ' AS spaced, CASE key {lists} ELSE NULL END AS common FROM e LEFT JOIN rep USING (row)),
g AS (SELECT *, [up, lo, dig, n_chars - word_chars, n_symbols, n_chars - (up + lo + dig + n_chars - word_chars + n_symbols)] AS classes,
    CASE WHEN common IS NULL THEN list_transform(range(0, {n}), lambda x: 0) ELSE list_transform(common, lambda x: (length(spaced) - length(replace(spaced, ' ' || x || ' ', ''))) // (length(x) + 2)) END AS hits FROM f),
h AS (SELECT *, list_append(hits, n_plain - list_sum(hits)) AS found, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM g),
s AS (SELECT *, list_transform(classes, lambda x: x / greatest(list_sum(classes), 1)) AS c, list_transform(found, lambda x: x / greatest(list_sum(found), 1)) AS w FROM h),
means AS (SELECT key, [{mean_c}] AS rc, [{mean_w}] AS rw, [{bare}] AS bare FROM s WHERE NOT base_failed AND n_chars >= 200 AND n_plain >= 100 GROUP BY 1),
ref AS (SELECT *, {BARE_SHARE} * {divergence('bare', 'rw', n + 1)} AS most FROM means)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (coalesce(n_chars >= 200 AND {divergence('c', 'rc', 6)} > 0.3, false)
        OR coalesce(n_plain >= 100 AND s.key != 'other' AND {divergence('w', 'rw', n + 1)} > most, false)) AS kept
FROM s LEFT JOIN ref USING (key)
"""


#: The distinct hashes under the limit of a list of hashes, or the least where none is.
_SKETCH = """CASE WHEN len(list_filter({0}, lambda h: h < '{limit}')) > 0 THEN list_sort(list_distinct(list_filter({0}, lambda h: h < '{limit}')))
    WHEN len({0}) > 0 THEN [list_min({0})] ELSE CAST([] AS VARCHAR[]) END"""
_SHINGLES = r"""CASE WHEN len({0}) > 0 THEN list_transform(range(1, greatest(len({0}) - 4, 1) + 1), lambda i: substr(md5(array_to_string({0}[i:i + 4], ' ')), 1, 16)) ELSE CAST([] AS VARCHAR[]) END"""
_LIKENESS = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) > 0 THEN len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) ELSE 1.0 END"
_CONTAINED = "CASE WHEN len({0}) > 0 THEN len(list_intersect({0}, {1})) / len({0}) ELSE 1.0 END"
_LIMIT = limit_of(FRACTION)

FINGERPRINTS = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) AS row, count(*) OVER () AS rows, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT a.row, a.doc_id, length(a.t) AS n, a.t, b.t AS u, b.row AS follow FROM d a JOIN d b ON b.row = a.row % a.rows + 1),
e AS (SELECT *, substr(t, 1, n - n // 2) || substr(u, 1, n // 2) AS e FROM p),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ 	-
]+'), lambda x: x != '') AS tw, list_filter(regexp_split_to_array(e, '[ 	-
]+'), lambda x: x != '') AS ew FROM e),
h AS (SELECT row, follow, doc_id, n, e, {_SHINGLES.format('tw')} AS th, {_SHINGLES.format('ew')} AS eh FROM w),
s AS (SELECT row, follow, doc_id, n, e, {_SKETCH.format('th', limit=_LIMIT)} AS s, {_SKETCH.format('eh', limit=_LIMIT)} AS es FROM h)
SELECT a.doc_id, CAST(a.n AS BIGINT) AS n_chars, sha256(a.e) AS edited_sha256, array_to_string(a.s, '') AS fingerprint, array_to_string(a.es, '') AS edited_fingerprint,
    {_LIKENESS.format('a.s', 'a.es')} AS near_edited, {_LIKENESS.format('a.s', 'b.s')} AS near_next, {_CONTAINED.format('a.s', 'a.es')} AS kept_in_edited, {_CONTAINED.format('a.s', 'b.s')} AS kept_in_next
FROM s a JOIN s b ON b.row = a.follow
"""


ORACLES = {
    "op11_fingerprints": FINGERPRINTS,
    "op4_mix_sources": MIXING,
    "op6_url_filter": URL_FILTER,
    "op7_quality_rules": _quality(),
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
    """,
}
