"""The training-data operators as registered queries, one opN_<name> for each."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from offersieve.llm import bpe, decontaminate, fingerprints, language, lines, minhash, pii, quality, search, sharding, suffixes, urls, variants
from offersieve.llm.common import compact, documents
from offersieve.session import ship


def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(lines.report(documents(spark, sf_dir)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(minhash.near_duplicates(documents(spark, sf_dir), percent=85))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(sharding.shards(documents(spark, sf_dir), n_shards=8))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(pii.report(documents(spark, sf_dir)))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(suffixes.repeated_spans(documents(spark, sf_dir)).drop("starts", "ends"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact(variants.variants(variants.words(documents(spark, sf_dir), edited=True)))


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = ship(spark).read.parquet(f"{sf_dir}/pages.parquet")
    return compact(urls.report(pages, urls.rules_table(spark)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lines": op1_lines,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_minhash": op4_minhash,
    "op5_language": op5_language,
    "op6_sharding": op6_sharding,
    "op7_fingerprints": op7_fingerprints,
    "op8_pii": op8_pii,
    "op9_decontaminate": op9_decontaminate,
    "op10_suffixes": op10_suffixes,
    "op11_search": op11_search,
    "op12_variants": op12_variants,
    "op13_urls": op13_urls,
}

#: doc_id is unique in the tables.
LINES_SQL = r"""
WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM parts),
counted AS (SELECT doc_id, pos, line, len(list_filter(regexp_split_to_array(line, '[ \t\x0B\f\r]+'), lambda x: x <> '')) AS words FROM lines),
numbered AS (
  SELECT doc_id, pos, words, md5(line) AS h, row_number() OVER w AS i, coalesce(sum(words) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    md5(line) || lead(md5(line)) OVER w AS pair
  FROM counted WHERE words > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
windows AS (
  SELECT a.doc_id, a.i, min({'h': b.h, 'i': b.i}) AS least
  FROM numbered a JOIN numbered b ON a.doc_id = b.doc_id AND b.i BETWEEN a.i AND a.i + 7 AND b.before - a.before < 50 GROUP BY a.doc_id, a.i),
fingerprints AS (SELECT least.h AS h FROM windows GROUP BY least.h HAVING count(DISTINCT {'d': doc_id, 'i': least.i}) > 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AND h IN (SELECT h FROM fingerprints) AS match,
    pair IS NOT NULL AND row_number() OVER (PARTITION BY pair ORDER BY doc_id, i) > 1 AS joined
  FROM numbered),
runs AS (
  SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT *, CASE WHEN lag(joined) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS begins FROM ranked)),
gone AS (SELECT doc_id, run FROM runs GROUP BY doc_id, run HAVING bool_or(match) AND sum(words) >= 5),
removed AS (SELECT r.doc_id, r.pos FROM runs r JOIN gone g ON r.doc_id = g.doc_id AND r.run = g.run),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(r.pos) AS n_removed,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE r.pos IS NULL), '') AS text
  FROM lines l LEFT JOIN removed r ON l.doc_id = r.doc_id AND l.pos = r.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
  length(coalesce(k.text, '')) AS n_kept_chars, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

_LOWERED = f"translate(text, '{urls.UPPER}', '{urls.LOWER}')"
_TERMS = r"regexp_extract_all(" + _LOWERED + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH_SQL = f"""
WITH texts AS (SELECT doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n FROM texts WHERE len(terms) > 0),
whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
lengths AS (SELECT doc_id, 25 + (75 * n * docs) // terms AS m FROM sizes, whole),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM texts) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM df, whole),
asked AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
scores AS (
  SELECT item_id, doc_id, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id) GROUP BY item_id, doc_id)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 10
"""

_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
VARIANTS_SQL = f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: {_CRC_STEP}) ORDER BY i) AS steps FROM range(256) t(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL),
each AS (SELECT run, count(*) AS n, hex(encode(concat(doc_id, ':', run))) AS code FROM runs GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295], [CAST(concat('0x', substr(code, 2 * i + 1, 2)) AS BIGINT) for i in range(len(code) // 2)]),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM each, crc),
edited AS (SELECT CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, concat(substr(word, 1, i), substr(word, i + 2)) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
ways AS (SELECT word, word AS root, form AS next FROM formed UNION ALL SELECT w.word, w.next, f.form FROM ways w JOIN formed f ON f.word = w.next)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN ways w ON f.word = w.word AND w.next IS NULL
"""


def _rules_sql() -> str:
    """The rule that fits, longest first."""
    rules = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{value(v, h, p)}'" for v, h, p in rules) + " END"
    return f"{case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS ruled"


_AFTER = "CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END"
_HOST = f"translate(regexp_extract({_AFTER}, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}')"
URLS_SQL = f"""
WITH parts AS (
  SELECT page_id, html, coalesce({_HOST}, '') AS host, coalesce(regexp_extract(substr({_AFTER}, length({_HOST}) + 1), '^[^?#]*'), '') AS path FROM pages),
ruled AS (SELECT page_id, host, path, {_rules_sql()} FROM parts),
seeds AS (SELECT host, count(*) FILTER (WHERE ruled = 'allow') / count(*) AS trust, count(*) FILTER (WHERE ruled = 'block') / count(*) AS distrust FROM ruled WHERE host <> '' GROUP BY host),
found AS (SELECT host, translate(unnest(regexp_extract_all(html, '{urls.LINK.replace("'", "''")}', 1)), '{urls.UPPER}', '{urls.LOWER}') AS target FROM parts WHERE html IS NOT NULL),
links AS (SELECT host, target, count(*) AS n FROM found WHERE host <> '' AND host <> target GROUP BY host, target),
ways AS (SELECT 'trust' AS kind, host, target, n FROM links UNION ALL SELECT 'distrust', target, host, n FROM links),
edges AS (SELECT kind, host, target, n / sum(n) OVER (PARTITION BY kind, host) AS share FROM ways),
s0 AS (SELECT 'trust' AS kind, host, {1 - urls.DAMPING} * trust AS score FROM seeds UNION ALL SELECT 'distrust', host, {1 - urls.DAMPING} * distrust FROM seeds),
""" + ",\n".join(
    f"s{i + 1} AS (SELECT kind, host, sum(score) AS score FROM (SELECT * FROM s0 UNION ALL SELECT e.kind, e.target, {urls.DAMPING} * score * share FROM edges e JOIN s{i} s ON e.kind = s.kind AND e.host = s.host) GROUP BY kind, host)"
    for i in range(urls.ROUNDS)
) + f"""
SELECT page_id, p.host, path, rule, coalesce(ruled, CASE WHEN round(coalesce(d.score, 0), 9) > round(coalesce(t.score, 0), 9) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled p LEFT JOIN s{urls.ROUNDS} t ON t.kind = 'trust' AND t.host = p.host LEFT JOIN s{urls.ROUNDS} d ON d.kind = 'distrust' AND d.host = p.host
"""

ORACLE_SQL: dict[str, str] = {"op1_lines": LINES_SQL, "op11_search": SEARCH_SQL, "op12_variants": VARIANTS_SQL, "op13_urls": URLS_SQL}
