"""The queries of the operators, over whole tables, and their SQL where SQL can express them."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import (
    bytecnn,
    decontaminate,
    jaccard,
    mixing,
    rulelist,
    runs,
    search,
    simhash,
    substrings,
    tokencount,
    tokenfiles,
    urlfilter,
    warc,
)

QUERIES = {}
ORACLE = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark, sf_dir):
    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_decontaminate(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items")


@query
def op3_warc(spark, sf_dir):
    read = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BITS = [" + ".join(f"{16 >> j} * CAST(substr(bits, {5 * k + j + 1}, 1) AS BIGINT)" for j in range(5)) for k in range(32)]
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {five} + 1, 1)" for five in _BITS)
ORACLE["op3_warc"] = f"""
WITH p AS (
  SELECT page_id, html, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits,
    row_number() OVER (PARTITION BY html ORDER BY page_id) AS place, min(page_id) OVER (PARTITION BY html) AS first_id
  FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN place = 1 THEN NULL ELSE first_id END AS refers_to
FROM p
"""


@query
def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_token_files(spark, sf_dir):
    return tokenfiles.token_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op6_repeated_substrings(spark, sf_dir):
    return substrings.remove_repeated(table(spark, sf_dir, "documents"), with_kept=False)


@query
def op7_url_filter(spark, sf_dir):
    rules = urlfilter.rule_table(spark, urlfilter.HOST_RULES + urlfilter.PATTERN_RULES)
    return urlfilter.judge(table(spark, sf_dir, "pages"), rules)


ORACLE["op7_url_filter"] = r"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), v AS (
  SELECT *, '.' || host AS h,
    CASE WHEN host LIKE 'spam-farm.%' OR host LIKE '%.spam-farm.%' THEN 'spam-farm'
      ELSE NULL END AS spam,
    CASE WHEN host LIKE 'link-farm.%' OR host LIKE '%.link-farm.%' THEN 'link-farm' ELSE NULL END AS link,
    CASE WHEN regexp_matches(host || path, '(?i)(^|[^a-z0-9])xxx([^a-z0-9]|$)') THEN 'xxx'
      WHEN regexp_matches(host || path, '(?i)(^|[^a-z0-9])viagra([^a-z0-9]|$)') THEN 'viagra' ELSE NULL END AS late_word,
    CASE WHEN regexp_matches(host || path, '(?i)(^|[^a-z0-9])porn([^a-z0-9]|$)') THEN 'porn' ELSE NULL END AS porn,
    CASE WHEN regexp_matches(host || path, '(?i)(^|[^a-z0-9])casino([^a-z0-9]|$)') THEN 'casino' ELSE NULL END AS casino
  FROM u
), r AS (
  SELECT page_id, host, path, coalesce(late_word, spam, porn, link, casino) AS pattern_rule,
    CASE WHEN ends_with(h, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN ends_with(h, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN ends_with(h, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN ends_with(h, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN ends_with(h, '.com') AND starts_with(path, '/') THEN 'com/' ELSE NULL END AS rule
  FROM v
)
SELECT page_id, host, path, rule, pattern_rule,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL OR pattern_rule IS NOT NULL THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""


@query
def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLE["op8_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS h,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER f, 0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM w
  WINDOW f AS (ORDER BY 3 * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), max(level) OVER () * weight) AS target FROM l
), b AS (
  SELECT *, CAST(round(target) AS BIGINT) AS words,
    CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t
), p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d
)
SELECT doc_id, size, source_size, target,
  CAST(size * epochs + greatest(0, least(size, words - epochs * source_size - before)) AS BIGINT) AS taken
FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source
"""


@query
def op9_rule_list(spark, sf_dir):
    judged = rulelist.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*columns)


@query
def op10_byte_cnn(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    net = bytecnn.train(docs, table(spark, sf_dir, "labels"))
    scored = bytecnn.score(docs.select("doc_id", "text"), net)
    return scored.select(
        "doc_id",
        bytecnn.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= bytecnn.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op11_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE["op11_jaccard_join"] = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
), u AS (
  SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w
), v AS (
  SELECT doc_id, n, i, concat_ws(' ', x, lead(x, 1) OVER p, lead(x, 2) OVER p, lead(x, 3) OVER p, lead(x, 4) OVER p) AS x
  FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), e AS (
  SELECT DISTINCT doc_id, md5_number(x) AS x FROM v WHERE i <= greatest(1, n - 4)
), s AS (
  SELECT w.doc_id, CAST(count(e.x) AS BIGINT) AS n FROM w LEFT JOIN e ON e.doc_id = w.doc_id GROUP BY w.doc_id
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * o.n >= 80 * (p.n + q.n - o.n)
), r AS (
  SELECT doc_id, doc_id AS least FROM s UNION SELECT l.b, r.least FROM r JOIN l ON l.a = r.doc_id
)
SELECT s.doc_id, s.n AS n_shingles, min(r.least) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY ALL
"""


@query
def op12_periodic_runs(spark, sf_dir):
    return runs.run_digests(runs.periodic_runs(runs.with_planted_runs(table(spark, sf_dir, "documents"))))


@query
def op13_ranked_search(spark, sf_dir):
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE["op13_ranked_search"] = rf"""
WITH q AS (
  SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark
), d AS (
  SELECT doc_id, {_TERMS} AS w FROM documents
), c AS (
  SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d
), p AS (
  SELECT doc_id, CAST(n AS BIGINT) AS n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY ALL
), f AS (
  SELECT t, count(*) AS df FROM p GROUP BY t
), i AS (
  SELECT doc_id, p.t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS impact
  FROM p JOIN f ON f.t = p.t CROSS JOIN c
), b AS (
  SELECT item_id, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM q JOIN i ON i.t = q.t GROUP BY ALL HAVING sum(impact) > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM b QUALIFY rank <= 10
"""
