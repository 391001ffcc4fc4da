"""The named queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfledger.llm import (
    byte_bpe,
    chat_format,
    divergence,
    exact_dedup,
    fill_in_middle,
    mixing,
    near_dedup,
    pii,
    quality_classifier,
    quality_rules,
    sharding,
    token_files,
    url_filter,
)
from shelfledger.session import staging_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
BLOCK, ALLOW = ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]
#: A conversation whose texts hold the marks of common templates.
PROBE = r"\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.learn(docs, table(spark, sf_dir, "labels")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.learn(docs, table(spark, sf_dir, "labels")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, BLOCK, ALLOW))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.cluster(table(spark, sf_dir, "documents"))


def op6_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.reshard(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_report(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(role).alias("role")) for i, role in enumerate(("user", "assistant"))])
    more = spark.range(1).select(F.inline(probe)).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("turn").cast("long"), "role", F.lit(PROBE).alias("text")
    )
    return chat_format.read_conversations(chat_format.format_conversations(turns.unionByName(more)))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.file_report(table(spark, sf_dir, "documents"), staging_path(spark, "token-files"), TOKENIZER)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.sample_report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_quality_rules, op3_quality_classifier, op4_url_filter, op5_near_dedup, op6_resharding,
        op7_exact_dedup, op8_pii, op9_mixing, op10_chat_format, op11_divergence, op12_token_files,
        op13_fill_in_middle, pipeline,
    )
}

ORACLE: dict[str, str] = {
    "op4_url_filter": r"""
WITH u AS (
  SELECT row_number() OVER () AS row, page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (SELECT * FROM (VALUES ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
  ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')) t(rh, rp, rule, verdict)),
m AS (SELECT u.*, r.rule, r.verdict, row_number() OVER (PARTITION BY u.row ORDER BY length(r.rule) DESC NULLS LAST) AS rn
  FROM u LEFT JOIN r ON (u.host = r.rh OR ends_with(u.host, '.' || r.rh)) AND starts_with(u.path, r.rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE rn = 1""",
    "op7_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op9_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source),
k AS (
  SELECT *, 3 * source_size AS cap,
    sum(3 * source_size) OVER w AS fixed, sum(weight) OVER w AS held, sum(source_size) OVER () AS total,
    sum(weight) OVER () AS weights,
    lead(3.0::DOUBLE * source_size / weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source) AS next
  FROM s WINDOW w AS (ORDER BY 3.0::DOUBLE * source_size / weight, source ROWS UNBOUNDED PRECEDING)),
steps AS (
  SELECT CAST(total AS DOUBLE) / CAST(weights AS DOUBLE) AS level, min(3.0::DOUBLE * source_size / weight) AS next, 0 AS k
  FROM k GROUP BY total, weights
  UNION ALL
  SELECT CAST(total - fixed AS DOUBLE) / CAST(weights - held AS DOUBLE), next, row_number() OVER (ORDER BY fixed)
  FROM k WHERE weights > held),
l AS (SELECT arg_min(level, k) AS level FROM steps WHERE next IS NULL OR level <= next),
t AS (
  SELECT source, source_size, CASE WHEN cap < level * weight THEN CAST(cap AS DOUBLE) ELSE level * weight END AS target
  FROM k, l),
w AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole FROM t),
o AS (
  SELECT d.*, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY place) AS upto
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target,
  CAST((whole + CASE WHEN upto - size / 2.0 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM o""",
    "op10_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
f AS (
  SELECT *, '<turn>' || replace(replace(replace(role, '\', '\\'), '<', '\<'), chr(10), '\n') || chr(10)
    || replace(replace(text, '\', '\\'), '<', '\<') || '</turn>' || chr(10) AS formatted FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""",
    "op11_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
w AS (SELECT row, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
e AS (
  SELECT g.lang, g.source, kept.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n
  FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (
  SELECT *, 1 + 1000000000 * (n + 5) // (sum(n) OVER s + 5 * count(*) OVER s) AS p
  FROM e WINDOW s AS (PARTITION BY lang, source)),
t AS (SELECT lang, term, sum(n) AS n FROM e GROUP BY lang, term),
q AS (
  SELECT lang, term, 1 + 1000000000 * (n + 5) // (sum(n) OVER s + 5 * count(*) OVER s) AS q
  FROM t WINDOW s AS (PARTITION BY lang)),
f AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value
  FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
  UNION ALL
  SELECT p.lang, source, 'term', p.term, CAST(p - q AS BIGINT) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term
  WHERE n > 0 AND p > q),
k AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT * FROM k WHERE part = 'pair' OR rank <= 50""",
    "op13_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
h AS (
  SELECT doc_id, text, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS x,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS y,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
c AS (
  SELECT *, least(x, y) AS a, greatest(x, y) - least(x, y) AS m, substr(text, 1, least(x, y)) AS pre,
    substr(text, least(x, y) + 1, greatest(x, y) - least(x, y)) AS mid, substr(text, greatest(x, y) + 1) AS suf
  FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c""",
}
