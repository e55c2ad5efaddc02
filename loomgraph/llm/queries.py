"""The subpackage's queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, divergence, exact_dedup, language_id, licenses, lm_scoring, mixing, quality, sharding, simhash, spelling, token_output
from .common import documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir)).withColumn("n_spans", F.size("spans")).drop("spans")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.write_tokens(documents(spark, sf_dir), tokenizer_path(), end_id=1).digest()


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(documents(spark, sf_dir), shards=40)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir, "doc_id", "source", "text"))
    return mixed.select("doc_id", "source", F.col("mix_copy").cast("long").alias("mix_copy"), F.col("mix_copies").cast("long").alias("mix_copies"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir, "doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.leaks(documents(spark, sf_dir), items)
    return found.select("doc_id", "item_id", F.col("shared").cast("long"), F.col("item_shingles").cast("long"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digest(chat.with_probe(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(documents(spark, sf_dir, "lang", "source", "text"))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(documents(spark, sf_dir), slips=31)


QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_token_ids, op3_language_id, op4_sharding, op5_mix_sources, op6_lm_score, op7_quality, op8_exact_dedup, op9_simhash, op10_decontamination, op11_chat_format, op12_source_divergence, op13_spelling_groups)
}

ORACLES = {
    "op8_exact_dedup": r"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
""",
    "op10_decontamination": r"""
WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
     b AS (SELECT item_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark),
     bs AS (SELECT DISTINCT id, least(len(w), 5) AS k, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM b WHERE len(w) > 0)),
     ks AS (SELECT DISTINCT k FROM bs),
     ds AS (SELECT DISTINCT id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN ks WHERE len(w) >= k)),
     n AS (SELECT id, count(*) AS size FROM bs GROUP BY id)
SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS shared, n.size AS item_shingles
FROM ds JOIN bs ON ds.s = bs.s AND ds.k = bs.k JOIN n ON n.id = bs.id
GROUP BY ds.id, bs.id, n.size HAVING count(*) >= ceil(n.size * 0.8 - 1e-9)
""",
    "op5_mix_sources": """
WITH s AS (SELECT source, count(*) AS size FROM documents GROUP BY source),
     t AS (SELECT sum(size) AS all_size, sum(pow(size, 0.7)) AS all_share FROM s),
     r AS (SELECT source, all_size * pow(size, 0.7) / all_share / size AS rate FROM s CROSS JOIN t),
     q AS (SELECT source, CAST(greatest(1, ceil(rate / 8)) AS INTEGER) AS parts, rate / greatest(1, ceil(rate / 8)) AS p FROM r),
     c AS (SELECT source, parts, list_transform(range(0, 49), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: exp(j * ln(p) - p - lgamma(j + 1))))) AS cdf FROM q),
     d AS (SELECT doc_id, documents.source AS source, text, CAST(list_sum(list_transform(range(1, parts + 1), lambda i: len(list_filter(cdf, lambda x: x <= CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')) || ':' || i), 1, 13) AS BIGINT) / 4503599627370496.0)))) AS BIGINT) AS n
           FROM documents JOIN c ON c.source IS NOT DISTINCT FROM documents.source)
SELECT doc_id, source, unnest(range(1, n + 1)) AS mix_copy, n AS mix_copies, md5(coalesce(text, '')) AS text_md5 FROM d WHERE n > 0
""",
    "op11_chat_format": r"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
           UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
     e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS body,
                  regexp_replace(replace(replace(role, '\', '\s'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') AS line FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, line, body)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, line, body) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(line) + 1 + length(body) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attachment_tokens
FROM e GROUP BY conv_id
""",
    "op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
     kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
     g AS (SELECT DISTINCT lang, source FROM d),
     v AS (SELECT g.lang, count(k.term) AS v, coalesce(sum(k.n), 0) AS n FROM (SELECT DISTINCT lang FROM g) g LEFT JOIN kept k ON k.lang = g.lang GROUP BY g.lang),
     c AS (SELECT t.lang, t.source, t.term, CAST(count(*) AS HUGEINT) AS n FROM t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, t.source, t.term),
     gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
     f AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 1) // (gn.n + v.v) AS p, 1 + 1000000000 * (k.n + 1) // (v.n + v.v) AS q
           FROM gn JOIN v ON v.lang = gn.lang JOIN kept k ON k.lang = gn.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
     s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
     x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
           FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
           UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM f WHERE n > 0 AND p > q),
     y AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM x)
SELECT lang, source, part, item, value, rank FROM y WHERE part = 'pair' OR rank <= 200
""",
}
