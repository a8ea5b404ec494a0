"""Registered queries of the subpackage, one per operator, and the SQL that says the same."""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.llm import (bpe_trie, decontaminate, embedding_whitening, language_crf, minhash_dedup, mixing, order_minhash, periodic_runs,
                        seed_extend, suffix_family, token_ids, url_filter, warc)
from tabvet.llm.common import table


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_report(table(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = suffix_family.repeated_spans(table(spark, sf_dir, "documents"))
    return suffix_family.without_repeats(spans).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    field = language_crf.learn(docs.where(~language_crf.held_out() & F.col("doc_id").isNotNull()))
    out = language_crf.identify(docs.select("doc_id", language_crf.held_out().alias("held_out"), "text"), field)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op5_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = seed_extend.repeated_spans(table(spark, sf_dir, "documents"))
    return seed_extend.without_repeats(spans).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), texts=False)
    return plan.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                       F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = token_ids.write_token_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2,
                                       encoder=partial(token_ids.kept_encoder, cache_words=500_000, chunk_chars=1 << 21))
    return token_ids.read_token_ids(blocks, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = warc.write_packages(table(spark, sf_dir, "pages"), least_bytes=0)
    return warc.read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judged(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = bpe_trie.decode(bpe_trie.encode(table(spark, sf_dir, "documents"), path), path)
    return texts.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.with_period(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    found = found.withColumn("top", longest)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"), F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_order_minhash": op1_order_minhash,
    "op2_minhash_dedup": op2_minhash_dedup,
    "op3_suffix_family": op3_suffix_family,
    "op4_language_crf": op4_language_crf,
    "op5_seed_extend": op5_seed_extend,
    "op6_mixing": op6_mixing,
    "op7_url_filter": op7_url_filter,
    "op8_token_ids": op8_token_ids,
    "op9_warc": op9_warc,
    "op10_decontamination": op10_decontamination,
    "op11_bpe_trie": op11_bpe_trie,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE = {
    "op2_minhash_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
            FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS t(i) WHERE len(ws) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        link AS (
            SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
        edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.other)
        SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id, w.doc_id = min(other) AS kept
        FROM w JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id""",
    "op7_url_filter": r"""
        WITH u AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0
                            THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
            FROM pages),
        p AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path
            FROM (SELECT page_id, coalesce(rest, '') AS rest FROM u)),
        r(verdict, h, q) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                    ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        fits AS (
            SELECT p.*, r.h || r.q AS rule, r.verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.q) DESC NULLS LAST) AS k
            FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.q))
        SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host || path,
                   '(^|[^A-Za-z0-9])(?i:casino|poker|betting|porn|xxx|warez|torrent)([^A-Za-z0-9]|$)')
                   THEN 'block' ELSE 'allow' END) AS verdict
        FROM fits WHERE k = 1""",
    # Base32 of the SHA-1: its 32 groups of five bits, taken from the hex digest two bytes at a time.
    "op9_warc": """
        WITH d AS (SELECT page_id, coalesce(html, '') AS html, sha1(encode(coalesce(html, ''))) AS hex FROM pages),
        g AS (SELECT hex, max(page_id) AS keeper FROM d GROUP BY hex)
        SELECT page_id, strlen(html) AS payload_bytes,
               list_aggregate(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST((('0x' || rpad(substr(d.hex, CAST(1 + (k * 5) // 4 AS BIGINT), 3), 3, '0'))::BIGINT
                             >> CAST(7 - (k * 5) % 4 AS BIGINT)) & 31 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
        FROM d JOIN g USING (hex)""",
    "op10_decontamination": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        phrase AS (
            SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + 12], ' ') AS p
            FROM b, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS t(i) WHERE len(ws) > 0),
        lens AS (SELECT DISTINCT n FROM phrase),
        grams AS (
            SELECT doc_id, i, lens.n AS n, array_to_string(ws[i:i + lens.n - 1], ' ') AS p
            FROM w, lens, unnest(range(1, len(ws) - lens.n + 2)) AS t(i)),
        hits AS (SELECT g.doc_id, g.i, g.n, phrase.item_id FROM grams g JOIN phrase USING (n, p)),
        covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
        listed AS (
            SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)""",
}
