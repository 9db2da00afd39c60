"""One query for each operator over its whole table; every callable takes (spark, sf_dir)."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html, langid, licenses, pii, quality, shards, simhash, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


RULES = "allow com/, block example.com/en/, allow www.example.com/en/, block net/es/, block net/fr/"


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), urls.parse_rules(RULES))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(ids: bytes, decoded: str) -> tuple[int, str, str]:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    columns = [("n_tokens", pa.int64(), "long"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    return bpe.coded(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests, columns)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` have no paths: a source is a tree of folders by hundreds and thousands of doc_id."""
    docs = _table(spark, sf_dir, "documents")
    folder = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), folder(1000), folder(100), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(docs.withColumn("path", path))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = _table(spark, sf_dir, "documents")
    taught = docs.filter(~held_out).select("doc_id", "text", "lang")
    model = langid.fit(taught, public_tokenizers.path("piece_bpe_32k.model"))
    found = langid.identify(docs, model)
    return found.withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def told(spans: str) -> str:
        return f"concat_ws(',', transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)))"

    found = pii.find(_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.BASE]
    base = F.sha2(F.expr(told("filter(spans, s -> s.base)")), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), F.expr(told("spans")).alias("spans"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards.write_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=0)
    ids = shards.read_shards(found)
    return ids.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_table(spark, sf_dir, "documents"))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    found = found.withColumn("base_failed", failed).withColumn("kept", F.expr("not base_failed and kept"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", "votes")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def llm_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stated rules alone make of every url."""
    found = op1_urls(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def llm_pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def llm_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {f.__name__: f for f in (op1_urls, op2_bpe, op3_licenses, op4_langid, op5_pii, op6_shards, op7_quality, op8_html, op9_decontamination, op10_simhash, llm_url_rules, llm_pii_counts, llm_quality_counts)}

#: Containment needs no fingerprints to be told: shingles of both sides, joined and counted.
OP9_SQL = r"""
with items as (select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from benchmark where text is not null),
  wanted as (select distinct item_id, least(5, len(w)) as width, array_to_string(w[i.i:i.i + least(5, len(w)) - 1], ' ') as s from items, unnest(range(1, len(w) - least(5, len(w)) + 2)) i(i) where len(w) > 0),
  sizes as (select item_id, count(*) as n from wanted group by item_id),
  docs as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') as w from documents where text is not null),
  here as (select distinct doc_id, width, array_to_string(w[i.i:i.i + width - 1], ' ') as s from docs, (select distinct width from wanted), unnest(range(1, len(w) - width + 2)) i(i) where len(w) >= width)
select doc_id, item_id, count(*) / any_value(n) as containment from wanted join here using (width, s) join sizes using (item_id) group by doc_id, item_id having count(*) / any_value(n) >= 0.8 - 1e-9
"""

URL_SQL = r"""
with parts as (select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
  ruled as (select *, case
    when (host = 'www.example.com' or ends_with(host, '.www.example.com')) and starts_with(path, '/en/') then 'www.example.com/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/') then 'example.com/en/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/es/') then 'net/es/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/fr/') then 'net/fr/'
    when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/') then 'com/' end as rule from parts)
select page_id, host, path, rule, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' end as rule_verdict from ruled
"""

PII_SQL = r"""
with found as (select doc_id,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as emails,
    list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: cast(p as double))) <= 255) as ips,
    list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]([\x20-]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))), lambda d: length(d) between 14 and 19) as digits,
    list_filter(regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) between 10 and 15) as phones from documents)
select doc_id, cast(len(emails) as bigint) as n_email, cast(len(ips) as bigint) as n_ip,
  cast(len(list_filter(digits, lambda d: list_sum(list_transform(range(1, length(d) + 1), lambda i: case when i % 2 = 1 then cast(d[i] as int) when cast(d[i] as int) > 4 then 2 * cast(d[i] as int) - 9 else 2 * cast(d[i] as int) end)) % 10 = 0)) as bigint) as n_card,
  cast(len(phones) as bigint) as n_phone from found
"""

QUALITY_SQL = r"""
with docs as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
  runs as (select doc_id, i.i as i, w[i.i] || ' ' || w[i.i + 1] || ' ' || w[i.i + 2] as s from docs, unnest(range(1, len(w) - 1)) i(i)),
  twice as (select doc_id, i from runs qualify count(*) over (partition by doc_id, s) > 1),
  inside as (select doc_id, count(distinct i + k.k) as n from twice, (select unnest([0, 1, 2]) as k) k group by doc_id),
  counts as (select doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from docs)
select doc_id, n_words, word_chars, n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(n, 0) as n_repeat_words,
  n_words < 50 or 100 * coalesce(n, 0) > 50 * n_words as base_failed from counts left join inside using (doc_id)
"""

ORACLE_SQL = {"op9_decontamination": OP9_SQL, "llm_url_rules": URL_SQL, "llm_pii_counts": PII_SQL, "llm_quality_counts": QUALITY_SQL}
