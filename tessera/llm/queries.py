"""The registered queries opN_<name>, each over its whole table with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, mixing, quality_knn, quality_llr, secret_scan, simhash, substring, token_files, url_filter
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="max").withColumnRenamed("digest", "text_sha256")


OP1_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document of the same number: bad if of low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0).alias("bad"))
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _shrunk(name: str, counts: str, parent: str) -> str:
    """CTEs that shrink the rates of ``counts`` (key columns, bad, n, prior) towards their parents' prior."""
    by, on = (f"group by {parent}", f"s.{parent} = c.{parent}") if parent else ("", "true")
    keys = f"{parent}, " if parent else ""
    return f"""{name}_s as (select {keys}any_value(prior) as mean, count(*) as k, sum(n * (bad / n - prior) * (bad / n - prior)) as ss, sum(n) as total from {counts} {by}),
{name}_t as (select *, least(greatest(mean * (1 - mean) / greatest((ss - k * (mean * (1 - mean))) / total, 1e-9::double) - 1, 2::double), 1000::double) as strength from {name}_s),
{name} as (select c.*, c.bad + s.strength * c.prior as alpha, c.n - c.bad + s.strength * (1 - c.prior) as beta from {counts} c join {name}_t s on {on})"""


OP2_SQL = f"""
with p as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {UPPER_LOWER}), '') as host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
named as (select *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as domain, list_extract(string_split(host, '.'), -1) as suffix from p),
hosts as (select host, domain, suffix, sum(case when l.quality = 0 or l.toxic = 1 then 1 else 0 end)::double as bad, count(*)::double as n from named join labels l on l.doc_id = page_id group by host, domain, suffix),
domains as (select suffix, domain, sum(bad) as bad, sum(n) as n from hosts group by suffix, domain),
suffixes as (select suffix, sum(bad) as bad, sum(n) as n from domains group by suffix),
whole as (select coalesce(sum(bad), 0) + 1 as alpha, coalesce(sum(n - bad), 0) + 1 as beta from suffixes),
s_in as (select suffixes.*, (select alpha / (alpha + beta) from whole) as prior from suffixes), {_shrunk("s", "s_in", "")},
d_in as (select domains.*, s.alpha / (s.alpha + s.beta) as prior from domains join s on s.suffix = domains.suffix), {_shrunk("d", "d_in", "suffix")},
h_in as (select hosts.host, hosts.domain, hosts.bad, hosts.n, d.alpha / (d.alpha + d.beta) as prior from hosts join d on d.domain = hosts.domain), {_shrunk("h", "h_in", "domain")},
j as (select named.*, coalesce(h.alpha, d.alpha, s.alpha, whole.alpha) as a, coalesce(h.beta, d.beta, s.beta, whole.beta) as b from named
 left join h on h.host = named.host left join d on d.domain = named.domain left join s on s.suffix = named.suffix cross join whole),
r as (select *, case when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/en/7') then 'example.com/en/7' when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/de/8') then 'example.net/de/8'
 when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/en/') then 'com/en/' when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/de/') then 'net/de/'
 when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/es/') then 'org/es/' end as rule from j)
select page_id, host, path, rule, case when rule in ('com/en/', 'example.net/de/8', 'org/es/') then 'block' when rule is not null then 'allow'
 when a / (a + b) - 1.645::double * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) > 0.5 then 'block' else 'allow' end as verdict from r
"""


def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.TokenFiles.write(table(spark, sf_dir, "documents"), tokenizer_path())
    return files.documents().withColumnRenamed("id", "doc_id")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup_passages(table(spark, sf_dir, "documents"), texts=False)


def op7_latent_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_knn.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_knn.score(docs, model)
    return scored.select("doc_id", quality_knn.held_out().alias("held_out"), "score", F.when(F.col("score") >= quality_knn.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op8_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def op9_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good and not toxic are trusted."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id")
    return quality_llr.judge(table(spark, sf_dir, "documents"), trusted)


QUERIES = {q.__name__: q for q in (op1_exact_dedup, op2_url_reputation, op3_simhash_bktree, op4_token_files, op5_bpe_round_trip, op6_block_anchors, op7_latent_neighbours, op8_randomness_battery, op9_pivotal_mix, op10_ngram_ratio)}
ORACLE = {"op1_exact_dedup": OP1_SQL, "op2_url_reputation": OP2_SQL}
