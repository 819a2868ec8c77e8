"""The queries of the training-data operators over the driver's tables, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, exact_dedup, jaccard_join, licenses, line_dedup, mixing, packing, secrets, toxicity, url_filter
from .common import table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    _QUERIES[run.__name__] = run
    return run


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE_RULES]
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(secrets.span_text(F.col("spans"), base).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(spark, table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join("removed", ",").alias("removed_lines"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(toxicity.may_learn(F.col("doc_id"))))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(~toxicity.may_learn(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted", "evidence")


@query
def op4_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(spark, table(spark, sf_dir, "documents"))


_SQL["op6_exact_dedup"] = """
WITH each AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM each WINDOW same AS (PARTITION BY text_sha256)
"""

#: Runs of marks in a page's text by which its content is judged junk, and how many of them it takes.
JUNK_MARKS, JUNK_RUNS = ("%%%", "***", "$$$"), 3


#: Sources and topics are tempered, languages given. Sources of one size get equal shares.
MIX_TARGETS = {"source": 0.3, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "topic": 0.5}


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(spark, mixing.describe(docs, mixing.fit_topics(docs)), MIX_TARGETS)


def junk_urls(pages: DataFrame) -> DataFrame:
    """The list: canonical URLs of pages judged junk by their content, whatever their address looks like."""
    runs = sum((F.size(F.split("html", "\\Q" + m + "\\E")) - 1 for m in JUNK_MARKS), start=F.lit(0))
    return pages.where(runs >= JUNK_RUNS).select(url_filter.canonical(F.col("url")).alias("url"))


@query
def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(spark, pages, junk_urls(pages))


_SQL["op8_url_filter"] = r"""
WITH cut AS (
  SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), part AS (
  SELECT page_id, html, rest, split_part(rest, '#', 1) AS address, split_part(split_part(split_part(rest, '#', 1), '?', 1), '/', 1) AS raw_host,
    split_part(split_part(rest, '#', 1), '?', 1) AS place
  FROM cut
), named AS (
  SELECT page_id, html, rest, coalesce(translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(substr(place, length(raw_host) + 1), '') AS path, coalesce(substr(address, length(place) + 2), '') AS query
  FROM part
), canon AS (
  SELECT *, CASE WHEN rest IS NOT NULL THEN
    regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(regexp_replace(path, '(?:/+|/index)$', ''), '\.html?$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|$)'))), '&'), ''), '') END AS canonical
  FROM named
), rules(rule, verdict, site, prefix) AS (
  VALUES ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'), ('www.example.com/en/', 'allow', 'www.example.com', '/en/'),
         ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')
), best AS (
  SELECT page_id, arg_max(rules.rule, length(rules.rule)) AS rule, arg_max(rules.verdict, length(rules.rule)) AS verdict
  FROM canon JOIN rules ON ends_with('.' || host, '.' || site) AND starts_with(path, prefix) GROUP BY page_id
), listed AS (
  SELECT DISTINCT canonical FROM canon
  WHERE canonical IS NOT NULL AND len(string_split(html, '%%%')) + len(string_split(html, '***')) + len(string_split(html, '$$$')) - 3 >= 3
)
SELECT canon.page_id, host, path, best.rule,
  CASE WHEN best.rule IS NOT NULL THEN best.verdict WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict,
  best.rule IS NULL AND coalesce(canonical IN (SELECT canonical FROM listed), false) AS listed
FROM canon LEFT JOIN best USING (page_id)
"""


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    told = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    changed = F.flatten(F.transform("licenses", lambda x: x["differences"]))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(told, ",").alias("licenses"), F.array_join(changed, " ").alias("differences"))


@query
def op10_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark, table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
