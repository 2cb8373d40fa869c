"""The queries of the numbered operators: whole tables in, the agreed columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import (
    brown, classifier, credentials, extract, mixing, negatives, orderhash, pieces, pii, rules, simhash, spelling, urls,
)
from tidewheel.llm.common import remainder, saved, table

#: Rows whose fingerprints differ in at most so many of 128 bits are near.
NEAR_BITS = 3
TOKENIZER = "piece_bpe_32k.model"
URL_RULES = [
    (urls.ALLOW, "com", "/"),
    (urls.BLOCK, "example.com", "/en/"),
    (urls.ALLOW, "www.example.com", "/en/"),
    (urls.BLOCK, "net", "/es/"),
    (urls.BLOCK, "net", "/fr/"),
]


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def simhash_query(spark: SparkSession, folder: str) -> DataFrame:
    """Besides the agreed columns ``near_rows``: for ids divisible by 100 the other rows near, else null."""
    docs = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = simhash.with_next(docs, ["text"], add=simhash.fingerprints)
    moved = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(
        F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 4) as int))"),
        F.substring("next_text", F.lit(1), moved),
    )
    rows = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "fingerprint",
        simhash.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        edited.alias("edited"),
    )
    rows = simhash.fingerprints(rows, "edited", "edited_fingerprint")
    rows = rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        simhash.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        "near_next",
    )
    # The texts are not read again: what is written is some 200 bytes a row.
    rows = saved(rows, "simhash")
    asks = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))
    found = simhash.near_rows(rows, asks, NEAR_BITS)
    rest = rows.where(~asks).withColumn("near_rows", F.lit(None).cast("long"))
    return rest.unionByName(rows.where(asks).join(found, "fingerprint"))


def urls_query(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


URLS_ORACLE = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
r(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT page_id, host, path, rh || rp AS rule, r.verdict AS v,
         row_number() OVER (PARTITION BY u.page_id ORDER BY length(rh || rp) DESC) AS n
  FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.n = 1
"""


def brown_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return brown.score(docs, remainder("doc_id", 7) != 2).select(
        "doc_id",
        (~F.col("trained")).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


def pieces_query(spark: SparkSession, folder: str) -> DataFrame:
    model = tokenizer()
    # The decoded text takes the place of the text, which need not come back from Python.
    rows = pieces.round_trip(table(spark, folder, "documents").select("doc_id", "text"), model, decoded="text")
    return rows.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def rules_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = rules.fit(docs, table(spark, folder, "labels"))
    return rules.judge(docs, model).drop("text")


def extract_query(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return extract.extract(pages).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def pii_query(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"),
        "spans",
    )


def classifier_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    aside = remainder("doc_id", 4) == 2
    network = classifier.fit(docs, table(spark, folder, "labels"), ~aside)
    return classifier.score(docs, network).select(
        "doc_id", aside.alias("held_out"), "score", "predicted"
    )


def orderhash_query(spark: SparkSession, folder: str) -> DataFrame:
    return orderhash.classes(table(spark, folder, "documents")).select(
        "doc_id", "class_id", "class_rows", "kept"
    )


def mixing_query(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def credentials_query(spark: SparkSession, folder: str) -> DataFrame:
    found = credentials.find(table(spark, folder, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"),
        "spans",
    )


def spelling_query(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def negatives_query(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, folder, "embeddings"))


QUERIES = {
    "op1_simhash": simhash_query,
    "op2_url_filter": urls_query,
    "op3_brown_lm": brown_query,
    "op4_sentencepiece": pieces_query,
    "op5_quality_rules": rules_query,
    "op6_html_text": extract_query,
    "op7_pii": pii_query,
    "op8_quality_classifier": classifier_query,
    "op9_order_minhash": orderhash_query,
    "op10_mixing": mixing_query,
    "op11_credentials": credentials_query,
    "op12_spelling": spelling_query,
    "op13_negatives": negatives_query,
}

#: The other operators rest on hashes, models or libraries that SQL cannot express.
ORACLES = {
    "op2_url_filter": URLS_ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_credentials": credentials.ORACLE,
    "op12_spelling": spelling.ORACLE,
    "op13_negatives": negatives.ORACLE,
}
