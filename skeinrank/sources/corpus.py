"""The corpus that queries are ranked against, as tables: postings, metadata, statistics and links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import token_count, tokenize
from ..schemas import LINKS_JSON, METADATA_JSON, POSTINGS_JSON, STATS_JSON


@dataclass
class Corpus:
    """postings(term, doc_id, frequency, positions), metadata(doc_id, doc_length, time_last_updated, doc_type, image_count,
    doc_title, url), stats(avg_doc_length, doc_count; one row), links(url, page_rank, in_link_count, out_link_count)."""

    postings: DataFrame
    metadata: DataFrame
    stats: DataFrame
    links: DataFrame


def postings_of(documents: DataFrame) -> DataFrame:
    tokens = documents.select("doc_id", F.posexplode(tokenize(F.col("text"))).alias("position", "term"))
    return tokens.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("frequency"), F.sort_array(F.collect_list("position")).alias("positions"))


def stats_of(documents: DataFrame) -> DataFrame:
    return documents.agg(F.coalesce(F.avg(token_count(F.col("text"))), F.lit(0.0)).alias("avg_doc_length"), F.count("*").alias("doc_count"))


def metadata_of(documents: DataFrame, pages: DataFrame, how: str = "left") -> DataFrame:
    """One row for each document; what a missing page would say is empty. how='inner' leaves such documents out."""
    page = pages.select(F.col("page_id").alias("doc_id"), "url", F.regexp_count("html", F.lit("<img")).alias("images"), F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"))
    return documents.join(page, "doc_id", how).select(
        "doc_id",
        token_count(F.col("text")).alias("doc_length"),
        F.lit("2024-01-01T00:00:00Z").alias("time_last_updated"),
        F.col("source").alias("doc_type"),
        F.coalesce("images", F.lit(0)).alias("image_count"),
        F.coalesce("title", F.lit("")).alias("doc_title"),
        F.coalesce("url", F.lit("")).alias("url"),
    )


def links_of(pages: DataFrame) -> DataFrame:
    """Link statistics of pages with an even id: out-links are the page's links; in-links are, for each of its distinct
    targets, the other pages that link to it."""
    targets = pages.select("page_id", "url", F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'href="([^"]*)"'), F.lit(1)).alias("targets"))
    each = targets.select("page_id", F.explode(F.array_distinct("targets")).alias("target"))
    known = each.groupBy("target").agg((F.count("*") - 1).alias("others"))
    inward = each.join(known, "target").groupBy("page_id").agg(F.sum("others").alias("n"))
    return targets.where("page_id % 2 = 0").join(inward, "page_id", "left").select("url", (F.lit(1.0) / (1 + F.col("page_id"))).alias("page_rank"), F.coalesce("n", F.lit(0)).cast("int").alias("in_link_count"), F.size("targets").alias("out_link_count"))


def corpus_from_tables(spark: SparkSession, sf_dir: str, how: str = "left") -> Corpus:
    documents, pages = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet")
    return Corpus(postings_of(documents), metadata_of(documents, pages, how), stats_of(documents), links_of(pages))


def queries_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and query_text: the first three tokens of each benchmark text."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return items.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(tokenize(F.col("text")), 1, 3), " ").alias("query_text"))


def decode(df: DataFrame, column: str, schema: str, strict: bool = True) -> DataFrame:
    """The JSON in a column as struct `decoded`. Strict: a malformed text fails the job; else its fields are null."""
    return df.withColumn("decoded", F.from_json(column, schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"}))


def postings_from_json(df: DataFrame, column: str = "json", strict: bool = True) -> DataFrame:
    each = decode(df, column, POSTINGS_JSON, strict).select(F.col("decoded.term").alias("term"), F.explode("decoded.index").alias("p"))
    return each.select("term", F.col("p.docID").alias("doc_id"), F.coalesce("p.frequency", F.lit(0)).alias("frequency"), "p.positions")


def metadata_from_json(df: DataFrame, id_col: str = "doc_id", column: str = "json", strict: bool = False) -> DataFrame:
    """The id asked for counts, not the one in the reply; missing fields are zero or empty."""
    m = "decoded.metadata."
    return decode(df, column, METADATA_JSON, strict).select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(m + "docLength", F.lit(0)).alias("doc_length"),
        *[F.coalesce(m + a, F.lit(z)).alias(b) for a, b, z in (("timeLastUpdated", "time_last_updated", ""), ("docType", "doc_type", ""), ("imageCount", "image_count", 0), ("docTitle", "doc_title", ""), ("URL", "url", ""))],
    )


def stats_from_json(df: DataFrame, column: str = "json") -> DataFrame:
    return decode(df, column, STATS_JSON).select(F.coalesce("decoded.avgDocLength", F.lit(0.0)).alias("avg_doc_length"), F.coalesce("decoded.docCount", F.lit(0)).alias("doc_count"))


def links_from_json(df: DataFrame, url_col: str = "url", column: str = "json", strict: bool = False) -> DataFrame:
    return decode(df, column, LINKS_JSON, strict).select(F.col(url_col).alias("url"), F.coalesce("decoded.pageRank", F.lit(0.0)).alias("page_rank"), F.coalesce("decoded.inLinkCount", F.lit(0)).alias("in_link_count"), F.coalesce("decoded.outLinkCount", F.lit(0)).alias("out_link_count"))
